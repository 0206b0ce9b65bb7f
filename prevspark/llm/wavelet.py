"""A wavelet matrix over token ids: one compressed file with access, rank, select and occurrence lookup.

Level by level, from the top bit down, the ids are dealt stably into zeros and ones; each level keeps its bits as a packed
plane with the number of ones before every block. The file holds the planes and counts, compressed with zstandard, the
documents' ids and lengths, and the ids that occur, so that a shard stands on its own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import zstandard

MAGIC = b"PWM1"
#: Bits between two stored counts of ones.
BLOCK_BITS = 512
_HEAD = struct.Struct("<4sIQQ")  # magic, levels, tokens, documents
_LEVEL = struct.Struct("<QII")  # zeros, bytes of the plane, bytes of the counts


def kind_for(n: int) -> np.dtype:
    """The narrowest type for numbers below ``n``."""
    return np.dtype("<u2") if n <= 1 << 16 else np.dtype("<u4")


class WaveletMatrix:
    """Ids of a shard and where its documents end."""

    def __init__(self, n: int, symbols: np.ndarray, levels: list[tuple[int, np.ndarray, np.ndarray]]):
        self.n, self.symbols, self.levels = n, symbols, levels
        self.kind = kind_for(len(symbols))

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        # the shard's own ids, numbered in order, need fewer levels than all ids
        symbols = np.flatnonzero(np.bincount(ids.astype(np.int64), minlength=1)).astype("<u4")
        kind = kind_for(len(symbols))
        number = np.zeros(int(symbols.max(initial=0)) + 1, dtype=kind)
        number[symbols] = np.arange(len(symbols))
        left, levels = number[ids], []
        for bit in range(max(1, (len(symbols) - 1).bit_length()) - 1, -1, -1):
            ones = (left & kind.type(1 << bit)) != 0
            plane = np.packbits(ones)
            levels.append((len(left) - int(np.count_nonzero(ones)), plane, counts(plane)))
            left = np.concatenate((left[~ones], left[ones]))
        return cls(len(ids), symbols, levels)

    def all(self) -> np.ndarray:
        """Every id, in order: the deals are undone from the last level up."""
        ids = np.zeros(self.n, dtype=self.kind)
        for bit, (zeros, plane, _) in enumerate(reversed(self.levels)):
            ones = np.unpackbits(plane, count=self.n).view(bool)
            before = np.empty_like(ids)
            before[~ones] = ids[:zeros]
            before[ones] = ids[zeros:] | self.kind.type(1 << bit)
            ids = before
        return self.symbols[ids] if self.n else self.symbols[:0]

    def _ones_before(self, level: int, at: int) -> int:
        _, plane, before = self.levels[level]
        block = at // BLOCK_BITS
        first = block * BLOCK_BITS // 8
        inside = int(np.bitwise_count(plane[first : at // 8]).sum())
        rest = int(plane[at // 8]) >> (8 - at % 8) if at % 8 else 0
        return int(before[block]) + inside + rest.bit_count()

    def access(self, at: int) -> int:
        """The id at a place."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for level, (zeros, plane, _) in enumerate(self.levels):
            bit = int(plane[at // 8]) >> (7 - at % 8) & 1
            ones = self._ones_before(level, at)
            at = zeros + ones if bit else at - ones
            value = value << 1 | bit
        return int(self.symbols[value])

    def _number(self, token: int) -> int:
        """The number of an id in this shard; -1 if it is not in it."""
        at = int(np.searchsorted(self.symbols, token)) if token >= 0 else len(self.symbols)
        return at if at < len(self.symbols) and int(self.symbols[at]) == token else -1

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the last level has the occurrences of ``token`` among the first ``end`` ids."""
        token = self._number(token)
        if token < 0:
            return 0, 0
        first = 0
        for level, (zeros, _, _) in enumerate(self.levels):
            a, b = self._ones_before(level, first), self._ones_before(level, end)
            one = token >> (len(self.levels) - 1 - level) & 1
            first, end = (zeros + a, zeros + b) if one else (first - a, end - b)
        return first, end

    def rank(self, token: int, end: int) -> int:
        """How often ``token`` is among the first ``end`` ids."""
        first, last = self._range(token, min(max(end, 0), self.n))
        return last - first

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence (from 0) of ``token``."""
        first, last = self._range(token, self.n)
        if not 0 <= k < last - first:
            raise IndexError(k)
        at, token = first + k, self._number(token)
        for level in range(len(self.levels) - 1, -1, -1):
            zeros = self.levels[level][0]
            one = token >> (len(self.levels) - 1 - level) & 1
            at = self._select_bit(level, at - zeros if one else at, one)
        return at

    def _select_bit(self, level: int, k: int, one: int) -> int:
        _, plane, before = self.levels[level]
        held = before if one else np.arange(len(before)) * BLOCK_BITS - before
        block = int(np.searchsorted(held, k, side="right")) - 1
        first = block * BLOCK_BITS
        bits = np.unpackbits(plane[first // 8 : (first + BLOCK_BITS) // 8])[: self.n - first]
        return first + int(np.flatnonzero(bits == one)[k - int(held[block])])

    def find(self, token: int) -> Iterator[int]:
        """The places of ``token``, in order."""
        return (self.select(token, k) for k in range(self.count(token)))


def counts(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of a plane, and before its end."""
    ones = np.bitwise_count(plane).astype(np.uint32)
    starts = np.arange(0, len(ones), BLOCK_BITS // 8)
    sums = np.add.reduceat(ones, starts) if len(ones) else ones
    return np.r_[np.uint32(0), np.cumsum(sums, dtype=np.uint32)].astype(np.uint32)


def to_bytes(matrix: WaveletMatrix, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """One shard as a file."""
    pack = zstandard.ZstdCompressor(level=1).compress
    ids = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    absent = np.packbits(np.array([d is None for d in doc_ids], dtype=bool))
    parts = [_HEAD.pack(MAGIC, len(matrix.levels), matrix.n, len(ids))]
    for section in (ids, absent, np.asarray(lengths, dtype="<u8"), matrix.symbols.astype("<u4")):
        held = pack(section.tobytes())
        parts += [struct.pack("<Q", len(held)), held]
    for zeros, plane, before in matrix.levels:
        bits, ranks = pack(plane.tobytes()), pack(before.astype("<u4").tobytes())
        parts += [_LEVEL.pack(zeros, len(bits), len(ranks)), bits, ranks]
    return b"".join(parts)


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """A shard's matrix, document ids and lengths."""
    unpack = zstandard.ZstdDecompressor().decompress
    magic, n_levels, n, docs = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    at, sections = _HEAD.size, []
    for _ in range(4):
        (size,) = struct.unpack_from("<Q", data, at)
        sections.append(unpack(data[at + 8 : at + 8 + size]))
        at += 8 + size
    absent = np.unpackbits(np.frombuffer(sections[1], dtype=np.uint8), count=docs)
    ids = [None if gone else i for i, gone in zip(np.frombuffer(sections[0], dtype="<i8").tolist(), absent.tolist())]
    levels = []
    for _ in range(n_levels):
        zeros, bits, ranks = _LEVEL.unpack_from(data, at)
        at += _LEVEL.size
        plane = np.frombuffer(unpack(data[at : at + bits]), dtype=np.uint8)
        before = np.frombuffer(unpack(data[at + bits : at + bits + ranks]), dtype="<u4")
        levels.append((zeros, plane, before))
        at += bits + ranks
    return WaveletMatrix(n, np.frombuffer(sections[3], dtype="<u4"), levels), ids, np.frombuffer(sections[2], dtype="<u8").astype(np.int64)
