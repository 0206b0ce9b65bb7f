"""Secret scans by patterns and a randomness battery, with DataFrame functions only.

Patterns give the base spans. Beyond them, every long run of encoding characters is a candidate, or its parts are if no encoding
has all of its characters: its encoding is inferred from the characters that it holds, and three tests ask whether they are uniform (chi-squared), in no order (runs above and below the
middle of the alphabet) and without memory (serial correlation). A candidate that passes all three is a discovery against the
hypothesis that it is text: the p-value that enters a Benjamini-Hochberg control over the candidates of all documents, weighted
by length, on a histogram of p-values, is the chance that letters of text in the same encoding come as near to uniform, by the
same statistic, as the candidate's characters do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prevspark.llm.common import let, running, store

#: Kind, pattern, group that is measured, its least characters.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # the run from its first AKIA on; shorter ones fail whole
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # whole runs; shorter ones fail
]
RANDOM = "random"
LEAST, CANDIDATE = 20, r"[A-Za-z0-9+/_=-]{20,}"
#: Runs of one encoding, what signs of equality that do not end a run leave, and such parts that mix two encodings.
ALONE, BETWEEN, MIXED = r"^([A-Za-z0-9+/]+|[A-Za-z0-9_-]+)=*$", r"[A-Za-z0-9+/_-]+(?:=+$)?", r"[+/].*[_-]|[_-].*[+/]"
#: The parts of a mixed part that either encoding allows; they may overlap.
EITHER = (r"[A-Za-z0-9_-]+(?:=+$)?", r"[A-Za-z0-9+/]+(?:=+$)?")
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: An encoding's pattern and alphabet, the narrowest first. Digits alone are no encoding.
ENCODINGS = [
    (r"^[0-9]+$", ""),
    (r"^[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^[a-z]+$", LOWER),
    (r"^[A-Z2-7]+$", UPPER + "234567"),
    (r"^[a-z0-9]+$", DIGITS + LOWER),
    (r"^[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    (r"^[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
]
#: Letters of a hundred of English text, from a to z.
LETTERS = dict(zip(LOWER, (
    8.17, 1.49, 2.78, 4.25, 12.70, 2.23, 2.02, 6.09, 6.97, 0.15, 0.77, 4.03, 2.41,
    6.75, 7.51, 1.93, 0.10, 5.99, 6.33, 9.06, 2.76, 0.98, 2.36, 0.15, 1.97, 0.07,
)))
#: Pairs of equal characters to expect up to which their number counts as one of rare events, and beyond which as normal.
FEW = 30.0
#: Level of the battery below which a candidate is not random; false discovery rate; bins of the histogram per halving of p.
LEVEL, RATE, BINS, LAST_BIN = 1e-2, 0.05, 8, 4096


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """(part, start, end) of each match: its group, and its code points."""

    def build(found: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        sizes = F.transform(found, lambda m: F.length(m).cast("long"))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.concat(F.array(F.lit(0).cast("long")), sizes), lambda g, m: g + m)
        starts = running(F.filter(steps, lambda s: s.isNotNull()))
        parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        return F.transform(
            F.arrays_zip(found.alias("m"), parts.alias("p"), starts.alias("s")),
            lambda z: F.struct(z["p"].alias("part"), z["s"].alias("start"), (z["s"] + F.length(z["m"])).alias("end")),
        )

    none = F.array().cast("array<struct<part:string,start:bigint,end:bigint>>")
    hits = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), build)
    return F.when(text.rlike(pattern), hits).otherwise(none)


def base_spans(text: Column) -> Column:
    """(start, order, kind, end) of the patterns' matches, in order."""
    def spans(order: int, kind: str, pattern: str, group: int, least: int) -> Column:
        held = F.filter(located(text, pattern, group), lambda x: F.length(x["part"]) >= least)
        columns = lambda x: [x["start"].alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), x["end"].alias("end")]
        return F.transform(held, lambda x: F.struct(*columns(x)))

    return F.sort_array(F.concat(*[spans(order, *each) for order, each in enumerate(BASE)]))


def candidates(text: Column) -> Column:
    """(part, start, end) of the long runs of encoding characters, or of their long parts that one encoding allows."""

    def inside(whole: Column, pattern: str) -> Column:
        move = lambda x: F.struct(x["part"].alias("part"), (x["start"] + whole["start"]).alias("start"), (x["end"] + whole["start"]).alias("end"))
        return F.transform(located(whole["part"], pattern), move)

    def parts(run: Column) -> Column:
        either = lambda p: F.array_distinct(F.concat(*[inside(p, x) for x in EITHER]))
        each = F.transform(inside(run, BETWEEN), lambda p: F.when(p["part"].rlike(MIXED), either(p)).otherwise(F.array(p)))
        return F.filter(F.flatten(each), lambda p: F.length(p["part"]) >= LEAST)

    return F.flatten(F.transform(located(text, CANDIDATE), lambda c: F.when(c["part"].rlike(ALONE), F.array(c)).otherwise(parts(c))))


def joined(spans: Column) -> Column:
    """``spans`` (start, end), in order, with those that overlap made one."""

    def add(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        both = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(last["end"] > s["start"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(both))).otherwise(F.concat(done, F.array(s)))

    def apart(x: Column) -> Column:
        overlap = F.exists(F.zip_with(x, F.slice(x, F.lit(2), F.size(x)), lambda a, b: a["end"] > b["start"]), lambda y: F.coalesce(y, F.lit(False)))
        return F.when(overlap, F.aggregate(x, F.array().cast("array<struct<start:bigint,end:bigint>>"), add)).otherwise(x)

    return let(F.array_sort(spans), apart)


def upper_tail(z: Column) -> Column:
    """Chance that a standard normal exceeds ``z``; by formula 7.1.26 of Abramowitz and Stegun, whose constants are fixed."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def repeats(alphabet: str) -> tuple[float, float]:
    """Chance that two, or three, letters of text that an encoding has are the same."""
    own = [n for c, n in LETTERS.items() if c in alphabet.lower()]
    total = sum(own) or 1.0
    return sum((n / total) ** 2 for n in own), sum((n / total) ** 3 for n in own)


def battery(token: Column) -> Column:
    """(random, text): p-value of the battery, and the chance that text of the token's length repeats as little; null without encoding."""

    def tests(t: Column) -> Column:
        kind = lambda a: F.struct(F.lit(a).alias("a"), *[F.lit(x).alias(n) for n, x in zip(("pair", "triple"), repeats(a))])
        known = F.coalesce(*[F.when(t.rlike(p), kind(a)) for p, a in ENCODINGS])
        return let(known, lambda e: F.when(F.length(e["a"]) > 1, measured(t, e["a"], e["pair"], e["triple"])))

    return let(F.regexp_replace(token, "=+$", ""), tests)


def at_least(x: Column, mean: Column) -> Column:
    """Chance of ``x`` or more rare events where ``mean`` are expected."""

    def step(state: Column, i: Column) -> Column:
        return F.struct((state["below"] + state["next"]).alias("below"), (state["next"] * mean / i).alias("next"))

    start = F.struct(F.lit(0.0).alias("below"), F.exp(-mean).alias("next"))
    below = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), x.cast("int"))), start, step, lambda s: s["below"])
    return F.when(x < 1, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - below))


def measured(t: Column, alphabet: Column, pair: Column, triple: Column) -> Column:
    n, k = F.length(t).cast("double"), F.length(alphabet).cast("double")
    count = lambda s, part: (F.length(s) - F.length(F.replace(s, part, F.lit("")))) / F.length(part)
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda x, a: x + F.when(a == "", 0.0).otherwise(F.pow(count(t, a), F.lit(2.0))))
    places = F.transform(F.filter(F.split(t, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double"))

    def with_places(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
        square = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
        ahead = F.concat(F.slice(x, F.lit(2), F.size(x)), F.slice(x, F.lit(1), F.lit(1)))
        product = F.aggregate(F.zip_with(x, ahead, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        bits = F.array_join(F.transform(x, lambda v: F.when(v > k / 2, "1").otherwise("0")), "")
        return let(F.struct(total.alias("s"), square.alias("q"), product.alias("p"), bits.alias("b"), squares.alias("c")), decided)

    def decided(m: Column) -> Column:
        # the chi-squared statistic is k / n times twice the pairs of equal characters, and a constant
        equal, even = (m["c"] - n) / 2, n * (n - 1) / 2 / k
        p_chi = F.when(even <= FEW, at_least(equal, even)).otherwise(upper_tail((equal - even) / F.sqrt(even * (1 - 1 / k))))
        high = count(m["b"], F.lit("1"))
        runs = 1 + count(m["b"], F.lit("01")) + count(m["b"], F.lit("10"))
        mean = 2 * high * (n - high) / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = F.when(spread > 0, 2 * upper_tail(F.abs(runs - mean) / F.sqrt(spread))).otherwise(0.0)
        scale = n * m["q"] - m["s"] * m["s"]
        serial = F.when(scale > 0, (n * m["p"] - m["s"] * m["s"]) / scale)
        p_serial = F.coalesce(2 * upper_tail(F.abs(serial + 1 / (n - 1)) * F.sqrt(n)), F.lit(0.0))
        expected = n * (n - 1) / 2 * pair
        variance = n * (n - 1) / 2 * (pair - pair * pair) + n * (n - 1) * (n - 2) * (triple - pair * pair)
        p_text = upper_tail((expected - equal) / F.sqrt(variance))
        return F.struct(F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial)).alias("random"), p_text.alias("text"))

    return let(places, with_places)


def bin_of(p: Column) -> Column:
    """The bin of a p-value: the larger, the less likely."""
    halvings = -F.log2(F.greatest(p, F.lit(2.0 ** (-LAST_BIN / BINS))))
    return F.greatest(F.lit(0), F.least(F.lit(LAST_BIN), F.floor(halvings * BINS))).cast("int")


def threshold(counts: list[tuple[int, int]], rate: float = RATE) -> int:
    """The least bin that Benjamini and Hochberg's rule accepts, with every p-value at the upper edge of its bin."""
    total, above, best = sum(n for _, n in counts), 0, LAST_BIN + 1
    for b, n in sorted(counts, reverse=True):
        above += n
        if 2.0 ** (-b / BINS) <= rate * above / total:
            best = b
    return best


def scanned(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) of every row of ``docs`` (doc_id, text).

    Null texts count as empty; rows that repeat stay; spans are code points, kind:start:end, comma-joined by start and then
    kind. Random spans never overlap base spans. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = F.transform(candidates(text), lambda c: F.struct(c["start"], c["end"], battery(c["part"]).alias("p")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), base_spans(text).alias("base"), raw.alias("raw"))
    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    weight = lambda c: F.log2((c["end"] - c["start"]).cast("double"))
    fit = F.filter("raw", lambda c: c["p"].isNotNull() & apart(c))
    rows = rows.select("doc_id", "base", F.transform(fit, lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), weight(c).alias("weight"), c["p"]["random"].alias("random"), c["p"]["text"].alias("text")
    )).alias("fit"))
    rows = store(rows, "candidates")
    each = rows.select(F.explode("fit").alias("c"))
    mean = each.agg(F.avg("c.weight")).first()[0] or 1.0
    place = lambda c: bin_of(c["text"] * F.lit(mean) / c["weight"])
    counts = each.groupBy(place(F.col("c")).alias("bin")).count().collect()  # LAST_BIN + 1 rows at most
    least = threshold([(r["bin"], r["count"]) for r in counts], rate) if counts else LAST_BIN + 1
    kept = F.filter("fit", lambda c: (c["random"] >= LEVEL) & (place(c) >= least))
    found = joined(F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    added = F.transform(found, lambda c: F.struct(
        c["start"].alias("start"), F.lit(len(BASE)).alias("order"), F.lit(RANDOM).alias("kind"), c["end"].alias("end")
    ))
    rows = rows.select("doc_id", "base", added.alias("added"))
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id",
        *[number(kind).alias(f"n_{kind}") for kind, *_ in BASE],
        F.sha2(shown("base").cast("binary"), 256).alias("base_sha256"),
        shown(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )
