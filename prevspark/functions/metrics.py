"""Errors and descriptions of prevalence vectors, as expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prevspark.functions.expressions import total


def absolute_error(p: Column, found: Column) -> Column:
    """Mean absolute difference."""
    return total(F.zip_with(p, found, lambda a, b: F.abs(a - b))) / F.size(p)


def l1_error(p: Column, found: Column) -> Column:
    """Sum of absolute differences."""
    return total(F.zip_with(p, found, lambda a, b: F.abs(a - b)))


def relative_absolute_error(p: Column, found: Column, n: Column) -> Column:
    """Mean relative error after both are smoothed by half an item of ``n``."""
    eps = 1 / (2 * n)
    even = lambda x: (x + eps) / (1 + eps * F.size(p))
    return total(F.zip_with(p, found, lambda a, b: F.abs(even(a) - even(b)) / even(a))) / F.size(p)


def is_pdf(p: Column) -> Column:
    """Entries sum to one and none is negative, up to rounding."""
    small = 2.0**-26
    return (F.abs(total(p) - 1) < small) & F.forall(p, lambda x: x > -small)


def mdpa(a: Column, b: Column) -> Column:
    """Minimum difference of pair assignments: distances of the cumulative sums, per unit of ``a``."""
    gaps = F.zip_with(a, b, lambda x, y: x - y)
    zero = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda s, g: F.struct((s["run"] + g).alias("run"), (s["sum"] + F.abs(s["run"] + g)).alias("sum"))
    return F.aggregate(gaps, zero, step, lambda s: s["sum"]) / total(a)


def nmd(a: Column, b: Column) -> Column:
    """MDPA as a share of the largest possible one."""
    return mdpa(a, b) / (F.size(a) - 1)


def curvature(p: Column) -> Column:
    """Half the squared second differences."""
    inner = F.sequence(F.lit(1), F.size(p) - 2)
    bend = lambda i: 2 * F.get(p, i) - F.get(p, i - 1) - F.get(p, i + 1)
    return F.when(F.size(p) > 2, total(F.transform(inner, lambda i: bend(i) * bend(i))) / 2).otherwise(F.lit(0.0))


def log10_density(p: Column, a_eff: Column, n: Column) -> Column:
    """Density of log10(1 + spectrum): prevalences corrected by the effective area, as counts, normalised."""
    spectrum = F.zip_with(p, a_eff, lambda x, a: x / a)
    logs = F.transform(spectrum, lambda x: F.log10(1 + x / total(spectrum) * (n - F.size(p))))
    return F.transform(logs, lambda x: x / total(logs))


def crab_flux(energy: Column) -> Column:
    """Differential flux of the Crab Nebula at an energy in GeV (published log-parabola, constants fixed)."""
    x = energy / 1e3
    return 3.23e-10 * F.pow(x, -2.47 - 0.24 * F.log10(x))


def corrected_flux(p: Column, a: Column, flux: Column) -> Column:
    """Acceptance-corrected prevalences scaled to the total of a reference flux."""
    raw = F.zip_with(p, a, lambda x, y: x * y)
    return F.transform(raw, lambda x: x / total(raw) * total(flux))


def percentiles(value: str, at=(0.05, 0.25, 0.5, 0.75, 0.95)) -> Column:
    """Exact interpolated quantiles, as an aggregate."""
    return F.percentile(value, F.array(*[F.lit(x) for x in at]))
