"""Column functions on numbers and arrays. Defined results: null in, null out; a zero denominator gives null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def phred(q: Column) -> Column:
    """Probability of error of a quality."""
    return F.pow(F.lit(10.0), q * -0.1)


def round_significant(x: Column, n: int) -> Column:
    """Rounded to n significant digits (half to even); 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(n - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, x.cast("double")).otherwise(F.rint(x * scale) / scale)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: mean by weight of the values that are neither null nor NaN."""
    ok = value.isNotNull() & ~F.isnan(value.cast("double"))
    return F.try_divide(F.sum(F.when(ok, value * weight)), F.sum(F.when(ok, weight)))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def array_mean(a: Column) -> Column:
    return F.try_divide(array_sum(a), F.size(a))


def mean_mad(a: Column) -> Column:
    """Mean deviation from the mean of an array."""
    m = array_mean(a)
    return F.try_divide(array_sum(F.transform(a, lambda x: F.abs(x - m))), F.size(a))


def array_median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    lo, hi = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def median_mad(a: Column) -> Column:
    """Median deviation from the median of an array."""
    m = array_median(a)
    return array_median(F.transform(a, lambda x: F.abs(x - m)))


def mean_pair_difference(a: Column) -> Column:
    """Mean of the absolute differences of all pairs of an array: of sorted values, by their ranks (no pair is formed)."""
    s, n = F.array_sort(a), F.size(a)
    total = F.aggregate(F.transform(s, lambda x, i: x * (2 * i - n + 1)), F.lit(0.0), lambda t, x: t + x)
    return F.when(n > 1, total / (n * (n - 1) / 2))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of arrays, at most 1; null for a vector of length 0."""
    return F.least(F.lit(1.0), F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def argmin(a: Column) -> Column:
    """Place (from 0) of the least value of an array that is neither null nor NaN."""
    ok = F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.nullif(F.array_position(a, F.array_min(ok)).cast("long"), F.lit(0).cast("long")) - 1


def argmax(a: Column) -> Column:
    ok = F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))
    return F.nullif(F.array_position(a, F.array_max(ok)).cast("long"), F.lit(0).cast("long")) - 1


def all_minima(a: Column) -> Column:
    """Places (from 0) of all least values of an array."""
    m = F.array_min(a)
    return F.filter(F.transform(a, lambda x, i: F.when(x == m, i)), lambda i: i.isNotNull())


def integer_bounds(x: Column, elevate: bool = True) -> Column:
    """struct(lower, upper): the whole numbers around x; of a whole number itself and the next one (the one before, without
    ``elevate``)."""
    lo, hi = F.floor(x), F.ceil(x)
    whole = lo == hi
    return F.struct(F.when(whole & F.lit(not elevate), lo - 1).otherwise(lo).alias("lower"), F.when(whole & F.lit(elevate), hi + 1).otherwise(hi).alias("upper"))


def digitize(x: Column, edges: Sequence[float]) -> Column:
    """Number of edges (ascending) that are at most x."""
    return F.when(x.isNotNull(), sum(((x >= e).cast("int") for e in edges), F.lit(0)))


def linspace(start: Column, end: Column, num: int) -> Column:
    step = (end - start) / (num - 1) if num > 1 else F.lit(0.0)
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)), lambda i: start + i * step)


def rescale(x: Column, low: Column, high: Column, to: tuple[float, float]) -> Column:
    """x, which lies in [low, high], drawn to the range ``to``."""
    return F.lit(to[0]) + F.try_divide(x - low, high - low) * (to[1] - to[0])


def short_number(x: Column, digits: int = 3) -> Column:
    """A count with a unit: 1.5 K, 2.0 M, 3.0 G; below 1,000 as it is."""
    unit = F.when(F.abs(x) >= 1e9, "G").when(F.abs(x) >= 1e6, "M").when(F.abs(x) >= 1e3, "K")
    size = F.when(unit == "G", 1e9).when(unit == "M", 1e6).when(unit == "K", 1e3)
    return F.when(unit.isNull(), x.cast("string")).otherwise(F.concat(F.format_string(f"%.{digits}f", x / size), F.lit(" "), unit))


def minor_fractions(vafs: Column) -> Column:
    """All allele fractions but the largest, ascending (the fractions and 1 less it, if there is one only)."""
    s = F.array_sort(F.when(F.size(vafs) == 1, F.array(vafs[0], 1 - vafs[0])).otherwise(vafs))
    return F.when(F.size(s) > 1, F.slice(s, 1, F.size(s) - 1))


def folded(vaf: Column) -> Column:
    """A fraction folded at one half."""
    return F.when(vaf > 0.5, 1 - vaf).otherwise(vaf)


def sum_to_one(vafs: Column) -> Column:
    total = array_sum(vafs)
    return F.transform(vafs, lambda x: F.try_divide(x, total))


def over_reference(vafs: Column) -> Column:
    """Fractions of the other alleles divided by that of the reference, which is the first."""
    return F.transform(F.slice(vafs, 2, F.greatest(F.size(vafs) - 1, F.lit(0))), lambda x: F.try_divide(x, vafs[0]))
