"""Rules for variants by their read support, as Column predicates (True keeps), and comparison with a panel of normals.

A rule is a function from nothing but parameters to a Column over these columns of a row per variant and sample: ``counts``
(map of allele class to reads), ``mean_BQs`` and the like (maps of allele class to double), ``softclip_overlap``. Defined
results: a statistic that is null or NaN and a zero denominator keep the variant, unless stated.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions import numbers, readstats


def _known(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def _or_keep(x: Column) -> Column:
    return F.coalesce(x, F.lit(True))


def all_of(rules: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, rules, F.lit(True))


def any_of(rules: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, rules, F.lit(False))


def population_frequency(freqs: Column, cutoff: float = 0.01) -> Column:
    """No frequency of a population above the cutoff; unknown ones count as none."""
    return _or_keep(F.forall(F.map_values(freqs), lambda x: x.isNull() | F.isnan(x) | (x <= cutoff)))


def mean_difference(stat: Column, counts: Column, allele: int, n_allele: int, cutoff: float) -> Column:
    """Mean of the allele less that of the other alleles, by reads, at least the cutoff."""
    mine, others = F.try_element_at(stat, F.lit(allele)), readstats.class_mean(stat, counts, [a for a in range(n_allele) if a != allele])
    return F.when(_known(mine) & _known(others), mine - others >= cutoff).otherwise(True)


def at_least(value: Column, cutoff: float) -> Column:
    """Absolute base or mapping quality, place in reads, number of reads."""
    return F.when(_known(value), value >= cutoff).otherwise(True)


def below(value: Column, cutoff: float, null_keeps: bool = True) -> Column:
    return F.when(_known(value), value < cutoff).otherwise(null_keeps)


def clip_overlap(counts: Column, clipped: Column, allele: int = 1, cutoff: float = 1) -> Column:
    """More than ``cutoff`` reads of the allele per overlapping clipped one."""
    return _or_keep(F.when(clipped == 0, True).otherwise(readstats.count(counts, allele) / clipped > cutoff))


def other_ratio(counts: Column, allele: int = 1, cutoff: float = 1.5, ref: Column | None = None, ref_length: int | None = None) -> Column:
    """More than ``cutoff`` reads of the allele per read of another sequence; long references are not judged."""
    other = readstats.count(counts, -1)
    rule = _or_keep(F.when(other == 0, True).otherwise(readstats.count(counts, allele) / other > cutoff))
    return rule if ref_length is None else (F.length(ref) >= ref_length) | rule


def between(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Inclusive range (depth, fraction)."""
    rules = [value >= low] if low is not None else []
    return _or_keep(all_of([*rules, value <= high] if high is not None else rules))


def recurrent_mismatches(n: Column, cutoff: float = 10) -> Column:
    return _or_keep(n <= cutoff)


def passed(filters: Column) -> Column:
    """A FILTER field (array of names) that is empty, null or holds PASS."""
    return F.coalesce((F.size(filters) <= 0) | F.array_contains(filters, "PASS"), F.lit(True))


PRESETS = {
    # fixed values: cutoffs of the presets
    "germline": {"diff_bq": -5, "abs_bq": 20, "clip": 2, "count": 2, "other": 1.5, "total": 0},
    "somatic": {"diff_bq": -5, "abs_bq": 20, "clip": 2, "count": 2, "other": 1.5, "total": 10},
    "panelseq": {"diff_bq": -5, "abs_bq": 20, "clip": 1, "count": 2, "other": 1.5, "total": 30},
}


def preset(kind: str, counts: Column, mean_bq: Column, clipped: Column, allele: int = 1, n_allele: int = 2) -> Column:
    """The rules of a preset that need counts, base qualities and clipped reads, together."""
    c = PRESETS[kind]
    return all_of([
        mean_difference(mean_bq, counts, allele, n_allele, c["diff_bq"]), at_least(F.try_element_at(mean_bq, F.lit(allele)), c["abs_bq"]),
        clip_overlap(counts, clipped, allele, c["clip"]), at_least(readstats.count(counts, allele), c["count"]), other_ratio(counts, allele, c["other"]),
        between(readstats.total(counts), c["total"]),
    ])


# ---- panel of normals ----


@dataclass(frozen=True)
class PonParams:
    """The defaults of the comparison with a panel."""

    bisect: float = 0.15
    stdev_factor: float = 3
    ratio: float = 3
    sample_fraction: float = 0.2
    lower_cap: float = 0.4
    het: tuple[float, float] = (0.3, 0.7)
    hom: tuple[float, float] = (0.9, 1)
    het_mean: tuple[float, float] = (0.4, 0.6)
    germline_upper: float = 0.8
    germline_all: float = 0.1
    global_ratio: float = 0.9
    min_depth: int = 10
    germline_range: tuple[float, float] = (0.2, 1)


#: Defaults for panel sequencing of tumours.
PANELSEQ_SOMATIC = PonParams(bisect=0.2, stdev_factor=1.5, ratio=1.5, min_depth=50)


def panel(stats: DataFrame, key: str, sample: str, counts: str, allele: int = 1, params: PonParams = PonParams(), exclude_other: bool = False) -> DataFrame:
    """key, vafs: ascending (vaf, sample) of the panel samples of a variant with enough depth and a fraction. As many
    entries as the panel has samples, whatever the number of rows."""
    c = F.col(counts)
    v = readstats.vaf(c, allele, exclude_other)
    kept = stats.where((readstats.total(c, exclude_other) >= params.min_depth) & v.isNotNull()).groupBy(key, sample).agg(F.max(v).alias("vaf"))
    return kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("vaf"), F.col(sample).alias("sample")))).alias("vafs"))


def others_of_panel(vafs: Column, query: Column) -> Column:
    """Fractions of the panel without the query's own sample, ascending."""
    return F.transform(F.filter(F.coalesce(vafs, F.array().cast("array<struct<vaf:double,sample:string>>")), lambda x: ~F.coalesce(x["sample"] == query, F.lit(False))), lambda x: x["vaf"])


def lower_part(vafs: Column, p: PonParams = PonParams()) -> Column:
    return F.filter(vafs, lambda x: x <= p.bisect)


def upper_part(vafs: Column, p: PonParams = PonParams()) -> Column:
    return F.filter(vafs, lambda x: x > p.bisect)


def _cutoff(part: Column, p: PonParams) -> Column:
    mean = numbers.array_mean(part)
    return F.greatest(mean + p.stdev_factor * numbers.mean_mad(part), mean * p.ratio)


def greater_than_lower(query: Column, vafs: Column, p: PonParams = PonParams()) -> Column:
    """Whether the query's fraction stands out from those of the panel that are low (true where few are)."""
    part = lower_part(vafs, p)
    few = F.size(part) / F.size(vafs) <= p.sample_fraction
    return F.when(few, True).otherwise(query >= F.least(F.lit(p.lower_cap), _cutoff(part, p)))


def different_to_upper(query: Column, vafs: Column, p: PonParams = PonParams()) -> Column:
    part = upper_part(vafs, p)
    few = F.size(part) / F.size(vafs) <= p.sample_fraction
    return F.when(few, True).otherwise(query >= _cutoff(part, p))


def is_global(vafs: Column, p: PonParams = PonParams()) -> Column:
    """Whether nearly all of the panel has the allele."""
    return F.size(upper_part(vafs, p)) / F.size(vafs) > p.global_ratio


def is_germline(vafs: Column, p: PonParams = PonParams()) -> Column:
    """Whether the fractions that are not low are those of an inherited allele."""
    part = upper_part(vafs, p)
    het = F.filter(part, lambda x: x.between(*p.het))
    n = F.size(F.filter(part, lambda x: x.between(*p.het) | x.between(*p.hom)))
    mean = numbers.array_mean(het)
    good_mean = F.coalesce(mean.between(*p.het_mean), F.lit(True))
    return F.when(F.size(part) == 0, False).otherwise(good_mean & (n / F.size(part) >= p.germline_upper) & (n / F.size(vafs) >= p.germline_all))


def _judged(query: Column, vafs: Column, verdict: Column) -> Column:
    return F.when(~_known(query) | query.isNull() | (F.size(vafs) == 0), True).otherwise(verdict)


def pon_wgs(query: Column, vafs: Column, p: PonParams = PonParams()) -> Column:
    """Keeps what stands out from the low fractions and, unless inherited alleles explain the others, from those too."""
    upper = F.when(is_global(vafs, p), False).when(is_germline(vafs, p), True).otherwise(different_to_upper(query, vafs, p))
    return _judged(query, vafs, greater_than_lower(query, vafs, p) & upper)


def pon_panelseq_germline(query: Column, vafs: Column, p: PonParams = PonParams()) -> Column:
    return _judged(query, vafs, greater_than_lower(query, vafs, p) & ~is_global(vafs, p))


def pon_panelseq_somatic(query: Column, vafs: Column, p: PonParams = PANELSEQ_SOMATIC) -> Column:
    """Here an allele counts as inherited by the part of the panel whose fraction is not low."""
    inherited = (F.size(upper_part(vafs, p)) / F.size(vafs)).between(*p.germline_range)
    return _judged(query, vafs, greater_than_lower(query, vafs, p) & ~inherited & ~is_global(vafs, p))


def pon_filter(mode: str, query: Column, vafs: Column, p: PonParams | None = None) -> Column:
    """The comparison with a panel by mode: wgs, panelseq_germline or panelseq_somatic."""
    f = {"wgs": pon_wgs, "panelseq_germline": pon_panelseq_germline, "panelseq_somatic": pon_panelseq_somatic}[mode]
    return f(query, vafs) if p is None else f(query, vafs, p)


def pon_panelseq_legacy(
    query: Column, vafs: Column, germline_vaf: float = 0.2, germline_ratio: float = 0.1, lowest_fraction: float = 0.7, lowest_snr: float = 5, nearby_ratio: float = 1.3, nearby_least: int = 5, nearby_snr: float = 3
) -> Column:
    """The older comparison: few of the panel look inherited, and the query stands out from the lowest part of the panel and
    from the fractions near its own (where at least ``nearby_least`` are near)."""
    n = F.size(vafs)
    germline = F.size(F.filter(vafs, lambda x: x >= germline_vaf)) / n < germline_ratio
    k = F.floor(n * F.lit(lowest_fraction)).cast("int")
    low = numbers.array_mean(F.slice(vafs, 1, F.greatest(k, F.lit(0))))
    lowest = F.coalesce(F.when((k == 0) | (low == 0), True).otherwise(query / low >= lowest_snr), F.lit(True))
    near = F.filter(vafs, lambda x: (x <= query * nearby_ratio) & (x >= query / nearby_ratio))
    around = numbers.array_mean(near)
    nearby = F.coalesce(F.when((F.size(near) < nearby_least) | (around == 0), True).otherwise(query / around >= nearby_snr), F.lit(True))
    return _judged(query, vafs, germline & lowest & nearby)
