"""Column functions on read support: counts, fractions and means per allele class (-1 other, 0 reference, 1.. alternatives).

Defined results: a null map or one without counts has total 0 and null fractions; null counts are no counts; a class that
is not in the map has a null fraction.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.numbers import array_sum


def total(counts: Column, exclude_other: bool = False) -> Column:
    kept = F.map_filter(counts, lambda k, v: k != -1) if exclude_other else counts
    return F.coalesce(F.aggregate(F.map_values(kept), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0).cast("long"))), F.lit(0).cast("long"))


def count(counts: Column, allele: int) -> Column:
    return F.try_element_at(counts, F.lit(allele))


def vaf(counts: Column, allele: int = 1, exclude_other: bool = False) -> Column:
    """Part of the reads that support an allele; null where there are none."""
    return F.try_divide(count(counts, allele), total(counts, exclude_other))


def vafs(counts: Column, n_allele: int, exclude_other: bool = False) -> Column:
    """Fractions of the alleles 0 .. n_allele - 1."""
    return F.array(*[vaf(counts, i, exclude_other) for i in range(n_allele)])


def sorted_vafs(counts: Column, exclude_other: bool = True, reverse: bool = True) -> Column:
    kept = F.map_filter(counts, lambda k, v: v.isNotNull() & ((k != -1) | F.lit(not exclude_other)))
    n = total(counts, exclude_other)
    return F.sort_array(F.transform(F.map_values(kept), lambda x: F.try_divide(x, n)), asc=not reverse)


def class_mean(stat: Column, counts: Column, alleles: list[int] | None = None) -> Column:
    """Mean of a statistic over allele classes (all of the map, if None) by their counts; null without counts."""
    keys = F.map_keys(stat) if alleles is None else F.array(*[F.lit(a) for a in alleles])
    pairs = F.filter(
        F.transform(keys, lambda k: F.struct(F.try_element_at(stat, k).alias("v"), F.try_element_at(counts, k).cast("double").alias("w"))),
        lambda p: p["v"].isNotNull() & ~F.isnan(p["v"]) & p["w"].isNotNull(),
    )
    return F.try_divide(array_sum(F.transform(pairs, lambda p: p["v"] * p["w"])), array_sum(F.transform(pairs, lambda p: p["w"])))


def top_alleles(counts: Column, n: int) -> Column:
    """The n allele classes (not -1) of most reads, of equal ones the lower, ascending."""
    kept = F.filter(F.map_entries(counts), lambda e: (e["key"] >= 0) & (F.coalesce(e["value"], F.lit(0).cast("long")) > 0))
    order = F.array_sort(F.transform(kept, lambda e: F.struct((-e["value"]).alias("c"), e["key"].alias("k"))))
    return F.array_sort(F.transform(F.slice(order, 1, n), lambda e: e["k"]))


def clonal_genotype(counts: Column, copies: Column, exclude_other: bool = False) -> Column:
    """Alleles with a fraction of at least 0.4 / copies, at most ``copies`` of them, those of most reads first; ascending."""
    n = total(counts, exclude_other)
    kept = F.filter(F.map_entries(counts), lambda e: (e["key"] >= 0) & (F.try_divide(e["value"], n) >= F.try_divide(F.lit(0.4), copies)))
    order = F.array_sort(F.transform(kept, lambda e: F.struct((-e["value"]).alias("c"), e["key"].alias("k"))))
    return F.array_sort(F.transform(F.slice(order, 1, copies.cast("int")), lambda e: e["k"]))


def match_allele(read: Column, targets: Column) -> Column:
    """Allele class of a read by identity of its sequence with one of the targets (map of class to sequence); null unless
    exactly one is equal."""
    hits = F.map_keys(F.map_filter(targets, lambda k, v: v == read))
    return F.when(F.size(hits) == 1, hits[0])
