"""Column functions on annotations: attribute strings, feature strings, populations, distances and classes.

Defined results: null in, null out; items that cannot be read are left out of maps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes of consequences and of transcript types.
CONSEQUENCES = {
    "splice_region_involved": ("splice_acceptor_variant", "splice_donor_variant", "splice_donor_region_variant", "splice_region_variant", "splice_polypyrimidine_tract_variant", "splice_donor_5th_base_variant"),
    "splice_acceptor_involved": ("splice_acceptor_variant",),
    "splice_donor_involved": ("splice_donor_variant", "splice_donor_region_variant", "splice_donor_5th_base_variant"),
    "5pUTR_involved": ("5_prime_UTR_variant",),
    "3pUTR_involved": ("3_prime_UTR_variant",),
    "protein_altering": ("stop_gained", "frameshift_variant", "stop_lost", "start_lost", "inframe_insertion", "inframe_deletion", "missense_variant", "protein_altering_variant"),
}
BIOTYPES = {
    "coding": ("IG_C_gene", "IG_D_gene", "IG_J_gene", "IG_V_gene", "ccds_gene", "mRNA", "protein_coding"),
    "IG": ("IG_C_gene", "IG_D_gene", "IG_J_gene", "IG_V_gene"),
    "TR": ("TR_C_gene", "TR_D_gene", "TR_J_gene", "TR_V_gene"),
}


def attributes(text: Column, item: str = ";", pair: str = "=") -> Column:
    """``k=v;k=v`` as a map; of a repeated key the last value, items without a key are left out."""
    items = F.filter(F.split(text, item), lambda x: F.instr(x, pair) > 1)
    each = F.transform(items, lambda x: F.struct(F.trim(F.substring_index(x, pair, 1)).alias("k"), F.substr(x, F.instr(x, pair) + 1).alias("v")))
    return F.when(text.isNotNull(), F.aggregate(each, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["k"]), F.create_map(e["k"], e["v"]))))


def features(text: Column, names: Sequence[str]) -> Column:
    """A feature string (records by ``,``, fields by ``|``) as an array of structs; empty fields are null."""
    return F.transform(F.split(text, ","), lambda r: F.transform(F.array(F.split(r, r"\|")), lambda f: F.struct(*[F.nullif(F.get(f, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)]))[0])


def population_map(text: Column) -> Column:
    """``POP:f,f|POP:f`` as a map of arrays; ``.`` is 0."""
    items = F.filter(F.split(text, r"\|"), lambda x: F.instr(x, ":") > 1)
    entry = lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.transform(F.split(F.substring_index(x, ":", -1), ","), lambda v: F.when(v == ".", 0.0).otherwise(v.try_cast("double"))).alias("v"))
    return F.when(text.isNotNull(), F.map_from_entries(F.array_distinct(F.transform(items, entry))))


def distance(pos0: Column, start: Column, end: Column) -> Column:
    """Signed distance of a place to a feature [start, end), null where it lies inside."""
    return F.when(pos0 < start, start - pos0).when(pos0 >= end, end - 1 - pos0)


def interval_distance(s: Column, e: Column, start: Column, end: Column) -> Column:
    """Signed distance of an interval to a feature, null where they overlap."""
    return F.when(e <= start, start - e + 1).when(s >= end, end - 1 - s)


def consequence_flags(terms: Column) -> dict[str, Column]:
    """Whether an array of consequences has one of each class."""
    return {k: F.arrays_overlap(terms, F.array(*[F.lit(x) for x in v])) for k, v in CONSEQUENCES.items()}


def biotype_flags(biotype: Column) -> dict[str, Column]:
    return {k: biotype.isin(*v) for k, v in BIOTYPES.items()}


def introns(exons: Column, forward: Column) -> Column:
    """Introns between consecutive exons (array of struct start, end, in order of transcription); null for one exon."""
    pairs = F.transform(F.slice(exons, 2, F.greatest(F.size(exons) - 1, F.lit(0))), lambda x, i: F.struct(F.get(exons, i).alias("a"), x.alias("b")))
    gap = lambda p: F.when(forward, F.struct(p["a"]["end"].alias("start"), p["b"]["start"].alias("end"))).otherwise(F.struct(p["b"]["end"].alias("start"), p["a"]["start"].alias("end")))
    return F.when(F.size(exons) > 1, F.transform(pairs, gap))


def merge_maps(mine: Column, other: Column, overwrite: bool = True, create: bool = True) -> Column:
    """Map with the values of another: its values win over those that are there (only over nulls, without ``overwrite``);
    new keys come in with ``create``."""
    both = F.map_zip_with(mine, other, lambda k, a, b: F.coalesce(b, a) if overwrite else F.coalesce(a, b))
    return both if create else F.map_filter(both, lambda k, v: F.map_contains_key(mine, k))


def site_portions(counts: Column, samples: Column) -> Column:
    """Occurrences by site over the samples of the site."""
    return F.transform_values(counts, lambda k, v: F.try_divide(v, F.try_element_at(samples, k)))


def is_meaningful(levels: Sequence[Column], oncogenic: Column) -> Column:
    """Whether a variant has a level of implication or is (likely) oncogenic."""
    known = F.coalesce(*[c.cast("string") for c in levels]).isNotNull()
    return known | F.coalesce(oncogenic.isin("Oncogenic", "Likely Oncogenic"), F.lit(False))


def codon_frame(before: Column, after: Column) -> Column:
    """Place (from 0) of the changed base in a codon whose changed bases are in upper case; null for other changes."""
    place = F.regexp_instr(before, F.lit("[A-Z]")) - 1
    return F.when((F.length(before) == 3) & (F.length(after) == 3) & (place >= 0), place)
