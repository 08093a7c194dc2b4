
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.functions import alleles, numbers, readstats
from spanforge.operators import filters, variant_sets
from spanforge.plans.book import Book
from spanforge.runtime import table

BOOK = Book()
add = BOOK.add
col = F.col

# ---- SQL of the functions ----

BASES = "'^[ACGTNacgtn]+$'"
SV = r"'^<(DEL|INS|DUP|INV|CNV|BND|TRA)(:.+)?>$'"
BND = r"""(regexp_matches({0}, '^[^\[\]]+[\[\]][^:]+:[0-9]+[\[\]]$') OR regexp_matches({0}, '^[\[\]][^:]+:[0-9]+[\[\]][^\[\]]+$'))"""


def type_sql(r: str, a: str) -> str:
    return f"""CASE WHEN {r} IS NULL OR {a} IS NULL THEN NULL
  WHEN regexp_matches({a}, {BASES}) THEN CASE WHEN length({r}) = length({a}) THEN CASE WHEN length({r}) = 1 THEN 'snv' ELSE 'mnv' END
    WHEN length({r}) = 1 AND {r}[1] = {a}[1] THEN 'ins' WHEN length({r}) > 1 AND length({a}) = 1 AND {r}[1] = {a}[1] THEN 'del' ELSE 'delins' END
  WHEN regexp_matches({a}, {SV}) OR {BND.format(a)} THEN 'sv' WHEN {a} = '<CPGMET>' THEN 'cpgmet' WHEN {a} = '*' THEN 'overlap_del' ELSE 'unknown' END"""


TYPED = f"typed AS (SELECT *, {type_sql('REF', 'ALT1')} AS t FROM variants)"
TOTAL = "coalesce(list_sum([coalesce(x, 0) for x in map_values(rppcounts)]), 0)"
NO_OTHER = "coalesce(list_sum([coalesce(e.value, 0) for e in map_entries(rppcounts) if e.key <> -1]), 0)"
VAF1 = f"CASE WHEN {TOTAL} = 0 THEN NULL ELSE rppcounts[1] / {TOTAL} END"
#: Read-support rows: one per variant and sample, as the copies of a row are equal but for the load time.
RS = """rs AS (SELECT variant_id, "sample", rppcounts, softclip_overlap, mean_BQs, is_pon FROM (SELECT *, row_number() OVER (PARTITION BY variant_id, "sample" ORDER BY loaded_at DESC) AS i FROM readstats) WHERE i = 1)"""


def rs(spark: SparkSession, sf: str) -> DataFrame:
    """Read support, the last loaded row of each variant and sample."""
    w = F.max_by(F.struct("rppcounts", "softclip_overlap", "mean_BQs", "is_pon"), F.coalesce("loaded_at", F.lit("1900-01-01").cast("timestamp")))
    return table(spark, sf, "readstats").groupBy("variant_id", "sample").agg(w.alias("x")).select("variant_id", "sample", "x.*")


def variants(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "variants")


def _text(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


# ---- 2.10: alleles ----


@add("SELECT variant_id, concat_ws('_', Chromosome, CAST(POS AS VARCHAR), REF, array_to_string(list_filter([ALT1, ALT2], lambda x: x IS NOT NULL), '|')) AS uid FROM variants")
def r220_variant_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 65 and 220."""
    return variants(spark, sf).select("variant_id", alleles.variant_id(col("Chromosome"), col("POS"), col("REF"), F.array("ALT1", "ALT2")).alias("uid"))


@add(f"WITH {TYPED} SELECT variant_id, t AS kind, {BND.format('ALT1')} OR regexp_matches(ALT1, {SV}) AS is_sv FROM typed")
def r221_mutation_types(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 221 and 222."""
    return variants(spark, sf).select("variant_id", alleles.mutation_type(col("REF"), col("ALT1")).alias("kind"), alleles.is_sv_alt(col("ALT1")).alias("is_sv"))


@add(f"WITH {TYPED} SELECT t AS kind, count(*) AS n FROM typed WHERE t IN ('ins', 'del', 'delins') GROUP BY t")
def r083_select_by_type(spark: SparkSession, sf: str) -> DataFrame:
    t = variants(spark, sf).withColumn("kind", alleles.mutation_type(col("REF"), col("ALT1")))
    return t.where(col("kind").isin("ins", "del", "delins")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@add(r"""SELECT variant_id, regexp_replace(ALT1, '[\[\]][^\[\]]+[\[\]]', '') AS t, regexp_extract(ALT1, '[\[\]]([^:]+):', 1) AS mate_chrom, CAST(regexp_extract(ALT1, ':([0-9]+)', 1) AS BIGINT) AS mate_pos,
  ALT1[1] IN ('[', ']') AS is5, contains(ALT1, '[') AS mate_is5 FROM variants WHERE """ + BND.format("ALT1"))
def r223_breakends(spark: SparkSession, sf: str) -> DataFrame:
    t = variants(spark, sf).where(alleles.is_breakend(col("ALT1")))
    return t.select("variant_id", alleles.parse_breakend(col("ALT1")).alias("b")).select("variant_id", "b.*")


@add("WITH c AS (SELECT chrom, chr_name, idx FROM chromdict), m AS (SELECT variant_id, POS, Chromosome, regexp_extract(ALT1, '[\\[\\]]([^:]+):', 1) AS mc, CAST(regexp_extract(ALT1, ':([0-9]+)', 1) AS BIGINT) AS mp FROM variants WHERE " + BND.format("ALT1") + """)
SELECT variant_id, a.idx < b.idx OR (a.idx = b.idx AND POS <= mp) AS first FROM m LEFT JOIN c AS a ON Chromosome IN (a.chrom, a.chr_name) LEFT JOIN c AS b ON mc IN (b.chrom, b.chr_name)""")
def r224_first_breakends(spark: SparkSession, sf: str) -> DataFrame:
    """Which of two mates stands first in contig order (rows 224 and 269)."""
    names = table(spark, sf, "chromdict").select(F.explode(F.array_distinct(F.array("chrom", "chr_name"))).alias("name"), "idx")
    t = variants(spark, sf).where(alleles.is_breakend(col("ALT1"))).select("variant_id", "POS", "Chromosome", alleles.parse_breakend(col("ALT1")).alias("b"))
    t = t.join(names.select(col("name").alias("Chromosome"), col("idx").alias("i")), "Chromosome", "left").withColumn("mc", col("b.mate_chrom"))
    t = t.join(names.select(col("name").alias("mc"), col("idx").alias("j")), "mc", "left")
    return t.select("variant_id", alleles.is_first_breakend(col("i"), col("POS"), col("j"), col("b.mate_pos")).alias("first"))


def _prefix_sql(a: str, b: str) -> str:
    return f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: {a}[1:i] = {b}[1:i]))"


@add(f"""WITH v AS (SELECT variant_id, POS AS pos, repeat(REF, 2) || 'GA' AS r, ALT1 || REF || 'GA' AS a FROM variants WHERE regexp_matches(ALT1, {BASES})),
p AS (SELECT *, {_prefix_sql('r', 'a')} AS p FROM v), q AS (SELECT *, {_prefix_sql('rr', 'ra')} AS q FROM (SELECT *, reverse(r[p + 1:]) AS rr, reverse(a[p + 1:]) AS ra, least(length(r), length(a)) AS short FROM p)),
o AS (SELECT *, CASE WHEN p = short AND length(r) = length(a) THEN 1 WHEN p = short THEN p WHEN q = short - p AND p > 0 THEN p WHEN q = short - p THEN 0 ELSE p + 1 END AS c FROM q)
SELECT variant_id, CAST(pos + c - 1 AS BIGINT) AS pos,
  CASE WHEN p = short AND length(r) = length(a) THEN r[1:1] WHEN p = short THEN r[p:] WHEN c = 0 THEN 'N' || r[1:length(r) - q] ELSE r[c:length(r) - q] END AS ref,
  CASE WHEN p = short AND length(r) = length(a) THEN a[1:1] WHEN p = short THEN a[p:] WHEN c = 0 THEN 'N' || a[1:length(a) - q] ELSE a[c:length(a) - q] END AS alt FROM o""")
def r225_parsimonious(spark: SparkSession, sf: str) -> DataFrame:
    """Alleles with bases added in front and behind, cut back."""
    t = variants(spark, sf).where(col("ALT1").rlike(alleles.BASES))
    ref, alt = F.concat(F.repeat("REF", F.lit(2)), F.lit("GA")), F.concat("ALT1", "REF", F.lit("GA"))
    return t.select("variant_id", alleles.parsimonious(col("POS"), ref, alt).alias("x")).select("variant_id", "x.*")


@add(f"WITH {TYPED} SELECT variant_id, CASE t WHEN 'ins' THEN ALT1[2:] WHEN 'del' THEN REF[2:] END AS diff FROM typed")
def r233_diff_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return variants(spark, sf).select("variant_id", alleles.diff_seq(col("REF"), col("ALT1")).alias("diff"))


HGVS = """CASE t WHEN 'snv' THEN Chromosome || ':g.' || POS || REF || '>' || ALT1 WHEN 'mnv' THEN Chromosome || ':g.' || POS || '_' || (POS + length(REF) - 1) || 'delins' || ALT1
  WHEN 'ins' THEN Chromosome || ':g.' || POS || '_' || (POS + 1) || 'ins' || ALT1[2:]
  WHEN 'del' THEN Chromosome || ':g.' || CASE WHEN length(REF) = 2 THEN CAST(POS + 1 AS VARCHAR) ELSE (POS + 1) || '_' || (POS + length(REF) - 1) END || 'del'
  WHEN 'delins' THEN Chromosome || ':g.' || CASE WHEN length(REF) = 1 THEN CAST(POS AS VARCHAR) ELSE POS || '_' || (POS + length(REF) - 1) END || 'delins' || ALT1 END"""


@add(f"WITH {TYPED} SELECT variant_id, {HGVS} AS name FROM typed")
def r234_hgvsg(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 234 and 241."""
    return variants(spark, sf).select("variant_id", alleles.hgvsg(*[col(c) for c in ("Chromosome", "POS", "REF", "ALT1")]).alias("name"))


@add(f"""WITH {TYPED} SELECT variant_id, Chromosome AS chrom, CASE WHEN t = 'del' THEN POS + 1 ELSE POS END AS start, CASE WHEN t = 'ins' THEN POS + 1 ELSE POS + length(REF) - 1 END AS stop,
  CASE WHEN t = 'mnv' THEN 'delins' ELSE t END AS kind, CASE WHEN t = 'snv' THEN REF END AS ref, CASE WHEN t = 'ins' THEN ALT1[2:] WHEN t <> 'del' THEN ALT1 END AS alt
  FROM typed WHERE t IN ('snv', 'mnv', 'ins', 'del', 'delins') AND Chromosome IS NOT NULL AND POS IS NOT NULL""")
def r242_parse_hgvsg(spark: SparkSession, sf: str) -> DataFrame:
    """Genomic names, written and read again."""
    name = alleles.hgvsg(*[col(c) for c in ("Chromosome", "POS", "REF", "ALT1")])
    t = variants(spark, sf).select("variant_id", alleles.parse_hgvsg(name).alias("x")).where(col("x").isNotNull())
    return t.select("variant_id", "x.chrom", "x.start", col("x.end").alias("stop"), "x.kind", "x.ref", "x.alt")


@add(f"""WITH {TYPED} SELECT variant_id, s - 3 AS before_start, s AS before_end, POS - 1 + length(REF) AS after_start, POS + 2 + length(REF) AS after_end FROM (SELECT *, POS - 1 + CASE WHEN t IN ('ins', 'del') THEN 1 ELSE 0 END AS s FROM typed)""")
def r235_flanks(spark: SparkSession, sf: str) -> DataFrame:
    return variants(spark, sf).select("variant_id", alleles.flanks(col("POS"), col("REF"), col("ALT1"), 3).alias("x")).select("variant_id", "x.*")


@add("SELECT variant_id, ALT1 AS alt, CAST(1 AS INTEGER) AS allele_index FROM variants WHERE ALT1 IS NOT NULL UNION ALL SELECT variant_id, ALT2, CASE WHEN ALT1 IS NULL THEN 1 ELSE 2 END FROM variants WHERE ALT2 IS NOT NULL")
def r236_single_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    return alleles.mono_alternatives(variants(spark, sf).select("variant_id", "ALT1", "ALT2"), ["ALT1", "ALT2"])


@add(f"""SELECT variant_id, array_to_string([REF[1:k] || ':' || (length(REF) // k) for k in range(1, length(REF) + 1) if length(REF) % k = 0 AND repeat(REF[1:k], length(REF) // k) = REF], ',') AS units FROM variants WHERE regexp_matches(REF, {BASES})""")
def r239_repeat_units(spark: SparkSession, sf: str) -> DataFrame:
    units = F.transform(alleles.repeat_units(col("REF")), lambda u: F.concat(u["unit"], F.lit(":"), u["count"].cast("string")))
    return variants(spark, sf).where(col("REF").rlike(alleles.BASES)).select("variant_id", F.array_join(units, ",").alias("units"))


@add("SELECT variant_id, reverse(translate(REF, 'ACGTacgt', 'TGCAtgca')) AS rc, CASE WHEN REF[1] IN ('A', 'G') THEN translate(REF[1], 'AG', 'TC') ELSE REF[1] END AS pyrimidine FROM variants")
def r244_pyrimidines(spark: SparkSession, sf: str) -> DataFrame:
    return variants(spark, sf).select("variant_id", alleles.reverse_complement(col("REF")).alias("rc"), alleles.to_pyrimidine(F.substring("REF", 1, 1)).alias("pyrimidine"))


@add("""SELECT name, CASE WHEN regexp_matches(name, '(?i)^(chr)?(0*[1-9][0-9]*|[XY])$') THEN 'chr' || regexp_replace(name, '(?i)^(chr)?0*', '') WHEN name IN ('MT', 'chrM') THEN 'chrM' ELSE name END AS long,
  CASE WHEN regexp_matches(name, '(?i)^(chr)?(0*[1-9][0-9]*|[XY])$') THEN regexp_replace(name, '(?i)^(chr)?0*', '') WHEN name IN ('MT', 'chrM') THEN 'MT' ELSE name END AS short
  FROM (SELECT chrom AS name FROM chromdict UNION SELECT chr_name FROM chromdict UNION SELECT 'chr00' || chrom FROM chromdict)""")
def r246_contig_names(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 246 and 247."""
    t = table(spark, sf, "chromdict").select(F.explode(F.array("chrom", "chr_name", F.concat(F.lit("chr00"), "chrom"))).alias("name")).distinct()
    return t.select("name", alleles.normalize_chrom(col("name")).alias("long"), alleles.normalize_chrom(col("name"), True).alias("short"))


@add("SELECT variant_id, CASE WHEN ID NOT IN ('', '.') THEN ID END AS id, CAST((CASE WHEN ALT2 IS NULL THEN 1 ELSE 2 END + 1) * (CASE WHEN ALT2 IS NULL THEN 1 ELSE 2 END + 2) / 2 AS BIGINT) AS genotypes FROM variants")
def r248_field_values(spark: SparkSession, sf: str) -> DataFrame:
    """Missing marks and numbers of values (rows 248 to 250)."""
    n = F.when(col("ALT2").isNull(), 1).otherwise(2)
    return variants(spark, sf).select("variant_id", alleles.missing_to_null(col("ID")).alias("id"), alleles.number_of_values(F.lit("G"), n).cast("long").alias("genotypes"))


@add("""SELECT event_id, replace(replace(replace(replace(replace('{"p":' || to_json(props) || ',"v":"' || event_type || '"}', '%', '%25'), ':', '%3A'), ';', '%3B'), '=', '%3D'), ',', '%2C') AS code, props AS back FROM events""")
def r251_item_codec(spark: SparkSession, sf: str) -> DataFrame:
    """Items written with percent escapes and read again (rows 251 and 252)."""
    t = table(spark, sf, "events").select("event_id", alleles.encode_item(F.struct(col("props").alias("p"), col("event_type").alias("v"))).alias("code"))
    return t.select("event_id", "code", alleles.decode_item(col("code"), "struct<p:string,v:string>")["p"].alias("back"))


@add(r"""SELECT txt, CASE WHEN txt = 'None' THEN 'none' WHEN txt IN ('True', 'False') THEN 'bool' WHEN regexp_matches(txt, '^[+-]?[0-9]+$') THEN 'int' WHEN regexp_matches(txt, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN 'float' ELSE 'str' END AS kind,
  CASE WHEN regexp_matches(txt, '^[+-]?[0-9]+$') THEN CAST(txt AS BIGINT) END AS integer
  FROM (SELECT CAST(o_orderkey AS VARCHAR) AS txt FROM orders UNION ALL SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'None' END FROM orders UNION ALL SELECT o_orderpriority FROM orders UNION ALL SELECT o_orderkey || '.5' FROM orders)""")
def r253_typed_texts(spark: SparkSession, sf: str) -> DataFrame:
    k = col("o_orderkey")
    texts = F.array(k.cast("string"), F.when(k % 2 == 0, "True").otherwise("None"), "o_orderpriority", F.concat(k.cast("string"), F.lit(".5")))
    return table(spark, sf, "orders").select(F.explode(texts).alias("txt")).select("txt", alleles.typed_text(col("txt")).alias("x")).select("txt", "x.kind", "x.integer")


# ---- 2.5, 2.9: variant sets ----

_HALF = """x AS (SELECT DISTINCT Chromosome, "Start", REF, ALT1, ALT2, POS FROM variants WHERE variant_id % 3 <> 0), y AS (SELECT DISTINCT Chromosome, "Start", REF, ALT1, ALT2, POS FROM variants WHERE variant_id % 3 <> 1)"""
_SAME = 'x.Chromosome IS NOT DISTINCT FROM y.Chromosome AND x."Start" IS NOT DISTINCT FROM y."Start" AND x.REF IS NOT DISTINCT FROM y.REF AND x.ALT1 IS NOT DISTINCT FROM y.ALT1 AND x.ALT2 IS NOT DISTINCT FROM y.ALT2'


def _two_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping sets of variants, as two callers would give them."""
    t = variants(spark, sf)
    cols = ["Chromosome", "Start", "REF", "ALT1", "ALT2", "POS"]
    return t.where(col("variant_id") % 3 != 0).select(cols).distinct(), t.where(col("variant_id") % 3 != 1).select(cols).distinct()


@add(f"""WITH {_HALF} SELECT x.Chromosome, x."Start", x.REF, x.ALT1, x.ALT2, x.POS AS pos_x, y.POS AS pos_y FROM x LEFT JOIN y ON {_SAME}""")
def r105_variant_join(spark: SparkSession, sf: str) -> DataFrame:
    x, y = _two_sets(spark, sf)
    return variant_sets.join([x.withColumnRenamed("POS", "pos_x"), y.withColumnRenamed("POS", "pos_y")], ["Chromosome", "Start", "REF", "ALT1", "ALT2"], "left")


@add(f"""WITH {_HALF} SELECT coalesce(x.Chromosome, y.Chromosome) AS Chromosome, coalesce(x."Start", y."Start") AS "Start", coalesce(x.REF, y.REF) AS REF, coalesce(x.ALT1, y.ALT1) AS ALT1, coalesce(x.ALT2, y.ALT2) AS ALT2, x.POS AS pos_x, y.POS AS pos_y FROM x FULL JOIN y ON {_SAME}""")
def r106_variant_union(spark: SparkSession, sf: str) -> DataFrame:
    x, y = _two_sets(spark, sf)
    return variant_sets.join([x.withColumnRenamed("POS", "pos_x"), y.withColumnRenamed("POS", "pos_y")], ["Chromosome", "Start", "REF", "ALT1", "ALT2"], "full")


@add(f"""WITH {_HALF} SELECT 'both' AS part, x.* FROM x WHERE EXISTS (SELECT 1 FROM y WHERE {_SAME}) UNION ALL SELECT 'only', x.* FROM x WHERE NOT EXISTS (SELECT 1 FROM y WHERE {_SAME})""")
def r108_intersection_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 107 to 110, 176."""
    x, y = _two_sets(spark, sf)
    keys = ["Chromosome", "Start", "REF", "ALT1", "ALT2"]
    both, only = variant_sets.intersection(x, y, keys), variant_sets.difference(x, y, keys)
    return both.select(F.lit("both").alias("part"), "*").unionByName(only.select(F.lit("only").alias("part"), "*"))


@add("""SELECT Chromosome, POS, REF, ALT1, bool_or(a) AND NOT bool_or(c) AND bool_or(b) AS isec, list_sort(list(DISTINCT src)) AS sources FROM (
  SELECT *, src = 'a' AS a, src = 'b' AS b, src = 'c' AS c FROM (SELECT Chromosome, POS, REF, ALT1, unnest(list_filter([CASE WHEN variant_id % 2 = 0 THEN 'a' END, CASE WHEN variant_id % 3 <> 0 THEN 'b' END, CASE WHEN variant_id % 5 = 0 THEN 'c' END], lambda x: x IS NOT NULL)) AS src FROM variants)) GROUP BY ALL""".replace("list_sort(list(DISTINCT src)) AS sources", "array_to_string(list_sort(list(DISTINCT src)), ',') AS sources"))
def r214_set_of_files(spark: SparkSession, sf: str) -> DataFrame:
    """Union of three sets and the part that lies in the first two but not in the third (rows 213 to 216)."""
    t, v = variants(spark, sf), col("variant_id")
    keys = ["Chromosome", "POS", "REF", "ALT1"]
    files = {"a": t.where(v % 2 == 0), "b": t.where(v % 3 != 0), "c": t.where(v % 5 == 0)}
    return variant_sets.combine({k: f.select(keys) for k, f in files.items()}, keys, {"a": True, "b": True, "c": False}).select(*keys, "isec", F.array_join("sources", ",").alias("sources"))


@add("""SELECT variant_id, count(*) OVER (PARTITION BY Chromosome, POS, REF, ALT1) > 1 AS repeated, CASE WHEN ALT1 = '*' THEN '' ELSE ALT1 END AS alt FROM variants""")
def r177_repeated_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records that come twice, and the alternative that stands for a deletion around (rows 177 and 232)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("Chromosome", "POS", "REF", "ALT1"))
    return variants(spark, sf).select("variant_id", (n > 1).alias("repeated"), F.when(col("ALT1") == "*", "").otherwise(col("ALT1")).alias("alt"))


# ---- read support ----


@add(f"""WITH {RS} SELECT variant_id, "sample", CAST({TOTAL} AS BIGINT) AS total, CAST({NO_OTHER} AS BIGINT) AS without_other, round({VAF1}, 6) AS vaf, round(CASE WHEN {NO_OTHER} = 0 THEN NULL ELSE rppcounts[1] / {NO_OTHER} END, 6) AS vaf_without_other, round(CASE WHEN {TOTAL} = 0 THEN NULL ELSE rppcounts[0] / {TOTAL} END, 6) AS ref FROM rs""")
def r284_allele_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 158, 284 and 285."""
    c = col("rppcounts")
    v = readstats.vafs(c, 2)
    return rs(spark, sf).select("variant_id", "sample", readstats.total(c).alias("total"), readstats.total(c, True).alias("without_other"), F.round(v[1], 6).alias("vaf"), F.round(readstats.vaf(c, 1, True), 6).alias("vaf_without_other"), F.round(v[0], 6).alias("ref"))


@add(f"""WITH {RS} SELECT variant_id, "sample", array_to_string([CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR) for x in list_reverse_sort([e.value / {NO_OTHER} for e in map_entries(rppcounts) if e.value IS NOT NULL AND e.key <> -1])], ',') AS vafs FROM rs WHERE {NO_OTHER} > 0""")
def r187_sorted_fractions(spark: SparkSession, sf: str) -> DataFrame:
    c = col("rppcounts")
    return rs(spark, sf).where(readstats.total(c, True) > 0).select("variant_id", "sample", _text(F.transform(readstats.sorted_vafs(c), lambda x: F.round(x * 1000).cast("long"))).alias("vafs"))


_W = "list_sum([e.value * rppcounts[e.key] for e in map_entries(mean_BQs) if e.value IS NOT NULL AND rppcounts[e.key] IS NOT NULL{0}])"
_N = "list_sum([rppcounts[e.key] for e in map_entries(mean_BQs) if e.value IS NOT NULL AND rppcounts[e.key] IS NOT NULL{0}])"
_MEAN = f"CASE WHEN coalesce({_N}, 0) = 0 THEN NULL ELSE {_W} / {_N} END"


@add(f"""WITH {RS} SELECT variant_id, "sample", round({_MEAN.format('')}, 6) AS mean_bq FROM rs""")
def r157_class_means(spark: SparkSession, sf: str) -> DataFrame:
    return rs(spark, sf).select("variant_id", "sample", F.round(readstats.class_mean(col("mean_BQs"), col("rppcounts")), 6).alias("mean_bq"))


@add(f"""WITH {RS} SELECT variant_id, "sample", array_to_string(list_sort([x.k for x in list_sort([{{'c': -e.value, 'k': e.key}} for e in map_entries(rppcounts) if e.key >= 0 AND e.value / {TOTAL} >= 0.4 / 2])[1:2]]), ',') AS genotype,
  array_to_string(list_sort([x.k for x in list_sort([{{'c': -e.value, 'k': e.key}} for e in map_entries(rppcounts) if e.key >= 0 AND coalesce(e.value, 0) > 0])[1:1]]), ',') AS top FROM rs WHERE {TOTAL} > 0""")
def r189_genotypes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 188 and 189."""
    c = col("rppcounts")
    return rs(spark, sf).where(readstats.total(c) > 0).select("variant_id", "sample", _text(readstats.clonal_genotype(c, F.lit(2))).alias("genotype"), _text(readstats.top_alleles(c, 1)).alias("top"))


# ---- 2.12: filters ----

_OTHERS = " AND e.key = 0"
_RULES = {
    "diff_bq": f"coalesce(mean_BQs[1] - ({_MEAN.format(_OTHERS)}) >= -5, true)",
    "abs_bq": "coalesce(mean_BQs[1] >= 20, true)",
    "clip": "coalesce(CASE WHEN softclip_overlap = 0 THEN true ELSE rppcounts[1] / softclip_overlap > 1 END, true)",
    "count": "coalesce(rppcounts[1] >= 2, true)",
    "other": "coalesce(CASE WHEN rppcounts[-1] = 0 THEN true ELSE rppcounts[1] / rppcounts[-1] > 1.5 END, true)",
    "depth_gt": f"{TOTAL} >= 20", "depth_lt": f"{TOTAL} <= 200", "depth": f"{TOTAL} BETWEEN 20 AND 200", "vaf": f"coalesce({VAF1} BETWEEN 0.1 AND 0.9, true)",
}


def _rules() -> dict[str, Column]:
    c, q, clip = col("rppcounts"), col("mean_BQs"), col("softclip_overlap")
    n = readstats.total(c)
    return {
        "diff_bq": filters.mean_difference(q, c, 1, 2, -5), "abs_bq": filters.at_least(F.try_element_at(q, F.lit(1)), 20), "clip": filters.clip_overlap(c, clip),
        "count": filters.at_least(readstats.count(c, 1), 2), "other": filters.other_ratio(c), "depth_gt": filters.between(n, 20), "depth_lt": filters.between(n, None, 200),
        "depth": filters.between(n, 20, 200), "vaf": filters.between(readstats.vaf(c), 0.1, 0.9),
    }


@add(f"""WITH {RS} SELECT variant_id, "sample", {', '.join(f'{v} AS {k}' for k, v in _RULES.items())} FROM rs""")
def r288_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 288 to 292, 297 to 301 and 303; the other rules take the same predicates over other statistics."""
    return rs(spark, sf).select("variant_id", "sample", *[v.alias(k) for k, v in _rules().items()])


@add(f"""WITH {RS} SELECT variant_id, "sample", {' AND '.join(_RULES.values())} AS every, {' OR '.join(_RULES.values())} AS some FROM rs""")
def r286_filter_list(spark: SparkSession, sf: str) -> DataFrame:
    rules = list(_rules().values())
    return rs(spark, sf).select("variant_id", "sample", filters.all_of(rules).alias("every"), filters.any_of(rules).alias("some"))


def _preset_sql(clip: float, total: int) -> str:
    r = _RULES | {"clip": _RULES["clip"].replace("> 1 END", f"> {clip} END")}
    return " AND ".join(r[k] for k in ("diff_bq", "abs_bq", "clip", "count", "other")) + f" AND {TOTAL} >= {total}"


@add(f"""WITH {RS} SELECT variant_id, "sample", {_preset_sql(2, 0)} AS germline, {_preset_sql(2, 10)} AS somatic, {_preset_sql(1, 30)} AS panelseq FROM rs""")
def r314_presets(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 314 to 316, with the rules for which the table has statistics."""
    return rs(spark, sf).select("variant_id", "sample", *[filters.preset(k, col("rppcounts"), col("mean_BQs"), col("softclip_overlap")).alias(k) for k in filters.PRESETS])


_FREQS = "[s_acctbal / 1000000, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_suppkey / 10000 END]"


@add(f"SELECT s_suppkey, len([x for x in {_FREQS} if x > 0.01]) = 0 AS rare FROM supplier")
def r287_population_frequency(spark: SparkSession, sf: str) -> DataFrame:
    k = col("s_suppkey")
    freqs = F.create_map(F.lit("a"), col("s_acctbal") / 1_000_000, F.lit("b"), F.when(k % 3 != 0, k / 10_000))
    return table(spark, sf, "supplier").select("s_suppkey", filters.population_frequency(freqs).alias("rare"))


_PANEL = f"""pon AS (SELECT variant_id, list(v ORDER BY v, "sample") AS vs, list("sample" ORDER BY v, "sample") AS ss FROM (SELECT variant_id, "sample", {VAF1} AS v FROM rs WHERE is_pon AND {TOTAL} >= 10) WHERE v IS NOT NULL GROUP BY variant_id),
query AS (SELECT variant_id, "sample", {VAF1} AS q, [z.v for z in list_transform(list_zip(coalesce(vs, []), coalesce(ss, [])), lambda z: {{'v': z[1], 's': z[2]}}) if z.s IS DISTINCT FROM "sample"] AS vs FROM rs LEFT JOIN pon USING (variant_id)),
part AS (SELECT *, [x for x in vs if x <= 0.15] AS lo, [x for x in vs if x > 0.15] AS up FROM query),
mean AS (SELECT *, list_avg(lo) AS ml, list_avg(up) AS mu, [x for x in up if x BETWEEN 0.3 AND 0.7] AS het FROM part),
verdict AS (SELECT *, CASE WHEN len(lo) / len(vs) <= 0.2 THEN true ELSE q >= least(0.4, greatest(ml + 3 * list_avg([abs(x - ml) for x in lo]), ml * 3)) END AS above_lower,
  CASE WHEN len(up) / len(vs) <= 0.2 THEN true ELSE q >= greatest(mu + 3 * list_avg([abs(x - mu) for x in up]), mu * 3) END AS above_upper, len(up) / len(vs) > 0.9 AS global,
  CASE WHEN len(up) = 0 THEN false ELSE coalesce(list_avg(het) BETWEEN 0.4 AND 0.6, true) AND len([x for x in up if x BETWEEN 0.3 AND 0.7 OR x BETWEEN 0.9 AND 1]) / len(up) >= 0.8 AND len([x for x in up if x BETWEEN 0.3 AND 0.7 OR x BETWEEN 0.9 AND 1]) / len(vs) >= 0.1 END AS germline FROM mean)"""


@add(f"""WITH {RS}, {_PANEL} SELECT variant_id, "sample", len(vs) AS panel, CASE WHEN q IS NULL OR len(vs) = 0 THEN true ELSE above_lower AND CASE WHEN global THEN false WHEN germline THEN true ELSE above_upper END END AS wgs,
  CASE WHEN q IS NULL OR len(vs) = 0 THEN true ELSE above_lower AND NOT global END AS panelseq FROM verdict""".replace("len(vs) AS panel", "CAST(len(vs) AS INTEGER) AS panel"))
def r309_pon_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Every variant and sample against the panel without itself (rows 304 to 311 and 317)."""
    t = rs(spark, sf)
    panel = filters.panel(t.where("is_pon"), "variant_id", "sample", "rppcounts")
    vs = filters.others_of_panel(col("vafs"), col("sample"))
    j = t.join(panel, "variant_id", "left").select("variant_id", "sample", readstats.vaf(col("rppcounts")).alias("q"), vs.alias("vs"))
    return j.select("variant_id", "sample", F.size("vs").alias("panel"), filters.pon_filter("wgs", col("q"), col("vs")).alias("wgs"), filters.pon_filter("panelseq_germline", col("q"), col("vs")).alias("panelseq"))


# ---- 2.11: numbers ----


@add("SELECT l_orderkey, l_linenumber, round(pow(10, l_quantity * -0.1), 9) AS p, CASE WHEN l_extendedprice = 0 THEN 0 ELSE round_even(l_extendedprice * pow(10, 2 - floor(log10(l_extendedprice))), 0) / pow(10, 2 - floor(log10(l_extendedprice))) END AS sig FROM lineitem")
def r254_phred_significant(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 254 and 255."""
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(numbers.phred(col("l_quantity")), 9).alias("p"), numbers.round_significant(col("l_extendedprice"), 3).alias("sig"))


_LISTS = "lists AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS a FROM lineitem GROUP BY l_orderkey)"


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    s = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(s, lambda x: x["l_quantity"]).alias("a"))


@add(f"""WITH {_LISTS} SELECT l_orderkey, round(list_avg([abs(x - list_avg(a)) for x in a]), 6) AS mean_mad, round(list_median([abs(x - list_median(a)) for x in a]), 6) AS median_mad,
  list_position(a, list_min(a)) - 1 AS argmin, list_position(a, list_max(a)) - 1 AS argmax, round(CASE WHEN len(a) > 1 THEN (SELECT sum(abs(x - y)) FROM (SELECT unnest(a) AS x), (SELECT unnest(a) AS y)) / (len(a) * (len(a) - 1)) END, 6) AS spread FROM lists"""
  .replace("(SELECT sum(abs(x - y)) FROM (SELECT unnest(a) AS x), (SELECT unnest(a) AS y))", "list_sum([list_sum([abs(x - y) for y in a]) for x in a])").replace("list_position(a, list_min(a)) - 1", "CAST(list_position(a, list_min(a)) - 1 AS BIGINT)").replace("list_position(a, list_max(a)) - 1", "CAST(list_position(a, list_max(a)) - 1 AS BIGINT)"))
def r258_deviations(spark: SparkSession, sf: str) -> DataFrame:
    """Deviations, places of extremes and mean difference of pairs (rows 257 to 260)."""
    a = col("a")
    t = _lists(spark, sf)
    return t.select("l_orderkey", F.round(numbers.mean_mad(a), 6).alias("mean_mad"), F.round(numbers.median_mad(a), 6).alias("median_mad"), numbers.argmin(a).alias("argmin"), numbers.argmax(a).alias("argmax"), F.round(numbers.mean_pair_difference(a), 6).alias("spread"))


@add("SELECT l_orderkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity) + 1e-7, 4) AS mean FROM lineitem GROUP BY l_orderkey")
def r256_weighted_means(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(numbers.weighted_mean(col("l_extendedprice"), col("l_quantity")) + 1e-7, 4).alias("mean"))


@add(f"""WITH {_LISTS} SELECT l_orderkey, array_to_string([i - 1 for i in range(1, len(a) + 1) if a[i] = list_min(a)], ',') AS places FROM lists""")
def r190_all_minima(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf).select("l_orderkey", _text(numbers.all_minima(col("a"))).alias("places"))


@add("""WITH e AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS v FROM embeddings), q AS (SELECT v AS w FROM e WHERE vec_id = (SELECT min(vec_id) FROM e))
SELECT vec_id, round(least(1, list_sum([x[1] * x[2] for x in list_zip(v, w)]) / (sqrt(list_sum([x * x for x in v])) * sqrt(list_sum([x * x for x in w])))), 6) AS cosine FROM e, q""")
def r261_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 261 and 262: every vector against one stated query."""
    e = table(spark, sf, "embeddings")
    first = e.orderBy("vec_id").first()
    q = F.array(*[F.lit(float(x)) for x in first["embedding"]]) if first else F.array()
    return e.select("vec_id", F.round(numbers.cosine(col("embedding"), q), 6).alias("cosine"))


@add("""SELECT p_partkey, CAST(floor(x) AS BIGINT) AS lower, CAST(CASE WHEN floor(x) = ceil(x) THEN ceil(x) + 1 ELSE ceil(x) END AS BIGINT) AS upper, CAST((x >= 100) AS INTEGER) + CAST((x >= 500) AS INTEGER) AS bin, round(10 + (x - 90) / 210 * 5, 6) AS scaled FROM (SELECT p_partkey, p_retailprice / 10 AS x FROM part)""")
def r263_bounds_bins_rescale(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 263, 264 and 266."""
    x = col("x")
    b = numbers.integer_bounds(x)
    t = table(spark, sf, "part").select("p_partkey", (col("p_retailprice") / 10).alias("x"))
    return t.select("p_partkey", b["lower"].alias("lower"), b["upper"].alias("upper"), numbers.digitize(x, [100, 500]).alias("bin"), F.round(numbers.rescale(x, F.lit(90), F.lit(300), (10, 15)), 6).alias("scaled"))


@add("SELECT p_partkey, array_to_string([CAST(round(p_size + i * (p_retailprice - p_size) / 4) AS BIGINT) for i in range(5)], ',') AS points FROM part")
def r265_linspaces(spark: SparkSession, sf: str) -> DataFrame:
    v = numbers.linspace(col("p_size").cast("double"), col("p_retailprice"), 5)
    return table(spark, sf, "part").select("p_partkey", _text(F.transform(v, lambda x: F.round(x).cast("long"))).alias("points"))


@add("SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN printf('%.3f M', o_totalprice / 1e6) WHEN o_totalprice >= 1e3 THEN printf('%.3f K', o_totalprice / 1e3) ELSE CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR) END AS txt FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def r268_short_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", numbers.short_number(F.floor("o_totalprice")).alias("txt"))


_V3 = f"[rppcounts[0] / {TOTAL}, rppcounts[1] / {TOTAL}, coalesce(rppcounts[-1], 0) / {TOTAL}]"


@add(f"""WITH {RS}, v AS (SELECT variant_id, "sample", {_V3} AS v FROM rs WHERE {TOTAL} > 0 AND rppcounts[0] IS NOT NULL AND rppcounts[1] IS NOT NULL AND rppcounts[2] IS NULL)
SELECT variant_id, "sample", round(list_sort(v)[1], 6) AS baf0, round(list_sort(v)[2], 6) AS baf1, round(CASE WHEN v[2] > 0.5 THEN 1 - v[2] ELSE v[2] END, 6) AS folded, round(v[2] / list_sum(v), 6) AS fitted, round(CASE WHEN v[1] = 0 THEN NULL ELSE v[2] / v[1] END, 6) AS odds,
  list_sum(v) >= 0.9 AND len([x for x in v if x = 0]) = 0 AS valid, list_max(v) / list_sum(v) < 0.85 AS is_het FROM v""")
def r277_minor_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """Minor allele fractions and flags of valid and heterozygous rows (rows 76 to 79 and 277 to 282)."""
    c = col("rppcounts")
    n = readstats.total(c)
    has = (n > 0) & F.try_element_at(c, F.lit(0)).isNotNull() & F.try_element_at(c, F.lit(1)).isNotNull() & F.try_element_at(c, F.lit(2)).isNull()
    v = F.array(readstats.vaf(c, 0), readstats.vaf(c, 1), F.coalesce(readstats.vaf(c, -1), F.lit(0.0)))
    t = rs(spark, sf).where(has).select("variant_id", "sample", v.alias("v"))
    minor, fit, total = numbers.minor_fractions(col("v")), numbers.sum_to_one(col("v")), numbers.array_sum(col("v"))
    return t.select(
        "variant_id", "sample", F.round(minor[0], 6).alias("baf0"), F.round(minor[1], 6).alias("baf1"), F.round(numbers.folded(col("v")[1]), 6).alias("folded"), F.round(fit[1], 6).alias("fitted"), F.round(numbers.over_reference(col("v"))[0], 6).alias("odds"),
        ((total >= 0.9) & ~F.exists("v", lambda x: x == 0)).alias("valid"), (F.array_max(fit) < 0.85).alias("is_het"))


@add("SELECT run_id, round(percent_rank() OVER (PARTITION BY run_id ORDER BY depth), 6) AS q, Chromosome, \"Start\" FROM (SELECT run_id, Chromosome, \"Start\", max(depth) AS depth FROM depth_rawdata WHERE NOT isnan(depth) GROUP BY ALL)")
def r283_quantile_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of each depth among those of its run."""
    t = table(spark, sf, "depth_rawdata").where(~F.isnan("depth") & col("depth").isNotNull()).groupBy("run_id", "Chromosome", "Start").agg(F.max("depth").alias("depth"))
    return t.select("run_id", F.round(F.percent_rank().over(Window.partitionBy("run_id").orderBy("depth")), 6).alias("q"), "Chromosome", "Start")


queries, oracle_sql = BOOK.queries, BOOK.oracle_sql
