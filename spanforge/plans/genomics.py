
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import alleles, annotation, reads
from spanforge.operators import algebra, frames, reference, signatures, structural
from spanforge.plans import copynumber, intervals, variants
from spanforge.plans.book import Book
from spanforge.plans.intervals import sql
from spanforge.runtime import materialize, table

BOOK = Book()
add = BOOK.add
col = F.col

# ---- 2.15: structural variants ----

_NORM = "regexp_replace(regexp_replace({0}, '^chrM$', 'MT'), '(?i)^chr0*', '')"
_SV = f"""sv AS (SELECT *, CASE WHEN a <> b THEN 'translocation' WHEN strand1 NOT IN ('+', '-') OR strand2 NOT IN ('+', '-') OR strand1 IS NULL OR strand2 IS NULL OR a IS NULL OR b IS NULL THEN NULL WHEN strand1 <> strand2 THEN 'inversion' WHEN strand1 = '+' THEN 'deletion' ELSE 'tandem-duplication' END AS svclass, abs(start1 - start2) AS length
  FROM (SELECT DISTINCT sv_id, chrom1, start1, chrom2, start2, "sample", strand1, strand2, {_NORM.format('chrom1')} AS a, {_NORM.format('chrom2')} AS b FROM rearrangements))"""
_SIZE = "CASE WHEN svclass IS NULL OR length IS NULL THEN NULL WHEN svclass = 'translocation' THEN '0' WHEN length <= 10000 THEN '1-10Kb' WHEN length <= 100000 THEN '10-100Kb' WHEN length <= 1000000 THEN '100Kb-1Mb' WHEN length <= 10000000 THEN '1Mb-10Mb' ELSE '>10Mb' END"


def _sv(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "rearrangements").select("sv_id", "chrom1", "start1", "chrom2", "start2", "sample", "strand1", "strand2").distinct()


@add(f"""WITH {_SV} SELECT sv_id, "sample", svclass, size_bin, length FROM (SELECT *, {_SIZE} AS size_bin FROM sv) WHERE size_bin IS NOT NULL AND (svclass = 'translocation' OR length >= 1000)""")
def r449_sv_classes(spark: SparkSession, sf: str) -> DataFrame:
    return structural.classified(_sv(spark, sf)).select("sv_id", "sample", "svclass", "size_bin", "length")


@add(f"""WITH {_SV} SELECT "sample", svclass, size_bin, count(*) AS n FROM (SELECT *, {_SIZE} AS size_bin FROM sv) WHERE size_bin IS NOT NULL AND (svclass = 'translocation' OR length >= 1000) GROUP BY ALL""")
def r449_sv_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    return structural.classified(_sv(spark, sf)).groupBy("sample", "svclass", "size_bin").agg(F.count(F.lit(1)).alias("n"))


@add(f"""WITH {_SV}, p AS (SELECT sv_id, "sample", a AS chrom, start1 AS pos, CASE WHEN a = b THEN start2 END AS partner, 1 AS side FROM sv UNION ALL SELECT sv_id, "sample", b, start2, CASE WHEN a = b THEN start1 END, 2 FROM sv),
q AS (SELECT *, count(*) OVER (PARTITION BY "sample", chrom) AS n, max(pos) OVER (PARTITION BY "sample", chrom ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM p WHERE chrom IS NOT NULL AND pos IS NOT NULL)
SELECT sv_id, CAST(side AS INTEGER) AS side, CASE WHEN before IS NULL THEN pos ELSE pos - CASE WHEN before = partner THEN (SELECT max(pos) FROM p AS o WHERE o."sample" IS NOT DISTINCT FROM q."sample" AND o.chrom = q.chrom AND o.pos < q.before) ELSE before END END AS imd FROM q WHERE n >= 4 AND pos IN (SELECT pos FROM p AS u WHERE u."sample" IS NOT DISTINCT FROM q."sample" AND u.chrom = q.chrom GROUP BY pos HAVING count(*) = 1)""")
def r450_break_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distances to the preceding break point that is not the partner (at least 4 per contig here), where no two break
    points share a place."""
    p = structural.breakpoints(_sv(spark, sf), "sv_id")
    alone = p.groupBy(col("sample").alias("_s"), col("chrom").alias("_c"), col("pos").alias("_p")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    d = structural.distances(p, 4)
    return d.join(alone, d["sample"].eqNullSafe(alone["_s"]) & (d["chrom"] == alone["_c"]) & (d["pos"] == alone["_p"])).select("sv_id", "side", "imd")


@add(f"""WITH m AS (SELECT variant_id, Chromosome, POS, REF, {_NORM.format('Chromosome')} AS a, regexp_extract(ALT1, '[\\[\\]]([^:]+):', 1) AS mc, CAST(regexp_extract(ALT1, ':([0-9]+)', 1) AS BIGINT) AS mp, ALT1[1] IN ('[', ']') AS is5, contains(ALT1, '[') AS m5, regexp_replace(ALT1, '[\\[\\]][^\\[\\]]+[\\[\\]]', '') AS t FROM variants WHERE {variants.BND.format('ALT1')})
SELECT variant_id, CASE WHEN a <> {_NORM.format('mc')} THEN 'TRA' WHEN NOT is5 AND m5 THEN 'DEL' WHEN is5 AND NOT m5 THEN 'DUP' ELSE 'INV' END AS kind,
  CASE WHEN is5 THEN CASE WHEN m5 THEN '[' ELSE ']' END || mc || ':' || mp || CASE WHEN m5 THEN '[' ELSE ']' END || t ELSE t || CASE WHEN m5 THEN '[' ELSE ']' END || mc || ':' || mp || CASE WHEN m5 THEN '[' ELSE ']' END END AS alt FROM m WHERE a IS NOT NULL""")
def r421_breakend_types(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 421 and 425."""
    t = table(spark, sf, "variants").where(alleles.is_breakend(col("ALT1")) & col("Chromosome").isNotNull()).select("variant_id", "Chromosome", alleles.parse_breakend(col("ALT1")).alias("b"))
    kind = structural.breakend_type(alleles.normalize_chrom(col("Chromosome"), True), alleles.normalize_chrom(col("b.mate_chrom"), True), col("b.is5"), col("b.mate_is5"))
    return t.select("variant_id", kind.alias("kind"), structural.breakend_alt(col("b.t"), col("b.mate_chrom"), col("b.mate_pos"), col("b.is5"), col("b.mate_is5")).alias("alt"))


_CN48 = """CASE WHEN CNt = 0 THEN '0' WHEN CNt <= 1 THEN '1' WHEN CNt = 2 THEN '2' WHEN CNt <= 4 THEN '3-4' WHEN CNt <= 8 THEN '5-8' ELSE '9+' END || ':' || CASE WHEN CNt = 0 THEN 'homdel' WHEN Bt = 0 OR CNt = Bt THEN 'LOH' ELSE 'het' END || ':' ||
  CASE WHEN len <= 100000 THEN '0-100kb' WHEN len <= 1000000 THEN '100kb-1Mb' WHEN CNt = 0 THEN '>1Mb' WHEN len <= 10000000 THEN '1Mb-10Mb' WHEN len <= 40000000 THEN '10Mb-40Mb' ELSE '>40Mb' END"""


@add(f"""WITH {copynumber.SEG}, {copynumber.FIT}, k AS (SELECT {_CN48} AS class FROM (SELECT *, (id % 997) * 50000 AS len FROM fit WHERE Bt IS NOT NULL)), every AS (SELECT unnest([{', '.join(repr(x) for x in structural.cn48_features())}]) AS class)
SELECT every.class, count(k.class) AS n FROM every LEFT JOIN k USING (class) GROUP BY every.class""")
def r448_cn48(spark: SparkSession, sf: str) -> DataFrame:
    t = copynumber.fit(spark, sf).where(col("Bt").isNotNull())
    key = structural.cn48_class(col("CNt"), col("Bt"), (col("id") % 997) * 50_000)
    return signatures.catalogue(t.withColumn("s", F.lit("all")), "s", key, structural.cn48_features()).select("class", "n")


# ---- 2.16: signatures ----

_CLASS6 = """CASE WHEN length(REF) = 1 AND length(ALT1) = 1 AND REF IN ('A', 'C', 'G', 'T') AND ALT1 IN ('A', 'C', 'G', 'T') AND REF <> ALT1 AND ALT2 IS NULL THEN CASE WHEN REF IN ('A', 'G') THEN translate(REF, 'AG', 'TC') || '>' || translate(ALT1, 'ACGT', 'TGCA') ELSE REF || '>' || ALT1 END END"""
_CALLED = f"""called AS (SELECT DISTINCT "sample", variant_id, REF, ALT1, Chromosome, POS, {_CLASS6} AS class FROM readstats JOIN variants USING (variant_id) WHERE NOT is_pon AND rppcounts[1] >= 2 AND "sample" IS NOT NULL)"""


def _called(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "readstats").where(~col("is_pon") & (F.try_element_at("rppcounts", F.lit(1)) >= 2) & col("sample").isNotNull()).select("sample", "variant_id").distinct()
    v = table(spark, sf, "variants").withColumn("class", F.when(col("ALT2").isNull(), alleles.substitution_class(col("REF"), col("ALT1"))))
    return r.join(v, "variant_id").select("sample", "variant_id", "REF", "ALT1", "Chromosome", "POS", "class")


@add(f"""WITH {_CALLED}, s AS (SELECT DISTINCT "sample" FROM called), k AS (SELECT unnest(['C>A', 'C>G', 'C>T', 'T>A', 'T>C', 'T>G']) AS class) SELECT s."sample", k.class, count(variant_id) AS n FROM s CROSS JOIN k LEFT JOIN called ON called."sample" = s."sample" AND called.class = k.class GROUP BY ALL""")
def r433_sbs6_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Six classes per sample, with zeros (rows 433 and 434)."""
    return signatures.catalogue(_called(spark, sf), "sample", col("class"), signatures.SUBSTITUTIONS)


_BASE = "'ACGT'[CAST(({0} * 7 + {0} // 3 + {0} // 11) % 4 AS BIGINT) + 1]"
WIDTH = 100


def _base(p: Column) -> Column:
    return F.substr(F.lit("ACGT"), ((p * 7 + F.floor(p / 3) + F.floor(p / 11)) % 4 + 1).cast("int"), F.lit(1))


def _reference(df: DataFrame) -> DataFrame:
    """An invented reference sequence: the chunks that lie around the places (Chromosome, POS) of a table."""
    c = F.floor((col("POS") - 1) / WIDTH)
    chunks = df.select("Chromosome", F.explode(F.array(c - 1, c, c + 1)).alias("chunk")).where(col("chunk") >= 0).distinct()
    seq = F.array_join(F.transform(F.sequence(col("chunk") * WIDTH, (col("chunk") + 1) * WIDTH - 1), _base), "")
    return chunks.select("Chromosome", "chunk", seq.alias("seq"))


@add(f"""WITH v AS (SELECT variant_id, POS, ALT1, {_BASE.format('(POS - 2)')} || {_BASE.format('(POS - 1)')} || {_BASE.format('POS')} AS c FROM variants WHERE POS > 1 AND Chromosome IS NOT NULL AND ALT2 IS NULL),
k AS (SELECT variant_id, c, CASE WHEN length(ALT1) = 1 AND ALT1 IN ('A', 'C', 'G', 'T') AND c[2] <> ALT1 THEN CASE WHEN c[2] IN ('A', 'G') THEN reverse(translate(c, 'ACGT', 'TGCA')) ELSE c END END AS d, CASE WHEN c[2] IN ('A', 'G') THEN translate(ALT1, 'ACGT', 'TGCA') ELSE ALT1 END AS a FROM v)
SELECT class, count(variant_id) AS n FROM (SELECT unnest([{', '.join(repr(x) for x in signatures.sbs96_keys())}]) AS class) LEFT JOIN (SELECT variant_id, d[1] || '[' || d[2] || '>' || a || ']' || d[3] AS class FROM k WHERE d IS NOT NULL) USING (class) GROUP BY class""")
def r162_sbs96_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """96 classes from the bases around each place of an invented reference (rows 162 and 245)."""
    v = table(spark, sf, "variants").where((col("POS") > 1) & col("Chromosome").isNotNull() & col("ALT2").isNull()).select("variant_id", "Chromosome", "POS", "ALT1")
    t = reference.fetch(v, _reference(v), WIDTH, col("POS") - 2, col("POS") + 1, ["variant_id"], "context")
    return signatures.catalogue(t.withColumn("s", F.lit("all")), "s", signatures.sbs96_class(col("context"), col("ALT1")), signatures.sbs96_keys()).select("class", "n")


@add(f"""WITH v AS (SELECT variant_id, POS FROM variants WHERE POS > 60 AND Chromosome IS NOT NULL) SELECT variant_id, round(list_sum([CASE WHEN {_BASE.format('p')} IN ('G', 'C') THEN 1 ELSE 0 END for p in range(POS - 50, POS + 51)]) / 101, 6) AS gc FROM v""")
def r272_gc_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """GC content around each place (rows 237, 272 and 276)."""
    v = table(spark, sf, "variants").where((col("POS") > 60) & col("Chromosome").isNotNull()).select("variant_id", "Chromosome", "POS")
    t = reference.fetch(v, _reference(v), WIDTH, col("POS") - 50, col("POS") + 51, ["variant_id"])
    return t.select("variant_id", F.round(reference.gc_fraction(col("seq")), 6).alias("gc"))


@add(f"""WITH v AS (SELECT DISTINCT Chromosome, (POS - 1) // 100 + o AS chunk FROM variants, (SELECT unnest([-1, 0, 1]) AS o) WHERE POS > 1 AND Chromosome IS NOT NULL AND (POS - 1) // 100 + o >= 0)
SELECT Chromosome, chunk * 100 + i * 20 AS "Start", chunk * 100 + i * 20 + 20 AS "End", round(list_sum([CASE WHEN {_BASE.format('p')} IN ('G', 'C') THEN 1 ELSE 0 END for p in range(chunk * 100 + i * 20, chunk * 100 + i * 20 + 20)]) / 20, 6) AS GC FROM v, (SELECT unnest(range(5)) AS i)""")
def r274_gc_bins(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "variants").where((col("POS") > 1) & col("Chromosome").isNotNull())
    return reference.gc_by_bin(_reference(v), WIDTH, 20).withColumn("GC", F.round("GC", 6))


def _signature_matrix(n: int = 5) -> pd.DataFrame:
    """Invented signatures over the 96 classes: one has most of its weight in every n-th class."""
    keys = signatures.sbs96_keys()
    m = np.array([[(5.0 if i % n == j else 0.2) + ((i * 7 + j * 13) % 11) / 11 for j in range(n)] for i in range(len(keys))])
    return pd.DataFrame(m / m.sum(0), index=keys, columns=[f"SBS{j + 1}" for j in range(n)])


@add()
def r440_fit_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """Exposures of the 96-class catalogue of each sample to invented signatures (rows 437, 439 and 440); without SQL: see
    the tests of the operator."""
    v = _called(spark, sf).where(col("POS") > 1)
    t = reference.fetch(v, _reference(v), WIDTH, col("POS") - 2, col("POS") + 1, ["sample", "variant_id"], "context")
    cat = signatures.catalogue(t, "sample", signatures.sbs96_class(col("context"), col("ALT1")), signatures.sbs96_keys())
    return signatures.fit_catalogues(cat, _signature_matrix())


_EXPO = """expo AS (SELECT o_custkey AS "sample", 'SBS' || (40 + o_orderkey % 25) AS signature, o_orderkey % 17 AS n FROM orders)"""


def _exposures(spark: SparkSession, sf: str) -> DataFrame:
    k = col("o_orderkey")
    return table(spark, sf, "orders").select(col("o_custkey").alias("sample"), F.concat(F.lit("SBS"), (k % 25 + 40).cast("string")).alias("signature"), (k % 17).alias("n"))


@add(f"""WITH {_EXPO} SELECT "sample", CAST(sum(CASE WHEN signature IN ({', '.join(repr(x) for x in signatures.ARTEFACTS)}) THEN n ELSE 0 END) AS BIGINT) AS burden, round(CASE WHEN sum(n) = 0 THEN NULL ELSE sum(CASE WHEN signature IN ({', '.join(repr(x) for x in signatures.ARTEFACTS)}) THEN n ELSE 0 END) / sum(n) END, 6) AS fraction FROM expo GROUP BY "sample" """)
def r438_artefact_burden(spark: SparkSession, sf: str) -> DataFrame:
    return signatures.artefact_burden(_exposures(spark, sf)).withColumn("fraction", F.round("fraction", 6))


@add(f"""WITH {_EXPO} SELECT "sample", CASE WHEN signature IN ('SBS40', 'SBS41') THEN 'flat' ELSE signature END AS signature, CAST(sum(n) AS BIGINT) AS n FROM expo GROUP BY ALL""")
def r435_merge_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return signatures.merge_signatures(_exposures(spark, sf), {"SBS40": "flat", "SBS41": "flat"})


@add(f"""WITH {_EXPO}, e AS (SELECT "sample", signature, sum(n) AS n FROM expo GROUP BY ALL), w AS (SELECT DISTINCT signature, c AS class, ((CAST(signature[4:] AS BIGINT) * c) % 7 + 1) / 10 AS weight FROM expo, (SELECT unnest([1, 2, 3]) AS c)),
x AS (SELECT "sample", class, signature, n * weight AS v FROM e JOIN w USING (signature)) SELECT "sample", CAST(class AS INTEGER) AS class, signature, round(CASE WHEN t = 0 THEN NULL ELSE v / t END + 1e-10, 6) AS p FROM (SELECT *, sum(v) OVER (PARTITION BY "sample", class) AS t FROM x)""")
def r442_probabilities(spark: SparkSession, sf: str) -> DataFrame:
    e = _exposures(spark, sf).groupBy("sample", "signature").agg(F.sum("n").alias("n"))
    w = e.select("signature").distinct().select("signature", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("class"))
    w = w.withColumn("weight", ((F.substring("signature", 4, 9).cast("long") * col("class")) % 7 + 1) / 10)
    return signatures.probabilities(e, w).withColumn("p", F.round(col("p") + 1e-10, 6))


@add("""SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / (sqrt(sum(l_quantity * l_quantity)) * sqrt(sum(l_extendedprice * l_extendedprice))), 6) AS cosine, round(sum(abs(l_quantity - l_extendedprice)) / sum(l_quantity), 4) AS l1,
  round(sqrt(sum((l_quantity - l_extendedprice) ** 2)) / sqrt(sum(l_quantity * l_quantity)), 4) AS l2, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem GROUP BY l_returnflag""")
def r443_similarities(spark: SparkSession, sf: str) -> DataFrame:
    s = signatures.similarities(col("l_quantity"), col("l_extendedprice"))
    digits = {"cosine": 6, "l1": 4, "l2": 4, "correlation": 6}
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(*[F.round(v, digits[k]).alias(k) for k, v in s.items()])


# ---- 2.13: annotations ----


@add("""SELECT event_id, '1' AS id, event_type AS kind, CAST(user_id AS VARCHAR) AS parent FROM events""")
def r030_attributes(spark: SparkSession, sf: str) -> DataFrame:
    """Attribute strings as maps (rows 27 to 30)."""
    text = F.concat(F.lit("ID=0;Name="), "event_type", F.lit("; ID=1;;Parent="), col("user_id").cast("string"), F.lit(";flag"))
    t = table(spark, sf, "events").select("event_id", annotation.attributes(text).alias("m"))
    return t.select("event_id", col("m")["ID"].alias("id"), col("m")["Name"].alias("kind"), col("m")["Parent"].alias("parent"))


@add("""SELECT annot_id, CAST(1 AS INTEGER) AS i, Feature AS feature, SYMBOL AS symbol FROM (SELECT DISTINCT annot_id, nullif(Feature, '') AS Feature, nullif(SYMBOL, '') AS SYMBOL FROM vep_annotation) UNION ALL SELECT annot_id, 2, nullif(Gene, ''), NULL FROM (SELECT DISTINCT annot_id, Gene FROM vep_annotation)""")
def r338_feature_strings(spark: SparkSession, sf: str) -> DataFrame:
    """Feature strings written from the annotation table and read again (rows 338 and 339)."""
    t = table(spark, sf, "vep_annotation").select("annot_id", "Feature", "SYMBOL", "Gene").distinct()
    e = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat(e("Feature"), F.lit("|"), e("SYMBOL"), F.lit(","), e("Gene"))
    x = t.select("annot_id", F.posexplode(annotation.features(text, ["feature", "symbol"])).alias("p", "f"))
    return x.select("annot_id", (col("p") + 1).alias("i"), "f.feature", "f.symbol").distinct()


@add("""SELECT s_suppkey, 0.0::DOUBLE AS a0, round(s_suppkey / 1000, 6) AS a1, round(s_nationkey / 100, 6) AS b0 FROM supplier""")
def r323_population_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 161, 318, 319 and 323."""
    text = F.concat(F.lit("A:.,"), (col("s_suppkey") / 1000).cast("string"), F.lit("|B:"), (col("s_nationkey") / 100).cast("string"))
    t = table(spark, sf, "supplier").select("s_suppkey", annotation.population_map(text).alias("m"))
    return t.select("s_suppkey", col("m")["A"][0].alias("a0"), F.round(col("m")["A"][1], 6).alias("a1"), F.round(col("m")["B"][0], 6).alias("b0"))


@add("""SELECT variant_id, ALT1 AS alt, min_by AS first_id FROM (SELECT Chromosome, POS, REF, ALT1, min(variant_id) AS min_by FROM (SELECT variant_id, Chromosome, POS, REF, ALT1 FROM variants WHERE ALT1 IS NOT NULL UNION ALL SELECT variant_id, Chromosome, POS, REF, ALT2 FROM variants WHERE ALT2 IS NOT NULL) GROUP BY ALL) AS g, LATERAL (SELECT g.min_by AS variant_id)""")
def r324_first_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per alternative, of repeated ones the first (rows 324 and 495)."""
    t = alleles.mono_alternatives(table(spark, sf, "variants").select("variant_id", "Chromosome", "POS", "REF", "ALT1", "ALT2"), ["ALT1", "ALT2"])
    g = t.groupBy("Chromosome", "POS", "REF", "alt").agg(F.min("variant_id").alias("first_id"))
    return g.select(col("first_id").alias("variant_id"), "alt", "first_id")


@add("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN p < s THEN s - p WHEN p >= e THEN e - 1 - p END AS point, CASE WHEN p + 3 <= s THEN s - (p + 3) + 1 WHEN p >= e THEN e - 1 - p END AS span FROM (SELECT *, l_partkey AS p, l_suppkey * 20 AS s, l_suppkey * 20 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)""")
def r329_feature_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 329 to 331."""
    p, s = col("l_partkey"), col("l_suppkey") * 20
    e = s + col("l_quantity").cast("long")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", annotation.distance(p, s, e).alias("point"), annotation.interval_distance(p, p + 3, s, e).alias("span"))


@add("""SELECT annot_id, coalesce(bool_or(contains(x, 'splice')) FILTER (x IN ('splice_acceptor_variant', 'splice_donor_variant', 'splice_donor_region_variant', 'splice_region_variant', 'splice_polypyrimidine_tract_variant', 'splice_donor_5th_base_variant')), false) AS splice,
  bool_or(x IN ('stop_gained', 'frameshift_variant', 'stop_lost', 'start_lost', 'inframe_insertion', 'inframe_deletion', 'missense_variant', 'protein_altering_variant')) AS altering, any_value(c) AS coding
  FROM (SELECT annot_id, unnest(string_split(Consequence, '&')) AS x, coalesce(BIOTYPE IN ('IG_C_gene', 'IG_D_gene', 'IG_J_gene', 'IG_V_gene', 'ccds_gene', 'mRNA', 'protein_coding'), false) AS c FROM (SELECT DISTINCT annot_id, Consequence, BIOTYPE FROM vep_annotation WHERE regexp_matches(Consequence, '^[A-Za-z0-9_&]+$'))) GROUP BY annot_id""")
def r333_consequence_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of consequences and transcript types, of fields in plain notation (rows 333 and 334)."""
    t = table(spark, sf, "vep_annotation").where(col("Consequence").rlike("^[A-Za-z0-9_&]+$")).select("annot_id", "Consequence", "BIOTYPE").distinct()
    f = annotation.consequence_flags(F.split("Consequence", "&"))
    return t.select("annot_id", f["splice_region_involved"].alias("splice"), f["protein_altering"].alias("altering"), F.coalesce(annotation.biotype_flags(col("BIOTYPE"))["coding"], F.lit(False)).alias("coding"))


_EXONS = """x AS (SELECT l_orderkey, list({'s': s, 'e': s + 5} ORDER BY s) AS ex FROM (SELECT DISTINCT l_orderkey, l_linenumber * 10 AS s FROM lineitem) GROUP BY l_orderkey)"""


@add(f"""WITH {_EXONS} SELECT l_orderkey, CASE WHEN len(ex) > 1 THEN array_to_string([ex[i].e || '-' || ex[i + 1].s for i in range(1, len(ex))], ',') END AS introns, CASE WHEN len(ex) > 1 THEN array_to_string(list_reverse([ex[i].e || '-' || ex[i + 1].s for i in range(1, len(ex))]), ',') END AS reverse FROM x""")
def r335_introns(spark: SparkSession, sf: str) -> DataFrame:
    s = (col("l_linenumber") * 10).cast("long")
    t = table(spark, sf, "lineitem").select("l_orderkey", s.alias("start")).distinct().groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("start", (col("start") + 5).alias("end")))).alias("ex"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",")
    return t.select("l_orderkey", text(annotation.introns(col("ex"), F.lit(True))).alias("introns"), text(annotation.introns(F.reverse("ex"), F.lit(False))).alias("reverse"))


@add("""SELECT variant_id, array_to_string(list_sort(list(DISTINCT SYMBOL)), ',') AS genes FROM vep_annotation WHERE SYMBOL IS NOT NULL GROUP BY variant_id""")
def r337_gene_names(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "vep_annotation").where(col("SYMBOL").isNotNull())
    return t.groupBy("variant_id").agg(F.array_join(F.sort_array(F.collect_set("SYMBOL")), ",").alias("genes"))


@add("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'b' ELSE 'a' END AS k1_over, 'a' AS k1_keep, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n FROM orders""")
def r332_map_merges(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 332, 347 and 348."""
    mine = F.create_map(F.lit("k1"), F.lit("a"))
    other = F.when(col("o_orderkey") % 3 == 0, F.create_map(F.lit("k1"), F.lit("b"), F.lit("k2"), F.lit("c"))).otherwise(F.create_map().cast("map<string,string>"))
    m = lambda **kw: annotation.merge_maps(mine, other, **kw)
    return table(spark, sf, "orders").select("o_orderkey", m()["k1"].alias("k1_over"), m(overwrite=False)["k1"].alias("k1_keep"), F.size(m()).alias("n"))


@add("""SELECT o_custkey, CAST(sum(o_orderkey % 5) AS BIGINT) AS total, round(sum(o_orderkey % 5) FILTER (o_orderstatus = 'F') / 100, 6) AS f_portion FROM orders GROUP BY o_custkey""")
def r320_site_portions(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences by site (rows 159, 320 to 322)."""
    per = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.sum(col("o_orderkey") % 5).alias("n"))
    t = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    samples = F.create_map(*[x for s in "FOP" for x in (F.lit(s), F.lit(100))])
    return t.select("o_custkey", F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, b: a + b).alias("total"), F.round(annotation.site_portions(col("m"), samples)["F"], 6).alias("f_portion"))


@add("""SELECT o_orderkey, o_orderpriority <> '5-LOW' OR o_orderstatus = 'F' AS meaningful FROM orders""")
def r342_meaningful(spark: SparkSession, sf: str) -> DataFrame:
    level = F.when(col("o_orderpriority") != "5-LOW", col("o_orderpriority"))
    onco = F.when(col("o_orderstatus") == "F", "Likely Oncogenic").when(col("o_orderstatus") == "P", "Unknown")
    return table(spark, sf, "orders").select("o_orderkey", annotation.is_meaningful([level, F.lit(None)], onco).alias("meaningful"))


# ---- 2.17: reads ----

_READ = "(o_orderkey * 37) % 4096"


@add(f"""SELECT o_orderkey, f & 1 <> 0 AND f & 4 = 0 AND f & 8 = 0 AND f & 1024 = 0 AS good, f & 1 <> 0 AND f & 4 = 0 AND f & 8 = 0 AND f & 1024 = 0 AND f & 2048 = 0 AND f & 256 = 0 AS pileup,
  CASE WHEN f & 8 <> 0 OR t = 0 THEN NULL WHEN t > 0 THEN me || mate ELSE mate || me END AS orientation FROM (SELECT o_orderkey, CAST({_READ} AS INTEGER) AS f, o_custkey % 3 - 1 AS t, CASE WHEN f & 16 <> 0 THEN 'r' ELSE 'f' END || CASE WHEN f & 64 <> 0 THEN '1' ELSE '2' END AS me, CASE WHEN f & 32 <> 0 THEN 'r' ELSE 'f' END || CASE WHEN f & 64 <> 0 THEN '2' ELSE '1' END AS mate FROM orders)""")
def r090_read_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 90, 91 and 464."""
    f = ((col("o_orderkey") * 37) % 4096).cast("int")
    return table(spark, sf, "orders").select("o_orderkey", reads.is_good(f).alias("good"), reads.for_pileup(f).alias("pileup"), reads.orientation(f, col("o_custkey") % 3 - 1).alias("orientation"))


_CIGAR = "(o_custkey % 5) || 'S' || (20 + o_orderkey % 30) || 'M' || (1 + o_orderkey % 3) || CASE WHEN o_orderkey % 2 = 0 THEN 'D' ELSE 'I' END || '10M' || (o_orderkey % 4) || 'S'"


@add("""SELECT o_orderkey, CAST(m + 10 + CASE WHEN o_orderkey % 2 = 0 THEN g ELSE 0 END AS INTEGER) AS on_reference, CAST(l + m + 10 + r + CASE WHEN o_orderkey % 2 = 1 THEN g ELSE 0 END AS INTEGER) AS in_read, CAST(l AS INTEGER) AS left_clip, CAST(r AS INTEGER) AS right_clip,
  o_orderkey || '-' || (o_orderkey + m) || ',' || (o_orderkey + m + CASE WHEN o_orderkey % 2 = 0 THEN g ELSE 0 END) || '-' || (o_orderkey + m + 10 + CASE WHEN o_orderkey % 2 = 0 THEN g ELSE 0 END) AS blocks FROM (SELECT o_orderkey, o_custkey % 5 AS l, 20 + o_orderkey % 30 AS m, 1 + o_orderkey % 3 AS g, o_orderkey % 4 AS r FROM orders)""")
def r462_cigars(spark: SparkSession, sf: str) -> DataFrame:
    """CIGAR strings: lengths, clips and aligned blocks (rows 459, 461 to 463)."""
    o, text = col("o_orderkey"), lambda c: c.cast("string")
    cigar = F.concat(text(col("o_custkey") % 5), F.lit("S"), text(o % 30 + 20), F.lit("M"), text(o % 3 + 1), F.when(o % 2 == 0, "D").otherwise("I"), F.lit("10M"), text(o % 4), F.lit("S"))
    t = table(spark, sf, "orders").select("o_orderkey", reads.cigar(cigar).alias("ops"))
    blocks = F.transform(reads.aligned_blocks(o, col("ops")), lambda b: F.concat(b["start"].cast("string"), F.lit("-"), b["end"].cast("string")))
    return t.select("o_orderkey", reads.reference_length(col("ops")).alias("on_reference"), reads.query_length(col("ops")).alias("in_read"), reads.soft_clips(col("ops"))["left"].alias("left_clip"), reads.soft_clips(col("ops"))["right"].alias("right_clip"), F.array_join(blocks, ",").alias("blocks"))


_PILE = """pile AS (SELECT l_partkey, CASE WHEN l_quantity < 15 THEN 'A' ELSE 'ACGT'[l_linenumber % 4 + 1] END AS base FROM lineitem), por AS (SELECT l_partkey, base, count(*) AS n, sum(count(*)) OVER (PARTITION BY l_partkey) AS depth FROM pile GROUP BY l_partkey, base)"""


def _pileup(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select("l_partkey", F.substr(F.lit("ACGT"), (col("l_linenumber") % 4 + 1).cast("int"), F.lit(1)).alias("b"), "l_quantity", F.lit("A").alias("ref"))
    return reads.allele_portions(t, ["l_partkey"], "b", "l_quantity", "ref", 15)


@add(f"WITH {_PILE} SELECT l_partkey, base, n, CAST(depth AS BIGINT) AS depth, round(n / depth, 6) AS portion FROM por")
def r470_pileups(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and portions per place, bases of low quality being the reference's (rows 470 to 473)."""
    return _pileup(spark, sf).select("l_partkey", "base", "n", "depth", F.round("portion", 6).alias("portion"))


@add(f"WITH {_PILE} SELECT l_partkey, CASE WHEN max(n / depth) > 0.5 THEN arg_max(base, n) ELSE 'X' END AS base FROM por GROUP BY l_partkey")
def r484_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return reads.consensus(_pileup(spark, sf), ["l_partkey"])


@add("""SELECT o_orderkey, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR a = b THEN a END AS class FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 2 END AS a, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 2 END AS b FROM orders)""")
def r468_pair_classes(spark: SparkSession, sf: str) -> DataFrame:
    a, b = (F.when(col(c) % 3 > 0, col(c) % 2) for c in ("o_orderkey", "o_custkey"))
    return table(spark, sf, "orders").select("o_orderkey", reads.merge_classes(a, b).alias("class"))


# ---- 2.18: contigs, plotting data ----


@add("""SELECT chr_name, cum_start + length // 2 AS middle, chrom AS other, cum_start = coalesce((SELECT sum(length) FROM chromdict AS y WHERE y.idx < x.idx), 0) AS consistent FROM chromdict AS x""")
def r492_cumulative_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Names in the other spelling and places on the whole genome (rows 490 to 492)."""
    t = table(spark, sf, "chromdict")
    whole = frames.cumulative(frames.all_regions(intervals.contigs(spark, sf), False), intervals.contigs(spark, sf))
    j = t.join(whole.select(col("Chromosome").alias("chr_name"), "length_cumsum"), "chr_name")
    return j.select("chr_name", (col("cum_start") + F.floor(col("length") / 2)).alias("middle"), col("chrom").alias("other"), (col("cum_start") == col("length_cumsum") - col("length")).alias("consistent"))


@add(sql("r c", """SELECT region_id, round((cum_start + greatest(r."Start", CAST(floor(length * 0.25) AS BIGINT)) ) / (SELECT sum(length) FROM c), 9) AS x0, round((cum_start + least(r."End", CAST(floor(length * 0.75) AS BIGINT))) / (SELECT sum(length) FROM c), 9) AS x1 FROM r JOIN c USING (Chromosome) WHERE r."Start" < CAST(floor(length * 0.75) AS BIGINT) AND r."End" > CAST(floor(length * 0.25) AS BIGINT)"""))
def r508_plot_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """Regions cut to a view and laid on an axis from 0 to 1 (rows 508 and 509)."""
    c = intervals.contigs(spark, sf)
    total = c.agg(F.sum("length")).first()[0]
    view = c.select("Chromosome", F.floor(col("length") * 0.25).alias("Start"), F.floor(col("length") * 0.75).alias("End"))
    t = frames.with_contig(algebra.intersect(intervals.regions(spark, sf).drop("sample"), view), c)
    return t.select("region_id", F.round((col("cum_start") + col("Start")) / F.lit(total), 9).alias("x0"), F.round((col("cum_start") + col("End")) / F.lit(total), 9).alias("x1"))


@add(sql("d", """SELECT Chromosome, min("Start") AS "Start", max("End") AS "End", any_value(state) AS state FROM (SELECT *, sum(CASE WHEN state = p AND "Start" <= e THEN 0 ELSE 1 END) OVER (PARTITION BY Chromosome ORDER BY "Start", "End" ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, lag(state) OVER (PARTITION BY Chromosome ORDER BY "Start", "End") AS p, lag("End") OVER (PARTITION BY Chromosome ORDER BY "Start", "End") AS e FROM step)) GROUP BY Chromosome, g""", intervals._STEP))
def r510_merge_adjacent(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that touch and have the same value become one."""
    t = intervals._steps(spark, sf)
    from spanforge.operators.ordered import running

    t = running(t, ["Chromosome"], F.struct("Start", "End", "state"), "max", "_p")
    new = ~F.coalesce((col("_p.state") == col("state")) & (col("Start") <= col("_p.End")), F.lit(False))
    t = running(materialize(t.withColumn("_new", new.cast("long"))), ["Chromosome"], col("_new"), "sum", "_g").withColumn("g", F.coalesce("_g", F.lit(0)) + col("_new"))
    return t.groupBy("Chromosome", "g").agg(F.min("Start").alias("Start"), F.max("End").alias("End"), F.first("state").alias("state")).drop("g")


@add("""WITH c AS (SELECT chr_name AS contig, length FROM chromdict), refs AS (SELECT 'full' AS ref, contig, length FROM c UNION ALL SELECT 'other', contig, length + 1 FROM c UNION ALL SELECT 'main', contig, length FROM c WHERE length > 1000000),
s AS (SELECT ref, count(*) FILTER (c.length IS NOT NULL) AS common, count(*) FILTER (c.length IS NULL) AS only_ref, bool_and(coalesce(c.length = refs.length, true)) AS ok FROM refs LEFT JOIN c USING (contig) GROUP BY ref) SELECT ref, common, only_ref FROM s WHERE ok QUALIFY rank() OVER (ORDER BY common DESC, only_ref) = 1""")
def r489_infer_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Which known reference has the contigs of a file: all common lengths equal, most common contigs, fewest others."""
    c = table(spark, sf, "chromdict").select(col("chr_name").alias("contig"), "length")
    refs = c.select(F.lit("full").alias("ref"), "*").unionByName(c.select(F.lit("other").alias("ref"), "contig", (col("length") + 1).alias("length"))).unionByName(c.where("length > 1000000").select(F.lit("main").alias("ref"), "*"))
    return infer_reference(c, refs)


def infer_reference(contigs: DataFrame, known: DataFrame) -> DataFrame:
    """ref, common, only_ref of the known references (ref, contig, length) that fit contigs (contig, length) best; more than
    one row means a tie, none that nothing fits."""
    t = known.join(contigs.select("contig", col("length").alias("_mine")), "contig", "left").groupBy("ref").agg(
        F.count("_mine").alias("common"), F.sum(col("_mine").isNull().cast("long")).alias("only_ref"), F.bool_and(F.coalesce(col("_mine") == col("length"), F.lit(True))).alias("_ok"))
    best = t.where("_ok").groupBy("ref", "common", "only_ref").agg(F.lit(1).alias("_x")).drop("_x")
    top = best.agg(F.max(F.struct("common", (-col("only_ref")).alias("o"))).alias("t"))  # one row
    return best.join(F.broadcast(top), (col("common") == col("t.common")) & (col("only_ref") == -col("t.o"))).select("ref", "common", "only_ref")


@add("""SELECT key, type, count(*) AS n FROM (SELECT unnest(['p', 'q']) AS key, unnest([CASE WHEN user_id % 2 = 0 THEN 'int' ELSE 'float' END, 'str']) AS type FROM events) GROUP BY ALL""")
def r493_observed_types(spark: SparkSession, sf: str) -> DataFrame:
    """Types that occur for each key of INFO-like fields."""
    v = F.when(col("user_id") % 2 == 0, col("user_id").cast("string")).otherwise(F.concat(col("user_id").cast("string"), F.lit(".5")))
    m = annotation.attributes(F.concat(F.lit("p="), v, F.lit(";q="), "event_type"))
    t = table(spark, sf, "events").select(F.explode(m).alias("key", "value"))
    return t.groupBy("key", alleles.typed_text(col("value"))["kind"].alias("type")).agg(F.count(F.lit(1)).alias("n"))


queries, oracle_sql = BOOK.queries, BOOK.oracle_sql
