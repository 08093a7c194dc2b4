
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import alleles, readstats
from spanforge.operators import filters, frames, overlap_join, readsupport, reference, signatures
from spanforge.plans import genomics, intervals
from spanforge.plans.book import Book
from spanforge.plans.genomics import _BASE, WIDTH, _reference
from spanforge.plans.intervals import sql
from spanforge.plans.variants import type_sql
from spanforge.runtime import table
from spanforge.sources import text

BOOK = Book()
add = BOOK.add
col = F.col
FLANK = 40


def _span(a: str, b: str) -> str:
    """SQL of the invented reference from place a (0-based) to b."""
    return f"array_to_string([{_BASE.format('p')} for p in range({a}, {b})], '')"


def _indels(spark: SparkSession, sf: str) -> DataFrame:
    """Insertions and deletions, one for every variant with a place: the inserted or deleted bases are the next 1 to 3 of the
    reference, so that many can be moved."""
    v = table(spark, sf, "variants").where((col("POS") > FLANK + 1) & col("Chromosome").isNotNull()).select("variant_id", "Chromosome", "POS")
    k = (col("variant_id") % 3 + 1).cast("int")
    t = reference.fetch(v, _reference(v), WIDTH, col("POS") - FLANK, col("POS") + 3 + FLANK, ["variant_id"], "text")
    before, seq = F.substr("text", F.lit(1), F.lit(FLANK)), F.substr("text", F.lit(FLANK + 1), k)
    anchor, ins = F.substr("text", F.lit(FLANK), F.lit(1)), col("variant_id") % 2 == 0
    after = F.when(ins, F.substr("text", F.lit(FLANK + 1), F.lit(FLANK))).otherwise(F.substr("text", F.lit(FLANK + 1) + k, F.lit(FLANK)))
    return t.select("variant_id", "Chromosome", "POS", F.when(ins, anchor).otherwise(F.concat(anchor, seq)).alias("ref"), F.when(ins, F.concat(anchor, seq)).otherwise(anchor).alias("alt"), before.alias("before"), after.alias("after"))


_INDELS = f"""i0 AS (SELECT variant_id, POS, variant_id % 3 + 1 AS k, variant_id % 2 = 0 AS ins, {_span(f'POS - {FLANK}', 'POS')} AS before, {_span('POS', f'POS + 3 + {FLANK}')} AS behind FROM variants WHERE POS > {FLANK + 1} AND Chromosome IS NOT NULL),
indel AS (SELECT *, behind[1:k] AS seq, CASE WHEN ins THEN behind[1:{FLANK}] ELSE behind[k + 1:k + {FLANK}] END AS after FROM i0),
l AS (SELECT *, list_position([(before || seq)[{FLANK} - j] = (before || seq)[{FLANK} - j + k] for j in range({FLANK})], false) AS ls, list_position([(seq || after)[j] = (seq || after)[j + k] for j in range(1, {FLANK} + 1)], false) AS rs FROM indel),
m AS (SELECT *, least(CASE WHEN ls > 0 THEN ls - 1 ELSE {FLANK} END, {FLANK - 1}) AS lm, CASE WHEN rs > 0 THEN rs - 1 ELSE {FLANK} END AS rm FROM l)"""


@add(f"""WITH {_INDELS} SELECT variant_id, CAST(POS - lm AS BIGINT) AS left_pos, (before || seq)[{FLANK} - lm] || CASE WHEN ins THEN '' ELSE (before || seq)[{FLANK} - lm + 1:{FLANK} - lm + k] END AS left_ref, CAST(POS + rm AS BIGINT) AS right_pos, CAST(lm + rm + 1 AS INTEGER) AS n FROM m""")
def r226_shifted_indels(spark: SparkSession, sf: str) -> DataFrame:
    """Leftmost, rightmost and all equivalent places of insertions and deletions (rows 226 to 228)."""
    a = [col(c) for c in ("POS", "ref", "alt")]
    t = _indels(spark, sf).select("variant_id", alleles.shift_left(*a, col("before")).alias("l"), alleles.shift_right(*a, col("after")).alias("r"), alleles.equivalents(*a, col("before"), col("after")).alias("e"))
    return t.select("variant_id", col("l.pos").alias("left_pos"), col("l.ref").alias("left_ref"), col("r.pos").alias("right_pos"), F.size("e").alias("n"))


@add(f"""WITH {_INDELS}, u AS (SELECT variant_id, seq, before, after, k, [reverse(before)[j * k + 1:j * k + k] = reverse(seq) for j in range({FLANK} // k)] AS a, [after[j * k + 1:j * k + k] = seq for j in range({FLANK} // k)] AS b FROM indel)
SELECT variant_id, CAST(coalesce(nullif(list_position(a, false), 0), len(a) + 1) - 1 AS INTEGER) AS before, CAST(coalesce(nullif(list_position(b, false), 0), len(b) + 1) - 1 AS INTEGER) AS behind FROM u""")
def r240_repeats_around(spark: SparkSession, sf: str) -> DataFrame:
    """How often the sequence stands beside an insertion or deletion (rows 238 and 240)."""
    seq = alleles.diff_seq(col("ref"), col("alt"))
    t = _indels(spark, sf).select("variant_id", alleles.repeat_around(seq, col("before"), col("after")).alias("x"))
    return t.select("variant_id", col("x.left").alias("before"), col("x.right").alias("behind"))


_PAIR = """pair AS (SELECT o_orderkey AS id, o_orderkey % 5000 + 10 AS p1, 1 + o_orderkey % 3 AS n1, o_orderkey % 5000 + 10 + o_custkey % 6 AS p2, 1 + o_custkey % 2 AS n2 FROM orders)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Two substitutions each, near each other on the invented reference."""
    from spanforge.plans.genomics import _base

    o, c = col("o_orderkey"), col("o_custkey")
    t = table(spark, sf, "orders").select(o.alias("id"), (o % 5000 + 10).alias("p1"), (o % 3 + 1).cast("int").alias("n1"), (o % 5000 + 10 + c % 6).alias("p2"), (c % 2 + 1).cast("int").alias("n2"))
    end = F.greatest(col("p1") + col("n1"), col("p2") + col("n2"))
    text = F.array_join(F.transform(F.sequence(col("p1") - 1, end - 2), _base), "")
    t = t.withColumn("span", text)
    at = (col("p2") - col("p1") + 1).cast("int")
    return t.select("id", "p1", "p2", F.substr("span", F.lit(1), col("n1")).alias("r1"), F.lit("T").alias("a1"), F.substr("span", at, col("n2")).alias("r2"), F.lit("GG").alias("a2"), "span")


@add(f"""WITH {_PAIR}, t AS (SELECT *, {_span('p1 - 1', 'greatest(p1 + n1, p2 + n2) - 1')} AS span FROM pair), x AS (SELECT *, 'T' || span[n1 + 1:] AS a, span[1:p2 - p1] || 'GG' || span[p2 - p1 + n2 + 1:] AS b FROM t)
SELECT id, p1 AS pos, span AS ref, CASE WHEN a = b THEN a WHEN p1 < p2 THEN a || '|' || b ELSE b || '|' || a END AS alts, CASE WHEN p1 + n1 <= p2 THEN 'T' || span[n1 + 1:p2 - p1] || 'GG' END AS joined FROM x""")
def r229_merge_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Two variants as one record of two haplotypes, and as one of one haplotype (rows 229 to 231)."""
    t = _pairs(spark, sf)
    a = [col(c) for c in ("p1", "r1", "a1", "p2", "r2", "a2")]
    gap = F.substr("span", (F.length("r1") + 1).cast("int"), F.greatest(col("p2") - col("p1") - F.length("r1"), F.lit(0)).cast("int"))
    t = t.select("id", alleles.merge_alleles(*a, col("span")).alias("m"), alleles.concat_alleles(*a, gap).alias("c"))
    return t.select("id", "m.pos", "m.ref", F.array_join("m.alts", "|").alias("alts"), col("c.alt").alias("joined"))


@add(f"""WITH {_INDELS}, x AS (SELECT variant_id, before, behind, (behind || 'ACGT')[2:20] AS r2, 'TT' || before[3:{FLANK - 1}] || before[{FLANK}] AS l2 FROM indel)
SELECT variant_id, CAST(len(list_filter(range(1, 20), lambda i: behind[1:i] = r2[1:i])) + len(list_filter(range(1, {FLANK} + 1), lambda i: reverse(before)[1:i] = reverse(l2)[1:i])) AS INTEGER) AS n FROM x""")
def r423_microhomology(spark: SparkSession, sf: str) -> DataFrame:
    """Bases by which two joined break ends can be moved (row 423)."""
    v = table(spark, sf, "variants").where((col("POS") > FLANK + 1) & col("Chromosome").isNotNull()).select("variant_id", "Chromosome", "POS")
    t = reference.fetch(v, _reference(v), WIDTH, col("POS") - FLANK, col("POS") + 3 + FLANK, ["variant_id"], "text")
    l1, r1 = F.substr("text", F.lit(1), F.lit(FLANK)), F.substr("text", F.lit(FLANK + 1))
    r2 = F.substr(F.concat(r1, F.lit("ACGT")), F.lit(2), F.lit(19))
    l2 = F.concat(F.lit("TT"), F.substr(l1, F.lit(3), F.lit(FLANK - 2)))
    return t.select("variant_id", alleles.microhomology(l1, r1, l2, r2)["length"].alias("n"))


@add(f"""WITH t AS (SELECT variant_id, Chromosome, POS, REF, ALT1, {type_sql('REF', 'ALT1')} AS t FROM variants), a AS (SELECT * FROM t WHERE t IN ('snv', 'ins', 'del') AND Chromosome IS NOT NULL AND POS IS NOT NULL)
SELECT x.variant_id, min(y.variant_id) AS hit, count(*) AS hits FROM a AS x JOIN a AS y ON x.Chromosome = y.Chromosome AND x.POS = y.POS AND x.REF = y.REF AND x.ALT1 = y.ALT1 GROUP BY x.variant_id""")
def r113_match_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records found in a table whose alleles are written with more bases, by their parsimonious forms (rows 113 and 114)."""
    v = table(spark, sf, "variants").where(col("Chromosome").isNotNull() & col("POS").isNotNull()).withColumn("t", alleles.mutation_type(col("REF"), col("ALT1"))).where(col("t").isin("snv", "ins", "del"))
    long = alleles.parsimonious(col("POS") - 2, F.concat(F.lit("GT"), "REF"), F.concat(F.lit("GT"), "ALT1"))
    y = v.select("Chromosome", col("variant_id").alias("other"), long.alias("x")).select("Chromosome", "other", col("x.pos").alias("POS"), col("x.ref").alias("REF"), col("x.alt").alias("ALT1"))
    return v.select("variant_id", "Chromosome", "POS", "REF", "ALT1").join(y, ["Chromosome", "POS", "REF", "ALT1"]).groupBy("variant_id").agg(F.min("other").alias("hit"), F.count(F.lit(1)).alias("hits"))


@add(f"""WITH {_INDELS}, u AS (SELECT variant_id, ins, k, seq, before, after, [reverse(before)[j * k + 1:j * k + k] = reverse(seq) for j in range({FLANK} // k)] AS a, [after[j * k + 1:j * k + k] = seq for j in range({FLANK} // k)] AS b,
  greatest(len([j for j in range(1, k + 1) if seq[1:j] = after[1:j]]), len([j for j in range(1, k + 1) if reverse(seq)[1:j] = reverse(before)[1:j]])) AS mh FROM indel),
c AS (SELECT *, coalesce(nullif(list_position(a, false), 0), len(a) + 1) - 1 + coalesce(nullif(list_position(b, false), 0), len(b) + 1) - 1 AS r FROM u),
n AS (SELECT *, CASE WHEN r >= 5 THEN '5+' ELSE CAST(r AS VARCHAR) END AS rc, least(mh, k - 1) AS m FROM c)
SELECT variant_id, CASE WHEN k = 1 THEN '1:' || CASE WHEN ins THEN 'Ins:' ELSE 'Del:' END || CASE WHEN seq IN ('A', 'G') THEN translate(seq, 'AG', 'TC') ELSE seq END || ':' || rc WHEN NOT ins AND r = 0 AND m > 0 THEN k || ':Del:M:' || m ELSE k || CASE WHEN ins THEN ':Ins:R:' ELSE ':Del:R:' END || rc END AS class FROM n""")
def r445_indel_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Classes of insertions and deletions."""
    return _indels(spark, sf).select("variant_id", signatures.id83_class(*[col(c) for c in ("ref", "alt", "before", "after")]).alias("class"))


@add("""SELECT chrom AS Chromosome, CAST(idx AS BIGINT) AS "Start", length AS "End", 'liver=1,lung=' || idx AS activities FROM chromdict""")
def r505_converted_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features with contigs in the other spelling and in order, and with activities by tissue (rows 505 to 507)."""
    c = table(spark, sf, "chromdict")
    f = c.select(col("chr_name").alias("Chromosome"), col("idx").cast("long").alias("Start"), col("length").alias("End"), col("idx").alias("id"))
    act = c.select(col("idx").alias("id"), F.explode(F.array(F.struct(F.lit("lung").alias("tissue"), col("idx").cast("string").alias("activity")), F.struct(F.lit("liver").alias("tissue"), F.lit("1").alias("activity")))).alias("x")).select("id", "x.*")
    names = c.select(col("chr_name").alias("name"), col("chrom").alias("Chromosome"))
    t = text.renamed(text.with_activities(f, act, "id"), names, frames.contig_table(c))
    return t.select("Chromosome", "Start", "End", F.array_join(F.transform(F.map_entries("activities"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("activities"))


@add("SELECT o_custkey % 100 AS user, CAST(sum(o_orderkey) AS BIGINT) AS size FROM orders GROUP BY ALL")
def r163_sizes_by_user(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy((col("o_custkey") % 100).alias("user")).agg(F.sum("o_orderkey").alias("size"))


@add()
def r455_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Six-class catalogues drawn anew; without SQL: see the tests of the operator."""
    cat = signatures.catalogue(genomics._called(spark, sf), "sample", col("class"), signatures.SUBSTITUTIONS)
    return signatures.bootstrap_catalogues(cat, 7)


# ---- reads to read support ----

_R = """reads AS (SELECT l_partkey AS variant_id, CAST(l_linenumber % 3 - 1 AS BIGINT) AS allele, l_quantity AS mq, l_extendedprice / 1000 AS bq, CASE WHEN l_suppkey % 4 = 0 THEN 1 ELSE 0 END AS clip, CASE WHEN l_suppkey % 2 = 0 THEN 'f1r2' ELSE 'f2r1' END AS orient, l_discount * 10 AS place FROM lineitem)"""


def _reads(spark: SparkSession, sf: str) -> DataFrame:
    s = col("l_suppkey")
    return table(spark, sf, "lineitem").select(col("l_partkey").alias("variant_id"), (col("l_linenumber") % 3 - 1).cast("long").alias("allele"), col("l_quantity").alias("mq"), (col("l_extendedprice") / 1000).alias("bq"), F.when(s % 4 == 0, 1).otherwise(0).alias("clip"), F.when(s % 2 == 0, "f1r2").otherwise("f2r1").alias("orient"), (col("l_discount") * 10).alias("place"))


@add(f"""WITH {_R} SELECT variant_id, allele, count(*) AS n, round(avg(mq) + 1e-9, 6) AS mean_mq, round(median(mq), 6) AS median_mq, round(stddev_pop(bq) + 1e-9, 6) AS std_bq, count(*) FILTER (clip > 0) AS clipped, count(*) FILTER (orient = 'f1r2') AS f1r2 FROM reads GROUP BY ALL""")
def r152_read_support(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 139, 152 and 153."""
    t = readsupport.summarize(_reads(spark, sf), ["variant_id"], "allele", ["mq", "bq"], "clip", "orient")
    return t.select("variant_id", "allele", "n", F.round(col("mean_mq") + 1e-9, 6).alias("mean_mq"), F.round("median_mq", 6).alias("median_mq"), F.round(col("std_bq") + 1e-9, 6).alias("std_bq"), "clipped", "f1r2")


@add(f"""WITH {_R}, c AS (SELECT variant_id, allele, count(*) FILTER (orient = 'f1r2') AS a, count(*) AS n FROM reads GROUP BY ALL)
SELECT variant_id, allele, round(least(1, list_sum([CASE WHEN lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) <= lgamma(n + 1) - lgamma(a + 1) - lgamma(n - a + 1) + 1e-7 THEN exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5)) ELSE 0 END for i in range(0, n + 1)])) + 1e-9, 6) AS p FROM c""")
def r156_orientation(spark: SparkSession, sf: str) -> DataFrame:
    t = readsupport.summarize(_reads(spark, sf), ["variant_id"], "allele", [], orient="orient")
    return t.select("variant_id", "allele", F.round(readsupport.orientation_balance(col("f1r2"), col("f2r1")) + 1e-9, 6).alias("p"))


@add(f"""WITH {_R}, c AS (SELECT variant_id, allele, round_even(least(greatest(place, 0), 1) * 1000, 0) AS step, count(*) AS n FROM reads GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY variant_id, allele) AS total, sum(n) OVER (PARTITION BY variant_id, allele ORDER BY step) AS upto FROM c),
d AS (SELECT variant_id, allele, (sqrt(max(total)) + 0.12 + 0.11 / sqrt(max(total))) * max(greatest(upto / total - step / 1000, step / 1000 - (upto - n) / total)) AS z FROM w GROUP BY ALL)
SELECT variant_id, allele, round(CASE WHEN z < 0.2 THEN 1 ELSE least(1, greatest(0, list_sum([CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * j * j * z * z) for j in range(1, 101)]))) END + 1e-9, 6) AS p FROM d""")
def r155_places_in_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Uniformity of the places in reads."""
    t = readsupport.uniform_pvalues(_reads(spark, sf), ["variant_id", "allele"], "place")
    return t.select("variant_id", "allele", F.round(col("p_value") + 1e-9, 6).alias("p"))


@add(f"""WITH {_R}, s AS (SELECT variant_id, allele, count(*) AS n, avg(mq) AS mq, avg(bq) AS bq FROM reads GROUP BY ALL), k AS (SELECT variant_id, max(mq) FILTER (allele = 1) AS m1, sum(mq * n) FILTER (allele = 0) / sum(n) FILTER (allele = 0) AS m0, max(bq) FILTER (allele = 1) AS b1, sum(bq * n) / sum(n) AS b FROM s GROUP BY variant_id)
SELECT variant_id, coalesce(m1 - m0 >= -15, true) AS diff_mq, coalesce(m1 >= 20, true) AS abs_mq, coalesce(b < 40, false) AS clip_length, coalesce(b1 < 40, true) AS abs_clip, coalesce(b1 >= 30, true) AS place, coalesce(m1 <= 25, true) AS recurrent FROM k""")
def r293_other_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The rules on further statistics (rows 290, 291, 293 to 296 and 302), from summarized reads."""
    s = readsupport.summarize(_reads(spark, sf), ["variant_id"], "allele", ["mq", "bq"])
    maps = [readsupport.as_map(s, ["variant_id"], "allele", v, n) for v, n in (("n", "counts"), ("mean_mq", "mq"), ("mean_bq", "bq"))]
    t = maps[0].join(maps[1], "variant_id").join(maps[2], "variant_id")
    one = lambda c: F.try_element_at(c, F.lit(1).cast("long"))
    m = col("mq")
    rules = {
        "diff_mq": filters.mean_difference(m, col("counts"), 1, 2, -15), "abs_mq": filters.at_least(one(m), 20), "clip_length": filters.below(readstats.class_mean(col("bq"), col("counts")), 40, False),
        "abs_clip": filters.below(one(col("bq")), 40), "place": filters.at_least(one(col("bq")), 30), "recurrent": filters.recurrent_mismatches(one(m), 25),
    }
    return t.select("variant_id", *[v.alias(k) for k, v in rules.items()])


@add("""WITH d AS (SELECT DISTINCT variant_id, l, p, r, a FROM (SELECT o_custkey AS variant_id, o_orderkey // 4 AS l, o_orderkey // 4 * 10 + o_orderkey % 4 AS p, 'ACGT'[o_orderkey % 4 + 1] AS r, 'CATG'[o_orderkey % 4 + 1] AS a FROM orders)),
e AS (SELECT o_orderkey // 4 * 10 + o_orderkey % 4 AS p, o_orderkey % 4 AS i, 'ACGT'[o_orderkey % 4 + 1] AS r, 'CATG'[o_orderkey % 4 + 1] AS a FROM orders WHERE o_custkey % 5 > 0),
f AS (SELECT *, p - row_number() OVER (ORDER BY p) AS run FROM e), g AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY p) AS k, lead(r) OVER (PARTITION BY run ORDER BY p) AS r2, lead(a) OVER (PARTITION BY run ORDER BY p) AS a2 FROM f)
SELECT p AS pos, r || r2 AS ref, a || a2 AS alt FROM g WHERE k % 2 = 1 AND r2 IS NOT NULL""")
def r446_doublets(spark: SparkSession, sf: str) -> DataFrame:
    """Substitutions of neighbouring bases in pairs."""
    o = col("o_orderkey")
    pick = lambda s: F.substr(F.lit(s), (o % 4 + 1).cast("int"), F.lit(1))
    t = table(spark, sf, "orders").where(col("o_custkey") % 5 > 0).select(F.floor(o / 40_000_000_000).alias("contig"), (F.floor(o / 4) * 10 + o % 4).alias("POS"), pick("ACGT").alias("REF"), pick("CATG").alias("ALT1"))
    return readsupport.doublets(t, ["contig"]).select(col("POS").alias("pos"), "ref", "alt")


@add("""WITH c AS (SELECT 'chr' || o_orderkey % 3 AS Chromosome, o_orderkey // 3 * 2 + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END AS pos, CASE WHEN o_custkey % 3 = 0 THEN 'G' ELSE 'C' END AS base, o_custkey % 7 AS m, o_custkey % 4 AS u FROM orders),
w AS (SELECT *, lead(pos) OVER o AS p, lead(base) OVER o AS b, lead(m) OVER o AS m2, lead(u) OVER o AS u2, lag(pos) OVER o AS q, lag(base) OVER o AS c FROM c WINDOW o AS (PARTITION BY Chromosome ORDER BY pos))
SELECT Chromosome, CASE WHEN base = 'G' THEN pos - 1 ELSE pos END AS pos, coalesce(base = 'C' AND b = 'G' AND p = pos + 1, false) AS both, m + CASE WHEN base = 'C' AND b = 'G' AND p = pos + 1 THEN m2 ELSE 0 END AS methylated, m + u + CASE WHEN base = 'C' AND b = 'G' AND p = pos + 1 THEN m2 + u2 ELSE 0 END AS total FROM w WHERE NOT coalesce(base = 'G' AND c = 'C' AND q = pos - 1, false)""")
def r036_cpg_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Methylation counts of both strands taken together."""
    o, c = col("o_orderkey"), col("o_custkey")
    g = c % 3 == 0
    t = table(spark, sf, "orders").select(F.concat(F.lit("chr"), (o % 3).cast("string")).alias("Chromosome"), (F.floor(o / 3) * 2 + F.when(g, 1).otherwise(0)).alias("pos"), F.when(g, "G").otherwise("C").alias("base"), (c % 7).alias("methylated"), (c % 4).alias("unmethylated"))
    return readsupport.cpg_pairs(t)


@add(sql("r", """SELECT g.kit, count(*) AS n, CAST(sum(least(r."End", g."End") - greatest(r."Start", g."Start")) AS BIGINT) AS bases, round(sum(least(r."End", g."End") - greatest(r."Start", g."Start")) / any_value(g.total), 6) AS depth FROM r JOIN (SELECT Chromosome, "Start", "End", kit, sum("End" - "Start") OVER (PARTITION BY kit) AS total FROM (SELECT chr_name AS Chromosome, CAST(0 AS BIGINT) AS "Start", length // 2 AS "End", 'k' || idx % 3 AS kit FROM chromdict)) AS g ON r.Chromosome = g.Chromosome AND r."Start" < g."End" AND g."Start" < r."End" GROUP BY g.kit"""))
def r487_region_depths(spark: SparkSession, sf: str) -> DataFrame:
    """Mean depth of groups of regions (rows 346, 486, 487 and 511)."""
    c = intervals.contigs(spark, sf)
    g = c.select("Chromosome", F.lit(0).cast("long").alias("Start"), F.floor(col("length") / 2).alias("End"), F.concat(F.lit("k"), (col("idx") % 3).cast("string")).alias("kit"))
    total = g.groupBy("kit").agg(F.sum(col("End") - col("Start")).alias("total"))
    p = overlap_join.overlap_pairs(intervals.regions(spark, sf), g)
    t = p.groupBy("kit").agg(F.count(F.lit(1)).alias("n"), F.sum(overlap_join.overlap_length()).alias("bases")).join(total, "kit")
    return t.select("kit", "n", "bases", F.round(col("bases") / col("total"), 6).alias("depth"))


queries, oracle_sql = BOOK.queries, BOOK.oracle_sql
