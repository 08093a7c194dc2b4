
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import alleles, annotation, readstats
from spanforge.functions import copynumber as cn
from spanforge.operators import algebra, filters, frames, genotypes, islands, overlap_join, reads_groups, reference
from spanforge.plans import copynumber, intervals, variants
from spanforge.plans.book import Book
from spanforge.plans.intervals import _ON, sql, union_sql
from spanforge.runtime import table

BOOK = Book()
add = BOOK.add
col = F.col
C, K = copynumber.C, copynumber.K

# ---- depth and fractions together ----

_W = """w AS (SELECT chr_name AS Chromosome, s AS "Start", least(s + 1000000, length) AS "End" FROM (SELECT *, unnest(range(0, length, 1000000)) AS s FROM chromdict))"""


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    c = intervals.contigs(spark, sf)
    t = c.select("Chromosome", "length", F.explode(F.sequence(F.lit(0).cast("long"), col("length") - 1, F.lit(1_000_000).cast("long"))).alias("Start"))
    return t.select("Chromosome", "Start", F.least(col("Start") + 1_000_000, "length").alias("End"))


@add(sql("d r", f"""SELECT x.Chromosome, x."Start", x."End", count(y."Start") AS N, round(avg(y.v) + 1e-9, 6) AS baf_mean FROM d AS x LEFT JOIN (SELECT Chromosome, "Start", "End", max(region_id % 50 / 100) AS v FROM r GROUP BY ALL) AS y ON {_ON} GROUP BY ALL"""))
def r120_depth_with_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """Depth bins with the mean fraction of the places inside (rows 119 and 120)."""
    p = intervals.regions(spark, sf).groupBy(*frames.COORDS).agg(F.max(col("region_id") % 50 / 100).alias("baf"))
    t = overlap_join.overlap_join(intervals.bins(spark, sf).select(*frames.COORDS), p, "baf", ["mean"])
    return t.withColumn("baf_mean", F.round(col("baf_mean") + 1e-9, 6))


@add(sql("d", f"""SELECT x.Chromosome, x."Start", x."End", count(y."Start") AS N, round(avg(y.depth) + 1e-9, 5) AS depth_mean, round(stddev_pop(y.depth) + 1e-9, 5) AS depth_std FROM w AS x LEFT JOIN d AS y ON {_ON} GROUP BY ALL""", _W))
def r140_segment_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Segments with mean and deviation of the bins inside (row 140)."""
    t = overlap_join.overlap_join(_windows(spark, sf), intervals.bins(spark, sf).drop("MQ"), "depth")
    return t.select(*frames.COORDS, "N", F.round(col("depth_mean") + 1e-9, 5).alias("depth_mean"), F.round(col("depth_std") + 1e-9, 5).alias("depth_std"))


@add(sql("r k", """SELECT Chromosome, "Start", "End", in_left, in_right FROM flags WHERE in_left OR in_right""", union_sql("r", "ma"), union_sql("k", "mb"), intervals._CUTS))
def r121_refined_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Borders of two sets of segments taken together (rows 121 and 409)."""
    return algebra.isec_union(algebra.merge(intervals.regions(spark, sf)), algebra.merge(intervals.breaks(spark, sf)))


_GERM = """g AS (SELECT chr_name AS Chromosome, s AS "Start", least(s + 700000, length) AS "End", (s // 700000) % 3 AS CNg, (s // 700000) % 2 AS Bg FROM (SELECT *, unnest(range(0, length, 700000)) AS s FROM chromdict))"""


def _germline(spark: SparkSession, sf: str) -> DataFrame:
    c = intervals.contigs(spark, sf)
    t = c.select("Chromosome", "length", F.explode(F.sequence(F.lit(0).cast("long"), col("length") - 1, F.lit(700_000).cast("long"))).alias("Start"))
    i = F.floor(col("Start") / 700_000)
    return t.select("Chromosome", "Start", F.least(col("Start") + 700_000, "length").alias("End"), (i % 3).alias("CNg"), (i % 2).alias("Bg"))


@add(sql("r", f"""SELECT x.region_id, greatest(x."Start", y."Start") AS "Start", least(x."End", y."End") AS "End" FROM r AS x JOIN g AS y ON {_ON} WHERE y.Bg > 0 AND y.CNg - y.Bg = y.Bg""", _GERM))
def r081_equal_alleles(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of regions with as many copies of one allele as of the other (rows 80 and 81)."""
    g = _germline(spark, sf).where((col("Bg") > 0) & (col("CNg") - col("Bg") == col("Bg")))
    return algebra.intersect(intervals.regions(spark, sf).drop("sample"), g).select("region_id", "Start", "End")


@add(f"""WITH {copynumber.SEG}, {copynumber.FIT}, m AS (SELECT *, (id % 10) / 10 AS ccf, id % 4 AS sub FROM fit) SELECT round(sum((CNt * (1 - ccf) + sub * ccf) * n) / sum(n), 6) AS ploidy FROM m""")
def r146_mean_ploidy(spark: SparkSession, sf: str) -> DataFrame:
    """Mean ploidy of clonal and subclonal copies."""
    t = copynumber.fit(spark, sf)
    x = (col("id") % 10) / 10
    return t.agg(F.round(F.sum((col("CNt") * (1 - x) + (col("id") % 4) * x) * col("n")) / F.sum("n"), 6).alias("ploidy"))


@add(f"""WITH {copynumber.SEG}, {copynumber.FIT}, d AS (SELECT id, depth, {K} * (g * {1 - C} + CNt * {C}) AS p, (id % 5) / 10 AS s, n FROM fit)
SELECT id, round(CASE WHEN s = 0 THEN 0.0 ELSE -(lgamma(3) - lgamma(2.5) - 0.5 * ln(5 * pi()) - ln(s / sqrt(n)) - 3 * ln(1 + pow((depth - p) / (s / sqrt(n)), 2) / 5)) END, 6) AS penalty FROM d""")
def r380_penalties(spark: SparkSession, sf: str) -> DataFrame:
    t = copynumber.fit(spark, sf)
    p = cn.predicted_depth(col("CNt"), K, C, col("g"))
    return t.select("id", F.round(cn.t_penalty(col("depth"), p, (col("id") % 5) / 10, col("n")), 6).alias("penalty"))


@add(sql("d", """SELECT Chromosome, min("Start") AS "Start", arg_max("End", ("Start", "End")) AS "End", any_value(cn) AS cn FROM (SELECT *, sum(CASE WHEN cn IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY Chromosome ORDER BY "Start", "End" ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, lag(cn) OVER (PARTITION BY Chromosome ORDER BY "Start", "End") AS p FROM (SELECT *, greatest(round_even((depth / 15 - 2 * 0.3) / 0.7, 0) + 0, 0) AS cn FROM d WHERE depth IS NOT NULL))) GROUP BY Chromosome, g"""))
def r410_merge_by_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Bins with their copies, merged where they are equal (row 410)."""
    t = intervals.bins(spark, sf).where(col("depth").isNotNull()).select(*frames.COORDS, cn.clonal_cnt(col("depth"), 0.7, 15, 2).alias("cn"))
    return islands.merge_byannot(t, ["cn"])


# ---- variants ----


@add(f"""WITH {variants.RS}, {variants._PANEL} SELECT variant_id, "sample", CASE WHEN q IS NULL OR len(vs) = 0 THEN true ELSE len([x for x in vs if x >= 0.2]) / len(vs) < 0.1
  AND coalesce(CASE WHEN floor(len(vs) * 0.7) = 0 OR list_avg(vs[1:CAST(floor(len(vs) * 0.7) AS BIGINT)]) = 0 THEN true ELSE q / list_avg(vs[1:CAST(floor(len(vs) * 0.7) AS BIGINT)]) >= 5 END, true)
  AND coalesce(CASE WHEN len([x for x in vs if x <= q * 1.3 AND x >= q / 1.3]) < 5 THEN true ELSE q / list_avg([x for x in vs if x <= q * 1.3 AND x >= q / 1.3]) >= 3 END, true) END AS kept FROM verdict""")
def r313_legacy_panel(spark: SparkSession, sf: str) -> DataFrame:
    t = variants.rs(spark, sf)
    panel = filters.panel(t.where("is_pon"), "variant_id", "sample", "rppcounts")
    j = t.join(panel, "variant_id", "left").select("variant_id", "sample", readstats.vaf(col("rppcounts")).alias("q"), filters.others_of_panel(col("vafs"), col("sample")).alias("vs"))
    return j.select("variant_id", "sample", filters.pon_panelseq_legacy(col("q"), col("vs")).alias("kept"))


_KIND = "['blood', 'tumor', 'clonal'][CAST(ascii(\"sample\"[9]) % 3 + 1 AS BIGINT)]"


@add(f"""WITH {variants.RS}, k AS (SELECT *, {_KIND} AS kind, {variants.TOTAL} AS n FROM rs WHERE "sample" IS NOT NULL),
votes AS (SELECT variant_id, allele, count(*) AS n FROM (SELECT variant_id, unnest([x.k for x in list_sort([{{'c': -e.value, 'k': e.key}} for e in map_entries(rppcounts) if e.key >= 0 AND coalesce(e.value, 0) > 0])[1:1]]) AS allele FROM k WHERE kind IN ('blood', 'clonal')) GROUP BY ALL),
germ AS (SELECT variant_id, arg_min(allele, (-n, allele)) AS germline FROM votes GROUP BY variant_id),
seen AS (SELECT DISTINCT variant_id, unnest([e.key for e in map_entries(rppcounts) if e.key >= 0 AND CASE WHEN n = 0 THEN false ELSE e.value / n >= CASE WHEN kind = 'clonal' THEN 0.2 ELSE 0.05 END END]) AS allele FROM k)
SELECT i.variant_id, CAST(any_value(germline) AS VARCHAR) AS germline, coalesce(array_to_string(list_sort(list(allele) FILTER (allele IS NOT NULL AND allele IS DISTINCT FROM germline)), ','), '') AS somatic FROM (SELECT DISTINCT variant_id FROM k) AS i LEFT JOIN germ USING (variant_id) LEFT JOIN seen USING (variant_id) GROUP BY i.variant_id""")
def r188_germline_somatic(spark: SparkSession, sf: str) -> DataFrame:
    """Inherited alleles (one copy here) by vote of the samples, and acquired ones."""
    kind = F.element_at(F.array(F.lit("blood"), F.lit("tumor"), F.lit("clonal")), (F.ascii(F.substring("sample", 9, 1)) % 3 + 1).cast("int"))
    t = variants.rs(spark, sf).where(col("sample").isNotNull()).withColumn("kind", kind)
    g = genotypes.genotypes(t, "variant_id", "rppcounts", "kind", 1)
    return g.select("variant_id", col("germline")[0].cast("string").alias("germline"), F.array_join(F.transform("somatic", lambda x: x.cast("string")), ",").alias("somatic"))


@add("""SELECT o_orderkey, CASE WHEN (r = a)::INT + (r = b)::INT + (r = c)::INT = 1 THEN CASE WHEN r = a THEN 0 WHEN r = b THEN 1 ELSE 2 END END AS class FROM (SELECT o_orderkey, 'ACGT'[o_orderkey % 4 + 1] AS r, 'ACGT'[o_custkey % 4 + 1] AS a, 'ACGT'[o_custkey % 3 + 1] AS b, 'A' AS c FROM orders)""")
def r467_matched_alleles(spark: SparkSession, sf: str) -> DataFrame:
    """Class of a read by identity with one of the allele sequences."""
    pick = lambda c: F.substr(F.lit("ACGT"), (c + 1).cast("int"), F.lit(1))
    targets = F.create_map(F.lit(0), pick(col("o_custkey") % 4), F.lit(1), pick(col("o_custkey") % 3), F.lit(2), F.lit("A"))
    return table(spark, sf, "orders").select("o_orderkey", readstats.match_allele(pick(col("o_orderkey") % 4), targets).alias("class"))


# ---- annotations ----


@add("""SELECT name, list_sort(list(DISTINCT code)) AS codes, count(DISTINCT code) > 1 AS ambiguous FROM (SELECT concat_ws('_', Chromosome, POS, REF, ALT1) AS name, 'COSV' || variant_id % 700 AS code FROM variants WHERE ID IS NOT NULL AND ID <> '') GROUP BY name""".replace("list_sort(list(DISTINCT code)) AS codes", "array_to_string(list_sort(list(DISTINCT code)), ',') AS codes"))
def r328_codes_of_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Codes by variant, with those that have several (rows 160, 325 to 328)."""
    t = table(spark, sf, "variants").where(col("ID").isNotNull() & (col("ID") != "")).select(F.concat_ws("_", "Chromosome", col("POS").cast("string"), "REF", "ALT1").alias("name"), F.concat(F.lit("COSV"), (col("variant_id") % 700).cast("string")).alias("code"))
    g = t.groupBy("name").agg(F.sort_array(F.collect_set("code")).alias("c"))
    return g.select("name", F.array_join("c", ",").alias("codes"), (F.size("c") > 1).alias("ambiguous"))


@add("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderkey % 3 END AS INTEGER) AS frame FROM orders""")
def r340_codon_frames(spark: SparkSession, sf: str) -> DataFrame:
    o = col("o_orderkey")
    before = F.when(o % 3 == 0, "Gat").when(o % 3 == 1, "gAt").otherwise("gaT")
    return table(spark, sf, "orders").select("o_orderkey", annotation.codon_frame(before, F.when(o % 5 == 4, "gatt").otherwise("ccc")).cast("int").alias("frame"))


@add("""SELECT s_nationkey AS gene, bool_or(s_suppkey % 3 = 0) AS amp, bool_or(s_suppkey % 3 = 1) AS del FROM supplier GROUP BY s_nationkey""")
def r343_gene_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Genes with flags of the kinds of events that matter (row 343)."""
    t = table(spark, sf, "supplier").select(col("s_nationkey").alias("gene"), F.when(col("s_suppkey") % 3 == 0, "amp").when(col("s_suppkey") % 3 == 1, "del").alias("kind"))
    return t.groupBy("gene").agg(*[F.bool_or(F.coalesce(col("kind") == k, F.lit(False))).alias(k) for k in ("amp", "del")])


@add("""SELECT l_orderkey, string_agg(s, '' ORDER BY l_linenumber, l_partkey, s) AS cds, reverse(translate(string_agg(s, '' ORDER BY l_linenumber, l_partkey, s), 'ACGT', 'TGCA')) AS minus FROM (SELECT l_orderkey, l_linenumber, l_partkey, repeat('ACGT'[l_suppkey % 4 + 1], l_linenumber) AS s FROM lineitem) GROUP BY l_orderkey""")
def r344_coding_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Exon sequences joined in order, and their reverse complement."""
    s = F.repeat(F.substr(F.lit("ACGT"), (col("l_suppkey") % 4 + 1).cast("int"), F.lit(1)), col("l_linenumber"))
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", s.alias("s")))).alias("x"))
    cds = F.array_join(F.transform("x", lambda e: e["s"]), "")
    return t.select("l_orderkey", cds.alias("cds"), alleles.reverse_complement(cds).alias("minus"))


@add("""SELECT chr_name AS Chromosome, CAST(10 AS BIGINT) AS "Start", CAST(15 AS BIGINT) AS "End" FROM chromdict UNION ALL SELECT chr_name, 17, 25 FROM chromdict UNION ALL SELECT chr_name, 28, 30 FROM chromdict""")
def r273_unknown_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of N, also over the border of two chunks."""
    c = table(spark, sf, "chromdict")
    chunk = F.explode(F.array(F.struct(F.lit(0).cast("long").alias("chunk"), F.lit("ACGTACGTACNNNNNAcNNN").alias("seq")), F.struct(F.lit(1).cast("long").alias("chunk"), F.lit("nnNNNACGNN").alias("seq"))))
    return reference.n_regions(c.select(col("chr_name").alias("Chromosome"), chunk.alias("x")).select("Chromosome", "x.*"), 20)


# ---- reads ----

_CLIPS = "clips AS (SELECT l_partkey AS pos, l_linenumber % 2 = 0 AS leftward, 'ACGT'[l_suppkey % 2 + 1] || 'ACGT'[CAST(l_quantity AS BIGINT) % 3 + 1] AS seq FROM lineitem)"


@add(f"""WITH {_CLIPS}, n AS (SELECT pos, leftward, count(*) AS n FROM clips GROUP BY ALL), b AS (SELECT pos, leftward, i, seq[i] AS base, count(*) AS k FROM clips, (SELECT unnest([1, 2]) AS i) GROUP BY ALL), c AS (SELECT pos, leftward, i, CASE WHEN max(k) / sum(k) > 0.5 THEN arg_max(base, k) ELSE 'X' END AS base FROM b GROUP BY ALL)
SELECT pos, leftward, n, string_agg(base, '' ORDER BY i) AS seq FROM n JOIN c USING (pos, leftward) WHERE n > 1 GROUP BY ALL""")
def r429_clip_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """Clipped ends of reads by place and side, with more than one read, and their consensus (rows 429 and 431)."""
    base = lambda c: F.substr(F.lit("ACGT"), (c + 1).cast("int"), F.lit(1))
    t = table(spark, sf, "lineitem").select(col("l_partkey").alias("pos"), (col("l_linenumber") % 2 == 0).alias("leftward"), F.concat(base(col("l_suppkey") % 2), base(col("l_quantity").cast("long") % 3)).alias("seq"))
    return reads_groups.clip_consensus(t, ["pos", "leftward"], "seq", 1)


@add("""SELECT name, count(*) AS n, count(*) FILTER (first) = 1 AND count(*) FILTER (NOT first) = 1 AS paired, min(pos) AS "Start", max(pos) AS "End" FROM (SELECT o_orderkey // 2 AS name, o_orderkey % 2 = 0 AS first, o_custkey AS pos FROM orders WHERE o_custkey % 11 > 0) GROUP BY name""")
def r458_read_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Reads by name, and whether both mates are there."""
    o = col("o_orderkey")
    t = table(spark, sf, "orders").where(col("o_custkey") % 11 > 0).select(F.floor(o / 2).alias("name"), (o % 2 == 0).alias("first"), col("o_custkey").alias("pos"))
    return reads_groups.pairs(t, "name", "first", "pos")


@add("""SELECT o_orderkey, p - 1 AS pos0, CAST(c AS INTEGER) AS mismatches FROM (SELECT o_orderkey, o_orderkey AS p, (a <> b)::INT + (a2 <> b2)::INT AS c FROM (SELECT o_orderkey, 'ACGT'[o_orderkey % 4 + 1] AS a, 'ACGT'[o_custkey % 4 + 1] AS b, 'ACGT'[o_orderkey % 3 + 1] AS a2, 'ACGT'[o_custkey % 3 + 1] AS b2 FROM orders))""")
def r460_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    """Number of mismatches of reads of two aligned bases (row 460)."""
    base = lambda c: F.substr(F.lit("ACGT"), (c + 1).cast("int"), F.lit(1))
    o, c = col("o_orderkey"), col("o_custkey")
    t = table(spark, sf, "orders").select("o_orderkey", (o - 1).alias("pos0"), F.concat(base(o % 4), base(o % 3)).alias("read"), F.concat(base(c % 4), base(c % 3)).alias("ref"))
    return t.select("o_orderkey", "pos0", F.size(reads_groups.mismatches(col("read"), col("ref"), col("pos0"))).alias("mismatches"))


queries, oracle_sql = BOOK.queries, BOOK.oracle_sql
