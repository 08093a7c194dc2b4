
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions import copynumber as cn
from spanforge.operators import algebra, copynumber, frames, overlap_join
from spanforge.plans import intervals
from spanforge.plans.book import Book
from spanforge.plans.intervals import sql
from spanforge.runtime import table

BOOK = Book()
add = BOOK.add
col = F.col
C, K, P = 0.7, 6.0, 2.5

SEG = """seg AS (SELECT o_orderkey AS id, o_totalprice / 10000 AS depth, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey % 51) / 100 END AS baf, 1000 + o_custkey AS n,
  CASE WHEN o_orderkey % 10 = 0 THEN 0.0 WHEN o_orderkey % 10 < 3 THEN 1.0 ELSE 2.0 END::DOUBLE AS g, CASE WHEN o_orderkey % 10 < 3 THEN 0.0 ELSE 1.0 END::DOUBLE AS bg FROM orders)"""


def seg(spark: SparkSession, sf: str) -> DataFrame:
    k = col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("id"), (col("o_totalprice") / 10000).alias("depth"), F.when(k % 13 != 0, (k % 51) / 100).alias("baf"), (col("o_custkey") + 1000).alias("n"),
        F.when(k % 10 == 0, 0.0).when(k % 10 < 3, 1.0).otherwise(2.0).alias("g"), F.when(k % 10 < 3, 0.0).otherwise(1.0).alias("bg"))


CNT = "CASE WHEN g = 0 THEN 0.0::DOUBLE ELSE greatest(round_even((depth / {k} - g * (1 - {c})) / {c}, 0) + 0, 0) END"
BT = "CASE WHEN g = 0 OR bg = 0 THEN 0.0::DOUBLE ELSE least(greatest(round_even(baf * (CNt + g * (1 / {c} - 1)) - bg * (1 / {c} - 1), 0) + 0, 0), floor(CNt / 2)) END"
FIT = f"t AS (SELECT *, {CNT.format(c=C, k=K)} AS CNt FROM seg), fit AS (SELECT *, CASE WHEN baf IS NULL AND NOT (g = 0 OR bg = 0) THEN NULL ELSE {BT.format(c=C)} END AS Bt FROM t)"


def fit(spark: SparkSession, sf: str) -> DataFrame:
    t = seg(spark, sf).withColumn("CNt", cn.clonal_cnt(col("depth"), C, K, col("g")))
    return t.withColumn("Bt", cn.clonal_bt(col("baf"), col("CNt"), C, col("g"), col("bg")))


@add(f"WITH {SEG}, {FIT} SELECT id, CNt, Bt FROM fit")
def r365_clonal_copy_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 365, 366, 375 and 411."""
    return fit(spark, sf).select("id", "CNt", "Bt")


@add(f"""WITH {SEG}, {FIT} SELECT id, round({K} * (g * {1 - C} + CNt * {C}), 6) AS depth, round(CASE WHEN CNt * {C} + g * {1 - C} = 0 THEN NULL ELSE (Bt * {C} + bg * {1 - C}) / (CNt * {C} + g * {1 - C}) END, 6) AS baf,
  round(CASE WHEN CNt * {C} + g * {1 - C} = 0 THEN NULL ELSE {C} / (CNt * {C} + g * {1 - C}) END, 6) AS one_baf, round({K * C}::DOUBLE, 6) AS one_depth FROM fit""")
def r369_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 369 to 372."""
    g, t = col("g"), col("CNt")
    return fit(spark, sf).select("id", F.round(cn.predicted_depth(t, K, C, g), 6).alias("depth"), F.round(cn.predicted_baf(t, col("Bt"), C, g, col("bg")), 6).alias("baf"), F.round(cn.onecopy_baf(t, C, g), 6).alias("one_baf"), F.round(cn.onecopy_depth(K, C), 6).alias("one_depth"))


@add(f"""WITH {SEG}, {FIT} SELECT DISTINCT CNt, array_to_string([CAST(CAST(round((b * {C} + {1 - C}) / (CNt * {C} + 2 * {1 - C}) * 10000) AS BIGINT) AS VARCHAR) for b in list_reverse(range(0, CAST(floor(CNt / 2) AS BIGINT) + 1))], ',') AS bafs FROM fit""")
def r373_possible_fractions(spark: SparkSession, sf: str) -> DataFrame:
    t = fit(spark, sf).select("CNt").distinct()
    return t.select("CNt", F.array_join(F.transform(cn.possible_bafs(col("CNt"), C), lambda x: F.round(x * 10000).cast("long").cast("string")), ",").alias("bafs"))


_KC = """WITH p AS (SELECT o_orderkey AS id, 10 + o_orderkey % 17 AS d1, o_orderkey % 4 AS t1, 10 + o_orderkey % 17 + o_custkey % 9 AS d2, o_orderkey % 4 + 1 AS t2 FROM orders),
r AS (SELECT *, CASE WHEN d2 * (t1 - 2) - d1 * (t2 - 2) = 0 THEN NULL ELSE (d1 * 2 - d2 * 2) / (d2 * (t1 - 2) - d1 * (t2 - 2)) END AS raw FROM p), s AS (SELECT *, CASE WHEN raw > 0 AND raw <= 1 THEN raw END AS c FROM r)
SELECT id, round(CASE WHEN d1 / (2 + c * (t1 - 2)) > 0 THEN d1 / (2 + c * (t1 - 2)) END, 6) AS k, round(c, 6) AS c FROM s"""


@add(_KC)
def r367_solve(spark: SparkSession, sf: str) -> DataFrame:
    """Depth of a copy and cellularity from two depths (rows 367, 368 and 374)."""
    o, d = col("o_orderkey"), 10 + col("o_orderkey") % 17
    x = cn.solve_kc_delta(d.cast("double"), (o % 4).cast("double"), 2, (col("o_custkey") % 9).cast("double"))
    return table(spark, sf, "orders").select(o.alias("id"), x.alias("x")).select("id", F.round("x.k", 6).alias("k"), F.round("x.c", 6).alias("c"))


@add(f"""WITH {SEG}, {FIT}, r AS (SELECT *, depth / 15 AS ratio FROM fit WHERE g > 0) SELECT id, round({C} * 2 / ({C} * CNt + {1 - C} * g), 6) AS vaf, round(0.3 * (CNt + (1 / {C} - 1) * g), 6) AS ccf,
  round(({C} * CNt + g * {1 - C}) / ({C} * {P} + 2 * {1 - C}) / (g / 2), 6) AS ratio, round(CNt, 6) AS back, round((({C} * (Bt - bg) + bg) / ({C} * (CNt - g) + g)), 6) + 0 AS baf, round(Bt, 6) AS b_back FROM r""")
def r386_models(spark: SparkSession, sf: str) -> DataFrame:
    """Model and inverse (rows 376, 377 and 386 to 389)."""
    g, t = col("g"), col("CNt")
    s = fit(spark, sf).where(g > 0)
    ratio, frac = cn.depth_ratio(t, C, P, g, 2), cn.baf(t, col("Bt"), C, g, col("bg"))
    return s.select("id", F.round(cn.vaf_of_copies(C, 2, t, g), 6).alias("vaf"), F.round(cn.ccf_of_vaf(0.3, C, t, g), 6).alias("ccf"), F.round(ratio, 6).alias("ratio"), (F.round(cn.cnt_of_depth_ratio(ratio, C, P, g, 2), 6) + 0.0).alias("back"), (F.round(frac, 6) + 0.0).alias("baf"), (F.round(cn.b_of_baf(frac, C, t, g, col("bg")), 6) + 0.0).alias("b_back"))


@add(f"""WITH {SEG} SELECT id, round(({C} * (3 * (1 - x) + 1 * x) + 2 * {1 - C}) / ({C} * {P} + 2 * {1 - C}), 6) AS ratio, round(({C} * (1 * (1 - x) + 0 * x - 1) + 1) / ({C} * (3 * (1 - x) + 1 * x - 2) + 2), 6) AS baf, round(x, 6) AS ccf_depth, round(x, 6) AS ccf_baf FROM (SELECT *, (id % 100) / 100 AS x FROM seg)""")
def r390_subclones(spark: SparkSession, sf: str) -> DataFrame:
    """Mixtures of 3 and 1 copies and their inverse (rows 390 to 393)."""
    s = seg(spark, sf).withColumn("x", (col("id") % 100) / 100)
    ratio, frac = cn.depth_ratio_subclone(3, 1, col("x"), C, P, 2, 2), cn.baf_subclone(3, 1, 1, 0, col("x"), C, 2, 1)
    return s.select("id", F.round(ratio, 6).alias("ratio"), F.round(frac, 6).alias("baf"), F.round(cn.ccf_of_depth_ratio(ratio, C, P, 2, 3, 1, 2), 6).alias("ccf_depth"), F.round(cn.ccf_of_baf(frac, C, 3, 1, 1, 0, 2, 1), 6).alias("ccf_baf"))


@add(f"""WITH {SEG}, r AS (SELECT id, baf, greatest(round_even(((depth / 15) * (2 / 2) * ({C} * {P} + 2 * {1 - C}) - 2 * {1 - C}) / {C}, 0) + 0, 0) AS CNt FROM seg)
SELECT id, CNt, least(greatest(round_even(baf * CNt + (1 / {C} - 1) * (baf * 2 - 1), 0) + 0, 0), floor(CNt / 2)) AS B FROM r WHERE baf IS NOT NULL""")
def r400_clonal_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 394, 395, 400 and 408."""
    s = seg(spark, sf).where(col("baf").isNotNull())
    return s.select("id", cn.clonal_fit(col("depth") / 15, col("baf"), C, P, 2, 2).alias("x")).select("id", "x.CNt", "x.B")


@add("""SELECT p_partkey, array_to_string([CASE WHEN lo - i >= 0 THEN CAST(lo - i AS VARCHAR) ELSE '-' END for i in range(n)], ',') AS lower, array_to_string([CAST(up + i AS VARCHAR) for i in range(n)], ',') AS upper
  FROM (SELECT p_partkey, CAST(floor(x) AS BIGINT) AS lo, CAST(CASE WHEN floor(x) = ceil(x) THEN x + 1 ELSE ceil(x) END AS BIGINT) AS up, CAST(greatest(5, round_even(x * 0.5, 0)) AS BIGINT) AS n FROM (SELECT p_partkey, p_size / 4 AS x FROM part))""")
def r384_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Row 384."""
    x = cn.candidate_copies(col("p_size") / 4)
    text = lambda a: F.array_join(F.transform(a, lambda v: F.coalesce(v.cast("string"), F.lit("-"))), ",")
    return table(spark, sf, "part").select("p_partkey", text(x["lower"]).alias("lower"), text(x["upper"]).alias("upper"))


def _grid_sql() -> str:
    t = CNT.format(c="c", k="K")
    return f"""WITH {SEG}, lim AS (SELECT min(depth) AS lo, max(depth) AS hi FROM seg), raw AS (SELECT t, d, lo, lo + (hi - lo) / d AS d2 FROM lim, (SELECT unnest(range(5)) AS t), (SELECT unnest(range(1, 9)) AS d)),
cells AS (SELECT t, d, lo, CASE WHEN d2 * (t - 2) - lo * (t + 1 - 2) = 0 THEN NULL ELSE (lo * 2 - d2 * 2) / (d2 * (t - 2) - lo * (t + 1 - 2)) END AS c FROM raw),
grid AS (SELECT t, d, lo / (2 + c * (t - 2)) AS K, c FROM cells WHERE c > 0 AND c <= 1 AND (2 + c * (t - 2)) / lo > 0),
x AS (SELECT t AS CNt0, d AS divisions, K, c, depth, baf, n, g, bg, {t} AS CNt FROM seg, grid), y AS (SELECT *, CASE WHEN baf IS NULL AND NOT (g = 0 OR bg = 0) THEN NULL ELSE {BT.format(c='c')} END AS Bt FROM x),
z AS (SELECT *, abs(depth - K * (g * (1 - c) + CNt * c)) / (K * c) + coalesce(CASE WHEN CNt * c + g * (1 - c) = 0 THEN NULL ELSE abs(baf - (Bt * c + bg * (1 - c)) / (CNt * c + g * (1 - c))) / (c / (CNt * c + g * (1 - c))) END, 0) AS cost FROM y)
SELECT CAST(CNt0 AS INTEGER) AS CNt0, CAST(divisions AS INTEGER) AS divisions, round(K, 6) AS K, round(c, 6) AS cellularity, round(sum(cost * n) / sum(n), 5) AS target FROM z GROUP BY CNt0, divisions, K, c"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    s = seg(spark, sf)
    lo, hi = s.agg(F.min("depth"), F.max("depth")).first()
    cells = copynumber.grid(lo, hi) if lo is not None else []
    return copynumber.grid_search(s, "depth", "baf", "n", "g", "bg", cells)


@add(_grid_sql())
def r379_grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 379, 381 to 383 and 396."""
    return _scores(spark, sf).select("CNt0", "divisions", F.round("K", 6).alias("K"), F.round("cellularity", 6).alias("cellularity"), F.round("target", 5).alias("target"))


@add(f"""WITH s AS ({_grid_sql()}) SELECT CNt0, divisions, target FROM (SELECT *, lag(target) OVER a AS a1, lead(target) OVER a AS a2, lag(target) OVER b AS b1, lead(target) OVER b AS b2 FROM s WINDOW a AS (PARTITION BY CNt0 ORDER BY divisions), b AS (PARTITION BY divisions ORDER BY CNt0))
WHERE target <= coalesce(a1, target) AND target <= coalesce(a2, target) AND target <= coalesce(b1, target) AND target <= coalesce(b2, target)""")
def r399_grid_minima(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that are best along both axes (row 399)."""
    t = _scores(spark, sf).withColumn("target", F.round("target", 5))
    return copynumber.grid_minima(t, "CNt0", "divisions", "target").select("CNt0", "divisions", "target")


_LOG_PMF = "lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + CASE WHEN k > 0 THEN k * ln({p}) ELSE 0 END + CASE WHEN n > k THEN (n - k) * ln(1 - {p}) ELSE 0 END"
_LOG_PMF_I = "lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + CASE WHEN i > 0 THEN i * ln({p}) ELSE 0 END + CASE WHEN n > i THEN (n - i) * ln(1 - {p}) ELSE 0 END"


@add(f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, 10 + CAST(l_quantity AS BIGINT) AS n, CAST(l_quantity AS BIGINT) // (1 + l_linenumber % 4) AS k, 2.0::DOUBLE AS g, (1 + l_suppkey % 5)::DOUBLE AS t, floor((1 + l_suppkey % 5) / 2) AS b FROM lineitem),
w AS (SELECT *, list_sum([exp({_LOG_PMF_I.format(p=f'({C} / ({C} * t + {1 - C} * g))')}) for i in range(0, k + 1)]) AS cdf,
  [CAST(m AS DOUBLE) for m in list_reverse(range(1, CAST(t - b AS BIGINT) + 1))] AS ms FROM v),
x AS (SELECT *, [{_LOG_PMF.format(p=f'({C} * m / ({C} * t + {1 - C} * g))')} for m in ms] AS ls FROM w)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN cdf < 0.05 THEN 1.0::DOUBLE ELSE ms[list_position(ls, list_max(ls))] END AS CNm, round(CASE WHEN cdf < 0.05 THEN k / n * (t + (1 / {C} - 1) * g) ELSE 1 END, 6) AS ccf FROM x""")
def r378_cancer_cell_fraction(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 124 and 378."""
    q, s = col("l_quantity").cast("long"), col("l_suppkey") % 5 + 1
    n, k = q + 10, F.floor(q / (col("l_linenumber") % 4 + 1))
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (k / n).alias("vaf"), n.alias("total_depth"), k.alias("alt_depth"), F.lit(2.0).alias("CNg"), s.cast("double").alias("CNt"), F.floor(s / 2).cast("double").alias("Bt"))
    out = copynumber.cell_fractions(t, C)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "CNm", F.round("ccf", 6).alias("ccf"))


@add(f"WITH {SEG}, {FIT} SELECT round(sum(CNt * n) / sum(n), 6) AS ploidy, round(sum(abs({K} * (g * {1 - C} + CNt * {C}) - depth) * n), 2) AS misfit FROM fit")
def r385_average_ploidy(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 147, 148 and 385."""
    n = col("n")
    return fit(spark, sf).agg(F.round(F.sum(col("CNt") * n) / F.sum(n), 6).alias("ploidy"), F.round(F.sum(F.abs(cn.predicted_depth(col("CNt"), K, C, col("g")) - col("depth")) * n), 2).alias("misfit"))


# ---- depth ----


@add(sql("d", """SELECT Chromosome, "Start", "End", coalesce(depth IS NULL OR Chromosome = 'chrY' OR depth < 1 OR depth > 500 OR i <= floor(n * 0.05) OR i > n - floor(n * 0.1), true) AS excluded
  FROM (SELECT *, count(depth) OVER (PARTITION BY Chromosome) AS n, row_number() OVER (PARTITION BY Chromosome ORDER BY depth NULLS LAST, "Start", "End") AS i FROM d)""").replace('ORDER BY depth NULLS LAST, "Start", "End"', 'ORDER BY depth NULLS LAST, "Start"'))
def r086_outliers(spark: SparkSession, sf: str) -> DataFrame:
    """Row 86."""
    t = intervals.bins(spark, sf)
    return copynumber.outliers(t, "depth", (0.05, 0.1), 1, 500, drop_y=True).select(*frames.COORDS, "excluded")


_GC = """gc AS (SELECT d.*, 0.3 + (("Start" // 500) % 300) / 1000 AS gc FROM d WHERE depth IS NOT NULL), agg AS (SELECT CAST(ceil(gc * 50) AS INTEGER) AS bin, sum(depth * ("End" - "Start")) / sum("End" - "Start") AS a FROM gc GROUP BY ALL),
every AS (SELECT CAST(unnest(range(1, 51)) AS INTEGER) AS bin)"""


@add(sql("d", """SELECT bin, round(a, 6) AS average, round(a / (SELECT avg(a) FROM agg), 6) AS normalized FROM every LEFT JOIN agg USING (bin)""", _GC))
def r143_gc_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 143 and 144; the GC content is made from the place here."""
    t = intervals.bins(spark, sf).withColumn("gc", F.lit(0.3) + (F.floor(col("Start") / 500) % 300) / 1000)
    return copynumber.gc_bins(t, "gc", "depth", 50, frames.length()).select("bin", F.round("average", 6).alias("average"), F.round("normalized", 6).alias("normalized"))


@add("""SELECT Chromosome, "Start", "End", round(avg(depth), 5) AS corrector, count(DISTINCT "sample") AS n_samples FROM (SELECT "sample", Chromosome, "Start", "End", max(depth) AS depth FROM depth_rawdata WHERE depth IS NOT NULL AND NOT isnan(depth) AND "sample" IS NOT NULL GROUP BY ALL) GROUP BY Chromosome, "Start", "End" """)
def r149_depth_corrector(spark: SparkSession, sf: str) -> DataFrame:
    """Row 149."""
    t = table(spark, sf, "depth_rawdata").where(col("depth").isNotNull() & ~F.isnan("depth") & col("sample").isNotNull()).groupBy("sample", *frames.COORDS).agg(F.max("depth").alias("depth"))
    return copynumber.depth_corrector(t, "sample", "depth").select(*frames.COORDS, F.round("corrector", 5).alias("corrector"), "n_samples")


_MALE = """c2 AS (SELECT Chromosome, CAST(0 AS BIGINT) AS "Start", length AS "End", CASE WHEN Chromosome IN ('chrX', 'chrY') THEN 1.0 ELSE 2.0 END::DOUBLE AS CNg, CASE WHEN Chromosome IN ('chrX', 'chrY') THEN 0.0 ELSE 1.0 END::DOUBLE AS Bg FROM c WHERE regexp_matches(Chromosome, '(?i)^(chr)?(0*[1-9][0-9]*|[XY])$')),
male AS (SELECT * FROM c2 WHERE Chromosome NOT IN ('chrX', 'chrY') UNION ALL SELECT Chromosome, 0, 60000, CNg, Bg FROM c2 WHERE Chromosome IN ('chrX', 'chrY') UNION ALL SELECT Chromosome, 2700000, "End", CNg, Bg FROM c2 WHERE Chromosome IN ('chrX', 'chrY') UNION ALL SELECT 'chrX', 60000, 2700000, 2.0, 1.0 UNION ALL SELECT 'chrY', 60000, 2700000, 0.0, 0.0)"""


def _male(spark: SparkSession, sf: str) -> DataFrame:
    par = spark.createDataFrame([("chrX", 60_000, 2_700_000), ("chrY", 60_000, 2_700_000)], "Chromosome string, Start bigint, End bigint")
    return copynumber.default_germline(intervals.contigs(spark, sf), False, par)


@add(sql("c", """SELECT false AS female, * FROM male UNION ALL SELECT true, Chromosome, "Start", "End", CASE WHEN Chromosome = 'chrY' THEN 0 ELSE 2 END::DOUBLE, CASE WHEN Chromosome = 'chrY' THEN 0 ELSE 1 END::DOUBLE FROM c2""", _MALE))
def r364_default_germline(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 275, 364 and 405."""
    female = copynumber.default_germline(intervals.contigs(spark, sf), True)
    return _male(spark, sf).select(F.lit(False).alias("female"), "*").unionByName(female.select(F.lit(True).alias("female"), "*"))


@add(sql("d c", """SELECT x.Chromosome, x."Start", x."End", arg_max(y.CNg, (y."End" - y."Start", -y."Start")) AS CNg, arg_max(y.Bg, (y."End" - y."Start", -y."Start")) AS Bg FROM d AS x LEFT JOIN male AS y ON x.Chromosome = y.Chromosome AND x."Start" < y."End" AND y."Start" < x."End" GROUP BY ALL""", _MALE))
def r123_germline_of_bins(spark: SparkSession, sf: str) -> DataFrame:
    t = overlap_join.overlap_join(intervals.bins(spark, sf).select(*frames.COORDS), _male(spark, sf), ["CNg", "Bg"], ["longest"], n_name=None)
    return t.withColumnsRenamed({"CNg_longest": "CNg", "Bg_longest": "Bg"})


@add(sql("d c", """SELECT round(sum(depth * 2 / CNg * ("End" - "Start")) / sum("End" - "Start") / 2, 6) AS onecopy FROM (SELECT x.Chromosome, x."Start", x."End", any_value(depth) AS depth, arg_max(y.CNg, (y."End" - y."Start", -y."Start")) AS CNg FROM d AS x JOIN male AS y ON x.Chromosome = y.Chromosome AND x."Start" < y."End" AND y."Start" < x."End" GROUP BY ALL) WHERE CNg > 0 AND depth IS NOT NULL""", _MALE))
def r356_onecopy_depth(spark: SparkSession, sf: str) -> DataFrame:
    t = overlap_join.overlap_join(intervals.bins(spark, sf), _male(spark, sf), ["CNg"], ["longest"], n_name=None)
    return t.agg(F.round(copynumber.onecopy_depth_of(t, "depth", "CNg_longest", 2), 6).alias("onecopy"))


@add()
def r350_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of the depth of all bins (rows 350 and 352); deterministic, without SQL: see its tests."""
    return copynumber.segment(intervals.bins(spark, sf), "depth")


@add()
def r142_fraction_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Peaks of the minor allele fractions per sample (rows 142, 267, 359 and 360); without SQL: see its tests."""
    t = table(spark, sf, "readstats").select("sample", F.try_element_at("rppcounts", F.lit(0)).cast("double").alias("r"), F.try_element_at("rppcounts", F.lit(1)).cast("double").alias("a"))
    x = F.try_divide(col("a"), col("r") + col("a"))
    return copynumber.fraction_peaks(t.withColumn("baf", F.least(x, 1 - x)), ["sample"], "baf")


@add(f"""WITH {SEG} SELECT id, baf, CASE WHEN baf > 0.41 THEN 0.5 ELSE baf END::DOUBLE AS corrected, coalesce(baf > 0.4, false) AS selected FROM seg""")
def r358_corrected_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 75 and 358."""
    return seg(spark, sf).select("id", "baf", F.when(col("baf") > 0.41, 0.5).otherwise(col("baf")).alias("corrected"), frames.in_range(col("baf"), 0.4, None).alias("selected"))


@add(sql("r c", """SELECT g.sv AS sv_id, round(sum(s.state * (s."End" - s."Start")) / sum(s."End" - s."Start"), 6) AS cn, sum(s.state * (s."End" - s."Start")) / sum(s."End" - s."Start") >= 5 AND sum(s.state * (s."End" - s."Start")) / sum(s."End" - s."Start") >= 1.5 * 3 AS amplified,
  sum(s.state * (s."End" - s."Start")) / sum(s."End" - s."Start") <= 0.2 AS deleted FROM (SELECT region_id AS sv, Chromosome, "Start", "End" FROM r) AS g JOIN (SELECT chr_name AS Chromosome, unnest(range(0, length, 50000)) AS "Start", "Start" + 50000 AS "End", ("Start" // 50000) % 7 AS state FROM chromdict) AS s
  ON g.Chromosome = s.Chromosome AND g."Start" < s."End" AND s."Start" < g."End" GROUP BY g.sv, g.Chromosome, g."Start", g."End" """))
def r125_amplified_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions with the mean copies of their segments, and whether they are amplified or deleted."""
    c = intervals.contigs(spark, sf)
    s = c.select("Chromosome", F.explode(F.sequence(F.lit(0).cast("long"), col("length") - 1, F.lit(50_000).cast("long"))).alias("Start"))
    s = s.select("Chromosome", "Start", (col("Start") + 50_000).alias("End"), (F.floor(col("Start") / 50_000) % 7).alias("state"))
    r = intervals.regions(spark, sf).drop("sample")
    joined = overlap_join.overlap_join(r.select(*frames.COORDS).distinct(), s, "state", ["weighted_mean"], "inner", n_name=None)
    m = col("state_weighted_mean")
    return r.join(joined, list(frames.COORDS)).select(col("region_id").alias("sv_id"), F.round(m, 6).alias("cn"), ((m >= 5) & (m >= 1.5 * 3)).alias("amplified"), (m <= 0.2).alias("deleted"))


queries, oracle_sql = BOOK.queries, BOOK.oracle_sql
