
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import algebra, frames, islands, ordered, overlap_join
from spanforge.plans.book import Book
from spanforge.runtime import table

BOOK = Book()
add = BOOK.add

# ---- frames that the queries run over, in Spark and in SQL ----


def _coords(spark: SparkSession, sf: str, name: str, chrom: str, start: str, end: str, value: str) -> DataFrame:
    t = table(spark, sf, name).select(F.expr(chrom).alias("Chromosome"), F.expr(start).alias("Start"), F.expr(value).alias("value"), "*").withColumn("End", F.expr(end))
    return t.groupBy("Chromosome", "Start", "End").agg(F.avg("value").alias("value"))


def iv_a(spark: SparkSession, sf: str) -> DataFrame:
    return _coords(spark, sf, "lineitem", "concat('chr', l_suppkey % 5 + 1)", "l_partkey * 100 + l_linenumber * 10", "Start + cast(l_quantity as bigint) + 1", "l_extendedprice")


def iv_b(spark: SparkSession, sf: str) -> DataFrame:
    return _coords(spark, sf, "orders", "concat('chr', o_custkey % 5 + 1)", "(o_orderkey % 2000) * 100", "Start + 50 + o_orderkey % 100", "o_totalprice")


def contigs(spark: SparkSession, sf: str) -> DataFrame:
    return frames.contig_table(table(spark, sf, "chromdict"), "chr_name")


def _named(t: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    """Contigs in one spelling; rows that are no intervals go."""
    names = table(spark, sf, "chromdict").select(F.col("chr_name").alias("_to"), F.explode(F.array_distinct(F.array("chrom", "chr_name"))).alias("_from"))
    t = t.join(F.broadcast(names), t["Chromosome"] == names["_from"]).withColumn("Chromosome", F.col("_to")).drop("_to", "_from")
    return t.where(F.col("End") > F.col("Start"))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    return _named(table(spark, sf, "region_gdf").select("region_id", "sample", "Chromosome", "Start", "End"), spark, sf).distinct()


def breaks(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "rearrangements").select("sv_id", F.col("chrom1").alias("Chromosome"), F.col("start1").alias("Start"), F.col("end1").alias("End"))
    return _named(t, spark, sf).distinct()


def bins(spark: SparkSession, sf: str) -> DataFrame:
    """Depth bins over all runs: greatest valid depth and quality of each."""
    t = _named(table(spark, sf, "depth_rawdata").select("Chromosome", "Start", "End", F.nanvl("depth", F.lit(None)).alias("depth"), "MQ"), spark, sf)
    return t.groupBy("Chromosome", "Start", "End").agg(F.max("depth").alias("depth"), F.max("MQ").alias("MQ"))


_SQL = {
    "a": """a AS (SELECT 'chr' || (l_suppkey % 5 + 1) AS Chromosome, l_partkey * 100 + l_linenumber * 10 AS "Start",
      l_partkey * 100 + l_linenumber * 10 + CAST(l_quantity AS BIGINT) + 1 AS "End", avg(l_extendedprice) AS value FROM lineitem GROUP BY ALL)""",
    "b": """b AS (SELECT 'chr' || (o_custkey % 5 + 1) AS Chromosome, (o_orderkey % 2000) * 100 AS "Start",
      (o_orderkey % 2000) * 100 + 50 + o_orderkey % 100 AS "End", avg(o_totalprice) AS value FROM orders GROUP BY ALL)""",
    "c": "c AS (SELECT chr_name AS Chromosome, length, idx, cum_start FROM chromdict)",
    "names": "names AS (SELECT chr_name AS t, chrom AS f FROM chromdict UNION SELECT chr_name, chr_name FROM chromdict)",
    "r": """r AS (SELECT DISTINCT region_id, "sample", t AS Chromosome, "Start", "End" FROM region_gdf JOIN names ON Chromosome = f WHERE "End" > "Start")""",
    "k": """k AS (SELECT DISTINCT sv_id, t AS Chromosome, start1 AS "Start", end1 AS "End" FROM rearrangements JOIN names ON chrom1 = f WHERE end1 > start1)""",
    "d": """d AS (SELECT t AS Chromosome, "Start", "End", max(CASE WHEN isnan(depth) THEN NULL ELSE depth END) AS depth, max(MQ) AS MQ
      FROM depth_rawdata JOIN names ON Chromosome = f WHERE "End" > "Start" GROUP BY ALL)""",
}


def union_sql(source: str, out: str, keys: str = "Chromosome") -> str:
    """CTEs that end in ``out`` (keys, Start, End): the merged rows of ``source``."""
    return f"""{out}1 AS (SELECT {keys}, "Start", "End", max("End") OVER (PARTITION BY {keys} ORDER BY "Start", "End" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT DISTINCT {keys}, "Start", "End" FROM {source})),
{out}2 AS (SELECT *, sum(CASE WHEN top IS NULL OR "Start" > top THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY "Start", "End" ROWS UNBOUNDED PRECEDING) AS island FROM {out}1),
{out} AS (SELECT {keys}, min("Start") AS "Start", max("End") AS "End" FROM {out}2 GROUP BY {keys}, island)"""


def sql(ctes: str, body: str, *more: str) -> str:
    """A statement with the named frames (``ctes``, blank separated) and further CTEs."""
    names = ctes.split()
    if set(names) & {"r", "k", "d"}:
        names = ["names", *names]
    return "WITH " + ",\n".join([*[_SQL[n] for n in names], *more]) + "\n" + body


_ON = 'x.Chromosome = y.Chromosome AND x."Start" < y."End" AND y."Start" < x."End"'

# ---- 2.1, 2.3, 2.4: frames ----


@add(sql("", """SELECT o_orderkey, 'chr' || (o_custkey % 24) AS Chromosome, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END AS "Start",
  CASE WHEN o_orderkey % 5 = 0 THEN length ELSE o_orderkey + 7 END AS "End" FROM orders LEFT JOIN chromdict ON chr_name = 'chr' || (o_custkey % 24)""".replace("WITH ", "")).replace("WITH \n", ""))
def r004_from_data(spark: SparkSession, sf: str) -> DataFrame:
    """Missing starts and ends are those of the contig."""
    k = F.col("o_orderkey")
    t = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("chr"), (F.col("o_custkey") % 24).cast("string")).alias("Chromosome"), F.when(k % 3 != 0, k).alias("Start"), F.when(k % 5 != 0, k + 7).alias("End"))
    return frames.from_data(t, contigs(spark, sf))


@add(sql("c", """SELECT Chromosome, CAST(0 AS BIGINT) AS "Start", length AS "End" FROM c WHERE regexp_matches(Chromosome, '(?i)^(chr)?(0*[1-9][0-9]*|[XY])$')"""))
def r006_all_regions(spark: SparkSession, sf: str) -> DataFrame:
    return frames.all_regions(contigs(spark, sf))


@add(sql("c", """SELECT Chromosome, CAST(CASE WHEN idx = 2 THEN 1000 ELSE 0 END AS BIGINT) AS "Start", CAST(CASE WHEN idx = 6 THEN 500 ELSE length END AS BIGINT) AS "End" FROM c WHERE idx BETWEEN 2 AND 6"""))
def r007_from_margins(spark: SparkSession, sf: str) -> DataFrame:
    c = contigs(spark, sf)
    ends = {r["idx"]: r["Chromosome"] for r in c.where(F.col("idx").isin(2, 6)).collect()}
    return frames.from_margins(c, ends[2], 1000, ends[6], 500)


@add(sql("a", """SELECT Chromosome, "Start", "End", round(value * 2, 4) AS x_twice_y FROM a"""))
def r053_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Choosing, assigning, renaming, affixing and dropping annotations (rows 50 to 57)."""
    t = iv_a(spark, sf).withColumn("twice", F.round(F.col("value") * 2, 4))
    t = frames.drop_annots(t, ["value", "Start", "unknown"])
    t = frames.add_affix(frames.rename(t, {"twice": "TWICE"}), "x_", "_y")
    return frames.choose_annots(t, ["x_TWICE_y"]).withColumnRenamed("x_TWICE_y", "x_twice_y")


@add(sql("a c", """SELECT Chromosome, "Start", "End", CAST(floor(("Start" + "End" - 1) / 2) AS BIGINT) AS midpoint, "End" - "Start" AS n, length AS contig_length, idx AS contig_idx FROM a LEFT JOIN c USING (Chromosome)"""))
def r058_midpoints_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Midpoints, lengths, contig lengths and coordinate arrays (rows 58 to 61)."""
    return frames.with_contig(iv_a(spark, sf), contigs(spark, sf)).select(*frames.COORDS, frames.midpoint().alias("midpoint"), frames.length().alias("n"), "contig_length", "contig_idx")


@add(sql("a", """SELECT * REPLACE (round(value, 4) AS value) FROM a WHERE Chromosome = 'chr3' AND "Start" < 90000 AND "End" > 20000"""))
def r066_subset(spark: SparkSession, sf: str) -> DataFrame:
    return iv_a(spark, sf).where(frames.overlaps("chr3", 20000, 90000)).withColumn("value", F.round("value", 4))


@add(sql("a", """SELECT Chromosome, "Start", "End" FROM a WHERE Chromosome IN ('chr1', 'chr4') AND Chromosome NOT IN ('chr4')"""))
def r068_subset_chroms(spark: SparkSession, sf: str) -> DataFrame:
    """Keeping and dropping contigs (rows 68 and 69)."""
    return frames.subset_chroms(frames.subset_chroms(iv_a(spark, sf), ["chr1", "chr4"]), ["chr4"], drop=True).drop("value")


@add(sql("r d", f"""SELECT x.Chromosome, x."Start", x."End" FROM d AS x JOIN r AS y ON {_ON}"""))
def r070_subset_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Bins once per region that they overlap."""
    return overlap_join.subset_regions(bins(spark, sf).select(*frames.COORDS), regions(spark, sf))


@add(sql("r d", f"""SELECT x.Chromosome, x."Start", x."End", EXISTS (SELECT 1 FROM r AS y WHERE {_ON}) AS overlaps FROM d AS x"""))
def r071_overlap_selector(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_join.overlap_flag(bins(spark, sf).select(*frames.COORDS), regions(spark, sf))


@add("""SELECT run_id, Chromosome, "Start", coalesce(depth > 0 AND depth < 100 AND NOT isnan(depth), false) AS exclusive,
  coalesce(depth >= 0 AND depth <= 100 AND NOT isnan(depth), false) AS inclusive, coalesce(MQ > 50 AND NOT isnan(MQ), false) AND coalesce(depth > 0 AND NOT isnan(depth), false) AS depth_selected FROM depth_rawdata""")
def r072_range_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Range predicates and the depth selection flag (rows 72 to 74)."""
    d, q = F.col("depth"), F.col("MQ")
    return table(spark, sf, "depth_rawdata").select("run_id", "Chromosome", "Start", frames.in_range(d, 0, 100).alias("exclusive"), frames.in_range(d, 0, 100, True).alias("inclusive"), (frames.in_range(q, 50, None) & frames.in_range(d, 0, None)).alias("depth_selected"))


@add("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN Chromosome IS NULL OR "Start" IS NULL OR "End" IS NULL THEN 'null' WHEN "Start" < 0 THEN 'negative start'
  WHEN "End" <= "Start" THEN 'end not after start' END AS reason FROM region_gdf) WHERE reason IS NOT NULL GROUP BY reason""")
def r003_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that a frame would refuse, by reason."""
    return frames.violations(table(spark, sf, "region_gdf").select(*frames.COORDS)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@add(sql("r d", f"""SELECT x.Chromosome, x."Start", x."End" FROM d AS x WHERE NOT EXISTS (SELECT 1 FROM r AS y WHERE {_ON})"""))
def r087_outside_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that overlap no included region."""
    return overlap_join.overlapping(bins(spark, sf).select(*frames.COORDS), regions(spark, sf), negate=True)


@add("SELECT chrom, chr_name FROM chromdict WHERE regexp_matches(chr_name, '(?i)^(chr)?(0*[1-9][0-9]*|[XY])$')")
def r088_assembled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chromdict").where(frames.is_assembled(F.col("chr_name"))).select("chrom", "chr_name")


# ---- 2.5, 2.6: joins ----

_STAT = {
    "mean": "avg(y.value)", "std": "stddev_pop(y.value)", "var": "var_pop(y.value)", "min": "min(y.value)", "max": "max(y.value)", "median": "median(y.value)",
    "first": 'arg_min(y.value, (y."Start", y."End"))', "last": 'arg_max(y.value, (y."Start", y."End"))',
    "longest": 'arg_max(y.value, (y."End" - y."Start", -y."Start"))', "shortest": 'arg_min(y.value, (y."End" - y."Start", y."Start"))',
    "weighted_mean": 'sum(y.value * (y."End" - y."Start")) / sum(y."End" - y."Start")',
}


def _join_sql(stats: list[str], how: str, extra: str = "") -> str:
    outs = ", ".join(f"round({_STAT[s]} + 1e-7, 3) AS value_{s}" for s in stats)  # half-way values round up on both sides
    return sql("a b", f"""SELECT x.Chromosome, x."Start", x."End", count(y."Start") AS N, {outs}{extra} FROM a AS x {how} JOIN b AS y ON {_ON} GROUP BY ALL""")


def _rounded(t: DataFrame) -> DataFrame:
    return t.select("Chromosome", "Start", "End", "N", *[F.round(F.col(c) + 1e-7, 3).alias(c) for c in t.columns if c.startswith("value_")])


@add(_join_sql(["mean", "std"], "LEFT"))
def overlap_join_mean_std(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 92, 93, 126 and 132: mean and deviation of the order intervals over each lineitem interval."""
    return _rounded(overlap_join.overlap_join(iv_a(spark, sf).drop("value"), iv_b(spark, sf), "value"))


@add(_join_sql(["mean", "max", "min", "first", "last"], "INNER"))
def r092_join_inner(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(overlap_join.overlap_join(iv_a(spark, sf).drop("value"), iv_b(spark, sf), "value", ["mean", "max", "min", "first", "last"], "inner"))


@add(_join_sql(["var", "median"], "LEFT", ", round(CASE WHEN count(y.value) >= 3 THEN CASE WHEN var_pop(y.value) < 1e-14 THEN 0 ELSE skewness(y.value) END END + 1e-7, 3) AS value_skew"))
def r126_join_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(overlap_join.overlap_join(iv_a(spark, sf).drop("value"), iv_b(spark, sf), "value", ["var", "median", "skew"]))


@add(_join_sql(["weighted_mean", "longest", "shortest"], "LEFT"))
def r127_join_by_length(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted mean, longest and shortest (rows 127 to 129)."""
    return _rounded(overlap_join.overlap_join(iv_a(spark, sf).drop("value"), iv_b(spark, sf), "value", ["weighted_mean", "longest", "shortest"]))


@add(sql("a b", f"""SELECT x.Chromosome, x."Start", x."End", count(y."Start") AS N, round(sum(y.value * (least(x."End", y."End") - greatest(x."Start", y."Start"))) / sum(least(x."End", y."End") - greatest(x."Start", y."Start")) + 1e-7, 3) AS value_weighted_mean
  FROM a AS x LEFT JOIN b AS y ON {_ON} GROUP BY ALL"""))
def r128_join_overlap_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(overlap_join.overlap_join(iv_a(spark, sf).drop("value"), iv_b(spark, sf), "value", ["weighted_mean"], weight="overlap"))


@add(sql("a b", f"""SELECT x.Chromosome, x."Start", x."End", count(y."Start") AS N, round(max(y.value) - min(y.value) + 1e-7, 3) AS value_spread FROM a AS x LEFT JOIN b AS y ON {_ON} GROUP BY ALL"""))
def r130_join_custom(spark: SparkSession, sf: str) -> DataFrame:
    """A merge of the caller's own (rows 130, 515)."""
    return _rounded(overlap_join.overlap_join(iv_a(spark, sf).drop("value"), iv_b(spark, sf), "value", {"spread": lambda c: F.max(c) - F.min(c)}))


@add(sql("b d", """SELECT Chromosome, "Start", "End", count(v) AS N, round(avg(CASE WHEN v IS NOT NULL THEN least(greatest(v, lo), hi) END), 3) AS depth_mean
  FROM (SELECT *, max(CASE WHEN i = floor(n * 0.2) + 1 THEN v END) OVER w AS lo, max(CASE WHEN i = n - floor(n * 0.2) THEN v END) OVER w AS hi FROM p WINDOW w AS (PARTITION BY Chromosome, "Start", "End")) GROUP BY ALL""",
  f"""p AS (SELECT x.Chromosome, x."Start", x."End", y.depth AS v, count(y.depth) OVER (PARTITION BY x.Chromosome, x."Start", x."End") AS n, row_number() OVER (PARTITION BY x.Chromosome, x."Start", x."End" ORDER BY y.depth NULLS LAST) AS i
  FROM (SELECT chr_name AS Chromosome, unnest(range(0, length, 10000000)) AS "Start", "Start" + 10000000 AS "End" FROM chromdict) AS x JOIN d AS y ON {_ON} WHERE y.depth IS NOT NULL)"""))
def r131_join_winsorized(spark: SparkSession, sf: str) -> DataFrame:
    """Mean depth of ten megabases after winsorizing a fifth at both ends."""
    wide = contigs(spark, sf).select("Chromosome", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(10_000_000).cast("long"))).alias("Start"))
    wide = wide.withColumn("End", F.col("Start") + 10_000_000)
    t = overlap_join.overlap_join(wide, bins(spark, sf).where(F.col("depth").isNotNull()), "depth", ["mean"], "inner", winsorize=(0.2, 0.2))
    return t.select(*frames.COORDS, "N", F.round("depth_mean", 3).alias("depth_mean"))


_NEAR = """near AS (SELECT x.Chromosome, x."Start", x."End", y."Start" AS s, y."End" AS e, greatest(0, y."Start" - x."End", x."Start" - y."End") AS dist,
  row_number() OVER (PARTITION BY x.Chromosome, x."Start", x."End" ORDER BY greatest(0, y."Start" - x."End", x."Start" - y."End"), CASE WHEN y."Start" < x."End" AND x."Start" < y."End" THEN 0 WHEN y."End" <= x."Start" THEN 1 ELSE 2 END,
    CASE WHEN y."End" <= x."Start" THEN -y."Start" ELSE y."Start" END, y."End") AS i
  FROM (SELECT DISTINCT Chromosome, "Start", "End" FROM k) AS x JOIN (SELECT DISTINCT Chromosome, "Start", "End" FROM r) AS y ON x.Chromosome = y.Chromosome)"""


@add(sql("r k", """SELECT Chromosome, "Start", "End", CASE WHEN dist = 0 AND s < "End" AND "Start" < e THEN NULL ELSE s END AS start_b, dist AS distance FROM near WHERE i = 1""", _NEAR))
def r096_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest region of each breakpoint (rows 96, 100 to 102, PyRanges nearest)."""
    a = breaks(spark, sf).select(*frames.COORDS).distinct()
    t = overlap_join.nearest(a, regions(spark, sf).select(*frames.COORDS).distinct()).where(F.col("Distance").isNotNull())
    inside = (F.col("Start_b") < F.col("End")) & (F.col("Start") < F.col("End_b"))
    return t.select(*frames.COORDS, F.when(~inside, F.col("Start_b")).alias("start_b"), F.col("Distance").alias("distance"))


@add(sql("a b", f"""SELECT x.Chromosome, x."Start", x."End", y."Start" AS start_b, y."End" AS end_b, greatest(0, y."Start" - x."End", x."Start" - y."End") AS distance, greatest(0, least(x."End", y."End") - greatest(x."Start", y."Start")) AS common
  FROM a AS x JOIN b AS y ON {_ON}"""))
def r103_overlap_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with distance and common length (rows 98, 102, 103, raw PyRanges join)."""
    t = overlap_join.overlap_pairs(iv_a(spark, sf).drop("value"), iv_b(spark, sf).drop("value"))
    c = [F.col(x) for x in ("Start", "End", "Start_b", "End_b")]
    return t.select(*frames.COORDS, F.col("Start_b").alias("start_b"), F.col("End_b").alias("end_b"), algebra.distance(*c).alias("distance"), algebra.common_length(*c).alias("common"))


@add(sql("r d", f"""SELECT x.Chromosome, x."Start", x."End" FROM d AS x WHERE EXISTS (SELECT 1 FROM r AS y WHERE {_ON})"""))
def r111_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """Rows with an overlap, each once (rows 111, 112, PyRanges overlap)."""
    return overlap_join.overlapping(bins(spark, sf).select(*frames.COORDS), regions(spark, sf))


@add(sql("r d", f"""SELECT x.Chromosome, x."Start", x."End", count(y."Start") AS n FROM (SELECT DISTINCT Chromosome, "Start", "End" FROM d) AS x LEFT JOIN r AS y ON {_ON} GROUP BY ALL"""))
def r112_count_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return overlap_join.count_overlaps(bins(spark, sf).select(*frames.COORDS), regions(spark, sf), "n")


@add(sql("r", """SELECT "sample", list(region_id ORDER BY region_id) AS ids, count(*) AS n FROM r WHERE Chromosome = 'chr1' AND "Start" < 150000000 AND "End" > 50000000 AND "sample" IS NOT NULL GROUP BY ALL""").replace("list(region_id ORDER BY region_id) AS ids", "array_to_string(list(region_id ORDER BY region_id), ',') AS ids"))
def r115_features_of_region(spark: SparkSession, sf: str) -> DataFrame:
    """Features of a region by entity (rows 115 to 117)."""
    t = regions(spark, sf).where(frames.overlaps("chr1", 50_000_000, 150_000_000) & F.col("sample").isNotNull())
    return t.groupBy("sample").agg(F.array_join(F.transform(F.sort_array(F.collect_list("region_id")), lambda x: x.cast("string")), ",").alias("ids"), F.count(F.lit(1)).alias("n"))


@add(sql("d c", """SELECT d.Chromosome, d."Start", d."End", CASE WHEN d."Start" < length // 3 THEN 'p' ELSE 'q' END AS arm FROM d JOIN c USING (Chromosome)"""))
def r118_arms(spark: SparkSession, sf: str) -> DataFrame:
    """The arm of each bin: the first letter of the first band that it overlaps. Bands are thirds of a contig here."""
    c = contigs(spark, sf)
    third = F.floor(F.col("length") / 3)
    bands = c.select("Chromosome", F.inline(F.array(F.struct(F.lit(0).cast("long").alias("Start"), third.alias("End"), F.lit("p1").alias("band")), F.struct(third.alias("Start"), F.col("length").alias("End"), F.lit("q1").alias("band")))))
    t = overlap_join.overlap_join(bins(spark, sf).select(*frames.COORDS), bands, "band", ["first"], "inner")
    return t.select(*frames.COORDS, F.substring("band_first", 1, 1).alias("arm"))


@add(sql("a b", """SELECT x.Chromosome, x."Start", x."End", round(x.value + 1e-7, 4) AS left_value, round(y.value + 1e-7, 4) AS right_value, round(CASE WHEN y.value = 0 THEN NULL ELSE x.value / y.value END + 1e-7, 4) AS ratio FROM t AS x JOIN n AS y ON x.Chromosome = y.Chromosome AND x."Start" = y."Start" AND x."End" = y."End" """,
  """t AS (SELECT Chromosome, "Start" // 1000 * 1000 AS "Start", "Start" + 1000 AS "End", avg(value) AS value FROM a GROUP BY Chromosome, a."Start" // 1000)""".replace('"Start" + 1000', 'a."Start" // 1000 * 1000 + 1000').replace('SELECT Chromosome, "Start" // 1000', 'SELECT Chromosome, a."Start" // 1000'),
  """n AS (SELECT Chromosome, b."Start" // 1000 * 1000 AS "Start", b."Start" // 1000 * 1000 + 1000 AS "End", avg(value) AS value FROM b GROUP BY Chromosome, b."Start" // 1000)"""))
def r122_ratio_of_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Ratio of two signals on the same coordinates; null where the denominator is 0."""

    def binned(t: DataFrame, name: str) -> DataFrame:
        return t.groupBy("Chromosome", (F.floor(F.col("Start") / 1000) * 1000).alias("Start")).agg(F.avg("value").alias(name))

    t = binned(iv_a(spark, sf), "x").join(binned(iv_b(spark, sf), "y"), ["Chromosome", "Start"])
    return t.select("Chromosome", "Start", (F.col("Start") + 1000).alias("End"), F.round(F.col("x") + 1e-7, 4).alias("left_value"), F.round(F.col("y") + 1e-7, 4).alias("right_value"), F.round(F.try_divide("x", "y") + 1e-7, 4).alias("ratio"))


@add(sql("d", """SELECT round(sum(depth * ("End" - "Start")) / sum("End" - "Start"), 6) AS average FROM d WHERE depth IS NOT NULL"""))
def r133_length_weighted_average(spark: SparkSession, sf: str) -> DataFrame:
    n = frames.length()
    return bins(spark, sf).where(F.col("depth").isNotNull()).agg(F.round(F.sum(F.col("depth") * n) / F.sum(n), 6).alias("average"))


@add(sql("d", """SELECT Chromosome, "Start", "End", round(depth / (SELECT sum(depth * ("End" - "Start")) / sum("End" - "Start") FROM d WHERE depth IS NOT NULL), 6) AS normalized FROM d"""))
def r138_normalized_depth(spark: SparkSession, sf: str) -> DataFrame:
    d = bins(spark, sf)
    n = frames.length()
    mean = d.where(F.col("depth").isNotNull()).agg((F.sum(F.col("depth") * n) / F.sum(n)).alias("m"))
    return d.join(F.broadcast(mean)).select(*frames.COORDS, F.round(F.col("depth") / F.col("m"), 6).alias("normalized"))  # one row


_STEP = "step AS (SELECT Chromosome, \"Start\", \"End\", CAST(floor(coalesce(depth, 0) / 20) AS BIGINT) AS state FROM d)"
_RUNS = """runs AS (SELECT *, sum(CASE WHEN state IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY Chromosome ORDER BY "Start", "End" ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT *, lag(state) OVER (PARTITION BY Chromosome ORDER BY "Start", "End") AS p FROM step))"""


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    return bins(spark, sf).select(*frames.COORDS, F.floor(F.coalesce("depth", F.lit(0)) / 20).alias("state"))


@add(sql("d", """SELECT Chromosome, min("Start") AS "Start", arg_max("End", ("Start", "End")) AS "End", any_value(state) AS state FROM runs GROUP BY Chromosome, run""", _STEP, _RUNS))
def r134_merge_by_annotation(spark: SparkSession, sf: str) -> DataFrame:
    return islands.merge_byannot(_steps(spark, sf), ["state"])


@add(sql("d", """SELECT Chromosome, CAST(run AS BIGINT) AS run, any_value(state) AS state, count(*) AS n FROM runs GROUP BY Chromosome, run""", _STEP, _RUNS))
def r164_run_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return islands.run_groups(_steps(spark, sf), ["state"]).groupBy("Chromosome", "run").agg(F.first("state").alias("state"), F.count(F.lit(1)).alias("n"))


_OLD = """old AS (SELECT Chromosome, s AS "Start", least(s + 100000, length) AS "End", length, (s // 100000) % 7 * 1.5 AS x, (s // 100000) % 11 = 0 AS flag FROM (SELECT *, unnest(range(0, length, 100000)) AS s FROM c))"""


def _old_bins(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("Start")
    t = contigs(spark, sf).select("Chromosome", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(100_000).cast("long"))).alias("Start"))
    i = F.floor(s / 100_000)
    return t.select("Chromosome", "Start", F.least(s + 100_000, F.col("length")).alias("End"), ((i % 7) * 1.5).cast("double").alias("x"), (i % 11 == 0).alias("flag"))


@add(sql("c", """SELECT Chromosome, CAST(j * 250000 AS BIGINT) AS "Start", CAST(least((j + 1) * 250000, length) AS BIGINT) AS "End", round(avg(x), 6) AS x, bool_or(flag) AS flag
  FROM (SELECT o.*, least(ceil(length / 250000) - 1, (SELECT min(n) FROM (SELECT unnest(range(0, 4000)) AS n) WHERE (250000 * (n + 1)) // 100000 > i)) AS j FROM (SELECT *, "Start" // 100000 AS i FROM old) AS o) GROUP BY Chromosome, j, length""", _OLD)
  .replace("(SELECT min(n) FROM (SELECT unnest(range(0, 4000)) AS n) WHERE (250000 * (n + 1)) // 100000 > i)", "CASE WHEN (250000 * (i * 100000 // 250000 + 1)) // 100000 > i THEN i * 100000 // 250000 ELSE i * 100000 // 250000 + 1 END"))
def r135_upsize_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Bins of 100 kb gathered into bins of 250 kb (rows 135 and 136)."""
    t = islands.upsize_bin(_old_bins(spark, sf), contigs(spark, sf), 100_000, 250_000, ["x"], ["flag"])
    return t.withColumn("x", F.round("x", 6))


@add(sql("c", """SELECT CAST(100000 AS BIGINT) AS binsize"""))
def r137_binsize(spark: SparkSession, sf: str) -> DataFrame:
    return islands.binsize(_old_bins(spark, sf), contigs(spark, sf))


# ---- 2.7: windows ----

_FLAT = union_sql("r", "m")


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.merge(regions(spark, sf))


@add(sql("r c", """SELECT m.Chromosome, CAST(coalesce(floor((lag("End") OVER w + "Start") / 2), 0) AS BIGINT) AS "Start", CAST(coalesce(floor(("End" + lead("Start") OVER w) / 2), length) AS BIGINT) AS "End"
  FROM m JOIN c USING (Chromosome) WINDOW w AS (PARTITION BY m.Chromosome ORDER BY "Start")""", _FLAT))
def r165_fill_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.fill_gaps(_flat(spark, sf), contigs(spark, sf))


@add(sql("r", """SELECT Chromosome, count(*) AS n FROM (SELECT *, max("End") OVER (PARTITION BY Chromosome ORDER BY "Start", "End" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r) WHERE "Start" < top GROUP BY Chromosome"""))
def r166_self_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that overlap an earlier one, per contig (rows 166 and 167)."""
    return frames.self_overlapping(regions(spark, sf)).groupBy("Chromosome").agg(F.count(F.lit(1)).alias("n"))


@add(sql("d", """SELECT Chromosome, row_number() OVER (PARTITION BY Chromosome ORDER BY "Start", "End") - 1 AS k, "Start", "End" FROM d"""))
def r168_compact_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    """Dense coordinates and back (rows 168, 169 and 351)."""
    dense, decoder = frames.compact(bins(spark, sf), contigs(spark, sf))
    back = frames.uncompact(dense.withColumn("k", F.col("Start")), decoder)
    return back.select("Chromosome", "k", "Start", "End")


@add(sql("r c", """SELECT m.Chromosome, "Start", "End", CAST(sum("End" - "Start") OVER (ORDER BY idx, "Start") AS BIGINT) AS length_cumsum FROM m JOIN c USING (Chromosome)""", _FLAT))
def r170_cumulative_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return frames.cumulative(_flat(spark, sf), contigs(spark, sf))


@add(sql("r", """SELECT Chromosome, "Start", "End" FROM m1 WHERE top IS NULL OR "Start" > top""", _FLAT))
def r172_first_of_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of every cluster of overlapping rows (rows 171 and 172)."""
    return islands.first_of_clusters(regions(spark, sf).select(*frames.COORDS).distinct())


_SEG = """seg AS (SELECT Chromosome, "Start", "End", ("Start" // 1000) % 90 AS ndata FROM m)"""


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf).withColumn("ndata", F.floor(F.col("Start") / 1000) % 90)


@add(sql("r", """SELECT Chromosome, min("Start") AS "Start", max("End") AS "End" FROM (SELECT *, sum(CASE WHEN low AND p THEN 0 ELSE 1 END) OVER (PARTITION BY Chromosome ORDER BY "Start" ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, ndata < 30 AS low, lag(ndata < 30) OVER (PARTITION BY Chromosome ORDER BY "Start") AS p FROM seg)) GROUP BY Chromosome, g""", _FLAT, _SEG))
def r173_merge_low_data(spark: SparkSession, sf: str) -> DataFrame:
    return islands.merge_low(_segments(spark, sf), "ndata", 30)


_LOW = """low AS (SELECT *, (i % 3 = 0) AS low FROM (SELECT *, row_number() OVER (PARTITION BY Chromosome ORDER BY "Start", "End") - 1 AS i FROM d))"""


@add(sql("d c", """SELECT Chromosome, CAST(CASE WHEN pl AND pp IS NULL THEN 0 WHEN pl THEN floor((ps + pe - 1) / 2) ELSE "Start" END AS BIGINT) AS "Start",
  CAST(CASE WHEN nl AND nn IS NULL THEN length WHEN nl THEN floor((ns + ne - 1) / 2) ELSE "End" END AS BIGINT) AS "End"
  FROM (SELECT low.*, length, lag(low) OVER w AS pl, lag("Start") OVER w AS ps, lag("End") OVER w AS pe, lag("Start", 2) OVER w AS pp, lead(low) OVER w AS nl, lead("Start") OVER w AS ns, lead("End") OVER w AS ne, lead("Start", 2) OVER w AS nn
  FROM low JOIN c USING (Chromosome) WINDOW w AS (PARTITION BY low.Chromosome ORDER BY "Start", "End")) WHERE NOT low""", _LOW))
def r174_incorporate_low_data(spark: SparkSession, sf: str) -> DataFrame:
    """Every third bin of a contig counts as one of little data."""
    t = ordered.running(bins(spark, sf), ["Chromosome"], F.lit(1), "sum", "i").withColumn("n", F.coalesce("i", F.lit(0)) % 3)
    return islands.incorporate_low(t, contigs(spark, sf), "n", 1)


# ---- 2.8: order and splits ----


@add(sql("r c", """SELECT region_id, row_number() OVER (ORDER BY idx, "Start", "End", region_id) - 1 AS position FROM r JOIN c USING (Chromosome)"""))
def r180_sorted_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every row in contig order (rows 179 to 184), found without a task that sees all rows."""
    t = frames.with_contig(regions(spark, sf), contigs(spark, sf))
    return ordered.numbered(t, [F.col("contig_idx"), F.col("Start"), F.col("End"), F.col("region_id")], "position").select("region_id", "position")


@add(sql("d c", """SELECT Chromosome, "Start", "End", ntile(7) OVER (ORDER BY idx, "Start", "End") - 1 AS chunk FROM d JOIN c USING (Chromosome)"""))
def r191_equal_nrow_split(spark: SparkSession, sf: str) -> DataFrame:
    return frames.equal_nrow_split(bins(spark, sf).select(*frames.COORDS), contigs(spark, sf), 7)


@add(sql("d", """SELECT Chromosome, "Start", "End", ntile(3) OVER (PARTITION BY Chromosome ORDER BY "Start", "End") - 1 AS chunk FROM d"""))
def r192_split_within_contigs(spark: SparkSession, sf: str) -> DataFrame:
    """Three near-equal runs of rows per contig (rows 192 and 194)."""
    t = ordered.running(bins(spark, sf).select(*frames.COORDS), ["Chromosome"], F.lit(1), "sum", "_i")
    n = t.groupBy("Chromosome").agg(F.count(F.lit(1)).alias("n"))
    i, q, r = F.coalesce("_i", F.lit(0)), F.floor(F.col("n") / 3), F.col("n") % 3
    return t.join(n, "Chromosome").select(*frames.COORDS, F.when(i < r * (q + 1), F.floor(i / (q + 1))).otherwise(r + F.floor((i - r * (q + 1)) / F.greatest(q, F.lit(1)))).cast("long").alias("chunk"))


@add(sql("r c", """SELECT Chromosome, "Start" + greatest(b, f) - f AS "Start", "Start" + least(e, l) - f AS "End", part FROM (SELECT m.*, l, l - ("End" - "Start") AS f FROM (SELECT m.*, CAST(sum("End" - "Start") OVER (ORDER BY idx, "Start") AS BIGINT) AS l FROM m JOIN c USING (Chromosome)) AS m) JOIN parts ON b < l AND e > f""",
  _FLAT, """parts AS (SELECT i AS part, i * (n // 5) + least(i, n % 5) AS b, (i + 1) * (n // 5) + least(i + 1, n % 5) AS e FROM (SELECT CAST(sum("End" - "Start") AS BIGINT) AS n FROM m), (SELECT unnest(range(5)) AS i))"""))
def r193_equal_length_split(spark: SparkSession, sf: str) -> DataFrame:
    """Five parts of equal total length (rows 193 and 207)."""
    return frames.equal_length_split(_flat(spark, sf), contigs(spark, sf), 5)


@add("""SELECT Chromosome, w AS widths FROM (SELECT chr_name AS Chromosome, length // n AS base, length % n AS more, n FROM (SELECT *, greatest(length // 30000000, 1) AS n FROM chromdict)),
  LATERAL (SELECT array_to_string(list(base + CASE WHEN i < more THEN 1 ELSE 0 END ORDER BY i), ',') AS w FROM (SELECT unnest(range(n)) AS i))""")
def r195_split_widths(spark: SparkSession, sf: str) -> DataFrame:
    w = frames.split_widths(F.col("length"), F.lit(30_000_000))
    return contigs(spark, sf).select("Chromosome", F.array_join(F.transform(w, lambda x: x.cast("string")), ",").alias("widths"))


# ---- 2.9 and 2.19: algebra ----


@add(sql("a b", f"""SELECT x.Chromosome, greatest(x."Start", y."Start") AS "Start", least(x."End", y."End") AS "End", round(x.value, 4) AS value FROM a AS x JOIN b AS y ON {_ON}"""))
def r197_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.intersect(iv_a(spark, sf), iv_b(spark, sf)).withColumn("value", F.round("value", 4))


_A_UNION, _B_UNION = union_sql("a", "ma"), union_sql("b", "mb")
_CUTS = """cuts AS (SELECT DISTINCT Chromosome, p FROM (SELECT Chromosome, "Start" AS p FROM ma UNION SELECT Chromosome, "End" FROM ma UNION SELECT Chromosome, "Start" FROM mb UNION SELECT Chromosome, "End" FROM mb)),
cells AS (SELECT Chromosome, p AS "Start", lead(p) OVER (PARTITION BY Chromosome ORDER BY p) AS "End" FROM cuts),
flags AS (SELECT x.*, EXISTS (SELECT 1 FROM ma AS y WHERE y.Chromosome = x.Chromosome AND y."Start" <= x."Start" AND x."End" <= y."End") AS in_left, EXISTS (SELECT 1 FROM mb AS y WHERE y.Chromosome = x.Chromosome AND y."Start" <= x."Start" AND x."End" <= y."End") AS in_right FROM cells AS x WHERE "End" IS NOT NULL)"""


@add(sql("a b", """SELECT * FROM flags WHERE in_left OR in_right""", _A_UNION, _B_UNION, _CUTS))
def r198_refinement(spark: SparkSession, sf: str) -> DataFrame:
    """Disjoint refinement of two frames (rows 175 and 198)."""
    return algebra.isec_union(algebra.merge(iv_a(spark, sf)), algebra.merge(iv_b(spark, sf)))


@add(sql("r k", """SELECT Chromosome, "Start", "End", region_id, NULL AS sv_id FROM r UNION ALL SELECT Chromosome, "Start", "End", NULL, sv_id FROM k""").replace("NULL AS sv_id", "CAST(NULL AS BIGINT) AS sv_id"))
def r199_concat(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 199, 201 and 217."""
    return algebra.concat(regions(spark, sf).drop("sample"), breaks(spark, sf)).select("Chromosome", "Start", "End", "region_id", "sv_id")


@add(sql("r k", """SELECT * FROM m""", """u AS (SELECT Chromosome, "Start", "End" FROM r UNION ALL SELECT Chromosome, "Start", "End" FROM k)""", union_sql("u", "m")))
def r200_union(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 200 and 204, PyRanges set_union."""
    return algebra.set_union(regions(spark, sf), breaks(spark, sf))


@add(sql("r d", f"""SELECT x.Chromosome, greatest(x."Start", y."Start") AS "Start", least(x."End", y."End") AS "End" FROM m AS x JOIN n AS y ON {_ON}""", _FLAT, union_sql("d", "n")))
def r202_set_intersect(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.set_intersect(regions(spark, sf), bins(spark, sf).select(*frames.COORDS))


@add(sql("a b", """SELECT Chromosome, s AS "Start", e AS "End", round(value, 4) AS value FROM (
  SELECT x.*, coalesce(y."End", x."Start") AS s, coalesce(lead(y."Start") OVER (PARTITION BY x.Chromosome, x."Start", x."End" ORDER BY y."Start" NULLS FIRST), x."End") AS e
  FROM (SELECT a.*, mb."Start" AS ys, mb."End" AS ye FROM a JOIN mb ON a.Chromosome = mb.Chromosome AND a."Start" < mb."End" AND mb."Start" < a."End" UNION ALL SELECT a.*, NULL, NULL FROM a) AS x0, LATERAL (SELECT x0.ys AS "Start", x0.ye AS "End") AS y, LATERAL (SELECT x0.Chromosome, x0."Start", x0."End", x0.value) AS x) WHERE e > s""", _B_UNION))
def r203_subtract(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 80, 145 and 203, PyRanges subtract."""
    return algebra.subtract(iv_a(spark, sf), iv_b(spark, sf)).withColumn("value", F.round("value", 4))


@add(sql("r", """SELECT * FROM m""", _FLAT))
def r205_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Row 205, PyRanges merge."""
    return _flat(spark, sf)


@add(sql("r c", """SELECT region_id, Chromosome, greatest(0, "Start" - 500) AS "Start", least(length, "End" + 70) AS "End" FROM r JOIN c USING (Chromosome)"""))
def r206_slop(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.slop(regions(spark, sf).drop("sample"), contigs(spark, sf), 500, 70).select("region_id", *frames.COORDS)


@add(sql("c", """SELECT Chromosome, i * (length // n) + least(i, length % n) AS "Start", (i + 1) * (length // n) + least(i + 1, length % n) AS "End" FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, greatest(length // 1000000, 1) AS n FROM c))"""))
def r208_depth_bins(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.depth_bins(contigs(spark, sf), 1_000_000)


@add(sql("a b", """SELECT *, CASE WHEN lo < hi THEN lo END AS isec_start, CASE WHEN lo < hi THEN hi END AS isec_end,
  CASE WHEN lo >= hi THEN CAST(s1 AS VARCHAR) || '-' || e1 ELSE array_to_string(list_filter([CASE WHEN s1 < s2 THEN CAST(s1 AS VARCHAR) || '-' || s2 END, CASE WHEN e2 < e1 THEN CAST(e2 AS VARCHAR) || '-' || e1 END], lambda x: x IS NOT NULL), ',') END AS rest,
  s1 <= s2 AND e1 >= e2 AS spans FROM p""".replace("SELECT *,", "SELECT s1, e1, s2, e2,"), """p AS (SELECT DISTINCT s1, e1, s2, e2, greatest(s1, s2) AS lo, least(e1, e2) AS hi FROM (SELECT l_partkey AS s1, l_partkey + l_linenumber * 5 AS e1, l_suppkey * 10 AS s2, l_suppkey * 10 + CAST(l_quantity AS BIGINT) AS e2 FROM lineitem))"""))
def r209_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection, subtraction and covering of ranges (rows 209 to 212)."""
    t = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("s1"), (F.col("l_partkey") + F.col("l_linenumber") * 5).alias("e1"), (F.col("l_suppkey") * 10).alias("s2"), (F.col("l_suppkey") * 10 + F.col("l_quantity").cast("long")).alias("e2")).distinct()
    c = [F.col(x) for x in ("s1", "e1", "s2", "e2")]
    isec, rest = algebra.range_intersection(*c), algebra.range_subtraction(*c)
    return t.select("*", isec["start"].alias("isec_start"), isec["end"].alias("isec_end"), F.array_join(F.transform(rest, lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ",").alias("rest"), algebra.spans(*c).alias("spans"))


@add(sql("r", """SELECT region_id, CAST(island AS BIGINT) AS cluster FROM r JOIN m2 USING (Chromosome, "Start", "End")""", _FLAT))
def pr_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.cluster(regions(spark, sf)).select("region_id", F.col("Cluster").alias("cluster"))


@add(sql("r", """SELECT region_id, s AS "Start", least("End", s + 700) AS "End" FROM (SELECT *, unnest(range("Start", "End", 700)) AS s FROM r)"""))
def pr_window(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.window(regions(spark, sf), 700).select("region_id", "Start", "End")


@add(sql("r", """SELECT region_id, greatest("Start", t * 1000) AS "Start", least("End", (t + 1) * 1000) AS "End" FROM (SELECT *, unnest(range("Start" // 1000, ("End" - 1) // 1000 + 1)) AS t FROM r)"""))
def pr_tile(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.tile(regions(spark, sf), 1000).select("region_id", "Start", "End")


@add(sql("r d", f"""SELECT x.*, (SELECT count(*) FROM r AS y WHERE {_ON}) AS n, round(coalesce((SELECT sum(least(x."End", y."End") - greatest(x."Start", y."Start")) FROM m AS y WHERE {_ON}), 0) / (x."End" - x."Start"), 6) AS fraction FROM (SELECT DISTINCT Chromosome, "Start", "End" FROM d) AS x""", _FLAT))
def pr_coverage(spark: SparkSession, sf: str) -> DataFrame:
    t = algebra.coverage(bins(spark, sf).select(*frames.COORDS), regions(spark, sf))
    return t.select(*frames.COORDS, F.col("NumberOverlaps").alias("n"), F.round("FractionOverlaps", 6).alias("fraction"))


queries, oracle_sql = BOOK.queries, BOOK.oracle_sql
