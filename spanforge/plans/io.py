"""Queries of the readers (over lines that are made of the tables) and of the windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.plans.book import Book
from spanforge.runtime import table
from spanforge.sources import text, vcf
from spanforge.streaming import windows

BOOK = Book()
add = BOOK.add
col = F.col


def _lines(t: DataFrame, *cols) -> DataFrame:  # noqa: ANN002
    return t.select(F.concat_ws("\t", *[c.cast("string") for c in cols]).alias("line"))


def _vcf(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "variants").where(col("Chromosome").isNotNull() & col("POS").isNotNull() & col("REF").isNotNull() & col("ALT1").isNotNull())
    n = col("variant_id")
    dot = lambda c: F.coalesce(c, F.lit("."))
    counts = F.concat((n % 50).cast("string"), F.lit(","), (n % 20).cast("string"))
    return _lines(t, col("Chromosome"), col("POS"), dot(col("ID")), col("REF"), F.concat_ws(",", "ALT1", "ALT2"), F.when(n % 3 == 0, ".").otherwise((n % 90).cast("string")), F.when(n % 4 == 0, "PASS").when(n % 4 == 1, ".").otherwise("q10;s50"),
                  F.concat(F.lit("NO="), n.cast("string"), F.lit(";DB")), F.lit("GT:AD"), F.concat(F.lit("0/1:"), counts), F.lit("./."))


_V = "v AS (SELECT *, variant_id AS n FROM variants WHERE Chromosome IS NOT NULL AND POS IS NOT NULL AND REF IS NOT NULL AND ALT1 IS NOT NULL)"


@add(f"""WITH {_V} SELECT n AS no, Chromosome AS chrom, POS AS pos, nullif(nullif(ID, '.'), '') AS id, CASE WHEN ALT2 IS NULL THEN ALT1 ELSE ALT1 || ',' || ALT2 END AS alts, CASE WHEN n % 3 = 0 THEN NULL ELSE n % 90 END::DOUBLE AS qual,
  CASE WHEN n % 4 IN (0, 1) THEN true ELSE false END AS pass, '0/1' AS gt1, './.' AS gt2 FROM v""")
def r011_vcf_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 11, 14 to 16, 89: records of two samples, scanned."""
    from spanforge.operators.filters import passed

    t = vcf.parse(_vcf(spark, sf), ["s1", "s2"])
    return t.select(col("INFO")["NO"].cast("long").alias("no"), col("CHROM").alias("chrom"), col("POS").alias("pos"), col("ID").alias("id"), F.array_join("ALTS", ",").alias("alts"), col("QUAL").alias("qual"), passed(col("FILTERS")).alias("pass"),
                    col("samples")["s1"]["GT"].alias("gt1"), col("samples")["s2"]["GT"].alias("gt2"))


@add(f"""WITH {_V} SELECT Chromosome, POS - 1 AS "Start", POS - 1 + length(REF) AS "End", REF, ALT1, POS, round(CASE WHEN n % 50 + n % 20 = 0 THEN NULL ELSE (n % 20) / (n % 50 + n % 20) END, 6) AS vaf FROM v""")
def r013_vcf_fractions(spark: SparkSession, sf: str) -> DataFrame:
    """Wide table with the fractions of a sample (rows 12, 13, 40, 62 to 64)."""
    t = vcf.wide(vcf.parse(_vcf(spark, sf), ["s1", "s2"]), ["s1", "s2"])
    return t.select("Chromosome", "Start", "End", *vcf.allele_columns(t), "POS", F.round("`s1:::ALT1_vaf`", 6).alias("vaf"))


@add(f"""WITH {_V} SELECT n AS no FROM v WHERE Chromosome IN ('chr2', '2') AND POS - 1 < 150000000 AND POS - 1 + length(REF) > 50000000""")
def r019_vcf_region(spark: SparkSession, sf: str) -> DataFrame:
    """Records of a region (rows 17 to 20, 84 and 85)."""
    t = vcf.parse(_vcf(spark, sf), ["s1", "s2"])
    hit = vcf.in_region("chr2", 50_000_000, 150_000_000) | vcf.in_region("2", 50_000_000, 150_000_000)
    return t.where(hit).select(col("INFO")["NO"].cast("long").alias("no"))


@add(f"""WITH {_V} SELECT Chromosome || chr(9) || POS || chr(9) || coalesce(nullif(ID, ''), '.') || chr(9) || REF || chr(9) || CASE WHEN ALT2 IS NULL THEN ALT1 ELSE ALT1 || ',' || ALT2 END AS head FROM v""")
def r041_vcf_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Records written as text (rows 41, 42 and 503)."""
    t = vcf.to_lines(vcf.parse(_vcf(spark, sf), ["s1", "s2"]).drop("samples"))
    return t.select(F.substring_index("line", "\t", 5).alias("head"))


@add("""SELECT region_id, Chromosome, "Start" - 1 AS "Start", "End", CAST(region_id AS VARCHAR) AS id, kit FROM (SELECT DISTINCT region_id, Chromosome, "Start", "End", kit FROM region_gdf WHERE Chromosome IS NOT NULL AND "Start" IS NOT NULL AND "End" IS NOT NULL AND kit IS NOT NULL)""")
def r027_gff_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Features with attributes (rows 27 and 29)."""
    t = table(spark, sf, "region_gdf").select("region_id", "Chromosome", "Start", "End", "kit").distinct().dropna(subset=["Chromosome", "Start", "End", "kit"])
    dot = F.lit(".")
    g = text.gff_features(_lines(t, col("Chromosome"), dot, F.lit("region"), col("Start"), col("End"), dot, F.lit("+"), dot, F.concat(F.lit("ID="), col("region_id").cast("string"), F.lit(";kit="), col("kit"))))
    return g.select(col("attributes")["ID"].cast("long").alias("region_id"), "Chromosome", "Start", "End", col("attributes")["ID"].alias("id"), col("attributes")["kit"].alias("kit"))


@add("""SELECT chr_name AS Chromosome, CAST(0 AS BIGINT) AS "Start", length AS "End", 'L' || idx AS name, 'LINE' AS class FROM chromdict""")
def r028_repeat_lines(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "chromdict")
    r = text.repeat_features(_lines(t, col("chr_name"), F.lit(0), col("length"), F.concat(F.lit("L"), col("idx").cast("string"), F.lit("|LINE|L1")), F.lit(1), F.lit("-")))
    return r.select("Chromosome", "Start", "End", "name", "class")


@add("""SELECT Chromosome, "Start" - 1 AS "Start", "End", depth FROM depth_rawdata WHERE Chromosome IS NOT NULL AND "Start" IS NOT NULL AND "End" IS NOT NULL AND depth IS NOT NULL AND NOT isnan(depth)""")
def r025_depth_and_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Depth lines read as 1-based segments (rows 9, 25, 26 and 33)."""
    d = table(spark, sf, "depth_rawdata").where(~F.isnan("depth")).dropna(subset=["Chromosome", "Start", "End", "depth"])
    t = text.fields(_lines(d, col("Chromosome"), col("Start"), col("End"), col("depth")), {"chromosome": "string", "start.pos": "bigint", "end.pos": "bigint", "depth": "double"})
    return text.sequenza_segments(t)


@add("""SELECT name, alias_kind, alias, length FROM (SELECT chrom AS name, unnest(['genbank', 'ucsc']) AS alias_kind, unnest(['G' || idx, chr_name]) AS alias, length FROM chromdict)""")
def r034_assembly_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 34 and 35."""
    na = F.lit("na")
    c = table(spark, sf, "chromdict")
    return text.assembly_report(_lines(c, col("chrom"), na, na, na, F.concat(F.lit("G"), col("idx").cast("string")), F.lit("="), na, na, col("length"), col("chr_name")))


@add("""SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL""")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    t = windows.tumbling(table(spark, sf, "events"), "ts", ["event_type"], "value", "6 hours")
    return t.select("event_type", "start", "n", F.round("total", 2).alias("total"))


@add("""SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY user_id, s""")
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return windows.sessions(table(spark, sf, "events"), "ts", ["user_id"]).select("user_id", "start", col("end").alias("stop"), "n")


queries, oracle_sql = BOOK.queries, BOOK.oracle_sql
