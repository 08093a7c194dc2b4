"""Queries of the general data-preparation operators (problems 2 to 5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.operators import interval_periods, line_errors, packed_values, schema_drift
from spanforge.runtime import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Values of packed fields that hold at least two."""
    return packed_values.split_packed(table(spark, sf, "vep_annotation"), ["annot_id"], ["Consequence", "TRANSCRIPTION_FACTORS"], min_values=2)


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the packed fields, single ones too."""
    return packed_values.split_packed(table(spark, sf, "vep_annotation"), ["annot_id"], ["Consequence", "TRANSCRIPTION_FACTORS"])


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return line_errors.parse_lines(table(spark, sf, "interval_lines"), table(spark, sf, "interval_files"), table(spark, sf, "chromdict"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Data lines that cannot be loaded, with the reason."""
    return line_errors.rejected(_lines(spark, sf))


def p3_edits(spark: SparkSession, sf: str) -> DataFrame:
    """What would have to be inserted or deleted to make the lines parse that do not."""
    return line_errors.edit_scripts(_lines(spark, sf))


def p3_loaded(spark: SparkSession, sf: str) -> DataFrame:
    """All lines that load, of every layout: with p3_found, all data lines."""
    return line_errors.loaded_all(_lines(spark, sf))


def p3_loaded_ends(spark: SparkSession, sf: str) -> DataFrame:
    """The intervals of all lines that load."""
    return p3_loaded(spark, sf).select("file_id", "line_no", "kind", "chrom1", "start1", "end1", "chrom2", "start2", "end2")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of the schema between successive files of a feed."""
    return schema_drift.drift(table(spark, sf, "vep_records"), table(spark, sf, "vep_files"), table(spark, sf, "vep_fields"))[1]


def p4_unified(spark: SparkSession, sf: str) -> DataFrame:
    """All records under the canonical fields."""
    records, dictionary = table(spark, sf, "vep_records"), table(spark, sf, "vep_fields")
    unified, _ = schema_drift.drift(records, table(spark, sf, "vep_files"), dictionary)
    fields = [(r["field"], r["json_type"]) for r in dictionary.orderBy("field").collect()]  # the dictionary is the output schema
    return schema_drift.unified_table(records, unified, fields)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous periods and gaps of the intervals of each sample and chromosome."""
    chroms = table(spark, sf, "chromdict").select("chrom", F.explode(F.array_distinct(F.array("chrom", "chr_name"))).alias("name"))

    def named(name: str, c: str, s: str, e: str) -> DataFrame:
        t = table(spark, sf, name).select(F.lit(name).alias("dataset"), "sample", F.col(c).alias("name"), F.col(s).alias("s"), F.col(e).alias("e"))
        return t.join(chroms, "name", "left").select("dataset", "sample", F.coalesce("chrom", "name").alias("chrom"), "s", "e")

    keys = ["dataset", "sample", "chrom"]
    rows = named("region_gdf", "Chromosome", "Start", "End").unionByName(named("rearrangements", "chrom1", "start1", "end1"))
    return interval_periods.periods_and_gaps(interval_periods.disjoint_lists(rows, keys, "s", "e"), keys)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_values, p3_found, p3_edits, p3_loaded_ends, p3_loaded, p4_found, p4_unified, p5_found)}


_P5_SOURCE = """
chroms AS (SELECT chrom, chrom AS name FROM chromdict UNION SELECT chrom, chr_name FROM chromdict),
raw AS (
  SELECT 'region_gdf' AS dataset, "sample", Chromosome AS name, "Start" AS s, "End" AS e FROM region_gdf
  UNION ALL SELECT 'rearrangements', "sample", chrom1, start1, end1 FROM rearrangements),
iv AS (SELECT dataset, "sample", coalesce(chrom, raw.name) AS chrom, s, e FROM raw LEFT JOIN chroms USING (name)
       WHERE "sample" IS NOT NULL AND raw.name IS NOT NULL AND s IS NOT NULL AND e > s),
m AS (SELECT *, max(e) OVER (PARTITION BY dataset, "sample", chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM iv),
g AS (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, "sample", chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT dataset, "sample", chrom, min(s) AS start0, max(e) AS end0 FROM g GROUP BY dataset, "sample", chrom, island)
"""


_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t]*)'
_P3 = rf"""
body AS (SELECT file_id, line_no, regexp_replace(line, '\r$', '') AS line FROM interval_lines WHERE line IS NOT NULL),
data AS (SELECT b.*, kind, column_list, coalesce(n_columns, -1) AS n FROM body AS b LEFT JOIN (SELECT DISTINCT file_id, kind, column_list, n_columns FROM interval_files) AS f USING (file_id)
  WHERE NOT regexp_matches(line, '^\s*$') AND NOT regexp_matches(line, '^(#|(track|browser)(\s|$))') AND replace(line, chr(9), ',') IS DISTINCT FROM column_list),
cut AS (SELECT *, regexp_matches(line, '^{_FIELD}(?:\t{_FIELD})*$') AS parses, [CASE WHEN x[1] = '"' THEN replace(x[2:length(x) - 1], '""', '"') ELSE x END for x in regexp_extract_all(line || chr(9), '({_FIELD})\t', 1)] AS f, string_split(column_list, ',') AS c FROM data),
val AS (SELECT *, {", ".join(f"f[list_position(c, '{x}')] AS {x}_" for x in ("chrom", "start", "end", "strand", "chrom1", "start1", "end1", "chrom2", "start2", "end2", "strand1", "strand2"))} FROM cut),
names AS (SELECT chrom AS name, length FROM chromdict UNION SELECT chr_name, length FROM chromdict),
one AS (SELECT v.*, coalesce(chrom_, chrom1_) AS ca, coalesce(start_, start1_) AS sa, coalesce(end_, end1_) AS ea, a.length AS la, b.length AS lb FROM val AS v LEFT JOIN names AS a ON a.name = coalesce(chrom_, chrom1_) LEFT JOIN names AS b ON b.name = chrom2_),
good AS (SELECT *, coalesce(la IS NOT NULL AND regexp_matches(sa, '^[0-9]+$') AND regexp_matches(ea, '^[0-9]+$') AND TRY_CAST(sa AS HUGEINT) <= TRY_CAST(ea AS HUGEINT) AND TRY_CAST(ea AS HUGEINT) <= la, false) AS ok1,
  NOT list_contains(c, 'chrom2') OR coalesce(lb IS NOT NULL AND regexp_matches(start2_, '^[0-9]+$') AND regexp_matches(end2_, '^[0-9]+$') AND TRY_CAST(start2_ AS HUGEINT) <= TRY_CAST(end2_ AS HUGEINT) AND TRY_CAST(end2_ AS HUGEINT) <= lb, false) AS ok2,
  coalesce(strand_ IN ('+', '-') OR (strand_ = '.' AND NOT list_contains(c, 'chrom2')), true) AND coalesce(strand1_ IN ('+', '-'), true) AND coalesce(strand2_ IN ('+', '-'), true) AS ok3 FROM one),
verdict AS (SELECT *, CASE WHEN NOT parses THEN 'quoting' WHEN len(f) <> n THEN 'column_count' WHEN NOT (ok1 AND ok2 AND ok3) THEN 'invalid_value' END AS reason FROM good)"""


_P2 = r"""
tall AS (SELECT DISTINCT annot_id, field, v FROM (SELECT annot_id, unnest(['Consequence', 'TRANSCRIPTION_FACTORS']) AS field, unnest([Consequence, TRANSCRIPTION_FACTORS]) AS v FROM vep_annotation) WHERE v IS NOT NULL),
bare AS (SELECT *, regexp_replace(v, '^[ \x{A0}]*\[(.*)\][ \x{A0}]*$', '\1', 's') AS t FROM tall),
flat AS (SELECT *, regexp_replace(t, '&amp;|&#38;|&#44;|&#59;|&#124;|%2[CcFf6]|%3[Bb]|%7[Cc]|%09', chr(1), 'g') AS u FROM bare),
cut AS (SELECT annot_id, field, regexp_extract_all(u || ',', '([ \x{A0}]*"(?:[^"\\]|""|\\.)*"[ \x{A0}]*|[^&,;|/\t\n\r\x01]*)[&,;|/\t\n\r\x01]', 1) AS x FROM flat),
item AS (SELECT annot_id, field, CAST(i AS INTEGER) AS pos, trim(x[i], ' ' || chr(160)) AS raw FROM cut, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i)),
clean AS (SELECT annot_id, field, pos, trim(CASE WHEN raw[1] = '"' AND raw[-1] = '"' AND length(raw) > 1 THEN regexp_replace(replace(raw[2:length(raw) - 1], '""', '"'), '\\(.)', '\1', 'g') ELSE raw END) AS item FROM item),
kept AS (SELECT DISTINCT * FROM clean WHERE lower(item) NOT IN ('', '.', '-', 'na', 'n/a', 'nan', 'null', 'none', '?'))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_values": f"WITH {_P2} SELECT annot_id, field, pos, item FROM kept",
        "p2_found": f"WITH {_P2} SELECT annot_id, field, pos, item FROM kept QUALIFY count(*) OVER (PARTITION BY annot_id, field) >= 2",
        "p3_found": f"WITH {_P3} SELECT file_id, line_no, reason FROM verdict WHERE reason IS NOT NULL",
        "p3_loaded_ends": f"""WITH {_P3} SELECT file_id, line_no, kind, ca AS chrom1, CAST(sa AS BIGINT) AS start1, CAST(ea AS BIGINT) AS end1, chrom2_ AS chrom2, CAST(start2_ AS BIGINT) AS start2, CAST(end2_ AS BIGINT) AS end2 FROM verdict WHERE reason IS NULL""",
        "p5_found": f"""
WITH {_P5_SOURCE}
SELECT dataset, "sample", chrom, 'period' AS kind, start0, end0 FROM p
UNION ALL
SELECT dataset, "sample", chrom, 'gap', prev_end, start0
FROM (SELECT *, lag(end0) OVER (PARTITION BY dataset, "sample", chrom ORDER BY start0) AS prev_end FROM p) WHERE prev_end IS NOT NULL""",
    }
