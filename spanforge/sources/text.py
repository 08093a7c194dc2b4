"""Tab-separated interval and annotation files. Spark reads them (also compressed) in parallel; only a first line is looked at
to tell a header.

Defined results: comment lines (#) and blank lines are no rows; fields that have not their type are null; lines of any
length are read whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.annotation import attributes
from spanforge.operators.frames import COORDS, sort

BED_NAMES = ("Chromosome", "Start", "End", "Name", "Score", "Strand", "ThickStart", "ThickEnd", "ItemRGB", "BlockCount", "BlockSizes", "BlockStarts")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line: the lines of text files that are no comments."""
    return spark.read.text(path).select(F.regexp_replace("value", r"\r\z", "").alias("line")).where((F.length(F.trim("line")) > 0) & ~F.col("line").startswith("#"))


def is_header(fields: Sequence[str]) -> bool:
    """Whether the second and third field of a first line are no numbers."""
    return len(fields) >= 3 and not fields[1].isdecimal() and not fields[2].isdecimal()


def fields(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Columns of a ``line`` by place, cast to their types."""
    x = F.split("line", "\t")
    return df.select(*[F.nullif(F.get(x, F.lit(i)), F.lit("")).try_cast(t).alias(n) for i, (n, t) in enumerate(types.items())])


def read_tsv(spark: SparkSession, path: str, names: Sequence[str] | None = None, types: Mapping[str, str] | None = None) -> DataFrame:
    """An interval file. Its header must begin with Chromosome, Start, End; without one the names are the coordinates and
    ``names``, or those of the BED format."""
    t = lines(spark, path)
    first = t.first()
    if first is None:
        return spark.createDataFrame([], "Chromosome string, Start bigint, End bigint")
    head = first["line"].split("\t")
    if is_header(head):
        if tuple(head[:3]) != COORDS:
            raise ValueError(f"the header does not begin with {COORDS}")
        cols, t = head, t.where(F.col("line") != first["line"])
    else:
        cols = [*COORDS, *names] if names is not None else list(BED_NAMES[: len(head)])
        if len(cols) != len(head):
            raise ValueError(f"{len(head)} fields, {len(cols)} names")
    kinds = {"Start": "bigint", "End": "bigint", **(types or {})}
    return fields(t, {c: kinds.get(c, "string") for c in cols})


def read_mosdepth(spark: SparkSession, path: str) -> DataFrame:
    """Depth per region (``*.regions.bed.gz``)."""
    if ".regions.bed" not in path:
        raise ValueError("not a regions file")
    return fields(lines(spark, path), {"Chromosome": "string", "Start": "bigint", "End": "bigint", "depth": "double"})


def sequenza_segments(t: DataFrame) -> DataFrame:
    """1-based segments (chromosome, start.pos, end.pos, ..) as a frame."""
    rest = [c for c in t.columns if c not in ("chromosome", "start.pos", "end.pos")]
    return t.select(F.col("chromosome").alias("Chromosome"), (F.col("`start.pos`").cast("long") - 1).alias("Start"), F.col("`end.pos`").cast("long").alias("End"), *[F.col(f"`{c}`") for c in rest])


def gff_features(df: DataFrame) -> DataFrame:
    """Chromosome, Start, End, kind, strand, attributes of GFF3 lines (``line``)."""
    t = fields(df, {"Chromosome": "string", "source": "string", "kind": "string", "start1": "bigint", "End": "bigint", "score": "string", "strand": "string", "phase": "string", "attrs": "string"})
    return t.select("Chromosome", (F.col("start1") - 1).alias("Start"), "End", "kind", "strand", attributes(F.col("attrs")).alias("attributes"))


def repeat_features(df: DataFrame) -> DataFrame:
    """Chromosome, Start, End, name, class, family, strand of lines whose name is ``name|class|family``."""
    t = fields(df, {"Chromosome": "string", "Start": "bigint", "End": "bigint", "full": "string", "score": "string", "strand": "string"})
    x = F.split("full", r"\|")
    return t.select("Chromosome", "Start", "End", F.get(x, F.lit(0)).alias("name"), F.get(x, F.lit(1)).alias("class"), F.get(x, F.lit(2)).alias("family"), "strand")


def cytobands(df: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Chromosome, Start, End, Name, Stain of a band track; contigs renamed by ``names`` (name, Chromosome), if given."""
    t = fields(df, {"Chromosome": "string", "Start": "bigint", "End": "bigint", "Name": "string", "Stain": "string"})
    if names is None:
        return t
    return t.withColumnRenamed("Chromosome", "name").join(names, "name").select("Chromosome", "Start", "End", "Name", "Stain")


def assembly_regions(df: DataFrame, name: str = "PAR") -> DataFrame:
    """Chromosome, Start, End, region of an assembly regions file; 1-based and closed in the file."""
    t = fields(df, {"region": "string", "Chromosome": "string", "start1": "bigint", "End": "bigint", "role": "string"})
    return t.where(F.col("region").startswith(name)).select("Chromosome", (F.col("start1") - 1).alias("Start"), "End", "region")


def assembly_report(df: DataFrame) -> DataFrame:
    """name, alias_kind, alias, length: the names of a contig in several spellings, from an assembly report."""
    t = fields(df, {"name": "string", "role": "string", "molecule": "string", "kind": "string", "genbank": "string", "relation": "string", "refseq": "string", "unit": "string", "length": "bigint", "ucsc": "string"})
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("alias_kind"), F.col(k).alias("alias")) for k in ("genbank", "refseq", "ucsc")]))
    return t.select("name", "length", each.alias("x")).select("name", "x.*", "length").where(~F.coalesce(F.col("alias") == "na", F.lit(True)))


# ---- sinks ----


def _text(df: DataFrame, null: str) -> Column:
    return F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null)) for c in df.columns])


def write_tsv(df: DataFrame, path: str, contigs: DataFrame | None = None, header: bool = True, null: str = "", compression: str = "none") -> None:
    """A folder of tab-separated files, in frame order if the contigs are given."""
    t = sort(df, contigs) if contigs is not None else df
    t.write.mode("overwrite").option("sep", "\t").option("header", header).option("nullValue", null).option("emptyValue", "").option("compression", compression).csv(path)


def write_bed(df: DataFrame, path: str, contigs: DataFrame | None = None) -> None:
    """The three coordinates only, without a header."""
    write_tsv(df.select(*COORDS), path, contigs, header=False)


def save_tables(tables: Mapping[str, DataFrame], folder: str, partition_by: str | None = None) -> None:
    """Every table as Parquet in a folder of its own."""
    for name, t in tables.items():
        w = t.write.mode("overwrite")
        (w.partitionBy(partition_by) if partition_by else w).parquet(f"{folder}/{name}")


def load_tables(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def renamed(df: DataFrame, names: DataFrame, contigs: DataFrame) -> DataFrame:
    """A frame with contigs in another spelling (``names``: name, Chromosome) and in contig order; rows on contigs without
    such a name are left out."""
    t = df.withColumnRenamed("Chromosome", "_name").join(names.select(F.col("name").alias("_name"), "Chromosome"), "_name")
    return sort(t.select(*df.columns), contigs)


def with_activities(features: DataFrame, activities: DataFrame, key: str) -> DataFrame:
    """Features with a map of tissue to activity from a tall table (key, tissue, activity)."""
    a = activities.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tissue", "activity")))).alias("activities"))
    return features.join(a, key, "left")


def write_split(df: DataFrame, path: str, n_files: int | None = None, n_rows: int | None = None) -> None:
    """A table as about ``n_files`` files, or as files of at most ``n_rows`` rows."""
    w = (df.repartition(n_files) if n_files else df).write.mode("overwrite")
    (w.option("maxRecordsPerFile", n_rows) if n_rows else w).parquet(path)
