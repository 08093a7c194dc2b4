"""Variant files (VCF text): scan, wide table and sink.

A scan is lazy: predicates on CHROM and POS are ordinary filters over split lines, and only the fields that are used are
cut. Defined results: ``.`` and empty fields are null; a sample whose format is shorter has nulls for the rest; header
lines are no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.alleles import is_breakend, missing_to_null
from spanforge.functions.annotation import attributes
from spanforge.operators.frames import sort

FIXED = ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT")


def header_samples(lines: DataFrame) -> list[str]:
    """Names of the samples, from the one header line that begins with #CHROM."""
    row = lines.where(F.col("line").startswith("#CHROM")).first()
    return row["line"].split("\t")[len(FIXED) :] if row else []


def parse(lines: DataFrame, samples: Sequence[str]) -> DataFrame:
    """CHROM, POS, ID, REF, ALTS, QUAL, FILTERS, INFO (map), samples (map of sample to map of key to text) of lines."""
    t = lines.where(~F.col("line").startswith("#") & (F.length(F.trim("line")) > 0)).select(F.split("line", "\t").alias("x"))
    at = lambda i: F.get("x", F.lit(i))
    keys = F.split(at(8), ":")

    def values(i: int) -> Column:
        v = F.split(at(len(FIXED) + i), ":")
        return F.map_from_entries(F.transform(keys, lambda k, j: F.struct(k.alias("k"), missing_to_null(F.get(v, j)).alias("v"))))

    per = F.create_map(*[c for i, s in enumerate(samples) for c in (F.lit(s), values(i))]) if samples else F.create_map().cast("map<string,map<string,string>>")
    lists = lambda c, sep: F.when(missing_to_null(c).isNotNull(), F.split(c, sep))
    return t.select(
        at(0).alias("CHROM"), at(1).try_cast("long").alias("POS"), missing_to_null(at(2)).alias("ID"), at(3).alias("REF"), lists(at(4), ",").alias("ALTS"), missing_to_null(at(5)).try_cast("double").alias("QUAL"),
        lists(at(6), ";").alias("FILTERS"), attributes(missing_to_null(at(7))).alias("INFO"), per.alias("samples"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return parse(lines, header_samples(lines))


def in_region(chrom: str, start0: int | None = None, end0: int | None = None, by_span: bool = True) -> Column:
    """Whether a record overlaps a region, by the span of REF or (without ``by_span``) by POS alone."""
    pos0 = F.col("POS") - 1
    last = pos0 + (F.length("REF") if by_span else 1)
    c = F.col("CHROM") == chrom
    if end0 is not None:
        c &= pos0 < end0
    return c & (last > start0) if start0 is not None else c


def wide(df: DataFrame, samples: Sequence[str], n_allele: int = 2, key: str = "AD") -> DataFrame:
    """Chromosome, Start, End, REF, ALT1.., POS, ID, is_bnd1 and per sample ``sample:::REF_vaf``, ``sample:::ALT1_vaf`` .. from
    the allele counts of ``key`` (comma separated, reference first)."""
    alts = [F.get("ALTS", F.lit(i)).alias(f"ALT{i + 1}") for i in range(n_allele - 1)]
    cols = []
    for s in samples:
        n = F.transform(F.split(F.col("samples")[s][key], ","), lambda x: x.try_cast("double"))
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
        cols += [F.try_divide(F.get(n, F.lit(i)), total).alias(f"{s}:::{'REF' if i == 0 else f'ALT{i}'}_vaf") for i in range(n_allele)]
    bnd = F.when(is_breakend(F.get("ALTS", F.lit(0))), F.when(F.col("INFO")["MATEID"].isNotNull(), True))
    return df.select(F.col("CHROM").alias("Chromosome"), (F.col("POS") - 1).alias("Start"), (F.col("POS") - 1 + F.length("REF")).alias("End"), "REF", *alts, "POS", "ID", bnd.alias("is_bnd1"), *cols)


def sample_columns(df: DataFrame, samples: Sequence[str] | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """The columns ``sample:::key`` of some samples and keys (of all, if None)."""
    pick = [c for c in df.columns if ":::" in c and (samples is None or c.split(":::")[0] in samples) and (keys is None or c.split(":::")[1] in keys)]
    return df.select(*[F.col(f"`{c}`") for c in pick])


def allele_columns(df: DataFrame) -> list[str]:
    """REF, ALT1, ALT2 .. of a wide table, in numeric order."""
    alts = [c for c in df.columns if c.startswith("ALT") and c[3:].isdecimal()]
    return ["REF", *sorted(alts, key=lambda c: int(c[3:]))]


def header(contigs: DataFrame, samples: Sequence[str] = (), version: str = "4.3") -> list[str]:
    """Header lines: version, contigs in their order (a small dimension), samples."""
    rows = contigs.orderBy("idx").collect()
    cols = [*FIXED[:8], *(["FORMAT", *samples] if samples else [])]
    return [f"##fileformat=VCFv{version}", *[f"##contig=<ID={r['Chromosome']},length={r['length']}>" for r in rows], "#" + "\t".join(cols)]


def merge_headers(headers: Sequence[Mapping[str, Mapping[str, str]]]) -> dict[str, dict[str, str]]:
    """Definitions (key to Type, Number, Description) of several headers; keys that are defined differently are dropped."""
    out: dict[str, dict[str, str]] = {}
    bad = set()
    for h in headers:
        for k, v in h.items():
            if k in out and out[k] != dict(v):
                bad.add(k)
            out.setdefault(k, dict(v))
    return {k: v for k, v in out.items() if k not in bad}


def to_lines(df: DataFrame, samples: Sequence[str] = ()) -> DataFrame:
    """line: records of a scan (or with these columns) as text; formats have the keys of a sample's map in their order."""
    dot = lambda c: F.coalesce(c, F.lit("."))
    info = F.array_join(F.transform(F.map_entries("INFO"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(".")))), ";")
    cols = [F.col("CHROM"), F.col("POS").cast("string"), dot(F.col("ID")), F.col("REF"), dot(F.array_join("ALTS", ",")), dot(F.col("QUAL").cast("string")), dot(F.array_join("FILTERS", ";")), dot(F.nullif(info, F.lit("")))]
    if samples:
        keys = F.map_keys(F.col("samples")[samples[0]])
        cols.append(F.array_join(keys, ":"))
        cols += [F.array_join(F.transform(keys, lambda k, s=s: F.coalesce(F.try_element_at(F.col("samples")[s], k), F.lit("."))), ":") for s in samples]
    return df.select(F.concat_ws("\t", *cols).alias("line"))


def write(df: DataFrame, path: str, contigs: DataFrame, samples: Sequence[str] = (), compression: str = "none") -> None:
    """Records in contig order as a folder of text files, of which the first begins with the header."""
    t = df.withColumns({"Chromosome": F.col("CHROM"), "Start": F.col("POS"), "End": F.col("POS")})
    body = to_lines(sort(t, contigs), samples)
    head = df.sparkSession.createDataFrame([(x,) for x in header(contigs, samples)], "line string").coalesce(1)
    head.unionByName(body).write.mode("overwrite").option("compression", compression).text(path)


def write_table(df: DataFrame, path: str) -> None:
    """A wide table as tab-separated text: CHROM and POS first, without Start and End, NA for missing values."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("Chromosome", "Start", "End", "POS")]
    df.select(F.col("Chromosome").alias("CHROM"), "POS", *rest).write.mode("overwrite").option("sep", "\t").option("header", True).option("nullValue", "NA").csv(path)
