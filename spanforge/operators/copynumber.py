"""Operators of the copy-number model that need more than a row: segmentation, grid search, cancer cell fractions, outliers,
GC bins, corrections and mean ploidies.

Grids are small arrays of parameters that are exploded beside each segment (their size is a parameter, not data) and
aggregated by grid cell; nothing is crossed with data. Defined results: null and NaN depths take no part; an empty frame
gives no rows (or one row of nulls where a total is asked).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.functions import copynumber as cn
from spanforge.functions.distributions import binom_cdf, binom_logpmf, kernel_density, peaks
from spanforge.operators.ordered import running

# ---- segmentation ----


def best_arc(x: np.ndarray) -> tuple[float, int, int]:
    """(statistic, i, j): the arc x[i:j] whose mean differs most from that of the rest, by the t statistic of circular
    binary segmentation."""
    n = len(x)
    s = np.concatenate([[0.0], np.cumsum(x - x.mean())])
    i, j = np.triu_indices(n + 1, 1)
    m = j - i
    ok = m < n
    i, j, m = i[ok], j[ok], m[ok]
    z = np.abs(s[j] - s[i]) / np.sqrt(m * (1 - m / n))
    k = int(np.argmax(z))
    return float(z[k]), int(i[k]), int(j[k])


def circular_segments(x: np.ndarray, cutoff: float = 4.0, least: int = 2) -> list[int]:
    """Borders (from 0 to len(x)) of segments of near-constant mean. The noise is that of successive differences, so the
    result is deterministic: an arc is cut out if its statistic exceeds ``cutoff`` deviations times the square root of
    the log of the length, and pieces have at least ``least`` values."""
    x = np.asarray(x, float)
    if len(x) < 2 * least:
        return [0, len(x)] if len(x) else [0]
    noise = np.median(np.abs(np.diff(x))) / 0.954 or np.std(np.diff(x)) / np.sqrt(2) or 1e-12
    borders, todo = {0, len(x)}, [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a < 2 * least:
            continue
        z, i, j = best_arc(x[a:b])
        if z / noise <= cutoff * np.sqrt(max(1.0, np.log(b - a) / 4)):
            continue
        cuts = sorted({a, b, *(c for c in (a + i, a + j) if a + least <= c <= b - least)})
        if len(cuts) > 2:
            borders.update(cuts)
            todo += list(zip(cuts, cuts[1:]))
    return sorted(borders)


def segment(df: DataFrame, value: str, width: int = 1000, cutoff: float = 4.0) -> DataFrame:
    """Chromosome, Start, End, N, ``<value>``: segments of near-constant value, in chunks of at most ``width`` rows of a
    contig; a contig of any size is cut into many chunks, so no task sees it whole."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select("Chromosome", "Start", "End", F.col(value).cast("double").alias(value))
    t = running(known, ["Chromosome"], F.lit(1), "sum", "_i").withColumn("_chunk", F.floor(F.coalesce("_i", F.lit(0)) / width))

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["Start", "End"])
        x = p[value].to_numpy()
        at = circular_segments(x, cutoff)
        rows = [(p["Chromosome"].iloc[0], p["Start"].iloc[a], p["End"].iloc[b - 1], b - a, float(x[a:b].mean())) for a, b in zip(at, at[1:])]
        return pd.DataFrame(rows, columns=["Chromosome", "Start", "End", "N", value])

    return t.groupBy("Chromosome", "_chunk").applyInPandas(cut, f"Chromosome string, Start bigint, End bigint, N bigint, `{value}` double")


# ---- grid search ----


def grid(low: float, high: float, cnt0: int = 5, divisions: int = 8, cng: float = 2.0) -> list[tuple[int, int, float, float]]:
    """(CNt0, number of divisions, K, cellularity) for the lowest depth being CNt0 copies and the range of depths
    ``divisions`` copies; cells without a solution are left out."""
    out = []
    for t in range(cnt0):
        for n in range(1, divisions + 1):
            d2 = low + (high - low) / n
            denom = d2 * (t - cng) - low * (t + 1 - cng)
            if denom == 0:
                continue
            c = (low * cng - d2 * cng) / denom
            if not 0 < c <= 1:
                continue
            inverse = (cng + c * (t - cng)) / low if low else 0.0
            if inverse > 0:
                out.append((t, n, 1 / inverse, c))
    return out


def grid_search(segments: DataFrame, depth: str, baf: str, length: str, cng: str, bg: str, cells: list[tuple[int, int, float, float]]) -> DataFrame:
    """CNt0, divisions, K, cellularity, target: the length-weighted mean over segments of the differences between observed
    and predicted depth and fraction, in units of one copy; a missing fraction costs nothing."""
    if not cells:
        return segments.sparkSession.createDataFrame([], "CNt0 int, divisions int, K double, cellularity double, target double")
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("CNt0"), F.lit(n).alias("divisions"), F.lit(k).alias("K"), F.lit(c).alias("cellularity")) for t, n, k, c in cells]))
    s = segments.select(*[F.col(x).cast("double").alias(y) for x, y in ((depth, "d"), (baf, "b"), (length, "n"), (cng, "g"), (bg, "bg"))]).where(F.col("d").isNotNull() & ~F.isnan("d"))
    t = s.select("*", each.alias("_g")).select("d", "b", "n", "g", "bg", "_g.*")
    t = t.withColumn("CNt", cn.clonal_cnt(F.col("d"), F.col("cellularity"), F.col("K"), F.col("g")))
    t = t.withColumn("Bt", cn.clonal_bt(F.col("b"), F.col("CNt"), F.col("cellularity"), F.col("g"), F.col("bg")))
    by_depth = F.abs(F.col("d") - cn.predicted_depth(F.col("CNt"), F.col("K"), F.col("cellularity"), F.col("g"))) / cn.onecopy_depth(F.col("K"), F.col("cellularity"))
    by_baf = F.try_divide(F.abs(F.col("b") - cn.predicted_baf(F.col("CNt"), F.col("Bt"), F.col("cellularity"), F.col("g"), F.col("bg"))), cn.onecopy_baf(F.col("CNt"), F.col("cellularity"), F.col("g")))
    cost = by_depth + F.coalesce(by_baf, F.lit(0.0))
    return t.groupBy("CNt0", "divisions", "K", "cellularity").agg((F.sum(cost * F.col("n")) / F.sum("n")).alias("target"))


def grid_minima(scores: DataFrame, x: str, y: str, value: str) -> DataFrame:
    """Cells that are not above their neighbours along both axes (a cell at an edge has one neighbour)."""
    low = F.lit(True)
    for a, b in ((x, y), (y, x)):
        w = Window.partitionBy(a).orderBy(b)
        low &= (F.col(value) <= F.coalesce(F.lag(value).over(w), F.lit(float("inf")))) & (F.col(value) <= F.coalesce(F.lead(value).over(w), F.lit(float("inf"))))
    return scores.withColumn("_low", low).where("_low").drop("_low")


# ---- cancer cell fractions ----


def cell_fractions(df: DataFrame, c: float, pvalue: float = 0.05) -> DataFrame:
    """Adds CNm and ccf to rows with vaf, total_depth, alt_depth, CNg, CNt, Bt: 1 copy and a fraction below 1 where so few
    reads would be unlikely for a mutation of all tumour cells, else fraction 1 with the most likely number of copies
    from the major allele down; null where a value is missing."""
    names = ["vaf", "total_depth", "alt_depth", "CNg", "CNt", "Bt"]

    def find(vaf: pd.Series, total: pd.Series, alt: pd.Series, cng: pd.Series, cnt: pd.Series, bt: pd.Series) -> pd.DataFrame:
        v, n, k, g, t, b = (x.to_numpy(float) for x in (vaf, total, alt, cng, cnt, bt))
        bad = np.isnan(v + n + k + g + t + b)

        def expected(m: np.ndarray) -> np.ndarray:
            with np.errstate(all="ignore"):
                return c * m / (c * t + (1 - c) * g)

        with np.errstate(invalid="ignore"):
            sub = (binom_cdf(k, n, expected(np.ones_like(t))) < pvalue) & ~bad
        best, score = np.full(len(v), np.nan), np.full(len(v), -np.inf)
        major = t - b
        for step in range(int(np.nanmax(np.where(bad, 0, major), initial=0)) + 1):
            m = major - step
            s = np.where(m > 0, binom_logpmf(k, n, expected(m)), -np.inf)
            better = ~np.isnan(s) & (s > score)
            best, score = np.where(better, m, best), np.where(better, s, score)
        ccf = np.where(sub, v * (t + (1 / c - 1) * g), 1.0)
        cnm = np.where(sub, 1.0, best)
        none = bad | np.isnan(cnm)
        return pd.DataFrame({"CNm": np.where(none, np.nan, cnm), "ccf": np.where(none, np.nan, ccf)}).astype(object).where(lambda x: x.notna(), None)

    udf = F.pandas_udf(find, "CNm double, ccf double")
    return df.withColumn("_f", udf(*[F.col(x).cast("double") for x in names])).select(*df.columns, "_f.CNm", "_f.ccf")


# ---- depth ----


def outliers(df: DataFrame, value: str, trim: tuple[float, float] | None = None, low: float | None = None, high: float | None = None, drop_y: bool = False, group: list[str] | None = None) -> DataFrame:
    """Adds ``excluded``: a missing value, contig Y (with ``drop_y``), outside the cutoffs, or among the int(part * n) least
    or greatest known values of its group (``trim``; ties as in the order of Start)."""
    group = group or ["Chromosome"]
    known = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    bad = ~known
    if drop_y:
        bad |= F.col("Chromosome").isin("Y", "chrY")
    t = df
    if trim:
        w = Window.partitionBy(*group)
        t = t.withColumns({"_n": F.sum(known.cast("long")).over(w), "_i": F.row_number().over(w.orderBy(F.when(known, F.col(value)).asc_nulls_last(), "Start"))})
        bad |= (F.col("_i") <= F.floor(F.col("_n") * trim[0])) | (F.col("_i") > F.col("_n") - F.floor(F.col("_n") * trim[1]))
    if low is not None:
        bad |= F.col(value) < low
    if high is not None:
        bad |= F.col(value) > high
    return t.withColumn("excluded", F.coalesce(bad, F.lit(True))).select(*df.columns, "excluded")


def gc_bins(df: DataFrame, gc: str, value: str, n_bin: int, weight: Column | None = None) -> DataFrame:
    """bin (1 .. n_bin), average, normalized: mean value per bin of GC content, (0, 1] in equal steps, by ``weight``; bins
    without rows have nulls; normalized is the average over the mean of all bins."""
    w = weight if weight is not None else F.lit(1.0)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(gc) > 0) & (F.col(gc) <= 1))
    g = known.groupBy(F.ceil(F.col(gc) * n_bin).cast("int").alias("bin")).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("average"))
    t = df.sparkSession.range(1, n_bin + 1).select(F.col("id").cast("int").alias("bin")).join(g, "bin", "left")
    return t.withColumn("normalized", F.col("average") / F.avg("average").over(Window.partitionBy(F.lit(1))))  # n_bin rows


def depth_corrector(df: DataFrame, sample: str, value: str) -> DataFrame:
    """Mean over samples of the values at equal coordinates, known ones only, with the number of samples."""
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy("Chromosome", "Start", "End").agg(F.avg(value).alias("corrector"), F.count_distinct(sample).alias("n_samples"))


def onecopy_depth_of(df: DataFrame, depth: str, cng: str, ploidy: float) -> Column:
    """Aggregate: depth of one copy, the length-weighted mean of depth * ploidy / CNg over the ploidy."""
    n = F.when((F.col(cng) > 0) & F.col(depth).isNotNull(), F.col("End") - F.col("Start"))
    return F.sum(F.try_divide(F.col(depth) * ploidy, F.col(cng)) * n) / F.sum(n) / ploidy


def default_germline(contigs: DataFrame, female: bool, par: DataFrame | None = None) -> DataFrame:
    """Chromosome, Start, End, CNg, Bg of a diploid germline: autosomes 2 and 1; X 2 and 1 and Y 0 and 0 in females; in
    males 1 and 0 on X and Y outside the pseudoautosomal regions ``par``, inside them 2 and 1 on X, 0 and 0 on Y."""
    from spanforge.operators.algebra import subtract
    from spanforge.operators.frames import all_regions

    t = all_regions(contigs)
    is_x, is_y = F.col("Chromosome").isin("X", "chrX"), F.col("Chromosome").isin("Y", "chrY")
    auto = t.where(~is_x & ~is_y).select("*", F.lit(2.0).alias("CNg"), F.lit(1.0).alias("Bg"))
    sex = t.where(is_x | is_y)
    pair = lambda d: d.select("Chromosome", "Start", "End", F.when(is_x, 2.0).otherwise(0.0).alias("CNg"), F.when(is_x, 1.0).otherwise(0.0).alias("Bg"))
    if female:
        return auto.unionByName(pair(sex))
    rest = subtract(sex, par) if par is not None else sex
    out = auto.unionByName(rest.select("*", F.lit(1.0).alias("CNg"), F.lit(0.0).alias("Bg")))
    return out.unionByName(pair(par)) if par is not None else out


# ---- distribution of fractions ----


def fraction_peaks(df: DataFrame, keys: list[str], value: str, bandwidth: float = 0.05) -> DataFrame:
    """keys, ndata, center, width, left, right: the highest peak of the density of minor allele fractions per group, with its
    extent at half height; nulls without a peak. Groups hold the points of one segment; values are first counted in steps
    of 0.0005, so a task holds at most 1,001 of them per group, whatever its size."""
    lo, hi, step = -0.05, 0.55, 0.001
    xs = np.arange(lo, hi + step / 2, step)
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    counted = known.groupBy(*keys, F.rint(F.col(value) * 2000).alias("_step")).agg(F.count(F.lit(1)).alias("_n"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.select(*keys).schema.fields) + ", ndata bigint, center double, width double, left double, right double"

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        y = kernel_density(pdf["_step"].to_numpy() / 2000, xs, pdf["_n"].to_numpy(), bandwidth)
        found = peaks(y) if y is not None else []
        head = [*[pdf[k].iloc[0] for k in keys], int(pdf["_n"].sum())]
        if not found:
            row = [*head, None, None, None, None]
        else:
            top, _, a, b = max(found, key=lambda p: p[1])
            row = [*head, xs[top], (b - a) * step, lo + a * step, lo + b * step]
        return pd.DataFrame([row], columns=[*keys, "ndata", "center", "width", "left", "right"])

    return counted.groupBy(*keys).applyInPandas(find, schema)

