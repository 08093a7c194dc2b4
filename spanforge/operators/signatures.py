"""Mutational catalogues and signatures.

A catalogue is tall (sample, class, n). Fitting runs per sample on a vector of as many entries as there are classes; the
signature matrix (classes x signatures, some hundred kilobytes) is a parameter. Defined results: unknown classes are left
out; a sample without mutations has exposures of 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.functions.alleles import reverse_complement

SUBSTITUTIONS = ("C>A", "C>G", "C>T", "T>A", "T>C", "T>G")
#: Signatures that are artefacts of sequencing, and groups that are taken together.
ARTEFACTS = (
    "SBS27", "SBS43", "SBS45", "SBS46", "SBS47", "SBS48", "SBS49", "SBS50", "SBS51", "SBS52", "SBS53", "SBS54", "SBS55", "SBS56", "SBS57", "SBS58", "SBS59", "SBS60", "SBS95",
)
CONNECTED = (("SBS2", "SBS13"), ("SBS7a", "SBS7b", "SBS7c", "SBS7d"), ("SBS10a", "SBS10b"), ("SBS17a", "SBS17b"))


def sbs96_keys() -> list[str]:
    """The 96 classes, in order of substitution and flanking bases."""
    return [f"{a}[{s}]{b}" for s in SUBSTITUTIONS for a in "ACGT" for b in "ACGT"]


def sbs96_class(context: Column, alt: Column) -> Column:
    """Class of a substitution in its three bases; null for what is none."""
    ok = context.rlike("^[ACGT]{3}$") & alt.rlike("^[ACGT]$") & (F.substring(context, 2, 1) != alt)
    flip = F.substring(context, 2, 1).isin("A", "G")
    c, a = F.when(flip, reverse_complement(context)).otherwise(context), F.when(flip, reverse_complement(alt)).otherwise(alt)
    return F.when(ok, F.concat(F.substring(c, 1, 1), F.lit("["), F.substring(c, 2, 1), F.lit(">"), a, F.lit("]"), F.substring(c, 3, 1)))


def catalogue(df: DataFrame, sample: str, key: Column, keys: Sequence[str]) -> DataFrame:
    """sample, class, n with zeros for classes that a sample lacks."""
    n = df.withColumn("class", key).where(F.col("class").isin(list(keys))).groupBy(sample, "class").agg(F.count(F.lit(1)).alias("n"))
    every = df.select(sample).distinct().select(sample, F.explode(F.array(*[F.lit(k) for k in keys])).alias("class"))
    t = n.withColumnsRenamed({sample: "_s", "class": "_c"})
    return every.join(t, every[sample].eqNullSafe(t["_s"]) & (every["class"] == t["_c"]), "left").select(sample, "class", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def merge_signatures(exposures: DataFrame, groups: Mapping[str, str], sample: str = "sample") -> DataFrame:
    """sample, signature, n with signatures of one group added up under its name."""
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])[F.col("signature")], F.col("signature"))
    return exposures.groupBy(sample, name.alias("signature")).agg(F.sum("n").alias("n"))


def artefact_burden(exposures: DataFrame, sample: str = "sample", artefacts: Sequence[str] = ARTEFACTS) -> DataFrame:
    """sample, burden, fraction: mutations of artefact signatures."""
    bad = F.sum(F.when(F.col("signature").isin(list(artefacts)), F.col("n")).otherwise(0))
    return exposures.groupBy(sample).agg(bad.alias("burden"), F.try_divide(bad, F.sum("n")).alias("fraction"))


def with_connected(names: Sequence[str], known: Sequence[str]) -> list[str]:
    """``names`` and the known signatures of every group of which one is among them."""
    out = set(names)
    for group in CONNECTED:
        if out & set(group):
            out |= set(group) & set(known)
    return [k for k in known if k in out]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares under x >= 0, by the active set method."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    w = a.T @ b
    for _ in range(10 * n + 10):
        if passive.all() or w[~passive].max(initial=-np.inf) <= 1e-10 * max(1.0, np.abs(a.T @ b).max()):
            break
        passive[np.argmax(np.where(passive, -np.inf, w))] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            if z[passive].min(initial=1) > 0:
                x = z
                break
            low = passive & (z <= 0)
            step = (x[low] / np.maximum(x[low] - z[low], 1e-300)).min()
            x = x + step * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
        w = a.T @ (b - a @ x)
    return x


def fit(sigs: np.ndarray, genome: np.ndarray) -> tuple[np.ndarray, float]:
    """(whole exposures that add up to the mutations, relative distance)."""
    total = genome.sum()
    if not total or not sigs.shape[1]:
        return np.zeros(sigs.shape[1]), 0.0 if not total else 1.0
    w = nnls(sigs, genome.astype(float))
    if not w.sum():
        return np.zeros(sigs.shape[1]), 1.0
    e = np.rint(w / w.sum() * total)
    e[int(np.argmax(e))] += total - e.sum()
    return e, float(np.linalg.norm(genome - sigs @ e) / np.linalg.norm(genome))


def assign(sigs: np.ndarray, genome: np.ndarray, names: Sequence[str], background: Sequence[str] = (), add_penalty: float = 0.05, remove_penalty: float = 0.01) -> tuple[dict[str, float], float]:
    """Stepwise choice: signatures whose loss raises the distance by no more than ``remove_penalty`` go, then those come in
    that lower it by more than ``add_penalty``; connected ones come together, those of the background stay."""
    index = {n: i for i, n in enumerate(names)}

    def distance(chosen: Sequence[str]) -> float:
        return fit(sigs[:, [index[n] for n in chosen]], genome)[1]

    chosen = with_connected(list(names), names)
    now = distance(chosen)
    while True:
        trials = [(distance([c for c in chosen if c != n]), n) for n in chosen if n not in background]
        if not trials or min(trials)[0] - now > remove_penalty:
            break
        now, gone = min(trials)
        chosen.remove(gone)
    while True:
        trials = [(distance(with_connected([*chosen, n], names)), n) for n in names if n not in chosen]
        if not trials or now - min(trials)[0] <= add_penalty:
            break
        now, new = min(trials)
        chosen = with_connected([*chosen, new], names)
    e, d = fit(sigs[:, [index[n] for n in chosen]], genome)
    return {n: float(x) for n, x in zip(chosen, e, strict=True) if x}, d


def fit_catalogues(cat: DataFrame, signatures: pd.DataFrame, stepwise: bool = False, sample: str = "sample") -> DataFrame:
    """sample, signature, n, distance of catalogues (sample, class, n) by a matrix with classes as index."""
    classes, names, m = list(signatures.index), list(signatures.columns), signatures.to_numpy(float)
    where = {c: i for i, c in enumerate(classes)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros(len(classes))
        for c, n in zip(pdf["class"], pdf["n"], strict=True):
            if c in where:
                g[where[c]] += n
        if stepwise:
            found, d = assign(m, g, names)
        else:
            e, d = fit(m, g)
            found = dict(zip(names, e, strict=True))
        return pd.DataFrame([(pdf[sample].iloc[0], n, int(x), d) for n, x in found.items()], columns=[sample, "signature", "n", "distance"])

    return cat.groupBy(sample).applyInPandas(run, f"`{sample}` {cat.schema[sample].dataType.simpleString()}, signature string, n bigint, distance double")


def probabilities(exposures: DataFrame, signatures: DataFrame, sample: str = "sample") -> DataFrame:
    """sample, class, signature, p: part of each signature (class, signature, weight) in the mutations of a class."""
    t = exposures.join(signatures, "signature").withColumn("_x", F.col("n") * F.col("weight"))
    total = t.groupBy(sample, "class").agg(F.sum("_x").alias("_t")).withColumnsRenamed({sample: "_s", "class": "_c"})
    j = t.join(total, t[sample].eqNullSafe(total["_s"]) & (t["class"] == total["_c"]))
    return j.select(sample, "class", "signature", F.try_divide("_x", "_t").alias("p"))


def similarities(a: Column, b: Column) -> dict[str, Column]:
    """Aggregates over classes of two counts: cosine, l1, l2 (relative), kl divergence and correlation."""
    x, y = a.cast("double"), b.cast("double")
    return {
        "cosine": F.try_divide(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))), "l1": F.try_divide(F.sum(F.abs(x - y)), F.sum(F.abs(x))),
        "l2": F.try_divide(F.sqrt(F.sum((x - y) * (x - y))), F.sqrt(F.sum(x * x))), "correlation": F.corr(x, y),
    }


def bootstrap(counts: np.ndarray, seed: int) -> np.ndarray:
    """Counts drawn anew from their own distribution, with the same total."""
    total = int(counts.sum())
    return np.random.default_rng(seed).multinomial(total, counts / total) if total else counts.copy()


def nmf(x: np.ndarray, rank: int, seed: int = 0, steps: int = 2000, tolerance: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative factors (classes x rank with columns of sum 1, rank x samples) by multiplicative updates for the
    Kullback-Leibler divergence. The matrix has a row per class, so it is as small as the number of samples allows."""
    rng = np.random.default_rng(seed)
    n, m = x.shape
    w, h = rng.random((n, rank)) + 0.1, rng.random((rank, m)) + 0.1
    last = np.inf
    for i in range(steps):
        h *= (w.T @ (x / np.maximum(w @ h, 1e-12))) / w.sum(0)[:, None]
        w *= ((x / np.maximum(w @ h, 1e-12)) @ h.T) / h.sum(1)[None, :]
        if i % 20 == 19:
            wh = np.maximum(w @ h, 1e-12)
            d = float((np.where(x > 0, x * np.log(np.maximum(x, 1e-12) / wh), 0) - x + wh).sum())
            if last - d <= tolerance * max(abs(last), 1) and np.isfinite(last):
                break
            last = d
    s = w.sum(0)
    return w / s, h * s[:, None]


def id83_class(ref: Column, alt: Column, before: Column, after: Column) -> Column:
    """One of the 83 classes of insertions and deletions: size, kind, base or repeat (R) or microhomology (M), and number.
    ``before`` ends with the kept base, ``after`` begins behind REF."""
    from spanforge.functions.alleles import diff_seq, let, microhomology, repeat_around, to_pyrimidine

    seq, is_ins = diff_seq(ref, alt), F.length(alt) > F.length(ref)
    n = F.length(seq)
    size = F.when(n >= 5, "5+").otherwise(n.cast("string"))
    capped = lambda k: F.when(k >= 5, "5+").otherwise(k.cast("string"))

    def named(x: Column) -> Column:
        k = x["r"]["left"] + x["r"]["right"]  # units beside the inserted or deleted ones
        single = F.concat(F.lit("1:"), F.when(is_ins, "Ins:").otherwise("Del:"), to_pyrimidine(seq), F.lit(":"), capped(k))
        repeat = F.concat(size, F.when(is_ins, F.lit(":Ins:R:")).otherwise(F.lit(":Del:R:")), capped(k))
        homology = F.least(x["m"], n - 1)
        micro = F.concat(size, F.lit(":Del:M:"), capped(homology))
        return F.when(n == 1, single).when(~is_ins & (k == 0) & (homology > 0), micro).otherwise(repeat)

    # bases that the deleted sequence has in common with what follows it, or with what stands before it
    gone = F.greatest(microhomology(F.lit(""), seq, F.lit(""), after)["length"], microhomology(before, F.lit(""), seq, F.lit(""))["length"])
    parts = F.struct(repeat_around(seq, before, after).alias("r"), gone.alias("m"))
    return F.when(n > 0, let(parts, named))


def id83_keys() -> list[str]:
    """The 83 classes."""
    n = ["0", "1", "2", "3", "4", "5+"]
    one = [f"1:{k}:{b}:{i}" for k in ("Del", "Ins") for b in "CT" for i in n]
    more = [f"{s}:{k}:R:{i}" for k in ("Del", "Ins") for s in ("2", "3", "4", "5+") for i in n]
    most = {"2": ["1"], "3": ["1", "2"], "4": ["1", "2", "3"], "5+": ["1", "2", "3", "4", "5+"]}
    return one + more + [f"{s}:Del:M:{i}" for s, k in most.items() for i in k]


def catalogue_type(classes: Sequence[str]) -> str | None:
    """sbs96, sbs6, id83 or cn48 by the set of classes; None for another one."""
    from spanforge.operators.structural import cn48_features

    known = {"sbs96": sbs96_keys(), "sbs6": SUBSTITUTIONS, "id83": id83_keys(), "cn48": cn48_features()}
    return next((k for k, v in known.items() if set(v) == set(classes)), None)


def bootstrap_catalogues(cat: DataFrame, seed: int = 0, sample: str = "sample") -> DataFrame:
    """Catalogues (sample, class, n) drawn anew per sample; the draw depends on the seed and the sample alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        p = pdf.sort_values("class")
        return p.assign(n=bootstrap(p["n"].to_numpy(), seed + zlib.crc32(str(p[sample].iloc[0]).encode())))

    return cat.groupBy(sample).applyInPandas(run, cat.schema)
