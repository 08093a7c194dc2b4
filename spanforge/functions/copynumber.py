"""Column functions of the copy-number model.

Names: CNt, Bt copies in the tumour (all, minor allele); CNg, Bg the same in the germline; c the part of tumour cells
(cellularity, not 0); K the depth of one copy. Defined results: null in, null out; a zero denominator gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanforge.functions.numbers import integer_bounds

Value = Column | float


def _c(x: Value) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clonal_cnt(depth: Value, c: Value, k: Value, cng: Value) -> Column:
    """Whole number of copies (half to even, at least 0) that explains a depth; 0 where the germline has none."""
    depth, c, k, cng = map(_c, (depth, c, k, cng))
    raw = F.try_divide(F.try_divide(depth, k) - cng * (1 - c), c)
    return F.when(cng == 0, F.lit(0.0)).otherwise(F.when(raw.isNotNull(), F.greatest(F.rint(raw) + 0.0, F.lit(0.0))))


def clonal_bt(baf: Value, cnt: Value, c: Value, cng: Value, bg: Value) -> Column:
    """Whole number of copies of the minor allele, from 0 to half of CNt; 0 where the germline has no copy of it."""
    baf, cnt, c, cng, bg = map(_c, (baf, cnt, c, cng, bg))
    rest = F.try_divide(F.lit(1.0), c) - 1
    raw = F.rint(baf * (cnt + cng * rest) - bg * rest) + 0.0
    return F.when((cng == 0) | (bg == 0), F.lit(0.0)).otherwise(F.when(raw.isNotNull() & cnt.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.floor(cnt / 2).cast("double"))))


def predicted_depth(cnt: Value, k: Value, c: Value, cng: Value) -> Column:
    cnt, k, c, cng = map(_c, (cnt, k, c, cng))
    return k * (cng * (1 - c) + cnt * c)


def predicted_baf(cnt: Value, bt: Value, c: Value, cng: Value, bg: Value) -> Column:
    cnt, bt, c, cng, bg = map(_c, (cnt, bt, c, cng, bg))
    return F.try_divide(bt * c + bg * (1 - c), cnt * c + cng * (1 - c))


def onecopy_depth(k: Value, c: Value) -> Column:
    """Difference of depth that one copy more makes."""
    return _c(k) * _c(c)


def onecopy_baf(cnt: Value, c: Value, cng: Value) -> Column:
    cnt, c, cng = map(_c, (cnt, c, cng))
    return F.try_divide(c, cnt * c + cng * (1 - c))


def possible_bafs(cnt: Value, c: Value, cng: Value = 2, bg: Value = 1) -> Column:
    """Predicted fractions for all copies of the minor allele from half of CNt down to 0."""
    cnt = _c(cnt)
    half = F.floor(cnt / 2)
    return F.transform(F.sequence(half, F.lit(0).cast("long"), F.lit(-1).cast("long")), lambda b: predicted_baf(cnt, b.cast("double"), c, cng, bg))


def solve_kc(depth1: Value, cnt1: Value, cng1: Value, depth2: Value, cnt2: Value, cng2: Value) -> Column:
    """struct(k, c) from two depths with known copies; nulls where c is not in (0, 1] or K not above 0."""
    d1, t1, g1, d2, t2, g2 = map(_c, (depth1, cnt1, cng1, depth2, cnt2, cng2))
    raw = F.try_divide(d1 * g2 - d2 * g1, d2 * (t1 - g1) - d1 * (t2 - g2))
    c = F.when((raw > 0) & (raw <= 1), raw)
    k = F.try_divide(d1, g1 + c * (t1 - g1))
    return F.struct(F.when(k > 0, k).alias("k"), c.alias("c"))


def solve_kc_delta(depth: Value, cnt: Value, cng: Value, delta: Value) -> Column:
    """The same from one depth and the difference that one copy makes."""
    return solve_kc(depth, cnt, cng, _c(depth) + _c(delta), _c(cnt) + 1, cng)


def vaf_of_copies(c: Value, cnm: Value, cnt: Value, cng: Value) -> Column:
    """Expected fraction of a mutation on ``cnm`` copies."""
    c, cnm, cnt, cng = map(_c, (c, cnm, cnt, cng))
    return F.try_divide(c * cnm, c * cnt + (1 - c) * cng)


def ccf_of_vaf(vaf: Value, c: Value, cnt: Value, cng: Value) -> Column:
    """Part of the tumour cells that have a mutation on one copy."""
    vaf, c, cnt, cng = map(_c, (vaf, c, cnt, cng))
    return vaf * (cnt + (F.try_divide(F.lit(1.0), c) - 1) * cng)


# ---- ratios of tumour to normal ----


def _lower(c: Column, tumor_ploidy: Column, normal_ploidy: Column) -> Column:
    return c * tumor_ploidy + normal_ploidy * (1 - c)


def depth_ratio(cnt: Value, c: Value, tumor_ploidy: Value, cnn: Value, normal_ploidy: Value, tumor_depth: Value = 1, normal_depth: Value = 1) -> Column:
    cnt, c, tp, cnn, np_, td, nd = map(_c, (cnt, c, tumor_ploidy, cnn, normal_ploidy, tumor_depth, normal_depth))
    return F.try_divide(td * F.try_divide(c * cnt + cnn * (1 - c), _lower(c, tp, np_)), nd * F.try_divide(cnn, np_))


def cnt_of_depth_ratio(ratio: Value, c: Value, tumor_ploidy: Value, cnn: Value, normal_ploidy: Value, tumor_depth: Value = 1, normal_depth: Value = 1) -> Column:
    """The inverse: copies, not rounded."""
    ratio, c, tp, cnn, np_, td, nd = map(_c, (ratio, c, tumor_ploidy, cnn, normal_ploidy, tumor_depth, normal_depth))
    upper = F.try_divide(ratio * nd * F.try_divide(cnn, np_) * _lower(c, tp, np_), td)
    return F.try_divide(upper - cnn * (1 - c), c)


def baf(cnt: Value, b: Value, c: Value, cnn: Value, bn: Value) -> Column:
    cnt, b, c, cnn, bn = map(_c, (cnt, b, c, cnn, bn))
    return F.try_divide(c * (b - bn) + bn, c * (cnt - cnn) + cnn)


def b_of_baf(fraction: Value, c: Value, cnt: Value, cnn: Value, bn: Value) -> Column:
    fraction, c, cnt, cnn, bn = map(_c, (fraction, c, cnt, cnn, bn))
    return fraction * cnt + (F.try_divide(F.lit(1.0), c) - 1) * (fraction * cnn - bn)


def depth_ratio_subclone(clonal: Value, subclonal: Value, ccf: Value, c: Value, tumor_ploidy: Value, cnn: Value, normal_ploidy: Value) -> Column:
    """Ratio where a part ccf of the tumour cells has other copies."""
    clonal, subclonal, ccf = map(_c, (clonal, subclonal, ccf))
    return depth_ratio(clonal * (1 - ccf) + subclonal * ccf, c, tumor_ploidy, cnn, normal_ploidy)


def baf_subclone(clonal: Value, clonal_b: Value, subclonal: Value, subclonal_b: Value, ccf: Value, c: Value, cnn: Value, bn: Value) -> Column:
    clonal, clonal_b, subclonal, subclonal_b, ccf = map(_c, (clonal, clonal_b, subclonal, subclonal_b, ccf))
    return baf(clonal * (1 - ccf) + subclonal * ccf, clonal_b * (1 - ccf) + subclonal_b * ccf, c, cnn, bn)


def ccf_of_depth_ratio(ratio: Value, c: Value, tumor_ploidy: Value, normal_ploidy: Value, clonal: Value, subclonal: Value, cnn: Value) -> Column:
    mean = cnt_of_depth_ratio(ratio, c, tumor_ploidy, cnn, normal_ploidy)
    return F.try_divide(mean - _c(clonal), _c(subclonal) - _c(clonal))


def ccf_of_baf(fraction: Value, c: Value, clonal: Value, subclonal: Value, clonal_b: Value, subclonal_b: Value, cnn: Value, bn: Value) -> Column:
    f, c, t1, t2, b1, b2, cnn, bn = map(_c, (fraction, c, clonal, subclonal, clonal_b, subclonal_b, cnn, bn))
    fixed = f * (c * t1 + cnn * (1 - c)) - (c * b1 + bn * (1 - c))
    return F.try_divide(fixed, c * ((b2 - b1) - f * (t2 - t1)))


def clonal_fit(ratio: Value, fraction: Value, c: Value, tumor_ploidy: Value, cnn: Value, normal_ploidy: Value, bn: Value = 1) -> Column:
    """struct(CNt, B): whole copies nearest to a depth ratio and a fraction."""
    cnt = F.greatest(F.rint(cnt_of_depth_ratio(ratio, c, tumor_ploidy, cnn, normal_ploidy)) + 0.0, F.lit(0.0))
    b = F.rint(b_of_baf(fraction, c, cnt, cnn, bn)) + 0.0
    return F.struct(cnt.alias("CNt"), F.when(b.isNotNull(), F.least(F.greatest(b, F.lit(0.0)), F.floor(cnt / 2).cast("double"))).alias("B"))


def candidate_copies(mean: Column, least: int = 5, fraction: float = 0.5) -> Column:
    """struct(lower, upper): candidates around a mean number of copies, max(least, rint(fraction * mean)) to each side;
    lower ones below 0 are null."""
    bounds, n = integer_bounds(mean), F.greatest(F.lit(least), F.rint(mean * fraction).cast("int"))
    shifts = F.sequence(F.lit(0), n - 1)
    low = F.transform(shifts, lambda i: F.when(bounds["lower"] - i >= 0, bounds["lower"] - i))
    return F.struct(low.alias("lower"), F.transform(shifts, lambda i: bounds["upper"] + i).alias("upper"))


def t_penalty(observed: Value, predicted: Value, std: Value, length: Value, df: int = 5) -> Column:
    """Negative log density of Student's t (scale: deviation over the square root of the length); 0 for a deviation of 0."""
    import math

    x, p, s, n = map(_c, (observed, predicted, std, length))
    scale = s / F.sqrt(n)
    z = F.try_divide(x - p, scale)
    front = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi)
    return F.when(s == 0, F.lit(0.0)).otherwise(-(F.lit(front) - F.log(scale) - F.lit((df + 1) / 2) * F.log(1 + z * z / df)))
