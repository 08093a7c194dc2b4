"""Column functions on alleles and variants: identity, type, trimming, names, break ends, contig names.

Defined results: null in, null out, unless stated; texts of any length are used whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Symbolic alternatives of structural variants and of methylation, and the notation of break ends.
SV_ALTS = ("DEL", "INS", "DUP", "INV", "CNV", "BND", "TRA")
CPGMET = "CPGMET"
SYMBOLIC_SV = rf"^<({'|'.join(SV_ALTS)})(:.+)?>$"
BND_AFTER = r"^([^\[\]]+)([\[\]])([^:]+):([0-9]+)[\[\]]$"
BND_BEFORE = r"^([\[\]])([^:]+):([0-9]+)[\[\]]([^\[\]]+)$"
BASES = r"^[ACGTNacgtn]+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def variant_id(chrom: Column, pos: Column, ref: Column, alts: Column) -> Column:
    """chrom_pos_ref_alt1|alt2; null alternatives are left out."""
    return F.concat_ws("_", chrom, pos.cast("string"), ref, F.array_join(F.array_compact(alts), "|"))


def is_breakend(alt: Column) -> Column:
    return alt.rlike(BND_AFTER) | alt.rlike(BND_BEFORE)


def is_sv_alt(alt: Column) -> Column:
    return alt.rlike(SYMBOLIC_SV) | is_breakend(alt)


def mutation_type(ref: Column, alt: Column) -> Column:
    """snv, mnv, ins, del, delins, sv, cpgmet, overlap_del; ``unknown`` for another symbolic alternative."""
    lr, la = F.length(ref), F.length(alt)
    same = F.substring(ref, 1, 1) == F.substring(alt, 1, 1)
    plain = (
        F.when(lr == la, F.when(lr == 1, "snv").otherwise("mnv"))
        .when((lr == 1) & same, "ins").when((lr > 1) & (la == 1) & same, "del").otherwise("delins")
    )
    return F.when(ref.isNull() | alt.isNull(), F.lit(None)).when(alt.rlike(BASES), plain).when(is_sv_alt(alt), "sv").when(alt == f"<{CPGMET}>", "cpgmet").when(alt == "*", "overlap_del").otherwise("unknown")


def parse_breakend(alt: Column) -> Column:
    """struct(t, mate_chrom, mate_pos, is5, mate_is5) of a break end alternative, null for another one."""
    after = alt.rlike(BND_AFTER)
    g = [F.regexp_extract(alt, BND_AFTER, i) for i in range(5)]
    h = [F.regexp_extract(alt, BND_BEFORE, i) for i in range(5)]
    pick = lambda a, b: F.when(after, a).otherwise(b)
    return F.when(is_breakend(alt), F.struct(
        pick(g[1], h[4]).alias("t"), pick(g[3], h[2]).alias("mate_chrom"), pick(g[4], h[3]).try_cast("long").alias("mate_pos"),
        (~after).alias("is5"), (pick(g[2], h[1]) == "[").alias("mate_is5"),
    ))


def is_first_breakend(idx: Column, pos: Column, mate_idx: Column, mate_pos: Column) -> Column:
    """Whether a break end stands before its mate in contig order; equal places count as first."""
    return compare_coords(idx, pos, mate_idx, mate_pos) <= 0


def compare_coords(idx1: Column, pos1: Column, idx2: Column, pos2: Column) -> Column:
    """-1, 0 or 1 by contig order and position."""
    return F.when((idx1 < idx2) | ((idx1 == idx2) & (pos1 < pos2)), -1).when((idx1 == idx2) & (pos1 == pos2), 0).when(idx1.isNotNull() & idx2.isNotNull() & pos1.isNotNull() & pos2.isNotNull(), 1)


def _common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning: the number of leading positions up to the shorter length that agree."""

    def agreeing(x: Column) -> Column:
        n = F.least(F.length(x["a"]), F.length(x["b"]))
        at = lambda t, i: F.substr(t, i, F.lit(1))
        stop = F.array_position(F.transform(F.sequence(F.lit(1), n), lambda i: at(x["a"], i) == at(x["b"], i)), False).cast("int")
        return F.when(n == 0, 0).when(stop > 0, stop - 1).otherwise(n)

    return let(F.struct(a.alias("a"), b.alias("b")), agreeing)


def parsimonious(pos: Column, ref: Column, alt: Column, base_before: Column | None = None) -> Column:
    """struct(pos, ref, alt) without common beginning and end, with one base kept where an allele would be empty.

    If only the end is common to its whole length, the base before is needed (``base_before``, else ``N``).
    """
    before = base_before if base_before is not None else F.lit("N")

    def trimmed(x: Column) -> Column:
        pos, ref, alt, p, q = (x[c] for c in ("pos", "ref", "alt", "p", "q"))
        short, lr, la, one = F.least(F.length(ref), F.length(alt)), F.length(ref), F.length(alt), F.lit(1)

        def cut(at: Column, n_r: Column, n_a: Column, lead: Column | None = None) -> Column:
            r, a = F.substr(ref, at, n_r), F.substr(alt, at, n_a)
            r, a = (F.concat(lead, r), F.concat(lead, a)) if lead is not None else (r, a)
            return F.struct((pos + (at - 1) - (1 if lead is not None else 0)).cast("long").alias("pos"), r.alias("ref"), a.alias("alt"))

        swallowed = q == short - p  # what is left of the shorter allele is the common end
        return (
            F.when(ref.isNull() | alt.isNull() | pos.isNull(), F.lit(None))
            .when((p == short) & (lr == la), cut(one, one, one))
            .when(p == short, cut(p, lr - p + 1, la - p + 1))
            .when(swallowed & (p > 0), cut(p, lr - q - p + 1, la - q - p + 1))
            .when(swallowed, cut(one, lr - q, la - q, before))
            .otherwise(cut(p + 1, lr - q - p, la - q - p))
        )

    def behind(x: Column) -> Column:
        q = _common_prefix(F.reverse(F.substr(x["ref"], x["p"] + 1)), F.reverse(F.substr(x["alt"], x["p"] + 1)))
        return let(F.struct(*[x[c].alias(c) for c in ("pos", "ref", "alt", "p")], q.alias("q")), trimmed)

    return let(F.struct(pos.alias("pos"), ref.alias("ref"), alt.alias("alt"), _common_prefix(ref, alt).alias("p")), behind)


def diff_seq(ref: Column, alt: Column) -> Column:
    """The inserted or deleted sequence, null for other types."""
    t = mutation_type(ref, alt)
    return F.when(t == "ins", F.substr(alt, F.lit(2))).when(t == "del", F.substr(ref, F.lit(2)))


def hgvsg(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """Genomic name of a substitution, insertion, deletion or both; null for other types."""
    last = pos + F.length(ref) - 1
    s = lambda c: c.cast("string")
    span = lambda a, b: F.when(a == b, s(a)).otherwise(F.concat(s(a), F.lit("_"), s(b)))

    def named(t: Column) -> Column:
        what = (
            F.when(t == "snv", F.concat(s(pos), ref, F.lit(">"), alt))
            .when(t == "mnv", F.concat(s(pos), F.lit("_"), s(last), F.lit("delins"), alt))
            .when(t == "ins", F.concat(s(pos), F.lit("_"), s(pos + 1), F.lit("ins"), F.substr(alt, F.lit(2))))
            .when(t == "del", F.concat(span(pos + 1, last), F.lit("del")))
            .when(t == "delins", F.concat(span(pos, last), F.lit("delins"), alt))
        )
        return F.concat(chrom, F.lit(":g."), what)

    return let(mutation_type(ref, alt), named)


def parse_hgvsg(name: Column) -> Column:
    """struct(chrom, start, end, kind, ref, alt) of a genomic name; null for what is none. kind is snv, del, ins, delins or dup."""
    pattern = r"^([^:]+):g\.([0-9]+)(?:_([0-9]+))?(?:([ACGTN])>([ACGTN])|(delins|del|ins|dup)([ACGTN]*))$"

    def parsed(x: Column) -> Column:
        g = F.split(F.regexp_replace(x, pattern, "$1\t$2\t$3\t$4\t$5\t$6\t$7"), "\t")
        return F.when(x.rlike(pattern), let(g, fields))

    def fields(g: Column) -> Column:
        start = g[1].try_cast("long")
        return F.struct(
            g[0].alias("chrom"), start.alias("start"), F.coalesce(g[2].try_cast("long"), start).alias("end"), F.when(g[3] != "", "snv").otherwise(g[5]).alias("kind"),
            F.nullif(g[3], F.lit("")).alias("ref"), F.when(g[3] != "", g[4]).otherwise(F.nullif(g[6], F.lit(""))).alias("alt"),
        )

    return let(name, parsed)


def flanks(pos: Column, ref: Column, alt: Column, flank: int = 1) -> Column:
    """struct(before_start, before_end, after_start, after_end), 0-based and half-open: the bases beside those that change.
    The base that insertions and deletions keep belongs to the flank before."""
    kept = F.when(mutation_type(ref, alt).isin("ins", "del"), 1).otherwise(0)
    first, end = pos - 1 + kept, pos - 1 + F.length(ref)
    return F.struct((first - flank).cast("long").alias("before_start"), first.cast("long").alias("before_end"), end.cast("long").alias("after_start"), (end + flank).cast("long").alias("after_end"))


def mono_alternatives(df: DataFrame, alts: Sequence[str]) -> DataFrame:
    """One row per alternative: alt and allele_index (from 1) in place of the columns ``alts``."""
    each = F.posexplode(F.array_compact(F.array(*alts)))
    return df.select(*[c for c in df.columns if c not in alts], each.alias("_i", "alt")).withColumn("allele_index", F.col("_i") + 1).drop("_i")


def repeat_units(seq: Column) -> Column:
    """All (unit, count) into which a sequence is a repetition, shorter units first; the whole sequence is the last."""
    n = F.length(seq)
    sizes = F.filter(F.sequence(F.lit(1), n), lambda k: (n % k == 0) & (F.repeat(F.substr(seq, F.lit(1), k), (n / k).cast("int")) == seq))
    return F.when(n > 0, F.transform(sizes, lambda k: F.struct(F.substr(seq, F.lit(1), k).alias("unit"), (n / k).cast("int").alias("count"))))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def to_pyrimidine(base: Column) -> Column:
    return F.when(base.isin("A", "G"), F.translate(base, "AG", "TC")).otherwise(base)


def substitution_class(ref: Column, alt: Column) -> Column:
    """One of the six classes of substitutions (C>A .. T>G); null for what is no substitution of a single base."""
    single = ref.isin("A", "C", "G", "T") & alt.isin("A", "C", "G", "T") & (ref != alt)
    flip = ref.isin("A", "G")
    return F.when(single, F.concat(F.when(flip, F.translate(ref, "AG", "TC")).otherwise(ref), F.lit(">"), F.when(flip, F.translate(alt, "ACGT", "TGCA")).otherwise(alt)))


def normalize_chrom(chrom: Column, strip_chr: bool = False) -> Column:
    """chr001 and 1 become chr1, MT becomes chrM; other names stay. Without ``chr`` if ``strip_chr``."""
    pattern = r"(?i)^(?:chr)?(?:0*([1-9][0-9]*)|([XY]))$"
    core = F.concat(F.regexp_extract(chrom, pattern, 1), F.regexp_extract(chrom, pattern, 2))
    mito = chrom.isin("chrM", "MT")
    if strip_chr:
        return F.when(chrom.rlike(pattern), core).when(mito, "MT").otherwise(chrom)
    return F.when(chrom.rlike(pattern), F.concat(F.lit("chr"), core)).when(mito, "chrM").otherwise(chrom)


def missing_to_null(value: Column) -> Column:
    """The marks for "no value" of variant files ("" and ".") become null."""
    return F.when(~value.isin("", "."), value)


def number_of_values(number: Column, n_alt: Column) -> Column:
    """How many values a field of Number A, R, G or a count holds; null for "."."""
    return F.when(number == "A", n_alt).when(number == "R", n_alt + 1).when(number == "G", ((n_alt + 1) * (n_alt + 2) / 2).cast("long")).otherwise(number.try_cast("long"))


def encode_item(item: Column) -> Column:
    """A struct or map as JSON whose characters with a meaning in variant files are written as percent escapes, the
    percent sign first."""
    out = F.to_json(item)
    for c in "%:;=,":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def decode_item(text: Column, schema: str) -> Column:
    out = text
    for c in ",=;:%":
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return F.from_json(out, schema)


def typed_text(text: Column) -> Column:
    """struct(kind, integer, number, flag): the type that a text stands for: none, bool, int, float or str."""
    i, d = text.rlike(r"^[+-]?[0-9]+$"), text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    kind = F.when(text == "None", "none").when(text.isin("True", "False"), "bool").when(i, "int").when(d, "float").when(text.isNotNull(), "str")
    return F.struct(kind.alias("kind"), F.when(i, text.try_cast("long")).alias("integer"), F.when(d, text.try_cast("double")).alias("number"), F.when(text.isin("True", "False"), text == "True").alias("flag"))


# ---- with reference sequence ----


def _moved(seq: Column, flank: Column, right: bool) -> Column:
    """How far an inserted or deleted sequence can be moved along a flank: as long as the base that it leaves behind is the
    one that it takes in."""
    parts = F.struct(F.concat(seq, flank).alias("text") if right else F.concat(flank, seq).alias("text"), F.length(seq).alias("k"), F.length(flank).alias("n"))

    def far(x: Column) -> Column:
        base = lambda i: F.substr(x["text"], i.cast("int"), F.lit(1))
        if right:
            same = F.transform(F.sequence(F.lit(1), x["n"]), lambda j: base(j) == base(j + x["k"]))
        else:
            same = F.transform(F.sequence(F.lit(0), x["n"] - 1), lambda j: base(x["n"] - j) == base(x["n"] - j + x["k"]))
        stop = F.array_position(same, False).cast("int")
        return F.when(x["n"] == 0, 0).when(stop > 0, stop - 1).otherwise(x["n"])

    return let(parts, far)


def shift_left(pos: Column, ref: Column, alt: Column, before: Column) -> Column:
    """struct(pos, ref, alt, complete): an insertion or deletion with one kept base, moved as far to the left as the
    reference allows. ``before`` is the reference that ends with the kept base; complete is false where it was used up (a
    longer one may move it farther). Other variants stay."""
    seq = diff_seq(ref, alt)
    n, k = F.length(before), F.length(seq)

    def moved(m: Column) -> Column:
        # one base of the flank has to stay as the kept one
        m = F.least(m, n - 1)
        kept = F.substr(before, (n - m).cast("int"), F.lit(1))
        new = F.substr(F.concat(before, seq), (n - m + 1).cast("int"), k)
        is_ins = F.length(alt) > F.length(ref)
        return F.struct((pos - m).cast("long").alias("pos"), F.when(is_ins, kept).otherwise(F.concat(kept, new)).alias("ref"), F.when(is_ins, F.concat(kept, new)).otherwise(kept).alias("alt"), (m < n - 1).alias("complete"))

    stay = F.struct(pos.cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt"), F.lit(True).alias("complete"))
    return F.when(seq.isNull() | (n == 0) | n.isNull(), stay).otherwise(let(_moved(seq, before, False), moved))


def shift_right(pos: Column, ref: Column, alt: Column, after: Column) -> Column:
    """The same to the right; ``after`` is the reference behind the last base of REF."""
    seq = diff_seq(ref, alt)
    n, k = F.length(after), F.length(seq)

    def moved(m: Column) -> Column:
        is_ins = F.length(alt) > F.length(ref)
        text = F.concat(F.substr(ref, F.lit(1), F.lit(1)), seq, after)
        kept, new = F.substr(text, (m + 1).cast("int"), F.lit(1)), F.substr(text, (m + 2).cast("int"), k)
        return F.struct((pos + m).cast("long").alias("pos"), F.when(is_ins, kept).otherwise(F.concat(kept, new)).alias("ref"), F.when(is_ins, F.concat(kept, new)).otherwise(kept).alias("alt"), (m < n).alias("complete"))

    stay = F.struct(pos.cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt"), F.lit(True).alias("complete"))
    return F.when(seq.isNull() | n.isNull(), stay).otherwise(let(_moved(seq, after, True), moved))


def equivalents(pos: Column, ref: Column, alt: Column, before: Column, after: Column) -> Column:
    """Array of struct(pos, ref, alt): all places of an insertion or deletion that give the same sequence, from left to right."""
    seq = diff_seq(ref, alt)

    def every(x: Column) -> Column:
        def at(m: Column) -> Column:
            kept, new = F.substr(x["text"], (x["n"] + m).cast("int"), F.lit(1)), F.substr(x["text"], (x["n"] + m + 1).cast("int"), x["k"])
            both = F.concat(kept, new)
            return F.struct((x["pos"] + m).cast("long").alias("pos"), F.when(x["ins"], kept).otherwise(both).alias("ref"), F.when(x["ins"], both).otherwise(kept).alias("alt"))

        return F.transform(F.sequence(-x["l"], x["r"]), at)

    ends = F.struct(
        F.least(_moved(seq, before, False), F.length(before) - 1).alias("l"), _moved(seq, after, True).alias("r"), F.concat(before, seq, after).alias("text"), F.length(seq).alias("k"),
        F.length(before).alias("n"), pos.alias("pos"), (F.length(alt) > F.length(ref)).alias("ins"),
    )
    alone = F.array(F.struct(pos.cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt")))
    return F.when(seq.isNull() | (F.length(before) == 0), alone).otherwise(let(ends, every))


def merge_alleles(pos1: Column, ref1: Column, alt1: Column, pos2: Column, ref2: Column, alt2: Column, span: Column) -> Column:
    """struct(pos, ref, alts): two variants of different haplotypes as one record. ``span`` is the reference from the lesser
    position to the greater end."""
    pos = F.least(pos1, pos2)

    def drawn(p: Column, r: Column, a: Column) -> Column:
        head = F.substr(span, F.lit(1), (p - pos).cast("int"))
        return F.concat(head, a, F.substr(span, (p - pos + F.length(r) + 1).cast("int")))

    first = (pos1 < pos2) | ((pos1 == pos2) & (alt1 <= alt2))
    a, b = drawn(pos1, ref1, alt1), drawn(pos2, ref2, alt2)
    return F.struct(pos.alias("pos"), span.alias("ref"), F.array_distinct(F.when(first, F.array(a, b)).otherwise(F.array(b, a))).alias("alts"))


def concat_alleles(pos1: Column, ref1: Column, alt1: Column, pos2: Column, ref2: Column, alt2: Column, between: Column) -> Column:
    """struct(pos, ref, alt): two variants of one haplotype, the second behind the first, as one; ``between`` is the reference
    between them. Null where they overlap."""
    ok = pos1 + F.length(ref1) <= pos2
    return F.when(ok, F.struct(pos1.alias("pos"), F.concat(ref1, between, ref2).alias("ref"), F.concat(alt1, between, alt2).alias("alt")))


def repeat_around(unit: Column, before: Column, after: Column) -> Column:
    """struct(left, right): how often a unit stands directly before and behind a place."""

    def both(x: Column) -> Column:
        k = F.length(x["unit"])

        def times(flank: Column, back: bool) -> Column:
            n = F.floor(F.length(flank) / k).cast("int")
            piece = lambda i: F.substr(flank, (F.length(flank) - (i + 1) * k + 1 if back else i * k + 1).cast("int"), k)
            same = F.transform(F.sequence(F.lit(0), n - 1), lambda i: piece(i) == x["unit"])
            stop = F.array_position(same, False).cast("int")
            return F.when((n <= 0) | (k == 0), 0).when(stop > 0, stop - 1).otherwise(n)

        return F.struct(times(x["before"], True).alias("left"), times(x["after"], False).alias("right"))

    return let(F.struct(unit.alias("unit"), before.alias("before"), after.alias("after")), both)


def microhomology(left_of_1: Column, right_of_1: Column, left_of_2: Column, right_of_2: Column) -> Column:
    """struct(length, sequence): bases by which the break ends of a join left(1) | right(2) can be moved without changing the
    joined sequence: to the right while the base behind 1 is the one behind 2, to the left while those before agree."""
    n = F.least(F.length(right_of_1), F.length(right_of_2))
    fwd = _common_prefix(F.substr(right_of_1, F.lit(1), n), right_of_2)
    back = _common_prefix(F.reverse(left_of_1), F.reverse(left_of_2))
    seq = F.concat(F.reverse(F.substr(F.reverse(left_of_1), F.lit(1), back)), F.substr(right_of_1, F.lit(1), fwd))
    return F.struct((fwd + back).alias("length"), seq.alias("sequence"))
