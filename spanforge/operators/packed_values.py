"""Splitting fields that hold several values in one string.

Every string is reduced to its *delimiter skeleton*: runs of ordinary characters become one ``a``, while delimiters,
quotes, escapes, brackets and blanks stay. The splitting rule depends on the skeleton alone, so it is resolved once
per distinct skeleton (a table that grows far slower than the data), joined back, and applied by position:
``regexp_extract_all`` cuts the string into the same tokens as the skeleton, and every item is a slice of them.

Defined results: a null, empty or blank field has no items; marks for "missing" and empty slots take a position but
are no values; repeated rows of one key count once (any copy); strings of any length are cut whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.runtime import lookup, materialize

#: Delimiters written as an entity or percent escape, in the order in which they are tried.
ENCODED = ("&amp;", "&#38;", "&#44;", "&#59;", "&#124;", "%2C", "%2c", "%26", "%3B", "%3b", "%7C", "%7c", "%2F", "%2f", "%09")
DELIMITERS = ("&", ",", ";", "|", "/", "\t", "\n", "\r")
BLANKS = "  "
#: What stands for "no value" (compared without regard to case).
MISSING = ("", ".", "-", "NA", "N/A", "nan", "null", "none", "?")

_ENC = "|".join(ENCODED)
_RUN = r'[^&,;|/\t\n\r"\[\]\\ \x{00A0}]'
#: A mark for "no value" that holds a delimiter and stands by itself is one run of ordinary characters.
_MARK = "|".join(rf"(?<!{_RUN})(?i:{re.escape(m)})(?!{_RUN})" for m in MISSING if any(d in m for d in DELIMITERS))
#: One token: an encoded delimiter, an escaped character, a run of ordinary characters, or a single special one.
TOKEN = rf"(?s){_ENC}|\\.|{_MARK}|(?:(?!{_ENC}){_RUN})+|."
_ORDINARY = rf"(?s)({_ENC}|\\.)|(?:{_MARK}|(?:(?!{_ENC}){_RUN})+)"


def skeleton(value: Column) -> Column:
    """The delimiter skeleton; a run of ordinary characters is written as ``\\x01``, special tokens stay."""
    return F.regexp_replace(value, _ORDINARY, "$1\u0001")


def _tokens(skel: str) -> list[str]:
    """Tokens of a skeleton; a special token carries a trailing mark that regexp_replace put behind it."""
    out, i = [], 0
    while i < len(skel):
        c = skel[i]
        enc = next((e for e in ENCODED if skel.startswith(e + "\u0001", i)), None)
        if enc:
            out.append(enc)
            i += len(enc) + 1
        elif c == "\\" and i + 2 < len(skel) and skel[i + 2] == "\u0001":
            out.append(skel[i : i + 2])
            i += 3
        else:
            out.append(c)
            i += 1
    return out


def resolve(skel: str) -> list[tuple[int, int, int, bool]]:
    """The slots of a skeleton: (position from 1, first token from 1, number of tokens, quoted).

    A bracketed list is read inside its brackets. A delimiter inside double quotes is protected; in quotes ``""`` and
    a backslash escape stand for the character itself. A quote that is never closed is an ordinary character.
    """
    toks = _tokens(skel)
    lo, hi = 0, len(toks)
    while lo < hi and toks[lo] in BLANKS:
        lo += 1
    while hi > lo and toks[hi - 1] in BLANKS:
        hi -= 1
    if hi - lo >= 2 and toks[lo] == "[" and toks[hi - 1] == "]":
        lo, hi = lo + 1, hi - 1
    slots: list[tuple[int, int, int, bool]] = []
    start, i = lo, lo

    def close(end: int) -> None:
        a, b = start, end
        while a < b and toks[a] in BLANKS:
            a += 1
        while b > a and toks[b - 1] in BLANKS:
            b -= 1
        quoted = b - a >= 2 and toks[a] == '"' and toks[b - 1] == '"'
        if quoted:
            a, b = a + 1, b - 1
        slots.append((len(slots) + 1, a + 1, b - a, quoted))

    while i < hi:
        t = toks[i]
        if t == '"' and all(x in BLANKS for x in toks[start:i]):
            j = i + 1
            while j < hi and not (toks[j] == '"' and not (j + 1 < hi and toks[j + 1] == '"')):
                j += 2 if toks[j] == '"' else 1
            i = j + 1 if j < hi else i + 1
            continue
        if t in DELIMITERS or t in ENCODED:
            close(i)
            start = i + 1
        i += 1
    close(hi)
    return slots


def _resolve_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["slots"] = [[{"pos": p, "first": f, "len": n, "quoted": q} for p, f, n, q in resolve(s)] for s in pdf["skel"]]
        yield pdf


def split_packed(df: DataFrame, keys: Sequence[str], fields: Sequence[str], min_values: int = 1, missing: Sequence[str] = MISSING) -> DataFrame:
    """One row per value: ``keys``, ``field``, ``pos`` (from 1, empty slots are counted), ``item``.

    ``keys`` identify a row; copies of a row count once. Only fields with at least ``min_values`` values come out.
    Rows whose key holds nulls are kept as a key of their own. Columns other than keys and fields are ignored, so
    clashing names don't matter.
    """
    packed = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields]))
    tall = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], packed.alias("x")).select(*[f"k{i}" for i in range(len(keys))], "x.field", "x.v").where(F.length(F.trim("v")) > 0)
    special = F.col("v").rlike(rf'[&,;|/\t\n\r"\[\]\\%]')
    plain = tall.where(~special)
    tall = tall.where(special).withColumn("skel", skeleton(F.col("v")))
    rules = materialize(tall.select("skel").distinct().mapInPandas(_resolve_batches, "skel string, slots array<struct<pos:int,first:int,len:int,quoted:boolean>>"))
    toks = F.regexp_extract_all("v", F.lit(TOKEN), F.lit(0))

    def item(s: Column) -> Column:
        raw = F.trim(F.array_join(F.slice(F.col("toks"), s["first"], s["len"]), ""))
        return F.struct(s["pos"].alias("pos"), F.when(s["quoted"], F.regexp_replace(F.regexp_replace(raw, '""', '"'), r"\\(.)", "$1")).otherwise(raw).alias("item"))

    low = [m.lower() for m in missing]
    items = F.filter(F.transform("slots", item), lambda x: ~F.lower(F.trim(x["item"])).isin(low))
    cols = [F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]
    out = lookup(tall, rules, ["skel"], ["v"]).withColumn("toks", toks).withColumn("items", items).where(F.size("items") >= min_values)
    out = out.select(*[f"k{i}" for i in range(len(keys))], "field", F.inline("items"))
    if min_values <= 1:
        one = plain.withColumn("item", F.trim("v")).where(~F.lower("item").isin(low))
        out = out.unionByName(one.select(*[f"k{i}" for i in range(len(keys))], "field", F.lit(1).alias("pos"), "item"))
    return out.dropDuplicates([*[f"k{i}" for i in range(len(keys))], "field", "pos"]).select(*cols, "field", "pos", "item")
