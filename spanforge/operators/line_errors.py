"""Loading tab-separated interval lines and separating those that cannot be loaded, with the reason.

Minimum-cost error parse. A line is reduced to its *shape* (runs of characters other than tab and double quote become
``x``); per distinct shape and expected number of fields a dynamic program finds the cheapest edit script that makes
the line parse: inserting or deleting a quote, and (strictly cheaper) inserting or deleting a delimiter. Lines of cost
zero whose values pass the type rules load; for the others the edit operations state the reason. The table of shapes
is far smaller than the lines, is resolved once and joined back; fields are then cut by position inside the JVM.

Defined results: a null line is no data; empty and blank lines, comments, track/browser lines and headers are no data;
every line stands for itself, so repeated lines are judged separately; a line whose file is not listed has no layout
and comes out with reason ``column_count``; lines of any length are parsed whole. Input columns are renamed inside, so
extra columns with clashing names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.runtime import lookup, materialize

REASONS = ("quoting", "column_count", "invalid_value")
_TOKEN = r'(?s)\t|"|[^\t"]+'
_START, _PLAIN, _QUOTED, _AFTER = range(4)
_ENDS = ("chrom", "start", "end", "strand")


def _step(state: int, t: str) -> tuple[int, bool] | None:
    """Next state and whether a field ends, without an edit; None where the grammar has no such move."""
    if state == _QUOTED:
        return (_AFTER, False) if t == '"' else (_QUOTED, False)
    if t == "\t":
        return _START, True
    if t == '"':
        return {_START: (_QUOTED, False), _AFTER: (_QUOTED, False)}.get(state)
    return (_PLAIN, False) if state in (_START, _PLAIN) else None


_FAR = 1 << 60
#: (from, to) of inserting a quote before the next symbol.
_INSERTS = ((_START, _QUOTED), (_AFTER, _QUOTED), (_QUOTED, _AFTER))


def parse(shape: str, n_fields: int) -> tuple[int, int, list[tuple[str, int]]]:
    """(quote edits, delimiter edits, edit operations) of the cheapest script.

    One pass: of every state only the least number of quote edits is kept, as a cheapest path has a cheapest prefix at
    every state on its way. Quote edits weigh more than any number of delimiter edits; ``reach[s]`` is the set of field
    counts with which state ``s`` is reached at its least cost, kept as the bits of an integer, so that the delimiter
    edits that remain are the distance from the wanted count to the nearest set bit.

    An operation is its kind and the symbol of the shape (from 1) that it deletes or stands before; the quote edits are
    those of one cheapest path, the delimiter edits are made at the end of the line.
    """
    cost, reach = [0, _FAR, _FAR, _FAR], [1, 0, 0, 0]
    back: list[list[tuple[int, str] | None]] = []  # per position and state: the state before, and the edit

    def insert(trace: list[tuple[int, str] | None]) -> None:
        for a, b in _INSERTS:
            if cost[a] + 1 < cost[b]:
                cost[b], reach[b], trace[b] = cost[a] + 1, reach[a], (a, "insert_quote")
            elif cost[a] + 1 == cost[b] < _FAR:
                reach[b] |= reach[a]

    trace: list[tuple[int, str] | None] = [None] * 4
    insert(trace)
    back.append(trace)
    for t in shape:
        was, had = cost, reach
        cost, reach, trace = [_FAR] * 4, [0] * 4, [None] * 4
        for s in range(4):
            if was[s] >= _FAR:
                continue
            moves = [(to[0], 0, had[s] << 1 if to[1] else had[s], "")] if (to := _step(s, t)) is not None else []
            if t == '"':
                moves.append((s, 1, had[s], "delete_quote"))
            for b, edits, bits, op in moves:
                if was[s] + edits < cost[b]:
                    cost[b], reach[b], trace[b] = was[s] + edits, bits, (s, op)
                elif was[s] + edits == cost[b]:
                    reach[b] |= bits
        insert(trace)
        back.append(trace)

    ends = (_START, _PLAIN, _AFTER)
    quotes = min(cost[s] for s in ends)
    bits, counts = 0, []
    for s in ends:
        if cost[s] == quotes:
            bits |= reach[s]
    # the set bit that is nearest to the wanted one
    below, above = bits & ((2 << (n_fields - 1)) - 1 if n_fields > 0 else 0), bits >> max(n_fields, 0)
    if below:
        counts.append(below.bit_length())
    if above:
        counts.append(max(n_fields, 0) + (above & -above).bit_length())
    count = min(counts, key=lambda k: (abs(k - n_fields), k))
    ops: list[tuple[str, int]] = []
    if quotes:
        s, i = next(s for s in ends if cost[s] == quotes), len(shape)
        while i > 0 or back[0][s] is not None:
            before, op = back[i][s]
            if op:
                ops.append((op, i if op == "delete_quote" else i + 1))
            if op != "insert_quote":
                i -= 1
            s = before
    ops.reverse()
    ops += [("delete_delimiter" if count > n_fields else "insert_delimiter", len(shape) + 1)] * (abs(count - n_fields) if n_fields >= 0 else 0)
    return quotes, abs(count - n_fields), ops


def field_slices(shape: str) -> list[tuple[int, int, bool]]:
    """(first token from 1, number of tokens, quoted) of each field of a shape that parses without quote edits."""
    out, start, state = [], 0, _START
    for i, t in enumerate([*shape, "\t"]):
        if t == "\t" and state != _QUOTED:
            quoted = i - start >= 2 and shape[start] == '"' and shape[i - 1] == '"'
            out.append((start + 2, i - start - 2, True) if quoted else (start + 1, i - start, False))
            start, state = i + 1, _START
        else:
            state = (_step(state, t) or (state, False))[0]
    return out


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for shape, n in zip(pdf["shape"], pdf["n_columns"], strict=True):
            q, d, ops = parse(shape, int(n))
            ok = q == d == 0
            rows.append((shape, n, q, d, [{"first": a, "len": b, "quoted": c} for a, b, c in field_slices(shape)] if ok else None, [{"op": o, "at": i} for o, i in ops]))
        yield pd.DataFrame(rows, columns=["shape", "n_columns", "quote_edits", "delimiter_edits", "slices", "edits"])


def is_data(line: Column, column_list: Column) -> Column:
    """Whether a line (without its carriage return) is a data line of a file with these columns."""
    return (F.length(F.regexp_replace(line, r"\s", "")) > 0) & ~line.rlike(r"^(#|(track|browser)(\s|\z))") & (F.translate(line, "\t", ",") != F.coalesce(column_list, F.lit("")))


def parse_lines(lines: DataFrame, files: DataFrame, contigs: DataFrame) -> DataFrame:
    """Data lines with their verdict.

    lines: file_id, line_no, line. files: file_id, kind, column_list, n_columns. contigs: chrom, chr_name, length.
    Returns file_id, line_no, kind, column_list, fields (null unless the line parses), quote_edits, delimiter_edits, edits, reason
    (null for lines that load, else one of REASONS).
    """
    fl = files.select(F.col("file_id").alias("file_id"), "kind", "column_list", "n_columns").dropDuplicates(["file_id"])
    body = lines.select("file_id", "line_no", F.regexp_replace("line", r"\r\z", "").alias("line")).where(F.col("line").isNotNull())
    data = body.join(fl, "file_id", "left").where(is_data(F.col("line"), F.col("column_list")))
    data = data.withColumn("n_columns", F.coalesce("n_columns", F.lit(-1)))

    data = data.withColumn("shape", F.regexp_replace("line", r'[^\t"]+', "x"))
    shapes = materialize(data.select("shape", "n_columns").distinct().mapInPandas(_resolve, "shape string, n_columns int, quote_edits int, delimiter_edits int, slices array<struct<first:int,len:int,quoted:boolean>>, edits array<struct<op:string,at:int>>"))
    toks = F.regexp_extract_all("line", F.lit(_TOKEN), F.lit(0))

    def value(s: Column) -> Column:
        raw = F.array_join(F.slice(F.col("toks"), s["first"], s["len"]), "")
        return F.when(s["quoted"], F.replace(raw, F.lit('""'), F.lit('"'))).otherwise(raw)

    # only the cutting differs: where no quote stands, the slices are what lies between the tabs
    resolved = lookup(data, shapes, ["shape", "n_columns"], ["file_id", "line_no"])
    cut = F.when(F.instr("line", '"') == 0, F.split("line", "\t")).otherwise(F.transform("slices", value))
    resolved = resolved.withColumn("toks", F.when(F.instr("line", '"') > 0, toks))
    return _typed(resolved.select("file_id", "line_no", "kind", "column_list", F.when(F.col("slices").isNotNull(), cut).alias("fields"), "quote_edits", "delimiter_edits", "edits"), contigs)


def _at(name: str) -> Column:
    """The field of this name, null where the layout has none."""
    p = F.array_position(F.split("column_list", ","), name)
    return F.when(p > 0, F.try_element_at("fields", p.cast("int")))


def _typed(parsed: DataFrame, contigs: DataFrame) -> DataFrame:
    names, at = F.split("column_list", ","), _at

    first, second = F.coalesce(at("chrom"), at("chrom1")), at("chrom2")
    known = contigs.select(F.explode(F.array_distinct(F.array("chrom", "chr_name"))).alias("name"), "length").where(F.col("name").isNotNull()).groupBy("name").agg(F.max("length").alias("length"))
    out = parsed.withColumns({"c1": first, "c2": second, "strands": F.array_compact(F.array(at("strand"), at("strand1"), at("strand2")))})
    for i in ("1", "2"):
        out = out.withColumns({f"s{i}": F.coalesce(at("start"), at("start1")) if i == "1" else at("start2"), f"e{i}": F.coalesce(at("end"), at("end1")) if i == "1" else at("end2")})
        out = out.join(known.select(F.col("name").alias(f"c{i}"), F.col("length").alias(f"len{i}")), f"c{i}", "left")

    def span_ok(i: str) -> Column:
        s, e = F.col(f"s{i}"), F.col(f"e{i}")
        sn, en = s.try_cast("decimal(38,0)"), e.try_cast("decimal(38,0)")
        return F.col(f"len{i}").isNotNull() & F.coalesce(s.rlike(r"^[0-9]+\z") & e.rlike(r"^[0-9]+\z") & (sn <= en) & (en <= F.col(f"len{i}")), F.lit(False))

    paired = F.array_contains(names, "chrom2")
    strand_ok = F.forall("strands", lambda x: x.isin("+", "-") | (~paired & (x == ".")))
    valid = span_ok("1") & (~paired | span_ok("2")) & strand_ok
    reason = F.when(F.col("quote_edits") > 0, REASONS[0]).when(F.col("delimiter_edits") > 0, REASONS[1]).when(F.coalesce(valid, F.lit(False)), F.lit(None)).otherwise(REASONS[2])
    return out.select("file_id", "line_no", "kind", "column_list", "fields", "quote_edits", "delimiter_edits", "edits", reason.alias("reason"))


def rejected(parsed: DataFrame) -> DataFrame:
    """file_id, line_no, reason of the lines that cannot be loaded."""
    return parsed.where(F.col("reason").isNotNull()).select("file_id", "line_no", "reason")


def edit_scripts(parsed: DataFrame) -> DataFrame:
    """file_id, line_no, reason, edits of the lines that do not parse: edits are texts like ``insert_quote@3``, the
    symbols of the line's shape being counted from 1, with the number of times where an edit is repeated at its place."""
    ops = parsed.where(F.size("edits") > 0).select("file_id", "line_no", "reason", F.posexplode("edits").alias("i", "x")).select("file_id", "line_no", "reason", "i", "x.*")
    same = ops.groupBy("file_id", "line_no", "reason", "op", "at").agg(F.min("i").alias("i"), F.count(F.lit(1)).alias("n"))
    text = F.concat(F.when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" "))).otherwise(F.lit("")), "op", F.lit("@"), F.col("at").cast("string"))
    return same.groupBy("file_id", "line_no", "reason").agg(F.sort_array(F.collect_list(F.struct("i", text.alias("t")))).alias("e")).select("file_id", "line_no", "reason", F.array_join(F.transform("e", lambda x: x["t"]), ", ").alias("edits"))


def loaded(parsed: DataFrame, kind: str, column_list: str) -> DataFrame:
    """The lines of one kind and layout that load, as a typed table."""
    names = column_list.split(",")
    types = {n: "bigint" for n in names if n.rstrip("12") in ("start", "end")}
    rows = parsed.where(F.col("reason").isNull() & (F.col("kind") == kind) & (F.col("column_list") == column_list))
    return rows.select("file_id", "line_no", *[F.element_at("fields", i + 1).cast(types.get(n, "string")).alias(n) for i, n in enumerate(names)])


def loaded_all(parsed: DataFrame) -> DataFrame:
    """The lines of every kind and layout that load, as one table.

    file_id, line_no, kind, column_list, the typed fields of both ends (bed has only the first), and ``others``, the
    remaining fields with their names in the order of the line; these are free, so they stay text.
    """
    rows = parsed.where(F.col("reason").isNull())
    ends = [F.coalesce(_at(n), _at(f"{n}1")).cast("bigint" if n in ("start", "end") else "string").alias(f"{n}1") for n in _ENDS]
    ends += [_at(f"{n}2").cast("bigint" if n in ("start", "end") else "string").alias(f"{n}2") for n in _ENDS]
    known = [x for n in _ENDS for x in (n, f"{n}1", f"{n}2")]
    others = F.filter(F.arrays_zip(F.split("column_list", ",").alias("name"), F.col("fields").alias("value")), lambda x: ~F.coalesce(x["name"].isin(known), F.lit(False)))
    return rows.select("file_id", "line_no", "kind", "column_list", *ends, others.cast("array<struct<name:string,value:string>>").alias("others"))
