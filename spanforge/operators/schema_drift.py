"""Reading records whose schema drifts between the files of a feed into one table, and listing every change.

1. Cells: every record is exploded (JSON variant, in the JVM) to (file, name, JSON type, value).
2. Profiles: per name a value sketch, the K masked value tokens of smallest hash with their frequencies; sketches of
   different names sample the same tokens, so their overlap estimates the overlap of the columns.
3. Scores of (name, canonical field): sketch overlap, name similarity, how often the one replaces the other from one
   version of a feed to the next, and the overlap of their JSON type profiles; a name that stands beside the canonical field in the same files is none of it.
4. Bipartite matching: per distinct set of names (a version's signature, far fewer than files) the names are assigned
   to the canonical fields that the set lacks, at maximum total score.
5. Versions are compared with their predecessors on (file, canonical field).

Nothing is collected: names, sketches and matches stay tables. A feed of any size is ordered by time buckets whose
last files are chained, so no task sees all files of a feed.

Defined results: a payload that is null or no JSON object has no fields; a file listed several times counts once; files
without feed or produced_at have no predecessor; ties of produced_at are ordered by file_id; a field whose values are
all null in a file has no type there and is never retyped against it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.runtime import materialize, sized_broadcast

SKETCH = 64
#: Weights of value sketch, name similarity and succession, and the least score of a match. A pair needs a good part of
#: its values in common, or the name and the succession. On the sf0.01 and sf0.1 tables true pairs score 0.41 and more,
#: false ones 0.32 and less.
WEIGHTS, LEAST = (0.6, 0.2, 0.2), 0.36
#: What equal JSON types add to the score of a pair; a field may change its type, so different ones take nothing away.
SAME_TYPE = 0.05
#: A name that shares more than this part of its files with a canonical field is not that field.
BESIDE = 0.02


def cells(records: DataFrame) -> DataFrame:
    """file_id, name, type (string, number, boolean, array, object; null for a JSON null), value as text."""
    # a payload that parses is an object if it opens with a brace
    r = records.where(F.col("payload").rlike(r"^\s*\{")).select("file_id", F.try_parse_json("payload").alias("v"))
    r = r.lateralJoin(records.sparkSession.tvf.variant_explode(F.col("v").outer()))
    t = F.schema_of_variant("value")
    jtype = F.when(t == "VOID", F.lit(None)).when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "object").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").otherwise("number")
    return r.select("file_id", F.col("key").alias("name"), jtype.alias("type"), F.try_variant_get("value", "$", "string").alias("text"))


def file_schema(cell: DataFrame) -> DataFrame:
    """file_id, name, type (the most frequent of the non-null values; null if there is none)."""
    n = cell.groupBy("file_id", "name", "type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("file_id", "name").agg(F.max_by("type", F.struct((F.when(F.col("type").isNotNull(), F.col("n")).otherwise(0)).alias("n"), F.coalesce("type", F.lit("")).alias("t"))).alias("type"))


def _mask(x: Column) -> Column:
    """A token in general form: runs of digits in names become 9, small whole numbers stay, others keep form and size."""
    number = x.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\z")
    v = F.abs(x.try_cast("double"))
    whole = ~x.contains(".")
    size = F.when(v == 0, F.lit("0")).otherwise(F.floor(F.log10(v)).cast("string"))
    sized = F.concat(F.when(whole, F.lit("i")).otherwise(F.lit("f")), F.when(x.startswith("-"), F.lit("-")).otherwise(F.lit("")), size)
    return F.when(~x.rlike("[0-9]"), x).when(number, F.when(whole & (v <= 9), x).otherwise(sized)).otherwise(F.regexp_replace(x, "[0-9]+", "9"))


def sketches(cell: DataFrame, k: int = SKETCH) -> DataFrame:
    """name, token, share: the k masked tokens of smallest hash of each name, with their share among these."""
    parts = F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"[\p{L}\p{N}_.:+-]+"), F.lit(0)))
    tok = cell.where(F.col("text").isNotNull()).select("name", parts.alias("part")).groupBy("name", _mask(F.col("part")).alias("token")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("name").orderBy(F.xxhash64("token"), "token")
    low = tok.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return low.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("name"))).select("name", "token", "share")


def predecessors(files: DataFrame, bucket: str = "week") -> DataFrame:
    """file_id, prev_id of every file with feed and produced_at; prev_id is null for the first of a feed."""
    f = files.select("file_id", "feed", "produced_at").where(F.col("feed").isNotNull() & F.col("produced_at").isNotNull()).groupBy("file_id").agg(F.min_by(F.struct("feed", "produced_at"), F.struct("produced_at", "feed")).alias("x")).select("file_id", "x.*")
    f = f.withColumn("bucket", F.date_trunc(bucket, "produced_at"))
    inside = f.withColumn("prev_id", F.lag("file_id").over(Window.partitionBy("feed", "bucket").orderBy("produced_at", "file_id")))
    last = f.groupBy("feed", "bucket").agg(F.max_by("file_id", F.struct("produced_at", "file_id")).alias("last"))
    chain = last.withColumn("before", F.lag("last").over(Window.partitionBy("feed").orderBy("bucket"))).select("feed", "bucket", "before")
    return inside.join(chain, ["feed", "bucket"]).select("file_id", F.coalesce("prev_id", "before").alias("prev_id"))


def _similar_names(a: Column, b: Column) -> Column:
    x, y = (F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "")) for c in (a, b))
    edit = 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1))
    inside = F.when((F.least(F.length(x), F.length(y)) >= 3) & (F.contains(x, y) | F.contains(y, x)), 0.8).otherwise(0.0)
    return F.greatest(edit, inside)


def scores(schema: DataFrame, sketch: DataFrame, prev: DataFrame, dictionary: DataFrame) -> DataFrame:
    """name, field, score of every name that is no canonical field against every canonical field it may stand for."""
    canon = dictionary.select(F.col("field").alias("field")).where(F.col("field").isNotNull()).distinct()
    names = schema.groupBy("name").agg(F.count(F.lit(1)).alias("files"))
    other = names.join(canon, names["name"] == canon["field"], "left_anti")
    q = sketch.join(canon, sketch["name"] == canon["field"], "left_semi").select(F.col("name").alias("field"), "token", F.col("share").alias("q"))
    overlap = sketch.join(q, "token").groupBy("name", "field").agg(F.sum(F.least("share", "q")).alias("values"))

    sets = schema.groupBy("file_id").agg(F.collect_set("name").alias("names"))  # names of one file, not of a group
    known = schema.join(canon, schema["name"] == canon["field"]).groupBy("file_id").agg(F.collect_set("field").alias("fields"))
    beside = schema.select("file_id", "name").join(known, "file_id").select("name", F.explode("fields").alias("field")).groupBy("name", "field").agg(F.count(F.lit(1)).alias("together"))
    pairs = prev.join(sets, "file_id").join(sets.select(F.col("file_id").alias("prev_id"), F.col("names").alias("was")), "prev_id")
    gone, fresh = F.array_except("was", "names"), F.array_except("names", "was")
    swaps = pairs.select(F.explode(F.array(F.struct(gone.alias("x"), fresh.alias("y")), F.struct(fresh.alias("x"), gone.alias("y")))).alias("s")).select(F.explode("s.x").alias("name"), F.col("s.y").alias("ys"))
    moves = swaps.groupBy("name").agg(F.count(F.lit(1)).alias("moves"))
    follow = swaps.select("name", F.explode("ys").alias("field")).groupBy("name", "field").agg(F.count(F.lit(1)).alias("follows"))

    kinds = schema.where(F.col("type").isNotNull()).groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.select("name", "type", (F.col("n") / F.sum("n").over(Window.partitionBy("name"))).alias("p"))
    known_kinds = kinds.join(canon, kinds["name"] == canon["field"], "left_semi").select(F.col("name").alias("field"), "type", F.col("p").alias("q"))
    same = kinds.join(known_kinds, "type").groupBy("name", "field").agg(F.sum(F.least("p", "q")).alias("same"))

    # a pair with neither common values nor a succession stays below the least score, whatever its names
    s = overlap.join(follow, ["name", "field"], "full_outer").join(canon, "field", "left_semi").join(other, "name")
    s = s.join(beside, ["name", "field"], "left").join(moves, "name", "left").join(same, ["name", "field"], "left")
    wv, wn, ws = WEIGHTS
    score = wv * F.coalesce("values", F.lit(0.0)) + wn * _similar_names(F.col("name"), F.col("field")) + ws * F.coalesce(F.try_divide("follows", "moves"), F.lit(0.0)) + SAME_TYPE * F.coalesce("same", F.lit(0.0))
    return s.where(F.coalesce("together", F.lit(0)) <= BESIDE * F.col("files")).select("name", "field", score.alias("score")).where(F.col("score") >= LEAST)


def best_assignment(score: np.ndarray) -> list[int]:
    """For each row the column assigned to it (or -1): the matching of maximum total score, by shortest augmenting paths."""
    n, m = score.shape
    cost = np.zeros((n, m + n))  # n columns more: a row may stay unmatched at no gain
    cost[:, :m] = -score
    u, v, match = np.zeros(n + 1), np.zeros(m + n + 1), np.zeros(m + n + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(m + n + 1, np.inf), np.zeros(m + n + 1, bool), np.zeros(m + n + 1, int)
        while match[j0]:
            used[j0] = True
            r = match[j0]
            red = cost[r - 1] - u[r] - v[1:]
            better = ~used[1:] & (red < least[1:])
            least[1:][better], way[1:][better] = red[better], j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            d = least[j1]
            u[match[used]] += d
            v[used] -= d
            least[~used] -= d
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if match[j] and score[match[j] - 1, j - 1] > 0:
            out[match[j] - 1] = j - 1
    return out


def _match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for sig, names, edges in zip(pdf["sig"], pdf["names"], pdf["edges"], strict=True):
            present = set(names)
            edges = [e for e in edges if e["field"] not in present]
            a, b = sorted({e["name"] for e in edges}), sorted({e["field"] for e in edges})
            if not edges:
                continue
            score = np.zeros((len(a), len(b)))
            ia, ib = {x: i for i, x in enumerate(a)}, {x: i for i, x in enumerate(b)}
            for e in edges:
                score[ia[e["name"]], ib[e["field"]]] = e["score"]
            rows += [(sig, a[i], b[j]) for i, j in enumerate(best_assignment(score)) if j >= 0]
        yield pd.DataFrame(rows, columns=["sig", "name", "field"])


def unify_names(schema: DataFrame, score: DataFrame) -> DataFrame:
    """file_id, name, type, field: the canonical field of every name of every file (or the name as it stands)."""
    sig = schema.groupBy("file_id").agg(F.sort_array(F.collect_set("name")).alias("names")).select("file_id", F.sha2(F.to_json("names"), 256).alias("sig"), "names")
    sets = sig.groupBy("sig").agg(F.first("names").alias("names"))
    edges = sets.select("sig", F.explode("names").alias("name")).join(score, "name").groupBy("sig").agg(F.collect_list(F.struct("name", "field", "score")).alias("edges"))
    match = materialize(sets.join(edges, "sig").mapInPandas(_match, "sig string, name string, field string"))
    named = schema.join(sig.select("file_id", "sig"), "file_id")
    return named.join(sized_broadcast(match), ["sig", "name"], "left").select("file_id", "name", "type", F.coalesce("field", "name").alias("field"))


def drift(records: DataFrame, files: DataFrame, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(file_id, name, type, field of every file; file_id, field, change_kind of every change)."""
    cell = cells(records)
    schema, prev = materialize(file_schema(cell)), materialize(predecessors(files))
    unified = materialize(unify_names(schema, scores(schema, materialize(sketches(cell)), prev, dictionary)))
    prev = prev.where(F.col("prev_id").isNotNull())
    now = unified.join(prev.select("file_id"), "file_id", "left_semi").select("file_id", "field", F.struct("name", "type").alias("now"))
    was = unified.withColumnRenamed("file_id", "prev_id").join(prev, "prev_id").select("file_id", "field", F.struct("name", "type").alias("was"))
    both = now.join(was, ["file_id", "field"], "full_outer")
    kinds = F.array_compact(F.array(
        F.when(F.col("was").isNull(), "added"),
        F.when(F.col("now").isNull(), "removed"),
        F.when(F.col("now.name") != F.col("was.name"), "renamed"),
        F.when(F.col("now.type") != F.col("was.type"), "retyped"),
    ))
    return unified, both.select("file_id", "field", F.explode(kinds).alias("change_kind"))


def unified_table(records: DataFrame, unified: DataFrame, dictionary_rows: list[tuple[str, str]]) -> DataFrame:
    """All records under the canonical fields, typed as the dictionary says, with what is in no dictionary in ``other``.

    Lists and objects of a text field become their texts joined by ``&``; numbers in quotes become numbers. A value
    that its field does not take over whole (an object with further members, a text in a number field) stands in
    ``other`` too, as it is in the record and under the name it has there.
    """
    names = unified.groupBy("file_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "name"))).alias("names"))
    r = records.select("file_id", "row_no", F.from_json("payload", "map<string,string>").alias("cells")).join(names, "file_id", "left")

    def raw(field: str) -> Column:
        return F.try_element_at("cells", F.try_element_at("names", F.lit(field)))

    def terms_and_name(v: Column) -> tuple[Column, Column]:
        obj = F.from_json(v, "struct<terms:array<string>,name:string>")
        return F.array_join(obj["terms"], "&"), obj["name"]

    def column(field: str, kind: str) -> Column:
        v = raw(field)
        if kind == "number":
            return F.regexp_replace(v, '["\\[\\]]', "").try_cast("double").alias(field)
        return F.when(v.startswith("["), F.array_join(F.from_json(v, "array<string>"), "&")).when(v.startswith("{"), F.coalesce(*terms_and_name(v), v)).otherwise(v).alias(field)

    def cut(field: str, kind: str) -> Column:
        """Whether the field takes over less than the value."""
        v = raw(field)
        if kind == "number":
            return v.isNotNull() & F.col(field).isNull()
        terms, name = terms_and_name(v)
        keys = F.json_object_keys(v)
        taken = F.when(terms.isNotNull(), "terms").when(name.isNotNull(), "name")
        return v.startswith("{") & taken.isNotNull() & ((F.size(keys) > 1) | (keys[0] != taken))

    known = F.transform(F.array(*[F.lit(f) for f, _ in dictionary_rows]), lambda f: F.try_element_at("names", f))
    r = r.select("file_id", "row_no", "cells", "names", *[column(f, k) for f, k in dictionary_rows])
    r = r.withColumns({"_known": known, "_cut": F.array_compact(F.array(*[F.when(cut(f, k), F.try_element_at("names", F.lit(f))) for f, k in dictionary_rows]))})
    other = F.map_filter("cells", lambda k, _: ~F.coalesce(F.array_contains("_known", k), F.lit(False)) | F.array_contains("_cut", k))
    return r.select("file_id", "row_no", *[f for f, _ in dictionary_rows], other.alias("other"))
