from spanforge.operators import line_errors
from spanforge.plans import training

FILES = [
    (1, "bed", "chrom,start,end", 3),
    (2, "bed", "chrom,start,end,depth", 4),
    (3, "bed", "chrom,start,end,name", 4),
    (4, "bedpe", "chrom1,start1,end1,chrom2,start2,end2,sample,strand1,strand2", 9),
]
LINES = [
    (1, 1, "chr1\t1\t2\r"), (1, 2, "# note"), (1, 3, "chr1\t9\t2"), (2, 1, "1\t5\t6\t1.5"), (3, 1, 'chr1\t7\t8\t"a ""b"""'),
    (4, 1, "chr1\t1\t2\t1\t3\t4\tS1\t+\t-"), (4, 2, "chr1\t1\t2"), (9, 1, "chr1\t1\t2"),
]


def _parsed(spark):
    lines = spark.createDataFrame(LINES, "file_id bigint, line_no bigint, line string")
    files = spark.createDataFrame(FILES, "file_id bigint, kind string, column_list string, n_columns int")
    return line_errors.parse_lines(lines, files, spark.createDataFrame([("chr1", "1", 100)], "chrom string, chr_name string, length bigint"))


def test_loaded_and_rejected_are_all_data_lines(spark):
    assert "p3_loaded" in training.queries()
    parsed = _parsed(spark)
    got = {(r.file_id, r.line_no): r for r in line_errors.loaded_all(parsed).collect()}
    bad = {(r.file_id, r.line_no): r.reason for r in line_errors.rejected(parsed).collect()}
    assert bad == {(1, 3): "invalid_value", (4, 2): "column_count", (9, 1): "column_count"}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert (got[1, 1].chrom1, got[1, 1].start1, got[1, 1].end1, got[1, 1].others) == ("chr1", 1, 2, [])
    assert [tuple(x) for x in got[3, 1].others] == [("name", 'a "b"')]
    r = got[4, 1]
    assert (r.chrom2, r.start2, r.end2, r.strand1, r.strand2) == ("1", 3, 4, "+", "-") and [tuple(x) for x in r.others] == [("sample", "S1")]


def test_layouts_of_equal_width_are_kept_apart(spark):
    assert [r.file_id for r in line_errors.loaded(_parsed(spark), "bed", "chrom,start,end,name").collect()] == [3]


def test_unquoted_shapes_go_through_the_program(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(line_errors, "materialize", lambda df: seen.append(df) or df)
    _parsed(spark)
    got = {(r.shape, r.n_columns, r.delimiter_edits) for r in seen[0].collect()}
    assert got >= {("x\tx\tx", 3, 0), ("x\tx\tx", 9, 6), ('x\tx\tx\t"x""x"""', 4, 0)}


def _brute(shape, n):
    """Least (quote edits, delimiter edits) over all scripts, by search over the states."""
    import heapq

    heap, seen, best = [(0, 0, 0, 1)], set(), None
    while heap:
        q, i, s, k = heapq.heappop(heap)
        if best is not None and q > best[0]:
            break
        if (i, s, k) in seen:
            continue
        seen.add((i, s, k))
        if i == len(shape) and s != 2:
            best = min(best or (q, 99), (q, abs(k - n)))
        moves = [(q + 1, i, b, k) for a, b in ((0, 2), (3, 2), (2, 3)) if a == s]
        if i < len(shape):
            if (to := line_errors._step(s, shape[i])) is not None:
                moves.append((q, i + 1, to[0], k + to[1]))
            if shape[i] == '"':
                moves.append((q + 1, i + 1, s, k))
        for m in moves:
            heapq.heappush(heap, m)
    return best


def test_parse_is_cheapest():
    import itertools

    for n in range(6):
        for shape in map("".join, itertools.product('x\t"', repeat=n)):
            q, d, ops = line_errors.parse(shape, 2)
            assert (q, d) == _brute(shape, 2), repr(shape)
            assert sum("quote" in o for o, _ in ops) == q and len(ops) == q + d


def test_edits_make_the_line_parse():
    for shape in ('x"x\tx', '"x\tx', 'x\t"x"x', '""x\t"'):
        _, _, ops = line_errors.parse(shape, 2)
        text, shift = list(shape), 0
        for op, at in ops:
            if op == "insert_quote":
                text.insert(at - 1 + shift, '"')
                shift += 1
            elif op == "delete_quote":
                del text[at - 1 + shift]
                shift -= 1
        assert line_errors.parse("".join(text), 2)[0] == 0, shape


def test_many_stray_quotes_take_linear_time():
    import time

    t = time.time()
    assert line_errors.parse('x"' * 50_000 + "x", 1)[0] > 0
    assert time.time() - t < 20


def test_empty_and_null_lines(spark):
    lines = spark.createDataFrame([(1, 1, None), (1, 2, ""), (1, 3, " \t \r"), (None, 4, "chr1\t1\t2"), (1, None, "chr1\t1\t2"), (1, 6, "chr1\t1\t2" + "\tx" * 3000)], "file_id bigint, line_no bigint, line string")
    files = spark.createDataFrame([(*FILES[0], "x"), (None, "bed", "chrom", 1, "x"), (1, "bed", "chrom,start,end", 3, "copy")], "file_id bigint, kind string, column_list string, n_columns int, line string")
    parsed = line_errors.parse_lines(lines, files, spark.createDataFrame([("chr1", None, 100), (None, None, None)], "chrom string, chr_name string, length bigint"))
    assert {(r.file_id, r.line_no): r.reason for r in parsed.collect()} == {(None, 4): "column_count", (1, None): None, (1, 6): "column_count"}
    assert [tuple(r) for r in line_errors.edit_scripts(parsed).where("line_no = 6").collect()] == [(1, 6, "column_count", "3000 delete_delimiter@6006")]
    assert line_errors.parse_lines(lines.where("false"), files, spark.createDataFrame([("chr1", None, 100)], "chrom string, chr_name string, length bigint")).collect() == []
