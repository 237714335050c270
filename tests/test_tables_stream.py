"""Tables on hand-made markup, and streams: replays, expiry, stream = batch for the index."""

from pyspark.sql import functions as F

from lodestar.operators import index as I
from lodestar.operators import tables as TB

NESTED = ("<table> Cap <tr> <td> aa </td> <td> bb </td> </tr> <tr> <td> cc <table> <tr> <td> xx </td> </tr> "
          "<tr> <td> yy </td> </tr> </table> </td> </tr> late </table> <table> <tr> <td> only </td> </tr> </table> "
          "<table> </table> </table> <table> <tr> <td> a </td> </tr> <tr> <td> </td> <td> </td> </tr> <tr> <td> b </td> </tr> </table>")


def _tables(spark, *markup, **options):
    docs = spark.createDataFrame([(i, m.split(), "T") for i, m in enumerate(markup)], "doc_id long, tokens array<string>, title string")
    return {(t.doc_id, t.table_id): t for t in TB.extract_tables(docs, **options).collect()}


def test_extract_tables_nested_and_dropped(spark):
    by_id = _tables(spark, NESTED)
    assert set(by_id) == {(0, 0), (0, 1), (0, 4)}        # one-row and empty tables dropped; a stray end is nothing
    inner, outer = by_id[0, 1], by_id[0, 0]
    assert inner.parent_table_id == 0 and inner.nested and not outer.nested
    assert inner.caption == "T Cap | cc"                 # parent caption, then the parent's current cell
    assert outer.caption == "T Cap" and outer.rows == [["aa", "bb"], ["cc late"]]    # late text goes to the last cell
    assert by_id[0, 4].rows == [["a"], ["", ""], ["b"]] and by_id[0, 4].filled_rows == 2
    assert set(_tables(spark, NESTED, keep_small=True)) == {(0, k) for k in range(5)}


def test_extract_tables_banner_and_mask(spark):
    banner = " ".join(["w"] * 80) + " ( hide ) This section has multiple issues " + NESTED
    assert _tables(spark, banner) == {}
    assert len(_tables(spark, banner, issue_banner=None)) == 3
    docs = spark.createDataFrame([(0, ["<table>", "<tr>", "<td>", "<b>", "<tr>", "<td>", "y", "</table>"],
                                   [True, True, True, False, True, True, False, True], None)],
                                 "doc_id long, tokens array<string>, mask array<boolean>, title string")
    assert [t.rows for t in TB.extract_tables(docs, html_mask="mask").collect()] == [[["<b>"], ["y"]]]


def test_table_stats_count_before_the_drop(spark):
    docs = spark.createDataFrame([(0, NESTED.split(), "T"), (1, "x ( hide ) This section has multiple issues".split(), "T")],
                                 "doc_id long, tokens array<string>, title string")
    s = TB.table_corpus_stats(docs).first()
    assert (s.with_issue, s.nested, s.single_row, s.regular, s.total_rows) == (1, 4, 2, 3, 2 + 2 + 3)


def _chunks(spark, rows, max_words):
    t = spark.createDataFrame([(0, 0, "c", rows)], "doc_id long, table_id long, caption string, rows array<array<string>>")
    return [(r.chunk, r.text, r.n_rows) for r in TB.split_table_chunks(t, max_words).orderBy("chunk").collect()]


def test_split_chunks_header_and_tail(spark):
    rows = [["h1", "h2"], ["a", "b"], ["c", "d"], ["e", "f"], [""]]
    assert _chunks(spark, rows, 5) == [(0, "c\nh1, h2\na, b\nc, d", 3), (1, "c\nh1, h2\ne, f", 2)]
    assert _chunks(spark, [["h1"]], 5) == []             # header only: nothing kept


def _line(spark, rows, answers, max_words):
    t = spark.createDataFrame([(rows, answers)], "rows array<array<string>>, a array<int>")
    return t.select(TB.linearize_table(F.col("rows"), F.col("a"), max_words).alias("t")).first().t.split("\n")


def test_linearize_answer_rows_first(spark):
    rows = [["hh"], ["r1"], ["r2"], ["r3"]]
    assert _line(spark, rows, [3], 100) == ["hh", "r3", "r1", "r2"]
    assert _line(spark, rows, [3], 3) == ["hh", "r3", "r1"]          # the row that reaches the limit is kept
    assert _line(spark, rows, [2, 0, 2], 1) == ["hh", "r2"]          # the first answer row always is
    assert _line(spark, rows, None, 1) == ["hh"]


def test_answer_cells_caption(spark):
    t = spark.createDataFrame([(0, 0, "the caption", [["a b", "c"]], ["caption"]), (0, 1, "x", [["a b", "c"], ["zA B"]], ["A B", ""])],
                              "doc_id long, table_id long, caption string, rows array<array<string>>, answers array<string>")
    assert sorted(tuple(r) for r in TB.answer_cells(t).collect()) == [(0, 0, -1, -1), (0, 1, 0, 0)]


def test_stream_index_equals_batch(spark):
    import __spark_entry__ as E
    q = E.queries()
    st = sorted(tuple(r) for r in q["ST1_stream_index"](spark, "/root/testdata/sf0.001").collect())
    batch = sorted(tuple(r) for r in q["V31_index_remove"](spark, "/root/testdata/sf0.001").collect())
    assert st == batch


def test_replayed_batch_comes_out_whole(spark, tmp_path):
    from lodestar.streaming.index_stream import apply_batch, read_streamed_index, read_streamed_lists
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter("vec_id < 64")
    codec = I.train_codec(e.select("embedding"), I.centroids_from_labels(e.withColumn("label", F.dense_rank().over(_by_label()) - 1)), 2, 64)
    add = e.select(F.lit("add").alias("op"), F.floor(F.col("vec_id") / 8).cast("long").alias("pid"), (F.col("vec_id") % 8).alias("tok_pos"),
                   F.col("embedding").cast("array<double>").alias("embedding"))
    gone = spark.createDataFrame([("remove", 2, None, None)], add.schema)
    path = str(tmp_path / "index")
    apply_batch(add.filter("pid < 6").unionAll(gone.limit(0)), 0, codec, path)
    # a crash after the first of a batch's writes leaves its codes alone; the replay brings the removals
    I.compress(add.filter("pid = 6").select("pid", "tok_pos", "embedding"), codec).write.parquet(path + "/codes/batch=1")
    apply_batch(add.filter("pid = 6").unionAll(gone), 1, codec, path)
    assert {r.pid: r.doclen for r in read_streamed_index(spark, path)[1].collect()} == {0: 8, 1: 8, 2: 0, 3: 8, 4: 8, 5: 8, 6: 8}
    apply_batch(add.filter("pid = 2"), 2, codec, path)                # added again later: live
    codes, dl = read_streamed_index(spark, path)
    assert {r.pid: r.doclen for r in dl.collect()}[2] == 8
    assert sorted(map(tuple, read_streamed_lists(spark, path).collect())) == sorted(map(tuple, codes.select("code", "pid").distinct().collect()))


def _by_label():
    from pyspark.sql import Window
    return Window.orderBy("label")


def test_stream_metrics_state_expires(spark, tmp_path):
    from lodestar.streaming.metrics_stream import current_metrics, stream_metrics
    schema = "qid long, rank int, label int, ts timestamp"
    days = ["2024-01-01", "2024-01-02", "2024-02-01", "2024-01-01"]     # the last file is later than the watermark allows
    for i, (day, rank) in enumerate(zip(days, [3, 1, 2, 1])):
        rows = spark.createDataFrame([(7, rank, 1)], "qid long, rank int, label int").withColumn("ts", F.lit(day).cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream_metrics(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "ck"), watermark="1 hour")
    out = spark.read.parquet(str(tmp_path / "out")).filter("first_pos is not null")
    assert sorted((str(r.since.date()), r.n_pos) for r in out.collect()) == [("2024-01-01", 1), ("2024-01-02", 1), ("2024-02-01", 1)]
    m = current_metrics(spark, str(tmp_path / "out")).first()
    assert m.mrr_10 == 1.0 and m.recall_10 == 1.0 and schema


def test_visitor_sees_each_cell_once(spark):
    docs = spark.createDataFrame([(0, NESTED.split(), "T"), (1, "no table <b> here </b>".split(), "T"), (2, [], "T"), (3, None, "T")],
                                 "doc_id long, tokens array<string>, title string")
    got = TB.visit_cells(docs, lambda tokens, row, cell: f"{row}/{cell}:{'_'.join(tokens)}", captions=True).collect()
    assert sorted((r.doc_id, r.table_id, r.row, r.cell, r.value) for r in got) == [
        (0, 0, -1, -1, "-1/-1:T_Cap"), (0, 0, 0, 0, "0/0:aa"), (0, 0, 0, 1, "0/1:bb"), (0, 0, 1, 0, "1/0:cc_late"),
        (0, 1, -1, -1, "-1/-1:T_Cap_|_cc"), (0, 1, 0, 0, "0/0:xx"), (0, 1, 1, 0, "1/0:yy"),
        (0, 4, -1, -1, "-1/-1:T"), (0, 4, 0, 0, "0/0:a"), (0, 4, 1, 0, "1/0:"), (0, 4, 1, 1, "1/1:"), (0, 4, 2, 0, "2/0:b")]
    sizes = TB.visit_cells(docs, lambda tokens, row, cell: len(tokens) if len(tokens) > 1 else None, "int", keep_small=True)
    assert [(r.table_id, r.row, r.cell, r.value) for r in sizes.collect()] == [(0, 1, 0, 2)]


def test_tables_deeply_nested_and_long(spark):
    depth, rows = 60, 30000
    deep = ["<table>", "<tr>", "<td>", "w"] * depth + ["</table>"] * depth + ["</table>"]
    long = ["<table>"] + ["<tr>", "<td>", "x", None] * rows
    docs = spark.createDataFrame([(0, deep, None), (1, long, "L"), (0, long, "again")], "doc_id long, tokens array<string>, title string")
    got = TB.extract_tables(docs, keep_small=True).collect()
    chain = sorted((t for t in got if t.doc_id == 0 and not t.caption.startswith("again")), key=lambda t: t.table_id)
    assert [t.parent_table_id for t in chain] == [None, *range(depth - 1)]
    assert chain[-1].caption == ("| w " * (depth - 1)).strip() and all(t.rows == [["w"]] for t in chain)
    assert sorted((t.caption, len(t.rows), t.filled_rows) for t in got if len(t.rows) > 1) == [("L", rows, rows), ("again", rows, rows)]


def test_training_tables_carry_answer_positions(spark):
    from lodestar.operators.weak import assemble_training_tables
    tables = spark.createDataFrame([(1, 5, 0, "cap", [["aa", "x"], ["Aa bb", "aa"]], ["aa", ""]), (1, 6, 0, "aa", [["n"]], ["aa"]),
                                    (1, 7, 0, "c", [["n"]], ["aa"]), (2, 7, 0, "c", [["n"]], ["n"]), (2, 5, 0, "c", [[]], None)],
                                   "qid long, doc_id long, table_id long, caption string, rows array<array<string>>, answers array<string>")
    t = TB.answer_positions(tables, keys=("qid", "doc_id", "table_id"))
    got = {(r.qid, r.doc_id): ([tuple(x) for x in r.answer_pos], r.has_answer) for r in t.collect()}
    assert got == {(1, 5): ([(0, 0), (1, 0), (1, 1)], True), (1, 6): ([(-1, -1)], True), (1, 7): ([], False),
                   (2, 7): ([(0, 0)], True), (2, 5): ([], False)}
    mined = spark.createDataFrame([(1, 6, 3), (3, 9, 1)], "qid long, pid long, pos long")
    negatives = spark.createDataFrame([(1, 8, 2), (4, 8, 1)], "qid long, pid long, pos long")
    gold = t.select("qid", F.col("doc_id").alias("pid"), F.col("table_id").alias("tpos"), "has_answer", "answer_pos")
    out = {r.qid: r for r in assemble_training_tables(mined, negatives, gold).collect()}
    assert out[1].positive_ids == [6, 5, 6] and [len(a) for a in out[1].answer_pos] == [0, 3, 1] and out[1].hard_negative_ids == [8]
    assert out[2].positive_ids == [7] and [tuple(x) for x in out[2].answer_pos[0]] == [(0, 0)] and out[2].hard_negative_ids == []
    assert out[3].positive_ids == [9] and out[3].answer_pos == [[]] and out[4].positive_ids == [] and out[4].answer_pos == []
    plain = {r.qid: r.positive_ids for r in assemble_training_tables(mined, negatives).collect()}
    assert plain == {1: [6], 3: [9], 4: []}
