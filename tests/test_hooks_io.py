"""User hooks, reader rules and file formats that the test tables do not reach."""

import json

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import metrics as M
from lodestar.operators import qa as QA
from lodestar.operators import reader as RDR
from lodestar.operators import weak as WK
from lodestar.sources import readers as RD
from lodestar.sources import sinks as SK


def _lines(path):
    import glob
    out = []
    for f in sorted(glob.glob(f"{path}/part-*")):
        with open(f) as fh:
            out += fh.read().splitlines()
    return out


def test_generator_hook(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c"), (3, "d e f")], "dataset_id long, document string")
    judged = spark.createDataFrame([(2,)], "dataset_id long")
    got = WK.generate_queries(docs, lambda texts: ([t.upper() for t in texts], [len(t) for t in texts]), judged=judged, fold="0", field="content")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "A B", 3.0, "0", "content"), (3, "D E F", 5.0, "0", "content")]
    bad = WK.generate_queries(docs, lambda texts: ([], []))
    with pytest.raises(Exception, match="another number of texts"):
        bad.collect()


def test_rouge_mean(spark):
    pairs = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "a b c d", "a c")], "id long, prediction string, reference string")
    r = M.rouge_mean(pairs).first()
    assert r.rouge1 == pytest.approx((100 + 100 * 2 / 3) / 2)
    assert r.rouge2 == pytest.approx(50.0) and r.rougeL == pytest.approx(r.rouge1)
    assert r.avg == pytest.approx((r.rouge1 + r.rouge2 + r.rougeL) / 3)


def test_success_counts_in_one_pass(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 7, 1), (1, 40, 0), (2, 12, 1), (3, 1, 0)], "qid long, rank int, label int")
    got = {r.cutoff: (r.success, r.counts, r.mismatch) for r in M.em_success_counts(rows, rows.select("qid")).collect()}
    assert got[1] == (pytest.approx(1 / 3), pytest.approx(1 / 3), False) and got[10][1] == pytest.approx(2 / 3)
    assert got[-1] == (pytest.approx(2 / 3), pytest.approx(1.0), False)


def test_pair_spans_move(spark):
    one = spark.createDataFrame([([5, 6, 7], [8, 9], [(0, 1), (1, 1)])], "q array<int>, p array<int>, s array<struct<start:int,end:int>>")
    r = one.select(T.pair_concat(F.col("q"), F.col("p"), F.col("s")).alias("x")).first().x
    assert list(r.ids) == [5, 6, 7, 8, 9] and r.offset == 3 and [(s.start, s.end) for s in r.spans] == [(3, 4), (4, 4)]


def test_answer_spans(spark):
    rows = spark.createDataFrame([([1, 2, 1, 2, 1], [1, 2, 1]), ([1, 2], [1, 2, 3]), ([1], []), (None, [1])], "a array<int>, b array<int>")
    got = [[(s.start, s.end) for s in r.s] for r in rows.select(QA.answer_spans(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [[(0, 2), (2, 4)], [], [], []]


def test_token_spans(spark):
    rows = spark.createDataFrame([("  ab, ćd \n",), ("",), (None,)], "t string")
    got = [r.s for r in rows.select(T.token_spans("t").alias("s")).collect()]
    assert [(s.token, s.start, s.end, s.ws) for s in got[0]] == [("ab", 2, 4, "ab"), (",", 4, 5, ", "), ("ćd", 6, 9, "ćd")]
    assert got[1] == [] and got[2] is None


def test_best_spans(spark):
    rows = spark.createDataFrame([(1, [1.0, 5.0, 0.0, 2.0], [0.0, 1.0, 4.0, 3.0], ["a", "b", "##c", "d"]), (2, [], [], [])],
                                 "pid long, start_logits array<double>, end_logits array<double>, tokens array<string>")
    got = {r.pid: [(s.start, s.end, s.score) for s in r.spans] for r in RDR.best_spans(rows, max_len=2, top=3).collect()}
    # 2..3 holds the taken 3..3 and is struck out; 0..1 only crosses the taken 1..2 and widens to its word
    assert got[1] == [(1, 2, 9.0), (3, 3, 5.0), (0, 2, 2.0)]
    assert got[2] == []


def test_reader_passages_with_spans_and_gold(spark):
    rows = spark.createDataFrame([(1, 10, 1, True, True, False), (1, 11, 2, True, False, True), (1, 12, 3, False, False, False),
                                  (2, 20, 1, False, False, False)], "qid long, pid long, rank int, has_answer boolean, gold_page boolean, ok boolean")
    got = RDR.select_reader_passages(rows, True, spans="ok")
    assert sorted((r.qid, r.pid, r.role) for r in got.collect()) == [(1, 11, "positive"), (1, 12, "negative")]
    gold = spark.createDataFrame([(1, 10), (2, 99)], "qid long, pid long")
    got = RDR.select_reader_passages(rows, True, spans="ok", gold=gold)
    assert sorted((r.qid, r.pid, r.role) for r in got.collect()) == [(1, 10, "positive"), (1, 12, "negative"), (2, 20, "negative"), (2, 99, "positive")]
    batch = RDR.compose_reader_batch(got.withColumn("fits", F.col("pid") != 99), 3, fits="fits")
    assert [(r.qid, list(r.pids)) for r in batch.collect()] == [(1, [10, 12, -1])]


def test_scores_as_json_numbers(spark, tmp_path):
    big = (1 << 53) + 1
    ex = spark.createDataFrame([(7, [(big, 3.5), (4, None)])], "qid long, pids array<struct<pid:long,score:double>>")
    SK.write_examples(ex, str(tmp_path / "ex"))
    assert json.loads(_lines(tmp_path / "ex")[0]) == [7, [big, 3.5], 4]
    assert [(r.qid, [(p.pid, p.score) for p in r.pids]) for r in RD.read_examples(spark, str(tmp_path / "ex"), 5).collect()] == [(7, [(big, 3.5), (4, None)])]
    SK.write_teacher_scores(ex.select("qid", F.slice("pids", 1, 1).alias("pids")), str(tmp_path / "ts"))
    assert json.loads(_lines(tmp_path / "ts")[0]) == [7, [[3.5, big]]]


def test_kilt_by_position(spark, tmp_path):
    results = spark.createDataFrame([(5, "q5", [("a",)]), (3, "q3", [("b",), ("a",)])], "qid long, question string, ctxs array<struct<id:string>>")
    mapping = spark.createDataFrame([("a", "W1", 2), ("b", "W2", 0)], "ctx_id string, wikipedia_id string, end_paragraph_id int")
    gold = spark.createDataFrame([(0, "g0", "first"), (1, "g1", "second")], "pos long, id string, input string")
    out = SK.write_kilt(results, mapping, str(tmp_path / "k"), gold)
    got = {r.id: (r.input, [(p.wikipedia_id, p.end_paragraph_id) for p in r.output[0].provenance]) for r in out.collect()}
    assert got == {"g0": ("first", [("W2", 0), ("W1", 2)]), "g1": ("second", [("W1", 2)])}
    with pytest.raises(ValueError, match="differ in size"):
        SK.write_kilt(results, mapping, str(tmp_path / "k2"), gold.limit(1))


def test_text_files(spark, tmp_path):
    SK.write_queries(spark.createDataFrame([(2, "b\tc"), (1, "a")], "qid long, query string").coalesce(1), str(tmp_path / "q"))
    assert _lines(tmp_path / "q") == ["1\ta", "2\tb c"]
    SK.write_qas(spark.createDataFrame([(1, "a", ["x"])], "qid long, question string, answers array<string>"), str(tmp_path / "qa"))
    assert json.loads(_lines(tmp_path / "qa")[0]) == {"qid": 1, "question": "a", "answers": ["x"]}
    tables = spark.createDataFrame([(1, 0, "cap", [["a", "b"], ["c"]])], "doc_id long, table_id long, caption string, rows array<array<string>>")
    SK.write_tables_csv(tables, str(tmp_path / "t"))
    assert _lines(tmp_path / "t") == ["1\ta . bc . \tcap"]


def test_labels_and_judgements_exclude_each_other(spark, tmp_path):
    (tmp_path / "top.tsv").write_text("1\t10\tx\t1\n1\t11\tx\t0\n2\t12\tx\t0\n")
    path, qrels = str(tmp_path / "top.tsv"), spark.createDataFrame([(2, 12)], "qid long, pid long")
    assert {r.qid: list(r.positives) for r in RD.read_topk_pids(spark, path, True)[1].collect()} == {1: [10], 2: []}
    assert {r.qid: list(r.positives) for r in RD.read_topk_pids(spark, path, False, qrels)[1].collect()} == {1: [], 2: [12]}
    with pytest.raises(ValueError):
        RD.read_topk_pids(spark, path, True, qrels)


def test_biencoder_forms(spark, tmp_path):
    rows = [{"question": f"q{i}", "answers": ["a"], "positive_ctxs": [{"text": "t"}] if i != 1 else [], "negative_ctxs": [], "hard_negative_ctxs": []} for i in range(4)]
    (tmp_path / "w.json").write_text(json.dumps(rows, indent=1))
    assert [r.question for r in RD.read_biencoder_jsonl(spark, str(tmp_path / "w.json"), whole_file=True).collect()] == ["q0", "q2", "q3"]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert [r.question for r in RD.read_biencoder_jsonl(spark, str(tmp_path / "l.jsonl"), start=1, size=2).collect()] == ["q2"]
