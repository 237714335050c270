"""Text functions and answer matching on hand-made rows."""

import unicodedata

from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators.qa import answer_in_passage


def test_tokenize_and_normalize(spark):
    df = spark.createDataFrame([("Café déjà-vu! The  a an",)], "t string")
    r = df.select(T.tokenize("t").alias("k"), T.normalize_answer("t").alias("n")).first()
    assert r.k == ["Café", "déjà", "-", "vu", "!", "The", "a", "an"]
    assert r.n == "café déjàvu"


def test_metadata_and_strip(spark):
    df = spark.createDataFrame([("a\tb", None, "c\nd", "e")], "a string, b string, c string, d string")
    r = df.select(T.metadata_document("a", "b", "c", "d").alias("m")).first()
    assert r.m == "[CLS] a b [SEP] c d [SEP] e [SEP]"


def test_answers_edge_cases(spark):
    decomposed = unicodedata.normalize("NFD", "Zoë")
    pairs = spark.createDataFrame([
        (0, "the capital is Zoë today", ["Zoë"]),          # composed answer, composed text
        (1, "the capital is " + decomposed, ["Zoë"]),        # decomposed text
        (2, "nothing here", [""]),                          # empty answer never matches
        (3, "nothing here", ["!!!"]),                       # punctuation-only answer
        (4, "abc", ["("]),                                  # bad regex in regex mode
    ], "id int, text string, answers array<string>")

    def run(mode):
        return [r.has_answer for r in sorted(answer_in_passage(pairs, mode).collect(), key=lambda r: r.id)]
    assert run("string") == [True, True, False, False, False]
    rx = run("regex")
    assert rx[4] is False and rx[0] is True
    k = run("kilt")
    assert k[2] is False and k[3] is False


def test_segment_ids_and_padding(spark):
    df = spark.createDataFrame([(["a", "[SEP]", "b", "c"],)], "ids array<string>")
    r = df.select(T.segment_ids(F.col("ids"), "[SEP]").alias("s"),
                  T.pad_or_cut(F.col("ids"), 3, "[PAD]", "[SEP]").alias("c"),
                  T.pad_or_cut(F.col("ids"), 6, "[PAD]", "[SEP]").alias("p")).first()
    assert r.s == [0, 0, 1, 1]
    assert r.c == ["a", "[SEP]", "[SEP]"]
    assert r.p == ["a", "[SEP]", "b", "c", "[PAD]", "[PAD]"]


def test_ngrams_order(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],)], "t array<string>")
    out = [r.g for r in df.select(T.ngrams(F.col("t"), 2).alias("g")).collect()]
    assert out == [["a", "a b", "b", "b c", "c"], []]


def test_token_offsets_of_texts_without_tokens(spark, tmp_path):
    """An empty or blank text has no last token; its end is 0, as in the SQL, and null stays null."""
    import duckdb

    from lodestar.plans import q_text  # noqa: F401  registers
    from lodestar.plans.registry import ORACLE, QUERIES
    rows = [(1, "a b, c"), (2, None), (3, ""), (4, "   "), (5, "\t\n"), (6, " lead, x  "), (7, "one two  three 4 5 6 7 8 9 ten eleven\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in QUERIES["P13_token_offsets"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == set(con.execute(ORACLE["P13_token_offsets"]).fetchall())
    assert {(3, 0, "", 0), (2, None, None, None)} < got
