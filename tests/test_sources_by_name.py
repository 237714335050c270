"""Names that are registered sources, files and globs."""

import pytest
from pyspark.errors import AnalysisException

from lodestar.sources import readers as RD


def test_files_globs_and_registered_names(spark, tmp_path):
    for k in (0, 1):
        (tmp_path / f"part-{k}.tsv").write_text(f"id\ttext\n{k}\ta, \"b\" {k}\n", encoding="utf-8")
    (tmp_path / "more.csv").write_text('id,text\n2,"x, ""y"""\n', encoding="utf-8")
    (tmp_path / "lines.jsonl").write_text('{"id": "3", "text": "z"}\n', encoding="utf-8")
    RD.register_source("own", lambda s: s.createDataFrame([("4", "w")], "id string, text string"))
    names = [f"{tmp_path}/part-*.tsv", f"{tmp_path}/more.csv", f"{tmp_path}/lines.jsonl", "own"]
    got = {r.id: r.text for r in RD.read_source_by_name(spark, names).collect()}
    assert got == {"0": 'a, "b" 0', "1": 'a, "b" 1', "2": 'x, "y"', "3": "z", "4": "w"}
    one = RD.read_source_by_name(spark, f"{tmp_path}/part-0.tsv", reader=lambda s, p: s.read.text(p))
    assert one.columns == ["value"] and one.count() == 2


def test_names_that_match_nothing(spark, tmp_path):
    with pytest.raises(AnalysisException):
        RD.read_source_by_name(spark, f"{tmp_path}/none-*.parquet").count()
    with pytest.raises(ValueError):
        RD.read_source_by_name(spark, [])
