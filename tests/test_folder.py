"""Parsers, skipped files and errors of a folder."""

import os

import pytest
from pyspark.sql import functions as F

from siltstone.sources import folder as D


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("files")
    (top / "sub").mkdir()
    (top / "a.json").write_text('{"key": 1, "text": "one"}\n{"broken\n\n[1, 2]\n{"key": null, "text": "zwei\\nlines"}')
    (top / "sub" / "b.csv").write_text('k,"text, with ""quotes""\nand lines"\nonly one cell\n')
    (top / "sub" / "c.md").write_text("before\n# First\nbody\n\n## Second\n#no heading\n")
    (top / "d.txt").write_bytes(b"\xef\xbb\xbfwhole text")
    (top / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (top / "e.xyz").write_text("what")
    (top / "empty.csv").write_text("")
    os.utime(top / "d.txt", (0, 0))
    return str(top)


def test_records_and_errors(spark, folder):
    good, bad = D.records(D.files(spark, folder))
    name = lambda p: p.rsplit("/", 1)[1]
    want = [
        ("a.json", 0, "1", "one"), ("a.json", 3, None, "[1, 2]"), ("a.json", 4, None, "zwei\nlines"), ("b.csv", 0, "k", 'text, with "quotes"\nand lines'),
        ("c.md", 0, None, "before"), ("c.md", 1, "First", "body\n"), ("c.md", 2, "Second", "#no heading\n"), ("d.txt", 0, None, "whole text"),
    ]
    assert sorted(((name(r.path), r.number, r.key, r.text) for r in good.collect()), key=str) == sorted(want, key=str)
    assert sorted((name(r.path), r.number, r.error.split(":")[0]) for r in bad.collect()) == [("a.json", 1, "JSON"), ("b.csv", 1, "CSV"), ("bad.txt", 0, "UnicodeDecodeError"), ("e.xyz", 0, "no parser for xyz")]


def test_filters_reach_the_source_and_skip_files(spark, folder):
    from datetime import datetime

    found = D.files(spark, folder, ["txt", "csv"], most_bytes=20, modified_from=datetime(2000, 1, 1))
    assert [r.path.rsplit("/", 1)[1] for r in found.orderBy("path").collect()] == ["bad.txt"]  # Spark lists no empty files
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,20)" in plan and "GreaterThanOrEqual(m" in plan


def test_files_reach_their_parser_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """Files go to Python in Arrow batches of bounded bytes, not a hundred files at once."""
    plan = D.parsed(D.files(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPythonUDTF" in plan and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_landed_files_hold_a_bounded_number_of_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "FILE_RECORDS", 7)
    docs = spark.range(50).repartition(1).select(F.col("id").alias("doc_id"), F.concat(F.lit('a "b", \n\r\n c'), F.col("id").cast("string")).alias("text"), F.element_at(F.array(F.lit("en"), F.lit("de")), (F.col("id") % 2 + 1).cast("int")).alias("lang"))
    D.land_documents(docs, str(tmp_path / "f"))
    found = D.files(spark, str(tmp_path / "f"), ["json", "csv"])
    good, bad = D.records(found)
    assert found.count() == 8 and good.groupBy("path").count().agg({"count": "max"}).first()[0] == 7 and bad.count() == 0
    assert sorted((int(r.key), r.text) for r in good.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())


def test_odd_values_of_json_and_csv():
    texts = lambda parser, content: [r[2] for r in parser(content)]
    assert texts(D.lines_of_json, b'{"text": 5}\n{"text": null}\n{"text": [1, "\xc3\xa9"]}\r\n"s"\n') == ["5", None, '[1, "\u00e9"]', '"s"']
    assert texts(D.rows_of_csv, b'a,b\rc,"d\r\ne"\r\nf,"g""\nh"') == ["b", "d\r\ne", 'g"\nh']


def test_half_a_character_is_replaced(spark):
    found = spark.createDataFrame([("p", "json", bytearray(b'{"text": "a\\ud800b"}\n{"text": 5}'))], "path string, extension string, content binary")
    assert [r.text for r in D.parsed(found).orderBy("number").collect()] == ["a?b", "5"]
