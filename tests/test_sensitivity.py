"""Patterns that come and go, texts of telemetry, limits of directories, and preferences of one file."""

from pyspark.sql import functions as F

from siltstone.operators import files, sensitivity as S, tags


def test_patterns_come_and_go(spark):
    names = spark.createDataFrame([("My Bank Contract",), ("plain",), ("",), (None,), ("SALARY 2024",)], "tag string")
    got = {r.tag: r for r in S.analyse(names).collect()}
    assert [(m.pattern, m.keywords, m.level) for m in got["My Bank Contract"].matched] == [("financial", ["bank"], 3), ("legal", ["contract"], 2)]
    assert got["My Bank Contract"].matched[1].reason == "May contain legal documents"
    assert {t: (r.overall, r.confirm) for t, r in got.items()} == {"My Bank Contract": ("High", True), "plain": ("None", False), "": ("None", False), None: ("None", False), "SALARY 2024": ("High", True)}
    mine = S.changed(S.DEFAULTS, (S.Pattern("custom", 1, ("plain", "pla")),), ("financial",))
    got = {r.tag: r for r in S.analyse(names, "tag", mine).collect()}
    assert (got["My Bank Contract"].overall, got["SALARY 2024"].overall, got["plain"].overall) == ("Medium", "None", "Low")
    assert [(m.pattern, m.keywords, m.reason) for m in got["plain"].matched] == [("custom", ["plain", "pla"], "Custom sensitive pattern")]
    assert {r.overall for r in S.analyse(names, "tag", ()).collect()} == {"None"}


def test_sanitised_telemetry(spark):
    rows = [("Feature", "search by ann", "open /data/ann/x y", "keep /a/b"), ("Error", "E1", "at ann", r"C:\Users\ann\f.txt failed in /home/me/x"), ("Session", "ann", "/a/b", "ann"), ("Performance", "/tmp/z ann", "ann", None)]
    got = S.sanitised(spark.createDataFrame(rows, "kind string, name string, action string, context string"), "ann", "/home/me").collect()
    assert [tuple(r) for r in got] == [
        ("Feature", "search by [USER]", "open [PATH] y", "keep /a/b"), ("Error", "E1", "at ann", "[PATH] failed in [HOME]/x"), ("Session", "ann", "/a/b", "ann"), ("Performance", "[PATH] [USER]", "ann", None)]


def test_limits_of_directories(spark):
    rows = [(f"/a/{i}", 10) for i in range(4)] + [("/b/1", 99), ("/b/2", None), ("/a/sub/1", 5), ("top", 200)]
    got = {r.path: r.verdict for r in files.filtered_files(spark.createDataFrame(rows, "path string, size_bytes long"), 3, 50).collect()}
    assert {got[f"/a/{i}"] for i in range(4)} == {"TooManyFiles"}
    assert [got[p] for p in ("/b/1", "/b/2", "/a/sub/1", "top")] == ["TooLarge", "Include", "Include", "TooLarge"]
    assert files.MOST_FILES == 10_000 and files.MOST_BYTES == 524_288_000


def test_preferences_of_one_file(spark):
    v = spark.createDataFrame([(1, "a", "confirmed"), (1, "b", "confirmed"), (2, "b", "confirmed"), (2, "c", "rejected"), (2, "d", None), (None, "b", "confirmed")], "file long, tag string, verdict string")
    rows = lambda df: sorted(tuple(r) for r in df.select("verdict", "position", "tag", "uses").collect())
    assert rows(tags.tag_preferences(v)) == [("confirmed", 1, "b", 3), ("confirmed", 2, "a", 1), ("rejected", 1, "c", 1)]
    assert rows(tags.tag_preferences(v, 1)) == [("confirmed", 1, "a", 1), ("confirmed", 2, "b", 1)]
    assert rows(tags.tag_preferences(v, F.lit(9))) == []
