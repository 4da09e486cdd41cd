"""Tag changes with odd rows, and searches whose files have no time."""

from siltstone.operators import search as S
from siltstone.operators import tag_table as G


def test_updates(spark):
    tags = spark.createDataFrame([("a", "A", None, False), ("b", "B", "a", False), ("c", "C", "a", False), ("d", "D", None, True)], "tag string, name string, parent string, is_system boolean")
    changes = [("a", "Z", None), ("a", "Y", "b"), ("b", "C", None), ("c", None, "b"), ("d", "N", "a"), ("x", "N", None)]
    got = {r.tag: tuple(r)[1:] for r in G.update_tags(tags, spark.createDataFrame(changes, "tag string, name string, parent string")).collect()}
    assert got == {"a": ("ok", "Z", None), "b": ("taken", "B", "a"), "c": ("ok", "C", "b"), "d": ("taken", "D", None), "x": ("missing", None, None)}


def test_removals_and_batches(spark):
    have = spark.createDataFrame([(1, 7, "Auto"), (1, 3, "Auto"), (2, 7, "Manual")], "file long, tag long, origin string")
    gone = spark.createDataFrame([(1, 7), (1, 7), (5, 5)], "file long, tag long")
    left, verdicts = G.remove_file_tags(have, gone)
    assert sorted(map(tuple, left.select("file", "tag").collect())) == [(1, 3), (2, 7)]
    assert sorted(map(tuple, verdicts.collect())) == [(1, 7, True), (5, 5, False)]
    counts = spark.createDataFrame([(7, 2), (5, 0), (3, 1)], "tag long, usage_count long")
    assert {tuple(r) for r in G.usage_after(counts, verdicts).collect()} == {(7, 1), (5, 0), (3, 1)}
    files = spark.createDataFrame([(1,), (1,), (9,)], "file long")
    assert {tuple(r) for r in G.batch_tag(have, files, [3, 4], [7]).collect()} == {(1, 3, "Auto"), (1, 4, "Manual"), (9, 3, "Manual"), (9, 4, "Manual"), (2, 7, "Manual")}
    assert G.batch_tag(have, files, [], []).count() == 3


def test_times_bound_both_kinds_of_filter(spark):
    files = spark.sql("SELECT * FROM VALUES (1, array('en'), TIMESTAMP_NTZ '2024-01-01 00:00:00'), (2, array('en', 'x'), TIMESTAMP_NTZ '2024-01-05 00:00:00'), (3, array('en'), NULL), (4, NULL, TIMESTAMP_NTZ '2024-01-02 00:00:00') AS t(doc_id, tags, modified_at)")
    files = files.selectExpr("CAST(doc_id AS LONG) AS doc_id", "tags", "modified_at")
    hits = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 5.0), (4, 2.0), (9, 9.0)], "doc_id long, bm25 double")
    run = lambda *a: [r.doc_id for r in S.filtered_after_top(hits, files, *a).collect()]
    assert run(["en"], None, None, 5) == [3, 2, 1] and run(["en"], "2024-01-01", None, 5) == [2, 1] and run([], "2024-01-01", "2024-01-02", 5) == [4, 1]
    assert run(["en"], None, None, 1) == [3]  # the filter comes after the best two
    f = S.request_filters({"time_range": {"start": "2024-01-02"}})
    assert (f.modified_from, f.modified_to) == ("2024-01-02", None)
    rows = files.selectExpr("doc_id", "'txt' AS extension", "'/p' AS path", "tags", "false AS private", "modified_at")
    assert sorted(r.doc_id for r in f.keep(rows).collect()) == [2, 4]
