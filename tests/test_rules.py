import pytest
from compare import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators import chunks, files
from siltstone.operators.files import snapshot_diff
from siltstone.operators.relations import apply_block_rules
from siltstone.operators.search import fuse, similar_vectors
from siltstone.sources import tables
from siltstone.streaming import sessions as stream

CLASSES = [
    ("0x80070005", "ExactKeyword"), ("error 0xDEADBEEF", "ExactKeyword"), ("12345678", "ExactKeyword"), ("ERROR_ACCESS_DENIED", "ExactKeyword"), ("report.pdf", "ExactKeyword"), ('"exact phrase"', "ExactKeyword"),
    ("C:\\Users\\test", "ExactKeyword"), ("/home/user/docs", "ExactKeyword"), ("find documents about machine learning", "NaturalLanguage"), ("where is the report", "NaturalLanguage"), ("找文件", "NaturalLanguage"), ("test", "Mixed"), ("AI", "Mixed"),
]


def test_classes(spark):
    got = spark.createDataFrame(CLASSES, "q string, want string").withColumn("got", T.classify_query(F.col("q"))).collect()
    assert [(r.q, r.got) for r in got] == CLASSES


def test_intents(spark):
    rows = [("find the report.pdf file", "File"), ("where is my document", "File"), ("find the paragraph that mentions machine learning", "Content"), ("content about neural networks", "Content"), ("hello", "Ambiguous")]
    df = spark.createDataFrame(rows, "q string, want string")
    file, content = T.intent_scores(F.col("q"))
    assert [(r.q, r.got) for r in df.select("q", T.intent(file, content).alias("got")).collect()] == rows


def test_paths(spark):
    paths = [("/a/node_modules/x.js", "Blacklisted"), ("/a/.git/config", "Blacklisted"), ("a/b.tmp", "Blacklisted"), ("/a/build/keep/x", "Include"), ("\\a\\target\\b", "Blacklisted"), ("/a/b.txt", "Include"), ("/" + "/".join("abcdefghijklmnopqrstu"), "TooDeep")]
    df = spark.createDataFrame(paths, "p string, want string")
    assert [(r.p, r.got) for r in df.select("p", T.path_filter(F.col("p"), ["**/keep/**"], T.BLACKLIST).alias("got")).collect()] == paths


@given(st.text(alphabet="ab .\n!?。", max_size=400), st.integers(20, 60))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text(text, most):
    spans = chunks.chunk_spans(text, most, 10, 10)
    assert bool(spans) == bool(text)
    if spans:
        assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b <= d and b - a <= most


def test_chunk_breaks():
    assert chunks.break_point("x" * 120 + "\n\n" + "y. z") == 122
    assert chunks.break_point("x" * 120 + "。" + "y" * 10 + ". z") == 133
    assert chunks.break_point("a. b") == 4


def test_debounce_counts_from_the_last_kept_event(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1, 'a', TIMESTAMP '2024-01-01 00:00:00'), (2, 1, 'a', TIMESTAMP '2024-01-01 00:00:08'), (3, 1, 'a', TIMESTAMP '2024-01-01 00:00:12'), (4, 2, 'a', TIMESTAMP '2024-01-01 00:00:01') AS t(event_id, user_id, event_type, ts)")
    assert {r.event_id for r in chunks.debounce(df, 10).collect()} == {1, 3, 4}


def test_fusion_keeps_one_sided_hits(spark):
    v = spark.createDataFrame([(1, 1.0), (2, 0.1), (3, 0.1)], "doc_id long, vector double")
    t = spark.createDataFrame([(2, 0.01), (4, 5.0)], "doc_id long, text double")
    assert {(r.doc_id, r.origin, r.score) for r in fuse(v, t).collect()} == {(1, "Vector", 0.6), (3, "Vector", 0.06), (4, "BM25", 0.4)}


def test_rename_is_found(spark):
    old = spark.createDataFrame([(1, "/a", 1), (2, "/b", 1), (3, "/c", 1)], "file_id long, path string, size long")
    new = spark.createDataFrame([(1, "/a2", 1), (3, "/c", 2), (4, "/d", 1)], "file_id long, path string, size long")
    assert {(r.file_id, r.change) for r in snapshot_diff(old, new).collect()} == {(1, "renamed"), (2, "deleted"), (3, "modified"), (4, "added")}


def test_block_rules(spark):
    e = spark.createDataFrame([(1, 2, "AIGenerated"), (2, 1, "User"), (3, 4, "AIGenerated"), (5, 6, "AIGenerated")], "source long, target long, origin string")
    kept = apply_block_rules(e, spark.createDataFrame([(3,)], "file long"), spark.createDataFrame([(2, 1)], "a long, b long"))
    assert {(r.source, r.target) for r in kept.collect()} == {(2, 1), (5, 6)}


def test_similar_vectors_in_small_tiles(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(250)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = {tuple(r) for r in similar_vectors(df, 5, 0.5).collect()}
    assert wide == {tuple(r) for r in similar_vectors(df, 5, 0.5, tile=20).collect()} and len(wide) == 15


def test_upsert_and_delete(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert {tuple(r) for r in tables.upsert(t, spark.createDataFrame([(2, "c"), (3, "d")], t.schema), "id").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in tables.delete(t, spark.createDataFrame([(2,)], "id long"), "id").collect()} == {(1, "a")}
    assert tables.compatible(t, t.schema) and not tables.compatible(t.drop("v"), t.schema)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_streamed_sessions_match_the_batch(spark, folder):
    got = stream._run(stream.session_counts(stream.event_stream(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))), "complete")
    from siltstone.operators.relations import q_sessions

    want = {(r.user_id, r.events) for r in q_sessions(spark, folder).select("user_id", "events").collect()}
    assert {(r.user_id, r.events) for r in got.collect()} == want


def test_streamed_debounce_matches_the_batch(spark):
    from siltstone.streaming.stateful import debounce_stream

    folder = "/root/testdata/sf0.001"
    got = stream._run(debounce_stream(stream.event_stream(spark, folder), 6 * 3600))
    assert {r.event_id for r in got.collect()} == {r.event_id for r in chunks.q_debounce(spark, folder).collect()}


def test_retries_end_as_dead_letters(spark, tmp_path):
    from siltstone.streaming.stateful import retry_stream

    for i, rows in enumerate([[(1, False), (2, True), (3, False)]] + [[(1, False)]] * 4 + [[(3, True)]]):
        spark.createDataFrame(rows, "task_id long, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("task_id long, ok boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = {}
    for r in stream._run(retry_stream(s), "update").collect():
        last[r.task_id] = max(last.get(r.task_id, (0, "")), (r.failures, r.status if r.status != "Retrying" else ""))
    assert last[1] == (5, "DeadLetter") and last[2] == (0, "Done") and last[3] == (1, "Done")


def test_files(spark, tmp_path):
    from siltstone.sources import files

    for name, data in {"a.txt": b"hello", "b.json": b'{"x": 1}', "c.json": b"{x", "d.md": b"# t", "e.png": b"\x89", "f.txt": b"\xff\xfe", "node_modules/g.txt": b"x", "h.tmp": b"x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert {(r.filename, r.file_type) for r in files.list_files(spark, str(tmp_path)).collect()} == {("a.txt", "TextDocument"), ("b.json", "Code"), ("c.json", "Code"), ("d.md", "TextDocument"), ("e.png", "Image"), ("f.txt", "TextDocument")}
    assert {(r.path.rsplit("/", 1)[1], r.kind, r.text) for r in files.read_texts(spark, str(tmp_path)).collect()} == {("a.txt", "plain", "hello"), ("b.json", "json", '{"x": 1}'), ("d.md", "markdown", "# t"), ("g.txt", "plain", "x")}
    assert files.count_files(spark, str(tmp_path)) == 7


def test_sections():
    from siltstone.operators.more import sections

    text = "# Title\nbody\n\n## Alone\n\npara one\nstill\n```py\nx = 1\n\n```\ntail\n```\nopen"
    assert [(a, b, k) for a, b, k, _ in sections(text)] == [(1, 2, "Paragraph"), (4, 4, "Heading"), (6, 7, "Paragraph"), (8, 11, "CodeBlock"), (12, 12, "Paragraph"), (13, 14, "CodeBlock")]
    assert sections("") == []


def test_code_units():
    rust = "use x;\npub(crate) fn a() {\n  if b { c }\n}\n\nstruct P;\nimpl P {\n}\n"
    assert chunks.code_units(rust, False) == [(2, 4, "fn", "a"), (6, 6, "struct", "P"), (7, 8, "impl", "P")]
    python = "import x\nclass A:\n    def f(self):\n        pass\n\nasync def g():\n    return 1\nprint(1)"
    assert chunks.code_units(python, True) == [(2, 4, "class", "A"), (6, 7, "def", "g")]
    assert chunks.code_units("just text", False) == [(1, 1, "text", "")] and chunks.code_units(" ", True) == []


def test_page_chunks(spark):
    rows = [(1, "a" * 10 + "\f" + "b" * 10), (2, "c" * 7000), (3, None)]
    got = [(r.doc_id, r.page) for r in chunks.page_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert got[:2] == [(1, 1), (1, 2)] and {p for d, p in got if d == 2} == {1, 2, 3} and not any(d == 3 for d, _ in got)


@given(st.lists(st.sampled_from(["From", "To"]), max_size=12))
@settings(max_examples=12, deadline=None)
def test_renames_match_a_queue(spark, halves):
    from siltstone.operators.files import pair_renames

    waiting, want = [], set()
    for i, h in enumerate(halves):
        if h == "From":
            waiting.append(i)
        elif waiting:
            want.add((waiting.pop(0), i, "Renamed"))
        else:
            want.add((None, i, "Created"))
    df = spark.createDataFrame([(1, i, i, h) for i, h in enumerate(halves)], "user_id long, event_id long, ts long, half string")
    assert {(r.from_event, r.to_event, r.kind) for r in pair_renames(df).collect()} == want


def test_log_export_takes_documents_of_every_length(spark, tmp_path):
    from siltstone.operators.maintenance import q_log_export

    long = "\n".join(f"long {i} " + "x" * 40 for i in range(150))
    rows = [(1, "a\nb", "s", 3), (2, "\n".join(f"old {i}" for i in range(100)), "s", 700), (3, long, "s", len(long)), (4, "no count", "s", None), (5, None, "s", 0), (6, "other", "t", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.position): r.line for r in q_log_export(spark, str(tmp_path)).collect()}
    want = ["no count", *long.split("\n"), *(f"old {i}" for i in range(49))]
    assert got == {("s", i + 1): x for i, x in enumerate(want)} | {("t", 1): "other"}


def test_snippets_and_highlights_cover_whole_documents(spark, tmp_path):
    import re

    from siltstone.operators.text_rules import q_document_highlights, q_snippet

    lines = [f"{i} " + "y" * 300 for i in range(9)]
    lines[5] += " the thtION and thtion"
    rows = [(1, "\n".join(lines)), (2, "İ Ion-IONion"), (3, None), (4, "none")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [(r.doc_id, r.line, r.snippet) for r in q_snippet(spark, str(tmp_path)).collect()] == [(1, 6, "\n".join(lines[2:9]))]
    want = {(i, m.start()) for i, t in rows if t for m in re.finditer("[iI][oO][nN]", t)}
    assert {(r.doc_id, r.start) for r in q_document_highlights(spark, str(tmp_path)).collect()} == want and len(want) == 5


def test_debounce_folds_one_large_key_in_pieces(spark):
    import random

    rnd, t, rows, want, last = random.Random(5), 0, [], set(), {}
    for i in range(3000):
        t += rnd.choice([0, 1, 3, 9, 12])
        rows.append((rnd.choice([None, 7]) if i % 50 == 0 else 7, "view", i, t))
    for u, _, i, s in rows:
        if u not in last or s - last[u] >= 10:
            want.add(i)
            last[u] = s
    df = spark.createDataFrame(rows, "user_id long, event_type string, event_id long, s long").selectExpr("user_id", "event_type", "event_id", "timestamp_seconds(s) AS ts")
    out = chunks.debounce(df.orderBy(F.rand(1)), 10)
    assert sorted(r.event_id for r in out.collect()) == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "piece" in plan


@given(st.text(max_size=40), st.integers(6, 40))
@settings(max_examples=15, deadline=None)
def test_truncation_keeps_whole_characters(spark, text, most):
    got = spark.createDataFrame([(text,)], "t string").select(T.truncated(F.col("t"), most)).first()[0]
    raw = text.encode()
    assert got == (text if len(raw) <= most else raw[: most - 3].decode(errors="ignore") + "...")


def test_every_pass_removes_files(spark):
    assert {r.removed_by for r in files.q_retention_passes(spark, DATA).collect()} == {"count", "size", "age", "kept"}
