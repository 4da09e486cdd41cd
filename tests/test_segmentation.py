"""Dictionary and segmentation against brute force, and the share of words found in texts without spaces."""

import random
import time
from math import log

import duckdb
import pyarrow as pa
import pytest
from compare import DATA, same
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators import segmentation as S
from siltstone.operators import word_graph as G

COSTS = {"a": 40, "ab": 55, "abc": 70, "b": 45, "bca": 61, "ca": 50, "cab": 57}


def every_path(run, longest):
    """All ways to cut a run, as (cost, sizes of the words from the last one on, whether each is unknown)."""
    if not run:
        return [(0, (), ())]
    out = []
    for k in range(1, min(longest, len(run)) + 1):
        piece = run[len(run) - k :]
        cost = COSTS.get(piece, 100 if k == 1 else None)
        if cost is not None:
            out += [(cost + c, (k, *sizes), (piece not in COSTS, *odd)) for c, sizes, odd in every_path(run[: len(run) - k], longest)]
    return out


@given(st.text("abcx", max_size=9))
@settings(deadline=None)
def test_best_path_matches_every_path(run):
    cost, sizes, odd = min(every_path(run, 3), key=lambda p: (p[0], [-k for k in p[1]]))
    ends, at = [], len(run)
    for i, k in enumerate(sizes):
        if not (i and odd[i] and odd[i - 1]):
            ends.append(at)
        at -= k
    assert S.best_path(run, COSTS, 3, 100) == ends[::-1]


def test_long_runs_take_linear_time():
    run = "abcxxab" * 100_000
    ends = S.best_path(run, COSTS, 3, 100)
    assert ends[-1] == len(run) and ends == sorted(set(ends))


WORDS = ["学习", "机器", "语言", "模型", "数据", "天气", "图书馆", "的", "在", "是"]


def chinese(n, seed=1):
    r = random.Random(seed)
    return [[r.choice(WORDS) for _ in range(30)] for _ in range(n)]


def test_words_of_texts_without_spaces(spark):
    texts = chinese(200)
    docs = spark.createDataFrame([(i, "".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "plain words_here")], "doc_id long, text string")
    words = S.learned(docs)
    got = {r.doc_id: r for r in S.Segmenter(words).tokens(docs, "doc_id").collect()}
    assert {"学习", "机器", "图书馆"} <= {r.word for r in words.collect()}
    right = sum(sum(w in t for w in got[i].tokens) for i, t in enumerate(texts))
    assert right >= 0.95 * sum(len(got[i].tokens) for i in range(200)) and all("".join(got[i].tokens) == "".join(t) for i, t in enumerate(texts))
    assert (got[900].tokens, got[901].tokens, got[902].tokens) == ([], [], ["plain", "words_here"])
    assert got[0].language == "Chinese" and len(got) == 203


def test_dictionary_matches_sql(spark):
    rows = [(i, "".join(t) + " The cat and the dog, " * (i % 3)) for i, t in enumerate(chinese(40, 2))] + [(99, None), (98, ""), (97, "ねこ と 犬 ねこ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    same(S.learned(docs).toPandas(), con.execute(S.ORACLE_SQL["learned_words"]).df())


def test_empty_dictionary(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    words = S.learned(docs)
    assert words.count() == 0
    assert {tuple(r) for r in S.Segmenter(words).found(docs, "doc_id", S.letters(S.F.col("text"))).collect()} == {(1, 0, 0, 0), (2, 0, 0, 0)}


def test_costs_are_log_probabilities(spark):
    got = S.dictionary(spark.createDataFrame([("a", 6), ("b", 2), ("c", 1)], "word string, n long")).collect()
    assert [(r.word, r.cost) for r in got] == [("a", round(log(8 / 6) * S.SCALE)), ("b", round(log(4) * S.SCALE))]


def test_documents_without_spaces_are_cut_at_their_words(spark):
    """65 of 100 words of the documents come back whole once their spaces are gone.

    The prose is invented from syllables: two thirds of its different words occur once and are not in
    the dictionary (with them in it, 82 of 100 come back), and many words are made of other words.
    """
    total = S.q_unspaced_words(spark, DATA).agg({"n_words": "sum", "n_found": "sum"}).first()
    assert total["sum(n_found)"] >= 0.6 * total["sum(n_words)"]


def cut_one_by_one(rows, costs, unknown):
    """Words, pieces and whole words of each row by ``best_path``."""
    out = []
    for row in rows:
        spans, at = set(), 0
        for w in row or []:
            spans.add((at, at + len(w)))
            at += len(w)
        ends = S.best_path("".join(row or []), costs, max(map(len, costs), default=1), unknown)
        out.append((len(spans), len(ends), sum(s in spans for s in zip([0, *ends], ends))))
    return out


@pytest.mark.parametrize("window, few, steps", [(1, 1, 1), (3, 2, 4), (8, 5, 2047), (G.WINDOW, G.FEW, G.STEPS)])
def test_graph_matches_best_path(monkeypatch, window, few, steps):
    """Windows, segments beside others and alone, unknown characters, nulls, empty words and characters beyond 16 bits."""
    for name, value in (("WINDOW", window), ("FEW", few), ("STEPS", steps)):
        monkeypatch.setattr(G, name, value)
    r = random.Random(window)
    for _ in range(25):
        letters = "abcé界😀x"[: r.randint(1, 7)]
        word = lambda more="", least=1: "".join(r.choice(letters + more) for _ in range(r.randint(least, 6)))
        costs, unknown = {word(): r.randint(0, 9) for _ in range(r.randint(0, 12))}, r.choice([3, 9, 50])
        rows = [None if r.random() < 0.1 else [word("q", r.random() > 0.1) for _ in range(r.randint(0, 12))] for _ in range(r.randint(0, 6))]
        got = G.WordGraph(costs, unknown).counts(pa.array([None, *rows], pa.list_(pa.string())).slice(1))
        assert list(zip(*[c.tolist() for c in got])) == cut_one_by_one(rows, costs, unknown), (costs, unknown, rows)


def test_graph_takes_a_fraction_of_the_loop_s_time(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r[0] for r in docs.select(S.letters(S.F.col("text"))).collect()]
    segmenter = S.Segmenter(S.learned(docs))
    graph, words = G.WordGraph(segmenter.costs, segmenter.unknown), pa.array(rows, pa.list_(pa.string()))
    begun = time.process_time()
    got = list(zip(*[c.tolist() for c in graph.counts(words)]))
    took, begun = time.process_time() - begun, time.process_time()
    assert got[:300] == cut_one_by_one(rows[:300], segmenter.costs, segmenter.unknown)
    loop = (time.process_time() - begun) * sum(len("".join(r)) for r in rows) / sum(len("".join(r)) for r in rows[:300])
    found = segmenter.found(docs, "doc_id", S.letters(S.F.col("text")))
    begun = time.time()
    assert sorted(tuple(r)[1:] for r in found.collect()) == sorted(got)
    assert took < loop / 3 and time.time() - begun < loop


def test_a_text_without_a_free_place(monkeypatch):
    monkeypatch.setattr(G, "WINDOW", 64)
    costs = {"a": 40, "ab": 55, "bc": 60, "ca": 41, "b": 45, "c": 30, "abca": 150}
    rows = [["abc" * 4000], ["q"], ["cab" * 3000]]
    assert list(zip(*[c.tolist() for c in G.WordGraph(costs, 90).counts(pa.array(rows))])) == cut_one_by_one(rows, costs, 90)
