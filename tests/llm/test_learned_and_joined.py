"""Operators 4, 7 and 8."""

import zlib

import numpy as np
import pytest
from compare import DATA, connect, same


from siltstone.llm import components, embedding_dedup, near_join, quality_classifier


def test_attention_gradient_learns_one_bad_passage():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(rng.integers(1, 8), 6)).astype(np.float32) for _ in range(400)]
    y = np.array([i % 2 for i in range(400)], np.float32)
    for b, v in zip(bags, y):
        if not v:
            b[rng.integers(len(b))] += [4, 0, -4, 0, 0, 0]
    x, doc = np.concatenate(bags), np.repeat(np.arange(400), [len(b) for b in bags])
    m = quality_classifier.fit_attention(x, doc, y)
    assert ((m.score(x, doc) >= 0.5) == y).mean() > 0.95
    assert quality_classifier.fit_attention(x[:0], doc[:0], y[:0]).score(x[:3], np.array([0, 0, 1])).tolist() == [0.5, 0.5]


def test_classifier_held_out_accuracy(spark):
    got = {r.doc_id: r for r in quality_classifier.op4_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    labels = [r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].predicted == r.quality for r in labels) / len(labels) > 0.95


def test_classify_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 0)], "doc_id long, quality int")
    m = quality_classifier.fit_classifier(odd, labels)
    got = quality_classifier.classify(odd, m).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.classify(empty, m).count() == 0
    assert quality_classifier.classify(odd, quality_classifier.fit_classifier(empty, labels)).count() == odd.count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 99), (99, 100), (7, 7), (None, 3), (60, 50), (61, 50), (61, 62)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 99: 99, 100: 99, **{i: 50 for i in (50, 60, 61, 62)}}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_join_matches_sql(spark):
    same(near_join.op8_near_join(spark, DATA).toPandas(), connect(DATA).execute(near_join.OP8_SQL).df())


def brute_links(texts):
    def grams(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    g = {i: grams(t) for i, t in texts.items()}
    return {i: {j for j in g if j != i and g[i] and 10 * len(g[i] & g[j]) >= 8 * len(g[i] | g[j])} for i in g}


def test_near_join_large_groups(spark, monkeypatch):
    """Groups beyond the small-node and block sizes, near copies, exact copies and short texts against brute force."""
    monkeypatch.setattr(near_join, "SMALL", 10)
    monkeypatch.setattr(near_join, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 120)]
    texts = {}
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 3)):
            w[k] = f"x{i}_{k}"
        texts[i] = " ".join(w)
    for i in range(60, 80):
        texts[i] = " ".join(f"v{k}" for k in rng.integers(0, 5000, 40))
    texts |= {80: "a b", 81: "a b", 82: "", 83: None, 84: texts[70] + " tail", 85: texts[70]}
    got = {r.doc_id: r for r in near_join.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = brute_links(texts)
    assert {i: r.n_links for i, r in got.items()} == {i: len(v) for i, v in want.items()}
    assert all(got[i].class_id == got[j].class_id for i in want for j in want[i])
    assert {r.class_id for r in got.values()} == {min([i, *(j for j in texts if got[j].class_id == got[i].class_id)]) for i in texts}


def test_near_join_odd_rows(odd, empty):
    got = near_join.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[6].class_id == by[7].class_id == 6 and by[7].n_links == 2 and by[None].kept and by[0].n_links == by[1].n_links == by[2].n_links == 0
    assert near_join.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("tile", [4096, 40])
def test_embeddings_match_brute_force(spark, tile):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 8))
    x[50:100] = x[:50] + 0.15 * rng.normal(size=(50, 8)) * np.linalg.norm(x[:50], axis=1, keepdims=True) / 3
    x[100:120] = x[7]
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [1.0, None] * 4), (204, []), (205, x[0][:4].tolist()), (None, x[0].tolist())]
    got = {r.vec_id: r for r in embedding_dedup.near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), tile=tile).collect()}
    d = x.astype(float)
    c = d @ d.T / np.linalg.norm(d, axis=1)[:, None] / np.linalg.norm(d, axis=1)[None, :] >= 0.9
    np.fill_diagonal(c, False)
    assert {i: got[i].n_links for i in range(150)} == dict(enumerate(c.sum(1).tolist())) and c.sum() > 400
    label = components.least_labels(150, *np.nonzero(c))
    assert {i: got[i].component_id for i in range(150)} == dict(enumerate(label.tolist()))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (200, 201, 202, 203, 204, 205))
    assert got[None].kept and got[None].component_id is None


def test_embeddings_of_any_size(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 6))
    x[1], x[3], x[5] = x[0] * 1e-200, x[2] * 1e200, x[4] * 3
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_embeddings(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    y = x / np.abs(x).max(1, keepdims=True)
    c = y @ y.T / np.linalg.norm(y, axis=1)[:, None] / np.linalg.norm(y, axis=1) >= 0.9
    np.fill_diagonal(c, False)
    assert got == dict(enumerate(c.sum(1).tolist())) and all(got[i] for i in range(6))


def test_embeddings_empty(spark):
    assert embedding_dedup.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_quantisation_bound_holds():
    x = np.random.default_rng(2).normal(size=(300, 16))
    q, s, n, e = embedding_dedup.quantise(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    bound = e[:, None] * n[None, :] + n[:, None] * e[None, :] + e[:, None] * e[None, :]
    assert (np.abs(u @ u.T - s * s * (q.astype(int) @ q.astype(int).T)) <= bound + 1e-12).all()
