"""The vector index against comparing all, and bulk inserts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import vector_index as V


@pytest.fixture(scope="module")
def vectors(spark):
    """Forty clusters, a third of all rows in one, equal vectors among them."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    of = np.where(rng.random(3000) < 0.33, 0, rng.integers(0, 40, 3000))
    x = centres[of] + 0.3 * rng.normal(size=(3000, 16))
    x[100:110] = x[100]
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, of))] + [(5000, None, 0), (5001, [], 0), (5002, [0.0] * 16, 0), (None, x[0].tolist(), 0), (5003, [float("nan")] * 16, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4).cache()


def brute(vectors, k):
    rows = [(r.vec_id, np.array(r.embedding)) for r in vectors.where("vec_id < 5000").collect()]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        s = np.round(x @ x[i], 6)
        s[i] = -2
        order = np.lexsort((ids, -s))[:k]
        out[int(ids[i])] = list(zip(ids[order].tolist(), s[order].tolist()))
    return out


def by_query(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    return out


def test_exact_mode_equals_comparing_all_and_probes_find_most(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "PART", 200)
    monkeypatch.setattr(V, "QUERIES_PART", 7)
    index = V.VectorIndex.build(vectors, str(tmp_path / "index"))
    asked = vectors.where("vec_id % 100 = 0 AND vec_id < 5000")
    want = brute(vectors, 10)
    got = by_query(index.search(asked, 10, probes=4, exact=True))
    assert {q: [s for _, s in h] for q, h in got.items()} == {q: pytest.approx([s for _, s in h], abs=2e-6) for q, h in want.items()}
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.999 * sum(map(len, want.values()))
    near = by_query(index.search(asked, 10, probes=8))
    recall = np.mean([len({v for v, _ in near.get(q, [])} & {v for v, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    # rows read: those of the visited cells, against all rows a query
    units = V.usable(asked)
    sizes = {r.cell: r.n for r in index.summary().collect()}
    read = sum(sizes[r.cell] for r in index.visits(units, 8).where("near").collect())
    assert read < 0.5 * len(want) * sum(sizes.values())
    assert index.rows().groupBy("cell", "part").count().agg(F.max("count")).first()[0] < 2 * 200


def test_no_vectors(spark, vectors, tmp_path):
    index = V.VectorIndex.build(vectors.where("vec_id = 5000"), str(tmp_path / "index"))
    assert index.rows().count() == 0


def test_bulk_insert_is_gapless_and_all_or_nothing(spark, tmp_path):
    table = V.VectorTable(spark, str(tmp_path / "table"), 2)
    assert table.read().count() == 0
    batch = spark.range(1000).select(F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.col("id").cast("int").alias("label")).repartition(7)
    assert table.insert(batch)
    for bad in (None, [1.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0], []):
        rows = batch.unionByName(spark.createDataFrame([(bad, 1)], "embedding array<float>, label int"))
        assert not table.insert(rows)
    assert table.read().count() == 1000 and table.insert(batch.limit(0)) and table.insert(batch.where("label < 10"))
    ids = sorted(r[0] for r in table.read().select("vec_id").collect())
    assert ids == list(range(1010))
    assert sorted(r[0] for r in table.read().select("label").collect()) == sorted([*range(1000), *range(10)])
