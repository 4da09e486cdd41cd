"""Values carried across pieces, as-of and interval joins against plain loops; one key holds most rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import intervals as I
from siltstone.operators import ordered
from siltstone.operators.ordered import Ordered, as_of


@pytest.fixture(autouse=True)
def pieces(monkeypatch):
    monkeypatch.setattr(ordered, "PIECES", 6)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    keys = np.where(rng.random(600) < 0.6, 7, rng.integers(0, 9, 600))
    out = [(None if k == 3 else int(k), int(t), i, None if i % 3 else int(t) * 10) for i, (k, t) in enumerate(zip(keys, rng.integers(0, 400, 600)))]
    return out, spark.createDataFrame(out, "k long, t long, id long, v long").repartition(5)


def loops(rows):
    total, last, out = {}, {}, {}
    for k, t, i, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        before = total.get(k, 0), last.get(k)
        total[k] = total.get(k, 0) + t
        last[k] = v if v is not None else last.get(k)
        out[i] = (total[k], before[0], last[k], before[1])
    return out


def test_running_values_cross_pieces(rows):
    plain, df = rows
    o = Ordered(df, ["k"], ["t", "id"])
    assert o.df.where("k = 7").select("piece").distinct().count() > 1
    o.running_sum("s", F.col("t")).running_sum("b", F.col("t"), inclusive=False).last_known("l", F.col("v")).last_known("m", F.col("v"), inclusive=False)
    got = {r.id: (r.s, r.b, r.l, r.m) for r in o.result().collect()}
    assert got == loops(plain) and o.result().columns == ["k", "t", "id", "v", "s", "b", "l", "m"]


def test_as_of(spark, rows):
    plain, df = rows
    states = df.where("id % 4 = 0").select("k", "t", "id", F.concat(F.lit("s"), "id").alias("state"))
    asked = df.where("id % 4 <> 0").select("k", "t", "id", F.col("v").alias("extra"))
    got = {r.id: (r.state, r.extra) for r in as_of(asked, states, "k", "t", "id", "state").collect()}
    want = {}
    for k, t, i, v in plain:
        if i % 4:
            found = [(u, j) for q, u, j, _ in plain if j % 4 == 0 and q == k and u <= t]
            want[i] = (f"s{max(found)[1]}" if found else None, v)
    assert got == want


def test_points_meet_their_spans_without_a_nested_loop(spark):
    rng = np.random.default_rng(4)
    spans, at = [], 0
    for n in range(300):  # one document holds nearly all
        size = int(rng.integers(1, 90)) if n % 50 else 700
        spans.append((1, n, at, at + size))
        at += size + int(rng.integers(0, 3))
    spans += [(2, 0, 5, 5), (2, 1, 5, 9), (None, 2, 0, 99)]
    points = [(1, int(x)) for x in rng.integers(-5, at + 5, 500)] + [(2, 5), (2, 9), (3, 1), (None, 4), (2, None)]
    joined = I.point_in_interval(spark.createDataFrame(points, "d long, at long"), spark.createDataFrame(spans, "d long, n long, start long, end long"), "d", "at", "start", "end", 64)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = sorted((d, x, n) for d, x in points for e, n, a, b in spans if d is not None and x is not None and d == e and a <= x < b)
    assert sorted((r.d, r.at, r.n) for r in joined.collect()) == want


def test_paragraphs_and_hits_of_long_conversations(spark):
    turns = [(1, t, f"que a\n\n  \n\n{'long que ' * (t % 40)}\n\nend{t}") for t in range(120)] + [(2, 0, None), (2, 1, ""), (3, 0, "queque")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, text string").repartition(4)
    text = "\n\n".join(t for c, _, t in turns if c == 1)
    got = sorted((r.number, r.start, r.end, r.preview) for r in I.paragraphs(df).where("conv_id = 1").collect())
    want, at = [], 0
    for n, p in enumerate(text.split("\n\n")):
        if p.strip():
            want.append((n, at, at + len(p.strip()), p.strip()[:100] + ("..." if len(p.strip()) > 100 else "")))
        at += len(p) + 2
    assert got == want
    places = sorted(r.at for r in I.hits(df, "que").where("conv_id = 1").collect())
    assert places == [i for i in range(len(text)) if text.startswith("que", i)]
    assert sorted((r.conv_id, r.at) for r in I.hits(df, "que").where("conv_id > 1").collect()) == [(3, 0), (3, 3)]
