"""Values along the order of one user who has most of the events, cut into many pieces, and busy sessions cut into blocks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from siltstone.operators import chunks, files, ordered, relations, requests

T0 = datetime(2024, 1, 1)


@pytest.fixture
def pieces(monkeypatch):
    monkeypatch.setattr(ordered, "PIECES", 7)


def events(n, seed):
    r = random.Random(seed)
    users = [r.choice([1, 1, 1, 2, None]) for _ in range(n)]
    times = [T0 + timedelta(minutes=r.choice([0, 1, 5, 29, 30, 31, 200]) + 40 * r.randrange(n)) for _ in range(n)]
    return [(u, i, t, r.choice(["From", "To"])) for i, (u, t) in enumerate(zip(users, times))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp, half string")


def by_user(rows):
    out = {}
    for u, i, t, half in sorted(rows, key=lambda r: (r[2], r[1])):
        out.setdefault(u, []).append((i, t, half))
    return out


def test_sessions_of_a_hot_user(spark, pieces):
    rows, want = events(300, 1), {}
    for u, es in by_user(rows).items():
        no, last = 0, None
        for i, t, _ in es:
            no += last is None or (t - last).total_seconds() > relations.GAP
            last, want[i] = t, no
    assert {r.event_id: r.session_no for r in relations.sessions(frame(spark, rows)).collect()} == want


@pytest.mark.parametrize("minutes", [30, 300])
def test_windows_of_a_hot_user(spark, pieces, minutes):
    rows, want = events(300, 2), {}
    for u, es in by_user(rows).items():
        start, n = None, 0
        for i, t, _ in es:
            if start is None or (t - start).total_seconds() >= 60 * minutes:
                start, n = t, 0
            n += 1
            want[i] = n
    assert {r.event_id: r.position for r in chunks.windows_from_first(frame(spark, rows), ["user_id"], 60 * minutes).collect()} == want


def test_renames_of_a_hot_user(spark, pieces):
    rows, want = [r for r in events(300, 3) if r[0] is not None], set()
    for u, es in by_user(rows).items():
        waiting = []
        for i, _, half in es:
            if half == "From":
                waiting.append(i)
            else:
                want.add((u, waiting.pop(0), i, "Renamed") if waiting else (u, None, i, "Created"))
    got = files.pair_renames(frame(spark, rows)).select("user_id", "from_event", "to_event", "kind").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_pairs_of_a_busy_session(spark, monkeypatch):
    monkeypatch.setattr(relations, "BLOCK", 4)
    r = random.Random(4)
    rows = [(1, s, r.randrange(40)) for s, n in ((1, 90), (2, 3), (3, 0), (4, 30)) for _ in range(n)] + [(1, 2, None)]
    want = {}
    for s in (1, 2, 4):
        f = sorted({x for _, y, x in rows if y == s and x is not None})
        for i, a in enumerate(f):
            for b in f[i + 1 :]:
                want[a, b] = want.get((a, b), 0) + 1
    got = relations.session_pairs(spark.createDataFrame(rows, "user_id long, session_no long, file long")).collect()
    assert len(got) == len(want) and {(x.a, x.b): x.co for x in got} == want


def test_parts_of_a_very_long_text(spark):
    text = "ab \n\n c\n\n\n\n" * 100_000
    got = requests.blocks(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n\n ")], "doc_id long, text string"))
    first = got.orderBy("number").limit(3).collect()
    assert [(r.number, r.start, r.end, r.preview) for r in first] == [(0, 0, 2, "ab"), (1, 6, 7, "c"), (2, 11, 13, "ab")]
    assert got.agg(F.count("*"), F.max("end")).first() == (200_000, len(text) - 4)
    lines = requests.parts_of(spark.createDataFrame([(3, ""), (4, "é\n\n")], "doc_id long, text string"), "\n").collect()
    assert sorted((r.doc_id, r.number, r.start, r.end, r.preview) for r in lines) == [(3, 0, 0, 0, ""), (4, 0, 0, 1, "é"), (4, 1, 2, 2, ""), (4, 2, 3, 3, "")]
