"""Streamed sessions with timers against a plain loop, over restarts and a batch that runs again."""

from datetime import datetime, timedelta

from siltstone.streaming.timers import SessionTable

START = datetime(2024, 1, 1)


def plain(events, late=10):
    out, by = {}, {}
    now = max(t for _, t in events) - late
    for u, t in sorted(events):
        by.setdefault(u, []).append(t)
    for u, times in by.items():
        runs = [[times[0]]]
        for t in times[1:]:
            if t - runs[-1][-1] > 30:
                runs.append([])
            runs[-1].append(t)
        for r, following in zip(runs, [*runs[1:], None]):
            gap = following[0] - r[-1] if following else None
            if gap is None:
                end = (r[-1], "stale") if r[-1] + 480 <= now else (None, "active")
            else:
                end = (following[0], "idle") if gap <= 480 else (r[-1], "stale")
            out[u, r[0]] = (r[-1], len(r), *end)
    return out


def test_sessions_over_restarts(spark, tmp_path):
    events = [(1, m) for m in (0, 10, 40, 71, 100, 700, 705, 2000)] + [(2, m) for m in (5, 6, 7)] + [(3, 1990)] + [(4, m) for m in range(0, 1500, 29)] + [(5, m) for m in (100, 580, 1061)]
    table = SessionTable(spark, str(tmp_path / "sessions"))
    df = lambda rows: spark.createDataFrame([(u, START + timedelta(minutes=m)) for u, m in rows], "user_id long, ts timestamp")
    for low, high in ((0, 90), (90, 1000), (1000, 3000)):
        table.land(df([e for e in events if low <= e[1] < high]))
        table.run()
    first = spark.read.parquet(f"{table.path}/sessions/batch=0")
    table._keep(spark.createDataFrame(first.collect(), first.schema), 0)  # a batch that runs again replaces itself
    table.run()
    base = int(spark.sql(f"SELECT unix_micros(timestamp '{START}')").first()[0])
    minute = lambda x: None if x is None else (x - base) // 60_000_000
    got = {(r.user_id, minute(r.started)): (minute(r.last), r.events, minute(r.ended), r.reason) for r in table.read().collect()}
    assert got == plain(events)
