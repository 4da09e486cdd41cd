"""Sessions over a stream of landed event files, with event-time timers and a table that survives restarts.

A session ends when its user's next event comes more than ``IDLE`` later (it ended then), or when
``STALE`` has passed since its last event without one (it ended with that event).  The keyed state is the
open session; a timer stands at the stale time.  Each micro-batch writes the sessions that it closed or
changed into a folder of its own number, so a batch that runs again after a failure replaces what it
wrote; a session's row in the latest batch is the one that counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siltstone.sources.scratch import shared_folder
from siltstone.sources.tables import load

MINUTE = 60_000_000
#: In microseconds.
IDLE, STALE = 30 * MINUTE, 480 * MINUTE
#: How late an event may be, in minutes.
LATE = 10
SESSION = "user_id long, started long, last long, events long, ended long, reason string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SessionTimer(StatefulProcessor):
    """Folds a user's events of a micro-batch in time order; reasons are active, idle and stale."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long, last long, events long")

    def row(self, key: tuple, at: tuple, ended: int | None, reason: str) -> tuple:
        return (key[0], *at, ended, reason)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for b in rows for t in b["at"].tolist())
        now = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for t in times:
            if now is None:
                now = (t, t, 1)
            elif t - now[1] > IDLE:
                stale = t - now[1] > STALE
                out.append(self.row(key, now, now[1] if stale else t, "stale" if stale else "idle"))
                now = (t, t, 1)
            else:
                now = (now[0], max(now[1], t), now[2] + 1)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(now[1] + STALE) // 1000))
        self.open.update(now)
        out.append(self.row(key, now, None, "active"))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SESSION.split(", ")]).astype({"ended": "Int64"})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = tuple(self.open.get())
        self.open.clear()
        yield pd.DataFrame([self.row(key, now, now[1], "stale")], columns=[c.split()[0] for c in SESSION.split(", ")]).astype({"ended": "Int64"})

    def close(self) -> None:
        pass


def timed_sessions(events: DataFrame) -> DataFrame:
    """The stream of changed and closed sessions of a stream (user_id, ts); events without user or time are left out."""
    rows = events.where("user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", f"{LATE} minutes").withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("user_id").transformWithStateInPandas(SessionTimer(), SESSION, "update", "EventTime")


class SessionTable:
    """Landing files, stream checkpoint and sessions below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def land(self, events: DataFrame) -> None:
        events.select("user_id", "ts").write.mode("append").parquet(f"{self.path}/landing")

    def run(self, files_per_batch: int = 64) -> None:
        """Take in what has landed since the last run, then stop; a run goes on where the one before, or a failed one, left off."""
        had = self.spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # timers need it
        try:
            stream = self.spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", files_per_batch).parquet(f"{self.path}/landing")
            write = timed_sessions(stream).writeStream.outputMode("update").foreachBatch(self._keep)
            write.option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        finally:
            self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", had)

    def _keep(self, rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/sessions/batch={batch}")

    def read(self) -> DataFrame:
        """(user_id, started, last, events, ended, reason), times in microseconds: each session as its latest batch has it."""
        rows = self.spark.read.schema(SESSION + ", batch long").parquet(f"{self.path}/sessions")
        # within one batch a session may change and then close
        newest = F.max_by(F.struct("last", "events", "ended", "reason"), F.struct("batch", F.col("reason") != "active"))
        return rows.groupBy("user_id", "started").agg(newest.alias("now")).select("user_id", "started", "now.*")


def q_timed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all events, which land in three parts; the stream is started anew from its checkpoint for each."""
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    table = SessionTable(spark, shared_folder(spark, "sessions"))
    parts = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    third = F.floor((F.unix_micros("ts") - F.unix_micros("low")) * 3 / (F.unix_micros("high") - F.unix_micros("low") + 1))
    cut = events.crossJoin(F.broadcast(parts)).withColumn("part", third)
    for k in range(3):
        table.land(cut.where(F.col("part") == k))
        table.run()
    return table.read().withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("started", "last", "ended")})


QUERIES = {"timed_sessions": q_timed_sessions}
ORACLE_SQL = {
    "timed_sessions": f"""WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    gaps AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {IDLE} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS no FROM gaps),
    s AS (SELECT user_id, no, min(us) AS started, max(us) AS last, count(*) AS events FROM numbered GROUP BY ALL),
    n AS (SELECT *, lead(started) OVER (PARTITION BY user_id ORDER BY no) AS next, (SELECT max(us) FROM e) - {LATE * MINUTE} AS now FROM s)
    SELECT user_id, make_timestamp(started::BIGINT) AS started, make_timestamp(last::BIGINT) AS last, events, make_timestamp((CASE WHEN next IS NULL AND last + {STALE} > now THEN NULL WHEN next - last <= {STALE} THEN next ELSE last END)::BIGINT) AS ended,
      CASE WHEN next IS NULL AND last + {STALE} > now THEN 'active' WHEN next - last <= {STALE} THEN 'idle' ELSE 'stale' END AS reason FROM n""",
}
