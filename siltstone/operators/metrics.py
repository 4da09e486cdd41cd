"""Metrics, costs, rate limits and the task queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import load

# Price per million tokens.
PRICES = {"O": 0.375, "F": 0.625, "P": 0.5}


def q_metric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    v = F.round("value", 6).cast("decimal(20,6)")
    return e.groupBy("event_type").agg(
        F.count("*").alias("n"), F.sum(v).cast("double").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.round(F.sum(v).cast("double") / F.count("*"), 6).alias("mean"), F.max_by("value", F.struct("ts", "event_id")).alias("last"), F.max("ts").alias("last_updated"))


def q_metric_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a day and a column a metric (the table has five event types)."""
    e = load(spark, sf_dir, "events").withColumn("day", F.date_trunc("day", "ts"))
    kinds = ["click", "error", "purchase", "signup", "view"]
    return e.groupBy("day").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds])


def q_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter samples: each event of a user and type is the last count plus one."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.row_number().over(order).cast("long").alias("counter"))


def q_last_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five samples of each user (a ring buffer)."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return load(spark, sf_dir, "events").withColumn("r", F.row_number().over(newest)).where("r <= 5").select("user_id", "event_id", F.col("r").cast("long").alias("age_rank"))


def q_monthly_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests, tokens (whole order value) and cost of each month, and whether the budget is spent."""
    price = F.when(F.col("o_orderstatus") == "O", PRICES["O"]).when(F.col("o_orderstatus") == "F", PRICES["F"]).otherwise(PRICES["P"])
    tokens = F.floor("o_totalprice").cast("long")
    o = load(spark, sf_dir, "orders").select(F.date_trunc("month", "o_orderdate").alias("month"), tokens.alias("tokens"), (tokens * (price * 1000).cast("long")).alias("nano"))
    m = o.groupBy("month").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), F.sum("nano").alias("nano"))
    return m.select("month", "requests", "tokens", F.round(F.col("nano") / 1e9, 6).alias("cost"), (F.col("nano") / 1e9 >= 10).alias("limit_reached"))


def q_recent_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


def q_state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at which a user's state (event type) differs from the one before."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf_dir, "events").withColumn("was", F.lag("event_type").over(order))
    return e.where("was IS NOT NULL AND was <> event_type").select("event_id", "user_id", "was", F.col("event_type").alias("now"))


def q_sampled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry sampling: a sixteenth of the views by id hash, all other events."""
    e = load(spark, sf_dir, "events")
    return e.where((F.col("event_type") != "view") | F.md5(F.col("event_id").cast("string")).startswith("0")).select("event_id", "event_type")


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as index tasks: priority 0 to 3, retries, next retry and error."""
    o = load(spark, sf_dir, "orders")
    p = F.least(F.lit(3), 5 - F.substring("o_orderpriority", 1, 1).cast("int"))
    retries = (F.col("o_orderkey") % 8).cast("int")
    return o.select(F.col("o_orderkey").alias("task_id"), p.alias("priority"), retries.alias("retry_count"), F.when(retries > 0, F.col("o_orderdate")).alias("next_retry_at"), F.col("o_orderstatus").alias("error"), "o_orderdate")


def q_scheduler_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten ready tasks to run next: priority first, then those never tried, then the earliest retry."""
    ready = tasks(spark, sf_dir).where("retry_count < 5 AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '1995-06-01')")
    return ready.orderBy(F.desc("priority"), F.asc_nulls_first("next_retry_at"), "task_id").limit(10).select("task_id", "priority")


def q_retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and back-off (2^min(n, 4) s, jitter by id) of each task; five failures go to the dead letters."""
    jitter = 0.75 + 0.5 * F.conv(F.substring(F.md5(F.col("task_id").cast("string")), 1, 4), 16, 10).cast("long") / 65536
    delay = F.pow(F.lit(2.0), F.least("retry_count", F.lit(4))) * jitter
    t = tasks(spark, sf_dir)
    return t.select("task_id", F.when(F.col("retry_count") >= 5, "DeadLetter").when(F.col("retry_count") > 0, "Retrying").otherwise("Pending").alias("status"), F.round(F.when(F.col("retry_count").between(1, 4), delay), 6).alias("delay_s"))


def q_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters by error: how many, the oldest and the newest, and the share of a queue of 100,000."""
    t = tasks(spark, sf_dir).where("retry_count >= 5")
    return t.groupBy("error").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("oldest"), F.max("o_orderdate").alias("newest"), F.round(F.count("*") / 1000.0, 6).alias("utilisation"))


def q_newest_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded queue: the 50 newest dead letters of each error."""
    newest = Window.partitionBy("error").orderBy(F.desc("o_orderdate"), "task_id")
    return tasks(spark, sf_dir).where("retry_count >= 5").withColumn("r", F.row_number().over(newest)).where("r <= 50").select("error", "task_id")


def q_export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics as JSON lines, one per user."""
    e = load(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"))
    return e.select("user_id", F.to_json(F.struct("n", "kinds")).alias("json"))


_TASKS = "t AS (SELECT o_orderkey AS task_id, least(3, 5 - CAST(substring(o_orderpriority, 1, 1) AS INT)) AS priority, CAST(o_orderkey % 8 AS INT) AS retry_count, CASE WHEN o_orderkey % 8 > 0 THEN o_orderdate END AS next_retry_at, o_orderstatus AS error, o_orderdate FROM orders)"

QUERIES = {
    "metric_stats": q_metric_stats, "metric_pivot": q_metric_pivot, "counter": q_counter, "last_samples": q_last_samples, "monthly_cost": q_monthly_cost, "recent_usage": q_recent_usage, "state_changes": q_state_changes,
    "sampled_events": q_sampled_events, "scheduler_pick": q_scheduler_pick, "retry_plan": q_retry_plan, "dead_letters": q_dead_letters, "newest_dead_letters": q_newest_dead_letters, "export_json": q_export_json,
}
ORACLE_SQL = {
    "metric_stats": """SELECT event_type, count(*) AS n, CAST(sum(CAST(round(value, 6) AS DECIMAL(20, 6))) AS DOUBLE) AS total, min(value) AS low, max(value) AS high, round(CAST(sum(CAST(round(value, 6) AS DECIMAL(20, 6))) AS DOUBLE) / count(*), 6) AS mean,
      arg_max(value, {'ts': ts, 'event_id': event_id}) AS last, max(ts) AS last_updated FROM events GROUP BY 1""",
    "metric_pivot": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "counter": "SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS counter FROM events",
    "last_samples": "SELECT user_id, event_id, r AS age_rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5",
    "monthly_cost": """WITH o AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, CAST(floor(o_totalprice) AS BIGINT) AS tokens, CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderstatus WHEN 'O' THEN 375 WHEN 'F' THEN 625 ELSE 500 END AS nano FROM orders)
    SELECT month, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(nano) / 1e9, 6) AS cost, sum(nano) / 1e9 >= 10 AS limit_reached FROM o GROUP BY 1""",
    "recent_usage": "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100",
    "state_changes": "SELECT event_id, user_id, was, event_type AS now FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE was <> event_type",
    "scheduler_pick": f"WITH {_TASKS} SELECT task_id, priority FROM t WHERE retry_count < 5 AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '1995-06-01') ORDER BY priority DESC, next_retry_at NULLS FIRST, task_id LIMIT 10",
    "dead_letters": f"WITH {_TASKS} SELECT error, count(*) AS n, min(o_orderdate) AS oldest, max(o_orderdate) AS newest, round(count(*) / 1000.0, 6)::DOUBLE AS utilisation FROM t WHERE retry_count >= 5 GROUP BY 1",
    "retry_plan": f"""WITH {_TASKS} SELECT task_id, CASE WHEN retry_count >= 5 THEN 'DeadLetter' WHEN retry_count > 0 THEN 'Retrying' ELSE 'Pending' END AS status,
      CASE WHEN retry_count BETWEEN 1 AND 4 THEN round(pow(2.0::DOUBLE, retry_count) * (0.75::DOUBLE + 0.5::DOUBLE * CAST('0x' || substring(md5(CAST(task_id AS VARCHAR)), 1, 4) AS BIGINT) / 65536), 6) END AS delay_s FROM t""",
    "newest_dead_letters": f"WITH {_TASKS} SELECT error, task_id FROM (SELECT *, row_number() OVER (PARTITION BY error ORDER BY o_orderdate DESC, task_id) AS r FROM t WHERE retry_count >= 5) WHERE r <= 50",
    "sampled_events": "SELECT event_id, event_type FROM events WHERE event_type <> 'view' OR starts_with(md5(CAST(event_id AS VARCHAR)), '0')",
    "export_json": "SELECT user_id, '{\"n\":' || count(*) || ',\"kinds\":' || count(DISTINCT event_type) || '}' AS json FROM events GROUP BY 1",
}
