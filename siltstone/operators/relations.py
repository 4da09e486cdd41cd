"""Sessions, co-access and the relation graph with feedback, decay and block rules.

A user's events are a stream of file accesses (``props.k`` is the file); a session ends when more than
``GAP`` seconds pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.ordered import Ordered
from siltstone.sources.tables import load

GAP = 30 * 60
#: About as many files of a session meet as many others in one join key; larger sessions are cut in blocks.
BLOCK = 256
DAY = 24 * 3600
#: Point in time of all ages, just behind the newest line, so that results do not depend on the clock.
AS_OF = "2002-01-01 00:00:00"

# Which feedback may follow which.
TRANSITIONS = [
    ("None", "None"), ("None", "Confirmed"), ("None", "Rejected"), ("None", "Adjusted"), ("Confirmed", "Rejected"), ("Confirmed", "Adjusted"), ("Confirmed", "Confirmed"),
    ("Adjusted", "Confirmed"), ("Adjusted", "Rejected"), ("Adjusted", "Adjusted"), ("Rejected", "Confirmed"),
]


def sessions(events: DataFrame, gap: int = GAP) -> DataFrame:
    """``events`` with session_no: a new one where more than ``gap`` seconds passed since the user's last event.

    Runs in pieces with a carry, so a user with a third of all events is no one task's work.
    """
    idle = F.col("ts") - F.col("_last")
    new = F.when(idle.isNull() | (idle > F.make_dt_interval(secs=F.lit(gap))), 1).otherwise(0)
    seen = Ordered(events, ["user_id"], ["ts", "event_id"]).last_known("_last", F.col("ts"), inclusive=False)
    return seen.running_sum("session_no", new.cast("long")).result().drop("_last")


def _accesses(spark: SparkSession, sf_dir: str, gap: int) -> DataFrame:
    e = load(spark, sf_dir, "events").where("user_id IS NOT NULL").withColumn("file", F.get_json_object("props", "$.k").cast("long"))
    return sessions(e, gap)


def q_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(load(spark, sf_dir, "events"))
    return s.groupBy("user_id", "session_no").agg(F.count("*").alias("events"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def session_pairs(accesses: DataFrame) -> DataFrame:
    """(a, b, co, strength) of files opened in one session: min(1, 0.3 + 0.1 (co - 1)).

    A session's files are dealt by hash into blocks of about ``BLOCK``, and each pair of blocks is a key of
    the join, so a session of any length is many small keys; one of up to ``BLOCK`` files is a single key.
    """
    session = ["user_id", "session_no"]
    opened = accesses.where("file IS NOT NULL").select(*session, "file").distinct()
    blocks = opened.groupBy(*session).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    opened = opened.join(blocks, session).withColumn("block", F.pmod(F.xxhash64("file"), "blocks"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = opened.select(*session, F.col("file").alias("a"), F.col("block").alias("x"), every.alias("y"))
    right = opened.select(*session, F.col("file").alias("b"), F.col("block").alias("y"), every.alias("x"))
    pairs = left.join(right, [*session, "x", "y"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("co")).withColumn("strength", F.round(F.least(F.lit(1.0), 0.3 + 0.1 * (F.col("co") - 1)), 6))


def q_session_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_pairs(_accesses(spark, sf_dir, DAY))


def q_co_accessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that share a session with file 7: how many sessions, strongest first."""
    s = _accesses(spark, sf_dir, DAY).where("file IS NOT NULL").select("user_id", "session_no", "file").distinct()
    with_it = s.where("file = 7").select("user_id", "session_no")
    return s.join(with_it, ["user_id", "session_no"]).where("file <> 7").groupBy("file").agg(F.count("*").alias("sessions"))


def q_first_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order in which a session first opens its files."""
    s = _accesses(spark, sf_dir, DAY).where("file IS NOT NULL").groupBy("user_id", "session_no", "file").agg(F.min("ts").alias("first_ts"))
    return s.withColumn("position", F.row_number().over(Window.partitionBy("user_id", "session_no").orderBy("first_ts", "file")).cast("long"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relation graph: a line links its part to its supplier's first part; feedback and age follow the line."""
    li = load(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "Confirmed").when(F.col("l_returnflag") == "R", "Rejected").when(F.col("l_linenumber") == 7, "Adjusted").otherwise("None")
    return li.where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), kind.alias("feedback"), F.round(1 - F.col("l_discount") * 5, 6).alias("strength"), F.col("l_tax").alias("user_strength"), F.col("l_shipdate").alias("updated_at"), F.when(F.col("l_linenumber") % 2 == 0, "AIGenerated").otherwise("User").alias("origin"), F.col("l_orderkey").alias("edge_order"), F.col("l_linenumber").alias("edge_line"))


def score_edges(e: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """Adds score: strength after feedback, times 0.99 for every whole day of age."""
    s = F.when(F.col("feedback") == "Confirmed", F.least(F.lit(1.0), 1.2 * F.col("strength"))).when(F.col("feedback") == "Rejected", 0.0).when(F.col("feedback") == "Adjusted", F.col("user_strength")).otherwise(F.col("strength"))
    days = F.greatest(F.lit(0), F.expr(f"extract(DAY FROM (TIMESTAMP_NTZ '{as_of}' - updated_at))"))
    return e.withColumn("score", s * F.pow(F.lit(0.99), days))


def q_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best edges of each source, rejected ones left out."""
    e = score_edges(edges(spark, sf_dir).where("feedback <> 'Rejected'")).withColumn("score", F.round("score", 9))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "target", "edge_order", "edge_line"))
    return e.withColumn("rank", rank.cast("long")).where("rank <= 10").select("source", "target", "score", "rank")


def q_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges touching part 5 at either end: the other end and the direction."""
    e = edges(spark, sf_dir).select("source", "target", "strength")
    out = e.where("source = 5").select(F.col("target").alias("other"), F.lit("out").alias("direction"), "strength")
    return out.unionByName(e.where("target = 5").select(F.col("source").alias("other"), F.lit("in").alias("direction"), "strength"))


def apply_block_rules(e: DataFrame, file_rules: DataFrame, pair_rules: DataFrame) -> DataFrame:
    """AI edges survive only if no active rule names their pair (either way round) or their source."""
    ai, rest = e.where("origin = 'AIGenerated'"), e.where("origin <> 'AIGenerated'")
    keyed = ai.withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target"))
    pairs = pair_rules.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    kept = keyed.join(pairs, ["lo", "hi"], "left_anti").join(file_rules.select(F.col("file").alias("source")).distinct(), "source", "left_anti")
    return kept.select(*e.columns).unionByName(rest)


def q_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left after rules from rejected lines (pairs) and old urgent orders' customers (files)."""
    e = edges(spark, sf_dir)
    pairs = e.where("feedback = 'Rejected' AND edge_line = 1").select(F.col("target").alias("a"), F.col("source").alias("b"))
    o = load(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1994-01-01'")
    return apply_block_rules(e, o.select(F.col("o_custkey").alias("file")), pairs).groupBy("origin", "feedback").agg(F.count("*").alias("edges"), F.round(F.sum("strength"), 4).alias("strength"))


def q_new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session pairs that no edge links yet, in either direction."""
    pairs = session_pairs(_accesses(spark, sf_dir, DAY)).select("a", "b", "strength")
    have = edges(spark, sf_dir).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.join(have, ["a", "b"], "left_anti")


def q_two_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two hops of part 5 and their least distance."""
    e = edges(spark, sf_dir).select("source", "target").distinct()
    both = e.unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    reached = spark.range(5, 6).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("hops"))
    for hop in (1, 2):
        step = both.join(reached.where(F.col("hops") == hop - 1).select(F.col("node").alias("source")), "source").select(F.col("target").alias("node"), F.lit(hop).cast("long").alias("hops"))
        reached = reached.unionByName(step).groupBy("node").agg(F.min("hops").alias("hops"))
    return reached


def q_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive feedback on a part: which changes the transition table allows."""
    order = Window.partitionBy("source").orderBy("updated_at", "edge_order", "edge_line")
    f = edges(spark, sf_dir).withColumn("before", F.coalesce(F.lag("feedback").over(order), F.lit("None")))
    allowed = spark.createDataFrame(TRANSITIONS, "before string, feedback string").withColumn("allowed", F.lit(True))
    return f.join(F.broadcast(allowed), ["before", "feedback"], "left").groupBy("before", "feedback", F.coalesce("allowed", F.lit(False)).alias("allowed")).agg(F.count("*").alias("n"))


_E = "e AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS file FROM events)"


def _sess(gap: int) -> str:
    return f"{_E}, n AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {gap * 1_000_000} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session_no FROM n)"


_EDGES = """edges AS (SELECT l_partkey AS source, l_suppkey AS target, CASE WHEN l_returnflag = 'A' THEN 'Confirmed' WHEN l_returnflag = 'R' THEN 'Rejected' WHEN l_linenumber = 7 THEN 'Adjusted' ELSE 'None' END AS feedback,
  round(1 - l_discount * 5, 6) AS strength, l_tax AS user_strength, l_shipdate AS updated_at, CASE WHEN l_linenumber % 2 = 0 THEN 'AIGenerated' ELSE 'User' END AS origin, l_orderkey AS edge_order, l_linenumber AS edge_line FROM lineitem WHERE l_partkey <> l_suppkey)"""
_PAIRS = "o AS (SELECT DISTINCT user_id, session_no, file FROM s WHERE file IS NOT NULL), pairs AS (SELECT x.file AS a, y.file AS b, count(*) AS co, round(least(1.0, 0.3 + 0.1 * (count(*) - 1))::DOUBLE, 6) AS strength FROM o x JOIN o y ON x.user_id = y.user_id AND x.session_no = y.session_no AND x.file < y.file GROUP BY 1, 2)"

QUERIES = {
    "sessions": q_sessions, "session_pairs": q_session_pairs, "co_accessed": q_co_accessed, "first_access": q_first_access, "related": q_related, "neighbours": q_neighbours, "block_rules": q_block_rules, "new_pairs": q_new_pairs,
    "two_hops": q_two_hops, "transitions": q_transitions,
}
ORACLE_SQL = {
    "sessions": f"WITH {_sess(GAP)} SELECT user_id, session_no, count(*) AS events, min(ts) AS started, max(ts) AS ended FROM s GROUP BY 1, 2",
    "session_pairs": f"WITH {_sess(DAY)}, {_PAIRS} SELECT * FROM pairs",
    "co_accessed": f"WITH {_sess(DAY)}, {_PAIRS} SELECT CASE WHEN a = 7 THEN b ELSE a END AS file, co AS sessions FROM pairs WHERE a = 7 OR b = 7",
    "first_access": f"WITH {_sess(DAY)} SELECT user_id, session_no, file, min(ts) AS first_ts, row_number() OVER (PARTITION BY user_id, session_no ORDER BY min(ts), file) AS position FROM s WHERE file IS NOT NULL GROUP BY 1, 2, 3",
    "related": f"""WITH {_EDGES}, d AS (SELECT *, round(CASE feedback WHEN 'Confirmed' THEN least(1.0, 1.2 * strength) WHEN 'Adjusted' THEN user_strength ELSE strength END
      * pow(0.99, greatest(0, floor(epoch(TIMESTAMP '{AS_OF}' - updated_at) / 86400))), 9) AS score FROM edges WHERE feedback <> 'Rejected')
    SELECT source, target, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target, edge_order, edge_line) AS rank FROM d) WHERE rank <= 10""",
    "neighbours": f"WITH {_EDGES} SELECT target AS other, 'out' AS direction, strength FROM edges WHERE source = 5 UNION ALL SELECT source, 'in', strength FROM edges WHERE target = 5",
    "block_rules": f"""WITH {_EDGES}, pr AS (SELECT DISTINCT least(source, target) AS lo, greatest(source, target) AS hi FROM edges WHERE feedback = 'Rejected' AND edge_line = 1),
    fr AS (SELECT DISTINCT o_custkey AS file FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate < TIMESTAMP '1994-01-01')
    SELECT origin, feedback, count(*) AS edges, round(sum(strength), 4) AS strength FROM edges WHERE origin = 'User' OR (NOT EXISTS (SELECT 1 FROM pr WHERE lo = least(source, target) AND hi = greatest(source, target)) AND source NOT IN (SELECT file FROM fr)) GROUP BY 1, 2""",
    "new_pairs": f"WITH {_sess(DAY)}, {_PAIRS}, {_EDGES} SELECT a, b, strength FROM pairs WHERE NOT EXISTS (SELECT 1 FROM edges WHERE least(source, target) = a AND greatest(source, target) = b)",
    "two_hops": f"""WITH {_EDGES}, g AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), h AS (SELECT 5::BIGINT AS node, 0::BIGINT AS hops UNION ALL SELECT target, 1 FROM g WHERE source = 5 UNION ALL SELECT y.target, 2 FROM g x JOIN g y ON y.source = x.target WHERE x.source = 5)
    SELECT node, min(hops) AS hops FROM h GROUP BY node""",
    "transitions": f"""WITH {_EDGES}, f AS (SELECT feedback, coalesce(lag(feedback) OVER (PARTITION BY source ORDER BY updated_at, edge_order, edge_line), 'None') AS before FROM edges), t(before, feedback) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in TRANSITIONS)})
    SELECT before, feedback, t.before IS NOT NULL AS allowed, count(*) AS n FROM f LEFT JOIN t USING (before, feedback) GROUP BY ALL""",
}
