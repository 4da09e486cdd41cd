"""A log of corrections, replayed in order of time on the relations it names.

An action takes a relation from one feedback to another, or is refused; so it is a function of the
feedback before it, and functions compose.  A long log on one relation is cut in pieces by time: each
piece becomes one function (four feedbacks to four), the few functions of a relation give the feedback
that each piece begins with, and then all pieces are replayed side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators.ordered import Ordered
from siltstone.operators.relations import TRANSITIONS
from siltstone.sources.tables import load

FEEDBACK = ["None", "Confirmed", "Rejected", "Adjusted"]
#: A batch rejection sets its relations to rejected whatever they were.
BATCH = "BatchRejected"
#: By action: the feedback after it for each feedback before, -1 where it is refused.
NEXT = {a: [FEEDBACK.index(a) if (f, a) in TRANSITIONS else -1 for f in FEEDBACK] for a in FEEDBACK} | {BATCH: [2] * 4}
#: What a rejection may block: this pair, the source with the target's tag, both tags, and (batches) the file.
SCOPES = ["FilePair", "FileToTag", "TagPair", "FileAllAI"]
KEY = ["source", "target"]
ORDER = ["ts", "action_id"]


def with_batches(actions: DataFrame, batches: DataFrame, relations: DataFrame) -> DataFrame:
    """Actions (source, target, ts, action_id, action, value, scope) with the rejections that batches mean.

    A batch (file, ts, action_id, kinds, block) rejects the file's machine-made relations of these kinds
    (null: all), whichever end the file is.
    """
    made = relations.where("origin = 'AIGenerated'").select(*KEY, "kind")
    ends = made.withColumn("file", F.col("source")).unionByName(made.where("source <> target").withColumn("file", F.col("target")))
    hit = batches.join(ends, "file").where(F.col("kinds").isNull() | F.array_contains("kinds", F.col("kind")))
    rows = hit.select(*KEY, *ORDER, F.lit(BATCH).alias("action"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("scope"))
    return actions.select(*rows.columns).unionByName(rows)


def replay(relations: DataFrame, actions: DataFrame) -> DataFrame:
    """Every action on one of ``relations`` (source, target, feedback, ...) with ``before``, ``after`` and ``accepted``.

    Actions of one time come in order of ``action_id``, which tells the actions of a relation apart.
    Unknown actions are refused; actions on a relation that is not there are left out.
    """
    known = relations.select(*KEY, F.coalesce("feedback", F.lit("None")).alias("first"))
    log = actions.join(known, KEY).withColumn("first", F.coalesce(F.array_position(F.array(*map(F.lit, FEEDBACK)), F.col("first")) - 1, F.lit(0)).cast("int"))
    pieces = Ordered(log, KEY, ORDER).df
    kinds = dict(pieces.dtypes)

    def sorted_pieces(df: DataFrame) -> DataFrame:
        return df.repartition("piece").sortWithinPartitions("piece", *KEY, *ORDER)

    def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, [0, 1, 2, 3]
        out: list[tuple] = []
        for b in batches:
            for *key, action in zip(*(b.column(c).to_pylist() for c in ("piece", *KEY, "action"))):
                if key != now:
                    if now is not None:
                        out.append((*now, f))
                    now, f = key, [0, 1, 2, 3]
                step = NEXT.get(action, [-1] * 4)
                f = [step[s] if step[s] >= 0 else s for s in f]
            if len(out) > 10_000:
                yield spell(out)
                out = []
        yield spell(out + ([(*now, f)] if now is not None else []))

    def spell(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.int32()))], ["piece", *KEY, "f"])

    each = sorted_pieces(pieces.select("piece", *KEY, *ORDER, "action")).mapInArrow(functions, "piece int, source long, target long, f array<int>")
    # only relations in several pieces have a start of their own; they are at most as many as the pieces
    earlier = Window.partitionBy(*KEY).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.withColumn("fs", F.collect_list("f").over(earlier)).where("size(fs) > 0").select("piece", *KEY, "fs")
    begun = pieces.join(F.broadcast(starts), ["piece", *KEY], "left").withColumn("state", F.expr("aggregate(coalesce(fs, array()), first, (s, f) -> f[s])")).drop("fs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, 0
        for b in batches:
            before, after, accepted = [], [], []
            for *key, action, first in zip(*(b.column(c).to_pylist() for c in ("piece", *KEY, "action", "state"))):
                if key != now:
                    now, state = key, first
                step = NEXT.get(action, [-1] * 4)[state]
                before.append(FEEDBACK[state])
                state = step if step >= 0 else state
                after.append(FEEDBACK[state]), accepted.append(step >= 0)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(before, pa.string()), pa.array(after, pa.string()), pa.array(accepted, pa.bool_())], [*names, "before", "after", "accepted"])

    names = [*KEY, *ORDER, "action", "value", "scope"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    return sorted_pieces(begun).mapInArrow(run, f"{schema}, before string, after string, accepted boolean")


def corrected(relations: DataFrame, done: DataFrame) -> DataFrame:
    """(source, target, feedback, strength, refused): the relations after a replay; an accepted adjustment sets the strength, within 0 and 1."""
    at = F.struct(*ORDER)
    last = done.groupBy(*KEY).agg(
        F.max_by("after", at).alias("after"), F.count_if(~F.col("accepted")).alias("refused"),
        F.max_by(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "value")), F.when(F.col("accepted") & (F.col("action") == "Adjusted"), at)).alias("set"),
    )
    return relations.join(last, KEY, "left").select(*KEY, F.coalesce("after", "feedback").alias("feedback"), F.coalesce("set", "strength").alias("strength"), F.coalesce("refused", F.lit(0)).alias("refused"))


def new_rules(done: DataFrame, batches: DataFrame) -> DataFrame:
    """(rule_type, a, b): the rules that accepted rejections with a scope and blocking batches create; tags are files' last digits."""
    tag = lambda c: F.pmod(c, F.lit(10))
    r = done.where("accepted AND action = 'Rejected' AND scope IS NOT NULL")
    a = F.when(F.col("scope") == "TagPair", tag("source")).otherwise(F.col("source"))
    b = F.when(F.col("scope") == "FilePair", F.col("target")).otherwise(tag("target"))
    files = batches.where("block").select(F.lit("FileAllAI").alias("rule_type"), F.col("file").alias("a"), F.lit(None).cast("long").alias("b"))
    return r.select(F.col("scope").alias("rule_type"), a.alias("a"), b.alias("b")).unionByName(files).distinct()


def order_log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Relations, single actions and batches: an order line is an action on the relation of its supplier with the file of its quantity; one without tax that came back rejects all of the supplier's."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), (F.col("l_quantity").cast("long") + 1_000_000).alias("target"), F.col("l_shipdate").alias("ts"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("action_id"), "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber")
    batch = (F.col("l_tax") == 0) & (F.col("l_returnflag") == "R")
    relations = li.select(*KEY).distinct().select(*KEY, F.lit("None").alias("feedback"), F.lit(0.5).alias("strength"), F.when(F.col("source") % 2 == 0, "AIGenerated").otherwise("User").alias("origin"), F.when(F.col("target") % 3 == 0, "SameProject").otherwise("ContentSimilar").alias("kind"))
    action = F.when(F.col("l_discount") < 0.03, "Confirmed").when(F.col("l_discount") < 0.06, "Rejected").otherwise("Adjusted")
    scope = F.when(F.col("l_linestatus") == "F", F.element_at(F.array(*map(F.lit, SCOPES[:3])), (F.col("l_linenumber") % 3 + 1).cast("int")))
    actions = li.where(~batch).select(*KEY, *ORDER, action.alias("action"), (F.col("l_tax") * 20 - 0.2).alias("value"), F.when(action == "Rejected", scope).alias("scope"))
    kinds = F.when(F.col("l_linenumber") < 3, F.array(F.lit("ContentSimilar")))
    batches = li.where(batch).select(F.col("source").alias("file"), *ORDER, kinds.alias("kinds"), (F.col("l_linestatus") == "F").alias("block"))
    return relations, actions, batches


def q_relation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations after all single and batch actions in order of time."""
    relations, actions, batches = order_log(spark, sf_dir)
    out = corrected(relations, replay(relations, with_batches(actions, batches, relations)))
    return out.withColumn("strength", F.round("strength", 6))


def q_relation_log_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The block rules that these actions create, by scope."""
    relations, actions, batches = order_log(spark, sf_dir)
    rules = new_rules(replay(relations, with_batches(actions, batches, relations)), batches)
    return rules.select("rule_type", "a", F.coalesce("b", F.lit(-1)).alias("b"))


QUERIES = {"relation_log": q_relation_log, "relation_log_rules": q_relation_log_rules}
_LOG = f"""li AS (SELECT l_suppkey AS source, CAST(l_quantity AS BIGINT) + 1000000 AS target, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS action_id, l_tax, l_linenumber,
      CASE WHEN l_tax = 0 AND l_returnflag = 'R' THEN '{BATCH}' WHEN l_discount < 0.03 THEN 'Confirmed' WHEN l_discount < 0.06 THEN 'Rejected' ELSE 'Adjusted' END AS action, l_linestatus = 'F' AS block FROM lineitem),
    rel AS (SELECT DISTINCT source, target FROM li),
    acts AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY ts, action_id) AS n FROM (
      SELECT source, target, ts, action_id, action, l_tax * 20 - 0.2 AS value, block AND action = 'Rejected' AS block, l_linenumber % 3 + 1 AS scope FROM li WHERE action <> '{BATCH}'
      UNION ALL SELECT rel.source, rel.target, ts, action_id, action, NULL, false, 0 FROM li JOIN rel ON rel.source = li.source AND rel.source % 2 = 0 AND (l_linenumber >= 3 OR rel.target % 3 <> 0) WHERE action = '{BATCH}')),
    st AS (SELECT source, target, 0::BIGINT AS n, 'None' AS feedback, 0.5::DOUBLE AS strength, 0::BIGINT AS refused, 0 AS rule FROM rel
      UNION ALL SELECT st.source, st.target, a.n, CASE WHEN NOT ok THEN st.feedback WHEN a.action = '{BATCH}' THEN 'Rejected' ELSE a.action END,
        CASE WHEN ok AND a.action = 'Adjusted' THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, a.value)) ELSE st.strength END, st.refused + (NOT ok)::BIGINT, CASE WHEN ok AND a.block THEN a.scope ELSE 0 END
      FROM st JOIN acts a ON a.source = st.source AND a.target = st.target AND a.n = st.n + 1, LATERAL (SELECT a.action = '{BATCH}' OR (st.feedback || '>' || a.action) IN ({', '.join(f"'{a}>{b}'" for a, b in TRANSITIONS)}) AS ok))"""
ORACLE_SQL = {
    "relation_log": f"WITH RECURSIVE {_LOG} SELECT source, target, arg_max(feedback, n) AS feedback, round(arg_max(strength, n), 6) AS strength, arg_max(refused, n) AS refused FROM st GROUP BY ALL",
    "relation_log_rules": f"""WITH RECURSIVE {_LOG} SELECT DISTINCT (['FilePair', 'FileToTag', 'TagPair'])[rule] AS rule_type, CASE WHEN rule = 3 THEN source % 10 ELSE source END AS a, CASE WHEN rule = 1 THEN target ELSE target % 10 END AS b FROM st WHERE rule > 0
      UNION SELECT 'FileAllAI', source, -1 FROM li WHERE action = '{BATCH}' AND block""",
}
