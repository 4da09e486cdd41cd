"""Trees of any depth by pointer doubling: paths, ancestors, cycles and checks of moves.

Every node keeps a pointer to an ancestor and the way there.  A round joins each pointer with the way of
the node it points to, so ways double and a tree of depth d takes about log2(d) rounds, each written to
the shared folder.  Depths have no gaps: once a round brings no further node to a root, the nodes that
are left have a cycle above them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.ordered import Ordered
from siltstone.sources.scratch import shared_folder, written
from siltstone.sources.tables import load


def ancestry(tree: DataFrame) -> DataFrame:
    """(tag, depth, ancestors, names, cyclic) of ``tree`` (tag, parent, name).

    ``ancestors`` and ``names`` go from the root to the tag itself.  A tag whose parent is null or is not
    there is a root.  A tag on a cycle, or below one, is cyclic and has nulls.  Tags are unique and not null.
    """
    spark = tree.sparkSession
    there = tree.select(F.col("tag").alias("parent"), F.lit(True).alias("there"))
    now = tree.join(there, "parent", "left").select("tag", F.when(F.col("there"), F.col("parent")).alias("up"), F.array("tag").alias("ancestors"), F.array("name").alias("names"))
    now, left = written(now, shared_folder(spark, "ways")), None
    while True:
        before, left = left, now.where("up IS NOT NULL").count()
        if not left or left == before:
            break
        way = now.select(F.col("tag").alias("up"), F.col("up").alias("further"), F.col("ancestors").alias("above"), F.col("names").alias("names_above"))
        done, open_ = now.where("up IS NULL"), now.where("up IS NOT NULL")
        more = open_.join(way, "up").select("tag", F.col("further").alias("up"), F.concat("above", "ancestors").alias("ancestors"), F.concat("names_above", "names").alias("names"))
        now = written(done.unionByName(more), shared_folder(spark, "ways"))
    cyclic = F.col("up").isNotNull()
    known = lambda c: F.when(~cyclic, c)
    return now.select("tag", known(F.size("ancestors") - 1).cast("long").alias("depth"), known(F.col("ancestors")).alias("ancestors"), known(F.col("names")).alias("names"), cyclic.alias("cyclic"))


def path(sep: str = " > ") -> Column:
    return F.array_join("names", sep)


def checked_moves(tree: DataFrame, moves: DataFrame, most_levels: int | None = None) -> DataFrame:
    """``moves`` (tag, new_parent) with ``verdict``: ok, cycle (the new parent is the tag or below it), missing, or too deep.

    A null new parent makes the tag a root.  Tags on or below a cycle count as missing.
    """
    known = ancestry(tree).where("NOT cyclic").select("tag", "depth", "ancestors")
    height = known.select(F.explode("ancestors").alias("tag"), "depth").groupBy("tag").agg(F.max("depth").alias("deepest"))
    own = known.join(height, "tag").select("tag", (F.col("deepest") - F.col("depth")).alias("height"))
    under = known.select(F.col("tag").alias("new_parent"), F.col("depth").alias("parent_depth"), "ancestors")
    j = moves.join(own, "tag", "left").join(under, "new_parent", "left")
    lost = F.col("height").isNull() | (F.col("new_parent").isNotNull() & F.col("parent_depth").isNull())
    verdict = F.when(lost, "missing").when(F.array_contains("ancestors", F.col("tag")), "cycle")
    if most_levels is not None:
        verdict = verdict.when(F.coalesce(F.col("parent_depth") + 1, F.lit(0)) + F.col("height") >= most_levels, "too deep")
    return j.select(*moves.columns, verdict.otherwise("ok").alias("verdict"))


def event_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event hangs below the event its ``props.k`` numbers; sign-ups hang below none."""
    k = F.get_json_object("props", "$.k").cast("long")
    return load(spark, sf_dir, "events").select(F.col("event_id").alias("tag"), F.when(F.col("event_type") != "signup", k).alias("parent"), F.col("event_type").alias("name"))


def q_linked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth, root and path of every event, and whether a cycle is above it."""
    a = ancestry(event_links(spark, sf_dir))
    return a.select(F.col("tag").alias("event_id"), F.coalesce("depth", F.lit(-1)).alias("depth"), F.coalesce(F.get("ancestors", F.lit(0)), F.lit(-1)).alias("root"), F.coalesce(path(), F.lit("")).alias("path"), "cyclic")


def q_event_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event hangs below its user's event before it: chains as long as users have events."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    linked = Ordered(e, ["user_id"], ["ts", "event_id"]).last_known("parent", F.col("event_id"), inclusive=False).result()
    a = ancestry(linked.select(F.col("event_id").alias("tag"), "parent", F.col("event_type").alias("name")))
    return a.select(F.col("tag").alias("event_id"), "depth", F.get("ancestors", F.lit(0)).alias("root"), F.md5(F.array_join("names", " > ")).alias("path_md5"))


QUERIES = {"linked_events": q_linked_events, "event_chains": q_event_chains}
ORACLE_SQL = {
    "linked_events": """WITH RECURSIVE t AS (SELECT event_id AS tag, CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS p, event_type AS name FROM events),
    tree AS (SELECT t.tag, CASE WHEN EXISTS (SELECT 1 FROM t o WHERE o.tag = t.p) THEN t.p END AS parent, t.name FROM t),
    below AS (SELECT tag, 0::BIGINT AS depth, tag AS root, name AS path FROM tree WHERE parent IS NULL
      UNION ALL SELECT tree.tag, below.depth + 1, below.root, below.path || ' > ' || tree.name FROM tree JOIN below ON tree.parent = below.tag)
    SELECT tree.tag AS event_id, coalesce(depth, -1) AS depth, coalesce(root, -1) AS root, coalesce(path, '') AS path, depth IS NULL AS cyclic FROM tree LEFT JOIN below ON tree.tag = below.tag""",
    "event_chains": """WITH RECURSIVE tree AS (SELECT event_id AS tag, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent, event_type AS name FROM events),
    below AS (SELECT tag, 0::BIGINT AS depth, tag AS root, name AS path FROM tree WHERE parent IS NULL
      UNION ALL SELECT tree.tag, below.depth + 1, below.root, below.path || ' > ' || tree.name FROM tree JOIN below ON tree.parent = below.tag)
    SELECT tag AS event_id, depth, root, md5(path) AS path_md5 FROM below""",
}
