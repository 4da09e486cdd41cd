"""Changes of tags and of files' tags as plans: updates and renames, removals, batches, usage counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.tags import tag_tree
from siltstone.sources.tables import load


def update_tags(tags: DataFrame, changes: DataFrame) -> DataFrame:
    """(tag, verdict, name, parent): every tag of ``tags`` (tag, name, parent, is_system) after ``changes`` (tag, name, parent), and a row a change of a tag that is not there.

    A null in a change keeps the value.  A change is refused where its name is another tag's, or is given
    by several changes: ``taken``; ``missing`` is one of no tag, ``ok`` one that was made, ``same`` a tag
    without changes.  Of several changes of one tag the one with the greatest name, then parent, counts.
    """
    once = changes.groupBy("tag").agg(F.max(F.struct("name", "parent")).alias("c")).select("tag", F.col("c.name").alias("to_name"), F.col("c.parent").alias("to_parent"))
    holders = tags.select(F.col("name").alias("to_name"), F.col("tag").alias("holder")).groupBy("to_name").agg(F.min("holder").alias("holder"))
    wanted = once.where("to_name IS NOT NULL").groupBy("to_name").agg(F.count("*").alias("wishes"))
    j = tags.join(once.withColumn("asked", F.lit(True)), "tag", "full_outer").join(holders, "to_name", "left").join(wanted, "to_name", "left")
    taken = (F.col("holder").isNotNull() & (F.col("holder") != F.col("tag"))) | (F.col("wishes") > 1)
    verdict = F.when(F.col("asked").isNull(), "same").when(F.col("name").isNull(), "missing").when(F.coalesce(taken, F.lit(False)), "taken").otherwise("ok")
    ok = F.col("verdict") == "ok"
    return j.withColumn("verdict", verdict).select("tag", "verdict", F.when(ok, F.coalesce("to_name", "name")).otherwise(F.col("name")).alias("name"), F.when(ok, F.coalesce("to_parent", "parent")).otherwise(F.col("parent")).alias("parent"))


def remove_file_tags(have: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of ``have`` (file, tag, ...), and each row of ``gone`` (file, tag) with ``found``."""
    pairs = gone.select("file", "tag").distinct()
    known = have.select("file", "tag", F.lit(True).alias("known")).distinct()
    return have.join(pairs, ["file", "tag"], "left_anti"), pairs.join(known, ["file", "tag"], "left").select("file", "tag", F.coalesce("known", F.lit(False)).alias("found"))


def batch_tag(have: DataFrame, files: DataFrame, add: list, remove: list) -> DataFrame:
    """(file, tag, origin) after a batch on ``files`` (file): each gets the tags ``add`` it lacks by hand (origin Manual), then loses those of ``remove``.

    The two lists are a command's, so every file meets a few tags.
    """
    kind = dict(have.dtypes)["tag"]
    asked = files.select("file").distinct().select("file", F.explode(F.array(*[F.lit(t) for t in add])).alias("tag")).withColumn("tag", F.col("tag").cast(kind)) if add else None
    out = have.select("file", "tag", "origin")
    if asked is not None:
        out = out.unionByName(asked.join(have.select("file", "tag").distinct(), ["file", "tag"], "left_anti").withColumn("origin", F.lit("Manual")))
    if remove:
        touched = files.select("file", F.lit(True).alias("touched")).distinct()
        out = out.join(touched, "file", "left").where(~(F.coalesce("touched", F.lit(False)) & F.col("tag").isin(remove))).select("file", "tag", "origin")
    return out


def usage_after(tags: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(tag, usage_count) of ``tags`` (tag, usage_count) less the removals that were found, 0 at least."""
    less = verdicts.where("found").groupBy("tag").agg(F.count("*").alias("less"))
    return tags.join(less, "tag", "left").select("tag", F.greatest(F.lit(0), F.col("usage_count") - F.coalesce("less", F.lit(0))).alias("usage_count"))


def _tagged(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").where(rule).select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 20).alias("tag")).distinct()


def q_tag_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with an A get a longer name and move below the first region; two regions want the name of a nation, and a tag of no tree is asked for."""
    t = tag_tree(spark, sf_dir).withColumn("is_system", F.col("tag").startswith("r"))
    nations = t.where(F.col("tag").startswith("n") & F.col("name").contains("A")).select("tag", F.concat("name", F.lit(" (old)")).alias("name"), F.lit("r0").alias("parent"))
    other = spark.createDataFrame([("r1", "FRANCE", None), ("r2", "FRANCE", None), ("r3", "KENYA", None), ("zz", "new", None)], "tag string, name string, parent string")
    return update_tags(t, nations.unionByName(other)).select("tag", "verdict", F.coalesce("name", F.lit("-")).alias("name"), F.coalesce("parent", F.lit("-")).alias("parent"))


def q_tag_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of returned lines are taken from their files: usage counts after it, and how many removals found nothing."""
    have, gone = _tagged(spark, sf_dir, "l_linestatus = 'F'"), _tagged(spark, sf_dir, "l_returnflag = 'R'")
    left, verdicts = remove_file_tags(have, gone)
    counts = have.groupBy("tag").agg(F.count("*").alias("usage_count"))
    lost = verdicts.where("NOT found").groupBy("tag").agg(F.count("*").alias("not_found"))
    rest = left.groupBy("tag").agg(F.count("*").alias("left"))
    return usage_after(counts, verdicts).join(lost, "tag", "left").join(rest, "tag", "left").fillna(0, ["not_found", "left"])


def q_tag_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of dear orders get tags 3 and 25 and lose tag 7: rows a tag and origin."""
    have = _tagged(spark, sf_dir, "l_linestatus = 'F'").withColumn("origin", F.lit("Auto"))
    files = load(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("file"))
    return batch_tag(have, files, [3, 25], [7]).groupBy("tag", "origin").agg(F.count("*").alias("files"))


QUERIES = {"tag_update": q_tag_update, "tag_remove": q_tag_remove, "tag_batch": q_tag_batch}
_TREE = "tree AS (SELECT 'r' || r_regionkey AS tag, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"
ORACLE_SQL = {
    "tag_update": f"""WITH {_TREE}, ch AS (SELECT tag, name || ' (old)' AS to_name, 'r0' AS to_parent FROM tree WHERE tag LIKE 'n%' AND contains(name, 'A')
      UNION ALL VALUES ('r1', 'FRANCE', NULL), ('r2', 'FRANCE', NULL), ('r3', 'KENYA', NULL), ('zz', 'new', NULL)),
    j AS (SELECT coalesce(tree.tag, ch.tag) AS tag, tree.name, tree.parent, ch.to_name, ch.to_parent, CASE WHEN ch.tag IS NULL THEN 'same' WHEN tree.tag IS NULL THEN 'missing'
      WHEN EXISTS (SELECT 1 FROM tree o WHERE o.name = ch.to_name AND o.tag <> ch.tag) OR (SELECT count(*) FROM ch o WHERE o.to_name = ch.to_name) > 1 THEN 'taken' ELSE 'ok' END AS verdict
      FROM tree FULL OUTER JOIN ch ON tree.tag = ch.tag)
    SELECT tag, verdict, coalesce(CASE WHEN verdict = 'ok' THEN to_name ELSE name END, '-') AS name, coalesce(CASE WHEN verdict = 'ok' THEN coalesce(to_parent, parent) ELSE parent END, '-') AS parent FROM j""",
    "tag_remove": """WITH have AS (SELECT DISTINCT l_orderkey AS file, l_partkey % 20 AS tag FROM lineitem WHERE l_linestatus = 'F'), gone AS (SELECT DISTINCT l_orderkey AS file, l_partkey % 20 AS tag FROM lineitem WHERE l_returnflag = 'R')
    SELECT tag, count(*) - count(*) FILTER ((file, tag) IN (SELECT (file, tag) FROM gone)) AS usage_count,
      (SELECT count(*) FROM gone g WHERE g.tag = have.tag AND (g.file, g.tag) NOT IN (SELECT (file, tag) FROM have)) AS not_found, count(*) FILTER ((file, tag) NOT IN (SELECT (file, tag) FROM gone)) AS left FROM have GROUP BY tag""",
    "tag_batch": """WITH have AS (SELECT DISTINCT l_orderkey AS file, l_partkey % 20 AS tag FROM lineitem WHERE l_linestatus = 'F'), f AS (SELECT DISTINCT o_orderkey AS file FROM orders WHERE o_totalprice > 200000),
    new AS (SELECT file, tag FROM f, (VALUES (3), (25)) t(tag) EXCEPT SELECT file, tag FROM have), rows AS (SELECT file, tag, 'Auto' AS origin FROM have UNION ALL SELECT file, tag, 'Manual' FROM new)
    SELECT tag, origin, count(*) AS files FROM rows WHERE NOT (tag = 7 AND file IN (SELECT file FROM f)) GROUP BY ALL""",
}
