"""Tags: all-of search, feedback counts, the tag tree (regions, nations, customers as three levels) and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import load


def tag_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, parent, name): regions are roots, then nations, then customers."""
    r, n, c = (load(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    key = lambda kind, col: F.concat(F.lit(kind), F.col(col))
    return (
        r.select(key("r", "r_regionkey").alias("tag"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
        .unionByName(n.select(key("n", "n_nationkey").alias("tag"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
        .unionByName(c.select(key("c", "c_custkey").alias("tag"), key("n", "c_nationkey").alias("parent"), F.col("c_name").alias("name")))
    )


def paths(tree: DataFrame, most_depth: int = 3) -> DataFrame:
    """(tag, depth, path, ancestors) by level-wise joins; tags whose parent is missing are roots.  The tree has at most ``most_depth`` levels."""
    known = tree.select(F.col("tag").alias("parent"), F.lit(True).alias("known"))
    t = tree.join(known, "parent", "left").withColumn("parent", F.expr("IF(known, parent, NULL)")).drop("known")
    level = t.where("parent IS NULL").select("tag", F.lit(0).cast("long").alias("depth"), F.col("name").alias("path"), F.array("tag").alias("ancestors"))
    out = level
    for depth in range(1, most_depth):
        up = level.select(F.col("tag").alias("parent"), F.col("path").alias("above"), F.col("ancestors").alias("up"))
        level = t.join(up, "parent").select("tag", F.lit(depth).cast("long").alias("depth"), F.concat_ws(" > ", "above", "name").alias("path"), F.concat("up", F.array("tag")).alias("ancestors"))
        out = out.unionByName(level)
    return out


def q_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(tag_tree(spark, sf_dir)).select("tag", "depth", "path")


def q_tag_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths(tag_tree(spark, sf_dir))
    return p.groupBy("depth").agg(F.count("*").alias("tags"))


def q_tag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole hierarchy in one row: tags, roots, greatest depth, and tags by depth as a map in JSON."""
    by_depth = q_tag_stats(spark, sf_dir)
    levels = F.map_from_entries(F.sort_array(F.collect_list(F.struct("depth", "tags"))))  # a row a depth
    return by_depth.agg(F.sum("tags").alias("tags"), F.sum(F.when(F.col("depth") == 0, F.col("tags")).otherwise(0)).alias("roots"), F.max("depth").alias("max_depth"), F.to_json(levels).alias("by_depth"))


def q_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of descendants of each tag that has one, from the ancestor closure."""
    p = paths(tag_tree(spark, sf_dir)).select("tag", F.explode("ancestors").alias("ancestor")).where("tag <> ancestor")
    return p.groupBy(F.col("ancestor").alias("tag")).agg(F.count("*").alias("descendants"))


def q_tag_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each nation may move under each region or nation of its own region: no cycle and at most three levels."""
    p = paths(tag_tree(spark, sf_dir))
    height = p.select(F.explode("ancestors").alias("tag"), "depth").groupBy("tag").agg(F.max("depth").alias("deepest"))
    node = p.join(height, "tag").select("tag", "depth", (F.col("deepest") - F.col("depth")).alias("height"), F.col("ancestors")[0].alias("root"))
    moved = node.where("depth = 1").select("tag", "height", "root")
    target = p.where("depth < 2").select(F.col("tag").alias("target"), F.col("depth").alias("target_depth"), F.col("ancestors")[0].alias("root"), "ancestors")
    both = moved.join(target, "root")
    verdict = F.when(F.array_contains("ancestors", F.col("tag")), "cycle").when(F.col("target_depth") + F.col("height") + 1 > 2, "too_deep").otherwise("ok")
    return both.select("tag", "target", verdict.alias("verdict"))


def q_tag_tree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that match by name, and all ancestors of one that does."""
    p = paths(tag_tree(spark, sf_dir)).join(tag_tree(spark, sf_dir).select("tag", "name"), "tag")
    hit = p.where(F.lower("name").contains("00042") | F.lower("name").contains("ia"))
    return hit.select(F.explode("ancestors").alias("tag")).distinct()


def q_tag_all_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders (files) that have all three part sizes (tags) without a rejected (returned) line for them."""
    li, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    tagged = li.where("l_returnflag <> 'R'").join(p.select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 5).alias("tag")), "l_partkey").where(F.col("tag").isin(0, 1, 2))
    return tagged.groupBy(F.col("l_orderkey").alias("file_id")).agg(F.countDistinct("tag").alias("n")).where("n = 3").select("file_id")


def q_tag_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed and rejected uses of each tag (brand)."""
    li, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    used = li.groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    return used.join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("tag")), "l_partkey").groupBy("tag").agg(F.sum("a").alias("confirmed"), F.sum("r").alias("rejected"))


def tag_preferences(verdicts: DataFrame, file=None) -> DataFrame:
    """(verdict, tag, uses, position) of ``verdicts`` (file, tag, verdict: confirmed or rejected), of one file or of all.

    Most used tags of each verdict first, ties by tag.  Tags are counted before they are ranked.
    """
    some = verdicts if file is None else verdicts.where(F.col("file") == file)
    used = some.where("verdict IN ('confirmed', 'rejected')").groupBy("verdict", "tag").agg(F.count("*").alias("uses"))
    return used.withColumn("position", F.row_number().over(Window.partitionBy("verdict").orderBy(F.desc("uses"), "tag")).cast("long"))


def q_ranked_tag_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preferences by position over all orders, and over the one of the smallest key alone."""
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("tag"))
    verdict = F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "rejected")
    v = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("p_partkey"), verdict.alias("verdict")).join(p, "p_partkey")
    first = v.where("verdict IS NOT NULL").agg(F.min("file").alias("file"))
    one = v.join(F.broadcast(first), "file")
    return tag_preferences(v).withColumn("scope", F.lit("all")).unionByName(tag_preferences(one).withColumn("scope", F.lit("file")))


def q_tag_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """usage_count of every brand, recomputed from its lines; unused tags count 0."""
    li, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    n = li.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return p.join(n, "p_partkey", "left").groupBy(F.col("p_brand").alias("tag")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("usage_count"))


def q_merge_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File tags after every odd size was merged into the even one below it: files keep one row a tag."""
    li, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    tagged = li.select("l_orderkey", "l_partkey").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    return tagged.select(F.col("l_orderkey").alias("file_id"), (F.col("p_size") - F.col("p_size") % 2).cast("long").alias("tag")).distinct()


_TREE = """tree AS (SELECT 'r' || r_regionkey AS tag, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
p AS (SELECT tag, 0::BIGINT AS depth, name AS path, [tag] AS ancestors, name FROM tree WHERE parent IS NULL UNION ALL SELECT t.tag, p.depth + 1, p.path || ' > ' || t.name, list_append(p.ancestors, t.tag), t.name FROM tree t JOIN p ON t.parent = p.tag)"""

QUERIES = {"ranked_tag_preferences": q_ranked_tag_preferences, 
    "tag_paths": q_tag_paths, "tag_stats": q_tag_stats, "tag_summary": q_tag_summary, "descendants": q_descendants, "tag_moves": q_tag_moves, "tag_tree_filter": q_tag_tree_filter,
    "tag_all_of": q_tag_all_of, "tag_preferences": q_tag_preferences, "tag_usage": q_tag_usage, "merge_tags": q_merge_tags,
}
ORACLE_SQL = {
    "ranked_tag_preferences": """WITH v AS (SELECT l_orderkey AS file, p_brand AS tag, CASE l_returnflag WHEN 'A' THEN 'confirmed' ELSE 'rejected' END AS verdict FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R')),
    s AS (SELECT 'all' AS scope, * FROM v UNION ALL SELECT 'file', * FROM v WHERE file = (SELECT min(file) FROM v))
    SELECT *, row_number() OVER (PARTITION BY scope, verdict ORDER BY uses DESC, tag) AS position FROM (SELECT scope, verdict, tag, count(*) AS uses FROM s GROUP BY ALL)""",
    "tag_paths": f"WITH RECURSIVE {_TREE} SELECT tag, depth, path FROM p",
    "tag_summary": f"""WITH RECURSIVE {_TREE}, d AS (SELECT depth, count(*) AS tags FROM p GROUP BY depth)
    SELECT CAST(sum(tags) AS BIGINT) AS tags, CAST(sum(tags) FILTER (depth = 0) AS BIGINT) AS roots, max(depth) AS max_depth, '{{' || string_agg('"' || depth || '":' || tags, ',' ORDER BY depth) || '}}' AS by_depth FROM d""",
    "tag_stats": f"WITH RECURSIVE {_TREE} SELECT depth, count(*) AS tags FROM p GROUP BY depth",
    "descendants": f"WITH RECURSIVE {_TREE} SELECT a AS tag, count(*) AS descendants FROM (SELECT tag, unnest(ancestors) AS a FROM p) WHERE a <> tag GROUP BY a",
    "tag_moves": f"""WITH RECURSIVE {_TREE}, h AS (SELECT a AS tag, max(depth) AS deepest FROM (SELECT unnest(ancestors) AS a, depth FROM p) GROUP BY a)
    SELECT m.tag, t.tag AS target, CASE WHEN list_contains(t.ancestors, m.tag) THEN 'cycle' WHEN t.depth + (h.deepest - m.depth) + 1 > 2 THEN 'too_deep' ELSE 'ok' END AS verdict
    FROM p m JOIN h ON h.tag = m.tag JOIN p t ON t.ancestors[1] = m.ancestors[1] WHERE m.depth = 1 AND t.depth < 2""",
    "tag_tree_filter": f"WITH RECURSIVE {_TREE} SELECT DISTINCT unnest(ancestors) AS tag FROM p WHERE contains(lower(name), '00042') OR contains(lower(name), 'ia')",
    "tag_all_of": "SELECT l_orderkey AS file_id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R' AND p_size % 5 IN (0, 1, 2) GROUP BY 1 HAVING count(DISTINCT p_size % 5) = 3",
    "tag_preferences": "SELECT p_brand AS tag, count(*) FILTER (l_returnflag = 'A') AS confirmed, count(*) FILTER (l_returnflag = 'R') AS rejected FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "tag_usage": "SELECT p_brand AS tag, count(l_partkey) AS usage_count FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY 1",
    "merge_tags": "SELECT DISTINCT l_orderkey AS file_id, CAST(p_size - p_size % 2 AS BIGINT) AS tag FROM lineitem JOIN part ON p_partkey = l_partkey",
}
