"""Changes of tags and of files' tags as plans, tag suggestions, and how well tags fit a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators.tags import paths, tag_tree
from siltstone.operators.text_rules import ORACLE_SQL as TEXT_SQL
from siltstone.operators.text_rules import auto_tags
from siltstone.sources.tables import documents_as_files, load


def valid_name(name: str | Column) -> Column:
    """1 to 100 bytes."""
    return F.coalesce(F.octet_length(name).between(1, 100), F.lit(False))


def create_tags(tree: DataFrame, new: DataFrame) -> DataFrame:
    """(name, parent, verdict) of new tags (name, parent): invalid, exists, too_deep (below the third level) or created.

    A parent that is not known counts as a root; of equal new names only one is created, under the least parent.
    """
    levels = paths(tree).select(F.col("tag").alias("parent"), "depth")
    have = tree.select("name", F.lit(True).alias("have")).distinct()
    once = F.row_number().over(Window.partitionBy("name").orderBy(F.col("parent").asc_nulls_first()))
    n = new.distinct().withColumn("turn", once).join(levels, "parent", "left").join(have, "name", "left")
    verdict = F.when(~valid_name("name"), "invalid").when(F.col("have") | (F.col("turn") > 1), "exists").when(F.coalesce("depth", F.lit(-1)) >= 2, "too_deep").otherwise("created")
    return n.select("name", "parent", verdict.alias("verdict"))


def q_tag_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names under a region, nation or customer; nation names again; an empty and a long name."""
    p = load(spark, sf_dir, "part").select(F.when(F.col("p_size") == 50, "").when(F.col("p_size") == 49, F.repeat("p_name", F.lit(20))).otherwise(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))).alias("name"), F.concat(F.element_at(F.array(F.lit("r"), F.lit("n"), F.lit("c")), (F.col("p_size") % 3 + 1)), F.pmod("p_partkey", F.lit(5)) + 1).alias("parent"))
    n = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit("r0").alias("parent"))
    return create_tags(tag_tree(spark, sf_dir), p.unionByName(n))


def delete_tags(tree: DataFrame, gone: DataFrame) -> DataFrame:
    """The tree (tag, parent, name, is_system) without the tags of ``gone``; system tags stay, children of deleted ones become roots."""
    out = tree.where("NOT is_system").join(gone.select("tag").distinct(), "tag", "left_semi").select("tag")
    left = tree.join(out, "tag", "left_anti")
    orphan = out.select(F.col("tag").alias("parent"), F.lit(True).alias("orphan"))
    return left.join(orphan, "parent", "left").select("tag", F.expr("IF(orphan, NULL, parent)").alias("parent"), "name")


def q_tag_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes all tags with an A in the name; regions are system tags."""
    t = tag_tree(spark, sf_dir).withColumn("is_system", F.col("tag").startswith("r"))
    return delete_tags(t, t.where(F.col("name").contains("A"))).withColumn("parent", F.coalesce("parent", F.lit("-")))


def add_file_tags(have: DataFrame, new: DataFrame) -> DataFrame:
    """(file, tag, verdict, is_confirmed) of new rows (file, tag, source): a tag that the file has is an error, Manual ones are confirmed."""
    known = have.select("file", "tag", F.lit(True).alias("known")).distinct()
    return new.join(known, ["file", "tag"], "left").select("file", "tag", F.when(F.col("known"), "exists").otherwise("added").alias("verdict"), (F.col("known").isNull() & (F.col("source") == "Manual")).alias("is_confirmed"))


def _file_tags(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem").where(rule).select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 20).alias("tag"), "l_returnflag")
    return li.groupBy("file", "tag").agg(F.max("l_returnflag").alias("flag"))


def q_tag_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of odd lines are there; those of even ones are added, by hand for returned lines."""
    new = _file_tags(spark, sf_dir, "l_linenumber % 2 = 0").select("file", "tag", F.when(F.col("flag") == "R", "Manual").otherwise("AI").alias("source"))
    return add_file_tags(_file_tags(spark, sf_dir, "l_linenumber % 2 = 1"), new)


def correct_file_tags(have: DataFrame, actions: DataFrame) -> DataFrame:
    """(file, tag, is_confirmed, is_rejected, verdict) after actions (file, tag, confirm): an action on no row is not_found."""
    j = have.select("file", "tag", "is_confirmed", "is_rejected", F.lit(True).alias("known")).join(actions, ["file", "tag"], "full_outer")
    verdict = F.when(F.col("known").isNull(), "not_found").when(F.col("confirm").isNull(), "unchanged").when(F.col("confirm"), "confirmed").otherwise("rejected")
    of = lambda c, new: F.when(F.col("known").isNull(), F.lit(False)).otherwise(F.coalesce(new, F.col(c)))
    return j.select("file", "tag", of("is_confirmed", F.col("confirm")).alias("is_confirmed"), of("is_rejected", ~F.col("confirm")).alias("is_rejected"), verdict.alias("verdict"))


def q_tag_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = _file_tags(spark, sf_dir, "l_linenumber <= 3").select("file", "tag", F.lit(False).alias("is_confirmed"), F.lit(False).alias("is_rejected"))
    return correct_file_tags(have, _file_tags(spark, sf_dir, "l_linenumber = 2 OR l_linenumber = 5").select("file", "tag", (F.col("flag") != "R").alias("confirm")))


def q_tag_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions with their reason; a sensitive name needs confirmation, nothing is written."""
    files = documents_as_files(spark, sf_dir)
    tags = auto_tags(files).join(files.select("doc_id", "extension"), "doc_id")
    by_type = F.col("tag") == T.type_tag(F.col("extension"))
    return tags.select("doc_id", "tag", "confidence", F.when(by_type, F.concat(F.lit("File extension: ."), "extension")).otherwise("Content keywords").alias("reason"), (T.sensitivity(F.col("tag")) > 0).alias("requires_confirmation"))


def q_tag_tree_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of each level by use (orders of a customer, summed upwards), then by name: position among siblings."""
    used = load(spark, sf_dir, "orders").groupBy(F.concat(F.lit("c"), "o_custkey").alias("leaf")).agg(F.count("*").alias("n"))
    p = paths(tag_tree(spark, sf_dir))
    sums = p.where("depth = 2").join(used.withColumnRenamed("leaf", "tag"), "tag").select(F.explode("ancestors").alias("tag"), "n").groupBy("tag").agg(F.sum("n").alias("usage"))
    t = tag_tree(spark, sf_dir).join(sums, "tag", "left").withColumn("usage", F.coalesce("usage", F.lit(0)))
    order = Window.partitionBy("parent").orderBy(F.desc("usage"), "name")
    return t.select("tag", "usage", F.row_number().over(order).cast("long").alias("position"))


def match_score(query: str, name: Column, display: Column) -> Column:
    """How well a tag (name, map of display names) fits a query; the first rung that holds decides.

    1.0 a name within the query or round; 0.8 so for a word of the query; then over the display names
    0.9 and, for a word within it, 0.7; else the share of query words that a word of the name is within, or round, times 0.6.
    """
    low, words = F.lower(name), query.split()
    either = lambda a, b: a.contains(b) | b.contains(a)
    shown = F.transform(F.map_values(F.coalesce(display, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda x: F.lower(x))
    rung = lambda x: F.when(either(F.lit(query), x), 0.9).when(T.contains_any(x, words), 0.7)
    first = F.get(F.filter(F.transform(shown, rung), lambda x: x.isNotNull()), F.lit(0))
    parts = F.split(low, r"[^\p{L}\p{N}]")
    overlap = sum(F.when(F.exists(parts, lambda p: either(F.lit(w), p)), 1).otherwise(0) for w in words)
    partial = F.lit(False)
    for w in words:
        partial = partial | either(F.lit(w), low)
    return F.when(either(F.lit(query), low), 1.0).when(partial, 0.8).otherwise(F.coalesce(first, overlap / F.lit(max(len(words), 1)) * 0.6))


QUERY_WORDS = "rusty economybig ring1 rand#23"


def q_tag_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as tags with JSON display names (some broken, which counts as none) against one query."""
    json = F.when(F.col("p_size") % 4 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("p_type").alias("en"), F.col("p_brand").alias("de"))))
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", F.from_json(json, "map<string,string>").alias("display"))
    return p.select("p_partkey", F.round(match_score(QUERY_WORDS, F.col("p_name"), F.col("display")), 6).alias("score")).where("score >= 0.3 OR score = 0.15")


def _rows(rule: str) -> str:
    return f"(SELECT l_orderkey AS file, l_partkey % 20 AS tag, max(l_returnflag) AS flag FROM lineitem WHERE {rule} GROUP BY 1, 2)"


def _either(a: str, b: str) -> str:
    return f"(contains({a}, {b}) OR contains({b}, {a}))"


_TREE = """tree AS (SELECT 'r' || r_regionkey AS tag, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"""
_LIST = QUERY_WORDS.split()
_TYPES = " ".join(f"WHEN ext IN ({', '.join(map(repr, keys))}) THEN '{name}'" for name, keys in T.TYPE_TAGS.items())
_ONE = f"CASE WHEN {_either(repr(QUERY_WORDS), 'x')} THEN 0.9::DOUBLE WHEN {' OR '.join(f'contains(x, {w!r})' for w in _LIST)} THEN 0.7::DOUBLE END"

QUERIES = {"tag_create": q_tag_create, "tag_delete": q_tag_delete, "tag_add": q_tag_add, "tag_feedback": q_tag_feedback, "tag_suggestions": q_tag_suggestions, "tag_tree_sorted": q_tag_tree_sorted, "tag_ladder": q_tag_ladder}
ORACLE_SQL = {
    "tag_create": f"""WITH {_TREE}, new AS (SELECT DISTINCT CASE p_size WHEN 50 THEN '' WHEN 49 THEN repeat(p_name, 20) ELSE p_name || ' ' || p_partkey END AS name, (['r', 'n', 'c'])[p_size % 3 + 1] || (p_partkey % 5 + 1) AS parent FROM part UNION SELECT n_name, 'r0' FROM nation),
    n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY parent) AS turn FROM new)
    SELECT name, parent, CASE WHEN strlen(name) NOT BETWEEN 1 AND 100 THEN 'invalid' WHEN turn > 1 OR name IN (SELECT name FROM tree) THEN 'exists' WHEN parent[1] = 'c' AND parent IN (SELECT tag FROM tree) THEN 'too_deep' ELSE 'created' END AS verdict FROM n""",
    "tag_delete": f"""WITH {_TREE}, gone AS (SELECT tag FROM tree WHERE contains(name, 'A') AND tag[1] <> 'r') SELECT tag, CASE WHEN parent IS NULL OR parent IN (SELECT tag FROM gone) THEN '-' ELSE parent END AS parent, name FROM tree WHERE tag NOT IN (SELECT tag FROM gone)""",
    "tag_add": f"SELECT n.file, n.tag, CASE WHEN h.file IS NULL THEN 'added' ELSE 'exists' END AS verdict, h.file IS NULL AND n.flag = 'R' AS is_confirmed FROM {_rows('l_linenumber % 2 = 0')} n LEFT JOIN {_rows('l_linenumber % 2 = 1')} h ON h.file = n.file AND h.tag = n.tag",
    "tag_feedback": f"""SELECT coalesce(h.file, a.file) AS file, coalesce(h.tag, a.tag) AS tag, h.file IS NOT NULL AND coalesce(a.flag <> 'R', false) AS is_confirmed, h.file IS NOT NULL AND coalesce(a.flag = 'R', false) AS is_rejected,
      CASE WHEN h.file IS NULL THEN 'not_found' WHEN a.file IS NULL THEN 'unchanged' WHEN a.flag <> 'R' THEN 'confirmed' ELSE 'rejected' END AS verdict FROM {_rows('l_linenumber <= 3')} h FULL OUTER JOIN {_rows('l_linenumber = 2 OR l_linenumber = 5')} a ON h.file = a.file AND h.tag = a.tag""",
    "tag_suggestions": f"""WITH t AS ({TEXT_SQL["auto_tag"]}), f AS (SELECT doc_id, (['txt','md','pdf','docx','xlsx','png','mp4','mp3','py','stl','zip','dat'])[doc_id % 12 + 1] AS ext FROM documents)
    SELECT doc_id, tag, confidence, CASE WHEN tag = CASE {_TYPES} ELSE 'Other' END THEN 'File extension: .' || ext ELSE 'Content keywords' END AS reason, tag = 'Health' AS requires_confirmation FROM t JOIN f USING (doc_id)""",
    "tag_tree_sorted": f"""WITH {_TREE}, u AS (SELECT 'c' || o_custkey AS tag, count(*) AS n FROM orders GROUP BY 1), leaf AS (SELECT u.tag, t.parent, m.parent AS root, n FROM u JOIN tree t ON t.tag = u.tag JOIN tree m ON m.tag = t.parent),
    s AS (SELECT tag, n FROM leaf UNION ALL SELECT parent, n FROM leaf UNION ALL SELECT root, n FROM leaf), w AS (SELECT tree.*, CAST(coalesce(x.n, 0) AS BIGINT) AS usage FROM tree LEFT JOIN (SELECT tag, sum(n) AS n FROM s GROUP BY 1) x USING (tag))
    SELECT tag, usage, row_number() OVER (PARTITION BY parent ORDER BY usage DESC, name) AS position FROM w""",
    "tag_ladder": f"""WITH p AS (SELECT p_partkey, lower(p_name) AS low, CASE WHEN p_size % 4 = 0 THEN [] ELSE [lower(p_type), lower(p_brand)] END AS shown, regexp_split_to_array(lower(p_name), '[^\\p{{L}}\\p{{N}}]') AS parts FROM part),
    s AS (SELECT p_partkey, round(CASE WHEN {_either(repr(QUERY_WORDS), 'low')} THEN 1.0::DOUBLE WHEN {' OR '.join(_either(repr(w), 'low') for w in _LIST)} THEN 0.8::DOUBLE
      ELSE coalesce(list_filter(list_transform(shown, lambda x: {_ONE}), lambda x: x IS NOT NULL)[1], ({' + '.join(f"(len(list_filter(parts, lambda x: {_either(repr(w), 'x')})) > 0)::INT" for w in _LIST)}) / {len(_LIST)} * 0.6) END, 6)::DOUBLE AS score FROM p)
    SELECT * FROM s WHERE score >= 0.3 OR score = 0.15""",
}
