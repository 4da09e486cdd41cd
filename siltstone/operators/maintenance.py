"""Changes of stored tables as plans: upserts, cascades, new relations, exports, and views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.operators.metrics import tasks
from siltstone.operators.relations import DAY, _accesses, apply_block_rules, edges, session_pairs
from siltstone.operators.requests import parts_of
from siltstone.sources.tables import delete, load, upsert


def q_vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings after every tenth vector got a new label and a new id was inserted for every fiftieth."""
    v = load(spark, sf_dir, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("dim"))
    changed = v.where("vec_id % 10 = 0").withColumn("label", F.lit(99))
    new = v.where("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 1_000_000_000)
    return upsert(v, changed.unionByName(new), "vec_id")


def q_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels left after the documents of one source were deleted."""
    gone = load(spark, sf_dir, "documents").where("source = 'src0'").select("doc_id")
    return delete(load(spark, sf_dir, "labels"), gone, "doc_id").select("doc_id", "quality", "toxic")


def q_delete_set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers after the nations of one region were deleted: their nation becomes null."""
    n = load(spark, sf_dir, "nation")
    left = delete(n, n.where("n_regionkey = 0").select("n_nationkey"), "n_nationkey").select(F.col("n_nationkey").alias("nation"))
    c = load(spark, sf_dir, "customer")
    return c.join(left, c["c_nationkey"] == left["nation"], "left").select("c_custkey", F.col("nation").cast("string").alias("nation"))


def q_create_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session pairs that may become AI relations: valid strength, not related yet either way, not blocked."""
    pairs = session_pairs(_accesses(spark, sf_dir, DAY)).where("a <> b AND strength BETWEEN 0 AND 1 AND co >= 2")
    have = edges(spark, sf_dir).select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    new = pairs.join(have, ["a", "b"], "left_anti").select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("AIGenerated").alias("origin"), "strength")
    files = load(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("file"))
    rejected = edges(spark, sf_dir).where("feedback = 'Rejected'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return apply_block_rules(new, files, rejected).select("source", "target", "strength")


def q_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with its character offsets and a preview of 100 characters."""
    return parts_of(load(spark, sf_dir, "documents"), "\n")


def q_log_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 newest lines of each log (source), blanked; newest documents first, lines in order.

    Every document has a line, so the 200 newest of a source hold them; of these only the ones that
    start within 200 lines are cut.
    """
    newest = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    docs = load(spark, sf_dir, "documents").where("text IS NOT NULL").select("source", "doc_id", F.split("text", "\n").alias("lines"))
    docs = docs.withColumn("rank", F.rank().over(newest)).where("rank <= 200")
    before = F.coalesce(F.sum(F.size("lines")).over(newest.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = docs.withColumn("before", before).where("before < 200").select("source", "doc_id", F.posexplode("lines").alias("line_no", "line"))
    kept = lines.withColumn("r", F.row_number().over(newest.orderBy(F.desc("doc_id"), "line_no"))).where("r <= 200")
    return kept.select("source", F.col("r").cast("long").alias("position"), T.redact_log(F.col("line")).alias("line"))


def q_recent_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the lines of a log a type: the 200 newest of the last 30 days before the newest event."""
    e = load(spark, sf_dir, "events").select("event_type", "event_id", "ts", "props")
    last = e.agg(F.max("ts")).scalar()
    newest = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    e = e.where(F.col("ts") >= last - F.expr("INTERVAL 30 DAYS"))
    return e.withColumn("r", F.row_number().over(newest)).where("r <= 200").select("event_type", F.col("r").cast("long").alias("position"), "event_id", T.redact_log(F.col("props")).alias("line"))


def q_sensitivity_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, group, keyword) of every text word that holds a sensitive keyword."""
    words = load(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("tag")).distinct()
    table = F.array(*[F.struct(F.lit(g).alias("grp"), F.lit(k).alias("keyword")) for g, _, keys in T.SENSITIVE for k in keys])
    return words.select("tag", F.explode(F.filter(table, lambda r: F.col("tag").contains(r["keyword"]))).alias("r")).select("tag", "r.grp", "r.keyword")


def q_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by status and priority."""
    status = F.when(F.col("retry_count") >= 5, "DeadLetter").when(F.col("retry_count") > 0, "Retrying").otherwise("Pending")
    return tasks(spark, sf_dir).groupBy(status.alias("status"), "priority").agg(F.count("*").alias("n"))


_EDGES = "e AS (SELECT l_partkey AS s, l_suppkey AS t, l_returnflag = 'R' AS rejected FROM lineitem WHERE l_partkey <> l_suppkey)"

QUERIES = {
    "vector_upsert": q_vector_upsert, "cascade_delete": q_cascade_delete, "create_relations": q_create_relations, "paragraphs": q_paragraphs, "log_export": q_log_export, "recent_log_lines": q_recent_log_lines, "delete_set_null": q_delete_set_null, "sensitivity_analysis": q_sensitivity_analysis, "index_stats": q_index_stats,
}
ORACLE_SQL = {
    "vector_upsert": """SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 99 ELSE label END AS label, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings
    UNION ALL SELECT vec_id + 1000000000, label, CAST(len(embedding) AS BIGINT) FROM embeddings WHERE vec_id % 50 = 0""",
    "cascade_delete": "SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')",
    "create_relations": f"""WITH a AS (SELECT *, CAST(props->>'$.k' AS BIGINT) AS file FROM events), n AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 86400000000 THEN 0 ELSE 1 END AS new FROM a),
    o AS (SELECT DISTINCT user_id, session_no, file FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM n) WHERE file IS NOT NULL),
    p AS (SELECT x.file AS source, y.file AS target, count(*) AS co FROM o x JOIN o y ON x.user_id = y.user_id AND x.session_no = y.session_no AND x.file < y.file GROUP BY 1, 2 HAVING count(*) >= 2), {_EDGES}
    SELECT source, target, round(least(1.0, 0.3 + 0.1 * (co - 1))::DOUBLE, 6) AS strength FROM p WHERE NOT EXISTS (SELECT 1 FROM e WHERE least(s, t) = source AND greatest(s, t) = target) AND source NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)""",
    "paragraphs": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number FROM documents WHERE text IS NOT NULL),
    o AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM l)
    SELECT doc_id, number, start, start + length(line) AS "end", substring(line, 1, 100) AS preview FROM o""",
    "log_export": f"""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC, line_no) AS position FROM l)
    SELECT source, position, regexp_replace(regexp_replace(regexp_replace(line, '{T.SECRET.replace("'", "''")}', '\\1=[REDACTED]', 'g'), '{T.EMAIL}', '[EMAIL]', 'g'), '{T.IPV4}', '[IP]', 'g') AS line FROM r WHERE position <= 200""",
    "recent_log_lines": f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS position FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY)
    SELECT event_type, position, event_id, regexp_replace(regexp_replace(regexp_replace(props, '{T.SECRET.replace("'", "''")}', '\\1=[REDACTED]', 'g'), '{T.EMAIL}', '[EMAIL]', 'g'), '{T.IPV4}', '[IP]', 'g') AS line FROM r WHERE position <= 200""",
    "delete_set_null": "SELECT c_custkey, CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0) THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer",
    "sensitivity_analysis": f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS tag FROM documents), k(grp, keyword) AS (VALUES {', '.join(f"('{g}', '{x}')" for g, _, keys in T.SENSITIVE for x in keys)})
    SELECT tag, grp, keyword FROM w JOIN k ON contains(tag, keyword)""",
    "index_stats": "SELECT CASE WHEN o_orderkey % 8 >= 5 THEN 'DeadLetter' WHEN o_orderkey % 8 > 0 THEN 'Retrying' ELSE 'Pending' END AS status, least(3, 5 - CAST(substring(o_orderpriority, 1, 1) AS INT)) AS priority, count(*) AS n FROM orders GROUP BY 1, 2",
}
