"""Block rules of five kinds, their life, and feedback on relations that may create them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.relations import TRANSITIONS, edges
from siltstone.operators.search import similar_vectors
from siltstone.sources.tables import load

#: Point in time at which rules are looked at.
NOW = "1999-06-01 00:00:00"
# Kinds of relations, in the order of line numbers.
KINDS = ["ContentSimilar", "SameSession", "SameProject", "SameAuthor", "Reference", "Derivative", "Workflow"]
#: A rule's detail is one of these, named by its only key.
DETAIL = "FilePair struct<file_id_a:bigint,file_id_b:bigint>, FileToTag struct<file_id:bigint,tag_id:bigint>, TagPair struct<tag_id_a:bigint,tag_id_b:bigint>, FileAllAI struct<file_id:bigint>, RelationType struct<file_id:bigint,relation_type:string>"


def stored_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rule_id, rule_type, rule_detail, expires_at, is_active): orders in progress as rules over their first line's files.

    The priority names the kind; rules end five years after the order and are active while the total is under 400,000.
    """
    o = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    first = load(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    r = o.join(first, "o_orderkey").withColumn("p", F.substring("o_orderpriority", 1, 1).cast("int"))
    one = lambda name, **cols: F.to_json(F.struct(F.struct(*[c.alias(k) for k, c in cols.items()]).alias(name)))
    a, b = F.col("a"), F.col("b")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.pmod(b, F.lit(7)) + 1).cast("int"))
    detail = [one("FilePair", file_id_a=b, file_id_b=a), one("FileToTag", file_id=a, tag_id=F.pmod(b, F.lit(10))), one("TagPair", tag_id_a=F.pmod(a, F.lit(10)), tag_id_b=F.pmod(b, F.lit(10))), one("FileAllAI", file_id=a), one("RelationType", file_id=a, relation_type=kind)]
    names = ["FilePair", "FileToTag", "TagPair", "FileAllAI", "RelationType"]
    pick = lambda options: F.element_at(F.array(*options), F.col("p"))
    return r.select(F.col("o_orderkey").alias("rule_id"), pick([F.lit(n) for n in names]).alias("rule_type"), pick(detail).alias("rule_detail"), (F.col("o_orderdate") + F.expr("INTERVAL 60 MONTH")).alias("expires_at"), (F.col("o_totalprice") < 400_000).alias("is_active"))


def parsed(rules: DataFrame) -> DataFrame:
    """Rules with their detail as a struct of the five variants, of which one is not null; what does not parse has none."""
    return rules.withColumn("d", F.from_json("rule_detail", DETAIL))


def in_force(rules: DataFrame, now: str = NOW) -> DataFrame:
    """Active rules that have not expired."""
    return rules.where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz"))))


def files_of(rules: DataFrame) -> DataFrame:
    """(rule_id, file): the files a rule names."""
    d = parsed(rules)
    named = F.array("d.FilePair.file_id_a", "d.FilePair.file_id_b", "d.FileToTag.file_id", "d.FileAllAI.file_id", "d.RelationType.file_id")
    return d.select("rule_id", F.explode(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))).alias("file"))


def tags_of(rules: DataFrame) -> DataFrame:
    """(rule_id, tag): the tags a rule names."""
    d = parsed(rules)
    named = F.array("d.FileToTag.tag_id", "d.TagPair.tag_id_a", "d.TagPair.tag_id_b")
    return d.select("rule_id", F.explode(F.array_distinct(F.filter(named, lambda x: x.isNotNull()))).alias("tag"))


def unblocked(e: DataFrame, rules: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Edges (source, target, kind, origin, ...) that no rule blocks; only AI edges can be blocked.

    One equi-anti-join a variant.  Without ``tags`` (file, tag) a FileToTag rule blocks all edges from its
    file and a TagPair rule none; with it, both look at the tags of the edge's ends.
    """
    d = parsed(rules).select("d.*")
    ai, rest = e.where("origin = 'AIGenerated'"), e.where("origin <> 'AIGenerated'")
    pair = d.select(F.least("FilePair.file_id_a", "FilePair.file_id_b").alias("lo"), F.greatest("FilePair.file_id_a", "FilePair.file_id_b").alias("hi")).where("lo IS NOT NULL").distinct()
    ai = ai.withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target")).join(pair, ["lo", "hi"], "left_anti").drop("lo", "hi")
    whole = d.select(F.col("FileAllAI.file_id").alias("f")).where("f IS NOT NULL").distinct()
    typed = d.where("RelationType IS NOT NULL").select(F.col("RelationType.file_id").alias("f"), F.col("RelationType.relation_type").alias("kind")).distinct()
    for end in ("source", "target"):
        ai = ai.join(whole.withColumnRenamed("f", end), end, "left_anti").join(typed.where("f IS NOT NULL").withColumnRenamed("f", end), [end, "kind"], "left_anti")
    ai = ai.join(typed.where("f IS NULL").select("kind"), "kind", "left_anti")
    if tags is None:
        from_file = d.select(F.col("FileToTag.file_id").alias("source")).where("source IS NOT NULL").distinct()
        ai = ai.join(from_file, "source", "left_anti")
    else:
        tagged = tags.select(F.col("file").alias("target"), F.col("tag").alias("to"))
        to_tag = d.select(F.col("FileToTag.file_id").alias("source"), F.col("FileToTag.tag_id").alias("to")).where("source IS NOT NULL").distinct()
        ai = ai.join(to_tag.join(tagged, "to").select("source", "target").distinct(), ["source", "target"], "left_anti")
        both = d.select(F.col("TagPair.tag_id_a").alias("x"), F.col("TagPair.tag_id_b").alias("y")).where("x IS NOT NULL")
        ends = ai.select("source", "target").distinct().join(tags.select(F.col("file").alias("source"), F.col("tag").alias("x")), "source").join(tagged.withColumnRenamed("to", "y"), "target")
        ai = ai.join(ends.join(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), ["x", "y"]).select("source", "target").distinct(), ["source", "target"], "left_anti")
    return ai.select(*e.columns).unionByName(rest)


def _typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).withColumn("kind", F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("edge_line").cast("int")))


def q_unblocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left by all rules in force, by origin and kind."""
    left = unblocked(_typed_edges(spark, sf_dir), in_force(stored_rules(spark, sf_dir)))
    return left.groupBy("origin", "kind").agg(F.count("*").alias("edges"))


def q_rules_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rules in force name each file."""
    return files_of(in_force(stored_rules(spark, sf_dir))).groupBy("file").agg(F.count("*").alias("rules"))


def q_rules_of_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags_of(in_force(stored_rules(spark, sf_dir))).groupBy("tag").agg(F.count("*").alias("rules"))


def changed_rules(rules: DataFrame, now: str, switch_off: DataFrame, switch_on: DataFrame, delete: DataFrame) -> DataFrame:
    """Rules after deletions, switching by rule_id (off wins over on), and the clean-up of expired ones."""
    r = rules.join(delete.select("rule_id").distinct(), "rule_id", "left_anti")
    marks = switch_off.select("rule_id", F.lit(False).alias("set")).unionByName(switch_on.select("rule_id", F.lit(True).alias("set"))).groupBy("rule_id").agg(F.min("set").alias("set"))
    r = r.join(marks, "rule_id", "left").withColumn("is_active", F.coalesce("set", "is_active")).drop("set")
    return r.where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp_ntz")))


def q_changed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of returned orders go, those of dear ones are switched off, those of cheap ones on."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rule_id"), "o_totalprice", "o_custkey")
    out = changed_rules(stored_rules(spark, sf_dir), NOW, o.where("o_totalprice > 300000"), o.where("o_totalprice < 20000"), o.where("o_custkey < 50"))
    return out.select("rule_id", "rule_type", "is_active")


def give_feedback(e: DataFrame, actions: DataFrame) -> DataFrame:
    """Edges (edge_order, edge_line, feedback, strength, ...) after actions (edge_order, edge_line, action, value, block).

    A change that the table of transitions does not allow leaves the edge as it is.  Adjusted edges take
    the value, within 0 and 1; of several actions on one edge the greatest counts; ``new_rule`` is the FilePair rule that a rejection with ``block`` creates.
    """
    spark = e.sparkSession
    once = actions.groupBy("edge_order", "edge_line").agg(F.max(F.struct("action", "value", "block")).alias("a")).select("edge_order", "edge_line", "a.*")
    allowed = F.broadcast(spark.createDataFrame(TRANSITIONS, "feedback string, action string").withColumn("ok", F.lit(True)))  # 11 rows
    j = e.join(once, ["edge_order", "edge_line"], "left").join(allowed, ["feedback", "action"], "left")
    ok = F.coalesce("ok", F.lit(False))
    after = F.when(ok, F.col("action")).otherwise(F.col("feedback"))
    strength = F.when(ok & (F.col("action") == "Adjusted"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value")))).otherwise(F.col("strength"))
    rule = F.when(ok & (F.col("action") == "Rejected") & F.col("block"), F.to_json(F.struct(F.struct(F.col("source").alias("file_id_a"), F.col("target").alias("file_id_b")).alias("FilePair"))))
    return j.select("edge_order", "edge_line", "source", "target", after.alias("feedback"), strength.alias("strength"), (F.col("action").isNotNull() & ~ok).alias("refused"), rule.alias("new_rule"))


def q_relation_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second line gets an action by its discount; rejections of closed lines block."""
    li = load(spark, sf_dir, "lineitem").where("l_linenumber % 2 = 0")
    action = F.when(F.col("l_discount") < 0.03, "Confirmed").when(F.col("l_discount") < 0.06, "Rejected").otherwise("Adjusted")
    actions = li.select(F.col("l_orderkey").alias("edge_order"), F.col("l_linenumber").alias("edge_line"), action.alias("action"), (F.col("l_tax") * 20 - 0.2).alias("value"), (F.col("l_linestatus") == "F").alias("block"))
    done = give_feedback(edges(spark, sf_dir), actions)
    rule = F.get_json_object("new_rule", "$.FilePair.file_id_a").cast("long")
    return done.select("edge_order", "edge_line", "feedback", F.round("strength", 6).alias("strength"), "refused", F.coalesce(rule, F.lit(-1)).alias("blocked_file"))


def q_content_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar vectors as new relations: not related yet either way, not blocked."""
    pairs = similar_vectors(load(spark, sf_dir, "embeddings"), 10, 0.2).select(F.col("query_id").alias("source"), F.col("vec_id").alias("target"), F.round("score", 4).alias("strength"), F.lit("AIGenerated").alias("origin"), F.lit("ContentSimilar").alias("kind"))
    have = edges(spark, sf_dir).select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).distinct()
    new = pairs.withColumn("lo", F.least("source", "target")).withColumn("hi", F.greatest("source", "target")).join(have, ["lo", "hi"], "left_anti").drop("lo", "hi")
    return unblocked(new, in_force(stored_rules(spark, sf_dir))).select("source", "target", "strength")


def feedback_of(json: str) -> DataFrame:
    """The kind of a stored feedback: a plain string or an object with one key; what does not parse is None."""
    key = F.element_at(F.json_object_keys(json), 1)
    text = F.regexp_extract(json, '^"([A-Za-z]+)"$', 1)
    name = F.coalesce(key, F.when(text != "", text))
    return F.when(name.isin("Confirmed", "Rejected", "Adjusted"), name).otherwise("None")


def q_feedback_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback as stored (quoted words, objects, broken text) read back: edges of each kind and line number."""
    e = edges(spark, sf_dir)
    json = F.when(F.col("feedback") == "Confirmed", '"Confirmed"').when(F.col("feedback") == "Rejected", F.to_json(F.struct(F.struct(F.lit("no").alias("reason")).alias("Rejected")))).when(F.col("feedback") == "Adjusted", F.to_json(F.struct(F.struct("user_strength").alias("Adjusted")))).otherwise("{broken")
    return e.select("edge_line", json.alias("json")).select("edge_line", feedback_of("json").alias("kind")).groupBy("edge_line", "kind").agg(F.count("*").alias("n"))


_EDGES = f"""e AS (SELECT l_partkey AS s, l_suppkey AS t, l_linenumber, ([{', '.join(repr(k) for k in KINDS)}])[l_linenumber] AS kind, CASE WHEN l_linenumber % 2 = 0 THEN 'AIGenerated' ELSE 'User' END AS origin FROM lineitem WHERE l_partkey <> l_suppkey)"""
_RULES = f"""r AS (SELECT o_orderkey AS rule_id, CAST(substring(o_orderpriority, 1, 1) AS INT) AS p, l_partkey AS a, l_suppkey AS b, ([{', '.join(repr(k) for k in KINDS)}])[l_suppkey % 7 + 1] AS kind, o_orderdate + INTERVAL 60 MONTH AS expires_at, o_totalprice < 400000 AS is_active, o_totalprice, o_custkey
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 WHERE o_orderstatus = 'P'), f AS (SELECT * FROM r WHERE is_active AND expires_at > TIMESTAMP '{NOW}')"""
_FREE = """NOT EXISTS (SELECT 1 FROM f WHERE p = 1 AND least(a, b) = least(s, t) AND greatest(a, b) = greatest(s, t)) AND s NOT IN (SELECT a FROM f WHERE p IN (2, 4)) AND t NOT IN (SELECT a FROM f WHERE p = 4)
    AND NOT EXISTS (SELECT 1 FROM f WHERE p = 5 AND f.kind = x.kind AND a = s) AND NOT EXISTS (SELECT 1 FROM f WHERE p = 5 AND f.kind = x.kind AND a = t)"""

QUERIES = {
    "unblocked_relations": q_unblocked, "rules_of_files": q_rules_of_files, "rules_of_tags": q_rules_of_tags, "changed_rules": q_changed_rules, "relation_feedback": q_relation_feedback, "content_relations": q_content_relations, "feedback_json": q_feedback_json,
}
ORACLE_SQL = {
    "unblocked_relations": f"WITH {_EDGES}, {_RULES} SELECT origin, kind, count(*) AS edges FROM e x WHERE origin = 'User' OR ({_FREE}) GROUP BY 1, 2",
    "rules_of_files": f"WITH {_RULES}, n AS (SELECT rule_id, unnest(list_distinct(CASE WHEN p = 1 THEN [a, b] WHEN p = 3 THEN [] ELSE [a] END)) AS file FROM f) SELECT file, count(*) AS rules FROM n GROUP BY 1",
    "rules_of_tags": f"WITH {_RULES}, n AS (SELECT rule_id, unnest(list_distinct(CASE WHEN p = 2 THEN [b % 10] WHEN p = 3 THEN [a % 10, b % 10] ELSE [] END)) AS tag FROM f) SELECT tag, count(*) AS rules FROM n GROUP BY 1",
    "changed_rules": f"""WITH {_RULES} SELECT rule_id, (['FilePair','FileToTag','TagPair','FileAllAI','RelationType'])[p] AS rule_type, CASE WHEN o_totalprice > 300000 THEN false WHEN o_totalprice < 20000 THEN true ELSE is_active END AS is_active
    FROM r WHERE o_custkey >= 50 AND expires_at > TIMESTAMP '{NOW}'""",
    "relation_feedback": f"""WITH e0 AS (SELECT l_orderkey AS edge_order, l_linenumber AS edge_line, l_partkey AS s, CASE WHEN l_returnflag = 'A' THEN 'Confirmed' WHEN l_returnflag = 'R' THEN 'Rejected' WHEN l_linenumber = 7 THEN 'Adjusted' ELSE 'None' END AS before, round(1 - l_discount * 5, 6) AS strength,
      1 AS one FROM lineitem WHERE l_partkey <> l_suppkey), 
    acts AS (SELECT l_orderkey AS edge_order, l_linenumber AS edge_line, max({{'action': CASE WHEN l_discount < 0.03 THEN 'Confirmed' WHEN l_discount < 0.06 THEN 'Rejected' ELSE 'Adjusted' END, 'value': l_tax * 20 - 0.2, 'block': l_linestatus = 'F'}}) AS a FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2),
    e AS (SELECT e0.*, a.action AS action, a.value AS value, a.block AS block FROM e0 LEFT JOIN acts USING (edge_order, edge_line)),
    k(before, action) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in TRANSITIONS)}), j AS (SELECT e.*, k.before IS NOT NULL AS ok FROM e LEFT JOIN k USING (before, action))
    SELECT edge_order, edge_line, CASE WHEN ok THEN action ELSE before END AS feedback, round(CASE WHEN ok AND action = 'Adjusted' THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, value)) ELSE strength END, 6) AS strength, action IS NOT NULL AND NOT ok AS refused, CASE WHEN ok AND action = 'Rejected' AND block THEN s ELSE -1 END AS blocked_file FROM j""",
    "content_relations": f"""WITH {_EDGES}, {_RULES}, pairs AS (SELECT q.vec_id AS s, v.vec_id AS t, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
    best AS (SELECT *, 'ContentSimilar' AS kind FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, t) AS rank FROM pairs WHERE score >= 0.2) WHERE rank <= 10)
    SELECT s AS source, t AS target, round(score, 4) AS strength FROM best x WHERE NOT EXISTS (SELECT 1 FROM e WHERE least(e.s, e.t) = least(x.s, x.t) AND greatest(e.s, e.t) = greatest(x.s, x.t)) AND {_FREE}""",
    "feedback_json": "SELECT l_linenumber AS edge_line, CASE WHEN l_returnflag = 'A' THEN 'Confirmed' WHEN l_returnflag = 'R' THEN 'Rejected' WHEN l_linenumber = 7 THEN 'Adjusted' ELSE 'None' END AS kind, count(*) AS n FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2",
}
