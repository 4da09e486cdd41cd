"""Merged answers, filtered text search, tag matching, time ranges, pages and document sections."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as V
from siltstone.operators.relations import edges
from siltstone.operators.search import TERMS, _query_vector, bm25_sql, bm25
from siltstone.sources.tables import load


def merge_answers(local: DataFrame, cloud: DataFrame, w_local: float = 0.3, w_cloud: float = 0.7, most: int = 20) -> DataFrame:
    """(doc_id, score, origin): both answers weigh in halves, a single one with its weight; under 0.1 goes; best ``most``."""
    m = local.join(cloud, "doc_id", "full_outer")
    l, c = F.col("local"), F.col("cloud")
    score = F.when(c.isNull(), w_local * l).when(l.isNull(), w_cloud * c).otherwise((w_local * l + w_cloud * c) / 2)
    m = m.select("doc_id", F.round(score, 6).alias("score"), F.when(c.isNull(), "Local").when(l.isNull(), "Cloud").otherwise("Both").alias("origin"))
    return m.where("score >= 0.1").orderBy(F.desc("score"), "doc_id").limit(most)


def q_merged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings")
    near = v.where(F.size("embedding") == 64).select(F.col("vec_id").alias("doc_id"), V.cosine(F.col("embedding"), _query_vector(v)).alias("local")).where("local > 0.34")
    hits = bm25(load(spark, sf_dir, "documents"), TERMS).select("doc_id", (F.col("bm25") / (8 + F.col("bm25"))).alias("cloud"))
    return merge_answers(near, hits, most=2000)


def q_text_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 hits with any of the wanted tags, none of the excluded ones, under a path prefix."""
    d = load(spark, sf_dir, "documents").withColumn("tags", F.array("lang", "source"))
    want, drop = F.array(F.lit("en"), F.lit("fr")), F.array(F.lit("src3"), F.lit("src4"))
    kept = d.where(F.arrays_overlap("tags", want) & ~F.arrays_overlap("tags", drop) & F.concat(F.lit("/"), "source").startswith("/src1"))
    hits = bm25(d, TERMS).join(kept.select("doc_id"), "doc_id", "left_semi")
    return hits.withColumn("bm25", F.round("bm25", 6)).where("bm25 >= 0.5").orderBy(F.desc("bm25"), "doc_id").limit(50)


def q_tag_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name as a tag against one query: whole name 1.0, a shared word 0.8, else the share of similar words times 0.6."""
    query = ["small", "ring", "dge"]
    name = F.lower("p_name")
    words = F.filter(F.split(name, "[^a-z0-9]+"), lambda w: w != "")
    shared = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in query])))
    part = F.size(F.filter(words, lambda w: T.contains_any(w, query)))
    score = F.when(F.lit(" ".join(query)).contains(name) | name.contains(" ".join(query)), 1.0).when(shared > 0, 0.8).otherwise(0.6 * part / F.greatest(F.size(words), F.lit(1)))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score")).where("score >= 0.3")


def q_time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders fall in each rolling range before a fixed point in time."""
    now = "TIMESTAMP_NTZ '1998-08-02 00:00:00'"
    back = lambda days: f"o_orderdate > {now} - INTERVAL '{days}' DAY AND o_orderdate <= {now}"
    cases = {"Today": back(1), "Yesterday": f"o_orderdate > {now} - INTERVAL '2' DAY AND o_orderdate <= {now} - INTERVAL '1' DAY", "ThisWeek": back(7), "ThisMonth": back(30), "Old": f"o_orderdate <= {now} - INTERVAL '90' DAY"}
    o = load(spark, sf_dir, "orders").select(F.explode(F.filter(F.array(*[F.when(F.expr(c), F.lit(k)) for k, c in cases.items()]), lambda x: x.isNotNull())).alias("hint"))
    return o.groupBy("hint").agg(F.count("*").alias("n"))


def q_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of a key that the user viewed before is a hit: hits, misses and hit rate of each user."""
    e = load(spark, sf_dir, "events").where("event_type = 'view'").groupBy("user_id", F.get_json_object("props", "$.k").alias("key")).agg(F.count("*").alias("n"))
    g = e.groupBy("user_id").agg(F.sum(F.col("n") - 1).alias("hits"), F.count("*").alias("misses"))
    return g.withColumn("hit_rate", F.round(F.col("hits") / (F.col("hits") + F.col("misses")), 6))


def q_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each document: form feeds plus one, or one for every 3,000 characters."""
    feeds = F.size(F.split("text", "\f"))
    return load(spark, sf_dir, "documents").select("doc_id", F.when(feeds > 1, feeds).otherwise(F.floor(F.length("text") / 3000) + 1).cast("long").alias("pages"))


def q_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both ends among the large parts, rejected ones left out: degree of each node."""
    big = load(spark, sf_dir, "part").where("p_size >= 10").select(F.col("p_partkey").alias("node"))
    e = edges(spark, sf_dir).where("feedback <> 'Rejected'").select("source", "target")
    e = e.join(big.withColumnRenamed("node", "source"), "source").join(big.withColumnRenamed("node", "target"), "target")
    ends = e.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def sections(text: str) -> list[tuple[int, int, str, str]]:
    """(first line, last line, kind, content) of a Markdown text: fenced code, headings and paragraphs.

    A heading with text below it is one paragraph section; an unclosed fence runs to the end.
    """
    out: list[tuple[int, int, str, str]] = []
    block: list[str] = []
    kind, first, fence = "Paragraph", 0, ""

    def close(last: int) -> None:
        nonlocal block
        if any(x.strip() for x in block):
            out.append((first + 1, last, kind, "\n".join(block).strip("\n")))
        block = []

    rows = text.split("\n")
    for i, row in enumerate(rows):
        bare = row.strip()
        if fence:
            block.append(row)
            if bare == fence:
                close(i + 1)
                fence, kind = "", "Paragraph"
        elif bare.startswith("```"):
            close(i)
            block, kind, first, fence = [row], "CodeBlock", i, "```"
        elif bare.startswith("#") and bare.lstrip("#").startswith(" "):
            close(i)
            block, kind, first = [row], "Heading", i
        elif not bare and block:
            close(i)
            kind = "Paragraph"
        elif bare:
            if not block:
                kind, first = "Paragraph", i
            elif kind == "Heading":
                kind = "Paragraph"
            block.append(row)
    close(len(rows))
    return out


def markdown_sections(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, i, *s) for d, t in zip(b["doc_id"], b["text"]) if t for i, s in enumerate(sections(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "section", "first_line", "last_line", "kind", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, section long, first_line long, last_line long, kind string, content string")


def q_markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_sections(load(spark, sf_dir, "documents"))


_Q = "CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])"

QUERIES = {
    "merged_answers": q_merged_answers, "text_filtered": q_text_filtered, "tag_match": q_tag_match, "time_ranges": q_time_ranges, "cache_stats": q_cache_stats, "page_counts": q_page_counts, "graph_nodes": q_graph_nodes, "markdown_sections": q_markdown_sections,
}
ORACLE_SQL = {
    "merged_answers": f"""WITH {bm25_sql()}, near AS (SELECT vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_Q}) AS l FROM embeddings WHERE len(embedding) = 64), n AS (SELECT * FROM near WHERE l > 0.34), c AS (SELECT doc_id, bm25 / (8 + bm25) AS c FROM scored),
    m AS (SELECT coalesce(n.doc_id, c.doc_id) AS doc_id, round(CASE WHEN c IS NULL THEN 0.3 * l WHEN l IS NULL THEN 0.7 * c ELSE (0.3 * l + 0.7 * c) / 2 END, 6) AS score, CASE WHEN c IS NULL THEN 'Local' WHEN l IS NULL THEN 'Cloud' ELSE 'Both' END AS origin FROM n FULL OUTER JOIN c ON n.doc_id = c.doc_id)
    SELECT * FROM m WHERE score >= 0.1 ORDER BY score DESC, doc_id LIMIT 2000""",
    "text_filtered": f"""WITH {bm25_sql()} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored JOIN documents USING (doc_id) WHERE (lang IN ('en', 'fr') OR source IN ('en', 'fr')) AND source NOT IN ('src3', 'src4') AND starts_with(source, 'src1') AND round(bm25, 6) >= 0.5 ORDER BY 2 DESC, doc_id LIMIT 50""",
    "tag_match": """WITH w AS (SELECT p_partkey, lower(p_name) AS name, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '') AS words FROM part),
    s AS (SELECT p_partkey, round(CASE WHEN contains('small ring dge', name) OR contains(name, 'small ring dge') THEN 1.0 WHEN len(list_intersect(words, ['small', 'ring', 'dge'])) > 0 THEN 0.8
      ELSE 0.6 * len(list_filter(words, lambda w: contains(w, 'small') OR contains(w, 'ring') OR contains(w, 'dge'))) / greatest(len(words), 1) END, 6)::DOUBLE AS score FROM w) SELECT * FROM s WHERE score >= 0.3""",
    "time_ranges": """WITH o AS (SELECT o_orderdate AS d, TIMESTAMP '1998-08-02 00:00:00' AS now FROM orders), h AS (SELECT 'Today' AS hint FROM o WHERE d > now - INTERVAL 1 DAY AND d <= now UNION ALL SELECT 'Yesterday' FROM o WHERE d > now - INTERVAL 2 DAY AND d <= now - INTERVAL 1 DAY
      UNION ALL SELECT 'ThisWeek' FROM o WHERE d > now - INTERVAL 7 DAY AND d <= now UNION ALL SELECT 'ThisMonth' FROM o WHERE d > now - INTERVAL 30 DAY AND d <= now UNION ALL SELECT 'Old' FROM o WHERE d <= now - INTERVAL 90 DAY) SELECT hint, count(*) AS n FROM h GROUP BY hint""",
    "cache_stats": """WITH e AS (SELECT user_id, props->>'$.k' AS key, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2)
    SELECT user_id, CAST(sum(n - 1) AS BIGINT) AS hits, count(*) AS misses, round(sum(n - 1) / sum(n), 6)::DOUBLE AS hit_rate FROM e GROUP BY 1""",
    "page_counts": "SELECT doc_id, CAST(CASE WHEN contains(text, chr(12)) THEN len(string_split(text, chr(12))) ELSE length(text) // 3000 + 1 END AS BIGINT) AS pages FROM documents",
    "graph_nodes": """WITH e AS (SELECT l_partkey AS s, l_suppkey AS t FROM lineitem JOIN part p ON p.p_partkey = l_partkey AND p.p_size >= 10 JOIN part q ON q.p_partkey = l_suppkey AND q.p_size >= 10 WHERE l_partkey <> l_suppkey AND l_returnflag <> 'R')
    SELECT node, count(*) AS degree FROM (SELECT s AS node FROM e UNION ALL SELECT t FROM e) GROUP BY node""",
}
