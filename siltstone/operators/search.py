"""Search: postings, BM25, vector search, score fusion, filters and pages."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions import vectors as V
from siltstone.sources.tables import file_extension, file_name, load

#: One query for all searches: words of texts, of file names and of tags.
TERMS = ["thtion", "attion", "thble", "md", "src3"]
K1, B = 1.2, 0.75


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf): partial counts are combined before the shuffle by (doc_id, term)."""
    return docs.select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def counted_fields(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, length of each field, count of each term in it): text, file name and tags of every document.

    The counts are dealt out by doc_id, so that a plan which reads them twice (for the totals and for the
    scores) tokenises the texts once and reads the exchange again.
    """
    fields = [T.analysed(F.col("text")), T.analysed(file_name()), T.analysed(F.concat_ws(" ", "lang", "source"))]
    split = docs.select("doc_id", *[f.alias(f"t{k}") for k, f in enumerate(fields)])
    count = lambda k, t: F.size(F.filter(f"t{k}", lambda w: w == t))
    cols = [F.size(f"t{k}").alias(f"dl{k}") for k in range(len(fields))] + [count(k, t).alias(f"tf{k}_{i}") for k in range(len(fields)) for i, t in enumerate(terms)]
    return split.select("doc_id", *cols).repartition("doc_id")


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, bm25) of documents with any of the terms, summed over terms and fields; nothing runs before an action.

    Totals (documents, mean lengths, document frequencies) are one row, which every task gets.
    """
    counted, fields = counted_fields(docs, terms), range(3)
    cells = [(k, i) for k in fields for i in range(len(terms))]
    totals = counted.agg(F.count("*").alias("n"), *[F.greatest(F.avg(f"dl{k}"), F.lit(1e-9)).alias(f"avgdl{k}") for k in fields], *[F.count_if(F.col(f"tf{k}_{i}") > 0).alias(f"df{k}_{i}") for k, i in cells])
    score: Column = F.lit(0.0)
    for k, i in cells:
        tf, df = F.col(f"tf{k}_{i}"), F.col(f"df{k}_{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"dl{k}") / F.col(f"avgdl{k}")))
    return counted.crossJoin(F.broadcast(totals)).select("doc_id", score.alias("bm25")).where("bm25 > 0")


@dataclass(frozen=True)
class Filters:
    """What a search may return; empty or None means any."""

    file_types: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()
    exclude_tags: tuple[str, ...] = ()
    path_prefix: str | None = None
    min_score: float = 0.3
    exclude_private: bool = False
    #: Bounds of the time of the last change, both included; a file without one fails them.
    modified_from: str | None = None
    modified_to: str | None = None

    def keep(self, files: DataFrame) -> DataFrame:
        """The doc_ids of files (doc_id, extension, path, tags, private, and modified_at if times are bounded) that may be returned."""
        rule = F.lit(True)
        if self.file_types:
            rule = rule & T.file_type(F.col("extension")).isin(*self.file_types)
        if self.tags:
            rule = rule & (F.size(F.array_except(F.array(*[F.lit(x) for x in self.tags]), "tags")) == 0)
        if self.exclude_tags:
            rule = rule & ~F.arrays_overlap("tags", F.array(*[F.lit(x) for x in self.exclude_tags]))
        if self.path_prefix:
            rule = rule & F.col("path").startswith(self.path_prefix)
        if self.exclude_private:
            rule = rule & ~F.col("private")
        if self.modified_from is not None:
            rule = rule & (F.col("modified_at") >= F.lit(self.modified_from).cast("timestamp_ntz"))
        if self.modified_to is not None:
            rule = rule & (F.col("modified_at") <= F.lit(self.modified_to).cast("timestamp_ntz"))
        return files.where(rule).select("doc_id")


def request_filters(request: dict) -> Filters:
    """A request's filters: unknown type names are dropped, tags are those that are words; ``time_range`` has a start, an end or both."""
    types = dict.fromkeys(T.REQUEST_TYPES.get(str(x).lower()) for x in request.get("file_types") or [])
    words = lambda key: tuple(x for x in request.get(key) or [] if isinstance(x, str) and re.fullmatch(r"\w+", x))
    least, times = request.get("min_score"), request.get("time_range") or {}
    return Filters(tuple(x for x in types if x), words("tags"), words("exclude_tags"), request.get("path_prefix") or None, 0.3 if least is None else float(least), bool(request.get("exclude_private", False)), times.get("start"), times.get("end"))


def search_weights(vector: float, text: float, normalise: bool = False) -> tuple[float, float]:
    """The two weights, which sum to 1 within 0.001, or are scaled so."""
    if normalise and vector + text > 0:
        vector, text = vector / (vector + text), text / (vector + text)
    if abs(vector + text - 1) > 0.001:
        raise ValueError(f"weights {vector} and {text} do not sum to 1")
    return vector, text


def _query_vector(vectors: DataFrame, vec_id: int = 0) -> Column:
    row = vectors.where(F.col("vec_id") == vec_id).select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in (row[0] if row else [])])


def q_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(load(spark, sf_dir, "documents"))


def q_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bm25(load(spark, sf_dir, "documents"), TERMS).withColumn("bm25", F.round("bm25", 6))
    return out.orderBy(F.desc("bm25"), "doc_id").limit(50)


def _knn(name: str, score) -> callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = load(spark, sf_dir, "embeddings")
        s = F.round(score(F.col("embedding"), _query_vector(v)), 6)
        return v.where(F.size("embedding") == 64).select("vec_id", s.alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)

    query.__name__ = name
    return query


def q_vector_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload filter (type, privacy, required tags) before the top k; a missing value fails all tests but privacy's."""
    v = load(spark, sf_dir, "embeddings")
    v = v.withColumn("privacy", F.when(F.col("vec_id") % 3 == 0, "Private").when(F.col("vec_id") % 3 == 1, "Normal")).withColumn("tags", F.array(F.col("label") % 2, F.col("label") % 5))
    need = F.array(F.lit(1), F.lit(3))
    kept = v.where(F.col("label").isin(1, 3, 5, 7) & (F.coalesce("privacy", F.lit("")) != "Private") & (F.size(F.array_except(need, "tags")) == 0))
    return kept.select("vec_id", "label", F.round(V.cosine(F.col("embedding"), _query_vector(v)), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


def fuse(vector_hits: DataFrame, text_hits: DataFrame, w_vector: float = 0.6, w_text: float = 0.4) -> DataFrame:
    """Full outer merge of (doc_id, vector) and (doc_id, text) hits, each scaled by its largest score.

    Rows with both scores low (under 0.3 and 0.1) are dropped; a missing score passes.  The two largest
    scores are one row, which every task gets.
    """
    top = lambda df, c: df.agg(F.max(c).alias(f"top_{c}"))
    tops = F.broadcast(top(vector_hits, "vector").crossJoin(top(text_hits, "text")))
    scaled = lambda c: F.col(c) / F.when(F.col(f"top_{c}") > 0, F.col(f"top_{c}")).otherwise(1.0)
    both = vector_hits.join(text_hits, "doc_id", "full_outer").crossJoin(tops).select("doc_id", scaled("vector").alias("v"), scaled("text").alias("b"))
    both = both.where("v IS NULL OR v >= 0.3 OR b IS NULL OR b >= 0.1")
    origin = F.when(F.col("v").isNull(), "BM25").when(F.col("b").isNull(), "Vector").otherwise("Both")
    return both.select("doc_id", origin.alias("origin"), F.round(w_vector * F.coalesce("v", F.lit(0.0)) + w_text * F.coalesce("b", F.lit(0.0)), 6).alias("score"))


def boost(words: list[str]) -> Column:
    """Boost of a hit (name, tags): its file name holds the query (x 1.5) or a query word (x 1.1 each), a tag holds one (x 1.2 each)."""
    whole = F.when(F.col("name").contains("_".join(words)), 1.5).otherwise(1.0)
    return whole * F.pow(F.lit(1.1), sum(F.when(F.col("name").contains(w), 1).otherwise(0) for w in words)) * F.pow(F.lit(1.2), F.size(F.filter("tags", lambda t: T.contains_any(t, words))))


#: A range of time for the searches that have one.
SINCE, UNTIL = "2024-01-01 06:00:00", "2024-01-03 18:00:00"
HYBRID = request_filters({"file_types": ["txt", "docx", "image", "code", "pdf", "nonsense"], "exclude_tags": ["src4"], "path_prefix": "/src", "min_score": 0.05})


def changed_at(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """``docs`` with modified_at: the time of the event of the same number, null without one."""
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp_ntz").alias("modified_at"))
    return docs.join(e, "doc_id", "left")


def hybrid(spark: SparkSession, sf_dir: str, filters: Filters) -> DataFrame:
    """The filters go to both sides, each side's best 200 are merged, boosted and sorted again; the best 100 stay."""
    docs, vecs = load(spark, sf_dir, "documents"), load(spark, sf_dir, "embeddings")
    files = docs.select("doc_id", file_extension().alias("extension"), F.concat(F.lit("/"), "source").alias("path"), F.array("lang", "source").alias("tags"), F.lit(False).alias("private"))
    if filters.modified_from is not None or filters.modified_to is not None:
        files = changed_at(spark, sf_dir, files)
    may = filters.keep(files)
    asked = F.broadcast(vecs.where("vec_id = 0").select(F.col("embedding").alias("asked")).limit(1))
    near = vecs.where(F.size("embedding") == 64).crossJoin(asked).select(F.col("vec_id").alias("doc_id"), V.cosine(F.col("embedding"), F.col("asked")).alias("vector"))
    near = near.join(may, "doc_id", "left_semi").orderBy(F.desc("vector"), "doc_id").limit(200)
    hits = bm25(docs, TERMS).withColumnRenamed("bm25", "text").join(may, "doc_id", "left_semi").orderBy(F.desc("text"), "doc_id").limit(200)
    merged = fuse(near, hits).join(docs.select("doc_id", file_name().alias("name"), F.array("lang", "source").alias("tags")), "doc_id")
    scored = merged.select("doc_id", "origin", F.round(F.col("score") * boost(TERMS), 6).alias("score")).where(F.col("score") >= filters.min_score)
    return scored.orderBy(F.desc("score"), "doc_id").limit(100)


def q_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with filters on types, tags and path."""
    return hybrid(spark, sf_dir, HYBRID)


def q_hybrid_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among files changed within a range of time, on both sides."""
    return hybrid(spark, sf_dir, replace(HYBRID, modified_from=SINCE, modified_to=UNTIL))


def filtered_after_top(hits: DataFrame, files: DataFrame, any_tags: list[str], modified_from: str | None, modified_to: str | None, limit: int) -> DataFrame:
    """The text side's own filter, which comes after its best ``2 * limit`` hits (doc_id, bm25): any of the tags, and time bounds that a file (doc_id, tags, modified_at) without a time fails."""
    top = hits.orderBy(F.desc("bm25"), "doc_id").limit(2 * limit).join(files, "doc_id")
    if any_tags:
        top = top.where(F.arrays_overlap("tags", F.array(*map(F.lit, any_tags))))
    if modified_from is not None:
        top = top.where(F.col("modified_at") >= F.lit(modified_from).cast("timestamp_ntz"))
    if modified_to is not None:
        top = top.where(F.col("modified_at") <= F.lit(modified_to).cast("timestamp_ntz"))
    return top.select("doc_id", "bm25").orderBy(F.desc("bm25"), "doc_id").limit(limit)


def q_filtered_after_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the best 200 hits those with one of two tags and a change in a range of time, 100 at most."""
    docs = load(spark, sf_dir, "documents")
    files = changed_at(spark, sf_dir, docs.select("doc_id", F.array("lang", "source").alias("tags")))
    return filtered_after_top(bm25(docs, TERMS).withColumn("bm25", F.round("bm25", 6)), files, ["en", "src1"], SINCE, UNTIL, 100)


def q_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("name"), F.array("lang", "source").alias("tags"))
    return d.select("doc_id", F.round(boost(["doc", "12"]), 6).alias("boost"))


def q_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 20 with the total and whether more follow."""
    hits = bm25(load(spark, sf_dir, "documents"), TERMS).withColumn("bm25", F.round("bm25", 6))
    total = F.broadcast(hits.agg(F.count("*").alias("total")))
    return hits.orderBy(F.desc("bm25"), "doc_id").offset(40).limit(20).crossJoin(total).select("doc_id", "bm25", "total", (F.col("total") > 60).alias("has_more"))


def similar_vectors(vectors: DataFrame, k: int, least: float, tile: int = 4096) -> DataFrame:
    """For each vec_id divisible by 100 its k most similar other vectors (cosine >= least).

    Queries and vectors are hashed into tiles of bounded size and every pair of tiles is one task, so
    neither side is broadcast; a task keeps k candidates a query, and a window takes the best k.
    """
    n = vectors.count()
    n_tiles, q_tiles = max(1, -(-n // tile)), max(1, -(-n // (100 * 512)))
    good = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0)).select("vec_id", "embedding")
    here = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    data = good.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1)))).withColumn("t", here("vec_id", n_tiles)).withColumn("query", F.lit(False))
    asked = good.where("vec_id % 100 = 0").withColumn("q", here("vec_id", q_tiles)).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1)))).withColumn("query", F.lit(True))

    def best(g: pd.DataFrame) -> pd.DataFrame:
        a, b = g[g["query"]], g[~g["query"]]
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, y = (np.stack(s["embedding"].to_numpy()).astype(float) for s in (a, b))
        norm = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :]
        s = np.round(np.divide(x @ y.T, norm, out=np.zeros_like(norm), where=norm > 0), 6)
        ids = b["vec_id"].to_numpy()
        s[a["vec_id"].to_numpy()[:, None] == ids[None, :]] = -2
        if s.shape[1] > k:  # only columns that may be among some row's best k are sorted, ties with the k-th too
            near = np.flatnonzero((s >= np.partition(s, -k, axis=1)[:, -k, None]).any(0))
            s, ids = s[:, near], ids[near]
        order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
        out = pd.DataFrame({"query_id": np.repeat(a["vec_id"].to_numpy(), order.shape[1]), "vec_id": ids[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})
        return out[out["score"] >= least]

    found = data.unionByName(asked).groupBy("q", "t").applyInPandas(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def q_similar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors(load(spark, sf_dir, "embeddings"), 10, 0.2)


_NAME = "'doc_' || doc_id || '.' || (['txt','md','pdf','docx','xlsx','png','mp4','mp3','py','stl','zip','dat'])[doc_id % 12 + 1]"


#: The analysed fields of a document in SQL.
FIELDS_SQL = ["coalesce(text, '')", _NAME, "lang || ' ' || source"]


def bm25_sql() -> str:
    fields = FIELDS_SQL
    cells = [(k, i) for k in range(3) for i in range(len(TERMS))]
    split = ", ".join(f"list_filter(regexp_extract_all(lower({f}), '{T.WORD}'), lambda w: strlen(w) <= 40) AS t{k}" for k, f in enumerate(fields))
    cols = ", ".join([f"len(t{k}) AS dl{k}" for k in range(3)] + [f"len(list_filter(t{k}, lambda w: w = '{TERMS[i]}')) AS tf{k}_{i}" for k, i in cells])
    one = " + ".join(f"ln(1 + (n - df{k}_{i} + 0.5) / (df{k}_{i} + 0.5)) * tf{k}_{i} * {K1 + 1} / (tf{k}_{i} + {K1} * (1 - {B} + {B} * dl{k} / avgdl{k}))" for k, i in cells)
    means = ", ".join(f"greatest(avg(dl{k}), 1e-9) AS avgdl{k}" for k in range(3))
    counts = ", ".join(f"count(*) FILTER (tf{k}_{i} > 0) AS df{k}_{i}" for k, i in cells)
    return f"""counted AS (SELECT doc_id, {cols} FROM (SELECT doc_id, {split} FROM documents)),
    stats AS (SELECT count(*) AS n, {means}, {counts} FROM counted),
    scored AS (SELECT doc_id, {one} AS bm25 FROM counted, stats WHERE {' OR '.join(f'tf{k}_{i} > 0' for k, i in cells)})"""


def _boost_sql(words: list[str]) -> str:
    has = lambda c: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")::INT"
    each = " + ".join(f"contains(name, '{w}')::INT" for w in words)
    return f"CASE WHEN contains(name, '{'_'.join(words)}') THEN 1.5 ELSE 1.0 END * pow(1.1, {each}) * pow(1.2, {has('lang')} + {has('source')})"


_Q = "CAST((SELECT embedding FROM embeddings WHERE vec_id = 0) AS DOUBLE[])"
_E = "CAST(embedding AS DOUBLE[])"

QUERIES = {
    "hybrid_search": q_hybrid_search,
    "hybrid_in_time": q_hybrid_in_time,
    "filtered_after_top": q_filtered_after_top,
    "postings": q_postings,
    "bm25_topk": q_bm25_topk,
    "knn_cosine": _knn("knn_cosine", V.cosine),
    "knn_euclidean": _knn("knn_euclidean", V.euclidean_similarity),
    "knn_dot": _knn("knn_dot", V.dot),
    "vector_filtered": q_vector_filtered,
    "boosted": q_boosted,
    "search_page": q_search_page,
    "similar_files": q_similar_files,
}
ORACLE_SQL = {
    "hybrid_search": f"""WITH {bm25_sql()}, files AS (SELECT doc_id, lang, source, {_NAME} AS name FROM documents),
    may AS (SELECT doc_id FROM files WHERE doc_id % 12 IN (0, 2, 3, 4, 5, 8, 1) AND lang <> 'src4' AND source <> 'src4' AND starts_with('/' || source, '/src')),
    near AS (SELECT vec_id AS doc_id, list_cosine_similarity({_E}, {_Q}) AS vector FROM embeddings WHERE len(embedding) = 64 AND vec_id IN (SELECT doc_id FROM may) ORDER BY vector DESC, vec_id LIMIT 200),
    hits AS (SELECT doc_id, bm25 FROM scored WHERE doc_id IN (SELECT doc_id FROM may) ORDER BY bm25 DESC, doc_id LIMIT 200),
    top AS (SELECT (SELECT max(vector) FROM near) AS v, (SELECT max(bm25) FROM hits) AS t),
    merged AS (SELECT coalesce(near.doc_id, hits.doc_id) AS doc_id, vector / CASE WHEN top.v > 0 THEN top.v ELSE 1 END AS v, bm25 / CASE WHEN top.t > 0 THEN top.t ELSE 1 END AS b
      FROM near FULL OUTER JOIN hits ON near.doc_id = hits.doc_id, top),
    fused AS (SELECT doc_id, CASE WHEN v IS NULL THEN 'BM25' WHEN b IS NULL THEN 'Vector' ELSE 'Both' END AS origin, round(0.6 * coalesce(v, 0) + 0.4 * coalesce(b, 0), 6) AS score
      FROM merged WHERE v IS NULL OR v >= 0.3 OR b IS NULL OR b >= 0.1)
    SELECT * FROM (SELECT doc_id, origin, round(score * {_boost_sql(TERMS)}, 6) AS score FROM fused JOIN files USING (doc_id)) WHERE score >= 0.05 ORDER BY score DESC, doc_id LIMIT 100""",
    "postings": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{T.WORD}')) AS term FROM documents) GROUP BY ALL",
    "bm25_topk": f"WITH {bm25_sql()} SELECT doc_id, round(bm25, 6) AS bm25 FROM scored ORDER BY 2 DESC, doc_id LIMIT 50",
    "knn_cosine": f"SELECT vec_id, round(list_cosine_similarity({_E}, {_Q}), 6) AS score FROM embeddings WHERE len(embedding) = 64 ORDER BY score DESC, vec_id LIMIT 20",
    "knn_euclidean": f"SELECT vec_id, round(1 / (1 + list_distance({_E}, {_Q})), 6) AS score FROM embeddings WHERE len(embedding) = 64 ORDER BY score DESC, vec_id LIMIT 20",
    "knn_dot": f"SELECT vec_id, round(list_inner_product({_E}, {_Q}), 6) AS score FROM embeddings WHERE len(embedding) = 64 ORDER BY score DESC, vec_id LIMIT 20",
    "vector_filtered": f"SELECT vec_id, label, round(list_cosine_similarity({_E}, {_Q}), 6) AS score FROM embeddings WHERE label IN (1, 3, 5, 7) AND vec_id % 3 <> 0 AND label % 2 = 1 AND label % 5 = 3 ORDER BY score DESC, vec_id LIMIT 20",
    "boosted": """WITH d AS (SELECT doc_id, 'doc_' || doc_id || '.txt' AS name, lang, source FROM documents)
    SELECT doc_id, round(CASE WHEN contains(name, 'doc_12') THEN 1.5 ELSE 1.0 END * pow(1.1, contains(name, 'doc')::INT + contains(name, '12')::INT)
      * pow(1.2, (contains(lang, 'doc') OR contains(lang, '12'))::INT + (contains(source, 'doc') OR contains(source, '12'))::INT), 6) AS boost FROM d""",
    "search_page": f"WITH {bm25_sql()}, total AS (SELECT count(*) AS total FROM scored) SELECT doc_id, round(bm25, 6) AS bm25, total, total > 60 AS has_more FROM scored, total ORDER BY round(bm25, 6) DESC, doc_id LIMIT 20 OFFSET 40",
    "similar_files": """WITH pairs AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
      FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs WHERE score >= 0.2) WHERE rank <= 10""",
}
_IN_TIME = f"ts >= TIMESTAMP '{SINCE}' AND ts <= TIMESTAMP '{UNTIL}'"
ORACLE_SQL["hybrid_in_time"] = ORACLE_SQL["hybrid_search"].replace("may AS (SELECT doc_id FROM files WHERE", f"may AS (SELECT doc_id FROM files JOIN events ON event_id = doc_id AND {_IN_TIME} WHERE")
ORACLE_SQL["filtered_after_top"] = f"""WITH {bm25_sql()}, top AS (SELECT doc_id, round(bm25, 6) AS bm25 FROM scored ORDER BY 2 DESC, doc_id LIMIT 200)
    SELECT doc_id, bm25 FROM top JOIN documents USING (doc_id) JOIN events ON event_id = doc_id WHERE (lang IN ('en', 'src1') OR source IN ('en', 'src1')) AND {_IN_TIME} ORDER BY bm25 DESC, doc_id LIMIT 100"""
