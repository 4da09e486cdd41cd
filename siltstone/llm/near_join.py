"""Operator 8: Jaccard join of word shingle sets by chosen paths.

1. Every text becomes the set of hashes of its five-word windows; sets that are equal become one class
   with its smallest id as representative, ``COORDS`` minimum hashes and a 1-byte sketch of them.
2. Each of ``runs`` independent runs splits all representatives recursively: a node of the tree samples
   one or two hash coordinates (1 / threshold on average), and its sets go to the children named by
   the values they share.  Children with one set end; small ones are compared within by sketch;
   larger ones are split again, and sets that still share a large node after ``DEPTH`` splits are
   all taken as candidates.  Nodes only emit the links that connect their sets, never all pairs.
3. Candidates are connected, and inside each candidate component the exact sets are compared, all with
   all, in blocks of bounded size.  That counts each set's links and leaves the links that connect
   the final classes.

A pair of sets at the threshold meets in one run's first split with probability 0.84; with 10 runs it
is missed with probability 1e-8 there, and below 1e-3 after three splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import load

from .components import components, least_labels
from .kernel import Slab, mix, slabs
from .skew import join_counted
from .storage import modest_batches, stored

WORDS, THRESHOLD, RUNS = 5, 0.8, 10
COORDS, SMALL, DEPTH = 128, 100, 6
BLOCK = 512
#: Sketches agree less often than this for a pair at the threshold about once in 1e5.
SLACK = 0.15
_U = np.uint64
_MULT = np.random.default_rng(8).integers(1, 1 << 63, COORDS, dtype=np.uint64) | _U(1)


def shingles(s: Slab, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted by text and hash; fewer than k words make one shingle."""
    h, at = s.windows(k)
    hs, docs = [h], [s.word_doc[at]]
    for j in range(1, k):
        h, at = s.windows(j)
        few = s.n_words[s.word_doc[at]] == j
        hs.append(h[few]), docs.append(s.word_doc[at][few])
    h, doc = np.concatenate(hs), np.concatenate(docs)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int = WORDS) -> DataFrame:
    """(id, key, a, b, sig): 128-bit digest of the shingle set and its minimum hashes; only texts with a word."""
    kind = dict(docs.dtypes)[id_col]
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slabs(b.column("text")):
                h, doc = shingles(s, k)
                if not len(h):
                    continue
                cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                sig = np.stack([np.minimum.reduceat(((h * m) >> _U(32)).astype(np.uint32), cut) for m in _MULT], 1)
                row = pa.array(doc[cut] + s.first)
                digest = [np.add.reduceat(mix(h ^ _U(c)), cut).view(np.int64) for c in (11, 12)]
                yield pa.RecordBatch.from_arrays([b.column("id").take(row), b.column("key").take(row), pa.array(digest[0]), pa.array(digest[1]), pa.array([r.tobytes() for r in sig], pa.binary())], ["id", "key", "a", "b", "sig"])

    return base.mapInArrow(run, f"id {kind}, key long, a long, b long, sig binary")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """A column of equally long binaries as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def split(rows: DataFrame, runs: int, threshold: float) -> DataFrame:
    """Children of each row (id, node, sig): (id, node) for every sampled coordinate.  A null node is all roots."""
    kind = dict(rows.dtypes)["id"]
    second = 1 / threshold - 1  # chance of a second coordinate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig, n = _matrix(b.column("sig"), "<u4"), b.num_rows
            if b.column("node").null_count:
                node, row = mix(np.repeat(np.arange(1, runs + 1), n).astype(np.uint64)), np.tile(np.arange(n), runs)
            else:
                node, row = b.column("node").to_numpy().view(np.uint64), np.arange(n)
            for draw in range(2):
                r = mix(node + _U(101 + draw))
                take = np.ones(len(r), bool) if not draw else (mix(node + _U(99)) >> _U(11)).astype(float) / 2.0**53 < second
                at = (r[take] % _U(COORDS)).astype(np.int64)
                child = mix(node[take] ^ mix(sig[row[take], at].astype(np.uint64) << _U(8) | at.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row[take])), pa.array(child.view(np.int64))], ["id", "node"])

    return rows.select("id", "node", "sig").mapInArrow(run, f"id {kind}, node long")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows sorted by ``key`` as tables of whole groups."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key)
        last = int(np.searchsorted(k.to_numpy(), k[-1].as_py(), "left"))
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)])
            held = [b.slice(last)]
        elif held and held[0].column(key)[0].as_py() != k[0].as_py():
            yield pa.Table.from_batches(held)
            held = [b]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def compare_small(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (u, v) that connect the sets of each small node (id, node, sketch) whose sketches agree enough."""
    kind = dict(rows.dtypes)["id"]
    least = threshold - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "node"):
            node, ids = t["node"].to_numpy(), t["id"].combine_chunks()
            sketch = _matrix(t["sketch"].combine_chunks(), "u1")
            left, right = [], []
            for k in range(1, len(node)):
                i = np.flatnonzero(node[:-k] == node[k:])
                if not len(i):
                    break
                i = i[(sketch[i] == sketch[i + k]).mean(1) >= least]
                left.append(i), right.append(i + k)
            if left:
                label = least_labels(len(node), np.concatenate(left), np.concatenate(right))
                row = np.flatnonzero(label != np.arange(len(node)))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), ids.take(pa.array(label[row]))], ["u", "v"])

    dealt = rows.select("id", "node", "sketch").repartition("node").sortWithinPartitions("node", "id")
    return dealt.mapInArrow(run, f"u {kind}, v {kind}").distinct()


def candidates(reps: DataFrame, runs: int, threshold: float) -> DataFrame:
    """Links (u, v) that connect all sets which the runs bring together."""
    sketch = reps.select("id", "sketch")
    rows, found = reps.withColumn("node", F.lit(None).cast("long")), []
    for depth in range(DEPTH):
        children = stored(split(rows, runs, threshold), "nodes")
        sizes = stored(children.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"), "sizes")
        shared = stored(join_counted(children, sizes, ["node"], "n"), "shared")
        found.append(compare_small(shared.where(F.col("n") <= SMALL).select("id", "node").join(sketch, "id"), threshold))
        large = shared.where(F.col("n") > SMALL)
        if large.isEmpty():
            break
        if depth == DEPTH - 1:
            found.append(large.select(F.col("id").alias("u"), F.col("least").alias("v")).where("u <> v").distinct())
        rows = large.select("id", "node").join(reps.select("id", "sig"), "id")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def exact_links(ids: np.ndarray, side: np.ndarray, mult: np.ndarray, texts: pa.Array, first: bool, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of linked documents of each set, and the smallest set it is connected to; exact.

    ``first``: all pairs count; else those of different ``side``.
    """
    hs, docs = [], []
    for s in slabs(texts):
        h, doc = shingles(s, k)
        hs.append(h), docs.append(doc + s.first)
    h, doc = np.concatenate(hs), np.concatenate(docs)
    n = len(ids)
    size = np.bincount(doc, minlength=n)
    _, token, freq = np.unique(h, return_inverse=True, return_counts=True)
    keep = freq[token] > 1
    token, doc = token[keep], doc[keep]
    _, token = np.unique(token, return_inverse=True)
    common = np.zeros((n, n), np.float32)
    order = np.argsort(token, kind="stable")
    token, doc = token[order], doc[order]
    width = max(64, (1 << 21) // max(n, 1))
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        i, j = np.searchsorted(token, [lo, lo + width])
        a = np.zeros((n, width), np.float32)
        a[doc[i:j], token[i:j] - lo] = 1
        common += a @ a.T
    # |A and B| >= t |A or B| in whole numbers of 1e-9, so equality counts
    union = size[:, None] + size[None, :] - common
    link = (common >= threshold * union - 1e-6) & (common > 0)
    np.fill_diagonal(link, False)
    if not first:
        link &= side[:, None] != side[None, :]
    i, j = np.nonzero(np.triu(link))
    return link @ mult, least_labels(n, i, j)


def verify(members: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float) -> DataFrame:
    """(id, n, root) of each member (id, key, component, mult) and block pair: exact links inside candidate components."""
    sizes = members.groupBy("component").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    blocks = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tasks = blocks.select("id", "key", "component", "mult", "block", other).select(
        "id", "key", "mult", "block", (F.col("block") == F.col("other")).alias("own"),
        F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other")).alias("task"))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    wanted = texts.join(members.select("id", "key"), ["id", "key"]).dropDuplicates(["id", "key"])
    rows = wanted.join(tasks, ["id", "key"]).drop("key")
    kind = dict(members.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "task"):
            task = t["task"].to_numpy()
            cut = np.append(np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])), len(task))
            for i, j in zip(cut[:-1], cut[1:]):
                g = t.slice(i, j - i)
                ids = g["id"].combine_chunks()
                own = bool(g["own"][0].as_py())
                n, label = exact_links(ids, g["block"].to_numpy(), g["mult"].to_numpy(), g["text"], own, k, threshold)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), ids.take(pa.array(label))], ["id", "n", "root"])

    dealt = rows.select("task", "id", "block", "own", "mult", "text").repartition("task").sortWithinPartitions("task", "id")
    return dealt.mapInArrow(run, f"id {kind}, n long, root {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, runs: int = RUNS) -> DataFrame:
    """One row per row of ``docs``: id, class_id, n_links, kept.

    ``n_links`` counts the other rows whose shingle set has at least the threshold in common with this
    one's, equal texts included; ``class_id`` is the smallest id reachable over links.  A text of fewer
    than ``words`` words is one shingle; a null text or one without words links with nothing and is
    its own class; a row with a null id is not compared (null class, no links, kept).  Repeated rows
    are copies of each other: each gets a result, and their id is one node.
    """
    modest_batches(docs.sparkSession)
    marks = stored(signatures(docs, id_col, text_col, words), "signatures")
    classes = marks.groupBy("a", "b").agg(F.min(F.struct("id", "key")).alias("rep"), F.count("*").alias("mult"))
    classes = stored(classes.select("a", "b", F.col("rep.id").alias("id"), F.col("rep.key").alias("key"), "mult"), "classes")
    kind = dict(docs.dtypes)[id_col]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("sig"), pa.array([r.tobytes() for r in _matrix(b.column("sig"), "<u4").astype(np.uint8)] if b.num_rows else [], pa.binary())], ["id", "sig", "sketch"])

    reps = marks.join(classes.select("a", "b", "id", "key"), ["a", "b", "id", "key"]).select("id", "sig").dropDuplicates(["id"])
    reps = stored(reps.mapInArrow(sketch, f"id {kind}, sig binary, sketch binary"), "representatives")
    grouped = components(candidates(reps, runs, threshold))
    members = stored(classes.select("id", "key", "mult").dropDuplicates(["id"]).join(grouped, "id"), "members")
    exact = stored(verify(members, docs, id_col, text_col, words, threshold), "links")
    links = exact.groupBy("id").agg(F.sum("n").alias("n"))
    final = components(exact.select(F.col("id").alias("u"), F.col("root").alias("v")))
    of_rep = classes.select("a", "b", "id", "mult").join(links, "id", "left").join(final, "id", "left")
    of_rep = of_rep.select("a", "b", F.coalesce("component", "id").alias("class_id"), (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    of_doc = marks.select("id", "key", "a", "b").distinct().join(of_rep, ["a", "b"]).select("id", "key", "class_id", "n_links")
    all_rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"))
    out = all_rows.join(of_doc, ["id", "key"], "left").select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("class_id"), F.lit(True)))


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), sets AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 10 * c >= 8 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), class AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x)
SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE links.x = doc_id) AS n_links, doc_id = class_id AS kept FROM class
"""
