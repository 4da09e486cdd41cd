"""Operator 7: near-duplicate embeddings by int8 tile products.

Equal vectors become one representative with a multiplicity.  Representatives are hashed into tiles of
about ``TILE``; every pair of tiles is one task.  In a task the unit vectors are quantised to int8 with
one scale a tile; integer dot products (exact in float32 as long as they stay below 2**24, float64
beyond) give each cosine within a bound that follows from the vectors' quantisation errors:

    |u.v - u'.v'| <= |u - u'| |v'| + |u'| |v - v'| + |u - u'| |v - v'|

Only pairs that the bound leaves possible are recomputed in double precision.  A task returns, per
vector, how many vectors it links with and one vector it is connected to: never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components, least_labels
from .near_join import whole_groups
from .storage import modest_batches, stored

#: Vectors of a tile, at most, and components of all its vectors.
TILE, TILE_COMPONENTS = 4096, 1 << 22
ROWS = 512
PAIRS = 1 << 16


def quantise(x: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Unit rows as int8, their scale, and per row the norms of the quantised vector and of its error."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = float(np.abs(unit).max(initial=1e-300)) / 127
    q = np.rint(unit / scale).astype(np.int8)
    return q, scale, np.linalg.norm(q * scale, axis=1), np.linalg.norm(unit - q * scale, axis=1)


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i, j) of rows of x and y, or with y None of two rows i < j of x, block by block."""
    qx, sx, nx, ex = quantise(x)
    qy, sy, ny, ey = (qx, sx, nx, ex) if y is None else quantise(y)
    z = x if y is None else y
    kind = np.float32 if x.shape[1] * 127 * 127 < 1 << 24 else np.float64
    norm_x, norm_z = np.linalg.norm(x, axis=1), np.linalg.norm(z, axis=1)
    right = qy.astype(kind).T.copy()
    # 1e-9 covers the rounding of the bound itself
    least = (threshold - 1e-9 - (ex * ny.max() + nx * ey.max() + ex * ey.max())) / (sx * sy)
    for i in range(0, len(x), ROWS):
        dots = qx[i : i + ROWS].astype(kind) @ right
        a, b = np.nonzero(dots >= least[i : i + ROWS, None].astype(kind) - 1)
        a += i
        if y is None:
            a, b = a[a < b], b[a < b]
        keep = [np.einsum("ij,ij->i", x[a[k : k + PAIRS]], z[b[k : k + PAIRS]]) / (norm_x[a[k : k + PAIRS]] * norm_z[b[k : k + PAIRS]]) >= threshold for k in range(0, len(a), PAIRS)]
        if keep:
            keep = np.concatenate(keep)
            yield a[keep], b[keep]


def link_counts(reps: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(id, n, root) from reps (id, mult, dim, vector), once per vector and task it took part in."""
    most = F.least(F.lit(tile), F.greatest(F.lit(64), F.lit(TILE_COMPONENTS) / F.greatest("dim", F.lit(1))))
    sizes = reps.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / most).cast("int").alias("tiles"))
    placed = reps.join(sizes, "dim").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = spread.select(F.xxhash64("dim", F.least("tile", "other"), F.greatest("tile", "other")).alias("task"), "tile", (F.col("tile") == F.col("other")).alias("own"), "id", "mult", "vector")
    kind = dict(reps.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "task"):
            task = t["task"].to_numpy()
            cut = np.append(np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])), len(task))
            for i, j in zip(cut[:-1], cut[1:]):
                g = t.slice(i, j - i)
                x = g["vector"].combine_chunks().flatten().to_numpy().astype(float).reshape(j - i, -1)
                x /= np.abs(x).max(1, keepdims=True)  # so that no square under- or overflows; the cosine stays
                mult, side = g["mult"].to_numpy(), g["tile"].to_numpy()
                n, left, right = np.zeros(j - i, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                own = bool(g["own"][0].as_py())
                half = j - i if own else int(np.searchsorted(side, side[-1], "left"))
                for a, b in tile_links(x, None, threshold) if own else tile_links(x[:half], x[half:], threshold) if 0 < half < j - i else ():
                    b = b if own else b + half
                    n += np.bincount(a, mult[b], j - i).astype(np.int64) + np.bincount(b, mult[a], j - i).astype(np.int64)
                    label = least_labels(j - i, np.concatenate([*left, a]), np.concatenate([*right, b]))
                    row = np.flatnonzero(label != np.arange(j - i))
                    left, right = [row], [label[row]]
                at = np.flatnonzero(n)
                label = least_labels(j - i, left[0], right[0])
                ids = g["id"].combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(n[at]), ids.take(pa.array(label[at]))], ["id", "n", "root"])

    dealt = rows.repartition("task").sortWithinPartitions("task", "tile", "id")
    return dealt.mapInArrow(run, f"id {kind}, n long, root {kind}")


def near_embeddings(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """One row per row of ``table``: id, n_links, component_id, kept.

    A vector that is null, empty or zero, or holds a null, NaN or infinite component, links with
    nothing; so does one whose id is null (null component, kept).  Vectors of different dimension never
    link.  Repeated rows are linked copies; rows sharing an id are one node of the components.
    """
    modest_batches(table.sparkSession)
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.forall(v, lambda x: x == 0)
    rows = table.select(F.col(id_col).alias("id"), F.when(~bad, v).alias("vector"))
    rows = rows.select("id", "vector", F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b"))
    good = rows.where("vector IS NOT NULL AND size(vector) > 0 AND id IS NOT NULL")
    classes = stored(good.groupBy("a", "b").agg(F.min("id").alias("id"), F.count("*").alias("mult"), F.first("vector").alias("vector")).withColumn("dim", F.size("vector")), "vectors")
    exact = stored(link_counts(classes.select("id", "mult", "dim", "vector"), threshold, tile), "links")
    links = exact.groupBy("id").agg(F.sum("n").alias("n"))
    final = components(exact.select(F.col("id").alias("u"), F.col("root").alias("v")))
    of_class = classes.select("a", "b", "id", "mult").join(links, "id", "left").join(final, "id", "left")
    of_class = of_class.select("a", "b", F.coalesce("component", "id").alias("component_id"), (F.col("mult") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    marked = rows.select("id", *[F.when(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.col("id").isNotNull(), F.col(k)).alias(k) for k in "ab"])
    out = marked.join(of_class, ["a", "b"], "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), class AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM class
"""
