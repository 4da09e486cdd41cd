"""A vector index: an inverted file of centroids with exact re-ranking, and bulk inserts with automatic ids.

Centroids are fitted on a documented, bounded sample (the ``SAMPLE`` vectors of least hashed id) and
every vector is assigned to its nearest.  A row keeps its distance to the centroid, a cell the largest
one.  Vectors are scaled to length 1, so that a cosine is 1 - d*d / 2 of the distance d, and by the
triangle inequality no vector of a cell is nearer to a query than |query - centroid| - largest.

A search scores the ``probes`` nearest cells of each query.  The exact mode then also scores every cell
that this bound leaves possible for a better or equal hit, so its result is that of comparing all.
Cells and queries are dealt out in parts of bounded size: one task a part of a cell and of its queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.scratch import shared_folder, written
from siltstone.sources.tables import load

#: Vectors that the centroids are fitted on, centroids, and steps of the fit, at most.
SAMPLE, CELLS, STEPS = 20_000, 1024, 20
#: Rows of a cell and queries in one task, about.
PART, QUERIES_PART = 4096, 4096
#: Half a unit of the digits that scores have, and what rounding of distances may add.
SLACK = 0.5e-6 + 1e-9


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, unit) of rows with an id and a vector that is not empty, has finite entries and a length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    rows = table.where("vec_id IS NOT NULL AND size(embedding) > 0").select("vec_id", v.alias("v"), norm.alias("norm"))
    return rows.where((F.col("norm") > 0) & (F.col("norm") < float("inf"))).select("vec_id", F.transform("v", lambda x: x / F.col("norm")).alias("unit"))


def centroids_of(units: DataFrame, cells: int | None = None) -> np.ndarray:
    """k-means on the sample; by default about the square root of the vectors' number, ``CELLS`` at most."""
    n = units.count()
    k = cells or max(1, min(CELLS, round(n**0.5)))
    sample = units.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(SAMPLE).select(array_to_vector("unit").alias("features"))
    if not n:
        return np.zeros((0, 0))
    return np.array(KMeans(k=k, maxIter=STEPS, seed=7, initSteps=1).fit(sample).clusterCenters())


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]
    return np.sqrt(np.maximum(d, 0))


def matrix(b: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    column = b[name] if isinstance(b, pa.Table) else b.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(False).reshape(len(column), -1)


@dataclass
class VectorIndex:
    """Cells (cell, part, vec_id, unit, residual) below ``path`` and their summary, which is one row a part of a cell."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    kind: str

    @classmethod
    def build(cls, table: DataFrame, path: str, cells: int | None = None) -> VectorIndex:
        """All usable vectors of ``table``; they must have one dimension."""
        spark, units = table.sparkSession, written(usable(table), f"{path}/units")
        centres = centroids_of(units, cells)
        shared = spark.sparkContext.broadcast(centres)  # at most CELLS rows
        kind = dict(units.dtypes)["vec_id"]

        def nearest(batches):
            for b in batches:
                if b.num_rows:
                    d = distances(matrix(b, "unit"), shared.value)
                    cell = d.argmin(1)
                    yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("unit"), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "unit", "cell", "residual"])

        found = written(units.mapInArrow(nearest, f"vec_id {kind}, unit array<double>, cell int, residual double"), f"{path}/assigned")
        sizes = found.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))  # at most CELLS rows
        placed = found.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
        placed.repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.parquet(f"{path}/cells")
        return cls(spark, path, centres, kind)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(f"cell int, vec_id {self.kind}, unit array<double>, residual double, part int").parquet(f"{self.path}/cells")

    def summary(self) -> DataFrame:
        return self.rows().groupBy("cell").agg(F.max("residual").alias("largest"), F.count("*").alias("n"), (F.max("part") + 1).alias("parts"))

    def visits(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, unit, cell, away, near) for every query and cell that may matter: ``near`` for the nearest ``probes`` cells, and the most a cosine can be there."""
        centres, parts = self.spark.sparkContext.broadcast(self.centres), {r.cell: r for r in self.summary().collect()}  # at most CELLS rows
        largest = self.spark.sparkContext.broadcast(np.array([parts[c].largest if c in parts else -1.0 for c in range(len(self.centres))]))

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                d = distances(matrix(b, "unit"), centres.value)
                d[:, largest.value < 0] = np.inf  # empty cells
                rank = np.argsort(np.argsort(d, 1, kind="stable"), 1, kind="stable")
                gap = np.maximum(d - largest.value[None, :] - 1e-9, 0)
                q, c = np.nonzero(np.isfinite(d))
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(q)), pa.array(c.astype(np.int32)), pa.array((1 - gap * gap / 2)[q, c]), pa.array(rank[q, c] < probes)], ["query_id", "cell", "most", "near"])

        return queries.mapInArrow(run, f"query_id {self.kind}, cell int, most double, near boolean")

    def scored(self, visits: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score): the best ``k`` of each visited cell's parts for each query."""
        summary = F.broadcast(self.summary().select("cell", "parts"))
        per_cell = F.broadcast(visits.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES_PART).cast("int").alias("q_parts")))  # at most CELLS rows
        asked = visits.join(queries.select(F.col("vec_id").alias("query_id"), "unit"), "query_id").join(summary, "cell").join(per_cell, "cell")
        asked = asked.select("cell", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.pmod(F.xxhash64("query_id"), F.col("q_parts")).cast("int").alias("q_part"), "query_id", "unit")
        data = self.rows().join(per_cell, "cell").select("cell", "part", F.explode(F.expr("sequence(0, q_parts - 1)")).alias("q_part"), "vec_id", "unit")

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            out = [pa.array([], left.schema.field("query_id").type), pa.array([], left.schema.field("query_id").type), pa.array([], pa.float64())]
            if left.num_rows and right.num_rows:
                x, y = matrix(left, "unit"), matrix(right, "unit")
                asked, ids = left["query_id"].combine_chunks(), right["vec_id"].combine_chunks()
                sort = pc.sort_indices(ids)
                y, ids = y[sort.to_numpy()], ids.take(sort)
                q, v, s = [], [], []
                for i in range(0, len(x), 512):
                    score = np.round(x[i : i + 512] @ y.T, 6)
                    own = pc.index_in(asked.slice(i, 512), ids)  # a query is no hit of its own
                    at = np.flatnonzero(~own.is_null().to_numpy(False))
                    score[at, own.drop_null().to_numpy(False).astype(int)] = -2
                    first = np.argsort(-score, 1, kind="stable")[:, :k]
                    hit = np.take_along_axis(score, first, 1)
                    r, c = np.nonzero(hit > -2)
                    q.append(r + i), v.append(first[r, c]), s.append(hit[r, c])
                out = [asked.take(pa.array(np.concatenate(q))), ids.take(pa.array(np.concatenate(v))), pa.array(np.concatenate(s))]
            return pa.table(out, ["query_id", "vec_id", "score"])

        keys = ["cell", "part", "q_part"]
        renamed = data.select(*[F.col(c).alias(c) for c in keys], F.col("vec_id").alias("vec_id"), F.col("unit").alias("unit"))
        return asked.groupBy(keys).cogroup(renamed.groupBy(keys)).applyInArrow(best, f"query_id {self.kind}, vec_id {self.kind}, score double")

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """(query_id, vec_id, score, rank): the ``k`` vectors of highest cosine (six digits, then least id) of each query (vec_id, embedding).

        Unless ``exact``, only the nearest ``probes`` cells are looked at.  A query is no hit of its own id.
        """
        asked = written(usable(queries), shared_folder(self.spark, "queries"))
        visits = written(self.visits(asked, probes), shared_folder(self.spark, "visits"))
        hits = self.scored(visits.where("near"), asked, k)
        order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        if exact:
            hits = written(hits, shared_folder(self.spark, "hits"))
            kth = hits.withColumn("rank", order).where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
            more = visits.where("NOT near").join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("most") >= F.col("kth") - SLACK)).drop("kth")
            hits = hits.unionByName(self.scored(written(more, shared_folder(self.spark, "more-visits")), asked, k))
        return hits.withColumn("rank", order.cast("long")).where(F.col("rank") <= k)


@dataclass
class VectorTable:
    """A table (vec_id, embedding, label) in numbered versions below ``path``; the manifest's last row names the one that counts."""

    spark: SparkSession
    path: str
    dimension: int

    def version(self) -> int:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema("version int").parquet(f"{self.path}/manifest").agg(F.max("version")).first()[0] or 0
        except AnalysisException:
            return 0

    def read(self) -> DataFrame:
        schema, version = "vec_id long, embedding array<float>, label int", self.version()
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/rows/{v}" for v in range(1, version + 1)]) if version else self.spark.createDataFrame([], schema)

    def invalid(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch that may not be stored: a vector that is null, of another dimension, or with a null, NaN or infinite entry."""
        v = F.col("embedding")
        bad = v.isNull() | (F.size(v) != self.dimension) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return batch.where(F.coalesce(bad, F.lit(True)))

    def insert(self, batch: DataFrame) -> bool:
        """Add all rows of (embedding, label) under new ids, or none if one is invalid; whether they were added.

        Ids go on from the greatest one without gaps, in the order of the batch's partitions.  The batch
        is written first; each of its partitions is counted, and a running sum over these counts (a row a
        partition) gives the id that each begins with.  No row goes through one task.
        """
        staged = written(batch.select(F.col("embedding").cast("array<float>").alias("embedding"), F.col("label").cast("int").alias("label")), f"{self.path}/staged-{self.version() + 1}-{shared_folder(self.spark, 'x')[-8:]}")
        if not self.invalid(staged).isEmpty():
            return False
        greatest = self.read().agg(F.coalesce(F.max("vec_id"), F.lit(-1))).first()[0]
        placed = staged.withColumn("at", F.monotonically_increasing_id())  # the partition in the upper bits, the row in it in the lower 33
        placed = placed.select("*", F.shiftright("at", 33).alias("piece"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
        counts = placed.groupBy("piece").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = F.broadcast(counts.select("piece", before.alias("start")))
        version = self.version() + 1
        placed.join(starts, "piece").select((F.col("start") + F.col("row") + greatest + 1).alias("vec_id"), "embedding", "label").write.mode("overwrite").parquet(f"{self.path}/rows/{version}")
        self.spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return True


def asked_of(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id % 100 = 0")


def q_vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, from the index in exact mode."""
    v = load(spark, sf_dir, "embeddings")
    return VectorIndex.build(v, shared_folder(spark, "vector-index")).search(asked_of(v), 10, exact=True)


def q_vector_bulk_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of odd label are inserted at once, then a batch with one short vector (nothing changes), then those of even label."""
    v = load(spark, sf_dir, "embeddings")
    table = VectorTable(spark, shared_folder(spark, "vector-table"), 64)
    table.insert(v.where("label % 2 = 1"))
    table.insert(v.withColumn("embedding", F.when(F.col("vec_id") == 1, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))))
    table.insert(v.where("label % 2 = 0"))
    return table.read().groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("ids"), F.sum(F.round(F.col("embedding")[0].cast("double") * 10000).cast("long")).alias("first_sum")).crossJoin(F.broadcast(table.read().agg(F.min("vec_id").alias("least"), F.max("vec_id").alias("greatest"))))


QUERIES = {"vector_index": q_vector_index, "vector_bulk_insert": q_vector_bulk_insert}
ORACLE_SQL = {
    "vector_index": """WITH pairs AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
      FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10""",
    "vector_bulk_insert": """SELECT label, count(*) AS n, count(*) AS ids, CAST(sum(CAST(round(CAST(embedding[1] AS DOUBLE) * 10000) AS BIGINT)) AS BIGINT) AS first_sum,
      0::BIGINT AS least, (SELECT count(*) - 1 FROM embeddings) AS greatest FROM embeddings GROUP BY label""",
}
