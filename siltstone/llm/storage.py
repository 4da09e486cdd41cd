"""Shared scratch tables: what one job leaves for the next, in the folder all executors see."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


#: Bytes of one Arrow batch.  Long texts would fill Spark's default of 10,000 rows (or 256 MB) many times over.
BATCH_BYTES = 4 << 20


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` in this session; every operator of the subpackage asks for them."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir.

    Where that is unset a temporary folder stands in on a local master (tests); on a cluster executors
    could not read it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="siltstone-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet to shared scratch and read it back: cut lineage that survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    modest_batches(spark)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, codec: str = "zstd") -> DataFrame:
    """As ``stored``, in buckets by ``column``, as many as a shuffle has partitions: grouping by it later needs no exchange.

    Buckets need a table; its name, new each time, stays in the session's catalog like its files in scratch.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    modest_batches(spark)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").option("compression", codec).option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).saveAsTable(table)
    return spark.table(table)
