"""The engine's tables: explicit schemas, loading, versions and single-row maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType

SCHEMAS = {
    "documents": StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())]),
    "embeddings": StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(FloatType())), StructField("label", IntegerType())]),
}


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores if it comes in fewer partitions than there are cores, as one small file does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; texts, which take time to read through, are spread over all cores."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name in ("documents", "pages") else table


def compatible(df: DataFrame, schema: StructType) -> bool:
    """Whether a stored table still has the columns a reader wants; if not, derived tables are rebuilt."""
    have = {f.name: f.dataType for f in df.schema.fields}
    return all(have.get(f.name) == f.dataType for f in schema.fields)


def file_extension() -> Column:
    extensions = F.array(*[F.lit(x) for x in ("txt", "md", "pdf", "docx", "xlsx", "png", "mp4", "mp3", "py", "stl", "zip", "dat")])
    return F.element_at(extensions, (F.pmod("doc_id", F.lit(12)) + 1).cast("int"))


def file_name() -> Column:
    return F.concat(F.lit("doc_"), F.col("doc_id"), F.lit("."), file_extension())


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file table: each document is a text file whose extension follows its id."""
    d = load(spark, sf_dir, "documents")
    ext, name = file_extension(), file_name()
    return d.select("doc_id", name.alias("filename"), ext.alias("extension"), F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), name).alias("path"), F.col("n_chars").alias("size_bytes"), "text")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows replace those of equal key; the others stay."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def valid_dimension(vector: str | Column, dimension: int) -> Column:
    return F.size(vector) == dimension
