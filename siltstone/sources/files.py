"""Files on storage as tables: listing, whole texts by extension, JSON checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T

# Folders and extensions.
SKIPPED_FOLDERS = ["node_modules", "target", "__pycache__", ".git", "vendor", "dist"]
TEXT_EXTENSIONS = ["txt", "md", "markdown", "rst", "rtf", "json", "yaml", "yml", "toml", "xml", "csv", "log", "ini", "cfg", "conf"]


def list_files(spark: SparkSession, folder: str, blacklist: list[str] | None = None) -> DataFrame:
    """(path, filename, extension, file_type, size_bytes, modified_at) below a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    f = f.select("path", name.alias("filename"), ext.alias("extension"), T.file_type(ext).alias("file_type"), "size_bytes", "modified_at")
    return f.where(T.path_filter(F.col("path"), [], T.BLACKLIST if blacklist is None else blacklist) == "Include")


def count_files(spark: SparkSession, folder: str) -> int:
    """Files that are in no skipped or hidden folder."""
    skip = "|".join(x.replace(".", "\\.") for x in SKIPPED_FOLDERS)
    return list_files(spark, folder, []).where(~F.col("path").rlike(rf"/({skip})/|/\.[^/]+")).count()


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, text) of the text files; a JSON file that does not parse is left out, as are bytes that are no UTF-8."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    t = b.where(ext.isin(TEXT_EXTENSIONS)).select("path", F.when(ext == "json", "json").when(ext.isin("md", "markdown"), "markdown").otherwise("plain").alias("kind"), F.try_validate_utf8(F.col("content").cast("string")).alias("text"))
    return t.where(F.col("text").isNotNull() & ((F.col("kind") != "json") | F.try_parse_json("text").isNotNull()))
