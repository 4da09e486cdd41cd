"""Folders of files as a table of records: filters that skip whole files, a parser a file type, errors as rows.

Files are planned and read by Spark's binaryFile source, in any store Spark reaches.  Filters on size and
time and the name pattern of the wanted types are pushed to it, so a skipped file is listed but never
opened.  Parsers are one table function that a lateral join calls for each file, in Arrow batches of a few
MB, so a task holds few files at a time; what a parser can't read becomes a row with an error in place of
a record, never a lost one.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable, Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from siltstone.functions import text as T
from siltstone.sources.scratch import shared_folder, small_batches
from siltstone.sources.tables import load

RECORD = "number: long, key: string, text: string, error: string"
#: Records of a landed file: a file is read as a whole.
FILE_RECORDS = 1_000


def _decoded(content: bytes) -> str:
    return content.decode("utf-8-sig")


def _lines(text: str, ends: str) -> Iterator[str]:
    """Lines with what ends them, one at a time; ``ends`` is a pattern."""
    at = 0
    for m in re.finditer(ends, text):
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def lines_of_json(content: bytes) -> Iterator[tuple]:
    """A record a line: an object's "key" and "text" (JSON, unless it is a string or null), or any other value as text."""
    for n, line in enumerate(_lines(_decoded(content), "\n")):
        line = line.removesuffix("\n")
        if line.strip():
            try:
                value = json.loads(line)
            except ValueError as e:
                yield n, None, None, f"JSON: {e}"
                continue
            if isinstance(value, dict) and "text" in value:
                text = value["text"]
                yield n, str(value["key"]) if value.get("key") is not None else None, text if text is None or isinstance(text, str) else json.dumps(text, ensure_ascii=False), None
            else:
                yield n, None, line, None


def rows_of_csv(content: bytes) -> Iterator[tuple]:
    """A record a row of two cells, key and text."""
    csv.field_size_limit(1 << 30)
    for n, row in enumerate(csv.reader(filter(None, _lines(_decoded(content), "\r\n|\n|\r")))):
        yield (n, row[0], row[1], None) if len(row) == 2 else (n, None, None, f"CSV: {len(row)} cells")


def whole_text(content: bytes) -> Iterator[tuple]:
    yield 0, None, _decoded(content), None


def sections(content: bytes) -> Iterator[tuple]:
    """A record a Markdown heading and what follows it; text before the first heading has no key."""
    key, held, n = None, [], 0
    for line in _lines(_decoded(content), "\n"):
        line = line.removesuffix("\n")
        if line.startswith("#") and line.lstrip("#")[:1] == " ":
            if held or key is not None:
                yield n, key, "\n".join(held), None
                n += 1
            key, held = line.lstrip("#").strip(), []
        else:
            held.append(line)
    yield n, key, "\n".join(held), None


#: By extension, without the dot and in lower case.
PARSERS: dict[str, Callable[[bytes], Iterator[tuple]]] = {"json": lines_of_json, "jsonl": lines_of_json, "csv": rows_of_csv, "md": sections, "markdown": sections, "txt": whole_text, "log": whole_text}


def _whole(text: str | None) -> str | None:
    """JSON can escape half a character, which UTF-8 can't hold."""
    return text and text.encode("utf-8", "replace").decode()


@udtf(returnType=RECORD, useArrow=True)
class ParseFile:
    """The records of a file, by its extension; a file that can't be read, or has no parser, is one row with an error."""

    def eval(self, extension: str, content: bytes) -> Iterator[tuple]:
        parser = PARSERS.get(extension)
        if parser is None:
            yield 0, None, None, f"no parser for {extension}"
            return
        try:
            for number, key, text, error in parser(content):
                yield number, _whole(key), _whole(text), _whole(error)
        except (UnicodeDecodeError, csv.Error) as e:
            yield 0, None, None, f"{type(e).__name__}: {e}"


def files(spark: SparkSession, folder: str, extensions: list[str] | None = None, most_bytes: int | None = None, modified_from: datetime | None = None, contents: bool = True) -> DataFrame:
    """(path, extension, size_bytes, modified_at, content) of the wanted files below a folder, without those in blacklisted places."""
    source = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if extensions is not None:
        source = source.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    rows = source.load(folder)
    if most_bytes is not None:
        rows = rows.where(F.col("length") <= most_bytes)
    if modified_from is not None:
        rows = rows.where(F.col("modificationTime") >= F.lit(modified_from))
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    columns = ["path", extension.alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")]
    return rows.select(*columns, *(["content"] if contents else [])).where(T.path_filter(F.col("path"), [], T.BLACKLIST) == "Include")


def parsed(found: DataFrame) -> DataFrame:
    """(path, number, key, text, error) of files (path, extension, content): one lateral call a file."""
    small_batches(found.sparkSession)
    return found.lateralJoin(ParseFile(F.col("extension").outer(), F.col("content").outer())).select("path", "number", "key", "text", "error")


def records(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (path, number, key, text), and errors (path, number, error)."""
    rows = parsed(found)
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("path", "number", "error")


def land_documents(docs: DataFrame, folder: str) -> None:
    """Documents as files of at most ``FILE_RECORDS``: English ones as JSON lines, German ones as CSV, all others as pages of an unknown type."""
    keyed = docs.select(F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    keyed.where("lang = 'en'").select("key", "text").write.option("maxRecordsPerFile", FILE_RECORDS).json(f"{folder}/en")
    keyed.where("lang = 'de'").select("key", "text").write.option("maxRecordsPerFile", FILE_RECORDS).option("quoteAll", "true").option("escape", '"').option("lineSep", "\n").csv(f"{folder}/de")
    keyed.where("lang NOT IN ('en', 'de') OR lang IS NULL").write.option("maxRecordsPerFile", FILE_RECORDS).parquet(f"{folder}/other")


def q_folder_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all files of a folder: length and digest of each text; files of other types are errors."""
    folder = shared_folder(spark, "folder")
    land_documents(load(spark, sf_dir, "documents"), folder)
    good, _ = records(files(spark, folder, ["json", "csv"]))
    return good.select(F.col("key").cast("long").alias("doc_id"), F.char_length("text").cast("long").alias("n"), F.md5("text").alias("text_md5"))


def q_folder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By folder: whether files were taken, skipped by a filter, or had no parser."""
    folder = shared_folder(spark, "folder")
    land_documents(load(spark, sf_dir, "documents"), folder)
    every = files(spark, folder, contents=False).where("extension IN ('json', 'csv', 'parquet')")
    taken = files(spark, folder, ["json", "parquet"])
    bad = records(taken)[1].select("path").distinct().withColumn("bad", F.lit(True))
    marked = every.join(taken.select("path", F.lit(True).alias("taken")), "path", "left").join(bad, "path", "left")
    status = F.when(F.col("taken").isNull(), "skipped").when(F.col("bad"), "error").otherwise("taken")
    return marked.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("lang"), status.alias("status")).distinct()


QUERIES = {"folder_records": q_folder_records, "folder_counts": q_folder_counts}
ORACLE_SQL = {
    "folder_records": "SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n, md5(coalesce(text, '')) AS text_md5 FROM documents WHERE lang IN ('en', 'de')",
    "folder_counts": "SELECT DISTINCT CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'other' END AS lang, CASE lang WHEN 'en' THEN 'taken' WHEN 'de' THEN 'skipped' ELSE 'error' END AS status FROM documents",
}
