"""Splitting documents into located chunks, and event streams folded per key (grouped Python where order decides)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.ordered import Ordered
from siltstone.sources.tables import load

# Sentence ends, tried in this order.
SENTENCE_ENDS = (". ", "。", "! ", "? ", "！", "？")


def break_point(piece: str, least: int = 100) -> int:
    """Where to end a full chunk: after the last blank line, sentence end or line end that leaves ``least`` characters."""
    for mark in ("\n\n", *SENTENCE_ENDS, "\n"):
        at = piece.rfind(mark)
        if at >= 0 and at + len(mark) >= least:
            return at + len(mark)
    return len(piece)


def chunk_spans(text: str, most: int = 1000, least: int = 100, overlap: int = 100) -> list[tuple[int, int]]:
    """(start, end) in characters; neighbours overlap, and every chunk starts after the one before."""
    if len(text) <= most:
        return [(0, len(text))] if text else []
    out, start = [], 0
    while start < len(text):
        end = min(start + most, len(text))
        if end < len(text):
            end = start + break_point(text[start:end], least)
        out.append((start, end))
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def chunk_documents(docs: DataFrame, most: int = 1000, least: int = 100, overlap: int = 100) -> DataFrame:
    """(doc_id, chunk_index, start, end, start_line, content): a narrow map over the documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                if text:
                    for i, (s, e) in enumerate(chunk_spans(text, most, least, overlap)):
                        rows.append((doc_id, i, s, e, text.count("\n", 0, s) + 1, text[s:e]))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "start", "end", "start_line", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, chunk_index long, start long, end long, start_line long, content string")


def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(load(spark, sf_dir, "documents"))


def q_chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the characters that its chunks cover (union of spans) and their overlap ratio."""
    c = chunk_documents(load(spark, sf_dir, "documents")).select("doc_id", "start", "end")
    spans = F.sort_array(F.collect_list(F.struct("start", "end")))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["at"], x["start"]))).cast("long").alias("n"), F.greatest(a["at"], x["end"]).alias("at"))
    g = c.groupBy("doc_id").agg(spans.alias("s"), F.sum(F.col("end") - F.col("start")).alias("total"))
    g = g.withColumn("covered", F.aggregate("s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("at")), step, lambda a: a["n"]))
    return g.select("doc_id", "covered", F.round(1 - F.col("covered") / F.col("total"), 6).alias("overlap_ratio"))


def q_paragraph_of_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that holds the first hit of a term in each text: offsets by running sums inside the row, no range join."""
    d = load(spark, sf_dir, "documents").withColumn("hit", F.instr("text", "thtion") - 1).where("hit >= 0")
    before = F.substring("text", F.lit(1), F.col("hit").cast("int"))
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return d.select("doc_id", F.col("hit").cast("long").alias("hit"), line.cast("long").alias("line"))


_UNIT = re.compile(r"(?:(?:pub|public|private|protected|static|async|export|default|abstract|final|unsafe)(?:\([a-z]+\))?\s+)*(?P<kind>fn|function|func|def|class|struct|enum|trait|impl|interface|module|namespace)\b\s*(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)?")


def code_units(text: str, indented: bool) -> list[tuple[int, int, str, str]]:
    """(first line, last line, kind, name) of the outermost definitions of a source text.

    A unit opens on a line that begins with a definition keyword; it closes where its braces balance, or
    with ``indented`` before the next line that is not indented.  A text without any is one unit.
    """
    rows = text.split("\n")
    out: list[tuple[int, int, str, str]] = []
    at = 0
    while at < len(rows):
        m = _UNIT.match(rows[at].lstrip() if not indented else rows[at])
        if not m:
            at += 1
            continue
        end = at
        if indented:
            while end + 1 < len(rows) and (not rows[end + 1].strip() or rows[end + 1][0] in " \t"):
                end += 1
            while not rows[end].strip():
                end -= 1
        else:
            depth, opened = 0, False
            for end in range(at, len(rows)):
                depth += rows[end].count("{") - rows[end].count("}")
                opened |= "{" in rows[end]
                if depth <= 0 and (opened or rows[end].rstrip().endswith(";")):
                    break
        out.append((at + 1, end + 1, m["kind"], m["name"] or ""))
        at = end + 1
    return out or ([(1, len(rows), "text", "")] if text.strip() else [])


def page_chunks(docs: DataFrame, most: int = 1000) -> DataFrame:
    """(doc_id, page, chunk_index, content): pages end at form feeds; a text without any has one for every 3,000 characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                pages = (text or "").split("\f")
                i = 0
                for number, page in enumerate(pages, 1):
                    for s, e in chunk_spans(page, most):
                        rows.append((doc_id, number if len(pages) > 1 else s // 3000 + 1, i, page[s:e]))
                        i += 1
            yield pd.DataFrame(rows, columns=["doc_id", "page", "chunk_index", "content"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, page long, chunk_index long, content string")


def q_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_chunks(load(spark, sf_dir, "documents"))


def windows_from_first(events: DataFrame, key: list[str], seconds: float) -> DataFrame:
    """(event_id, position) of each event in its window: a window starts at the first event of its key that comes
    ``seconds`` or more after the start of the window before.

    Where a window starts depends on those before, so events are folded in order.  An event ``seconds`` or
    more after the event before it starts one for certain, so each key is cut there and the stretches are folded
    apart, row by row; a task keeps one timestamp and a count.  Events without a time go.
    """
    limit = round(seconds * 1_000_000)
    rows = events.where("ts IS NOT NULL").select(*key, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    cut = F.col("before").isNull() | (F.col("us") - F.col("before") >= limit)
    seen = Ordered(rows, key, ["us", "event_id"]).last_known("before", F.col("us"), inclusive=False).running_sum("stretch", cut.cast("long"))
    rows = seen.result().withColumn("cut", cut)
    rows = rows.repartition(*key, "stretch").sortWithinPartitions(*key, "stretch", "us", "event_id").select("event_id", "us", "cut")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = n = 0
        for b in batches:
            position = []
            for t, cut in zip(b.column("us").to_pylist(), b.column("cut").to_pylist()):
                if cut or t - start >= limit:
                    start, n = t, 0
                n += 1
                position.append(n)
            yield pa.RecordBatch.from_arrays([b.column("event_id"), pa.array(position, pa.int64())], ["event_id", "position"])

    return rows.mapInArrow(fold, f"event_id {dict(events.dtypes)['event_id']}, position long")


def debounce(events: DataFrame, seconds: float) -> DataFrame:
    """Event ids that stay: one less than ``seconds`` after the last kept event of its user and type goes."""
    return windows_from_first(events, ["user_id", "event_type"], seconds).where("position = 1").select("event_id")


def q_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debounce(load(spark, sf_dir, "events"), 6 * 3600)


def q_rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two requests of a user are allowed in each window of twelve hours; a window starts at the first request after the one before ended."""
    return windows_from_first(load(spark, sf_dir, "events"), ["user_id"], 12 * 3600).select("event_id", (F.col("position") <= 2).alias("allowed"))


QUERIES = {"rate_limited": q_rate_limited, "chunks": q_chunks, "page_chunks": q_page_chunks, "chunk_coverage": q_chunk_coverage, "paragraph_of_hit": q_paragraph_of_hit, "debounce": q_debounce}
ORACLE_SQL = {
    "rate_limited": """WITH RECURSIVE w AS (SELECT user_id, min(ts) AS start FROM events GROUP BY 1
      UNION ALL SELECT w.user_id, min(e.ts) FROM w JOIN events e ON e.user_id = w.user_id AND e.ts >= w.start + INTERVAL 12 HOUR GROUP BY w.user_id, w.start),
    p AS (SELECT e.event_id, row_number() OVER (PARTITION BY e.user_id, w.start ORDER BY e.ts, e.event_id) AS r FROM events e JOIN w ON w.user_id = e.user_id AND e.ts >= w.start AND e.ts < w.start + INTERVAL 12 HOUR)
    SELECT event_id, r <= 2 AS allowed FROM p""",
    "debounce": """WITH RECURSIVE w AS (SELECT user_id, event_type, min(ts) AS start FROM events GROUP BY ALL
      UNION ALL SELECT w.user_id, w.event_type, min(e.ts) FROM w JOIN events e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.event_type = w.event_type AND e.ts >= w.start + INTERVAL 6 HOUR GROUP BY w.user_id, w.event_type, w.start)
    SELECT min(event_id) AS event_id FROM w JOIN events e ON e.user_id IS NOT DISTINCT FROM w.user_id AND e.event_type = w.event_type AND e.ts = w.start GROUP BY w.user_id, w.event_type, w.start""",
    "paragraph_of_hit": "SELECT doc_id, hit - 1 AS hit, CAST(length(substring(text, 1, hit - 1)) - length(replace(substring(text, 1, hit - 1), chr(10), '')) AS BIGINT) AS line FROM (SELECT *, instr(text, 'thtion') AS hit FROM documents) WHERE hit > 0",
}
