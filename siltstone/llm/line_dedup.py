"""Operator 6: substring dedup by hashing lines and the sentences in them.

Units are lines, cut further after sentence ends, so that a passage inside a line is found too.  A
unit is normalised (words without regard to case, white space is one space) and hashed to 128 bits;
of each digest the earliest occurrence by (id, unit) stays and every later one is marked.  A unit of
fewer than ``min_words`` words and ``MIN_CHARS`` characters is short: where such units stand
side by side and are longer than that together, each is hashed with the units after it, and with those
before it, up to one of these lengths, and marked with them, not alone.  What goes are unbroken stretches of marked units, lines and sentences alike, of at least ``min_run`` words or ``min_run`` * ``RUN_CHARS`` characters: a repeated line,
paragraph or passage of that length goes whole, however short its sentences are, while a short line
or sentence that texts merely have in common stays where it is.

Only digests are shuffled to count repeats, after partial counts, so that a common unit is one row
there.  Positions of repeated units are looked up in that table, and a unit which is one of the
``1000`` most common at most is joined by broadcast, not by its key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from siltstone.sources.tables import load

from .kernel import Slab, inverses, mix, powers, slabs
from .skew import join_counted
from .storage import modest_batches, stored

MIN_WORDS = 5
MIN_CHARS = 20
MIN_RUN = 30
#: Characters that count as much as a word of a stretch, for texts without spaces.
RUN_CHARS = 5
SPANS = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))

_U = np.uint64
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_STOP, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_STOP[list(b".!?")] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters, byte by byte."""
    low = _LOW[buf]
    accent = np.zeros(len(buf), bool)
    accent[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
    low[accent] += 32
    return low


def units(s: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of each unit, the word after its last, and its text.

    A unit ends with its line, and after a word that ends in one of .!? with at most three other
    ASCII punctuation marks behind it.
    """
    start, end, doc = s.word_start, s.word_end, s.word_doc
    n = len(start)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    stops, marks = np.zeros(n, bool), np.ones(n, bool)
    for k in range(4):
        at = end - 1 - k
        inside = at >= start
        b = s.buf[np.maximum(at, 0)]
        stops |= marks & inside & _STOP[b]
        marks &= inside & _MARK[b]
    feeds = np.concatenate([[0], np.cumsum(s.buf == 10)])
    first = np.ones(n, bool)
    first[1:] = (doc[1:] != doc[:-1]) | stops[:-1] | (feeds[start[1:]] != feeds[end[:-1]])
    a = np.flatnonzero(first)
    return a, np.append(a[1:], n), doc[a]


def sizes(s: Slab, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code points of the words of each unit, without white space."""
    solid = np.concatenate([[0], np.cumsum(((s.buf & 0xC0) != 0x80) & ~s.space)])
    return solid[s.word_end[b - 1]] - solid[s.word_start[a]]


def runs(chars: np.ndarray, words: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last unit of every run to compare.

    A unit that is long enough is a run, and so is a short one among few: where short units side by side
    are long enough together, from each of them the shortest run inside its text that is long enough
    goes onward instead, and one goes back.
    """
    n = len(chars)
    if not n:
        return (np.zeros(0, np.int64),) * 2
    totals = [(np.concatenate([[0], np.cumsum(x)]), least) for x, least in ((chars, MIN_CHARS), (words, min_words))]
    at = np.arange(n)
    long = (words >= min_words) | (chars >= MIN_CHARS)
    opens = long | np.concatenate([[True], long[:-1] | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(opens)
    end = np.append(first[1:], n)
    enough = np.zeros(len(first), bool)
    for t, least in totals:
        enough |= t[end] - t[first] >= least
    alone = long | ~np.repeat(enough, end - first)
    short = at[~alone]
    last = np.minimum(*[np.searchsorted(t, t[short] + least) for t, least in totals]) - 1
    onward = (last < n) & (doc[np.minimum(last, n - 1)] == doc[short])
    begin = np.maximum(*[np.searchsorted(t, t[short + 1] - least, "right") for t, least in totals]) - 1
    back = (begin >= 0) & (doc[np.maximum(begin, 0)] == doc[short])
    a = np.concatenate([at[alone], short[onward], begin[back]])
    z = np.concatenate([at[alone], last[onward], short[back]])
    pairs = np.unique(a * n + z)
    return pairs // n, pairs % n


def digests(s: Slab, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of the lower-cased words of each unit."""
    h = Slab(lowered(s.buf), s.off, s.first).word_hash
    up, down = powers(len(h)), inverses(a)
    out = []
    for salt in (0, 77):
        p = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ _U(salt)) * up, out=p[1:])
        out.append(mix((p[b] - p[a]) * down + (b - a).astype(np.uint64)).view(np.int64))
    return out


def repeated_units(docs: DataFrame, id_col: str, text_col: str, min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """(id, key, units): first and last number of the marked runs of units; ``key`` hashes the text.

    Documents whose marked runs are too short together for any stretch to go are left out.
    """
    kind = dict(docs.dtypes)[id_col]
    base = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slabs(batch.column("text")):
                a, b, doc = units(s)
                number = np.arange(len(a)) - np.searchsorted(doc, np.arange(s.n))[doc]
                chars = sizes(s, a, b)
                i, j = runs(chars, b - a, doc, min_words)
                x, y = digests(s, a[i], b[j])
                upto = np.concatenate([[0], np.cumsum(np.maximum(b - a, -(-chars // RUN_CHARS)))])
                row = pa.array(doc[i] + s.first)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(row), batch.column("key").take(row), pa.array(number[i].astype(np.int32)), pa.array(number[j].astype(np.int32)), pa.array((upto[j + 1] - upto[i]).astype(np.int32)), pa.array(x), pa.array(y)], ["id", "key", "unit", "last", "size", "a", "b"])

    found = stored(base.mapInArrow(run, f"id {kind}, key long, unit int, last int, size int, a long, b long"), "units")
    common = stored(found.groupBy("a", "b").agg(F.count("*").alias("copies")).where("copies > 1"), "repeated")
    again = stored(join_counted(found, common, ["a", "b"], "copies"), "again")
    place = F.struct("id", "key", "unit")
    first = stored(again.groupBy("a", "b").agg(F.min(place).alias("first"), F.first("copies").alias("n")), "first")
    later = join_counted(again, first, ["a", "b"], "n").where(place > F.col("first"))
    of_doc = later.groupBy("id", "key").agg(F.sum("size").alias("size"), F.sort_array(F.collect_set(F.struct("unit", "last"))).alias("units"))
    return of_doc.where(F.col("size") >= min_run).drop("size")


def stretches(drop: np.ndarray, words: np.ndarray, chars: np.ndarray, min_run: int) -> np.ndarray:
    """``drop`` without the unbroken stretches that are too short to go."""
    edge = np.diff(np.concatenate([[0], drop.astype(np.int8), [0]]))
    out = drop.copy()
    for i, j in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        out[i:j] = words[i:j].sum() >= min_run or chars[i:j].sum() >= min_run * RUN_CHARS
    return out


def cut(text: str, gone: list[dict], min_run: int) -> tuple[str, list[dict]]:
    """The text without these runs of units, and where they stood (code points of the old text).

    Neighbours that stay keep the white space between them; where units between two went, a line feed
    stays if there was one, else a space.
    """
    (s,) = slabs(pa.array([text]), 1 << 62)
    a, b, _ = units(s)
    drop, size = np.zeros(len(a), bool), sizes(s, a, b)
    for r in gone:
        drop[r["unit"] : r["last"] + 1] = True
    drop = stretches(drop, b - a, size, min_run)
    if not drop.any():
        return text, []
    chars = np.concatenate([[0], np.cumsum((s.buf & 0xC0) != 0x80)])
    begin, end = chars[s.word_start[a]].tolist(), chars[s.word_end[b - 1]].tolist()
    kept = np.flatnonzero(~drop).tolist()
    out = []
    for k, i in enumerate(kept):
        if k == 0:
            out.append(text[: begin[0]] if i == 0 else "")
        else:
            gap = text[end[kept[k - 1]] : begin[i]]
            out.append(gap if kept[k - 1] == i - 1 else "\n" if "\n" in gap else " ")
        out.append(text[begin[i] : end[i]])
    if kept and kept[-1] == len(a) - 1:
        out.append(text[end[-1] :])
    return "".join(out), [{"start": begin[i], "end": end[i]} for i in np.flatnonzero(drop).tolist()]


def remove_units(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, min_run: int = MIN_RUN) -> DataFrame:
    """``docs`` without those units, plus ``removed``: their (start, end).

    Columns of ``docs`` travel as one struct, so none of their names can meet those used here.
    """
    schema, names, at = docs.schema, docs.columns, docs.columns.index(text_col)
    whole = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"))
    marked = whole.join(found, ["id", "key"], "left").select(*[F.col("row")[n].alias(n) for n in names], F.col("units").alias("units of this row"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols, lists = list(b.columns[: len(names)]), b.column(len(names)).to_pylist()
            spans: list[list[dict]] = [[] for _ in lists]
            if any(lists):
                texts = cols[at].to_pylist()
                for i, gone in enumerate(lists):
                    if gone:
                        texts[i], spans[i] = cut(texts[i], gone, min_run)
                cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind)], [*names, "removed"])

    return marked.mapInArrow(run, StructType([*schema.fields, StructField("removed", SPANS)]))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_run: int = MIN_RUN) -> DataFrame:
    """Every row of ``docs`` with repeats cut from its text, and the column ``removed``.

    Ranks are (id, unit number), so ids should be unique; rows with one id are ranked by a hash of
    their texts, and rows equal in id and text are one document and get the same result.  A row with a
    null id or text is neither compared nor changed; empty texts stay; a document may lose all its
    units and then has an empty text; an empty table gives an empty one.  Other columns pass through,
    whatever their names (an old ``removed`` is replaced).
    """
    modest_batches(docs.sparkSession)
    docs = docs.drop("removed")
    found = stored(repeated_units(docs, id_col, text_col, min_words, min_run), "found")
    return remove_units(docs, found, id_col, text_col, min_run)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.concat_ws(" ", F.transform("removed", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))))
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed_spans"))
