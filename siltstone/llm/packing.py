"""Operator 5: packing documents into fixed-length sequences by fitted length patterns.

Only lengths decide how documents share sequences, and there are at most ``size`` of them.  So the
driver works on the histogram of piece lengths: it enumerates every pattern of one, two or three
lengths that fills a sequence exactly, fits how often each pattern repeats by non-negative least
squares, rounds, and packs the histogram's rest best fit first.  The result is a plan: for each
length, which ranks go to which run of sequences at which offset.  Pieces then find their place from
their rank within their length, which Spark computes in salted windows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import load

from .storage import modest_batches, stored
from .tokens import encoder, with_end

#: Tasks of a length at least, and pieces of one at most.
SALTS, SALT_ROWS = 64, 1_000_000


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All multisets of one to three of the lengths that sum to ``size``; rows padded with 0."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    rows = [np.array([[size, 0, 0]])[have[[size]]]]
    a = lengths[lengths * 2 <= size]
    a = a[have[size - a]]
    rows.append(np.stack([a, size - a, 0 * a], 1))
    for x in lengths[lengths * 3 <= size]:
        b = lengths[(lengths >= x) & (lengths * 2 <= size - x)]
        b = b[have[size - x - b]]
        rows.append(np.stack([np.full_like(b, x), b, size - x - b], 1))
    return np.concatenate(rows).astype(np.int64).reshape(-1, 3)


def fit_repeats(p: np.ndarray, histogram: np.ndarray, steps: int = 200) -> np.ndarray:
    """Non-negative least squares: repeats x of the patterns whose lengths come closest to the histogram.

    Accelerated projected gradient with the separable bound A'A1 as step sizes (A has no negative
    entry); A is never built, a pattern is its three lengths.
    """
    if not len(p):
        return np.zeros(0)
    n = len(histogram)
    total = max(histogram.sum(), 1)
    h = histogram / total
    use = (p > 0).astype(float)
    ax = lambda x: np.bincount(p.ravel(), (x[:, None] * use).ravel(), n)
    at = lambda r: (r[p] * use).sum(1)
    bound = at(ax(np.ones(len(p))))
    x = at(h) / bound
    y, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0, y - at(ax(y) - h) / bound)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * total


def round_repeats(p: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole repeats that the histogram can serve, and the histogram's rest.

    Repeats are rounded along the patterns' order, so that what one loses its neighbours get; a
    pattern then takes no more than is left of its lengths.
    """
    c = np.floor(np.cumsum(x) + 0.5)
    want = np.diff(c, prepend=0.0).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    took = np.zeros(len(p), np.int64)
    for i in np.flatnonzero(want):
        lengths, each = np.unique(p[i][p[i] > 0], return_counts=True)
        took[i] = max(0, min(want[i], int((left[lengths] // each).min())))
        left[lengths] -= each * took[i]
    return took, left


def best_fit(histogram: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, over counts: (lengths of a sequence, how many such sequences)."""
    room: dict[int, list] = defaultdict(list)  # free tokens: runs of equal sequences
    left = histogram.copy()
    free = np.zeros(size + 1, bool)
    for length in np.flatnonzero(left)[::-1]:
        length, k = int(length), int(left[length])
        while k:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                c = int(fits[0]) + length
                content, n = room[c].pop()
            else:
                c, content, n = size, (), -(-k // (size // length))
            m = min(k, n)
            if n > m:
                room[c].append((content, n - m))
            free[c] = bool(room[c]) and c < size
            room[c - length].append(((*content, length), m))
            free[c - length] = True
            k -= m
    return [run for runs in room.values() for run in runs]


@dataclass(frozen=True)
class Plan:
    """Entries sorted by (length, lo): ranks lo.. of a length go to sequences first.. at ``offset``."""

    length: np.ndarray
    lo: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pos = np.searchsorted(self.length << 44 | self.lo, length.astype(np.int64) << 44 | rank, "right") - 1
        return self.first[pos] + rank - self.lo[pos], self.offset[pos]


def plan(histogram: np.ndarray, size: int) -> Plan:
    """``histogram[l]``: pieces of l tokens, for l from 0 to ``size``."""
    histogram = histogram.astype(np.int64)
    p = patterns(np.flatnonzero(histogram), size)
    took, rest = round_repeats(p, fit_repeats(p, histogram), histogram)
    runs = [(tuple(int(v) for v in p[i] if v), int(took[i])) for i in np.flatnonzero(took)] + best_fit(rest, size)
    entries, at, next_rank = [], 0, np.zeros(size + 1, np.int64)
    for lengths, n in runs:
        offset = 0
        for v in lengths:
            entries.append((v, next_rank[v], at, offset))
            next_rank[v] += n
            offset += v
        at += n
    e = np.array(sorted(entries), np.int64).reshape(-1, 4)
    return Plan(e[:, 0], e[:, 1], e[:, 2], e[:, 3], at)


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int, size: int) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32.  Only the first piece of a long document is shorter."""
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for b in batches:
            for first, ids, n in enc.encode_column(b.column("text")):
                ids, n = with_end(ids, n, end_id)
                ids = ids.astype("<u4")
                count = -(-n // size)
                row = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(row)) - (np.cumsum(count) - count)[row]
                # only the first piece may be shorter
                start = np.maximum(0, n[row] - (count[row] - piece) * size)
                length = n[row] - (count[row] - piece - 1) * size - start
                at = (np.cumsum(n) - n)[row] + start
                crc = [zlib.crc32(ids[x : x + y]) for x, y in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row + first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return base.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, size: int = 2048) -> DataFrame:
    """One row per piece with sequence_id and offset.

    A null or empty text is the end id alone.  Rows with null or equal ids are documents of their
    own, repeated rows are packed each; an empty table gives an empty result; other columns are not
    read.  Which of several equal-length pieces goes where follows a hash of id and piece.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    table = stored(pieces(docs, tokenizer, id_col, text_col, end_id, size), "pieces")
    found = table.groupBy("length").agg(F.count("*").alias("n")).toPandas()  # at most size rows
    histogram = np.zeros(size + 1, np.int64)
    histogram[found["length"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    salts = np.maximum(SALTS, -(-histogram // SALT_ROWS))
    often = np.flatnonzero(salts > SALTS).tolist()
    many = F.lit(SALTS)
    if often:
        many = F.coalesce(F.create_map(*[F.lit(x) for k in often for x in (k, int(salts[k]))])[F.col("length").cast("int")], many)
    salted = table.withColumn("salt", F.pmod(F.xxhash64(F.col("id").cast("string"), "piece", "ids_crc32"), many).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).toPandas()  # a row a cell: at most SALTS a length, or one for SALT_ROWS pieces
    base = np.cumsum(salts) - salts  # first cell of each length
    cell = np.zeros(int(salts.sum()), np.int64)
    cell[base[counts["length"].to_numpy(np.int64)] + counts["salt"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    ahead = np.cumsum(cell) - cell
    ahead -= np.repeat(ahead[base], salts)
    shared = spark.sparkContext.broadcast((plan(histogram, size), base, ahead))  # bounded by the patterns and cells
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(F.xxhash64(F.col("id").cast("string")), "id", "piece", "ids_crc32")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, base, ahead = shared.value
        for b in batches:
            if b.num_rows:
                length, salt, rank = (b.column(k).to_numpy() for k in ("length", "salt", "rank"))
                sequence, offset = chosen.place(length, rank - 1 + ahead[base[length] + salt])
                yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    kind = dict(table.dtypes)["id"]
    out = ranked.select(*table.columns, "salt", "rank").mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
