"""Operator 2: token ids as canonical length-limited Huffman code.

``write_token_files`` leaves a folder with three Parquet tables: ``codebook`` (token, length),
``parts`` (part, base: the ids in all parts before it) and ``blocks``.  A block holds whole documents
in ascending id order: ``doc_ids``, ``counts``, ``part`` and ``first`` (ids of its part before it; with
the part's base the position in the stream of all ids), ``bits`` (code words, most significant bit
first, padded to 32-bit words) and ``checkpoints`` (for every ``STRIDE`` ids, the bits they take, as
unsigned 16-bit integers; their running sum gives the bit offset where each stride starts).  Blocks
decode without each other, and the strides of a block side by side from one lookup table.

Texts are tokenised where they are read; what is sorted by document id are the ids, in byte planes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import load

from .storage import modest_batches, scratch, stored
from .tokens import Encoder, encoder, with_end

LIMIT = 18
STRIDE = 128
BLOCK = 1 << 17
_U = np.uint64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.int64)
    level, flags = weight, [np.ones(len(weight), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        flags.append(rank < len(weight))
    take = 2 * len(weight) - 2
    for leaf in reversed(flags):
        n = int(leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words: ascending by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    code = last = 0
    ids = np.flatnonzero(lengths)
    for i in ids[np.argsort(lengths[ids], kind="stable")]:
        code <<= int(lengths[i]) - last
        codes[i], last = code, int(lengths[i])
        code += 1
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """The bits and the checkpoints of one block."""
    if not len(ids):
        return b"", b""
    size = lengths[ids].astype(np.uint64)
    end = np.cumsum(size)
    at = end - size
    word = (at >> _U(5)).astype(np.int64)
    value = codes[ids] << (_U(64) - (at & _U(31)) - size)
    n = int(end[-1] + _U(31) >> _U(5)) + 1
    # code words do not overlap, so sums below 2**32 are what "or" would give
    out = np.bincount(word, (value >> _U(32)).astype(float), n) + np.bincount(word + 1, (value & _U(0xFFFFFFFF)).astype(float), n + 1)[:n]
    edge = end[np.append(np.arange(STRIDE - 1, len(ids) - 1, STRIDE), len(ids) - 1)]
    return out.astype(">u4").tobytes(), np.diff(edge, prepend=_U(0)).astype("<u2").tobytes()


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Decoding tables over the next ``width`` bits: the id, and how many bits it takes."""
    width = max(1, int(lengths.max(initial=0)))
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    span = np.left_shift(1, width - lengths[ids].astype(np.int64))
    fill = (1 << width) - int(span.sum())
    return np.append(np.repeat(ids, span), np.zeros(fill, np.int64)).astype(np.uint32), np.append(np.repeat(lengths[ids], span), np.ones(fill, np.uint8)).astype(np.int64), width


def unpack(bits: bytes, checkpoints: bytes, n: int, tables: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """The n ids of a block: step k reads the k-th id of every stride."""
    symbol, size, width = tables
    if not n:
        return np.zeros(0, np.uint32)
    words = np.frombuffer(bits, ">u4").astype(np.uint64)
    pair = (words << _U(32)) | np.append(words[1:], _U(0))
    pos = np.concatenate([[0], np.cumsum(np.frombuffer(checkpoints, "<u2").astype(np.int64))[:-1]])
    out = np.zeros((STRIDE, len(pos)), np.uint32)
    last = n - (len(pos) - 1) * STRIDE
    for k in range(min(STRIDE, n)):
        if k == last:
            pos = pos[:-1]
        peek = (pair[pos >> 5] >> (64 - width - (pos & 31)).astype(np.uint64)) & _U((1 << width) - 1)
        peek = peek.astype(np.int64)
        out[k, : len(pos)] = symbol[peek]
        pos = pos + size[peek]
    return out.T.ravel()[:n]


def planes_of(enc: Encoder) -> list[str]:
    """Names of the byte planes of an id, low byte first: two up to 65,536 ids, else three."""
    return ["lo", "hi"] if enc.dtype.itemsize == 2 else ["lo", "hi", "top"]


def split_planes(ids: np.ndarray, n: np.ndarray, planes: int) -> list[pa.Array]:
    """Byte planes of ids end to end, cut into documents of n ids."""
    off = pa.py_buffer(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
    return [pa.Array.from_buffers(pa.binary(), len(n), [None, off, pa.py_buffer((ids >> 8 * k & 255).astype(np.uint8))]) for k in range(planes)]


def join_planes(b: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """All ids of a batch, end to end."""
    out = None
    for k, name in enumerate(names):
        c = b.column(name)
        off = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        plane = np.frombuffer(c.buffers()[2], np.uint8)[off[0] : off[-1]].astype(np.uint16 if len(names) == 2 else np.uint32)
        out = plane if out is None else out | plane << 8 * k
    return out


def tokenise(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(id, tie, n, planes of the ids): one row a document, made where its text is read; ``tie`` hashes the text."""
    kind = dict(docs.dtypes)[id_col]
    names = planes_of(encoder(path))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("tie"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for first, ids, n in enc.encode_column(b.column("text")):
                ids, n = with_end(ids, n, end_id)
                some = b.slice(first, len(n))
                yield pa.RecordBatch.from_arrays([some.column("id"), some.column("tie"), pa.array(n), *split_planes(ids, n, len(names))], ["id", "tie", "n", *names])

    return base.mapInArrow(run, f"id {kind}, tie long, n long, " + ", ".join(f"{p} binary" for p in names))


def count_ids(tokens: DataFrame, names: list[str], n_ids: int) -> np.ndarray:
    """How often each id occurs; one row an id and task is shuffled, at most ``n_ids`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(join_planes(b, names), minlength=n_ids)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["token", "n"])

    got = tokens.select(*names).mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(n_ids, np.int64)
    counts[got["token"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return counts


def write_token_files(docs: DataFrame, tokenizer: str, to: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, limit: int = LIMIT) -> None:
    """Encode all texts and write the folder ``to``.

    A null or empty text is one end id.  Null ids come first, as one more value; repeated rows are
    each written; rows of one id are in order of a hash of their texts.  An empty table gives empty
    tables.  Other columns are not read.
    """
    spark = docs.sparkSession
    enc = encoder(tokenizer)
    names, n_ids = planes_of(enc), max(enc.n_ids, end_id + 1)
    tokens = stored(tokenise(docs, tokenizer, id_col, text_col, end_id), "tokens")
    kind = dict(tokens.dtypes)["id"]
    lengths = code_lengths(count_ids(tokens, names, n_ids), limit)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "token int, length int").coalesce(1).write.parquet(f"{to}/codebook")
    book = spark.sparkContext.broadcast((lengths, canonical(lengths)))  # n_ids entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (lengths, codes), before = book.value, 0
        for b in batches:
            if not b.num_rows:
                continue
            n, part = b.column("n").to_numpy(), b.column("part")[0].as_py()
            end, ids, i = np.cumsum(n), join_planes(b, names), 0
            while i < len(n):
                j = max(i + 1, int(np.searchsorted(end, end[i] - n[i] + BLOCK, "right")))
                bits, checks = pack(ids[end[i] - n[i] : end[j - 1]], codes, lengths)
                one = lambda v, t: pa.array([v], t)
                first = before + int(end[i] - n[i])
                yield pa.RecordBatch.from_arrays([one(part, pa.int32()), one(first, pa.int64()), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column("id").slice(i, j - i)), one(n[i:j].tolist(), pa.list_(pa.int64())), one(bits, pa.binary()), one(checks, pa.binary())], ["part", "first", "doc_ids", "counts", "bits", "checkpoints"])
                i = j
            before += int(end[-1])

    parts = tokens.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select(F.spark_partition_id().alias("part"), "id", "n", *names)
    parts.mapInArrow(run, f"part int, first long, doc_ids array<{kind}>, counts array<long>, bits binary, checkpoints binary").write.option("compression", "none").parquet(f"{to}/blocks")
    size = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    of_part = spark.read.parquet(f"{to}/blocks").groupBy("part").agg(F.sum(size).alias("n")).coalesce(1)  # a row a part
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    of_part.select("part", base.alias("base")).write.parquet(f"{to}/parts")


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """One row per document from the blocks: id, start, n_tokens, ids_crc32, and the ids if asked for."""
    modest_batches(spark)
    book = spark.read.parquet(f"{path}/codebook").collect()  # a row an id of the vocabulary
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/parts")), "part")  # a row a part of the sort
    lengths = np.zeros(max((r["token"] for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r["token"]] = r["length"]
    shared = spark.sparkContext.broadcast(lengths)
    kind = dict(blocks.dtypes)["doc_ids"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = lookup(shared.value)
        for b in batches:
            for i in range(b.num_rows):
                n = np.array(b.column("counts")[i].as_py(), np.int64)
                ids = unpack(b.column("bits")[i].as_py(), b.column("checkpoints")[i].as_py(), int(n.sum()), tables)
                end = np.cumsum(n)
                each = [ids[e - k : e] for e, k in zip(end, n)]
                cols = [b.column("doc_ids")[i].values, pa.array(b.column("first")[i].as_py() + end - n), pa.array(n), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())]
                names = ["id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([x.tolist() for x in each], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    placed = blocks.select((F.col("first") + F.col("base")).alias("first"), "doc_ids", "counts", "bits", "checkpoints")
    out = placed.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    to = scratch(spark, "token-files")
    write_token_files(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), to)
    return read_token_files(spark, to)
