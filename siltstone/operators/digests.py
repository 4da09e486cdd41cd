"""BLAKE3 digests of whole texts, computed side by side for all texts of an Arrow batch.

The hash is a tree: leaves of 1,024 bytes, each a chain of up to 16 blocks of 64 bytes, joined two by two;
the left subtree holds the largest power of two of leaves that leaves something for the right one.  Every
step is one numpy pass over all texts: the blocks of one position of all leaves, then all joins of a level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import load

# Fixed values of the published function: initial words, word order of a round, flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
#: Columns and diagonals that a round mixes.
LANES = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]
LEAF, BLOCK = 1024, 64
#: Bytes of text that are hashed side by side, about; a longer text is hashed by itself.
STRETCH = 1 << 20


def compress(chain: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The 8 new chaining words (8 x n) of n blocks: chaining words 8 x n, message words 16 x n."""
    n = chain.shape[1]
    v = [*chain, *(np.full(n, x, np.uint32) for x in IV[:4]), counter.astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    turn = lambda x, k: (x >> np.uint32(k)) | (x << np.uint32(32 - k))
    m = list(words)
    for round_ in range(7):
        for k, (a, b, c, d) in enumerate(LANES):
            for word, r1, r2 in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                v[a] = v[a] + v[b] + word
                v[d] = turn(v[d] ^ v[a], r1)
                v[c] = v[c] + v[d]
                v[b] = turn(v[b] ^ v[c], r2)
        if round_ < 6:
            m = [m[i] for i in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def leaves(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chaining words of all leaves (8 x n) of texts side by side, and how many leaves each text has."""
    size = np.diff(off)
    count = np.maximum(1, -(-size // LEAF))
    text = np.repeat(np.arange(len(size)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = off[text] + number * LEAF
    length = np.minimum(LEAF, off[text + 1] - start)
    blocks = np.maximum(1, -(-length // BLOCK))
    chain = np.repeat(IV[:, None], len(text), 1)
    padded = np.concatenate([data, np.zeros(BLOCK, np.uint8)])
    for k in range(int(blocks.max(initial=0))):
        at = np.flatnonzero(blocks > k)
        here = np.clip(length[at] - k * BLOCK, 0, BLOCK)
        bytes_ = padded[np.minimum(start[at] + k * BLOCK, len(data))[:, None] + np.arange(BLOCK)]
        bytes_[np.arange(BLOCK) >= here[:, None]] = 0
        last = blocks[at] == k + 1
        flags = (CHUNK_START if k == 0 else 0) | np.where(last, CHUNK_END | np.where(count[text[at]] == 1, ROOT, 0), 0)
        chain[:, at] = compress(chain[:, at], bytes_.view("<u4").T.astype(np.uint32), number[at].astype(np.uint64), here, flags)
    return chain, count


def blake3(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The 32-byte digests (n x 32) of n texts side by side (bytes, n + 1 offsets)."""
    chain, count = leaves(data, off)
    while (count > 1).any():
        # neighbours of a text join; an odd last one goes up as it is, which is the tree with full left sides
        text = np.repeat(np.arange(len(count)), count)
        number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        left = np.flatnonzero((number % 2 == 0) & (number + 1 < count[text]))
        alone = np.flatnonzero((number % 2 == 0) & (number + 1 == count[text]))
        flags = PARENT | np.where(count[text[left]] == 2, ROOT, 0)
        joined = compress(np.repeat(IV[:, None], len(left), 1), np.concatenate([chain[:, left], chain[:, left + 1]]), np.zeros(len(left), np.uint64), np.full(len(left), BLOCK), flags)
        order = np.argsort(np.concatenate([left, alone]), kind="stable")
        chain, count = np.concatenate([joined, chain[:, alone]], 1)[:, order], (count + 1) // 2
    return np.ascontiguousarray(chain.T).astype("<u4").view(np.uint8).reshape(len(count), 32)


def content_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, blake3): the digest of each text's UTF-8 bytes in hexadecimal; a null text has none, an empty one has that of no bytes."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("text").cast(pa.large_binary())
            off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
            out, i = [], 0
            while i < len(column):
                j = max(i + 1, int(np.searchsorted(off, off[i] + STRETCH, "right")) - 1)
                out += [d.tobytes().hex() for d in blake3(data[off[i] : off[j]], off[i : j + 1] - off[i])]
                i = j
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([None if gone else x for x, gone in zip(out, column.is_null().to_pylist())], pa.string())], [id_col, "blake3"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, blake3 string")


def q_content_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_digests(load(spark, sf_dir, "documents").select("doc_id", "text"))


def q_equal_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several documents have, found by their digests: how many, the first and the last of them."""
    same = content_digests(load(spark, sf_dir, "documents").select("doc_id", "text")).where("blake3 IS NOT NULL").groupBy("blake3")
    return same.agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("n > 1").select("n", "first", "last")


QUERIES = {"content_digests": q_content_digests, "equal_contents": q_equal_contents}
ORACLE_SQL = {"equal_contents": "SELECT count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1"}
