"""Operator 12: byte-level BPE encoding and decoding by folds over the bytes of distinct words.

Spark's regular expressions cut a text into the matches of the tokenizer's pattern.  Whole texts are
gathered in blocks of about ``BLOCK`` bytes, and a block's distinct words that no earlier block of the
task had go before it as rows of their own; no text and no word is shuffled.  ``fold_states`` turns a
word's bytes into ids with higher-order functions alone: its state is an array with one number a piece
(the rank that the piece and its right neighbour would have together, where the piece starts, and its
id), ``aggregate`` merges the leftmost pair of the best rank in each step, and ranks come from one
literal table in the plan.  The rows of a block are put together again behind the fold, in the task
that cut them.  Decoding concatenates the binary pieces of the ids.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import load

from .storage import modest_batches

#: Bytes of text in a block.
BLOCK = 4 << 20
#: Words that the blocks of a task share; beyond, the next block starts anew.
KEEP = 1_000_000
#: Longer words are merged from a heap, since a step of the fold copies the word's state.
LONG = 200
#: Bits of an id, and of a place in a short word.
ID_BITS, PLACE_BITS = 20, 12
#: In place of a rank: the pair is no piece.
NO_RANK = 1 << ID_BITS
#: Slots of each half of the rank table: primes that scatter ``left << ID_BITS | right``.
SLOTS = (255_989, 240_007)


def read_ranks(path: str) -> dict[bytes, int]:
    """Pieces and their ranks, which are their ids, from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) >= 1 << ID_BITS or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the file lacks a byte or has too many pieces")
    return ranks


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of each two ids whose pieces side by side are a piece, by ``left << ID_BITS | right``."""
    out = {}
    for piece, rank in ranks.items():
        for k in range(1, len(piece)):
            a, b = ranks.get(piece[:k]), ranks.get(piece[k:])
            if a is not None and b is not None:
                out[a << ID_BITS | b] = rank
    return out


def rank_table(pairs: dict[int, int]) -> list[int]:
    """The pairs by cuckoo hashing: each is in its slot of the first or of the second half; an entry is ``pair << ID_BITS | rank``, none is -1."""
    first, second = SLOTS
    table = [-1] * (first + second)
    for pair, rank in pairs.items():
        entry, slot = pair << ID_BITS | rank, pair % first
        for _ in range(10_000):
            entry, table[slot] = table[slot], entry
            if entry < 0:
                break
            k = entry >> ID_BITS
            slot = first + k % second if slot == k % first else k % first
        else:
            raise ValueError("the rank table is too full")
    return table


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once.

    An aggregate of nothing, whose last step is the body.  An element of a transformed array would do
    too, but then each evaluation asks the whole body anew for its type and for whether it may be null.
    """
    return F.aggregate(F.expr("CAST(array() AS array<int>)"), value, lambda x, _: x, body)


def _found(table: Column, left: Column, right: Column) -> Column:
    """The rank of two ids side by side; ``NO_RANK`` where they are no piece or one is missing."""

    def look(pair: Column) -> Column:
        one, two = F.get(table, (pair % SLOTS[0]).cast("int")), F.get(table, (pair % SLOTS[1] + SLOTS[0]).cast("int"))
        mask = F.lit((1 << ID_BITS) - 1)
        return F.when(F.shiftright(one, ID_BITS) == pair, one.bitwiseAND(mask)).when(F.shiftright(two, ID_BITS) == pair, two.bitwiseAND(mask))

    return F.coalesce(_bound(F.shiftleft(left, ID_BITS) + right, look), F.lit(NO_RANK).cast("long"))


def _literal(values: list[int]) -> Column:
    # from_json over a literal is folded into an array literal by the optimizer
    return F.from_json(F.lit(str(values)), "array<bigint>")


def fold_states(start: Column, ranks: dict[bytes, int]) -> Column:
    """The ids (array<int>) of a word, in higher-order functions, from its bytes' state (array<bigint>); null for null.

    An element of the state is a piece: the rank of it and its right neighbour together (``NO_RANK``:
    none), the place of its first byte, which tells equal pairs apart, and its id.
    """
    id_of = lambda x: x.bitwiseAND(F.lit((1 << ID_BITS) - 1))
    high = ID_BITS + PLACE_BITS
    place, low, none = F.lit(((1 << PLACE_BITS) - 1) << ID_BITS), F.lit((1 << high) - 1), F.lit(NO_RANK << high)

    def body(table: Column) -> Column:
        def step(state: Column, _: Column) -> Column:
            def merge(best: Column) -> Column:
                new = F.shiftright(best, high)  # a piece's rank is its id

                def before(i: Column) -> Column:
                    """``i``: the index in front of the best pair."""
                    here = F.shiftleft(_found(table, new, id_of(F.get(state, i + 3))), high).bitwiseOR(best.bitwiseAND(place)).bitwiseOR(new)
                    left = lambda x: F.shiftleft(_found(table, id_of(x), new), high).bitwiseOR(x.bitwiseAND(low))
                    return F.array_remove(F.transform(state, lambda x, k: F.when(x == best, here).when(k == i, left(x)).otherwise(x)), F.get(state, i + 2))

                return _bound(F.array_position(state, best).cast("int") - 2, before)

            return _bound(F.array_min(state), lambda best: F.when(best >= none, state).otherwise(merge(best)))

        # steps in fours, of which no more begin once nothing can merge
        four = lambda state, _: F.when(F.array_min(state) >= none, state).otherwise(F.aggregate(F.array(*map(F.lit, range(4))), state, step))
        rounds = F.sequence(F.lit(0), F.floor((F.size(start) + 2) / 4).cast("int"))
        return F.aggregate(rounds, start, four, lambda s: F.transform(s, lambda x: id_of(x).cast("int")))

    return F.when(F.size(start) == 0, F.expr("CAST(array() AS array<int>)")).when(F.size(start) > 0, _bound(_literal(rank_table(pair_ranks(ranks))), body))


def fold_words(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids (array<int>) of a binary word of at most ``LONG`` bytes, in higher-order functions; null for null."""

    def states(table: Column) -> Column:
        bytes_ = F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.ascii(F.decode(F.substring(word, i, F.lit(1)), "ISO-8859-1")))
        ids = F.transform(bytes_, lambda b: F.get(_literal([ranks[bytes([b])] for b in range(256)]), b))
        high = ID_BITS + PLACE_BITS
        return _bound(ids, lambda x: F.transform(x, lambda a, i: F.shiftleft(_found(table, a, F.get(x, i + 1)), high).bitwiseOR(F.shiftleft(i.cast("long"), ID_BITS)).bitwiseOR(a)))

    start = F.when(F.octet_length(word) == 0, F.expr("CAST(array() AS array<bigint>)")).when(F.octet_length(word) > 0, _bound(_literal(rank_table(pair_ranks(ranks))), states))
    return _bound(start, lambda s: fold_states(s, ranks))


def byte_tables(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """The id of each byte, and the rank of each two."""
    single = [bytes([b]) for b in range(256)]
    return np.array([ranks[b] for b in single], np.int64), np.array([[ranks.get(a + b, NO_RANK) for b in single] for a in single], np.int64)


def byte_states(words: pa.Array, tables: tuple[np.ndarray, np.ndarray]) -> pa.Array:
    """The state of each binary word's bytes, where ``fold_states`` starts; null for words of over ``LONG`` bytes."""
    ids, together = tables
    size = pc.binary_length(words).to_numpy(False).astype(np.int64)
    words = words.filter(pa.array(size <= LONG))
    n = np.where(size > LONG, 0, size)
    end = np.cumsum(n)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    text = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(words) else np.zeros(0, np.uint8)
    rank = np.append(together[text[:-1], text[1:]], NO_RANK)[: len(text)]
    rank[end[n > 0] - 1] = NO_RANK
    place = np.arange(len(text)) - np.repeat(end - n, n)
    state = rank << ID_BITS + PLACE_BITS | place << ID_BITS | ids[text]
    return pa.ListArray.from_arrays(pa.array(np.append(0, end).astype(np.int32)), pa.array(state, pa.int64()), mask=pa.array(size > LONG))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a long word: the same merges, best pairs from a heap."""
    end, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = []

    def offer(a: int) -> None:
        if a >= 0 and end[a] < len(word):
            rank = ranks.get(word[a : end[end[a]]])
            if rank is not None:
                heapq.heappush(heap, (rank, a, end[a], end[end[a]]))

    for a in range(len(word) - 1):
        offer(a)
    gone = bytearray(len(word) + 1)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if gone[a] or gone[b] or end[a] != b or end[b] != c:
            continue
        gone[b], end[a] = 1, c
        if c < len(word):
            before[c] = a
        offer(before[a])
        offer(a)
    out, at = [], 0
    while at < len(word):
        out.append(ranks[word[at : end[at]]])
        at = end[at]
    return out


def cut_words(docs: DataFrame, pattern: str, id_col: str, text_col: str) -> DataFrame:
    """(id, words, text): all matches of the pattern in order; where Java's characters are older than the text's, words are null and the text is given."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    new = text.rlike(r"\p{Cn}")
    words = F.when(~new, F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)))
    return docs.select(F.col(id_col).alias("id"), words.alias("words"), F.when(new, text).alias("text"))


def block_rows(cut: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Rows of blocks, in order: (state, or ids where the word is long, first) of new words, then (id, codes) of its texts.

    Codes number the words of the task's blocks in their order, from 0 again where ``first`` is true.
    """
    shared = cut.sparkSession.sparkContext.broadcast(ranks)
    kind = dict(cut.dtypes)["id"]
    names = ["id", "codes", "state", "ids", "first"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        later = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        known, tables = pa.array([], pa.binary()), byte_tables(shared.value)

        def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal known
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            lists = t["words"].combine_chunks()
            if t["text"].null_count < len(t):
                texts = t["text"].to_pylist()
                lists = pa.array([w if x is None else later.findall(x) for w, x in zip(lists.to_pylist(), texts)], pa.list_(pa.string()))
            flat = lists.flatten().dictionary_encode()
            words = flat.dictionary.cast(pa.binary())
            if len(known) > KEEP:
                known = known.slice(0, 0)
            first = not len(known)
            code = pc.index_in(words, known)
            new = words.filter(code.is_null())
            code = code.fill_null(-1).to_numpy(False).copy()
            code[code < 0] = len(known) + np.arange(len(new), dtype=np.int32)
            known = pa.concat_arrays([known, new])
            off = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(False))]).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(off), pa.array(code[flat.indices.to_numpy(False)], pa.int32()))
            size = 1 << 14  # rows of an Arrow batch
            for i in range(0, len(new), size):
                some = new.slice(i, size)
                n = len(some)
                state = byte_states(some, tables)
                ids = pa.nulls(n, pa.list_(pa.int32()))
                if state.null_count:
                    ids = pa.array([merge_long(w, shared.value) if len(w) > LONG else None for w in some.to_pylist()], ids.type)
                yield pa.RecordBatch.from_arrays([pa.nulls(n, t["id"].type), pa.nulls(n, codes.type), state, ids, pa.array([first] * n, pa.bool_())], names)
            n = len(t)
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), codes, pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32())), pa.nulls(n, pa.bool_())], names)

        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= 2 * BLOCK:  # words come with offsets, which take about as much as they
                yield from block(held)
                size = 0
                pa.default_memory_pool().release_unused()
        if sum(b.num_rows for b in held):
            yield from block(held)

    return cut.mapInArrow(run, f"id {kind}, codes array<int>, state array<bigint>, ids array<int>, first boolean")


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    """The piece of each id."""
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def _spelled(lists: pa.ListArray, piece: pa.LargeBinaryArray) -> pa.Array:
    """The pieces of each id list one after another; null for null."""
    spelled = piece.take(lists.flatten())
    n = pc.list_value_length(lists).fill_null(0).to_numpy(False)
    off = np.frombuffer(spelled.buffers()[1], np.int64, len(spelled) + 1, spelled.offset * 8)[np.concatenate([[0], np.cumsum(n)])]
    data = memoryview(spelled.buffers()[2] or b"")
    return pa.array([None if gone else bytes(data[i:j]) for i, j, gone in zip(off[:-1], off[1:], lists.is_null().to_pylist())], pa.binary())


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", bytes_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id and ``ids`` (array<int>), as the tiktoken library gives them without special tokens.

    A null or empty text has no ids; null and repeated document ids are rows like others; a text of any
    length is encoded whole (it is one array, and its words over ``LONG`` bytes are merged from a heap);
    other columns are not read; an empty table gives an empty result.  With ``bytes_col`` each row also
    has there what ``decode`` makes of its ids, by the task and the Python worker that put them together.
    """
    modest_batches(docs.sparkSession)
    rows = block_rows(cut_words(docs, pattern, id_col, text_col), ranks, pattern)
    coded = rows.select("id", "codes", F.coalesce("ids", fold_states(F.col("state"), ranks)).alias("ids"), "first")
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(_pieces(ranks)) if bytes_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Array] = []
        flat, start, size, fresh = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), False
        piece = pa.array(shared.value, pa.large_binary()) if shared else None
        for b in batches:
            is_word = b.column("codes").is_null().to_numpy(False)
            cut = [0, *(np.flatnonzero(np.diff(is_word)) + 1).tolist(), len(is_word)]
            for i, j in zip(cut, cut[1:]):
                if i == j:
                    continue
                if is_word[i]:
                    if not fresh and b.column("first")[i].as_py():
                        flat, size = flat[:0], size[:0]
                    parts.append(b.column("ids").slice(i, j - i))
                    fresh = True
                    continue
                if fresh:
                    size = np.concatenate([size, *(pc.list_value_length(p).to_numpy(False) for p in parts)])
                    flat = np.concatenate([flat, *(p.flatten().to_numpy(False) for p in parts)])
                    parts, start, fresh = [], np.cumsum(size) - size, False
                codes = b.column("codes").slice(i, j - i)
                c = codes.flatten().to_numpy(False)
                n = size[c]
                upto = np.concatenate([[0], np.cumsum(n)])
                ids = flat[np.repeat(start[c] - upto[:-1], n) + np.arange(upto[-1])]
                at = upto[np.concatenate([[0], np.cumsum(pc.list_value_length(codes).to_numpy(False))])]
                lists = pa.LargeListArray.from_arrays(pa.array(at), pa.array(ids)).cast(pa.list_(pa.int32()))
                spelled = [] if piece is None else [_spelled(lists, piece)]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), lists, *spelled], [id_col, "ids", *[bytes_col] * len(spelled)])

    return coded.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>" + (f", `{bytes_col}` binary" if bytes_col else ""))


def decode(table: DataFrame, ranks: dict[bytes, int], ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``table`` with ``bytes_col``: the pieces of each id list one after another (null: null); an unknown id is an error."""
    shared = table.sparkSession.sparkContext.broadcast(_pieces(ranks))
    names = [c for c in table.columns if c != bytes_col]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = pa.array(shared.value, pa.large_binary())
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _spelled(b.column(at), piece)], [*names, bytes_col])

    schema = ", ".join([*(f"`{c}` {dict(table.dtypes)[c]}" for c in names), f"`{bytes_col}` binary"])
    return table.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    back = encode(load(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, bytes_col="decoded")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
