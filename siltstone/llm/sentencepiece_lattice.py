"""Operator 3: SentencePiece encoding and decoding over a relational lattice.

No piece crosses two characters that stand side by side in no piece of the model, so texts fall into
units there (words without their punctuation, mostly) and equal units are encoded once.  For every
distinct unit Spark explodes its substrings up to the longest piece, equi-joins them to the (broadcast,
vocabulary-sized) piece table, groups the edges by unit and folds them with ``aggregate``.

The model is of the BPE kind.  A Viterbi fold over piece scores does not give its segmentation, which
is defined by merging the best-ranked adjacent pair again and again; so the fold here runs those
merges on the lattice: its state is the set of boundaries (a bit each), and a step removes the
boundary inside an edge that has both its ends and exactly one boundary within.  Where each piece
ranks after what it is made of (``in_rank_order``), one pass over the edges by rank is that process.

Units and the codes of texts are written once, in buckets of the task that cut them; units are
shuffled once, and once back with their ids; codes stay where they are.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import load

from .storage import bucketed, modest_batches

MARK = "▁"
#: Longer units do not fit a 64-bit boundary set; they are folded by ``merge_long``.
BITS = 62
NO_RANK, NO_PIECE = (1 << 31) - 1, (1 << 20) - 1
#: Units of one local dictionary, and codes of the texts that share it; beyond, a new one begins.
LOCAL_UNITS, LOCAL_CODES = 1_500_000, 12_000_000
#: Bytes of text that are cut at once, if no text is longer.
SLAB = 1 << 20
#: Units whose edges a task groups by hash (under 1 KB each) before it sorts instead; Spark's 128 would sort nearly all.
GROUPS = 64_000
#: Bits of a code beside its part.
CODE_BITS = 32
#: Encoded units of a task that are dealt out by part at once.
PACK = 1_000_000


def piece_table(model: str) -> tuple[list[tuple[str, int, int]], int]:
    """(piece, id, rank) of all normal pieces, rank 0 for the best score, and the id of byte 0."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    skip = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
    scores = {i: m.get_score(i) for i in range(m.vocab_size()) if not skip(i)}
    rank = {x: k for k, x in enumerate(sorted(set(scores.values()), reverse=True))}
    return [(m.id_to_piece(i), i, rank[x]) for i, x in scores.items()], next(i for i in range(m.vocab_size()) if m.is_byte(i))


def in_rank_order(rows: list[tuple[str, int, int]]) -> bool:
    """Whether the merges that make each piece from its characters come by falling rank, its own last.

    As long as no merge crosses the ends of a piece's span, those inside are the ones of the piece alone,
    in their order; so if this holds for each piece, whatever a merge makes possible ranks after it.
    """
    rank = {p: r for p, _, r in rows}
    for piece in rank:
        parts, last = list(piece), -1
        while len(parts) > 1:
            best, i = min((rank.get(a + b, NO_RANK), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best < last:
                return False
            if best == NO_RANK:
                break
            parts[i : i + 2], last = [parts[i] + parts[i + 1]], best
    return True


class Cutter:
    """Cuts texts between characters that are side by side in no piece."""

    def __init__(self, pieces: list[str]):
        spelled = [p.replace(MARK, " ") for p in pieces]
        chars = sorted(set().union(*spelled))
        self.index, self.n = np.zeros(0x110000, np.uint16), len(chars) + 1  # 0: a character of no piece
        self.index[[ord(c) for c in chars]] = np.arange(1, self.n)
        self.joined = np.zeros(self.n * self.n, bool)
        for p in spelled:
            at = self.index[[ord(c) for c in p]].astype(np.int64)
            self.joined[at[:-1] * self.n + at[1:]] = True

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of texts (null: empty) end to end, the mark as a space and with the dummy prefix; how many each text has."""
        texts = pc.replace_substring(texts.fill_null(""), MARK, " ")
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", pc.binary_join_element_wise(" ", texts, ""))
        off = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(False).astype(np.int64))])
        if not off[-1]:
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset]
        data = texts.buffers()[2].slice(int(first), int(off[-1]))
        code = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), "<u4")
        lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        kind = self.index[code].astype(np.int64)
        opens = np.append(True, ~self.joined[kind[:-1] * self.n + kind[1:]])
        opens[np.searchsorted(lead, off[:-1][off[:-1] < off[1:]])] = True
        at = lead[opens]
        ends = np.append(at, off[-1]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(ends), data), np.diff(np.searchsorted(at, off))


def squeeze(x: np.ndarray) -> bytes:
    """Numbers as little-endian 32-bit ones, all first bytes before all second ones and so on, compressed."""
    return pa.compress(x.astype("<i4").view("u1").reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def expand(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that ``squeeze`` was given."""
    return np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), "u1").reshape(4, -1).T.copy().view("<i4").ravel()


def index_units(docs: DataFrame, pieces: list[str], id_col: str, text_col: str) -> DataFrame:
    """Two kinds of rows: (part, code, unit) of local dictionaries, and (part, ids, sizes, codes) of blocks of documents.

    ``codes`` are those of the block's texts end to end, squeezed; ``sizes`` says how many each text has.
    """
    kind = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    names = ["part", "code", "unit", "ids", "sizes", "codes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, none = Cutter(shared.value), pa.array([], pa.string())
        part, known, coded = TaskContext.get().partitionId() << 24, none, 0
        for b in batches:
            ids = b.column("id")
            upto = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(False).astype(np.int64))
            cuts = [0, *(np.flatnonzero(np.diff(upto // SLAB)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                units, size = cutter.cut(b.column("text").slice(i, j - i))
                flat = units.dictionary_encode()
                code = pc.index_in(flat.dictionary, known)
                new = flat.dictionary.filter(code.is_null())
                code = code.fill_null(-1).to_numpy(False).copy()
                code[code < 0] = len(known) + np.arange(len(new), dtype=np.int32)
                n = len(new)
                for k in range(0, n, 1 << 16):
                    some = new.slice(k, 1 << 16)
                    m = len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * m, pa.int64()), pa.array(np.arange(len(known) + k, len(known) + k + m, dtype=np.int32)), some, pa.nulls(m, pa.list_(ids.type)), pa.nulls(m, pa.list_(pa.int32())), pa.nulls(m, pa.binary())], names)
                known = pa.concat_arrays([known, new])
                codes = squeeze(code[flat.indices.to_numpy(False)])
                one = lambda x, of: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x.cast(of))
                rows = [pa.array([part], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), one(ids.slice(i, j - i), ids.type), one(pa.array(size), pa.int32()), pa.array([codes], pa.binary())]
                yield pa.RecordBatch.from_arrays(rows, names)
                coded += len(flat)
                if len(known) >= LOCAL_UNITS or coded >= LOCAL_CODES:
                    part, known, coded = part + 1, none, 0

    return base.mapInArrow(run, f"part long, code int, unit string, ids array<{kind}>, sizes array<int>, codes binary")


def merge_long(length: int, edges: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the tokens of a long word from its edges (start, length, rank): a heap of merges."""
    rank = {(s, s + n): i for s, n, i in edges if n > 1}
    after, before = list(range(1, length + 1)), list(range(-1, length))
    heap = [(rank[s, s + 2], s, s + 1, s + 2) for s in range(length - 1) if (s, s + 2) in rank]
    heapq.heapify(heap)
    gone: set[int] = set()
    while heap:
        _, s, mid, e = heapq.heappop(heap)
        if {s, mid, e} & gone or after[s] != mid or after[mid] != e:
            continue
        gone.add(mid)
        after[s] = e
        if e < length:
            before[e] = s
            if (s, after[e]) in rank:
                heapq.heappush(heap, (rank[s, after[e]], s, e, after[e]))
        if s > 0 and (before[s], e) in rank:
            heapq.heappush(heap, (rank[before[s], e], before[s], s, e))
    out, at = [], 0
    while at < length:
        out.append((at, after[at]))
        at = after[at]
    return out


def encode_units(uses: DataFrame, rows: list[tuple[str, int, int]], byte0: int) -> DataFrame:
    """(at, ids) of each row of ``uses`` (at, unit); each distinct unit has one lattice."""
    spark = uses.sparkSession
    longest = max(len(p) for p, _, _ in rows)
    pieces = F.broadcast(spark.createDataFrame([(p.replace(MARK, " "), i, r) for p, i, r in rows], "sub string, piece int, rank int"))  # one row a piece of the model
    # a character that is no piece becomes its bytes
    as_bytes = f"transform(sequence(1, octet_length(%s)), i -> CAST(conv(substring(hex(%s), 2 * i - 1, 2), 16, 10) AS INT) + {byte0})"

    def spots_of(units: DataFrame) -> DataFrame:
        spots = units.withColumn("n", F.char_length("unit"))
        spots = spots.select("unit", "least", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
        spots = spots.select("unit", "least", "n", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("s")))).alias("l"))
        return spots.withColumn("sub", F.expr("substring(unit, s + 1, l)")).join(pieces, "sub", "left").where("piece IS NOT NULL OR l = 1")

    def back(uses: DataFrame, coded: DataFrame) -> DataFrame:
        # always true; with it both sides need the same columns, and so read one exchange
        return uses.join(coded, "unit").where("at >= least").select("at", "ids")

    here = uses.where(F.char_length("unit") <= BITS).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "unit")
    # an edge is one number while it is grouped: rank, start, length, piece (all ones: none)
    number = F.expr(f"shiftleft(coalesce(rank, {NO_RANK})::bigint, 32) | shiftleft(s::bigint, 26) | shiftleft(l::bigint, 20) | coalesce(piece, {NO_PIECE})")
    short = spots_of(here.groupBy("unit").agg(F.min("at").alias("least"))).withColumn("e", number).groupBy("unit").agg(F.min("least").alias("least"), F.sort_array(F.collect_list("e")).alias("edges"))
    s, l = "(shiftright(e, 26) & 63)::int", "(shiftright(e, 20) & 63)::int"  # noqa: E741
    short = short.withColumn("edges", F.expr(f"transform(edges, e -> struct(e & {(1 << 32) - 1} AS e, shiftleft(shiftleft(1L, {l}) + 1, {s}) AS ends, shiftleft(shiftleft(2L, {l}) - 1, {s}) AS span))"))
    fits, merged, whole = "bit_count(m & e.span) = 3 AND (m & e.ends) = e.ends", "(m & ~e.span) | e.ends", "~shiftleft(-1L, char_length(unit) + 1)"
    if in_rank_order(rows):
        fold = f"edges, {whole}, (m, e) -> IF({fits}, {merged}, m)"
    else:
        fold = f"sequence(1, char_length(unit)), {whole}, (m, i) -> coalesce(get(transform(slice(filter(edges, e -> {fits}), 1, 1), e -> {merged}), 0), m)"
    # the tokens are the edges without a boundary within; as the last step of the aggregate, so that m is computed once
    short = short.select("unit", "least", F.expr(f"sort_array(aggregate({fold}, m -> transform(filter(edges, e -> (m & e.span) = e.ends), e -> e.e)))").alias("tokens"))
    piece, spelled = f"(e & {NO_PIECE})::int", as_bytes.replace("%s", f"substring(unit, {s} + 1, 1)")
    bytes_too = f"flatten(transform(tokens, e -> IF({piece} = {NO_PIECE}, {spelled}, array({piece}))))"
    short = short.select("unit", "least", F.expr(f"IF(exists(tokens, e -> {piece} = {NO_PIECE}), {bytes_too}, transform(tokens, e -> {piece}))").alias("ids"))

    far = uses.where(F.char_length("unit") > BITS)
    ids = F.expr(f"IF(piece IS NULL, {as_bytes.replace('%s', 'sub')}, array(piece))")
    long = spots_of(far.groupBy("unit").agg(F.min("at").alias("least"))).groupBy("unit", "least").agg(F.collect_list(F.struct("s", "l", F.coalesce("rank", F.lit(-1)).alias("rank"), ids.alias("ids"))).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for word, edges in zip(b.column("unit").to_pylist(), b.column("edges").to_pylist()):
                ids = {(e["s"], e["s"] + e["l"]): e["ids"] for e in edges}
                out.append([i for span in merge_long(len(word), [(e["s"], e["l"], e["rank"]) for e in edges]) for i in ids[span]])
            yield pa.RecordBatch.from_arrays([b.column("unit"), b.column("least"), pa.array(out, pa.list_(pa.int32()))], ["unit", "least", "ids"])

    return back(here, short).unionByName(back(far, long.select("unit", "least", "edges").mapInArrow(run, "unit string, least long, ids array<int>")))


def pack(encoded: DataFrame) -> DataFrame:
    """Rows (at, ids) as a few rows a part: (part, n, m, code, size, ids), squeezed: ``n`` codes in order, how many ids each has, and the ``m`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            at, lists = t["at"].to_numpy(), t["ids"].combine_chunks()
            order = np.argsort(at)
            at, lists = at[order], lists.take(pa.array(order))
            size, flat = pc.list_value_length(lists).to_numpy(False), lists.flatten().to_numpy(False)
            upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            part, code = at >> CODE_BITS, at & ((1 << CODE_BITS) - 1)
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(at)]
            rows = [(int(part[i]), j - i, int(upto[j] - upto[i]), squeeze(np.diff(code[i:j], prepend=0)), squeeze(size[i:j]), squeeze(flat[upto[i] : upto[j]])) for i, j in zip(cuts, cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names)

        names, kinds = ["part", "n", "m", "code", "size", "ids"], [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                n += b.num_rows
            if n >= PACK:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    return encoded.mapInArrow(run, "part long, n int, m int, code binary, size binary, ids binary")


class Speller:
    """The texts of id lists."""

    def __init__(self, rows: list[tuple[str, int, int]], byte0: int):
        spell = {i: p.replace(MARK, " ").encode() for p, i, _ in rows} | {byte0 + k: bytes([k]) for k in range(256)}
        self.none = max(spell) + 1
        self.piece = pa.array([spell.get(i, b"") for i in range(self.none + 1)], pa.large_binary())

    def texts(self, ids: np.ndarray, edge: np.ndarray) -> list[str]:
        """A text for each two neighbours in ``edge``, which are places in ``ids``; unknown ids spell nothing."""
        spelled = self.piece.take(pa.array(np.where((ids < 0) | (ids > self.none), self.none, ids)))
        upto = np.concatenate([[0], np.cumsum(pc.binary_length(spelled).to_numpy(False))])[edge].tolist()
        data = memoryview(spelled.buffers()[2] or b"")
        return [str(data[i:j], "utf-8", "replace").removeprefix(" ") for i, j in zip(upto, upto[1:])]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decoded_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit), ids.

    Ids are those of the sentencepiece library.  A null or empty text has none; null and repeated ids
    are rows like others; other columns are not read; an empty table gives an empty result.  A text of
    any length is encoded whole; the texts that share a dictionary (``LOCAL_CODES``) are one group.
    With ``decoded_col`` each row also has there what ``decode`` makes of its ids, by the task and the
    Python worker that put them together.
    """
    modest_batches(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(GROUPS))
    rows, byte0 = piece_table(model)
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(rows) if decoded_col else None
    both = bucketed(index_units(docs, [p for p, _, _ in rows], id_col, text_col), "units", "part")
    uses = both.select(F.expr(f"shiftleft(part, {CODE_BITS}) | code").alias("at"), "unit").where("at IS NOT NULL AND unit IS NOT NULL")
    table = pack(encode_units(uses, rows, byte0))
    blocks = both.where("codes IS NOT NULL").select("part", "ids", "sizes", "codes")

    def spell(left: pa.Table, right: pa.Table) -> pa.Table:
        speller = Speller(shared.value, byte0) if shared else None
        packs = left.select(["n", "m", "code", "size", "ids"]).to_pylist()
        none = [np.zeros(0, np.int32)]
        code = np.concatenate([np.cumsum(expand(p["code"], p["n"])) for p in packs] + none)
        flat = np.concatenate([expand(p["ids"], p["m"]) for p in packs] + none)
        size, start = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        size[code] = length = np.concatenate([expand(p["size"], p["n"]) for p in packs] + none)
        start[code] = np.cumsum(length) - length
        out = [[] for _ in range(5 if shared else 4)]
        for ids, sizes, codes in zip(right["ids"], right["sizes"], right["codes"]):
            units = sizes.values.to_numpy(False).astype(np.int64)
            c = expand(codes.as_py(), int(units.sum()))
            k = size[c]
            upto = np.concatenate([[0], np.cumsum(k)])
            took = flat[np.repeat(start[c] - upto[:-1], k) + np.arange(upto[-1])]
            edge = upto[np.concatenate([[0], np.cumsum(units)])]
            data = took.astype("<i4").tobytes()
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(edge.tolist(), edge[1:].tolist())]
            made = [ids.values, pa.array(np.diff(edge)), pa.array(crc, pa.int64()), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(took, pa.int32()))]
            for x, y in zip(out, [*made, pa.array(speller.texts(took, edge), pa.string())] if speller else made):
                x.append(y)
        kinds = [right.schema.field("ids").type.value_type, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string()]
        return pa.table([pa.chunked_array(x, of) for x, of in zip(out, kinds)], ["id", "n_tokens", "ids_crc32", "ids", "decoded"][: len(out)])

    out = table.groupBy("part").cogroup(blocks.groupBy("part")).applyInArrow(spell, f"id {kind}, n_tokens long, ids_crc32 long, ids array<int>" + (", decoded string" if shared else ""))
    return out.withColumnsRenamed({"id": id_col} | ({"decoded": decoded_col} if shared else {}))


def decode(table: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``table`` with ``text_col``: the text of each id list (null: null); unknown ids spell nothing."""
    rows, byte0 = piece_table(model)
    shared = table.sparkSession.sparkContext.broadcast(rows)
    names = [c for c in table.columns if c != text_col]
    at = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(shared.value, byte0)
        for b in batches:
            lists = b.column(at)
            edge = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy(False))])
            texts = speller.texts(lists.flatten().fill_null(-1).to_numpy(False), edge)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(False))], [*names, text_col])

    schema = ", ".join([*(f"`{c}` {dict(table.dtypes)[c]}" for c in names), f"`{text_col}` string"])
    return table.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode(load(spark, sf_dir, "documents"), model, decoded_col="decoded")
    return coded.withColumn("decoded_crc32", F.crc32("decoded")).drop("decoded")
