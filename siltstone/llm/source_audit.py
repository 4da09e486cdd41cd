"""Operator 11: how the word use of the sources of a language diverges, by a sort of word-start pointers.

A shard is a stretch of whole texts in an Arrow buffer.  Its terms are runs of letters there; a pointer
to each start is kept, and a multikey quicksort, eight bytes a level, brings equal terms together: each
level splits the slices of pointers that are still equal so far, and only slices of two or more whose
terms go on are sorted further.  A run of equal pointers yields, per language and source, in how many
texts the term stands and how often.  Spark adds up the shards (partial sums first), keeps the terms of
enough documents of a language, and compares the sources of a language in blocks of terms and tiles of
sources, so no task depends on how common a term or how large a source is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.sources.tables import load

from .kernel import Slab, slabs
from .storage import modest_batches, stored

#: Bytes of a shard; a longer text is a shard of its own.
SHARD = 4 << 20
#: Documents of a language that a kept term has, at least; terms a group reports, at most.
LEAST, TOP = 30, 50
#: Sources of a tile, and cells (terms times sources) of a block.
TILE, CELLS = 256, 1 << 16
UNIT = 1_000_000_000

_TERM = np.zeros(256, bool)
_TERM[128:] = True
_TERM[ord("A") : ord("Z") + 1] = _TERM[ord("a") : ord("z") + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms_of(s: Slab) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, and each term's start, end and text."""
    low, is_term = _LOWER[s.buf], _TERM[s.buf]
    edge = np.zeros(len(low) + 1, bool)
    edge[s.off] = True
    opens, closes = is_term.copy(), is_term.copy()
    opens[1:] &= ~is_term[:-1] | edge[1:-1]
    closes[:-1] &= ~is_term[1:] | edge[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return low, start, end, np.searchsorted(s.off, start, "right") - 1


def sort_pointers(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the pointers by their terms, and the run (0, 1, ...) of equal terms each place lies in.

    Multikey quicksort with characters of eight bytes; bytes behind a term count as zero, which no term has.
    """
    n = len(start)
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    words = np.ndarray((len(low) + 1,), ">u8", padded.tobytes(), strides=(1,))
    order, slice_of = np.arange(n), np.zeros(n, np.int64)
    open_, depth = np.arange(n), 0  # places whose slice is not settled
    while len(open_):
        at = order[open_]
        left = end[at] - start[at] - 8 * depth
        key = words[np.minimum(start[at] + 8 * depth, len(low))].astype(np.uint64)
        short = np.clip(left, 0, 8)
        key &= np.where(short > 0, ~np.uint64(0) << np.minimum(8 * (8 - short), 63).astype(np.uint64), np.uint64(0))
        within = slice_of[open_]
        more = left > 8  # a term that ends here is smaller than those that go on
        by = np.lexsort((more, key, within) if depth else (more, key))
        order[open_], key, more = at[by], key[by], more[by]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (within[1:] != within[:-1]) | (more[1:] != more[:-1])])
        piece = np.cumsum(new) - 1
        sizes = np.bincount(piece)
        # a slice is named by the place of its first pointer
        slice_of[open_] = open_[np.flatnonzero(new)][piece]
        open_ = open_[(sizes[piece] > 1) & more]
        depth += 1
    runs = np.cumsum(np.concatenate([[0], (slice_of[1:] != slice_of[:-1]).astype(np.int64)])) if n else slice_of
    return order, runs


def shard_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, docs, n) of every shard; nulls are empty strings."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))])

    def count(s: Slab, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        low, start, end, doc = terms_of(s)
        order, run = sort_pointers(low, start, end)
        n_runs = int(run[-1]) + 1 if len(run) else 0
        # how often each text has each run, then over the texts of a group
        pair, often = np.unique(doc[order] * max(n_runs, 1) + run, return_counts=True)
        key = group[pair // max(n_runs, 1)] * max(n_runs, 1) + pair % max(n_runs, 1)
        cell, back, texts = np.unique(key, return_inverse=True, return_counts=True)
        total = np.bincount(back, often, len(cell)).astype(np.int64)
        first = order[np.flatnonzero(np.diff(run, prepend=-1))]
        size = (end - start)[first]
        off = np.concatenate([[0], np.cumsum(size)])
        data = low[np.repeat(start[first] - off[:-1], size) + np.arange(off[-1])]
        terms = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data.tobytes())])
        return cell // max(n_runs, 1), cell % max(n_runs, 1), texts, total, terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards() -> Iterator[pa.Table]:
            held, size = [], 0
            for b in batches:
                held.append(b)
                size += b.nbytes
                if size >= SHARD:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
            if held:
                yield pa.Table.from_batches(held)

        for t in shards():
            for s in slabs(t["text"], SHARD):
                part = t.slice(s.first, s.n)
                names = [part[c].combine_chunks().dictionary_encode() for c in ("lang", "source")]
                lang, source = (x.indices.to_numpy(False).astype(np.int64) for x in names)
                pairs, group = np.unique(lang << 32 | source, return_inverse=True)
                g, term, texts, total, terms = count(s, group, len(pairs))
                for i in range(0, len(g), 1 << 16):
                    c = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([names[0].dictionary.take(pa.array(pairs[g[c]] >> 32)), names[1].dictionary.take(pa.array(pairs[g[c]] & 0xFFFFFFFF)), terms.take(pa.array(term[c])).cast(pa.string()), pa.array(texts[c]), pa.array(total[c])], ["lang", "source", "term", "docs", "n"])

    return rows.mapInArrow(run, "lang string, source string, term string, docs long, n long")


def kept_counts(counts: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n) of the terms that at least ``least`` documents of the language have; n is over 0."""
    summed = counts.groupBy("lang", "term", "source").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    over = F.sum("docs").over(Window.partitionBy("lang", "term"))  # at most a row a source
    return summed.withColumn("docs", over).where(F.col("docs") >= least).select("lang", "source", "term", "n")


def share(n, total, v):
    """1 + floor(UNIT * (n + 5) / (total + 5 * v)), exact."""
    return (1 + F.expr(f"CAST({UNIT} AS DECIMAL(10, 0)) * CAST({n} + 5 AS DECIMAL(19, 0)) div CAST({total} + 5 * {v} AS DECIMAL(20, 0))")).cast("long")


def tile_distances(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, f) partial sums of |p_a - p_b| over blocks of terms, a and b the numbers of two sources.

    ``cells``: (lang, block, term_no, g, p) of terms that occur in the group; ``groups``: (lang, g, zero)
    with the share of terms that don't.  Both are dealt to (lang, block, tile of a, tile of b).
    """

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        lang = right["lang"][0]
        ids, zero = right["id"].to_numpy(), right["none"].to_numpy()
        order = np.argsort(ids)
        ids, zero = ids[order], zero[order]
        term, col = np.unique(left["term"].combine_chunks().dictionary_encode().indices.to_numpy(False), return_inverse=True)
        p = np.repeat(zero[:, None], len(term), 1)
        p[np.searchsorted(ids, left["g"].to_numpy()), col] = left["p"].to_numpy()
        low, high = right["low"][0].as_py(), right["high"][0].as_py()
        rows, cols = np.flatnonzero(ids // TILE == low), np.flatnonzero(ids // TILE == high)
        # kept terms of the block that occur in neither tile
        rest = right["terms"][0].as_py() - len(term)
        out = [(ids[a], ids[b], int(x) + rest * abs(int(zero[a] - zero[b]))) for a in rows for b, x in zip(cols, np.abs(p[cols] - p[a]).sum(1)) if low < high or a < b]
        a, b, f = (np.array(c, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table([pa.repeat(lang, len(a)), pa.array(a), pa.array(b), pa.array(f)], ["lang", "a", "b", "f"])

    tile = (F.col("g") / TILE).cast("long")
    tiles = groups.groupBy("lang").agg((F.max(tile) + 1).alias("tiles"), F.first("blocks").alias("blocks"))
    each = F.explode(F.expr("sequence(0L, tiles - 1)")).alias("other")
    deal = lambda df, *cols: df.select("lang", "block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), *cols)
    left = deal(cells.join(tiles.drop("blocks"), "lang").select("*", tile.alias("own"), each), "term", "g", "p")
    right = groups.join(tiles.drop("blocks"), "lang").select("*", tile.alias("own"), each).select("*", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    keys = ["lang", "block", "low", "high"]
    terms = cells.groupBy("lang", "block", "term").agg(F.count("*").alias("groups")).groupBy("lang", "block").agg(F.count("*").alias("terms"))
    right = right.join(terms, ["lang", "block"], "left").fillna(0, ["terms"])
    return left.groupBy(keys).cogroup(deal(right, F.col("g").alias("id"), F.col("zero").alias("none"), "terms").groupBy(keys)).applyInArrow(block, "lang string, a long, b long, f long")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): distances between the sources of a language, and each source's terms over its language's.

    Null text, language and source are empty strings; every row is a document, repeated ones too; a text
    of any length is counted whole; a group without terms has all shares of no occurrence; a language
    without kept terms has distances 0 and no terms; equal values are ranked by the item's UTF-8 bytes;
    other columns are not read; an empty table gives an empty result.
    """
    modest_batches(docs.sparkSession)
    kept = stored(kept_counts(shard_counts(docs, text_col, lang_col, source_col), least), "term-counts")
    occurring = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    v = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row a source
    groups = occurring.join(sums, ["lang", "source"], "left").join(v, "lang", "left").fillna(0, ["total", "v", "lang_n"]).withColumn("g", number.cast("long"))
    in_lang = F.count("*").over(Window.partitionBy("lang"))
    groups = groups.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("v") * F.least(in_lang, F.lit(2 * TILE)) / CELLS)).cast("long"))
    groups = stored(groups.withColumn("zero", F.when(F.col("v") > 0, share("0", "total", "v")).otherwise(F.lit(0))), "groups")
    seen = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "v"))

    cells = seen.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "term", "g", "p")
    parts = tile_distances(cells, groups.select("lang", "g", "zero", "blocks")).groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))
    names = groups.select("lang", "g", "source")
    both = parts.unionByName(parts.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "f"))
    pair = both.join(names.withColumnRenamed("g", "a"), ["lang", "a"]).join(names.select("lang", F.col("g").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", F.col("f").alias("value"))

    whole = kept.groupBy("lang", "term").agg(F.sum("n").alias("lang_count"))
    q = seen.join(whole, ["lang", "term"]).withColumn("q", share("lang_count", "lang_n", "v")).where("p > q")
    term = q.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= top))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents"))


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_P = f"1 + ({UNIT}::HUGEINT * ({{n}} + 5)) // ({{total}} + 5 * v)"
OP11_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
terms AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, '{_CAPITALS}', '{_SMALL}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
keep AS (SELECT lang, term, count(*) AS lang_count FROM terms GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST}),
langs AS (SELECT lang, count(*) AS v, sum(lang_count) AS lang_n FROM keep GROUP BY ALL),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN keep USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, {_P.format(n='coalesce(n, 0)', total='total')} AS p, {_P.format(n='lang_count', total='lang_n')} AS q
  FROM groups JOIN keep USING (lang) JOIN langs USING (lang) LEFT JOIN counts USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
over AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item))::INT AS rank FROM over) WHERE rank <= {TOP}
"""
