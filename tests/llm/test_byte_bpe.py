"""Operator 12 against the tiktoken library."""

import hashlib

import public_tokenizers
import tiktoken
from compare import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import bpe_fold as B

RANKS = B.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def encoded(df):
    return B.encode(df, RANKS, public_tokenizers.PATTERN)


def test_fold_of_words(spark):
    words = ["a", " the", "the", " naïve", "日本語", "'s", "aaaaaaaa", " antidisestablishmentarian", "!!??!!", "\n\n\n", " 1234567", "🙂🙂", "xyzzyxyzzy" * 15, ""]
    df = spark.createDataFrame([(w.encode(),) for w in words] + [(None,)], "word binary")
    got = {bytes(r[0]) if r[0] is not None else None: r[1] for r in df.select("word", B.fold_words(F.col("word"), RANKS)).collect()}
    assert got == {None: None, b"": []} | {w.encode(): LIBRARY._core_bpe.encode_single_piece(w.encode()) for w in words if w}


@given(st.text(st.sampled_from("aeinrst'd 0!\n\té日🙂"), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_long_words(word):
    assert B.merge_long(word.encode(), RANKS) == LIBRARY._core_bpe.encode_single_piece(word.encode())


def test_rank_table_holds_every_pair():
    pairs = B.pair_ranks(RANKS)
    table = B.rank_table(pairs)
    first, second = B.SLOTS
    for pair, rank in list(pairs.items())[::97]:
        assert pair << B.ID_BITS | rank in (table[pair % first], table[first + pair % second])


def test_odd_rows(spark, odd, empty):
    got = encoded(odd).collect()
    rows = odd.select("doc_id", "text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.ids) for r in got), key=key) == sorted(((r.doc_id, LIBRARY.encode_ordinary(r.text or "")) for r in rows), key=key)
    assert encoded(empty).columns == ["doc_id", "ids"] and not encoded(empty).count()


def test_characters_newer_than_javas_and_rare_white_space(spark):
    texts = ["a b   c\x1c\x1d d\x85e", "new letter \U00031350\U00031351 and word", "　　x  ", "a" * 5000 + " " * 700 + "b", "\r\n \r\n", "it's IT'S we've 12³ ½x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.ids for r in encoded(df).collect()} == {i: LIBRARY.encode_ordinary(t) for i, t in enumerate(texts)}


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 200)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        texts = [f"word{i % 7} of block {i} und the rest{i}" for i in range(50)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
        assert {r.doc_id: r.ids for r in encoded(df).collect()} == {i: LIBRARY.encode_ordinary(t) for i, t in enumerate(texts)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_share_words(spark, monkeypatch):
    """A word is folded once in a task, unless its dictionary is full; one Python worker puts ids together and decodes them."""
    monkeypatch.setattr(B, "BLOCK", 200)
    texts = ["", *(f"shared words of every block and own{i}" + "z" * 300 * (i % 9 == 0) for i in range(60)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for keep, times in ((1_000_000, 1), (20, 2)):
            monkeypatch.setattr(B, "KEEP", keep)
            rows = B.block_rows(B.cut_words(df, public_tokenizers.PATTERN, "doc_id", "text"), RANKS, public_tokenizers.PATTERN)
            folded = rows.where("codes IS NULL AND ids IS NULL").groupBy("state").count().agg(F.max("count")).first()[0]
            assert folded == 1 if times == 1 else folded >= times
            got = B.encode(df, RANKS, public_tokenizers.PATTERN, bytes_col="decoded")
            assert {r.doc_id: (r.ids, bytes(r.decoded)) for r in got.collect()} == {i: (LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts)}
            assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_decode(spark):
    df = spark.createDataFrame([(1, LIBRARY.encode_ordinary("héllo, 日本")), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded if r.decoded is None else bytes(r.decoded) for r in B.decode(df, RANKS).collect()} == {1: "héllo, 日本".encode(), 2: b"", 3: None}


def test_query_is_the_librarys(spark):
    got = {r.doc_id: r for r in B.op12_byte_bpe(spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = LIBRARY.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256, g.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
