"""Operators 2, 3 and 5, and the pipeline."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import packing, sentencepiece_lattice, token_files
from siltstone.llm.storage import scratch, stored
from siltstone.llm.tokens import Encoder

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ENCODER, PLAIN = Encoder(BPE), Tokenizer.from_file(BPE)
ALPHABET = st.sampled_from(["a", "Bc", "é", " ", "  ", "\n", "\t", "'s", "9", "!", "#$", "\xa0", "　", "<|endoftext|>", "日本", "word,", " naïve", "Ünder.", ".\"", ")]", "x;y", "ªb", "\r\n", "_", "\x1c", "\x85", "\0", "▁"])
TEXT = st.lists(ALPHABET, max_size=14).map("".join)


@given(st.lists(TEXT, max_size=4))
@settings(max_examples=300, deadline=None)
def test_chunked_ids_are_the_librarys(texts):
    assert [np.frombuffer(x, ENCODER.dtype).tolist() for x in ENCODER.encode(texts)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_ids_over_16_bits_keep_all_bits():
    class Wide:
        dtype = np.dtype("<u4")

    ids = [np.array([1, 70_000, 1 << 23], "<u4"), np.array([], "<u4"), np.array([65_536], "<u4")]
    names = token_files.planes_of(Wide)
    b = pa.RecordBatch.from_arrays(token_files.split_planes(np.concatenate(ids), np.array([len(x) for x in ids]), len(names)), names)
    assert token_files.join_planes(b, names).tolist() == [1, 70_000, 1 << 23, 65_536] and len(names) == 3


@given(st.lists(st.integers(0, 300), max_size=600), st.integers(9, 18))
@settings(deadline=None)
def test_huffman_round_trip(ids, limit):
    ids = np.array(ids, np.uint16) ** 2 % 301
    lengths = token_files.code_lengths(np.bincount(ids, minlength=301), limit)
    assert lengths.max(initial=0) <= limit and (not len(ids) or sum(2.0 ** -int(x) for x in lengths[lengths > 0]) <= 1)
    bits, checks = token_files.pack(ids, token_files.canonical(lengths), lengths)
    assert token_files.unpack(bits, checks, len(ids), token_files.lookup(lengths)).tolist() == ids.tolist()


def test_code_lengths_are_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 0])
    assert token_files.code_lengths(counts, 18).tolist() == [6, 6, 5, 4, 3, 2, 1, 0]
    assert token_files.code_lengths(counts, 3).max() == 3


def want_ids(rows, end):
    return [(i, [*PLAIN.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows]


def test_token_files(spark, odd, empty):
    to = scratch(spark, "files")
    token_files.write_token_files(odd, BPE, to)
    got = token_files.read_token_files(spark, to, with_ids=True).toPandas().sort_values("start")
    want = want_ids([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], 2)
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((None if i != i else int(i), list(x)) for i, x in zip(got["doc_id"], got["ids"])), key=key) == sorted(want, key=key)
    assert got["start"].tolist() == (np.cumsum(got["n_tokens"]) - got["n_tokens"]).tolist()
    ids = got["doc_id"].dropna().tolist()
    assert ids == sorted(ids) and got["doc_id"].isna().tolist()[0]
    assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in got["ids"]] == got["ids_crc32"].tolist()
    to = scratch(spark, "files")
    token_files.write_token_files(empty, BPE, to)
    assert token_files.read_token_files(spark, to).count() == 0


@given(st.lists(st.integers(1, 64), max_size=120))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_piece_once(lengths):
    h = np.bincount(lengths, minlength=65)
    p = packing.plan(h, 64)
    taken = {}
    for v in np.unique(lengths):
        seq, off = p.place(np.full(h[v], v), np.arange(h[v]))
        for s, o in zip(seq, off):
            taken.setdefault(int(s), []).append((int(o), int(v)))
    assert sum(map(len, taken.values())) == len(lengths) and len(taken) == p.sequences
    for spans in taken.values():
        at = 0
        for o, v in sorted(spans):
            assert o == at
            at += v
        assert at <= 64
    low = -(-sum(lengths) // 64)
    assert p.sequences <= low * 1.3 + 2


@pytest.mark.parametrize("rows", [packing.SALT_ROWS, 1])
def test_pack_documents(odd, empty, monkeypatch, rows):
    monkeypatch.setattr(packing, "SALT_ROWS", rows)  # with 1 a frequent length is dealt to more tasks
    monkeypatch.setattr(packing, "SALTS", 2)
    got = packing.pack_documents(odd, BPE).toPandas()
    assert len(got.groupby("sequence_id").length.sum()) and got.groupby("sequence_id").length.sum().max() <= 2048
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all()
    want = sorted(len(x) for _, x in want_ids([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], 0))
    assert sum(want) == got.length.sum() and (got[got.piece > 0].length == 2048).all() and (got.piece == 0).sum() == len(want)
    assert packing.pack_documents(empty, BPE).count() == 0


def test_lattice_is_sentencepiece(spark, odd, empty):
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = np.random.default_rng(4)
    parts = ["a", "é", " ", "  ", "\n", "the", "ing", "tion", "9", "!", "日本", "①", "▁", "\0", "x" * 70, "abcdefghij" * 9]
    rows = [(i, "".join(rng.choice(parts, rng.integers(0, 14)))) for i in range(300)]
    coded = stored(sentencepiece_lattice.encode(spark.createDataFrame(rows, "doc_id long, text string"), PIECES), "coded")
    assert {r.doc_id: list(r.ids) for r in coded.collect()} == {i: m.encode(t) for i, t in rows}
    assert {r.doc_id: r.text for r in sentencepiece_lattice.decode(coded, PIECES).collect()} == {i: t.replace("▁", " ") for i, t in rows}
    got = sentencepiece_lattice.encode(odd, PIECES).collect()
    text = {r.doc_id: r.text for r in odd.collect()}
    assert len(got) == odd.count() and all(list(r.ids) == m.encode(text[r.doc_id] or "") and r.n_tokens == len(r.ids) for r in got)
    assert sentencepiece_lattice.encode(empty, PIECES).count() == 0


def test_merge_long():
    assert sentencepiece_lattice.merge_long(4, [(0, 2, 1), (2, 2, 0), (1, 2, 2)]) == [(0, 2), (2, 4)]


def test_units_of_62_and_63_characters(spark):
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(n, "the" * 30 if not n else ("thingsand" * 9)[: n - 1]) for n in (0, 61, 62, 63, 64)]  # with the prefix, n characters
    got = sentencepiece_lattice.encode(spark.createDataFrame(rows, "doc_id long, text string"), PIECES).collect()
    assert {r.doc_id: r.ids for r in got} == {i: m.encode(t) for i, t in rows}


def test_lattice_moves_no_codes(spark):
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = [(i, f"many words, of some texts; number {i}.") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    plan = sentencepiece_lattice.encode(docs, PIECES)._jdf.queryExecution().executedPlan().toString()
    codes = plan[plan.rindex("Sort [part") :]  # the second side of the cogroup
    assert "codes" in codes and "Bucketed: true" in codes and "Exchange" not in codes
    got = sentencepiece_lattice.encode(docs, PIECES, decoded_col="decoded").collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in got} == {i: (m.encode(t), t) for i, t in rows}


@pytest.mark.parametrize("ranks", [{"ab": 0, "bc": 1, "abc": 2, "aa": 3, "abcaa": 4}, {"ab": 5, "bc": 6, "abc": 1, "ca": 0, "aab": 2, "cab": 7}])
def test_folds_merge_in_order(spark, ranks):
    rows = [(p, i, r) for i, (p, r) in enumerate([("a", 20), ("b", 21), *ranks.items()])]  # c is no piece
    assert sentencepiece_lattice.in_rank_order(rows) == (ranks["abc"] == 2)
    rng = np.random.default_rng(5)
    units = sorted({"".join(rng.choice(list("abc"), n)) for n in range(1, 30) for _ in range(8)})
    got = sentencepiece_lattice.encode_units(spark.createDataFrame(list(enumerate(units)), "at long, unit string"), rows, 100).collect()
    ids = {p: [i] for p, i, _ in rows} | {"c": [100 + ord("c")]}

    def want(u):
        edges = [(s, len(p), r) for s in range(len(u)) for p, r in ranks.items() if u.startswith(p, s)]
        return [i for a, b in sentencepiece_lattice.merge_long(len(u), edges) for i in ids[u[a:b]]]

    assert {r.at: r.ids for r in got} == {k: want(u) for k, u in enumerate(units)}


def test_pipeline(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns and docs.count() <= n
        n = docs.count()
    out = p.STAGES[-1][1](spark, docs, sf)
    assert stored(p.quality_classifier(spark, docs, sf), "again").count() <= n
    assert out.select("doc_id").distinct().count() == n
    for name, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_stages_take_odd_rows(spark, odd):
    import corpus_pipeline as p

    sf, n = "/root/testdata/sf0.001", odd.count()
    wide = odd.selectExpr("*", "1 AS n_chars", "2 AS `quality score`", "3 AS _id", "4 AS _key", "5 AS node")
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, wide, sf)
        assert got.columns == wide.columns and got.count() <= n, name
    by_id = lambda df: {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
    assert by_id(p.near_duplicate_join(spark, wide, sf)) == {r for r in by_id(odd) if r[0] != 7}
    assert p.line_dedup(spark, wide, sf).count() == p.pseudonyms(spark, wide, sf).count() == n
    assert p.packing(spark, wide, sf).where("piece = 0").count() == n


def test_entry_has_all_operators():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert all(sum(x.startswith(f"op{n}_") for x in names) == 1 for n in range(1, 11)) and "pipeline" in names
