"""BLAKE3 against published digests and a plain form that follows the recursive definition."""

import numpy as np
from compare import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators import digests as D

# Published: the empty input, "abc", and inputs of n bytes 0, 1, ... 250, 0, 1, ...
KNOWN = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
}
ABC = "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


def of(texts):
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return [d.tobytes().hex() for d in D.blake3(np.frombuffer(b"".join(texts), np.uint8), off)]


def plain(data):
    """One text, one block after the other, the tree by recursion."""
    mask = 0xFFFFFFFF
    turn = lambda x, k: (x >> k | x << 32 - k) & mask

    def compress(h, block, counter, length, flags):
        m = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
        v = [*h, *map(int, D.IV[:4]), counter & mask, counter >> 32, length, flags]
        for _ in range(7):
            for k, (a, b, c, d) in enumerate(D.LANES):
                for x, r, s in ((m[2 * k], 16, 12), (m[2 * k + 1], 8, 7)):
                    v[a] = v[a] + v[b] + x & mask
                    v[d] = turn(v[d] ^ v[a], r)
                    v[c] = v[c] + v[d] & mask
                    v[b] = turn(v[b] ^ v[c], s)
            m = [m[i] for i in D.PERMUTATION]
        return [v[i] ^ v[i + 8] for i in range(8)]

    def node(part, first, root):
        if len(part) <= 1024:
            h, n = list(map(int, D.IV)), max(1, -(-len(part) // 64))
            for k in range(n):
                block = part[64 * k : 64 * k + 64]
                h = compress(h, block.ljust(64, b"\0"), first, len(block), (k == 0) + 2 * (k == n - 1) + 8 * (root and k == n - 1))
            return h
        left = 1024
        while left * 2 < len(part):
            left *= 2
        both = node(part[:left], first, False) + node(part[left:], first + left // 1024, False)
        return compress(list(map(int, D.IV)), b"".join(x.to_bytes(4, "little") for x in both), 0, 64, 4 + 8 * root)

    return b"".join(x.to_bytes(4, "little") for x in node(data, 0, True)).hex()


def test_published_digests():
    inputs = {n: bytes(i % 251 for i in range(n)) for n in KNOWN}
    assert of([*inputs.values(), b"abc"]) == [*KNOWN.values(), ABC]


def test_many_lengths_side_by_side():
    texts = [bytes((i * 7 + n) % 256 for i in range(n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 3072, 3073, 5000, 7168, 16384, 16385, 31744)]
    assert of(texts) == [plain(t) for t in texts]


@given(st.lists(st.binary(max_size=200), max_size=6))
@settings(max_examples=30, deadline=None)
def test_short_texts(texts):
    assert of(texts) == [plain(t) for t in texts]


def test_table(spark, monkeypatch):
    monkeypatch.setattr(D, "STRETCH", 5000)
    rows = [(1, None), (2, ""), (3, "abc"), (None, "日本" * 900), (3, "abc"), (4, "x" * 20_000)]
    got = D.content_digests(spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, id string").coalesce(1)).collect()
    assert [(r.doc_id, r.blake3) for r in got] == [(i, None if t is None else plain(t.encode())) for i, t in rows]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(20).collect()
    want = {r.doc_id: plain(r.text.encode()) for r in docs}
    assert {r.doc_id: r.blake3 for r in D.q_content_digests(spark, DATA).collect() if r.doc_id in want} == want
