"""Operator 11 against its SQL and plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import DATA, connect, same
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import source_audit as A
from siltstone.llm.kernel import slabs

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


EIGHT = st.lists(st.sampled_from(["abcdefgh", "abcdefg", "ABCDEFGHi", "abcdefghabcdefgh", "abcdefghabcdefghz", "éééé", "ééééa", " ", "1"]), max_size=30).map("".join)


@given(st.lists(st.text(st.sampled_from("aAbBéÉzZ 1.\n-日"), max_size=60) | EIGHT, max_size=8))
@settings(max_examples=200, deadline=None)
def test_pointers_sort_terms(texts):
    for s in slabs(pa.array(texts, pa.string()), 1 << 20):
        low, start, end, doc = A.terms_of(s)
        words = [low[i:j].tobytes() for i, j in zip(start, end)]
        assert [w.decode() for w in words] == [w for t in texts for w in plain_terms(t)]
        order, run = A.sort_pointers(low, start, end)
        got = [words[i] for i in order]
        assert got == sorted(words)
        assert run.tolist() == np.cumsum([0, *(a != b for a, b in zip(got, got[1:]))]).tolist()[: len(got)]


def plain(rows, least, top):
    docs = [((l or ""), (s or ""), plain_terms(t or "")) for t, l, s in rows]
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, terms in docs:
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for t, n in df[lang].items() if n >= least)
        sources = sorted({d[1] for d in docs if d[0] == lang})
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        q = p(sum((counts[lang, s] for s in sources), Counter()))
        shares = {s: p(counts[lang, s]) for s in sources}
        for s in sources:
            pair = sorted(((-sum(abs(shares[s][t] - shares[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            term = sorted(((q[t] - shares[s][t], t.encode()) for t in kept if counts[lang, s][t] and shares[s][t] > q[t]))[:top]
            out += [(lang, s, part, item.decode(), -f, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (f, item) in enumerate(found)]
    return sorted(out)


ROWS = [("the cat The dog", "en", "b"), ("the ewe", "en", "a"), (None, "en", "c"), ("", "en", "a"), ("the the cat", "en", None), ("der die", None, "a"), ("der", "", "b"), ("zoo ZOO", "fr", "a"), ("the cat The dog", "en", "b"), ("ewe " * 4000, "en", "é"), ("antidisestablishmentarianism antidisestablishmentarians", "en", "a"), ("antidisestablishmentarianism", "en", "b")]


@pytest.mark.parametrize("tile, cells", [(A.TILE, A.CELLS), (2, 3)])
def test_odd_rows_tiles_and_blocks(spark, monkeypatch, tile, cells):
    monkeypatch.setattr(A, "TILE", tile)
    monkeypatch.setattr(A, "CELLS", cells)
    df = spark.createDataFrame([(i, *r, "x", 1, 0.5) for i, r in enumerate(ROWS)], "doc_id long, text string, lang string, source string, term string, n int, p double").repartition(3)
    for least in (1, 2, 99):
        assert sorted(map(tuple, A.divergence(df, least, 3).collect())) == plain(ROWS, least, 3)
    none = A.divergence(df.limit(0))
    assert none.columns == ["lang", "source", "part", "item", "value", "rank"] and not none.count()


def test_query_is_its_sql(spark):
    got = A.op11_source_divergence(spark, DATA).toPandas()
    same(got, connect(DATA).execute(A.OP11_SQL).df())
    assert set(got["part"]) == {"pair", "term"}
