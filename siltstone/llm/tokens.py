"""Whole texts to ids of a byte-level BPE tokenizer, through the tokenizers library.

The tokenizer's pattern never joins characters across a single space between two non-space
characters, so a text falls into chunks there and a chunk's ids do not depend on its neighbours.  A
slab of texts is cut into chunks by numpy passes over its bytes; each chunk is known by a 64-bit hash,
checked by its length and first bytes.  Each Python worker keeps a table of the chunks it has met (at
most ``KEEP``, about 40 bytes each) and sends the library only new ones; the ids of a text are those of
its chunks side by side.  A new chunk that is a word in Latin letters, with punctuation behind it or
without, is split there as the pattern would, and goes straight to the library's BPE model.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .kernel import Slab, slabs
from .worker import kept

KEEP = 2_000_000
SLAB = 1 << 20
#: White space other than space and line feed, as Unicode and Python have it.
_OTHER = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_PLAIN = re.compile(r" ?\S+\Z")
#: A word in Latin letters and the punctuation behind it: two units of the GPT-2 pattern, whatever stands around them.
_WORD = re.compile(r'( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([.,;:!?)"\]]*)\Z')
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
_GAP = re.compile(r"(?<=\S) (?=\S)")
_ODD = np.zeros(256, bool)
_ODD[[0, 9, 11, 12, 13, 28, 29, 30, 31]] = True
#: The multi-byte ones of ``_OTHER``, as numbers.
_WIDE = np.array(sorted(int.from_bytes(c.encode(), "big") for c in _OTHER if ord(c) > 127))


def _byte_alphabet() -> dict[int, str]:
    """The characters that byte-level BPE writes for bytes: printable ones stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids as little-endian unsigned ``dtype`` numbers; ``dtype`` is uint16 where the vocabulary fits."""

    def __init__(self, path: str, keep: int = KEEP):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.n_ids = max(self.tokenizer.get_vocab().values()) + 1
        self.dtype = np.dtype("<u2" if self.n_ids <= 1 << 16 else "<u4")
        self.keep = keep
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.tail: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        #: Whether words may go to the library's model as they are, without its pattern.
        self.direct = spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.alphabet = {b: c for b, c in _byte_alphabet().items() if b != 10}
        self.clear()

    def clear(self) -> None:
        """The table: keys in order, a check of each, and where its ids stand in ``flat``."""
        self.keys, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.dtype)

    def _words(self, new: list[str], got: dict[str, bytes]) -> list[str]:
        """Learn the words among new chunks through the library's model; the chunks that are none."""
        rest, words, tails = [], [], []
        for c in new:
            if m := _WORD.match(c):
                words.append(m[1]), tails.append(m[2])
            else:
                rest.append(c)
        stems = list(dict.fromkeys(words))
        if stems:
            joined = "\n".join(stems)
            spelled = joined.replace(" ", "\u0120") if joined.isascii() else joined.encode().decode("latin-1").translate(self.alphabet)
            tokenize = self.tokenizer.model.tokenize
            ids = [[t.id for t in tokenize(w)] for w in spelled.split("\n")]
            cut = (np.cumsum([len(x) for x in ids]) * self.dtype.itemsize).tolist()
            data = np.fromiter(itertools.chain.from_iterable(ids), self.dtype).tobytes()
            got.update(zip(stems, [data[i:j] for i, j in zip([0, *cut], cut)]))
        for tail in set(tails):
            if tail not in self.tail:
                self.tail[tail] = np.array(self.tokenizer.encode(tail, add_special_tokens=False).ids if tail else [], self.dtype).tobytes()
        got.update([(w + t, got[w] + self.tail[t]) for w, t in zip(words, tails) if t])
        return rest

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of chunks.  Those without inner white space that are no words go in as lines of one text, whose line feeds are tokens of their own."""
        got: dict[str, bytes] = {}
        joined = "\n".join(new)
        alone = {c for c in new if any(a in c for a in self.added)} if any(a in joined for a in self.added) else set()
        new = [c for c in new if c not in alone]
        if self.direct:
            new = self._words(new, got)
        alone.update(c for c in new if not _PLAIN.match(c))
        new = [c for c in new if c not in alone]
        for chunk, e in zip(alone, self.tokenizer.encode_batch_fast(list(alone), add_special_tokens=False)):
            got[chunk] = np.array(e.ids, self.dtype).tobytes()
        size = self.dtype.itemsize
        lines = [new[k : k + 200] for k in range(0, len(new), 200)]
        for part, e in zip(lines, self.tokenizer.encode_batch_fast(["\n".join(p) for p in lines], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            data, cut = ids.tobytes(), (np.flatnonzero(ids == self.feed) * size).tolist()
            got.update(zip(part, [data[i:j] for i, j in zip([0, *(c + size for c in cut)], [*cut, len(data)])]))
        return got

    def odd(self, s: Slab) -> np.ndarray:
        """Which texts hold white space other than single spaces and line feeds between words."""
        white = (s.buf == 32) | (s.buf == 10)
        at = [np.flatnonzero(_ODD[s.buf] | white & np.concatenate([[True], white[:-1]]) & (len(white) > 0))] if len(s.buf) else []
        full = s.off[:-1] < s.off[1:]
        for edge in (s.off[:-1][full], s.off[1:][full] - 1):
            at.append(edge[white[edge]])
        lead = np.flatnonzero((s.buf == 0xC2) | (s.buf >= 0xE1) & (s.buf <= 0xE3))
        padded = np.concatenate([s.buf, np.zeros(2, np.uint8)]).astype(np.int64)
        code = np.where(s.buf[lead] == 0xC2, padded[lead] << 8 | padded[lead + 1], padded[lead] << 16 | padded[lead + 1] << 8 | padded[lead + 2])
        at.append(lead[np.isin(code, _WIDE)])
        out = np.zeros(s.n, bool)
        out[np.searchsorted(s.off, np.concatenate(at), "right") - 1] = True
        return out

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Pieces that the tokenizer treats alone; side by side they are the text."""
        return [text] if "\0" in text else _LINE.sub("\0\n\0", _GAP.sub("\0 ", text)).split("\0")

    def _slab(self, s: Slab) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slab's texts end to end, and how many each has."""
        if not len(s.buf):
            return np.zeros(0, self.dtype), np.zeros(s.n, np.int64)
        opens = (s.buf == 32) | (s.buf == 10)
        opens[1:] |= s.buf[:-1] == 10
        opens[s.off[:-1][s.off[:-1] < len(s.buf)]] = True
        first = np.flatnonzero(opens)
        end = np.append(first[1:], len(s.buf))
        key = s.span_hash(first, end)
        length = (end - first).astype(np.uint64)
        eight = np.ndarray((len(s.buf),), "<u8", np.concatenate([s.buf, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))[first]
        check = (eight & np.where(length < 8, (np.uint64(1) << np.minimum(length, 7) * np.uint64(8)) - np.uint64(1), ~np.uint64(0))) ^ length << np.uint64(40)
        uniq, at, back = np.unique(key, return_index=True, return_inverse=True)
        if (check[at][back] != check).any():  # two chunks with one hash
            return self._texts([s.text(i) for i in range(s.n)])
        pos = np.minimum(np.searchsorted(self.keys, uniq), max(len(self.keys) - 1, 0))
        same = self.keys[pos] == uniq if len(self.keys) else np.zeros(len(uniq), bool)
        hit = same & (self.check[pos] == check[at]) if len(self.keys) else same
        start, size, flat = np.zeros(len(uniq), np.int64), np.zeros(len(uniq), np.int64), self.flat
        start[hit], size[hit] = self.start[pos[hit]], self.size[pos[hit]]
        if not hit.all():
            miss, data = np.flatnonzero(~hit), s.buf.tobytes()
            new = [data[i:j].decode() for i, j in zip(first[at[miss]].tolist(), end[at[miss]].tolist())]
            got = self._learn(new)
            ids = [got[c] for c in new]
            size[miss] = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
            start[miss] = len(flat) + np.cumsum(size[miss]) - size[miss]
            flat = np.concatenate([flat, np.frombuffer(b"".join(ids), self.dtype)])
            keep = miss[~same[miss]]
            keys = np.concatenate([self.keys, uniq[keep]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.flat = keys[order], flat
            self.check, self.start, self.size = (np.concatenate(x)[order] for x in ((self.check, check[at[keep]]), (self.start, start[keep]), (self.size, size[keep])))
            if len(self.keys) > self.keep:
                self.clear()
        n = size[back]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(start[back] - upto[:-1], n) + np.arange(upto[-1])]
        return ids, np.diff(upto[np.searchsorted(first, s.off)])

    def _texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``_slab``, text by text."""
        cut = [self.chunks(t) if t else [] for t in texts]
        got = self._learn(list(set().union(*cut)))
        ids = [np.frombuffer(b"".join(got[c] for c in x), self.dtype) for x in cut]
        return np.concatenate([*ids, np.zeros(0, self.dtype)]), np.array([len(x) for x in ids], np.int64)

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids end to end, how many of each row) of the slabs of a string column; a null is an empty text."""
        for s in slabs(texts, SLAB, keep_worker=True):
            ids, n = self._slab(s)
            odd = np.flatnonzero(self.odd(s))
            if len(odd):
                parts = np.split(ids, np.cumsum(n)[:-1])
                other, m = self._texts([s.text(i) for i in odd])
                for i, x in zip(odd, np.split(other, np.cumsum(m)[:-1])):
                    parts[i] = x
                ids, n = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
            yield s.first, ids, n

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        out: list[bytes] = []
        for _, ids, n in self.encode_column(pa.array(texts, pa.string())):
            out += [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])]
        return out


def with_end(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` behind each text, and the new counts."""
    return np.insert(ids, np.cumsum(n), ids.dtype.type(end_id)), n + 1


def encoder(path: str) -> Encoder:
    """The Python worker's own encoder: its chunks serve all tasks of tokenising that the worker runs."""
    return kept(("encoder", path), lambda: Encoder(path))
