"""Operator 4: a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is encoded from its character
classes, letters and repetition by a learned tanh layer; gated attention (tanh times sigmoid) weighs
the passages of a document, and a logistic unit scores the weighted mean.  All weights are learned
from document labels alone.  Fitting takes at most ``max_rows`` labelled documents (their passage
statistics, not their texts, reach the driver); scoring covers every passage of every document in the
task that reads it, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siltstone.sources.tables import load

from .kernel import Slab, slabs
from .quality_rules import labelled_sample

PASSAGE = 64

_PUNCT = b"#*$%&|<>!?.,;:'\"()[]{}-_/\\@=+~^`"
_N_CLASS = 5 + 26 + len(_PUNCT)
_CLASS = np.zeros(256, np.int64)  # 0: the rest
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[128:192] = 3  # continuation bytes
_CLASS[192:] = 4
_CLASS[97:123] = np.arange(5, 31)
_CLASS[list(_PUNCT)] = np.arange(31, 31 + len(_PUNCT))
WIDTH = _N_CLASS + 5


def passages(s: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of each passage of a slab and the text it belongs to; a text without words has one empty passage."""
    first = np.searchsorted(s.word_doc, np.arange(s.n))
    at = np.arange(len(s.word_doc)) - first[s.word_doc]
    per = np.maximum(1, -(-s.n_words // PASSAGE))
    base = np.concatenate([[0], np.cumsum(per)])
    of_word = base[s.word_doc] + at // PASSAGE
    n = int(base[-1])
    doc = np.repeat(np.arange(s.n), per)
    words = np.bincount(of_word, minlength=n)
    opens = of_word != np.concatenate([[-1], of_word[:-1]])
    edges = s.word_start[opens]
    lead = np.searchsorted(edges, np.arange(len(s.buf)), "right") - 1 if len(s.buf) < 1 << 16 else np.repeat(np.arange(-1, len(edges)), np.diff(np.concatenate([[0], edges, [len(s.buf)]])))
    pid = of_word[opens][np.maximum(lead, 0)] if len(edges) else np.zeros(0, np.int64)
    keep = (lead >= 0) & ~s.space if len(edges) else np.zeros(len(s.buf), bool)
    kinds = np.bincount(pid[keep] * _N_CLASS + _CLASS[s.buf[keep]], minlength=n * _N_CLASS).reshape(n, _N_CLASS) if len(edges) else np.zeros((n, _N_CLASS))
    lines = np.bincount(pid[(s.buf == 10) & (lead >= 0)], minlength=n) if len(edges) else np.zeros(n)
    size = np.maximum(kinds.sum(1), 1)
    w = np.maximum(words, 1)
    long = s.word_end - s.word_start
    rest = [np.log1p(words), size / w, np.bincount(of_word[s.repeated_words], minlength=n) / w, lines / w, np.bincount(of_word[long <= 2], minlength=n) / w]
    return np.concatenate([np.sqrt(kinds / size[:, None]), np.stack(rest, 1)], 1).astype(np.float32), doc


@dataclass(frozen=True)
class Attention:
    mean: np.ndarray
    std: np.ndarray
    w: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, doc: np.ndarray) -> dict[str, np.ndarray]:
        """x: passages in order of doc; doc: 0 to n - 1, each with a passage."""
        w = self.w
        seg = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        h = np.tanh(x @ w["enc"] + w["enc_b"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        e = (t * g) @ w["att"]
        e = np.exp(e - np.maximum.reduceat(e, seg)[doc])
        a = e / np.add.reduceat(e, seg)[doc]
        bag = np.add.reduceat(a[:, None] * h, seg)
        return {"seg": seg, "h": h, "t": t, "g": g, "a": a, "bag": bag, "p": 1 / (1 + np.exp(-np.clip(bag @ w["out"] + w["out_b"], -30, 30)))}

    def score(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return self.forward((x - self.mean) / self.std, doc)["p"]


def fit_attention(x: np.ndarray, doc: np.ndarray, y: np.ndarray, hidden: int = 24, gate: int = 12, steps: int = 160, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Attention:
    """Adam on the logistic loss over all bags at once; deterministic.  No bags: every score is 0.5."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"enc": draw(d, hidden), "enc_b": np.zeros(hidden, np.float32), "v": draw(hidden, gate), "u": draw(hidden, gate), "att": draw(gate), "out": draw(hidden), "out_b": np.zeros(1, np.float32)}
    if not len(y):
        return Attention(np.zeros(d, np.float32), np.ones(d, np.float32), {k: np.zeros_like(v) for k, v in w.items()})
    model = Attention(x.mean(0), x.std(0) + np.float32(1e-3), w)
    x = np.clip((x - model.mean) / model.std, -8, 8)
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        f = model.forward(x, doc)
        h, t, g, a = f["h"], f["t"], f["g"], f["a"]
        dl = ((f["p"] - y) / len(y)).astype(np.float32)
        dbag = (dl[:, None] * w["out"])[doc]
        da = (dbag * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, f["seg"])[doc])
        dgate = de[:, None] * w["att"]
        dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
        dh = (a[:, None] * dbag + dt @ w["v"].T + dg @ w["u"].T) * (1 - h * h)
        grad = {"enc": x.T @ dh, "enc_b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "att": (t * g).T @ de, "out": f["bag"].T @ dl, "out_b": dl.sum(keepdims=True)}
        for k in w:
            grad[k] = grad[k] + decay * w[k]
            m[k] = 0.9 * m[k] + 0.1 * grad[k]
            v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(id_col: str) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4000, **options) -> Attention:
    """Fit on at most ``max_rows`` labelled documents, none of them held out."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slabs(b.column("text")):
                x, doc = passages(s)
                cut = np.searchsorted(doc, np.arange(s.n + 1))
                x = x.astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(s.first, s.n).cast(pa.string()), b.column("y").slice(s.first, s.n), pa.array([x[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], ["id", "y", "x"])

    free = labels.where(~held_out(id_col))
    got = labelled_sample(docs, free, id_col, text_col, label_col, max_rows).mapInArrow(encode, "id string, y int, x binary").toPandas().sort_values("id")
    bags = [np.frombuffer(b, np.float16).reshape(-1, WIDTH) for b in got["x"]]
    x = np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, WIDTH), np.float32)
    return fit_attention(x, np.repeat(np.arange(len(bags)), [len(b) for b in bags]), got["y"].to_numpy(np.float32), **options)


def classify(docs: DataFrame, model: Attention, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the column ``score_col`` (0 to 1) added, or replaced where docs has one already.

    A null or empty text is scored as one empty passage; repeated rows get equal scores; null ids and
    any other column pass through untouched.
    """
    out = docs.drop(score_col)
    names = out.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = [model.score(*passages(s)) for s in slabs(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(score) if score else np.zeros(0), pa.float64())], [*names, score_col])

    return out.mapInArrow(run, StructType([*out.schema.fields, StructField(score_col, DoubleType())]))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (load(spark, sf_dir, t) for t in ("documents", "labels"))
    scored = classify(docs.select("doc_id", "text"), fit_classifier(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
