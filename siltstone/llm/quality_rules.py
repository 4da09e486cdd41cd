"""Operator 10: quality rules as gradient-boosted trees over document statistics.

``document_stats`` gives exact per-document counts.  ``fit_rules`` grows depth-limited regression
trees on the logistic loss from a bounded labelled sample (``max_rows``), with monotone constraints
on chosen features, and flattens them into numpy node arrays; ``apply_rules`` scores every document
in the task that counted it, so the corpus is read once and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.tables import load

from .kernel import Slab, slabs

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "bang_share", "bar_share", "comma_stop_share", "short_line_share", "mean_line_words")
#: -1: a larger value never raises the score.
MONOTONE = {"symbol_share": -1, "dup_line_share": -1, "repeat_share": -1}

_SYMBOL, _UPPER, _DIGIT, _BANG, _BAR, _STOP = (np.zeros(256, bool) for _ in range(6))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_BANG[list(b"!?")] = True
_BAR[list(b"|")] = True
_STOP[list(b",.;:")] = True


def slab_stats(s: Slab) -> tuple[np.ndarray, np.ndarray]:
    """Counts (n x 5, integers) and features (n x 12) of a slab's texts."""
    start, end, doc, again = s.lines
    solid = ~s.space
    chars = s.count(solid & ((s.buf & 0xC0) != 0x80))
    dup, lines = np.bincount(doc[again], minlength=s.n), np.bincount(doc, minlength=s.n)
    line_words = np.searchsorted(s.word_start, end) - np.searchsorted(s.word_start, start)
    short = np.bincount(doc[line_words < 5], minlength=s.n)
    repeat = np.bincount(s.word_doc[s.repeated_words], minlength=s.n)
    counts = np.stack([s.n_words, chars, s.count(_SYMBOL[s.buf]), dup, repeat], 1).astype(np.int64)
    w, c, ln = np.maximum(s.n_words, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    share = lambda table: s.count(table[s.buf]) / c
    feats = np.stack([np.log1p(s.n_words), chars / w, counts[:, 2] / c, dup / ln, repeat / w, share(_UPPER), share(_DIGIT), share(_BANG), share(_BAR), share(_STOP), short / ln, s.n_words / ln], 1)
    return counts, feats


@dataclass(frozen=True)
class Forest:
    """Trees laid end to end: a leaf has ``feature`` -1 and itself as both children."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                go_left = x[rows, np.maximum(f, 0)] <= self.cut[at]
                at = np.where(go_left, self.left[at], self.right[at])
            z += self.value[at]
        return 1 / (1 + np.exp(-z))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, monotone: dict[int, int] | None = None) -> Forest:
    """Boost ``trees`` trees on the logistic loss.

    A split on a constrained feature is taken only if its children's values are ordered as asked, and
    the mid of those values bounds each child's subtree, so a tree, and with it the sum, is monotone.
    One label only, or no rows, gives the constant base score.
    """
    monotone = monotone or {}
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    p0 = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    base = float(np.log(p0 / (1 - p0)))
    d = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(d)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)], 1) if len(x) else np.zeros((0, d), int)
    z = np.full(len(y), base)

    def node(rows: np.ndarray, level: int, lo: float, hi: float, g: np.ndarray, h: np.ndarray) -> int:
        k = len(feature)
        leaf = lambda a, b: float(np.clip(-a / (b + l2), lo, hi))
        feature.append(-1), cut.append(0.0), left.append(k), right.append(k), value.append(rate * leaf(g[rows].sum(), h[rows].sum()))
        if level == depth or len(rows) < 20:
            return k
        best = (1e-6, -1, 0)
        gs, hs = g[rows].sum(), h[rows].sum()
        for j in range(d):
            if not len(cuts[j]):
                continue
            n = len(cuts[j]) + 1
            gl, hl = (np.cumsum(np.bincount(code[rows, j], v[rows], n))[:-1] for v in (g, h))
            nl = np.cumsum(np.bincount(code[rows, j], minlength=n))[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + l2), lo, hi), np.clip(-gr / (hr + l2), lo, hi)
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs**2 / (hs + l2)
            ok = (nl >= 10) & (len(rows) - nl >= 10)
            if monotone.get(j):
                ok &= monotone[j] * (vr - vl) >= 0
            gain = np.where(ok, gain, -1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), j, i)
        _, j, i = best
        if j < 0:
            return k
        to_left = code[rows, j] <= i
        a, b = rows[to_left], rows[~to_left]
        bounds = (lo, hi, lo, hi)
        if monotone.get(j):
            mid = (leaf(g[a].sum(), h[a].sum()) + leaf(g[b].sum(), h[b].sum())) / 2
            bounds = (lo, mid, mid, hi) if monotone[j] > 0 else (mid, hi, lo, mid)
        feature[k], cut[k] = j, float(cuts[j][i])
        left[k] = node(a, level + 1, *bounds[:2], g, h)
        right[k] = node(b, level + 1, *bounds[2:], g, h)
        return k

    if len(y) and 0 < y.sum() < len(y):
        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            roots.append(node(np.arange(len(y)), 0, -4.0, 4.0, p - y, p * (1 - p)))
            f = Forest(*map(np.array, (feature, cut, left, right, value)), np.array(roots[-1:]), depth, 0.0)
            s = f.score(x)
            z += np.log(s / (1 - s))
    return Forest(np.array(feature, np.int64), np.array(cut, float), np.array(left, np.int64), np.array(right, np.int64), np.array(value, float), np.array(roots, np.int64), depth, base)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled texts (id, text, y), the same ones on every run: lowest hashes of the id."""
    some = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    some = some.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_rows)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    # of several texts with one id the one with the least hash, whatever the order of tasks
    one = found.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return one.select("id", "text", "y")


def fit_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, **options) -> Forest:
    """Fit on at most ``max_rows`` labelled documents; only their statistics reach the driver."""

    def stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slabs(b.column("text")):
                f = slab_stats(s)[1]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(s.first, s.n).cast(pa.string()), b.column("y").slice(s.first, s.n), pa.array(f.tolist(), pa.list_(pa.float64()))], ["id", "y", "f"])

    got = labelled_sample(docs, labels, id_col, text_col, label_col, max_rows).mapInArrow(stats, "id string, y int, f array<double>").toPandas().sort_values("id")
    x = np.array(got["f"].tolist(), float).reshape(-1, len(FEATURES))
    return grow(x, got["y"].to_numpy(float), monotone={FEATURES.index(k): v for k, v in MONOTONE.items()}, **options)


def apply_rules(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, max_repeat: int = 20) -> DataFrame:
    """One row per row of ``docs``: id, the counts, base_failed, score and kept.

    Words are runs of characters other than space and U+0009 to U+000D.  A null text counts as empty
    (no words: base_failed); a null id stays null; repeated rows give repeated results; other columns
    are not read.  base_failed: fewer than ``min_words`` words, or 100 * n_repeat_words >
    ``max_repeat`` * n_words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slabs(b.column("text")):
                counts, feats = slab_stats(s)
                failed = (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat * counts[:, 0])
                score = forest.score(feats)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(s.first, s.n), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(score), pa.array(~failed & (score >= 0.5))],
                    ["id", *STATS, "base_failed", "score", "kept"],
                )

    kind = dict(docs.dtypes)[id_col]
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {', '.join(f'{k} long' for k in STATS)}, base_failed boolean, score double, kept boolean")
    return out.withColumnRenamed("id", id_col)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (load(spark, sf_dir, t) for t in ("documents", "labels"))
    return apply_rules(docs, fit_rules(docs, labels))
