"""Operator 13: whitening of embeddings with eigenvectors refined in mixed precision.

Entries become integers (``floor(scale * c)``), and the fit list holds each distinct integer vector once.
Two passes over it give exact moments: count and sums, then products of entries centred on the nearest
integer of their mean, whose sums are exact too; so the covariance does not depend on how rows are dealt
out.  The driver gets one row a pair of dimensions.  A float32 solver gives first eigenvectors; steps of
Ogita and Aishima (products and sums only) correct them in extended precision.  Where eigenvalues are
closer than a step can tell apart, the subspace of the cluster is solved for itself, on the matrix
shifted by its mean eigenvalue.  A third pass measures the whitened covariance of the fit list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import modest_batches, stored

SCALE = 256
#: The precision of the refinement: 80 bits where the machine has them.
WIDE = np.longdouble
#: Components with an eigenvalue under this share of the trace, times the dimension, are rounding.
NOISE = 1e-13


def clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of ``values`` in groups of two or more whose neighbours are at most ``gap`` apart."""
    order = np.argsort(values, kind="stable")
    cut = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [g for g in np.split(order, cut) if len(g) > 1]


def refine(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step for the symmetric ``a`` and approximate eigenvectors ``x`` (columns).

    Returns the corrected vectors, the eigenvalues, and the gap under which two of them count as one;
    vectors of such a cluster are only made orthonormal.
    """
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    gap = 2 * (np.linalg.norm((s - np.diag(values)).astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float)))
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > gap
    e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    return x + x @ e, values, float(gap)


def eigenvectors(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, correct to double precision."""
    d, size = len(v), float(np.abs(v).max(initial=0))
    if not size:
        return np.zeros(d), np.eye(d)
    a = v.astype(WIDE) / WIDE(size)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(WIDE)
    best, best_x, stale = np.inf, x, 0
    while stale < 3 and best > 1e-18:
        x, values, gap = refine(a, x)
        for group in clusters(values, gap):
            # within the cluster's subspace the shifted matrix is small, so a solver sees its eigenvalues apart
            part = x[:, group]
            small = part.T @ (a @ part - values[group].mean() * part)
            small = (small + small.T) / 2
            top = float(np.abs(small).max())
            if top > 0:
                x[:, group] = part @ np.linalg.eigh((small / top).astype(float))[1].astype(WIDE)
        s = x.T @ (a @ x)
        rest = float(np.abs(s - np.diag(np.diag(s))).max()) + float(np.abs(x.T @ x - np.eye(d)).max())
        stale = 0 if rest < best / 2 else stale + 1
        if rest < best:
            best, best_x = rest, x
    x = best_x
    for _ in range(2):  # what clusters have left of orthogonality
        x = x + x @ (np.eye(d, dtype=WIDE) - x.T @ x) / 2
    x /= np.sqrt((x * x).sum(0))
    values = np.diag(x.T @ (a @ x)) * WIDE(size)
    order = np.argsort(-values, kind="stable")
    return values[order].astype(float), x[:, order].astype(float)


def as_integers(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<long>) of rows whose vector is not null and has only finite entries."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))
    return table.where(v.isNotNull() & ~bad).select(F.col(id_col).alias("id"), whole.alias("x"))


def rows_of(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places of the rows, matrix) of a batch with a list column x, a dimension at a time."""
    x = b.column("x")
    n = pc.list_value_length(x).to_numpy(False)
    for d in np.unique(n):
        at = np.flatnonzero(n == d)
        yield int(d), at, x.take(pa.array(at)).flatten().to_numpy(False).astype(np.int64).reshape(len(at), int(d))


def centred_products(fit: DataFrame, centre: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Sums of products of all pairs of entries, each less its ``centre`` (an integer a dimension); exact below 2**53 a chunk."""
    shared = fit.sparkSession.sparkContext.broadcast(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in rows_of(b):
                if not d:
                    continue
                y = (x - shared.value[d]).astype(float)
                most = float(np.abs(y).max(initial=0)) ** 2
                step = max(1, int(2**52 // max(most, 1.0)))
                for i in range(0, len(y), step):
                    part = y[i : i + step].T @ y[i : i + step]
                    had = total.get(d)
                    if had is not None and max(np.abs(had).max(), np.abs(part).max()) < 2**52:
                        part = had + part
                    elif had is not None:
                        yield from spell(d, had)
                    total[d] = part
        for d, s in total.items():
            yield from spell(d, s)

    def spell(d: int, s: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = np.triu_indices(d)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d)), pa.array(i), pa.array(j), pa.array(s[i, j])], ["d", "i", "j", "s"])

    parts = fit.mapInArrow(run, "d long, i long, j long, s double")
    out = {d: np.zeros((d, d), WIDE) for d in centre}
    exact = F.expr("try_sum(try_cast(s AS decimal(38, 0)))")
    for r in parts.groupBy("d", "i", "j").agg(exact.cast("string").alias("s"), F.sum("s").alias("f")).toLocalIterator():
        out[r.d][r.i, r.j] = out[r.d][r.j, r.i] = WIDE(r.s) if r.s is not None else WIDE(r.f)
    return out


def fitted(fit: DataFrame, most: int) -> dict[int, dict]:
    """By dimension: n, sums, and the first ``most`` components with their eigenvalues, shares and the whitened covariance's error."""
    long = fit.select(F.size("x").alias("d"), F.posexplode("x").alias("i", "v")).groupBy("d", "i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38, 0)")).alias("s"))
    models: dict[int, dict] = {}
    for r in long.toLocalIterator():  # a row a dimension and entry
        models.setdefault(r.d, {"n": r.n, "s": [0] * r.d})["s"][r.i] = int(r.s)
    # the nearest integer of each mean
    centre = {d: np.array([(2 * s + m["n"]) // (2 * m["n"]) for s in m["s"]], np.int64) for d, m in models.items()}
    products = centred_products(fit, centre)
    for d, m in models.items():
        off = np.array([(WIDE(s - m["n"] * int(c))) / m["n"] for s, c in zip(m["s"], centre[d])], WIDE)
        v = products[d] / WIDE(m["n"]) - np.outer(off, off)
        e, u = eigenvectors(v)
        trace = float(np.trace(v))
        k = min(most, d)
        good = e[:k] > NOISE * d * trace
        m |= {"centre": centre[d], "off": off.astype(float), "u": u[:, :k] * np.where(good, 1 / np.sqrt(np.where(good, e[:k], 1)), np.nan), "explained": e[:k] / trace if trace > 0 else np.zeros(k), "good": good}
    errors = whitened_errors(fit, models)
    for d, m in models.items():
        m["error"] = errors.get(d, 0.0)
    return models


def whiten(x: np.ndarray, m: dict) -> np.ndarray:
    return ((x - m["centre"]).astype(float) - m["off"]) @ m["u"]


def whitened_errors(fit: DataFrame, models: dict[int, dict]) -> dict[int, float]:
    """By dimension: the largest entry of the whitened fit list's covariance less the identity, over components that are not rounding."""
    shared = fit.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for d, _, x in rows_of(b):
                if d:
                    w = whiten(x, shared.value[d])[:, shared.value[d]["good"]]
                    mean = w.mean(0)
                    held[d] = merged(held.get(d), [len(w), mean, (w - mean).T @ (w - mean)])
        for d, (n, mean, s) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([n]), pa.array([mean.tolist()], pa.list_(pa.float64())), pa.array([s.ravel().tolist()], pa.list_(pa.float64()))], ["d", "n", "mean", "s"])

    def merged(a: list | None, b: list) -> list:
        """Count, mean and centred products of two parts together."""
        if a is None:
            return b
        n, gap = a[0] + b[0], b[1] - a[1]
        return [n, a[1] + gap * b[0] / n, a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)]

    total: dict[int, list] = {}
    for r in fit.mapInArrow(run, "d long, n long, mean array<double>, s array<double>").toLocalIterator():  # a row a task and dimension
        k = len(r.mean)
        total[r.d] = merged(total.get(r.d), [r.n, np.array(r.mean), np.array(r.s).reshape(k, k)])
    return {d: float(np.abs(s / n - np.eye(len(mean))).max(initial=0)) for d, (n, mean, s) in total.items()}


def whitened(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = 4) -> DataFrame:
    """One row per remaining row of ``table`` and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null, NaN or infinite entries are dropped; an empty vector has no
    components and so no rows.  Vectors of different dimension are fitted apart.  Null and repeated ids
    are rows like others, equal vectors count once in the fit.  A component without variance has a null
    ``whitened`` and does not count for ``identity_error``; a ``deviation`` over 64 bits is null.  An
    empty table gives an empty result; other columns are not read.
    """
    modest_batches(table.sparkSession)
    rows = as_integers(table, id_col, vector_col)
    fit = stored(rows.where(F.size("x") > 0).groupBy("x").agg(F.count("*").alias("copies")).select("x"), "fit-list")
    models = fitted(fit, most)
    shared = table.sparkSession.sparkContext.broadcast(models)
    kind = dict(table.dtypes)[id_col]
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, at, x in rows_of(b):
                if not d:
                    continue
                m = shared.value[d]
                k, n = len(m["explained"]), len(x)
                s = np.array(m["s"], object)
                most = m["n"] * int(np.abs(x).max(initial=0)) + max(abs(v) for v in m["s"])
                if d * most * most < 1 << 63:
                    deviation = pa.array(((m["n"] * x - s.astype(np.int64)) ** 2).sum(1))
                else:
                    whole = ((m["n"] * x.astype(object) - s) ** 2).sum(1)
                    deviation = pa.array([v if v < 1 << 63 else None for v in whole], pa.int64())
                w = whiten(x, m)
                per = lambda a: pa.array(np.tile(a, n))  # noqa: E731  a value a component
                each = pa.array(np.repeat(np.arange(n), k))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)).take(each), per(np.arange(1, k + 1, dtype=np.int32)), pa.array(np.full(n * k, m["n"])), deviation.take(each), pa.array(w.ravel(), from_pandas=True), per(m["explained"]), pa.array(np.full(n * k, m["error"]))], names)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
