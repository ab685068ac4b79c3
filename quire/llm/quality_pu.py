"""Quality scores by positive-unlabelled learning.

Trusted positives are training rows labelled 1; every document is unlabelled text. With prior
``pi`` and the logistic loss, the unbiased risk of a linear score z is
``pi * E_p[l(z)] + (E_u[l(-z)] - pi * E_p[l(-z)])``; the bracket estimates the risk on negatives and
is kept non-negative: while it is below zero, steps go against it instead. Labels of 0 are not used.

Text statistics are extracted once to a small shared table. Newton steps sum gradient and curvature
over *all* rows of it, so only a fixed-size sum reaches the driver. The prior is estimated from the
scores of a fit on one half of the positives: the share of unlabelled text above a threshold over
that of the other half approaches the prior where no negatives are left, and the least is taken over
all thresholds that keep half of the positives. Where so few rows are positive that a half has none,
the prior stays at 0.5.

``max_positives`` bounds the labelled rows used (by hash of doc_id, at most about that many).

Defined results: null and empty texts have all statistics zero and a score like any other, very long
ones are read whole; without any positive every score is 0; repeated rows are scored each, equal texts
alike, and a doc_id that labels repeat counts once; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, values

LOWER, UPPER, DIGIT, SPACE, LINE, POINT, LOUD, SIGN, HIGH = range(9)
_class = np.full(256, SIGN, np.int8)
_class[97:123], _class[65:91], _class[48:58], _class[128:] = LOWER, UPPER, DIGIT, HIGH
_class[[9, 11, 12, 13, 32]], _class[10] = SPACE, LINE
_class[[ord(c) for c in ".,;:'\"()-"]], _class[[ord(c) for c in "!?"]] = POINT, LOUD
N_FEATURES = 38


def features(text: bytes | None) -> np.ndarray:
    """Fixed statistics of a whole text, each of moderate size."""
    out = np.zeros(N_FEATURES)
    words = (text or b"").split()
    if not words:
        return out
    cls = _class[np.frombuffer(text, np.uint8)]
    n, n_words = len(cls), len(words)
    share = np.bincount(cls, minlength=9) / n
    blank = (cls == SPACE) | (cls == LINE)
    ends = np.flatnonzero(np.append(blank[1:], True) & ~blank)
    begins = np.flatnonzero(np.append(True, blank[:-1]) & ~blank)
    size = ends - begins + 1
    last = np.bincount(cls[ends], minlength=9) / n_words
    lines = text.split(b"\n")
    fractions = np.concatenate([
        share[[UPPER, DIGIT, LOUD, SIGN, POINT]],
        last[[LOUD, SIGN, POINT]],
        [
            np.count_nonzero((size == 1) & (cls[begins] == SIGN)) / n_words,
            sum(map(bytes.__eq__, words, words[1:])) / n_words,
            1 - len(set(words)) / n_words,
            1 - len(set(lines)) / len(lines),
            np.count_nonzero(size > 20) / n_words,
            np.count_nonzero(size <= 3) / n_words,
            np.count_nonzero((cls[begins] == UPPER) & (cls[np.minimum(begins + 1, n - 1)] == UPPER) & (size > 1)) / n_words,
        ],
    ])
    k = len(fractions)
    out[:k] = fractions
    out[k : 2 * k] = np.log1p(50 * fractions)
    sentences = 1 + np.count_nonzero(cls[ends] == POINT)
    out[2 * k : 2 * k + 8] = np.log1p(n_words), n / n_words / 5, size.std() / 5, np.log1p(n_words / sentences), np.log1p(n_words / len(lines)), np.log1p(len(set(words))), share[HIGH], 1.0
    return out


def feature_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, x)`` for every row, in a shared table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for _, t in values(b)], np.float32).reshape(-1, N_FEATURES)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, N_FEATURES, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), rows], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, N_FEATURES)


def _sums(rows: DataFrame, of, size: int) -> np.ndarray:
    """Sum over all rows of what ``of(x, part)`` gives for a batch; rows: x, part (0 for rows
    without a label, 1 and 2 for the halves of the positives)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_pydict({"v": pa.array([total], pa.list_(pa.float64()))})

    parts = rows.select("x", "part").mapInArrow(run, "v array<double>")
    got = parts.select(F.posexplode("v").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(size)
    for r in got:
        out[r.i] = r.s
    return out


class Model:
    """A linear score of standardised statistics."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, prior: float = 0.5) -> None:
        self.mean, self.scale, self.prior, self.w = mean, scale, prior, np.zeros(len(mean) + 1)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -6, 6), np.ones(len(x))])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.w

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _fit(rows: DataFrame, model: Model, steps: int, parts: tuple[int, ...], ridge: float = 1e-3) -> None:
    d = N_FEATURES + 1
    penalty = np.append(np.full(d - 1, ridge), 0)
    for _ in range(steps):
        def of(x: np.ndarray, part: np.ndarray, m: Model = model) -> np.ndarray:
            a = m.inputs(x)
            z = np.clip(a @ m.w, -30, 30)
            s = 1 / (1 + np.exp(-z))
            soft, p = np.logaddexp(0, z), np.isin(part, parts)
            curve = (a * (s * (1 - s))[:, None]).T @ a
            return np.concatenate([[len(x), p.sum(), soft.sum(), soft[p].sum()], a.T @ s, a[p].sum(axis=0), a[p].T @ s[p], curve.ravel()])

        v = _sums(rows, of, 4 + 3 * d + d * d)
        n, k, u_soft, p_soft = v[:4]
        u_grad, p_mean, p_grad = v[4 : 4 + d] / n, v[4 + d : 4 + 2 * d] / k, v[4 + 2 * d : 4 + 3 * d] / k
        curve = v[4 + 3 * d :].reshape(d, d) / n + np.diag(penalty + 1e-6)
        if u_soft / n - model.prior * p_soft / k < 0:  # the risk on negatives: against it
            step = 0.1 * (u_grad - model.prior * p_grad)
        else:
            step = -np.linalg.solve(curve, u_grad - model.prior * p_mean + penalty * model.w)
        size = np.abs(step).max()
        model.w = model.w + step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-3:
            break


def _prior(rows: DataFrame, model: Model, bins: int = 400) -> float:
    """Share of positives in unlabelled text, from its scores and those of positives that the model
    wasn't fitted on."""
    def of(x: np.ndarray, part: np.ndarray) -> np.ndarray:
        i = np.minimum((model.score(x) * bins).astype(int), bins - 1)
        return np.concatenate([np.bincount(i, minlength=bins), np.bincount(i[part == 2], minlength=bins)])

    u, p = _sums(rows, of, 2 * bins).reshape(2, bins)
    n, k = u.sum(), max(p.sum(), 1)
    above_u, above_p = np.cumsum(u[::-1]) / n, np.cumsum(p[::-1]) / k
    ok = above_p >= 0.5
    return float(np.clip((above_u[ok] / above_p[ok]).min() if ok.any() else 0.5, 0.02, 0.95))


def learn(table: DataFrame, labels: DataFrame, max_positives: int = 2_000_000, steps: int = 12) -> Model | None:
    """Fit on table(doc_id, x) and labels(doc_id, quality) of training rows; None without positives."""
    known = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    count = known.count()
    if count > max_positives:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (max_positives << 20) // count)
    rows = cut(table.join(known.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) + 1), "doc_id", "left").select("x", F.coalesce("half", F.lit(0)).cast("int").alias("part")))
    v = _sums(rows, lambda x, part: np.concatenate([[len(x), (part > 0).sum()], x.sum(axis=0), (x * x).sum(axis=0)]), 2 + 2 * N_FEATURES)
    if not v[1]:
        return None
    halves = [r.part for r in rows.where("part > 0").select("part").distinct().collect()]
    mean = v[2 : 2 + N_FEATURES] / v[0]
    spread = np.sqrt(np.maximum(v[2 + N_FEATURES :] / v[0] - mean**2, 0))
    model = Model(mean, np.where(spread > 1e-6, spread, 1.0))
    if len(halves) == 2:
        _fit(rows, model, 6, (1,))
        model.prior = _prior(rows, model)
        model.w = np.zeros_like(model.w)
    _fit(rows, model, steps, (1, 2))
    return model


def score(table: DataFrame, model: Model | None) -> DataFrame:
    """``(doc_id, score)`` per row of table(doc_id, x)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = model.score(_matrix(b.column(1))) if model and b.num_rows else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(points)], ["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, score)`` for every row of docs; labels are training rows only."""
    table = cut(feature_table(docs))
    return score(table, learn(table, labels))
