"""Mixtures of normal distributions over two columns, their size chosen by BIC from several starts each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the starts are drawn from; rounds of EM and the gain in mean log-likelihood that ends them; what is added to variances.
SAMPLE, ROUNDS, REST, RIDGE = 4096, 100, 1e-3, 1e-6

Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def _model(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> Model:
    """(weights, means, covariances) from counts, sums and sums of products."""
    n = n + 10 * np.finfo(float).eps
    m = s / n[:, None]
    return n / n.sum(), m, q / n[:, None, None] - m[:, :, None] * m[:, None, :] + RIDGE * np.eye(2)


def _start(x: np.ndarray, k: int, rng: np.random.Generator) -> Model:
    """The clusters of k-means on x, begun at rows far from each other."""
    centres = x[rng.integers(len(x), size=1)]
    while len(centres) < k:
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum() if d.sum() > 0 else None)]])
    for _ in range(20):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
    r = np.eye(k)[own]
    return _model(r.sum(axis=0), r.T @ x, np.einsum("nk,ni,nj->kij", r, x, x))


def _logs(x: np.ndarray, model: Model) -> np.ndarray:
    """Log of weight times density, rows by components."""
    w, m, c = model
    d = x[:, None] - m[None]
    return np.log(w) - np.log(2 * np.pi) - np.log(np.linalg.det(c)) / 2 - np.einsum("nki,kij,nkj->nk", d, np.linalg.inv(c), d) / 2


def _step(points: DataFrame, models: list[Model]) -> tuple[list[Model], np.ndarray]:
    """The models after a round of EM, all in one pass, and their log-likelihoods before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            x, out = b.to_numpy(float), []
            for model in models:
                g = _logs(x, model)
                top = g.max(axis=1, keepdims=True)
                e = np.exp(g - top)
                size = e.sum(axis=1, keepdims=True)
                r = e / size
                out += [[(np.log(size) + top).sum()], r.sum(axis=0), (r.T @ x).ravel(), np.einsum("nk,ni,nj->kij", r, x, x).ravel()]
            flat = np.concatenate(out)
            total = flat if total is None else total + flat
        if total is not None:
            yield pd.DataFrame({"total": [total]})

    total = np.sum([r[0] for r in points.mapInPandas(run, "total array<double>").collect()], axis=0)
    after, likely, at = [], [], 0
    for w, _, _ in models:
        k = len(w)
        likely.append(total[at])
        n, s, q = np.split(total[at + 1 : at + 1 + 7 * k], [k, 3 * k])
        after.append(_model(n, s.reshape(k, 2), q.reshape(k, 2, 2)))
        at += 1 + 7 * k
    return after, np.array(likely)


def fit(points: DataFrame, most: int = 6, starts: int = 20) -> Model:
    """The mixture of 1 to `most` components with the least BIC, of each size the likeliest of `starts` fits. points: two columns, no nulls."""
    n = points.count()
    x = points.orderBy(F.xxhash64(*points.columns), *points.columns).limit(SAMPLE).toPandas().to_numpy(float)
    # One component has one fit, whatever its start.
    models = [_start(x, k, np.random.default_rng([k, s])) for k in range(1, most + 1) for s in range(starts if k > 1 else 1)]
    likely, going = np.full(len(models), -np.inf), list(range(len(models)))
    for _ in range(ROUNDS):
        after, now = _step(points, [models[i] for i in going])
        still = []
        for i, model, value in zip(going, after, now):
            ended = abs(value - likely[i]) < REST * n
            likely[i] = value
            if not ended:
                models[i] = model
                still.append(i)
        going = still
        if not going:
            break
    if going:
        likely[going] = _step(points, [models[i] for i in going])[1]
    # Six free numbers a component (mean, covariance, weight), less one for the weights' sum.
    bic = [-2 * v + (6 * len(m[0]) - 1) * np.log(n) for v, m in zip(likely, models)]
    return models[int(np.argmin(bic))]


def component(a: Column, b: Column, model: Model) -> Column:
    """The likeliest component of each row, from 0."""
    logs = []
    for w, m, c in zip(*model):
        i, x, y = np.linalg.inv(c), a - float(m[0]), b - float(m[1])
        logs.append(F.lit(float(np.log(w) - np.log(np.linalg.det(c)) / 2)) - (x * x * float(i[0, 0]) + x * y * float(2 * i[0, 1]) + y * y * float(i[1, 1])) / 2)
    every = F.array(*logs)
    return (F.array_position(every, F.array_max(every)) - 1).cast("int")
