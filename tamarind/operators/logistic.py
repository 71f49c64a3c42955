"""Bayesian logistic regression: MAP by Newton steps over distributed sums, and its predictions."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarind.functions import numeric as N


@dataclass
class Fit:
    beta: np.ndarray
    covariance: np.ndarray
    log_posterior: float
    steps: int
    rows: int


def _sums(rows: DataFrame, beta: np.ndarray, mean: np.ndarray, precision: np.ndarray) -> tuple:
    """Log posterior, gradient and curvature at ``beta``: a partial sum from every task, added on the driver."""
    d = len(beta)

    def part(batches):
        loss, grad, gram, n = 0.0, np.zeros(d), np.zeros((d, d)), 0
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                y = b.column(1).to_numpy(zero_copy_only=False)
                m = x @ beta
                p = 1 / (1 + np.exp(-m))
                loss += float((y * m - np.logaddexp(0, m)).sum())
                grad += x.T @ (y - p)
                gram += (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x
                n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([[loss, float(n), *grad, *gram.ravel()]], pa.list_(pa.float64()))], ["s"])

    # numbers by position are summed in Spark: what reaches the driver is d * d + d + 2 numbers
    found = rows.mapInArrow(part, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    s = np.zeros(2 + d + d * d)
    for r in found:
        s[r["i"]] = r["v"]
    off = beta - mean
    value = s[0] - 0.5 * float(off @ (precision * off))
    return value, s[2 : 2 + d] - precision * off, s[2 + d :].reshape(d, d) + np.diag(precision), int(s[1])


def fit(rows: DataFrame, x: str, y: str, mean, sd, max_steps: int = 25, tolerance: float = 1e-8) -> Fit:
    """Newton from the prior mean, with halved steps where the posterior would fall; ``x`` is an array column.

    The covariance is the inverse curvature at the last point that was linearised.
    """
    data = rows.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y")).persist()
    mean, precision = np.asarray(mean, float), 1 / np.square(np.asarray(sd, float))
    beta = mean.copy()
    value, grad, curve, n = _sums(data, beta, mean, precision)
    steps = 0
    covariance = np.linalg.inv(curve + 1e-6 * np.eye(len(beta)))
    for steps in range(1, max_steps + 1):
        covariance = np.linalg.inv(curve + 1e-6 * np.eye(len(beta)))
        move, size = covariance @ grad, 1.0
        for _ in range(30):
            new = _sums(data, beta + size * move, mean, precision)
            if new[0] >= value:
                break
            size /= 2
        else:
            break
        beta, (value, grad, curve, _) = beta + size * move, new
        if np.abs(size * move).max() < tolerance:
            break
    data.unpersist()
    return Fit(beta, covariance, value, steps, n)


def constant(values) -> Column:
    """Numbers (a list, or a list of lists) as one literal: hundreds of them are no burden on the plan."""
    values = np.asarray(values, float)
    return F.from_json(F.lit(json.dumps(values.tolist())), "array<" * values.ndim + "double" + ">" * values.ndim)


def _dot(x: Column, values) -> Column:
    pairs = F.zip_with(x, constant(values), lambda a, b: a * b)
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def contributions(x: Column, beta) -> Column:
    return F.zip_with(x, constant(beta), lambda a, b: a * b)


def predict(x: Column, beta, covariance) -> tuple[Column, Column, Column]:
    """Margin, variance of the margin, and the probability averaged over the posterior (probit form)."""
    margin = N.clamp(_dot(x, beta), -10.0, 10.0)
    rows = constant(covariance)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda t, w: t + w)
    variance = N.let(x, lambda v: F.greatest(F.lit(0.0), dot(F.transform(rows, lambda r: dot(r, v)), v)))
    return margin, variance, N.sigmoid(margin / F.sqrt(1 + math.pi * variance / 8))


def top_weights(names: list[str], beta, n: int = 6) -> list[tuple[str, float]]:
    return sorted(zip(names, map(float, beta), strict=True), key=lambda kv: -abs(kv[1]))[:n]


def sample_posterior(beta, covariance, n: int = 1, seed: int = 20260101):
    """``(n, features)`` draws of the weights, by the covariance's Cholesky factor."""
    import numpy as np

    cov = np.asarray(covariance, float)
    factor = np.linalg.cholesky(cov + 1e-12 * np.eye(len(cov)))
    return np.asarray(beta, float) + np.random.default_rng(seed).standard_normal((n, len(cov))) @ factor.T


def stored_state(names: list[str], beta, covariance) -> dict:
    """A model as a row: weights by name, with the covariance's cells among them for old readers, and the covariance."""
    rows = [[float(c) for c in r] for r in covariance]
    cells = {f"cov:{i}:{j}": c for i, r in enumerate(rows) for j, c in enumerate(r)}
    return {"weights": dict(zip(names, map(float, beta), strict=True)) | cells, "covariance": rows}


def restored_state(stored: dict, names: list[str], prior_means: list[float]) -> tuple[list[float], list[list[float]]]:
    """Weights and covariance of a row: missing weights are the prior's, missing or non-finite cells
    come from the old keys, else from the identity."""
    weights, held = stored.get("weights") or {}, stored.get("covariance") or []

    def cell(i: int, j: int) -> float:
        found = [held[i][j] if i < len(held) and j < len(held[i] or []) else None, weights.get(f"cov:{i}:{j}")]
        return next((float(x) for x in found if x is not None and math.isfinite(x)), float(i == j))

    beta = [float(weights.get(n, m)) for n, m in zip(names, prior_means, strict=True)]
    return beta, [[cell(i, j) for j in range(len(names))] for i in range(len(names))]
