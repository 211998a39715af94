"""Repeated cross-validation. Folds are a column, dealt by a seeded hash; each (repeat, fold) is fitted in its own task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_folds(df: DataFrame, key: str, *, folds: int = 5, repeats: int = 3, seed: int = 2652124) -> DataFrame:
    """A row for each repeat, with the fold in which the row is held out."""
    out = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return out.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "repeat", key), F.lit(folds)).cast("int"))


def _ranks(v: np.ndarray) -> np.ndarray:
    return pd.Series(v).rank().to_numpy()


def spearman(a: np.ndarray, b: np.ndarray) -> float:
    x, y = _ranks(a), _ranks(b)
    return float(np.corrcoef(x, y)[0, 1]) if len(x) > 1 and x.std() and y.std() else float("nan")


def linear(x: np.ndarray, y: np.ndarray, new: np.ndarray) -> np.ndarray:
    one = np.column_stack((np.ones(len(x)), x))
    return np.column_stack((np.ones(len(new)), new)) @ np.linalg.lstsq(one, y, rcond=None)[0]


def support_vectors(x: np.ndarray, y: np.ndarray, new: np.ndarray, *, cost: float = 1.0, epsilon: float = 0.1, sweeps: int = 200) -> np.ndarray:
    """RBF support-vector regression by coordinate descent on the dual (bias as a constant kernel term). Columns are scaled by
    the training rows' mean and population deviation. The kernel takes n * n numbers: for a few thousand rows."""
    mean, std = x.mean(0), x.std(0)
    std = np.where(std > 0, std, 1)
    a, b = (x - mean) / std, (new - mean) / std
    gamma = 1 / (a.shape[1] * (a.var() or 1))

    def kernel(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return np.exp(-gamma * np.maximum(0, (p * p).sum(1)[:, None] + (q * q).sum(1) - 2 * p @ q.T)) + 1

    k, centre = kernel(a, a), y.mean()
    beta, f = np.zeros(len(a)), np.zeros(len(a))
    target = y - centre
    for _ in range(sweeps):
        moved = 0.0
        for i in range(len(a)):
            g = target[i] - f[i] + k[i, i] * beta[i]
            new_beta = np.clip(np.sign(g) * max(0.0, abs(g) - epsilon) / k[i, i], -cost, cost)
            if (d := new_beta - beta[i]) != 0:
                f += d * k[:, i]
                beta[i] = new_beta
                moved = max(moved, abs(d))
        if moved < 1e-4:
            break
    return kernel(b, a) @ beta + centre


def cross_validated(df: DataFrame, features: str, target: str, *, model: str = "linear", folds: int = 5, repeats: int = 3) -> DataFrame:
    """repeat, held_out, rho, n: rank correlation of predictions and truth on each held-out fold; df has columns from
    with_folds and an array of features. Folds are bounded by the size of one fit."""
    fit = {"linear": linear, "svr": support_vectors}[model]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, y = np.stack(rows[features]).astype(float), rows[target].to_numpy(float)
        out = rows["fold"].to_numpy() == key[1]
        rho = spearman(fit(x[~out], y[~out], x[out]), y[out]) if out.any() and not out.all() else float("nan")
        return pd.DataFrame({"repeat": [key[0]], "held_out": [key[1]], "rho": [rho], "n": [int(out.sum())]})

    runs = df.withColumn("held_out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return runs.groupBy("repeat", "held_out").applyInPandas(one, "repeat int, held_out int, rho double, n long")


def summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("rho").alias("mean_rho"), F.min("rho").alias("least_rho"), F.count("*").alias("fits"))
