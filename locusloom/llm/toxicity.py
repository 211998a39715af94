"""Toxicity by non-negative positive-unlabelled learning, trained in numpy.

Features of a text are its distinct words (letters lowered) and the first 4 and 5 bytes of longer ones (so that
compounds and inflections of one stem share a feature), hashed into 2**HASH_BITS columns. A linear classifier is
fitted from confirmed toxic texts (positives) and a sample of all texts, whose labels are not looked at (unlabelled;
a positive may be drawn into it too, so it stands for the whole), under the logistic loss. The risk is prior * R_p(+) +
max(0, R_u(-) - prior * R_p(-)); where the bracket falls below zero, the step goes the other way, as the
non-negative estimator asks. Weights are soft-thresholded, so that long texts don't gather noise; how much is
chosen on a fifth of the training texts by recall ** 2 / share called toxic, which needs positives and unlabelled texts
only. The class prior is the share of toxic rows among all labelled training rows.

The classifier is fitted on at most `positives` and `unlabelled` texts, the first by a hash of their
ids, and on the FEATURES columns at most in which the two differ most (documented bounds; all labels are counted for
the prior, all documents are scored whole).

Defined results: a null or empty text is scored by the bias alone; without a confirmed toxic text
every score is 0; several labels of one id count as toxic if one is; a null id has no label; rows that
repeat are all scored; labels of absent documents count for the prior only."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, texthash

HASH_BITS, POSITIVES, UNLABELLED, FEATURES = 18, 4000, 12000, 16384
BEGINNINGS = (4, 5)
#: What is tried for the soft threshold, and the least z of a column's share between positives and unlabelled.
SPARSITY, LEAST_Z = (5e-4, 1e-4, 2e-5), 4.5
_SHIFT = np.uint64(64 - HASH_BITS)


def features(texts: list) -> Iterator[np.ndarray]:
    for t in texts:
        h = texthash.subwords((t or "").lower().encode("utf-8", "surrogatepass"), texthash.NOT_WORD, BEGINNINGS)
        yield np.unique((h >> _SHIFT).astype(np.int32))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list) -> np.ndarray:
        z = np.array([self.weights[f].sum() for f in features(texts)], np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def risk(z: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores z, and the direction in which each score's step goes: its slope, or where the
    bracket is negative the slope of minus the bracket."""
    n_p, n_u = max(1, positive.sum()), max(1, unlabelled.sum())
    s = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    called = np.logaddexp(0, z)  # the loss where the answer should be negative; its slope is s
    bracket = (unlabelled * called).sum() / n_u - prior * (positive * called).sum() / n_p
    slope = unlabelled * s / n_u - positive * prior * s / n_p
    if bracket < 0:
        return prior * (positive * np.logaddexp(0, -z)).sum() / n_p, -slope
    return prior * (positive * np.logaddexp(0, -z)).sum() / n_p + bracket, slope - positive * prior * (1 - s) / n_p


def fit(rows: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, sparsity: float, steps: int = 300, rate: float = 0.1) -> Model:
    """rows: the feature ids of each text; positive: whether it is a confirmed positive; unlabelled: whether it is of
    the sample of all texts."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows).astype(np.int64) if len(rows) else np.empty(0, np.int64)
    known, column = np.unique(flat, return_inverse=True)
    doc = np.repeat(np.arange(len(rows)), sizes)
    w, bias = np.zeros(len(known)), 0.0
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for t in range(1, steps + 1):
        g = risk(np.bincount(doc, w[column], len(rows)) + bias, positive, unlabelled, prior)[1]
        grad = np.append(np.bincount(column, g[doc], len(known)), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        scale = rate / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        moved = m / (1 - 0.9**t) * scale
        w = w - moved[:-1]
        w = np.sign(w) * np.maximum(0, np.abs(w) - scale[:-1] * sparsity)
        bias -= moved[-1]
    full = np.zeros(1 << HASH_BITS, np.float32)
    full[known] = w
    return Model(full, float(bias))


def chosen_fit(rows: list[np.ndarray], positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """fit with the SPARSITY that does best on every fifth text, when fitted on the others."""
    fold = np.arange(len(rows)) % 5 == 0
    best, chosen = -1.0, SPARSITY[0]
    if (positive & fold).any() and (positive & ~fold).any():
        inside, outside = np.flatnonzero(~fold), np.flatnonzero(fold)
        for sparsity in SPARSITY:
            model = fit([rows[i] for i in inside], positive[inside], unlabelled[inside], prior, sparsity=sparsity)
            called = np.array([model.weights[rows[i]].sum() + model.bias >= 0 for i in outside])
            recall, share = called[positive[outside]].mean(), max(called[unlabelled[outside]].mean() if unlabelled[outside].any() else 0.0, prior / 2)
            if recall * recall / share > best:
                best, chosen = recall * recall / share, sparsity
    return fit(rows, positive, unlabelled, prior, sparsity=chosen)


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else np.empty(0, np.int32)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns[:3], _lists(list(features(b.column(3).to_pylist())))], ["order", "positive", "unlabelled", "features"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many positive and unlabelled texts each column occurs."""
    n = np.zeros((2, 1 << HASH_BITS), np.int64)
    for b in batches:
        sizes = b.column(3).value_lengths().to_numpy(zero_copy_only=False)
        flat = b.column(3).flatten().to_numpy(zero_copy_only=False)
        for k in (0, 1):
            n[k] += np.bincount(flat, np.repeat(b.column(1 + k).to_numpy(zero_copy_only=False), sizes), n.shape[1]).astype(np.int64)
    (at,) = np.nonzero(n.sum(0))
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[0, at]), pa.array(n[1, at])], ["at", "p", "u"])


def _kept(columns: np.ndarray):
    wanted = np.zeros(1 << HASH_BITS, bool)
    wanted[columns] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.asarray(f, np.int32) for f in b.column(3).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _lists([f[wanted[f]] for f in rows])], ["order", "positive", "unlabelled", "features"])

    return run


_SAMPLED = "order long, positive boolean, unlabelled boolean, features array<int>"


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """docs and labels hold training rows only. None without a confirmed positive."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    by_hash = F.xxhash64("doc_id", F.lit(8))
    prior = marks.agg(F.avg("toxic")).first()[0]
    if not prior:
        return None
    toxic = marks.where("toxic = 1").select("doc_id").orderBy(by_hash).limit(positives).withColumn("kind", F.lit(1))
    others = texts.select("doc_id").distinct().orderBy(by_hash).limit(unlabelled).withColumn("kind", F.lit(2))
    chosen = F.broadcast(toxic.unionByName(others).groupBy("doc_id").agg(F.sum("kind").alias("kind")))  # positives + unlabelled rows at most
    rows = texts.join(chosen, "doc_id").select(by_hash.alias("order"), (F.col("kind") != 2).alias("positive"), (F.col("kind") > 1).alias("unlabelled"), "text")
    rows = common.stored(rows.mapInArrow(_featured, _SAMPLED), "features")
    n_p, n_u = rows.agg(F.count_if("positive"), F.count_if("unlabelled")).first()
    if not n_p or not n_u:
        return None
    counts = rows.mapInArrow(_counted, "at int, p long, u long").groupBy("at").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    both = F.expr(f"(p + u) / {n_p + n_u}D")
    z = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u) + 1e-12)
    top = counts.where("p + u >= 5").select("at", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.col("z").desc(), "at").limit(FEATURES)
    columns = np.array([r[0] for r in top.collect()], np.int64)
    got = rows.mapInArrow(_kept(columns), _SAMPLED).toArrow().sort_by("order")  # few columns of a bounded number of rows
    kept = [np.asarray(x, np.int32) for x in got.column("features").to_numpy(zero_copy_only=False)]
    positive, drawn = (np.asarray(got.column(c).to_numpy(zero_copy_only=False), bool) for c in ("positive", "unlabelled"))
    return chosen_fit(kept, positive, drawn, min(max(prior, 1e-3), 0.9))


def scored(docs: DataFrame, model: Model | None, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score of each whole text. The model (1 MB at most) goes out with the tasks."""
    if model is None:
        return docs.withColumn(score_col, F.lit(0.0))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts.tolist()))

    return docs.withColumn(score_col, score(F.col(text_col)))


def in_training(id_col: str = "doc_id") -> F.Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0


def classifier(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Trained from the rows that aren't held out."""
    return train(docs.where(in_training()), labels.where(in_training()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, classifier(docs, common.table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(~in_training(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def not_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't call toxic."""
    common.tune(docs.sparkSession)
    name = common.fresh(docs, "_toxic")
    return scored(docs, classifier(docs, labels), score_col=name).where(F.col(name) < 0.5).drop(name)
