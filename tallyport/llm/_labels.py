"""Labelled rows for fitting: the held-out rule and the bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a classifier is fitted on, at most.
PER_CLASS = 4000


def held_out(doc_id: Column) -> Column:
    """True for the rows that are never used in fitting."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(labels: DataFrame, label: str, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """Up to ``per_class`` labelled ids of each class, in the order of a hash, with ``part`` 0 to 3; and the classes' counts.

    An id with more than one label counts once, with the larger.  At most ``2 * per_class`` rows: small enough to broadcast.
    """
    rows = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    parts = [rows.filter(F.col("label") == c).withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(per_class) for c in (0, 1)]
    taken = parts[0].unionByName(parts[1]).select("doc_id", "label", F.pmod("order", F.lit(4)).cast("int").alias("part"))
    return taken, {c: counts.get(c, 0) for c in (0, 1)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method; the last coefficient is the intercept, which is not penalised."""
    x = np.column_stack((x, np.ones(len(x))))
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta
