"""Bounded samples of labelled documents, and the calibration that the two classifiers share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold

TEXT_BYTES = 1 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int):
    """Up to `per_class` labelled (doc_id, text, y) rows of each class outside the held-out fold, as an Arrow table,
    and the number of labelled rows of each class outside it.

    The rows with the smallest hashes of their ids are taken, so the sample is the same on every run. Only labels
    are ordered; the ids found (2 * per_class at most) are broadcast to the documents. Of rows with one id the least text
    is taken, and texts of over TEXT_BYTES are not learnt from, so rows and bytes are bounded.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.where(fold(F.col("doc_id"), folds) != held)
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    picked = known.where("y = 0").orderBy(order, "doc_id").limit(per_class).union(known.where("y = 1").orderBy(order, "doc_id").limit(per_class))
    ids = picked.groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.where(F.octet_length("text") <= TEXT_BYTES).join(F.broadcast(ids), "doc_id")
    rows = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).toArrow()
    return rows.sort_by("doc_id"), (counts.get(0, 0), counts.get(1, 0))


def logistic(features, y, weight, rounds: int = 40, ridge: float = 1e-2):
    """Weights of a logistic regression (last one: the constant), by Newton steps."""
    import numpy as np

    x = np.column_stack([features, np.ones(len(y))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + keep * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def class_weights(y, counts: tuple[int, int]):
    """Weights that give the sample the class shares of all labelled rows."""
    import numpy as np

    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    share = [counts[k] / max(1, sum(counts)) for k in (0, 1)]
    return np.where(y == 1, share[1] / n[1], share[0] / n[0]) * len(y)
