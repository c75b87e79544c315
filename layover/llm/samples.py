"""Labelled samples of bounded size, and turning margins into probabilities."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bounds of a sample: documents and bytes of text per class.
PER_CLASS = 3000
CLASS_BYTES = 8 << 20


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


@dataclass
class Sample:
    """Texts with their labels; ``tune`` marks the quarter kept back for calibration.  ``share`` is the
    share of label 1 among all rows that may be learnt from."""

    texts: list[str]
    labels: np.ndarray
    tune: np.ndarray
    share: float


def sample(docs: DataFrame, labels: DataFrame, column: str, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES) -> Sample:
    """At most ``per_class`` documents and ``class_bytes`` of text per class, drawn by a hash of the id.

    Null ids, texts and labels are not learnt from; an id with several labels has the largest.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & (fold(F.col("doc_id")) != 1))
    each = usable.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in each.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = None
    for label in (0, 1):
        drawn = each.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = drawn if ids is None else ids.unionByName(drawn)
    # The ids are bounded by the limit, so they go to the documents and not the other way round.
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    order = [F.xxhash64("doc_id", F.lit("order")), F.col("doc_id"), F.col("text")]
    run = W.partitionBy("label").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    size = F.sum(F.octet_length("text").cast("long")).over(run)
    # A repeated id could bring more rows than ids were drawn; the limits hold for rows.
    bounded = texts.withColumn("bytes", size).withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy(*order)))
    rows = bounded.filter((F.col("bytes") <= class_bytes) & (F.col("nth") <= per_class)).orderBy("nth", "label").select("text", "label", "nth").collect()
    return Sample(
        [r["text"] for r in rows],
        np.array([r["label"] for r in rows], dtype=np.int64),
        np.array([r["nth"] % 4 == 0 for r in rows], dtype=bool),
        counts.get(1, 0) / max(1, sum(counts.values())),
    )


def calibrate(features: np.ndarray, labels: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Slopes and shift so that 1 / (1 + exp(-(features @ slopes + shift))) is a probability.

    Logistic regression by Newton steps with a slight pull to 0, then moved from the sample's share of
    label 1 to the true one.  Without both labels there is nothing to tell apart: slopes 0.
    """
    width, ones = features.shape[1], int(labels.sum())
    if not ones or ones == len(labels):
        return np.zeros(width), 4.0 if ones else -4.0
    x = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    w = np.zeros(width + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - labels) + 1e-3 * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(width + 1)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    share = min(max(share, 1e-6), 1 - 1e-6)
    return w[:-1], float(w[-1] + math.log(share / (1 - share)) - math.log(ones / (len(labels) - ones)))


def probability(margins: np.ndarray, slope: float, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
