"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by log-count ratios.

Indicators: single words, pairs of words, and one to three word shapes in a row (case, digits, marks,
length, and whether the word repeats the one before), hashed to 2**18 places.  On a bounded labelled
sample each indicator gets the log ratio of its smoothed counts in the two classes; a dual coordinate
descent fits hinge loss on the scaled indicators; margins of a part kept back give probabilities.
Every whole text of the table is scored.

An empty or null text has no indicators and gets the score of a margin of 0.  Repeated rows are scored
alike.  A null id is scored, with a null fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layover.llm.blocks import Block, Hasher, Words, blocks, mix
from layover.llm.samples import Sample, calibrate, fold, probability, sample

PLACES = 18
COST = 1.0
EPOCHS = 30
#: Weight of the fitted model against the plain log-count ratios.
BLEND = 0.75


def kinds_of_bytes() -> np.ndarray:
    """Upper case, lower case, digit, mark, beyond ASCII: 0 to 4."""
    kinds = np.full(256, 3, dtype=np.uint8)
    kinds[65:91], kinds[97:123], kinds[48:58], kinds[128:] = 0, 1, 2, 4
    return kinds


def shapes(block: Block, words: Words, kinds: np.ndarray) -> np.ndarray:
    """A small number per word for how it looks."""
    kind = kinds[block.data]
    shape = np.zeros(len(words.hash), dtype=np.uint64)
    for k, most in ((0, 2), (1, 1), (2, 1), (3, 3), (4, 1)):
        sums = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
        shape = shape * np.uint64(most + 1) + np.minimum(sums[words.end] - sums[words.start], most).astype(np.uint64)
    length = np.minimum((words.end - words.start) // 4, 4).astype(np.uint64)
    again = np.zeros(len(words.hash), dtype=np.uint64)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
    return (shape * np.uint64(5) + length) * np.uint64(2) + again


def indicators(block: Block, words: Words, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indicators per text as (text, place), ordered by text."""
    if not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shape = mix(shapes(block, words, kinds) + np.uint64(1))
    found = [(words.text, words.hash), (words.text, shape)]
    for base, most in ((words.hash, 2), (shape, 3)):
        value = base
        for k in range(1, most):
            value = mix(value[:-1]) * np.uint64(3) + base[k:]
            inside = words.text[k:] == words.text[: len(words.text) - k]
            found.append((words.text[k:][inside], value[inside]))
    keys = []
    for salt, (text, value) in enumerate(found, start=1):
        place = mix(value + np.uint64(salt * 0x632BE59BD9B4E019 % (1 << 64))) >> np.uint64(64 - PLACES)
        keys.append((text.astype(np.uint64) << np.uint64(PLACES)) | place)
    merged = np.unique(np.concatenate(keys))
    return (merged >> np.uint64(PLACES)).astype(np.int64), (merged & np.uint64((1 << PLACES) - 1)).astype(np.int64)


def rows_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Indicators block by block: (first text, number of texts, text within the block, place)."""
    hasher, kinds = Hasher(lower=False), kinds_of_bytes()
    for block in blocks(texts):
        yield block.first, block.n, *indicators(block, hasher.words(block), kinds)


@dataclass
class Model:
    weights: np.ndarray
    shift: float
    slope: float
    base: float

    def margins(self, n: int, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        size = np.bincount(text, minlength=n)
        total = np.bincount(text, weights=self.weights[place], minlength=n)
        return total / np.sqrt(np.maximum(size, 1)) + self.shift * (size > 0)


def dual_descent(rows: list[np.ndarray], scale: np.ndarray, signs: np.ndarray, cost: float, epochs: int) -> np.ndarray:
    """Weights of the hinge-loss fit; a row has scale[place] / sqrt(size) at its places, and a constant 1."""
    weights = np.zeros(len(scale) + 1)
    values = [np.append(scale[r] / np.sqrt(max(len(r), 1)), 1.0) for r in rows]
    places = [np.append(r, len(scale)) for r in rows]
    squared = [float(v @ v) for v in values]
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = signs[i] * float(weights[places[i]] @ values[i]) - 1.0
            fresh = min(max(alpha[i] - gradient / squared[i], 0.0), cost)
            if fresh != alpha[i]:
                step = (fresh - alpha[i]) * signs[i]
                weights[places[i]] += step * values[i]
                moved = max(moved, abs(fresh - alpha[i]))
                alpha[i] = fresh
        if moved < 1e-3 * cost:
            break
    return weights


def fit(found: Sample) -> Model:
    zero = np.zeros(1 << PLACES, dtype=np.float32)
    if not len(found.texts) or found.labels.min() == found.labels.max():
        slope, base = calibrate(np.zeros((len(found.texts), 1)), found.labels, found.share)
        return Model(zero, 0.0, float(slope[0]), base)
    rows: list[np.ndarray] = []
    for _, n, text, place in rows_of(pa.array(found.texts)):
        rows += np.split(place, np.searchsorted(text, np.arange(1, n)))
    learn = np.flatnonzero(~found.tune)
    counts = np.ones((2, 1 << PLACES))
    for i in learn:
        counts[found.labels[i], rows[i]] += 1
    sizes = [max(1, int((found.labels[learn] == c).sum())) + 2 for c in (0, 1)]
    ratio = np.log(counts[1] / sizes[1]) - np.log(counts[0] / sizes[0])
    ratio[(counts[0] + counts[1]) <= 2] = 0.0  # never seen
    fitted = dual_descent([rows[i] for i in learn], ratio, 2.0 * found.labels[learn] - 1.0, COST, EPOCHS)
    size = np.abs(fitted[:-1]).mean()
    weights = (ratio * ((1 - BLEND) * size + BLEND * fitted[:-1])).astype(np.float32)
    model = Model(weights, float(BLEND * fitted[-1]), 1.0, 0.0)
    tune = np.flatnonzero(found.tune)
    margins = np.array([model.margins(1, np.zeros(len(rows[i]), np.int64), rows[i])[0] for i in tune])
    slope, model.base = calibrate(margins[:, None], found.labels[tune], found.share)
    model.slope = float(slope[0])
    return model


def score_with(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, text, place in rows_of(batch.column(1)):
                margins = model.margins(n, text, place)
                scores = probability(margins, model.slope, model.base)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(scores)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = 0.5, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text)."""
    model = fit(sample(docs, labels, column, **bounds))
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score_with(model), "doc_id long, score double")
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
