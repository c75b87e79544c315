"""Exact top-k by inner product: a KD-tree per shard, searched best first for blocks of queries.

Components are quantised to floor(256 * x).  Rows are dealt to shards by a hash of the id; each shard
becomes one tree: median splits along the widest side, leaves of at most 128 rows, and for every node
the tight box around its rows.  The largest inner product a box allows bounds what is inside.  Nodes are
taken by their best bound over the queries of a block; a query follows only where the bound reaches its
k-th score so far, and that score is carried from tree to tree within a task.  A task grows the trees of
its shards and then reads every query once, so queries are shuffled once per task, are never collected or
broadcast, and a task holds its trees and one block.  Tasks answer with their k best, and the k best of
those remain.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id.
Vectors meet only vectors of their own length.  Repeated ids are different rows, but a query never meets
a row of its own id.  Equal scores go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layover.llm.vectors import matrix, usable

SCALE = 256
LEAF = 128
SHARD_ROWS = 8192
BLOCK_QUERIES = 512
NONE = -(1 << 62)

TASK_BYTES = 64 << 20
TASKS_PER_CORE = 3

KEY = ["task", "asks", "dim", "shard"]
ANSWERS = "query_id long, vec_id long, score long"


def quantised(rows: np.ndarray) -> np.ndarray:
    return np.floor(rows * SCALE)


def grow(ids: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """The tree of a shard: rows in leaf order, and per node its box, bounds of rows and children."""
    order = np.argsort(ids, kind="stable")
    low, high, begin, end, child = [], [], [], [], []

    def node(part: slice) -> int:
        inside = rows[order[part]]
        low.append(inside.min(axis=0)), high.append(inside.max(axis=0))
        begin.append(part.start), end.append(part.stop), child.append(-1)
        return len(child) - 1

    waiting = [node(slice(0, len(ids)))]
    while waiting:
        at = waiting.pop()
        a, b = begin[at], end[at]
        axis = int(np.argmax(high[at] - low[at]))
        if b - a <= LEAF or high[at][axis] == low[at][axis]:
            order[a:b] = np.sort(order[a:b])
            continue
        middle = (a + b) // 2
        half = np.argpartition(rows[order[a:b], axis], middle - a)
        order[a:b] = order[a:b][half]
        child[at] = node(slice(a, middle))
        node(slice(middle, b))
        waiting += [child[at], child[at] + 1]
    for at in range(len(child)):  # smaller ids first within a leaf
        if child[at] < 0:
            part = order[begin[at] : end[at]]
            order[begin[at] : end[at]] = part[np.argsort(ids[part], kind="stable")]
    return {
        "ids": ids[order], "rows": rows[order], "low": np.array(low), "high": np.array(high),
        "begin": np.array(begin), "end": np.array(end), "child": np.array(child),
    }


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as int64; doubles hold them exactly unless components are huge."""
    if np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * max(rows.shape[1], 1) < 2.0**53:
        return (queries @ rows.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in rows]
    return np.array([[sum(int(a) * b for a, b in zip(q, row)) for row in whole] for q in queries], dtype=np.int64)


def task_count(shards: int, shard_bytes: int, cores: int) -> int:
    """Tasks that shards are dealt to: a few per core, and more where their trees would take over TASK_BYTES each."""
    most = max(1, TASK_BYTES // max(1, shard_bytes))
    return min(shards, max(TASKS_PER_CORE * cores, -(-shards // most)))


def search(tree: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray):
    """The k best rows of a tree per query: (ids, scores), padded with NONE.  ``floor`` is raised to the k-th score.

    Bounds are doubles; half a unit of slack keeps their rounding from hiding an equal score.
    """
    n = len(ids)
    best = np.full((n, k), NONE, dtype=np.int64)
    owner = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
    bound = np.maximum(queries, 0) @ tree["high"].T + np.minimum(queries, 0) @ tree["low"].T
    bound += 0.5 + np.abs(bound) * 1e-12
    heap = [(-float(bound[:, 0].max()), 0)]
    while heap:
        _, node = heapq.heappop(heap)
        active = np.flatnonzero(bound[:, node] >= floor)
        if not len(active):
            continue
        child = int(tree["child"][node])
        if child >= 0:
            for c in (child, child + 1):
                heapq.heappush(heap, (-float(bound[active, c].max()), c))
            continue
        a, b = int(tree["begin"][node]), int(tree["end"][node])
        rows = tree["ids"][a:b]
        scores = products(queries[active], tree["rows"][a:b])
        scores[rows[None, :] == ids[active][:, None]] = NONE
        reach = np.flatnonzero(scores.max(axis=1) >= floor[active])
        if not len(reach):
            continue
        active, scores = active[reach], scores[reach]
        if b - a > k:  # ids ascend within a leaf, so the earlier place wins a tie
            keyed = scores * (b - a) + (b - a - 1 - np.arange(b - a))
            keyed[scores == NONE] = NONE
            top = np.argpartition(-keyed, k - 1, axis=1)[:, :k]
            scores = np.take_along_axis(scores, top, axis=1)
            found = rows[top]
        else:
            found = np.broadcast_to(rows, scores.shape)
        scores = np.concatenate([best[active], scores], axis=1)
        found = np.where(scores == NONE, np.iinfo(np.int64).max, np.concatenate([owner[active], found], axis=1))
        order = np.lexsort((found, -scores), axis=1)[:, :k]
        best[active] = np.take_along_axis(scores, order, axis=1)
        owner[active] = np.take_along_axis(found, order, axis=1)
        floor[active] = np.maximum(floor[active], best[active, k - 1])
    return owner, best


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Consecutive rows with equal (task, asks, dim, shard), as far as they lie in one batch: that key, ids, rows."""
    for batch in batches:
        keys = np.column_stack([batch.column(c).cast(pa.int32()).to_numpy(zero_copy_only=False) for c in KEY])
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)]):
            if a < b:
                part = batch.slice(a, b - a)
                yield tuple(int(x) for x in keys[a]), part.column("vec_id").to_numpy(), quantised(matrix(part.column("embedding")))


def blocks(found: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same ids and rows in blocks of ``most``, the last one smaller."""
    ids, rows = [], []
    for i, r in found:
        for at in range(0, len(i), most):
            ids.append(i[at : at + most]), rows.append(r[at : at + most])
            if sum(map(len, ids)) >= most:
                i_all, r_all = np.concatenate(ids), np.concatenate(rows)
                yield i_all[:most], r_all[:most]
                ids, rows = [i_all[most:]], [r_all[most:]]
    if sum(map(len, ids)):
        yield np.concatenate(ids), np.concatenate(rows)


def best_of(trees: list[dict[str, np.ndarray]], ids: np.ndarray, queries: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best rows of all trees for a block of queries."""
    floor = np.full(len(ids), NONE, dtype=np.int64)
    owner = np.empty((len(ids), 0), dtype=np.int64)
    best = owner.copy()
    for tree in trees:
        found, scores = search(tree, ids, queries, k, floor)
        owner, best = np.concatenate([owner, found], axis=1), np.concatenate([best, scores], axis=1)
        order = np.lexsort((owner, -best), axis=1)[:, :k]
        owner, best = np.take_along_axis(owner, order, axis=1), np.take_along_axis(best, order, axis=1)
        floor = np.maximum(floor, best[:, k - 1])
    some = best != NONE
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(ids, some.sum(axis=1))), pa.array(owner[some]), pa.array(best[some])],
        names=["query_id", "vec_id", "score"],
    )


def search_all(k: int):
    """Rows ordered by KEY to answers: the vectors of a task come first, shard by shard, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, trees = None, {}
        for (task, asks, dim, _), group in groupby(parts(batches), key=lambda part: part[0]):
            if task != here:
                here, trees = task, {}
            found = ((ids, rows) for _, ids, rows in group)
            if not asks:
                ids, rows = zip(*found)
                trees.setdefault(dim, []).append(grow(np.concatenate(ids), np.concatenate(rows)))
            elif dim in trees:
                for ids, rows in blocks(found, BLOCK_QUERIES):
                    yield best_of(trees[dim], ids, rows, k)

    return run


def top_k(rows: DataFrame, every: int, k: int = 5, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``, against all rows."""
    known = usable(rows.select(F.col("vec_id").cast("long"), "embedding"))
    total, longest = known.agg(F.count(F.lit(1)), F.max("dim")).first()
    shards = max(1, -(-total // shard_rows))
    tasks = task_count(shards, shard_rows * (longest or 1) * 8, rows.sparkSession.sparkContext.defaultParallelism)
    # Repeated ids are spread by their vectors, so one id cannot fill a shard.
    shard = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(shards)).cast("int")
    sharded = known.withColumn("shard", shard).withColumn("task", F.pmod("shard", F.lit(tasks))).withColumn("asks", F.lit(0))
    asked = known.filter(F.pmod("vec_id", F.lit(every)) == 0)
    everywhere = asked.withColumn("shard", F.lit(-1)).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).withColumn("asks", F.lit(1))
    # Never a join: the planner takes queries for as small as they are before they go to every task, and broadcasts them.
    met = sharded.unionByName(everywhere).repartitionById(tasks, "task").sortWithinPartitions(*KEY)
    answers = met.mapInArrow(search_all(k), ANSWERS)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
