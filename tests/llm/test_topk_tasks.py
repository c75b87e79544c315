"""Top-k tasks: queries reach each of them once as rows, and are neither joined nor broadcast."""

import numpy as np
import pytest

from layover.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def rows(n=1300, width=6):
    """Vectors with copies, ids that repeat, and a few of another length."""
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(n, width)).astype(np.float32)
    vectors[700:720] = vectors[0]
    ids = [i // 2 if i < 40 else i for i in range(n)]
    made = [(i, [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return made + [(5000 + i, made[i][1][:2]) for i in range(30)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("shard_rows,task_bytes", [(100, 1), (100, 1 << 20), (5000, 1 << 20)])
def test_all_queries_meet_all_rows(spark, monkeypatch, shard_rows, task_bytes):
    monkeypatch.setattr(topk, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(topk, "TASKS_PER_CORE", 0 if task_bytes > 1 else 3)
    made = rows()
    found = topk.top_k(spark.createDataFrame(made, SCHEMA).repartition(3), every=1, k=4, shard_rows=shard_rows)
    want = []
    known = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in made]
    for dim in (6, 2):
        ids = np.array([i for i, v in known if len(v) == dim])
        table = np.array([v for _, v in known if len(v) == dim])
        scores = table @ table.T
        answers = {}
        for a, i in enumerate(ids):
            near = np.lexsort((ids, -scores[a]))[:12]
            answers.setdefault(int(i), []).extend((-int(scores[a, b]), int(ids[b])) for b in near if ids[b] != i)
        want += [(i, k, j, -s) for i, some in answers.items() for k, (s, j) in enumerate(sorted(some)[:4], start=1)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_queries_are_not_joined_or_broadcast(spark):
    """Before, small queries were repeated per shard and then broadcast through the driver."""
    text = plan(topk.top_k(spark.createDataFrame(rows(), SCHEMA), every=2, shard_rows=50))
    assert "Join" not in text and "Broadcast" not in text


def test_tasks_are_bounded():
    assert topk.task_count(1, 1 << 30, 8) == 1
    assert topk.task_count(100, 4 << 20, 2) == 7  # 16 trees of 4 MB each at most
    assert topk.task_count(100, 4 << 20, 8) == 24
    assert topk.task_count(100, 1 << 30, 8) == 100


def test_blocks_cut_a_stream_anywhere():
    parts = [np.arange(a, b) for a, b in ((0, 3), (3, 3), (3, 14), (14, 20), (20, 21))]
    cut = list(topk.blocks(((p, p[:, None] * 1.0) for p in parts), 5))
    assert [len(i) for i, _ in cut] == [5, 5, 5, 5, 1]
    assert np.concatenate([i for i, _ in cut]).tolist() == list(range(21))
    assert all((r[:, 0] == i).all() for i, r in cut)
