"""Vector operators against all pairs."""

import numpy as np
import pytest

from layover.llm import covertree, topk
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, shard int, block int, dim int"


def make(spark, seed=0, n=240):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(12, 8))
    vectors = [centres[i % 12] + draw.normal(size=8) * draw.choice([0.02, 0.08, 1.0]) for i in range(n)]
    vectors[5] = vectors[4].copy()
    vectors[30] = vectors[4] * 3
    made = [(i, [float(x) for x in v], int(i % 3), 1, 2, 3) for i, v in enumerate(vectors)]
    made += [(6000, made[50][1], 1, 0, 0, 0), (6050, made[50][1], 1, 0, 0, 0)]
    made += [
        (7000, None, 1, 0, 0, 0), (7050, [0.0] * 8, 1, 0, 0, 0), (7100, [float("nan")] * 8, 1, 0, 0, 0),
        (7150, [1.0, None] * 4, 1, 0, 0, 0), (7200, [float("inf")] * 8, 1, 0, 0, 0), (7250, [], 1, 0, 0, 0),
        (7300, made[0][1], None, 0, 0, 0), (7350, [1.0, 2.0], 1, 0, 0, 0), (7400, [1.0, 2.0], 1, 0, 0, 0), (None, made[0][1], 0, 0, 0, 0),
    ]
    return made, spark.createDataFrame(made, SCHEMA).repartition(3)


def sound(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block_rows,seed", [(2048, 0), (40, 1), (7, 2)])
def test_links_and_components(spark, block_rows, seed):
    made, df = make(spark, seed)
    rows = covertree.near_vectors(df, block_rows=block_rows).collect()
    assert len(rows) == len(made)
    known = [(i, np.array(v, np.float32).astype(float), y) for i, v, y, *_ in made if i is not None and y is not None and sound(v) and any(v)]
    links, count = [], {}
    for a, (i, v, y) in enumerate(known):
        for j, w, z in known[:a]:
            if y == z and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links.append((i, j))
                count[i], count[j] = count.get(i, 0) + 1, count.get(j, 0) + 1
    component = brute.components([m[0] for m in made if m[0] is not None], links)
    assert len(links) > 100
    for r in rows:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"]) == (count.get(i, 0), component.get(i))
        assert r["kept"] == (i == r["component_id"])


def test_no_vectors(spark):
    _, df = make(spark)
    assert covertree.near_vectors(df.limit(0)).count() == 0
    assert topk.top_k(df.limit(0), every=50).count() == 0


@pytest.mark.parametrize("shard_rows,leaf,seed", [(8192, 128, 0), (50, 8, 1)])
def test_top_k(spark, monkeypatch, shard_rows, leaf, seed):
    monkeypatch.setattr(topk, "LEAF", leaf)
    made, df = make(spark, seed)
    got = sorted(tuple(r) for r in topk.top_k(df, every=50, k=5, shard_rows=shard_rows).collect())
    known = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v, *_ in made if i is not None and sound(v)]
    want = []
    for i, q in known:
        if i % 50 == 0:
            scored = sorted((-int(q @ v), j) for j, v in known if j != i and len(v) == len(q))[:5]
            want += [(i, k, j, -s) for k, (s, j) in enumerate(scored, start=1)]
    assert got == sorted(want)


def test_the_tree_leaves_boxes_out():
    """With clustered rows a search must not open every leaf."""
    draw = np.random.default_rng(1)
    rows = np.concatenate([draw.normal(size=(500, 4)) + 40 * np.eye(4)[k] for k in range(4)])
    tree = topk.grow(np.arange(2000), topk.quantised(rows))
    opened = []
    plain = topk.products
    topk.products = lambda q, r: opened.append(len(r)) or plain(q, r)
    try:
        floor = np.full(1, topk.NONE, dtype=np.int64)
        topk.search(tree, np.array([-1]), np.array([[256.0, 0, 0, 0]]), 5, floor)
    finally:
        topk.products = plain
    assert sum(opened) <= 500
