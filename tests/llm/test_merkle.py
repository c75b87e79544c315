"""The manifest against a plain tree, node by node."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from layover.llm import merkle, registry
from tests.llm.conftest import DOCUMENTS


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more: int = 0) -> str:
    values = [row["doc_id"], row["source"], row["lang"], None if row["n_chars"] is None else row["n_chars"] + more, row["text"]]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The last node, and per leaf its siblings as (side, digest)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            other = k ^ 1
            paths[i].append(("L" if k % 2 else "R", nodes[other]) if other < len(nodes) else ("", ""))
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        at = [k // 2 for k in at]
    return nodes[0], paths


def plain(rows: list) -> list[tuple]:
    trees = {}
    for r in rows:
        trees.setdefault("-" if r["lang"] is None else "=" + r["lang"], []).append(r)
    names = sorted(trees, key=lambda t: t.encode())
    order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))
    sorted_rows = {t: sorted(trees[t], key=order) for t in names}
    subs = {t: climb([leaf(r) for r in sorted_rows[t]]) for t in names}
    if not rows:
        return []
    root, above = climb([subs[t][0] for t in names])
    out = []
    for t, up in zip(names, above):
        for r, own in zip(sorted_rows[t], subs[t][1]):
            path, i = own + up, r["doc_id"]
            node = leaf(r, int(i is not None and zlib.crc32(str(i).encode()) % 7 == 0))
            for side, sibling in path:
                node = h(sibling, node) if side == "L" else h(node, sibling)
            out.append((i, leaf(r), subs[t][0], root, h(*[s for _, s in path]), node, node == root))
    return sorted(out, key=str)


def hold(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in registry.queries()["op12_merkle_manifest"](spark, str(tmp_path)).collect()), key=str)
    assert got == plain(df.collect())
    return got


def test_places_of_the_layout():
    """Every node has one place; both halves of a tree lie together, and so do theirs."""
    import numpy as np

    for levels in range(1, 10):
        places = [merkle.address(levels, d, np.arange(1 << d)) for d in range(levels)]
        assert sorted(np.concatenate(places)) == list(range((1 << levels) - 1))
        top = levels // 2
        if top:
            assert sorted(np.concatenate(places[:top])) == list(range((1 << top) - 1))
            lower = (1 << (levels - top)) - 1
            for k in range(1 << top):
                own = [places[d][k << (d - top) : (k + 1) << (d - top)] for d in range(top, levels)]
                assert sorted(np.concatenate(own)) == list(range((1 << top) - 1 + k * lower, (1 << top) - 1 + (k + 1) * lower))


def test_odd_rows(spark, odd, none, tmp_path):
    mixed = odd.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).when(F.col("doc_id") % 5 == 1, "").when(F.col("doc_id") % 5 == 2, "é").otherwise(F.col("lang")))
    hold(spark, mixed.select("size", *[c for c in mixed.columns if c != "size"]), tmp_path / "odd")
    assert hold(spark, none, tmp_path / "none") == []
    assert len(hold(spark, odd.limit(1), tmp_path / "one")) == 1


@pytest.mark.parametrize("n", [2, 3, 255, 256, 257, 700])
def test_trees_of_any_size(spark, tmp_path, n):
    rows = [(i * 3, f"text {i}", "big" if i % 9 else f"t{i % 4}", "s", i) for i in range(n)]
    got = hold(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5), tmp_path)
    assert {v for *_, v in got} <= {True, False} and all(v == (zlib.crc32(str(i).encode()) % 7 != 0) for i, *_, v in got)


def test_many_layers_and_many_trees(spark, tmp_path, monkeypatch):
    """Blocks of two levels: three and more layers of blocks, trees that end in each of them, a deep forest."""
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "LEAVES", 4)
    sizes = [1, 2, 4, 5, 16, 17, 64, 65, 150] + [1] * 12 + [3] * 6
    rows = [(k * 1000 + i, f"t{i}", f"l{k:02d}", None, i) for k, n in enumerate(sizes) for i in range(n)]
    hold(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4), tmp_path)


def test_repeated_rows_fill_many_tasks(spark, tmp_path):
    rows = [(7, "same", "en", "s", 4)] * 600 + [(i, "x", "en", "s", 1) for i in range(100)]
    hold(spark, spark.createDataFrame(rows, DOCUMENTS.split(", extra")[0]).repartition(4), tmp_path)
