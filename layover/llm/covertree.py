"""Near-equal vectors by cover trees: exact links above a cosine, without listing all pairs.

Unit vectors are compared by distance, which a cosine fixes.  Equal vectors of a label are folded into
one, with their number.  Each label's vectors are dealt to blocks by a hash; every block becomes a cover
tree: each level halves the radius, the first centre of a node is the node's own, centres of a level lie
further apart than its radius, and every node knows how far its farthest vector is.  Pairs of trees of a
label are walked together: a pair of nodes further apart than both radii and the threshold is left out,
a pair of single vectors is a link or not, and everything else is opened.  Walks count links and return
a spanning forest, so a large group of near-copies gives as many rows as it has members.

Vectors that are null, zero, or hold null or non-finite components, and rows without label or id, link
with nothing and are components of their own.  Vectors of different lengths do not link.  Repeated ids
are different rows that share a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layover.llm.components import components
from layover.llm.vectors import matrix, packed, unpacked, usable
from layover.operators.keys import match

COSINE = 0.98
BLOCK_ROWS = 2048
LEAF = 24
#: Children of one node that are compared at once with all children of another.
STRIP = 512

#: A table of labels with at most this many rows is broadcast.
BROADCAST_LABELS = 10_000

FOUND = "id long, links long, root long"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def grow(ids: np.ndarray, weights: np.ndarray, units: np.ndarray) -> dict[str, np.ndarray]:
    """The cover tree of unit vectors: vectors in node order and, per node, centre, radius, vectors and children."""
    order = np.arange(len(ids))
    centre, radius, begin, end, child, children = [], [], [], [], [], []

    def node(a: int, b: int, reach: np.ndarray) -> int:
        centre.append(a), begin.append(a), end.append(b), child.append(0), children.append(0)
        radius.append(float(reach.max(initial=0.0)))
        return len(centre) - 1

    first = distances(units[:1], units)[0] if len(ids) else np.zeros(0)
    waiting = [node(0, len(ids), first)]
    while waiting:
        at = waiting.pop()
        a, b = begin[at], end[at]
        if b - a <= LEAF or radius[at] == 0.0:
            continue
        half = radius[at] / 2
        rest, groups = order[a:b], []
        while len(rest):  # the first of the rest is the next centre
            reach = distances(units[rest[:1]], units[rest])[0]
            near = reach <= half
            near[0] = True
            groups.append((rest[near], reach[near]))
            rest = rest[~near]
        child[at], children[at], place = len(centre), len(groups), a
        for members, reach in groups:
            order[place : place + len(members)] = members
            waiting.append(node(place, place + len(members), reach))
            place += len(members)
    return {
        "ids": ids[order], "weights": weights[order], "units": units[order], "centre": np.array(centre), "radius": np.array(radius),
        "begin": np.array(begin), "end": np.array(end), "child": np.array(child), "children": np.array(children),
    }


def below(tree: dict[str, np.ndarray], node: int) -> np.ndarray:
    n = int(tree["children"][node])
    return np.arange(tree["child"][node], tree["child"][node] + n) if n else np.array([node])


def walk(a: dict[str, np.ndarray], b: dict[str, np.ndarray], same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all vectors that link; with ``same`` each unequal pair once."""
    limit = np.sqrt(2.0 - 2.0 * cosine) + 1e-9
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def linked(x: np.ndarray, y: np.ndarray) -> None:
        """Exact test of vectors, place by place."""
        hit = np.einsum("ij,ij->i", a["units"][x], b["units"][y]) >= cosine
        left.append(x[hit]), right.append(y[hit])

    waiting = [(0, 0)]
    while waiting:
        p, q = waiting.pop()
        leaves = not a["children"][p] and not b["children"][q]
        if leaves:
            x, y = np.arange(a["begin"][p], a["end"][p]), np.arange(b["begin"][q], b["end"][q])
            i, j = np.nonzero(distances(a["units"][x], b["units"][y]) <= limit)
            if same and p == q:
                i, j = i[i < j], j[i < j]
            linked(x[i], y[j])
            continue
        twin = same and p == q
        ps, qs = below(a, p), below(b, q)
        for strip in range(0, len(ps), STRIP):
            part = ps[strip : strip + STRIP]
            apart = distances(a["units"][a["centre"][part]], b["units"][b["centre"][qs]])
            i, j = np.nonzero(apart <= a["radius"][part][:, None] + b["radius"][qs][None, :] + limit)
            i, j = part[i], qs[j]
            if twin:
                i, j = i[i <= j], j[i <= j]
            single = (a["end"][i] - a["begin"][i] == 1) & (b["end"][j] - b["begin"][j] == 1)
            x, y = a["begin"][i[single]], b["begin"][j[single]]
            if same:
                x, y = x[x != y], y[x != y]
            linked(x, y)
            waiting += zip(i[~single].tolist(), j[~single].tolist())
    return np.concatenate(left), np.concatenate(right)


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of n nodes over links x, y."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            break
    while (root[root] != root).any():
        root = root[root]
    return root


def blocks(rows: pa.Table) -> pa.Table:
    vectors = matrix(rows.column("embedding"))
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    tree = grow(rows.column("id").to_numpy(), rows.column("weight").to_numpy(), units)
    first = {c: pa.array([rows.column(c)[0].as_py()], rows.schema.field(c).type) for c in ("label", "dim", "block")}
    return pa.table({**first, "tree": pa.array([packed(**tree)], pa.binary())})


def walks(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, one, two in zip(*(batch.column(c) for c in range(4))):
                same = i.as_py() == j.as_py()
                a = unpacked(one.as_py())
                b = a if same else unpacked(two.as_py())
                x, y = walk(a, b, same, cosine)
                shift = 0 if same else len(a["ids"])
                n = shift + len(b["ids"])
                ids = a["ids"] if same else np.concatenate([a["ids"], b["ids"]])
                links = np.bincount(x, weights=b["weights"][y], minlength=n) + np.bincount(y + shift, weights=a["weights"][x], minlength=n)
                root = roots(n, x, y + shift)
                some = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[root[some]])],
                    names=["id", "links", "root"],
                )

    return run


def near_vectors(rows: DataFrame, cosine: float = COSINE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of ``rows`` (vec_id, embedding, label): (vec_id, n_links, component_id, kept)."""
    plain = rows.select(F.col("vec_id").cast("long"), "embedding", "label")
    known = usable(plain.filter("label IS NOT NULL")).filter(F.exists("embedding", lambda x: x != 0))
    # Equal vectors are one, known by a 128-bit hash and their smallest id.
    prints = [F.xxhash64("embedding").alias("f1"), F.xxhash64(F.lit(1), "embedding").alias("f2")]
    key = ["label", "dim", "f1", "f2"]
    folded = known.select("vec_id", "embedding", "label", "dim", *prints).groupBy(*key).agg(
        F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"), F.any_value("embedding").alias("embedding")
    ).checkpoint()
    sizes = folded.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    n_blocks = F.ceil(F.col("n") / block_rows).cast("int")
    # A label may own any share of the rows: they are not moved to their number, or split by the join.
    few = sizes.count() <= BROADCAST_LABELS
    sized = folded.join(F.broadcast(sizes), ["label", "dim"]) if few else match(folded, sizes, ["label", "dim"], "inner")
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("f2", "f1"), n_blocks).cast("int"))
    grown = dealt.select("label", "dim", "block", "id", "weight", "embedding").groupBy("label", "dim", "block").applyInArrow(
        blocks, f"label {dict(rows.dtypes)['label']}, dim int, block int, tree binary"
    ).checkpoint()
    one = grown.select("label", "dim", F.col("block").alias("i"), F.col("tree").alias("one"))
    two = grown.select("label", "dim", F.col("block").alias("j"), F.col("tree").alias("two"))
    pairs = one.join(two, ["label", "dim"]).filter("i <= j").select("i", "j", "one", "two")
    found = pairs.repartition("i", "j", F.xxhash64("one")).mapInArrow(walks(cosine), FOUND).checkpoint()
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    classes = (
        folded.select(*key, "id", "weight").join(counts, "id", "left").join(groups, "id", "left")
        .select(*key, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    )
    of = plain.select("vec_id", "label", F.size("embedding").alias("dim"), *prints).join(classes, key, "left")
    own = F.col("vec_id").isNull()
    component = F.when(~own, F.coalesce("component", "vec_id"))
    return of.select(
        "vec_id", F.when(own, F.lit(0)).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
