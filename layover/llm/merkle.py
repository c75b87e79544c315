"""A Merkle manifest of a table: a root over all rows, and for every row the proof that it is part of it.

A row's leaf is the SHA-256 of its columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its
value.  Leaves of one tree (a language, say) ascend by id; every two consecutive nodes, and a last one
alone, become the digest of their hex digests until one remains, the subroot.  Subroots, ordered by tree
(null first, then by bytes), are the leaves of one more tree, whose last node is the root.

The tree is stored in blocks: aligned subtrees of ``HEIGHT`` levels, one row each.  Inside a block the nodes
lie in van Emde Boas order: the tree is split at half its height, the upper half comes first, then every
lower subtree, each laid out the same way; ``address`` computes a node's place from its depth and index
alone, for building and for finding siblings.  The roots of blocks are the leaves of the next layer of
blocks.  Proofs go the other way, from the last layer to the first: a block hands each block below it the
path above that block's root, so a row of at most ``LEAVES`` leaves is all that ever meets in one task.

Null values of any column, the id and the tree included, count as such; null ids come first in their tree.
Rows that share an id are ordered by leaf; exact repeats are leaves of their own.  An empty table has no
rows, no tree and no root.  Other columns take no part, and no column of the table is passed through, so
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layover.llm.scratch import keep

HEIGHT = 8
LEAVES = 1 << HEIGHT
#: A step of a path: 0 without sibling, 1 sibling on the left, 2 on the right; then the sibling's digest.
STEP = 33
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

BLOCKS = "tree string, block long, size long, n int, nodes binary, root binary, names array<string>, claims array<binary>"
HANDED = "tree string, block long, path binary, subroot binary, root binary"
PROOFS = "name string, leaf binary, subroot binary, root binary, proof binary, folded binary"


@dataclass
class Manifest:
    """Layers of blocks, the leaves' first: of the trees, and of the tree over their roots."""

    trees: list[DataFrame]
    forest: list[DataFrame]


# --- the layout of a block -----------------------------------------------------------------


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes ``index`` at ``depth`` of a complete tree with ``levels`` levels, in van Emde Boas order."""
    place = np.zeros(len(index), dtype=np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        levels, depth = levels - top, depth - top
        below = index >> depth  # which of the lower subtrees
        place += (1 << top) - 1 + below * ((1 << levels) - 1)
        index = index & ((1 << depth) - 1)
    return place


def height(size: int) -> int:
    """Levels above the leaves of the blocks of a layer with ``size`` leaves."""
    return HEIGHT if size > LEAVES else (size - 1).bit_length()


def joined(left: bytes, right: bytes = b"") -> bytes:
    return sha256((left.hex() + right.hex()).encode()).digest()


def laid_out(leaves: list[bytes], levels_above: int) -> np.ndarray:
    """Nodes (places, 32) of the block over these leaves; absent nodes are zero."""
    nodes = np.zeros(((2 << levels_above) - 1, 32), dtype=np.uint8)
    level = leaves
    for depth in range(levels_above, -1, -1):
        found = np.frombuffer(b"".join(level), dtype=np.uint8).reshape(-1, 32)
        nodes[address(levels_above + 1, depth, np.arange(len(level)))] = found
        level = [joined(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return nodes


def paths(nodes: np.ndarray, n: int, levels_above: int) -> np.ndarray:
    """Steps (n, levels, STEP) from each leaf of a block to its root."""
    steps = np.zeros((n, levels_above, STEP), dtype=np.uint8)
    for up in range(levels_above):
        node = np.arange(n) >> up
        sibling = node ^ 1
        there = np.flatnonzero(sibling < -(-n // (1 << up)))
        steps[there, up, 0] = 2 - (node[there] & 1)
        steps[there, up, 1:] = nodes[address(levels_above + 1, levels_above - up, sibling[there])]
    return steps


def folded(leaf: bytes, path: str) -> str:
    """The root that a leaf and a path (hex) lead to, as hex."""
    at = leaf.hex()
    for k in range(0, len(path), 2 * STEP):
        side, sibling = path[k + 1], path[k + 2 : k + 2 * STEP]
        both = at if side == "0" else sibling + at if side == "1" else at + sibling
        at = sha256(both.encode()).hexdigest()
    return at


def proof(path: str) -> bytes:
    """Digest of a path's siblings."""
    steps = range(0, len(path), 2 * STEP)
    return sha256("".join([path[k + 2 : k + 2 * STEP] for k in steps if path[k + 1] != "0"]).encode()).digest()


# --- building ------------------------------------------------------------------------------


def leaf(columns: list[Column]) -> Column:
    """Digest of a row's values."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def tree_key(tree: Column) -> Column:
    """A tree's name that is never null and sorts as trees do."""
    return F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit("-"))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their ``place`` in their ``tree`` and the tree's ``size``.

    Rows are dealt out by ranges of tree and order, so a tree may cover many tasks; only counts per tree and
    task are added up.  Rows that are alike in all of it are told apart, so they too may cover several tasks.
    """
    told = rows.withColumn("nth", F.monotonically_increasing_id())
    ranged = told.repartitionByRange("tree", *order, "nth").sortWithinPartitions("tree", *order, "nth")
    kept = keep(ranged.drop("nth", *set(order) - {"name", "digest", "claim"}).withColumn("row", F.monotonically_increasing_id()), "merkle-leaves")
    rows_in = kept.withColumn("task", F.shiftright("row", 33))
    counts = rows_in.groupBy("tree", "task").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    tree = W.partitionBy("tree")
    before = F.sum("n").over(tree.orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    starts = counts.select(
        "tree", "task", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size")
    )
    return rows_in.join(starts, ["tree", "task"]).withColumn("place", F.col("row") + F.col("shift")).drop("task", "row", "shift")


def block_of(table: pa.Table) -> pa.Table:
    """The block over up to ``LEAVES`` leaves of one tree."""
    table = table.sort_by("place")
    size, leaves = table["size"][0].as_py(), table["digest"].to_pylist()
    nodes = laid_out(leaves, height(size))
    block = table["place"][0].as_py() >> HEIGHT
    found = [table["tree"][0].as_py(), block, size, len(leaves), nodes.tobytes(), nodes[0].tobytes(),
             table["name"].to_pylist(), table["claim"].to_pylist()]
    names = ["tree", "block", "size", "n", "nodes", "root", "names", "claims"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.binary())]
    return pa.table({name: pa.array([value], kind) for name, value, kind in zip(names, found, kinds)})


def layers(leaves: DataFrame) -> list[DataFrame]:
    """Layers of blocks over leaves (tree, place, size, digest, name, claim), until every tree has one block."""
    size = leaves.agg(F.max("size")).first()[0] or 1
    found = []
    while True:
        blocks = leaves.groupBy("tree", F.shiftright("place", HEIGHT)).applyInArrow(block_of, BLOCKS)
        found.append(keep(blocks, "merkle-blocks"))
        if size <= LEAVES:
            return found
        size = -(-size // LEAVES)
        leaves = found[-1].filter(F.col("size") > LEAVES).select(
            "tree", F.col("block").alias("place"), F.ceil(F.col("size") / LEAVES).alias("size"),
            F.col("root").alias("digest"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("binary").alias("claim"),
        )


def build(
    docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id: str = "doc_id", tree: str = "lang", claim: Column | None = None
) -> Manifest:
    """The manifest of a table.

    ``claim`` may give a leaf to check against the manifest in place of a row's own; null checks the own one.
    """
    rows = docs.select(
        tree_key(F.col(tree)).alias("tree"), F.col(id).alias("id"), F.col(id).cast("string").alias("name"),
        leaf([F.col(c) for c in columns]).alias("digest"),
        (F.lit(None) if claim is None else claim).cast("binary").alias("claim"),
    )
    trees = layers(placed(rows, ["id", "digest"]))
    tops = [layer.filter(F.col("size") <= LEAVES) for layer in trees]
    roots = tops[0]
    for top in tops[1:]:
        roots = roots.unionByName(top)
    subroots = roots.select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"), F.lit(None).cast("binary").alias("claim")
    )
    return Manifest(trees, layers(placed(subroots, ["name"])))


# --- proofs --------------------------------------------------------------------------------


def steps_of(row: dict) -> list[bytes]:
    """Per leaf of a block the path to the root of all."""
    above = height(row["size"])
    nodes = np.frombuffer(row["nodes"], dtype=np.uint8).reshape(-1, 32)
    return [p.tobytes() + row["path"] for p in paths(nodes, row["n"], above)]


def of_blocks(rows_of: Callable[[dict], list[tuple]], schema: pa.Schema):
    """A function for ``mapInArrow`` that makes rows from each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = rows_of(batch.slice(i, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def below(row: dict) -> list[tuple]:
    """What a block hands to the blocks below it."""
    first = row["block"] << HEIGHT
    return [(row["tree"], first + i, p, row["subroot"], row["top"]) for i, p in enumerate(steps_of(row))]


def under_forest(row: dict) -> list[tuple]:
    """What a block of the forest hands to the trees whose roots are its leaves."""
    nodes = np.frombuffer(row["nodes"], dtype=np.uint8).reshape(-1, 32)
    leaves = nodes[address(height(row["size"]) + 1, height(row["size"]), np.arange(row["n"]))]
    return [(name, 0, p, sub.tobytes(), row["top"]) for name, p, sub in zip(row["names"], steps_of(row), leaves)]


def proved(row: dict) -> list[tuple]:
    """Proofs of a block's leaves, and the root that each leaf, or what is claimed to be it, leads to."""
    above = height(row["size"])
    nodes = np.frombuffer(row["nodes"], dtype=np.uint8).reshape(-1, 32)
    leaves = nodes[address(above + 1, above, np.arange(row["n"]))]
    out = []
    for name, claim, own, path in zip(row["names"], row["claims"], leaves, steps_of(row)):
        own, text = own.tobytes(), path.hex()
        out.append((name, own, row["subroot"], row["top"], proof(text), bytes.fromhex(folded(claim or own, text))))
    return out


HANDED_SCHEMA = pa.schema(
    {"tree": pa.string(), "block": pa.int64(), "path": pa.binary(), "subroot": pa.binary(), "root": pa.binary()}
)
PROOFS_SCHEMA = pa.schema(
    {k: pa.string() if k == "name" else pa.binary() for k in ("name", "leaf", "subroot", "root", "proof", "folded")}
)


def met(layer: DataFrame, handed: DataFrame) -> DataFrame:
    """Blocks with the path above each."""
    return layer.join(handed.withColumnRenamed("root", "top"), ["tree", "block"])


def proofs(manifest: Manifest) -> DataFrame:
    """One row per row of the table: (name, leaf, subroot, root, proof, folded), digests as bytes.

    ``name`` is the id as text, ``proof`` the digest of all siblings from the leaf up, left to right, and
    ``folded`` the root recomputed from the leaf, or from the claim in its place.
    """
    hand = of_blocks(below, HANDED_SCHEMA)
    handed = manifest.forest[-1].select("tree", "block", F.lit(b"").alias("path"), F.col("root").alias("subroot"), "root")
    for layer in reversed(manifest.forest[1:]):
        handed = met(layer, handed).mapInArrow(hand, HANDED)
    subroots = met(manifest.forest[0], handed).mapInArrow(of_blocks(under_forest, HANDED_SCHEMA), HANDED)
    subroots, handed = keep(subroots, "merkle-subroots"), None
    for layer in reversed(manifest.trees):
        # Trees that end in this layer take their path from the forest, others from the layer above.
        ready = met(layer.filter(F.col("size") <= LEAVES), subroots)
        if handed is not None:
            ready = ready.unionByName(met(layer.filter(F.col("size") > LEAVES), handed))
        if layer is not manifest.trees[0]:
            handed = keep(ready.mapInArrow(hand, HANDED), "merkle-paths")
    return ready.mapInArrow(of_blocks(proved, PROOFS_SCHEMA), PROOFS)


def root(manifest: Manifest) -> DataFrame:
    """The root of everything, one row; none for an empty table."""
    return manifest.forest[-1].filter(F.col("size") <= LEAVES).select("root")
