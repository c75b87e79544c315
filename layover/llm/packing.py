"""Packing token sequences into windows by non-negative least squares over a length histogram.

A document's tokens, with an end token, are cut into whole windows and one remainder.  Remainders are
packed by their lengths: all pairs and triples of lengths that fill a window exactly are candidate
combinations; a non-negative least squares fit of their repeat counts to the histogram of lengths,
rounded down to what is there, says how often each is used.  What rounding leaves over is packed
greedily, one after the other, cut where a window ends.

The fit sees only the histogram, at most 1,023 numbers; pieces find their places by rank within their
length, counted per input partition and summed up, so no task sees all pieces of a length.

A null text is an empty one: its end token alone.  Rows are documents; repeated rows or ids are packed
as often as they occur, a null id included.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layover.llm.blocks import Block, Hasher, Lookup, blocks, mix
from layover.llm.scratch import gives_back, keep

#: Fixed: how byte-level tokenizers cut a text before merging.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW = 1024
END_TOKEN = 0
SWEEPS = 6
#: Distinct space-separated units a worker remembers before it starts afresh.
REMEMBERED = 1 << 20
#: Tokens that one task packs greedily.
GREEDY_TOKENS = 1 << 22

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, chunk int, rank long"


def merger(spec: dict):
    """The same byte-pair merges in the faster of the two public libraries, or None where they may differ.

    It applies where a merge's rank follows from its token's number, as in the byte-level vocabularies
    whose tokens were numbered in the order of their merges.
    """
    import tiktoken

    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    made = [model["vocab"].get(a + b, -1) for a, b in merges]
    if not level or spec.get("normalizer") or model.get("dropout") or made != sorted(made) or -1 in made:
        return None
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("bytes", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Encodes whole blocks of texts; every distinct unit between single spaces is tokenised once.

    Byte-level pre-tokenisation begins a new piece at a space that stands alone between two characters
    that are not white space, so units can be encoded one by one.  Units are found and looked up as
    64-bit hashes for a block at a time.  New ones made of ASCII and two-byte letters are merged many in
    one string, and the bytes of their tokens tell where each ends; others go to the tokenizer itself.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.fast = merger(json.loads(tokenizer_json))
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)  # one letter of the byte-level alphabet per byte
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.hasher = Hasher(lower=False)
        self.plain = np.zeros(256, dtype=bool)
        self.plain[0x21:0x7F] = True
        self.forget()

    def forget(self) -> None:
        self.table = Lookup(np.zeros(0, np.uint64))
        self.begin, self.size, self.pool = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def units(self, block: Block) -> np.ndarray:
        """First byte of every unit: text starts, and spaces between characters that are certainly none.

        Beyond ASCII only two-byte characters from U+00C0 count as certain; a unit is longer otherwise.
        """
        data, n = block.data, len(block.data)
        begins = np.zeros(n, dtype=bool)
        if n > 2:
            two = (data >= 0xC3) & (data < 0xE0)
            before = self.plain[data]
            before[1:] |= two[:-1]
            begins[1:-1] = (data[1:-1] == 0x20) & before[:-2] & (self.plain[data[2:]] | two[2:])
            inner = block.offsets[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            begins[inner - 1] = False  # a space that ends a text
        starts = block.offsets[:-1][np.diff(block.offsets) > 0]
        begins[starts] = True
        return np.flatnonzero(begins)

    def learn(self, block: Block, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        data, size = block.data, end - start
        last = data[end - 1]
        odd = np.concatenate([[0], np.cumsum((data >= 0xE0) | (data == 0xC2), dtype=np.int64)])
        # Joined units must begin and end where the tokenizer certainly cuts.
        closed = self.plain[last] | ((size > 1) & (data[end - 2] >= 0xC3) & (data[end - 2] < 0xE0))
        good = (data[start] == 0x20) & (size > 1) & closed & (odd[end] == odd[start])
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        joined = data[at[np.repeat(good, size)]].tobytes()
        if self.fast is None or any(mark in joined for mark in self.special):
            good[:], joined = False, b""
        counts = np.zeros(len(keys), np.int64)
        found = np.array(self.fast.encode_ordinary(joined.decode()) if joined else [], dtype=np.uint32)
        if len(found):
            stops = np.searchsorted(np.cumsum(self.bytes_of[found]), np.cumsum(size[good])) + 1
            counts[good] = np.diff(stops, prepend=0)
        begin = np.zeros(len(keys), np.int64)
        begin[good] = len(self.pool) + np.cumsum(counts[good]) - counts[good]
        parts, place, raw = [self.pool, found], len(self.pool) + len(found), data.tobytes()
        for i in np.flatnonzero(~good):
            ids = self.tokenizer.encode(raw[start[i] : end[i]].decode("utf-8", "replace"), add_special_tokens=False).ids
            parts.append(np.array(ids, dtype=np.uint32))
            begin[i], counts[i], place = place, len(ids), place + len(ids)
        self.pool = np.concatenate(parts)
        known = np.concatenate([self.table.keys[:-1], keys])
        order = np.argsort(known, kind="stable")  # two ascending runs
        self.begin = np.append(np.concatenate([self.begin[:-1], begin])[order], 0)
        self.size = np.append(np.concatenate([self.size[:-1], counts])[order], 0)
        self.table = Lookup(known[order])

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all texts, tokens per text)."""
        if len(self.size) > REMEMBERED:
            self.forget()
        start = self.units(block)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(block.n, np.int64)
        end = np.append(start[1:], len(block.data))
        p = self.hasher.prefix(block.data)
        keys = mix((p[end] - p[start]) * self.hasher.down[start] + (end - start).astype(np.uint64))
        at = self.table.find(keys)
        fresh = np.flatnonzero(at == len(self.table.keys) - 1)
        if len(fresh):
            found, first = np.unique(keys[fresh], return_index=True)
            self.learn(block, found, start[fresh[first]], end[fresh[first]])
            at = self.table.find(keys)
        sizes = self.size[at]
        stops = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.begin[at] - (stops - sizes), sizes) + np.arange(stops[-1])]
        edges = np.append(0, stops)[np.searchsorted(start, block.offsets)]
        return ids, np.diff(edges)


def cut(tokenizer_json: str, window: int):
    """Tokens of every document, cut into whole windows and a remainder, ranked per length in this task."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, chunk = Encoder(tokenizer_json), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, dtype=np.int64)
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids, sizes = encoder.encode(block)
                # Every document gets its end token.
                ids = np.insert(ids, np.cumsum(sizes), np.uint32(END_TOKEN)).astype("<u4")
                sizes = sizes + 1
                pieces = -(-sizes // window)
                doc = np.repeat(np.arange(block.n), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(sizes[doc] - start, window)
                order = np.argsort(length, kind="stable")
                run_start = np.searchsorted(length[order], length[order])
                rank = np.empty(len(doc), np.int64)
                rank[order] = seen[length[order]] + np.arange(len(doc)) - run_start
                seen += np.bincount(length, minlength=window + 1)
                edges = pa.py_buffer((np.append(0, np.cumsum(length)) * 4).astype(np.int32).tobytes())
                raw = pa.Array.from_buffers(pa.binary(), len(doc), [None, edges, pa.py_buffer(ids.tobytes())])
                owners = batch.column(0).slice(block.first, block.n).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays(
                    [
                        owners, pa.array(start), pa.array(length), raw, pa.array(sizes[doc]),
                        pa.array(np.full(len(doc), chunk, np.int32)), pa.array(rank),
                    ],
                    names=[f.split()[0] for f in PIECES.split(", ")],
                )

    return run


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of the lengths that fill the window, ascending; a pair has a 0 in front."""
    there = np.zeros(window + 1, dtype=bool)
    there[lengths] = True
    low = lengths[2 * lengths <= window]
    pairs = low[there[window - low]]
    found = [np.stack([np.zeros_like(pairs), pairs, window - pairs], axis=1)]
    for a in lengths[3 * lengths <= window]:
        b = lengths[(lengths >= a) & (a + 2 * lengths <= window)]
        b = b[there[window - a - b]]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], axis=1))
    return np.concatenate(found)


def repeats(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """How often each combination is used: least squares with counts of at least 0, rounded to what is there.

    Coordinate descent: each combination in turn takes the count that fits the histogram best.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v), dtype=np.int64)
    if not len(lengths):
        return []
    table = [tuple(c) if c[0] else tuple(c[1:]) for c in combinations(lengths, window).tolist()]
    weight = [len(c) + 2 * (len(c) - len(set(c))) if len(set(c)) > 1 or len(c) == 2 else 9 for c in table]
    rest, fitted = [0.0] * (window + 1), [0.0] * len(table)
    for length, n in histogram.items():
        rest[length] = float(n)
    for _ in range(SWEEPS):
        for j, combination in enumerate(table):
            step = 0.0
            for length in combination:
                step += rest[length]
            step = max(step / weight[j], -fitted[j])
            if step:
                fitted[j] += step
                for length in combination:
                    rest[length] -= step
    left, plan = dict(histogram), []
    for j in sorted(range(len(table)), key=lambda j: (-fitted[j], j)):
        if fitted[j] < 0.5:
            break
        uses = {length: table[j].count(length) for length in table[j]}
        n = min(round(fitted[j]), *(left[length] // k for length, k in uses.items()))
        if n > 0:
            plan.append((table[j], n))
            for length, k in uses.items():
                left[length] -= n * k
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Ranks of each length by place: (length, first rank, rank after, first sequence, offset); sequences used."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for combination, n in plan:
        offset = 0
        for length in combination:
            at = taken.get(length, 0)
            out.append((length, at, at + n, sequence, offset))
            taken[length] = at + n
            offset += length
        sequence += n
    return out, sequence


def pack(docs: DataFrame, tokenizer_json: str, window: int = WINDOW) -> DataFrame:
    """Pieces in their places: (doc_id, start, length, ids, doc_tokens, sequence_id, offset).

    ``ids`` are unsigned little-endian 32-bit numbers.  ``docs`` needs doc_id and text.  A sequence's
    pieces lie one after the other from offset 0 and hold ``window`` tokens, but for the last sequence
    of each greedy task.
    """
    pieces = keep(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut(tokenizer_json, window), PIECES), "pieces")
    spark = docs.sparkSession
    counts = pieces.groupBy("chunk", "length").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    before = F.sum("n").over(W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("chunk", "length", F.coalesce(before, F.lit(0)).alias("before"))
    # At most `window` rows, whatever the input.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    whole = histogram.pop(window, 0)
    places, used = slots(repeats(histogram, window))
    table = spark.createDataFrame(places, "__length long, from_rank long, to_rank long, first_sequence long, place long")

    ranked = pieces.join(offsets.hint("shuffle_hash"), ["chunk", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ["doc_id", "start", "length", "ids", "doc_tokens"]
    rank = F.col("rank")
    # The table of places is bounded by the number of combinations, a constant of the window.
    found = ranked.join(
        F.broadcast(table),
        (F.col("length") == F.col("__length")) & (rank >= F.col("from_rank")) & (rank < F.col("to_rank")),
        "left",
    )
    sequence = F.when(F.col("length") == window, rank + used).otherwise(F.col("first_sequence") + rank - F.col("from_rank"))
    offset = F.when(F.col("length") == window, F.lit(0).cast("long")).otherwise(F.col("place"))
    placed = found.select(*columns, sequence.alias("sequence_id"), offset.alias("offset"))

    fixed: dict[int, int] = {}
    for length, _, to, _, _ in places:
        fixed[length] = max(fixed.get(length, 0), to)
    over = sum((n - fixed.get(length, 0)) * length for length, n in histogram.items())
    if not over:
        return placed
    groups = -(-over // GREEDY_TOKENS)
    limits = spark.createDataFrame([(k, fixed.get(k, 0)) for k in histogram], "length long, fixed long")
    # Left over: ranks beyond those that combinations use.
    odd = ranked.join(F.broadcast(limits), "length").filter("rank >= fixed")
    odd = odd.withColumn("greedy", F.pmod(F.xxhash64("length", "rank"), F.lit(groups)))
    run = W.partitionBy("greedy").orderBy(F.col("length").desc(), "rank").rowsBetween(W.unboundedPreceding, -1)
    odd = odd.withColumn("at", F.coalesce(F.sum("length").over(run), F.lit(0)))
    per_group = -(-over // window) + 1  # more than any group can use
    first = F.floor(F.col("at") / window)
    last = F.floor((F.col("at") + F.col("length") - 1) / window)
    parts = odd.select("*", F.explode(F.sequence(first, last)).alias("nth"))
    begin = F.greatest(F.col("nth") * window - F.col("at"), F.lit(0))
    end = F.least((F.col("nth") + 1) * window - F.col("at"), F.col("length"))
    cut_up = parts.withColumn("begin", begin).withColumn("size", end - begin)
    greedy = cut_up.select(
        "doc_id",
        (F.col("start") + F.col("begin")).alias("start"),
        F.col("size").alias("length"),
        F.substring("ids", (F.col("begin") * 4 + 1).cast("int"), (F.col("size") * 4).cast("int")).alias("ids"),
        "doc_tokens",
        (F.lit(used + whole) + F.col("greedy") * per_group + F.col("nth")).alias("sequence_id"),
        (F.col("at") + F.col("begin") - F.col("nth") * window).alias("offset"),
    )
    return placed.filter("sequence_id IS NOT NULL").unionByName(greedy)
