"""Repeated strings of 50 bytes removed, found by merging Burrows-Wheeler transforms of shards.

Every window of 50 bytes names an anchor: of its 20-byte strings the one with the smallest hash.  Equal
windows name equal anchors, so only anchors that stand in two documents can hold a repeated window, and
all equal windows meet under one anchor.  Consecutive windows of one anchor are a segment; segments equal
byte for byte are folded into one with their smallest document.  An anchor left with one segment has no
two strings to compare: all its windows first stand in that document.

Segments of the other anchors are dealt by anchor to tasks of a few megabytes.  There those that share no 40
bytes around their anchor with another segment are set aside, as no window of theirs stands elsewhere.  A task sorts
the suffixes of two shards of the others, takes their transforms, and merges these by interleave refinement: in round t the
interleaving that sorts the suffixes of both shards by 2t bytes follows from that of round t - 1 by one
stable pass over the transforms, which hold the two bytes before a suffix, and so do the places where the
common prefix ends.  After 25 rounds the suffixes between two such places share 50 bytes: a repeated interval.  The smallest document of an
interval decides its windows; no suffix is compared with another one again.

Matches never cross documents.  A null text is empty.  A row with a null id has no place in the order: it
loses nothing and nothing is lost to it.  Exact repeats of a row are judged alike, and a document is not
a repeat of itself.  Different texts must not share an id.  Anchors and segments are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layover.llm.blocks import Block, Hasher, blocks, mix
from layover.llm.scratch import keep, release

LENGTH = 50
GRAM = 20
#: Bits of a place within a text block; the other bits order anchors.
PLACE_BITS = 28
#: Bytes before and after an anchor.  Wherever a window has its anchor, it holds one of these strings around it.
AROUND = ((0, 20), (10, 10), (20, 0))
#: Bytes of segments that one task merges.
TASK_BYTES = 3 << 20

#: ``at`` holds a segment's first byte and, in its low bits, its windows less one: they are 31 at most.
OCCURRENCES = "doc_id long, at long, anchor long, segment long"
WINDOW_BITS = 5
FIRSTS = "anchor long, segment long, runs array<struct<at:int,first:long>>"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:int,end:int>>"


def anchors_of(hasher: Hasher, block: Block) -> tuple[np.ndarray, ...]:
    """(text, first byte in the block, windows, anchor, segment) of every segment of a block."""
    none = np.zeros(0, np.int64)
    sizes = np.maximum(np.diff(block.offsets) - LENGTH + 1, 0)
    total = int(sizes.sum())
    if not total:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    p = hasher.prefix(block.data)
    n = len(block.data) - GRAM + 1
    grams = mix((p[GRAM:] - p[:-GRAM]) * hasher.down[:n])
    mask = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~mask) | np.arange(n, dtype=np.uint64)
    span, wanted = 1, LENGTH - GRAM + 1
    while span < wanted:  # minima of 1, 2, 4, … grams, then of all in a window
        step = min(span, wanted - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    text = np.repeat(np.arange(block.n), sizes)
    window = np.arange(total) + np.repeat(block.offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)
    place = (least[window] & mask).astype(np.int64)
    fresh = np.ones(total, dtype=bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh)
    n_windows = np.diff(np.append(first, total))
    start = window[first]
    end = start + n_windows - 1 + LENGTH
    segment = mix((p[end] - p[start]) * hasher.down[start] + (end - start).astype(np.uint64))
    return text[first], start, n_windows, grams[place[first]], segment


def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(lower=False)
    for batch in batches:
        for block in blocks(batch.column(1)):
            text, start, n, anchor, segment = anchors_of(hasher, block)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(block.first, block.n).take(pa.array(text)),
                    pa.array(((start - block.offsets[text]) << WINDOW_BITS) + n - 1),
                    pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64)),
                ],
                names=[f.split()[0] for f in OCCURRENCES.split(", ")],
            )


def suffixes(codes: np.ndarray) -> np.ndarray:
    """Suffixes of a string in order of at least their first 64 codes; its last code is 0 and nowhere else."""
    n = len(codes)
    bits = max(int(codes.max()).bit_length(), 1)
    reach = 64 // bits  # so many codes fit a key
    wide = np.zeros(n + reach, dtype=np.uint64)
    wide[:n] = codes
    key = np.zeros(n, dtype=np.uint64)
    for k in range(reach):
        key = (key << np.uint64(bits)) | wide[k : k + n]
    while True:
        order = np.argsort(key)  # equal keys get equal ranks, so their order is free
        ordered = key[order]
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1])).astype(np.uint64)
        if reach >= 64 or rank[order[-1]] == n - 1:
            return order
        later = np.zeros(n, dtype=np.uint64)
        later[: n - reach] = rank[reach:] + np.uint64(1) if n > reach else 0
        key = (rank << np.uint64(32)) | later
        reach *= 2


def transform(codes: np.ndarray, order: np.ndarray, kinds: int, step: int) -> np.ndarray:
    """The ``step`` codes, 1 or 2, before every suffix as one number, in order; before the first stands the last, 0."""
    if step == 1:
        return codes[order - 1]
    return codes[(order - 2) % len(codes)].astype(np.uint16) * np.uint16(kinds) + codes[order - 1]


def interleave(one: np.ndarray, two: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge two transforms: which shard each suffix is from, and the number of its interval.

    Suffixes of one interval agree in as many codes as ``rounds`` entries of the transforms hold.
    """
    n = len(one) + len(two)
    state = np.zeros(n, dtype=np.int32)  # of each suffix the interval, and in the lowest bit the shard
    state[len(one) :] = 1
    codes = np.empty(n, dtype=one.dtype)
    cut = np.zeros(n, dtype=bool)
    most = int(max(one.max(), two.max())) + 1
    counts = np.bincount(one, minlength=most) + np.bincount(two, minlength=most)
    first = (np.cumsum(counts) - counts)[counts > 0][1:]
    for _ in range(rounds):
        source = (state & 1).astype(bool)
        codes[np.flatnonzero(~source)] = one
        codes[np.flatnonzero(source)] = two
        state = state[np.argsort(codes, kind="stable")]
        np.greater(state[1:] ^ state[:-1], 1, out=cut[1:])
        cut[first] = True  # where the next code begins
        interval = np.cumsum(cut, dtype=np.int32)
        state = (interval << 1) | (state & 1)
    return (state & 1).astype(bool), state >> 1


def first_documents(first: np.ndarray, data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Smallest document of every window of segments: windows of segment 0, then of segment 1, …

    ``data`` holds the segments' bytes one after the other, ``first`` their smallest documents.
    """
    n, far = len(first), np.iinfo(np.int64).max
    half = int(np.searchsorted(np.cumsum(size), size.sum() // 2, side="right")) if n > 1 else n
    half = min(max(half, 1), n)
    begin = np.cumsum(size) - size
    used, dense = np.unique(data, return_inverse=True)
    kind = np.uint8 if len(used) + 2 <= 256 else np.uint16
    shards = []
    for a, b in ((0, half), (half, n)):
        # Bytes from 2; 1 after every segment; 0 at the end of the shard.
        part, lengths = dense[begin[a] : begin[a] + size[a:b].sum()] if b > a else dense[:0], size[a:b]
        ends = np.cumsum(lengths)
        codes = np.append(np.insert(part + 2, ends, 1), 0).astype(kind)
        # Of each place the segment, and whether a window begins there.
        owner = np.append(np.repeat(np.arange(a, b), lengths + 1), -1)
        left = np.append(np.repeat(ends + np.arange(b - a), lengths + 1), 0) - np.arange(len(codes))
        order = suffixes(codes)
        shards.append((codes, order, owner, (left >= LENGTH) & (owner >= 0)))
    # Two codes at a time where both fit sixteen bits, which are sorted by counting.
    kinds = len(used) + 2
    step = 2 if kinds <= 256 and LENGTH % 2 == 0 else 1
    source, interval = interleave(*(transform(c, o, kinds, step) for c, o, _, _ in shards), LENGTH // step)
    value = np.full(len(source), far, dtype=np.int64)
    sides = (~source, source)
    for side, (_, order, owner, window) in zip(sides, shards):
        value[side] = np.where(window[order], first[owner[order]], far)
    starts = np.flatnonzero(np.append(True, interval[1:] != interval[:-1]))
    least = np.repeat(np.minimum.reduceat(value, starts), np.diff(np.append(starts, len(value))))
    out = []
    for side, (codes, order, _, window) in zip(sides, shards):
        at = np.empty(len(codes), dtype=np.int64)
        at[order] = least[side]
        out.append(at[window])
    return np.concatenate(out)


def may_share(anchor: np.ndarray, data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which segments have a string around their anchor in common with another one; all others share no window.

    A window has its anchor at the same byte wherever it stands, and a segment at its first occurrence, because ties go
    to the first.  Equal hashes of different strings only keep a segment in.
    """
    hasher = Hasher(lower=False)
    p, end = hasher.prefix(data), np.cumsum(size)
    begin = end - size
    owner = np.repeat(np.arange(len(size)), size)[: len(data) - GRAM + 1]
    grams = mix((p[GRAM:] - p[:-GRAM]) * hasher.down[: len(owner)])
    hit = np.flatnonzero(grams == anchor[owner])
    hit = hit[hit + GRAM <= end[owner[hit]]]
    known, first = np.unique(owner[hit], return_index=True)
    place = hit[first]
    out = np.ones(len(size), dtype=bool)
    out[known] = False
    for before, after in AROUND:
        start, stop = place - before, place + GRAM + after
        fits = (start >= begin[known]) & (stop <= end[known])
        start, stop = start[fits], stop[fits]
        _, of, n = np.unique((p[stop] - p[start]) * hasher.down[start], return_inverse=True, return_counts=True)
        out[known[fits][n[of] > 1]] = True
    return out


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First documents of all windows of the task's segments (anchor, segment, first, bytes)."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found).combine_chunks()
    raw = table.column("bytes").cast(pa.large_binary()).combine_chunks()
    block = next(blocks(raw, limit=1 << 62))
    size = np.diff(block.offsets)
    windows = size - LENGTH + 1
    first = table.column("first").to_numpy()
    value, shares = np.repeat(first, windows), may_share(table.column("anchor").to_numpy().view(np.uint64), block.data, size)
    if shares.any():
        value[np.repeat(shares, windows)] = first_documents(first[shares], block.data[np.repeat(shares, size)], size[shares])
    owner = np.repeat(np.arange(len(size)), windows)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    fresh = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))
    edges = np.append(0, np.cumsum(np.bincount(owner[fresh], minlength=len(size)))).astype(np.int32)
    runs = pa.StructArray.from_arrays([pa.array(at[fresh].astype(np.int32)), pa.array(value[fresh])], names=["at", "first"])
    whole = pa.table({
        "anchor": table.column("anchor"), "segment": table.column("segment"), "runs": pa.ListArray.from_arrays(pa.array(edges), runs),
    })
    yield from whole.to_batches(max_chunksize=20_000)


def placed(rows: DataFrame) -> DataFrame:
    """``at`` as the first byte (start) and the number of windows (n)."""
    n = F.col("at").bitwiseAND(F.lit((1 << WINDOW_BITS) - 1)) + 1
    return rows.withColumn("start", F.shiftright("at", WINDOW_BITS).cast("int")).withColumn("n", n.cast("int")).drop("at")


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the union of their ranges."""
    for batch in batches:
        ids, texts, ranges = batch.column(0), batch.column(1), batch.column(2)
        for at in range(0, batch.num_rows, 500):
            rows = []
            for i in range(at, min(at + 500, batch.num_rows)):
                data, spans = (texts[i].as_py() or "").encode(), []
                found = ranges[i]
                if found.is_valid and len(found):
                    a = found.values.field(0).to_numpy().astype(np.int64)
                    b = found.values.field(1).to_numpy().astype(np.int64)
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    fresh = np.append(True, a[1:] > b[:-1])
                    starts = a[fresh]
                    ends = b[np.append(np.flatnonzero(fresh)[1:] - 1, len(b) - 1)]
                    spans = list(zip(starts.tolist(), ends.tolist()))
                kept, place = [], 0
                for a, b in spans:
                    kept.append(data[place:a])
                    place = b
                kept.append(data[place:])
                rows.append((ids[i].as_py(), len(data), sum(b - a for a, b in spans), len(spans), b"".join(kept), [{"start": a, "end": b} for a, b in spans]))
            kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def repeated_ranges(plain: DataFrame) -> DataFrame:
    """Byte ranges (doc_id, start, end) that repeat an earlier document; ranges may overlap."""
    spark = plain.sparkSession
    known = plain.filter("doc_id IS NOT NULL")
    by_anchor = W.partitionBy("anchor")
    stands = known.mapInArrow(occurrences, OCCURRENCES)
    both = stands.withColumn("low", F.min("doc_id").over(by_anchor)).withColumn("high", F.max("doc_id").over(by_anchor))
    shared = keep(both.filter("low < high").drop("low", "high"), "bwt-anchors")
    release(spark)
    first = F.min(F.struct("doc_id", "at")).alias("first")
    segments = shared.groupBy("anchor", "segment").agg(first).withColumn("kinds", F.count(F.lit(1)).over(by_anchor))
    segments = placed(keep(segments.select("anchor", "segment", "first.*", "kinds"), "bwt-segments"))
    several = segments.filter("kinds > 1")
    size = several.agg(F.sum(F.col("n") + LENGTH - 1)).first()[0] or 0
    raw = F.col("text").cast("binary")  # not encode(), which reads the whole text anew for each of its segments
    texts = several.join(known.dropDuplicates(["doc_id"]), "doc_id").select(
        "anchor", "segment", F.col("doc_id").alias("first"), F.substring(raw, F.col("start") + 1, F.col("n") + LENGTH - 1).alias("bytes")
    )
    tasks = max(1, -(-size // TASK_BYTES))
    merged = texts.repartition(tasks, "anchor").mapInArrow(merge, FIRSTS)
    alone = segments.filter("kinds = 1").select(
        "anchor", "segment", F.array(F.struct(F.lit(0).alias("at"), F.col("doc_id").alias("first"))).alias("runs")
    )
    firsts = keep(merged.unionByName(alone), "bwt-firsts")
    release(spark)
    judged = placed(shared.join(firsts, ["anchor", "segment"]))
    stop = lambda k: F.coalesce(F.get("runs", k + 1)["at"], F.col("n"))
    ranges = F.transform(
        "runs",
        lambda r, k: F.struct(
            (F.col("start") + r["at"]).alias("start"), (F.col("start") + stop(k) + LENGTH - 1).alias("end"), r["first"].alias("first")
        ),
    )
    repeats = F.filter(ranges, lambda r: r["first"] < F.col("doc_id"))
    return judged.select("doc_id", F.explode(repeats).alias("r")).select("doc_id", "r.start", "r.end")


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans) for every row of ``docs`` (doc_id, text).

    ``kept`` are the bytes that remain, ``spans`` the maximal removed runs of the original text.
    """
    plain = docs.select(F.col("doc_id").cast("long"), "text")
    found = repeated_ranges(plain).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return plain.join(found, "doc_id", "left").select("doc_id", "text", "ranges").mapInArrow(cut_out, RESULT)


def digest(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
