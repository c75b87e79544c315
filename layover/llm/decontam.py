"""Benchmark passages in documents, by Wu-Manber search over words.

A to Z are lower-cased; words are runs of letters, digits and everything beyond ASCII.  A pattern is
``WINDOW`` consecutive words of an item, or all words of an item that has fewer.  Patterns of one length
are searched together.  Words are the symbols of the search, two of them a block: a table says for every
block how far the end of a window may move on without passing a pattern (nine words at most for patterns
of ten), so most words are never looked at.  Where it may not move, the last block of the window, with its
first one, selects a bucket of patterns, and each of these is compared with the words byte by byte.  Many
places of a text are moved on at once, so the search runs in numpy.

Patterns reach the tasks in shards of at most ``SHARD_BYTES``; a larger benchmark gives several shards,
each of which all documents pass, so nothing is left out and no shard outgrows a task.

A null text has no words.  Rows that share an id stay apart, as do repeated rows: one row comes back for
each.  Items that share an id are one item; an item without an id hits words and is named nowhere, one
without words is never found.  Without documents there are no rows, without items no hits.  No other column
is read, so names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layover.llm.blocks import Block, Hasher, Lookup, Words, blocks, mix
from layover.llm.scratch import keep

WINDOW = 10
#: Patterns of one shard, their items and their search tables take about this many bytes at most.
SHARD_BYTES = 64 << 20
#: What a pattern takes beside its bytes.
PATTERN_BYTES = 400
#: Ends of windows that one cursor passes, and candidates compared at a time.
LANE, AT_ONCE = 128, 1 << 15

PATTERNS = "words int, pattern binary, ends array<int>, item string"
FOUND = "doc_id long, n_words long, hits array<struct<start:int,stop:int>>, items array<string>"
HITS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def separators() -> np.ndarray:
    """Bytes between words: all of ASCII but digits and letters."""
    table = np.ones(256, dtype=bool)
    table[128:] = table[48:58] = table[65:91] = table[97:123] = False
    return table


def lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


class Reader(Hasher):
    """Finds the words of this search."""

    def __init__(self):
        super().__init__(lower=True)
        self.space = separators()


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first) * np.uint64(3) + second)


def spread(sizes: np.ndarray) -> np.ndarray:
    """0 … size - 1 for each size, one after another."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


# --- patterns ------------------------------------------------------------------------------


def cut_patterns(window: int):
    """Patterns of items (item, text): their words without separators, and where each word ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for block in blocks(batch.column(1)):
                words, data = reader.words(block), lower(block.data)
                counts = np.diff(words.first)
                size = np.minimum(counts, window)
                n = np.where(counts > 0, counts - size + 1, 0)
                owner = np.repeat(np.arange(block.n), n)
                first, size = words.first[owner] + spread(n), size[owner]
                ends = [np.cumsum(words.end[a : a + k] - words.start[a : a + k]) for a, k in zip(first, size)]
                found = [b"".join([data[x:y].tobytes() for x, y in zip(words.start[a : a + k], words.end[a : a + k])]) for a, k in zip(first, size)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(size.astype(np.int32)), pa.array(found, pa.binary()), pa.array(ends, pa.list_(pa.int32())),
                        batch.column(0).slice(block.first, block.n).take(pa.array(owner)),
                    ],
                    names=["words", "pattern", "ends", "item"],
                )

    return run


def patterns(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct patterns and items that have them: (words, pattern, ends, item)."""
    texts = items.select(F.col("item_id").cast("string").alias("item"), "text")
    return texts.mapInArrow(cut_patterns(window), PATTERNS).distinct()


@dataclass
class Searcher:
    """Search tables for patterns of ``size`` words; pattern i belongs to items ``items[first[i]:first[i + 1]]``."""

    size: int
    data: np.ndarray  # bytes of all patterns
    start: np.ndarray  # first byte of each
    lengths: np.ndarray  # bytes of each word, a row per pattern
    first: np.ndarray
    items: np.ndarray
    shift: np.ndarray
    bits: int
    buckets: Lookup
    bucket: np.ndarray  # first pattern per bucket

    def block_code(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the block of words that ends at ``last``."""
        return pair(hashes[last - 1], hashes[last]) if self.size > 1 else mix(hashes[last])

    def bucket_code(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hash of the last and the first block of a window."""
        begin = last - self.size + (2 if self.size > 1 else 1)
        return pair(self.block_code(hashes, last), self.block_code(hashes, begin))

    def ends(self, hashes: np.ndarray) -> np.ndarray:
        """Ends of windows that the shift table does not rule out; cursors move side by side."""
        total = len(hashes)
        at = np.arange(self.size - 1, total, LANE)
        stop = np.minimum(at + LANE, total)
        found = []
        while len(at):
            step = self.shift[self.block_code(hashes, at) >> np.uint64(64 - self.bits)].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.concatenate(found) if found else at

    def occurrences(self, words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of every occurrence in a block of texts."""
        last = self.ends(words.hash)
        last = last[words.text[last - self.size + 1] == words.text[last]]
        at = self.buckets.find(self.bucket_code(words.hash, last)) if len(last) else last
        known = at < len(self.bucket) - 1
        last, at = last[known], at[known]
        many = self.bucket[at + 1] - self.bucket[at]
        found = [(last[:0], last[:0])]
        begin = 0
        while begin < len(last):
            end = max(begin + 1, int(np.searchsorted(np.cumsum(many[begin:]), AT_ONCE, side="right")) + begin)
            n = many[begin:end]
            found.append(self.compared(words, data, np.repeat(last[begin:end], n), np.repeat(self.bucket[at[begin:end]], n) + spread(n)))
            begin = end
        return tuple(np.concatenate(x) for x in zip(*found))

    def compared(self, words: Words, data: np.ndarray, last: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs whose words are the same byte by byte."""
        inside = last[:, None] - np.arange(self.size - 1, -1, -1)
        same = ((words.end - words.start)[inside] == self.lengths[pattern]).all(axis=1)
        last, pattern, inside = last[same], pattern[same], inside[same]
        sizes = self.lengths[pattern].reshape(-1)
        theirs = data[np.repeat(words.start[inside.reshape(-1)], sizes) + spread(sizes)]
        bytes_of = self.lengths[pattern].sum(axis=1)
        ours = self.data[np.repeat(self.start[pattern], bytes_of) + spread(bytes_of)]
        edges = np.append(0, np.cumsum(theirs != ours))
        stop = np.cumsum(bytes_of)
        equal = edges[stop] == edges[stop - bytes_of]
        return last[equal], pattern[equal]


def searcher(size: int, found: pa.Table, names: pa.Array) -> Searcher:
    """Tables for the patterns of one length: (pattern, ends, item), one row per pattern and item."""
    coded = found["pattern"].combine_chunks().dictionary_encode()
    of, item = coded.indices.to_numpy(), pc.index_in(found["item"].combine_chunks(), names)
    unique, row = np.unique(of, return_index=True)
    ends = np.stack(found["ends"].take(pa.array(row)).to_numpy(zero_copy_only=False)).astype(np.int64).reshape(-1, size)
    lengths = np.diff(ends, axis=1, prepend=0)
    texts = coded.dictionary.to_pylist()
    # Hash the words as those of texts are, by a text that parts them.
    parted = b" ".join([t[a - n : a] for t, e, w in zip([texts[u] for u in unique], ends, lengths) for a, n in zip(e, w)])
    block = next(blocks(pa.array([parted]), len(parted) + 1))
    hashes = Reader().words(block).hash
    last = np.arange(len(unique)) * size + size - 1
    reach = min(2, size)
    bits = min(22, max(12, int(len(unique) * size).bit_length() + 4))
    one = Searcher(size, *[np.zeros(0)] * 5, np.full(1 << bits, size - reach + 1, dtype=np.int8), bits, Lookup(np.zeros(0, np.uint64)), np.zeros(1, np.int64))
    for back in range(size - reach, -1, -1):  # the smallest shift of a block counts
        one.shift[one.block_code(hashes, last - back) >> np.uint64(64 - bits)] = back
    code = one.bucket_code(hashes, last)
    order = np.argsort(code, kind="stable")
    codes, begin = np.unique(code[order], return_index=True)
    one.buckets, one.bucket = Lookup(codes), np.append(begin, len(order))
    texts = [texts[u] for u in unique[order]]
    one.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    one.lengths = lengths[order]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    one.start = np.cumsum(sizes) - sizes
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    known = item.is_valid().to_numpy(zero_copy_only=False)
    owner, named = place[np.searchsorted(unique, of[known])], item.drop_null().to_numpy()
    by_owner = np.argsort(owner, kind="stable")
    one.items, one.first = named[by_owner], np.searchsorted(owner[by_owner], np.arange(len(order) + 1))
    return one


# --- search --------------------------------------------------------------------------------


def merged(text: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> pa.Array:
    """Ranges as lists per text, ranges that touch joined."""
    order = np.lexsort((start, text))
    text, start, stop = text[order], start[order], stop[order]
    top = np.maximum.accumulate(stop + text * (1 << 40)) - text * (1 << 40)
    fresh = np.ones(len(text), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (start[1:] > top[:-1])
    begins = np.flatnonzero(fresh)
    ends = np.append(begins[1:], len(text))[: len(begins)] - 1
    ranges = pa.StructArray.from_arrays([pa.array(start[begins].astype(np.int32)), pa.array(top[ends].astype(np.int32))], names=["start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text[begins], np.arange(n + 1)).astype(np.int32)), ranges).cast(HITS)


def named(text: np.ndarray, item: np.ndarray, names: pa.Array, n: int) -> pa.Array:
    """Distinct items as lists per text."""
    both = np.unique(text * (len(names) + 1) + item)
    text, item = both // (len(names) + 1), both % (len(names) + 1)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), names.take(pa.array(item)))


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Owner and value of every member of a list column."""
    return np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False)), column.flatten()


def search(searchers: list[Searcher], names: pa.Array):
    """Adds hits and items of one shard of patterns to batches of (doc_id, text, n_words, hits, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            for block in blocks(batch.column(1)):
                words, data = reader.words(block), lower(block.data)
                rest = batch.slice(block.first, block.n)
                owner, before = flat(rest.column(3))
                found = [(owner, *[before.field(k).to_numpy().astype(np.int64) for k in (0, 1)])]
                texts, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for one in searchers:
                    last, pattern = one.occurrences(words, data)
                    text = words.text[last]
                    found.append((text, last - words.first[text] - one.size + 1, last - words.first[text] + 1))
                    both = np.unique(text * len(one.start) + pattern)  # each pattern's items once per text
                    text, pattern = both // len(one.start), both % len(one.start)
                    many = one.first[pattern + 1] - one.first[pattern]
                    texts.append(np.repeat(text, many))
                    items.append(one.items[np.repeat(one.first[pattern], many) + spread(many)])
                now = named(np.concatenate(texts), np.concatenate(items), names, block.n)
                owners, told = zip(flat(rest.column(4)), flat(now))
                owners = np.concatenate(owners)
                order = np.argsort(owners, kind="stable")
                everything = pa.concat_arrays(list(told)).take(pa.array(order))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owners[order], np.arange(block.n + 1)).astype(np.int32)), everything)
                ranges = merged(*[np.concatenate(x) for x in zip(*found)], block.n)
                yield pa.RecordBatch.from_arrays(
                    [rest.column(0), rest.column(1), pa.array(np.diff(words.first).astype(np.int64)), ranges, lists],
                    names=["doc_id", "text", "n_words", "hits", "items"],
                )

    return run


def shards(items: DataFrame, window: int, shard_bytes: int) -> Iterator[tuple[list[Searcher], pa.Array]]:
    """Search tables of all patterns, shard by shard; the driver holds one shard at a time."""
    found = keep(patterns(items, window), "decontam-patterns")
    size = found.agg(F.sum(F.length("pattern") + F.length("item") + PATTERN_BYTES)).first()[0] or 0
    n = -(-size // shard_bytes)
    for k in range(n):
        own = found.filter(F.pmod(F.xxhash64("pattern", "item"), F.lit(n)) == k) if n > 1 else found
        table = own.toArrow()
        names = pc.unique(table["item"].combine_chunks()).drop_null().sort()
        table = table.append_column("at", pa.array(range(len(table))))
        lengths = sorted(set(table["words"].to_pylist()))
        yield [searcher(w, table.filter(pc.equal(table["words"], w)), names) for w in lengths], names


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """What of ``items`` (item_id, text) stands in each row of ``docs`` (doc_id, text).

    Returns (doc_id, n_words, hits, items): ranges of hit words, ascending and apart, and the ids of items
    with an occurring pattern, as text, ascending by bytes.
    """
    none = F.lit(None).cast("array<struct<start:int,stop:int>>")
    empty = F.coalesce(none, F.array().cast("array<struct<start:int,stop:int>>"))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("n_words"),
        empty.alias("hits"), F.array().cast("array<string>").alias("items"),
    )
    kind = FOUND.replace("n_words", "text string, n_words", 1)
    searched = False
    for tables, names in shards(items, window, shard_bytes):
        found, searched = found.mapInArrow(search(tables, names), kind), True
    if not searched:  # nothing to look for: count the words
        found = found.mapInArrow(search([], pa.array([], pa.string())), kind)
    return found.select("doc_id", "n_words", "hits", F.array_sort(F.array_distinct("items")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` whose text holds no pattern of ``items``, with all their columns.

    Texts are told apart by themselves: rows with one text, ids equal or not, are judged alike.
    """
    told = docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("doc_id"), "text")
    hit = contamination(told, items, window).filter(F.size("hits") > 0).select("doc_id").distinct()
    return told.join(hit, "doc_id", "left_anti").select("row.*")
