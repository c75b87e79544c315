"""Repeated passages removed word by word: the earliest occurrence stays, the rest goes.

Words are compared normalised (A to Z lower-cased, white space ignored).  A passage is repeated if
``min_words`` words in a row, a window, stand at an earlier place, by document id and word; all words
of a repeated window go, so a passage loses exactly the words that agree.  An occurrence that overlaps
the earliest one in the same document is no repeat of it.  Every later occurrence of a whole line or
paragraph goes whatever its length: one of ``min_words`` or more consists of repeated windows, and shorter
ones are compared as a whole.  A paragraph is what stands between blank lines, however it is broken.

Every window has an anchor: the smallest hash of ``ANCHOR`` words in it.  Equal windows have equal anchors
wherever they stand, and neighbouring windows with one anchor form a piece.  Only pieces whose anchor
stands more than once are moved further; equal pieces are judged as a whole, and single windows are
compared only where one anchor has different pieces.

A removed run reaches to the next word.  Offsets are bytes of the original UTF-8 text.  A null text has
no words and stays null.  Rows with a null id take no part and are unchanged.  Rows that share an id
are judged by id and place; an exact repeat of a row, id included, is the same row and is judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from layover.llm.blocks import BASE, INVERSE, Block, Hasher, Words, blocks, mix, powers
from layover.llm.scratch import gives_back, release

ANCHOR = 6
MIN_WORDS = 13
#: Keeps anchors of whole lines apart from those of windows.
LINE = np.uint64(0x7C15A3F1D2B49E65)

PIECES = "doc_id long, at int, n_words int, anchor long, piece long"
WINDOWS = "doc_id long, at int, window long"
SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


class Digests:
    """Digests of runs of words, block by block."""

    def __init__(self):
        self.hasher = Hasher(lower=True)
        self.up = self.down = np.ones(0, np.uint64)

    def of(self, words: Words):
        n = len(words.hash)
        if len(self.up) <= n:
            self.up, self.down = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hash) * self.up[:n])])
        return lambda first, size: mix((sums[first + size] - sums[first]) * self.down[first] + np.asarray(size).astype(np.uint64))


def window_pieces(words: Words, digest, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, words, anchor) of runs of windows with one anchor."""
    n = len(words.hash)
    width = min(ANCHOR, min_words)
    at = np.flatnonzero(words.text[: n - min_words + 1] == words.text[min_words - 1 :]) if n >= min_words else np.zeros(0, np.int64)
    if not len(at):
        return at, at, at.astype(np.uint64)
    grams = digest(np.arange(n - width + 1), width)
    best, where = grams[at], at.copy()
    for k in range(1, min_words - width + 1):
        value = grams[at + k]
        less = value < best
        best[less], where[less] = value[less], at[less] + k
    first = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
    return at[first], np.diff(np.append(first, len(at))) + min_words - 1, best[first]


def short_lines(block: Block, words: Words, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, words) of lines, and paragraphs of several lines, with fewer words than ``min_words``."""
    breaks = np.concatenate([[0], np.cumsum(block.data == 10, dtype=np.int64)])
    passed = np.append(2, breaks[words.start[1:]] - breaks[words.end[:-1]])
    passed[1:][words.text[1:] != words.text[:-1]] = 2
    lines, paragraphs = np.flatnonzero(passed >= 1), np.flatnonzero(passed >= 2)
    line_size, size = (np.diff(np.append(x, len(passed))) for x in (lines, paragraphs))
    several = size > line_size[np.searchsorted(lines, paragraphs)]
    first, size = np.concatenate([lines, paragraphs[several]]), np.concatenate([line_size, size[several]])
    return first[size < min_words], size[size < min_words]


def cut_pieces(min_words: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                words = digests.hasher.words(block)
                if not len(words.hash):
                    continue
                digest = digests.of(words)
                first, size, anchor = window_pieces(words, digest, min_words)
                lines, line_size = short_lines(block, words, min_words)
                first, size = np.concatenate([first, lines]), np.concatenate([size, line_size])
                piece = digest(first, size)
                anchor = np.concatenate([anchor, mix(piece[len(anchor) :] ^ LINE)])
                owner = words.text[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[block.first + owner]), pa.array((first - words.first[owner]).astype(np.int32)),
                        pa.array(size.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(piece.view(np.int64)),
                    ],
                    names=["doc_id", "at", "n_words", "anchor", "piece"],
                )

    return run


def ranged(block: Block, words: Words, ranges: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(first word, word after) of ranges of words, a list per text; a text that shares its id may be shorter."""
    owner = np.repeat(np.arange(block.n), pc.fill_null(pc.list_value_length(ranges), 0).to_numpy())
    at, stop = (ranges.flatten().field(k).to_numpy().astype(np.int64) for k in (0, 1))
    return tuple(np.minimum(words.first[owner] + place, words.first[owner + 1]) for place in (at, stop))


def cut_windows(min_words: int):
    """Windows in ranges of words: batches of doc_id, text, ranges."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1)):
                words = digests.hasher.words(block)
                begin, stop = ranged(block, words, batch.column(2).slice(block.first, block.n))
                n = np.maximum(stop - begin - min_words + 1, 0)
                at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                if len(at):
                    owner = words.text[at]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(ids[block.first + owner]), pa.array((at - words.first[owner]).astype(np.int32)),
                            pa.array(digests.of(words)(at, min_words).view(np.int64)),
                        ],
                        names=["doc_id", "at", "window"],
                    )

    return run


def pieces(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every piece and short line of every document (doc_id, text): its words, anchor and digest."""
    known = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text")
    return known.mapInArrow(cut_pieces(min_words), PIECES)


def match(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Inner join on a key and its sign, so that both sides are shuffled for it and a hot key can be split."""
    sign = F.shiftright(key, 63)
    return rows.withColumn("__sign", sign).join(found.withColumn("__sign", sign), [key, "__sign"]).drop("__sign")


def repeated_words(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, ranges) of documents that lose something: ranges of words (at, stop), ascending, may overlap."""
    spark = docs.sparkSession
    cut = pieces(docs, min_words)
    often = cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    shared = match(cut, often, "anchor").checkpoint()
    del often
    release(spark)
    place = F.struct("doc_id", "at")
    kinds = shared.groupBy("anchor", "piece").agg(F.min(place).alias("kept"))
    judged = match(shared, kinds.drop("anchor"), "piece").checkpoint()
    apart = (F.col("doc_id") != F.col("kept.doc_id")) | (F.col("at") >= F.col("kept.at") + F.least("n_words", F.lit(min_words)))
    later = (place > F.col("kept")) & apart
    stop = (F.col("at") + F.col("n_words")).alias("stop")
    whole = judged.filter(later).select("doc_id", "at", stop)
    # Different pieces with one anchor may still have equal windows.
    mixed = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    some = match(judged.filter(~later).drop("kept", "piece"), mixed, "anchor").select("doc_id", "at", stop)
    asked = some.groupBy("doc_id").agg(F.collect_list(F.struct("at", "stop")).alias("ranges"))
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(asked, "doc_id").select("doc_id", "text", "ranges")
    single = texts.mapInArrow(cut_windows(min_words), WINDOWS).withColumn("n_words", F.lit(min_words)).checkpoint()
    release(spark)
    firsts = single.groupBy("window").agg(F.min(place).alias("kept"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    windows = match(single, firsts, "window").filter(later).select("doc_id", "at", stop)
    ranges = whole.unionByName(windows)
    return ranges.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("at", "stop"))).alias("ranges"))


def spans_of(block: Block, words: Words, ranges: pa.Array) -> pa.Array:
    """Byte spans of ranges of words, joined where they touch, one list per text of the block."""
    begin, stop = ranged(block, words, ranges)
    gone = np.bincount(begin, minlength=len(words.hash) + 1) - np.bincount(stop, minlength=len(words.hash) + 1)
    gone = np.cumsum(gone[:-1]) > 0
    fresh = np.append(True, words.text[1:] != words.text[:-1])[: len(gone)]
    begins = np.flatnonzero(gone & (fresh | ~np.append(False, gone[:-1])[: len(gone)]))
    ends = np.flatnonzero(gone & (np.append(fresh[1:], True) | ~np.append(gone[1:], False))[: len(gone)]) + 1
    text = words.text[begins]
    base = block.offsets[text]
    to = np.where(ends == words.first[text + 1], block.offsets[text + 1], np.append(words.start, 0)[ends])
    spans = pa.StructArray.from_arrays(
        [pa.array((words.start[begins] - base).astype(np.int32)), pa.array((to - base).astype(np.int32))], names=["start", "end"]
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(block.n + 1)).astype(np.int32)), spans)


def locate(text_at: int):
    """Replaces the last column, ranges of words, by spans of bytes."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(lower=True)
        for batch in batches:
            *rest, ranges = batch.columns
            for block in blocks(rest[text_at]):
                spans = spans_of(block, hasher.words(block), ranges.slice(block.first, block.n))
                yield pa.RecordBatch.from_arrays(
                    [c.slice(block.first, block.n) for c in rest] + [spans], names=[*batch.schema.names[:-1], "__spans"]
                )

    return run


def without(text: Column, spans: Column) -> Column:
    """The text without its spans, which are ascending and do not overlap."""
    raw = F.encode(text, "UTF-8")
    edges = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text)))
    kept = F.zip_with(edges, stops, lambda a, b: F.decode(F.substring(raw, a + 1, b - a), "UTF-8"))
    return F.array_join(kept, "")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``, and the ``spans`` removed from the original.

    All columns and rows are kept; a column named spans is replaced.  Documents that lose nothing have
    an empty list.
    """
    found = repeated_words(docs.select("doc_id", "text"), min_words).withColumnRenamed("ranges", "__ranges")
    columns = [c for c in docs.columns if c != "spans"]
    joined = docs.select(*columns).join(found, "doc_id", "left").select(*columns, "__ranges")
    kinds = StructType([*joined.schema.fields[:-1], StructField("__spans", SPANS)])
    cut = joined.mapInArrow(locate(columns.index("text")), kinds)
    text = F.when(F.size("__spans") == 0, F.col("text")).otherwise(without(F.col("text"), F.col("__spans")))
    rest = [F.col(c) if c != "text" else text.alias("text") for c in columns]
    return cut.select(*rest, F.col("__spans").alias("spans"))
