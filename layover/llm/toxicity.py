"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts, over the letters of words.

A word is a start, its characters and an end.  A symbol is predicted from up to five before it (``ORDER`` 6).
The highest order is counted per class on a bounded labelled sample, an n-gram once per document and word; from
every count a discount is taken, and what it frees goes to the next lower order.  Lower orders are shared by both
classes and come from the whole corpus: continuation counts, after how many different symbols an n-gram stands in
the different words of all documents, with the same discount, down to a uniform choice among all symbols.  A rare
expression is therefore smoothed by all texts, and what no class has seen weighs the same in both.  In scripts
without spaces every character begins a word, of itself and the next ones.

A word's value is the difference of its log-likelihoods.  A document is judged by the mean value of its
words and by the root mean square of the positive ones, both length-normalised: a few strong expressions
count for more than a slight drift of many words.  Both become a probability on a part of the sample
that the models have not seen.

An empty or null text is judged by its prior.  Repeated rows are scored alike.  A null id is scored,
with a null fold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layover.llm.blocks import BLOCK_BYTES, Block, Hasher, Lookup, Words, blocks, mix
from layover.llm.samples import Sample, calibrate, fold, probability, sample
from layover.llm.scratch import gives_back, keep, release

DISCOUNT = 0.75
#: Symbols of the longest n-grams.
ORDER = 6
#: Characters of a word in scripts that are written without spaces; every character begins one.
CHARACTERS = 4
#: Different words that a task remembers so as not to send them again.
SEEN = 1 << 20
#: Words that a task spells at once.
WORDS = 1 << 18
#: Bytes of the sample that the driver spells at once.
SAMPLE_BLOCK = 1 << 18
LENGTH_FACTOR, START, END = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0x5BF0A8B1456ABCDE, 0xD1B54A32D192ED03))


#: Symbols for the start and the end of a word: bytes that no UTF-8 text holds.
FIRST, LAST = np.uint64(0xFE), np.uint64(0xFF)


def unspaced(data: np.ndarray) -> np.ndarray:
    """First bytes of characters of scripts without spaces: Thai to Lao, Burmese, Khmer, kana and Han."""
    after = np.append(data[1:], 0)
    found = (data >= 0xE3) & (data <= 0xE9)
    found |= (data == 0xE0) & (after >= 0xB8) & (after <= 0xBB)
    found |= (data == 0xE1) & (((after >= 0x80) & (after <= 0x82)) | (after == 0x9E) | (after == 0x9F))
    return found | ((data == 0xF0) & (after >= 0xA0) & (after <= 0xB3))


def split(hasher: Hasher, block: Block, words: Words) -> Words:
    """Words as they are, but in scripts without spaces from every character over the next ones of its run."""
    data = block.data
    if not len(data) or not (data >= 0xE0).any():
        return words
    lead = unspaced(data)
    if not lead.any():
        return words
    character = (data & 0xC0) != 0x80
    inside = np.zeros(len(data) + 1, np.int32)
    inside[words.start] += 1
    np.subtract.at(inside, words.end, 1)
    inside = np.cumsum(inside[:-1]) > 0
    own = np.maximum.accumulate(np.where(character, np.arange(len(data)), 0))  # the character of every byte
    dense = lead[own] & inside
    edge = np.zeros(len(data), bool)
    edge[words.start] = True
    edge[1:] |= inside[1:] & (dense[1:] != dense[:-1])  # stretches of one kind
    stretch = np.flatnonzero(edge)
    run = np.searchsorted(words.start, stretch, side="right") - 1
    stop = np.minimum(np.append(stretch[1:], len(data)), words.end[run])
    start = np.flatnonzero(edge | (lead & inside))
    end = stop[np.searchsorted(stretch, start, side="right") - 1]
    places = np.append(np.flatnonzero(character), np.full(CHARACTERS, len(data)))
    ahead = places[np.searchsorted(places, start) + CHARACTERS]
    end = np.where(dense[start], np.minimum(end, ahead), end)
    p = hasher.prefix(data)
    first = np.searchsorted(start, block.offsets)
    text = np.repeat(np.arange(block.n), np.diff(first))
    return Words(start, end, text, mix((p[end] - p[start]) * hasher.down[start]), first)


@dataclass
class Spelling:
    """Different words of a block: first character and number of them, in how many texts each stands, and the
    word of every token."""

    first: np.ndarray
    size: np.ndarray
    documents: np.ndarray
    token: np.ndarray
    places: np.ndarray
    prefix: np.ndarray
    down: np.ndarray
    data: np.ndarray

    @staticmethod
    def of(hasher: Hasher, block: Block, words: Words) -> Spelling:
        keys, first, token = np.unique(words.hash, return_index=True, return_inverse=True)
        pairs = np.unique((words.text.astype(np.int64) << 32) | token)
        documents = np.bincount(pairs & 0xFFFFFFFF, minlength=len(keys))
        characters = np.flatnonzero((block.data & 0xC0) != 0x80)
        begin, end = (np.searchsorted(characters, x[first]) for x in (words.start, words.end))
        places = np.append(characters, len(block.data))
        return Spelling(begin, end - begin, documents, token, places, hasher.prefix(block.data), hasher.down, block.data)

    def gram(self, which: np.ndarray, k: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Key of the ``n`` symbols up to symbol ``k`` of words; the start is symbol -1, the end comes last."""
        low = k - n + 1
        first, size = self.first[which], self.size[which]
        a = self.places[first + np.maximum(low, 0)]
        b = self.places[first + np.minimum(k + 1, size)]
        value = (self.prefix[b] - self.prefix[a]) * self.down[a] + n.astype(np.uint64) * LENGTH_FACTOR
        return mix(value + (low < 0) * START + (k == size) * END)


    def characters(self) -> np.ndarray:
        """The bytes of every character as a number, A to Z lower-cased."""
        begin, size = self.places[:-1], np.diff(self.places)
        out = self.data[begin].astype(np.uint64)
        out[(out >= 65) & (out <= 90)] += np.uint64(32)
        for j in range(1, 4):
            more = np.flatnonzero(size > j)
            out[more] |= self.data[begin[more] + j].astype(np.uint64) << np.uint64(8 * j)
        return out

    def symbol(self, characters: np.ndarray, which: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Symbol ``k`` of words, in 32 bits."""
        size = self.size[which]
        found = characters[self.first[which] + np.clip(k, 0, size - 1)]
        return np.where(k < 0, FIRST, np.where(k == size, LAST, found))


def pair_key(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Key of a symbol after a context."""
    return mix(context + (symbol + np.uint64(1)) * LENGTH_FACTOR)


def steps(spelling: Spelling) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, places in them) of all symbols but the start, so many at a time."""
    before = np.append(0, np.cumsum(spelling.size + 1))
    for at in range(0, int(before[-1]), SAMPLE_BLOCK):
        place = np.arange(at, min(at + SAMPLE_BLOCK, before[-1]))
        which = np.searchsorted(before, place, side="right") - 1
        yield which, place - before[which]


def spellings(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[tuple[Block, Words, Spelling]]:
    hasher = Hasher(lower=True, block=limit)
    for block in blocks(texts, limit):
        words = split(hasher, block, hasher.words(block))
        yield block, words, Spelling.of(hasher, block, words)


@dataclass
class Grams:
    """Longest n-grams of a class in ascending order: key, context, length, count, and key and context of every
    lower order; orders from the length on do not apply."""

    key: np.ndarray
    context: np.ndarray
    length: np.ndarray
    n: np.ndarray
    lower: np.ndarray
    lower_context: np.ndarray

    @staticmethod
    def merged(parts: list[Grams]) -> Grams:
        key, first, place = np.unique(np.concatenate([p.key for p in parts]), return_index=True, return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([p.n for p in parts]), minlength=len(key)).astype(np.int64)
        kept = [np.concatenate([getattr(p, c) for p in parts])[first] for c in ("context", "length", "lower", "lower_context")]
        return Grams(key, kept[0], kept[1], n, kept[2], kept[3])

    def highest(self) -> Grams:
        """The longest n-grams alone, which is all a class model is built from."""
        wide = np.zeros((0, ORDER - 1), np.uint64)
        return Grams(self.key, self.context, self.length, self.n, wide, wide)

    @staticmethod
    def none() -> Grams:
        flat, wide = np.zeros(0, np.uint64), np.zeros((0, ORDER - 1), np.uint64)
        return Grams(flat, flat, np.zeros(0, np.int64), np.zeros(0, np.int64), wide, wide)


def grams(texts: list[str]) -> Grams:
    """The longest n-grams of the texts, counted once per document and word."""
    found = Grams.none()
    for _, _, spelling in spellings(pa.array(texts, pa.string()), SAMPLE_BLOCK):
        # Merged block by block, so that only different n-grams are held.
        characters = spelling.characters()
        for which, k in steps(spelling):
            n = np.minimum(ORDER, k + 2)
            orders = [np.minimum(m, n - 1) for m in range(1, ORDER)]
            below = np.stack([spelling.gram(which, k - 1, m - 1) for m in orders], axis=1)
            symbol = spelling.symbol(characters, which, k)
            part = Grams(
                spelling.gram(which, k, n), spelling.gram(which, k - 1, n - 1), n, spelling.documents[which],
                pair_key(below, symbol[:, None]), below,
            )
            found = Grams.merged([found, part])
    return found


@gives_back
def corpus_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different words of the texts, A to Z lower-cased; some come from several blocks."""
    hasher = Hasher(lower=True)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    seen = np.zeros(0, np.uint64)
    for batch in batches:
        for block in blocks(batch.column(0)):
            words = split(hasher, block, hasher.words(block))
            keys, first = np.unique(words.hash, return_index=True)
            fresh = ~np.isin(keys, seen, assume_unique=True)
            seen = np.union1d(seen, keys[fresh]) if len(seen) < SEEN else keys[fresh]
            start, size = (x[first[fresh]] for x in (words.start, words.end - words.start))
            offsets = np.append(0, np.cumsum(size))
            data = lower[block.data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]]
            yield pa.RecordBatch.from_arrays(
                [pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])],
                names=["word"],
            )


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.ChunkedArray]:
    """The first columns of batches, in pieces of about ``WORDS`` rows."""
    held: list[pa.Array] = []
    for batch in batches:
        held.append(batch.column(0))
        if sum(map(len, held)) >= WORDS:
            yield pa.chunked_array(held)
            held = []
    if held:
        yield pa.chunked_array(held)


def corpus_grams(contexts: np.ndarray):
    """Different n-grams (context, ends) of words, of all contexts that the sample has: ``context`` lies between the
    first and the last symbol, which ``ends`` holds in 32 bits each.  Some come from several tasks."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hasher = Lookup(contexts), Hasher(lower=True)
        for piece in gathered(batches):
            for block in blocks(piece):
                # A row is a word of its own.
                filled = np.flatnonzero(np.diff(block.offsets))
                start, end = block.offsets[filled], block.offsets[filled + 1]
                p = hasher.prefix(block.data)
                words = Words(start, end, filled, mix((p[end] - p[start]) * hasher.down[start]), np.zeros(1, np.int64))
                spelling = Spelling.of(hasher, block, words)
                characters = spelling.characters()
                which = np.repeat(np.arange(len(spelling.size)), spelling.size + 1)
                k = np.arange(len(which)) - np.repeat(np.cumsum(spelling.size + 1) - spelling.size - 1, spelling.size + 1)
                first = np.unique(spelling.gram(which, k, np.minimum(ORDER, k + 2)), return_index=True)[1]
                which, k = which[first], k[first]
                # Shorter n-grams are ends of longer ones, so each order is read from what the one above left over.
                for m in range(ORDER - 1, 0, -1):
                    long = k + 2 > m
                    w, at = which[long], k[long]
                    first = np.unique(spelling.gram(w, at, np.full(len(w), m + 1)), return_index=True)[1]
                    w, at = w[first], at[first]
                    which, k = np.append(w, which[~long]), np.append(at, k[~long])
                    context = spelling.gram(w, at - 1, np.full(len(w), m - 1))
                    some = table.find(context) < len(contexts)
                    w, at, context = w[some], at[some], context[some]
                    ends = (spelling.symbol(characters, w, at - m) << np.uint64(32)) | spelling.symbol(characters, w, at)
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in (context, ends)], names=["context", "ends"])

    return run


def continuations(docs: DataFrame, found: Grams) -> DataFrame:
    """(context, symbol, n): after how many different symbols a context with this symbol next stands in the words
    of all texts.

    The table of different words is distributed, grows with the corpus and keeps rare ones; from it all that
    follows the sample's contexts is counted, whether the sample has it or not.  Other contexts weigh the same in
    both classes.
    """
    words = docs.select("text").mapInArrow(corpus_words, "word binary").distinct()
    reader = corpus_grams(np.unique(found.lower_context))
    different = words.mapInArrow(reader, "context long, ends long").distinct()
    symbol = F.col("ends").bitwiseAND(F.lit(0xFFFFFFFF)).alias("symbol")
    return keep(different.groupBy("context", symbol).agg(F.count(F.lit(1)).alias("n")), "toxicity-continuations")


def numbers(table: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    return table.column(column).to_numpy().view(np.uint64)


def keys_of(table: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Keys of rows: of a symbol after its context, or of the context alone."""
    context = numbers(table, "context")
    return pair_key(context, numbers(table, "symbol")) if "symbol" in table.schema.names else context


def among(keys: np.ndarray):
    """Rows whose key is one of some; they are bounded by the sample."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Lookup(keys)
        for batch in batches:
            yield batch.filter(pa.array(table.find(keys_of(batch)) < len(keys)))

    return run


@dataclass
class Shared:
    """Lower orders, as far as the sample's n-grams have them: continuation counts, and sums and kinds by context."""

    follows: Lookup
    n: np.ndarray
    contexts: Lookup
    total: np.ndarray
    kinds: np.ndarray

    @staticmethod
    def load(table: DataFrame, found: Grams) -> Shared:
        follows, contexts = np.unique(found.lower), np.unique(found.lower_context)
        sums = table.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))

        def loaded(df: DataFrame, keys: np.ndarray, *columns: str) -> list[np.ndarray]:
            rows = df.mapInArrow(among(keys), df.schema).toArrow()
            at = np.searchsorted(keys, keys_of(rows))
            out = []
            for c in columns:
                out.append(np.zeros(len(keys) + 1))
                out[-1][at] = rows.column(c).to_numpy()
            return out

        n, = loaded(table, follows, "n")
        total, kinds = loaded(sums, contexts, "total", "kinds")
        return Shared(Lookup(follows), n, Lookup(contexts), total, kinds)

    def chance(self, found: Grams) -> np.ndarray:
        """Probability of the last symbol of each n-gram by the highest of the lower orders that applies."""
        p = np.ones(len(found.key))
        for m in range(1, ORDER):
            at, context = self.follows.find(found.lower[:, m - 1]), self.contexts.find(found.lower_context[:, m - 1])
            n, total, kinds = self.n[at], self.total[context], self.kinds[context]
            if m == 1:
                p /= np.maximum(kinds, 1.0)
            sure = np.maximum(total, 1.0)
            mixed = np.maximum(n - DISCOUNT, 0.0) / sure + DISCOUNT * kinds / sure * p
            p = np.where((found.length > m) & (total > 0), mixed, p)
        return p


@dataclass
class Model:
    table: Lookup
    #: The difference at a known n-gram, and at an unknown one after a known context.
    value: np.ndarray
    contexts: Lookup
    rest: np.ndarray
    slope: tuple[float, float] = (0.0, 0.0)
    shift: float = -4.0

    def words(self, spelling: Spelling) -> np.ndarray:
        """The difference of both log-likelihoods of every different word."""
        total = np.zeros(len(spelling.first))
        for which, k in steps(spelling):
            n = np.minimum(ORDER, k + 2)
            at = self.table.find(spelling.gram(which, k, n))
            each = self.value[at]
            lost = np.flatnonzero(at == len(self.value) - 1)
            each[lost] = self.rest[self.contexts.find(spelling.gram(which[lost], k[lost] - 1, n[lost] - 1))]
            total += np.bincount(which, weights=each, minlength=len(total))
        return total

    def features(self, n: int, words: Words, spelling: Spelling) -> np.ndarray:
        """Mean difference, and root of the mean square of the positive ones, per text."""
        each = self.words(spelling)[spelling.token]
        size = np.maximum(np.diff(words.first), 1)
        mean = np.bincount(words.text, weights=each, minlength=n) / size
        strong = np.bincount(words.text, weights=np.maximum(each, 0.0) ** 2, minlength=n) / size
        return np.stack([mean, np.sqrt(strong)], axis=1)

    def scores(self, n: int, words: Words, spelling: Spelling) -> np.ndarray:
        return probability(self.features(n, words, spelling) @ np.array(self.slope), 1.0, self.shift)


def build(counted: list[Grams], found: Grams, base: np.ndarray) -> Model:
    """The difference of both class models at every n-gram of the sample.  ``base`` is the lower orders' chance."""
    table, contexts = Lookup(found.key), Lookup(np.unique(found.context))
    missing = len(contexts.keys) - 1
    own = contexts.find(found.context)
    chance, left = [], []
    for each in counted:
        n = np.zeros(len(found.key) + 1)
        n[table.find(each.key)] = each.n
        context = contexts.find(each.context)
        total = np.bincount(context, weights=each.n, minlength=missing + 1)
        kinds = np.bincount(context, minlength=missing + 1)
        sure = np.maximum(total, 1.0)
        free = np.where(total > 0, DISCOUNT * kinds / sure, 1.0)
        chance.append(np.maximum(n[:-1] - DISCOUNT, 0.0) / sure[own] + free[own] * base)
        left.append(free)
    return Model(table, np.append(np.log(chance[1] / chance[0]), 0.0), contexts, np.log(left[1] / left[0]))


def train(docs: DataFrame, found: Sample) -> Model:
    spark = docs.sparkSession
    learn = [[t for t, y, k in zip(found.texts, found.labels, found.tune) if y == c and not k] for c in (0, 1)]
    counted = [grams(each) for each in learn]
    known = Grams.merged(counted)
    counted = [each.highest() for each in counted]
    tune = np.flatnonzero(found.tune)
    kept = pa.array([found.texts[i] for i in tune], pa.string())
    labels, share = found.labels[tune], found.share
    del learn, found
    # What a step leaves behind goes before the next one brings tables to the driver.
    release(spark)
    table = continuations(docs, known)
    release(spark)
    base = Shared.load(table, known).chance(known)
    known = known.highest()
    model = build(counted, known, base)
    features = [model.features(b.n, w, s) for b, w, s in spellings(kept, SAMPLE_BLOCK)]
    slope, model.shift = calibrate(np.concatenate([np.zeros((0, 2)), *features]), labels, share)
    model.slope = tuple(slope)
    del counted, known, base, features, kept
    release(spark)
    return model


def score_with(model: Model):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, spelling in spellings(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.first, block.n), pa.array(model.scores(block.n, words, spelling))],
                    names=["doc_id", "score"],
                )

    return run


def score(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = 0.7, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text)."""
    model = train(docs, sample(docs, labels, column, **bounds))
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score_with(model), "doc_id long, score double")
    return scored.select(
        "doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepting(model: Model, text_at: int, threshold: float):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, spelling in spellings(batch.column(text_at)):
                fine = model.scores(block.n, words, spelling) < threshold
                yield batch.slice(block.first, block.n).filter(pa.array(fine))

    return run


def accept(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = 0.7, **bounds) -> DataFrame:
    """Rows of ``docs`` scored below the threshold, with all their columns."""
    model = train(docs, sample(docs, labels, column, **bounds))
    return docs.mapInArrow(accepting(model, docs.columns.index("text"), threshold), docs.schema)
