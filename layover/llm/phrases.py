"""Collocations: phrases whose words stand together more often than their parts would by chance.

A to Z are lower-cased; texts are split at ``. , ; : ! ?`` and line breaks into pieces, pieces at spaces and
tabs into words.  Everything is counted per language, null being ``und``.

Phrases are counted by Rabin-Karp fingerprints: prefix polynomials over a word's bytes and over a text's
words give the print of every run of words by one subtraction.  Lengths follow each other, as a phrase can be
frequent only if both phrases of one word less in it are: prints of length k are counted (per block, per
task, then by a shuffle) where a bitmap of the frequent prints of length k - 1 allows it.  The bitmap has
``FILTER_BITS`` bits however many prints there are; where it lets one through in error, it is counted in vain.

Words are counted by their texts in one reading, so the rows of a task follow from its own text.  In every block
the occurrences of a print are compared with its first one, byte by byte; the first one's text is compared with what
the task has under this print and goes on with the number that agree; others with the same print are groups of their
own.  Frequent words are then numbered, and words that share a print with another, of which there are hardly any,
are told apart by their texts.  Phrases are
counted by the numbers of their words, two to a column, so final counts are of texts, and a collision of prints
costs work but never a count.  Their texts are put together from the words', once for each frequent phrase.

Null texts are empty.  Null ids count, but are never named as ``first_doc``; rows that share an id, and exact
repeats, all count.  Ties in score are broken by count, then by the phrase's bytes.  An empty table has no
phrases.  Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from layover.llm.blocks import BASE, INVERSE, Block, Hasher, Lookup, Words, blocks, mix, powers
from layover.llm.scratch import gives_back, keep

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
#: A candidate goes if a longer one around it has this share of its count, in hundredths.
ABSORB_PCT = 100
BREAKS = b".,;:!?\n\x0b\x0c\r"
BLOCK = 4 << 20
#: Spelling and numbering hold some sixty bytes of memory for each byte of a block.
SMALL_BLOCK = 1 << 20
FILTER_BITS = 26
#: A task hands on the phrases it has spelled out when they are so many or so long.
POOL, POOL_BYTES = 500_000, 32 << 20
MISSING = np.iinfo(np.int64).max
#: Leading bits of a print that are used; fewer only to force collisions in tests.
PRINT_BITS = 64

#: A phrase's numbers, two in each column from its end on; columns it has no words for are null.
NUMBERS = ["last", "middle", "first"]
NUMBERED = f"{', '.join(f'{c} long' for c in NUMBERS)}, n long"
UNPACKED = "ids array<long>, words int, print long, a long"
SPELLED = "lang string, phrase string, words int, n long, doc long, print long"
WORDS = "lang string, phrase string, print long, n long"
#: Rows of spelled phrases that a task hands on at once.
ROWS = 50_000


def shortened(prints: np.ndarray) -> np.ndarray:
    return prints >> np.uint64(64 - PRINT_BITS) << np.uint64(64 - PRINT_BITS)


@dataclass
class Runs:
    """Words of a block with the prints of their runs; ``reach`` is the number of words up to a piece's end."""

    block: Block
    words: Words
    reach: np.ndarray
    word: np.ndarray  # the print of each word, which differs by language
    sums: np.ndarray
    down: np.ndarray

    def prints(self, first: np.ndarray, size: int) -> np.ndarray:
        if size == 1:
            return self.word[first]
        return shortened(mix((self.sums[first + size] - self.sums[first]) * self.down[first] + np.uint64(size)))


class Reader:
    """Cuts texts into runs of words, block by block."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.hasher = Hasher(lower=True, block=block)
        self.breaks = np.zeros(256, dtype=bool)
        self.breaks[list(BREAKS)] = True
        self.hasher.space = self.breaks.copy()
        self.hasher.space[[0x20, 0x09]] = True
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def runs(self, column: pa.Array, langs: pa.Array) -> Iterator[Runs]:
        coded = langs.dictionary_encode()
        hashed = np.array([int.from_bytes(name.encode()[:8], "little") for name in coded.dictionary.to_pylist()], dtype=np.uint64)
        for i, name in enumerate(coded.dictionary.to_pylist()):  # all bytes of a long name count
            for k in range(8, len(name.encode()), 8):
                hashed[i] = mix(hashed[i : i + 1])[0] ^ np.uint64(int.from_bytes(name.encode()[k : k + 8], "little"))
        codes = coded.indices.to_numpy()
        for block in blocks(column, self.block):
            words = self.hasher.words(block)
            n = len(words.hash)
            if len(self.up) <= n:
                self.up, self.down = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
            passed = np.append(0, np.cumsum(self.breaks[block.data], dtype=np.int32))
            fresh = np.ones(n, dtype=bool)
            fresh[1:] = (words.text[1:] != words.text[:-1]) | (passed[words.start[1:]] != passed[words.end[:-1]])
            first = np.flatnonzero(fresh)
            stop = np.append(first[1:], n)[: len(first)]
            reach = np.repeat(stop, stop - first) - np.arange(n)
            own = mix(hashed[codes[block.first : block.first + block.n]] + np.uint64(1))
            word = shortened(mix(words.hash ^ own[words.text]))
            sums = np.append(np.uint64(0), np.cumsum(mix(word) * self.up[:n], dtype=np.uint64))
            yield Runs(block, words, reach, word, sums, self.down)


class Bitmap:
    """A set of prints that may hold more than it was given, never less."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - (int(len(bits)).bit_length() - 1) - 6)

    def has(self, prints: np.ndarray) -> np.ndarray:
        at = prints >> self.shift
        return (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def frequent_at(runs: Runs, size: int, bitmap: Bitmap | None) -> np.ndarray:
    """Where the runs of ``size`` words in the bitmap begin; without a bitmap, where any begin."""
    first = np.flatnonzero(runs.reach >= size)
    return first if bitmap is None else first[bitmap.has(runs.prints(first, size))]


# --- counting by numbers -------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Frequent words, numbered by their places among the ascending ids.  A word's id is its print; words that share
    their print with another have an id by language and text."""

    ids: np.ndarray
    prints: np.ndarray
    shared: np.ndarray
    own: dict[tuple[str, bytes], int]

    def numbers(self, runs: Runs, langs: pa.Array, table: Lookup) -> np.ndarray:
        """The number of every word, or that of all words for one that is not frequent."""
        number = table.find(runs.word).astype(np.int64)
        if len(self.shared):
            words, block = runs.words, runs.block
            for at in np.flatnonzero(np.isin(runs.word, self.shared)):
                text = block.data[words.start[at] : words.end[at]].tobytes().lower()
                number[at] = self.own.get((langs[block.first + words.text[at]].as_py(), text), len(self.ids))
        return number


def count(size: int, vocabulary: Vocabulary, shorter: Bitmap | None):
    """Counts of phrases of ``size`` frequent words by their numbers; both phrases of one word less are frequent."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, table = Reader(SMALL_BLOCK), Lookup(vocabulary.ids)
        for batch in batches:
            langs = batch.column(0)
            for runs in reader.runs(batch.column(1), langs):
                number = vocabulary.numbers(runs, langs, table)
                rare = np.append(0, np.cumsum(number == len(vocabulary.ids)))
                first = np.flatnonzero(runs.reach >= size)
                first = first[rare[first + size] == rare[first]]
                if shorter is not None:
                    part = np.zeros(len(runs.reach) + 1, dtype=bool)
                    part[frequent_at(runs, size - 1, shorter)] = True
                    first = first[part[first] & part[first + 1]]
                key = [number[first + k - 1] | (number[first + k - 2] << 32 if k > 1 else 0) for k in range(size, 0, -2)]
                if len(key) > 1:
                    order = np.argsort(runs.prints(first, size))
                    key = [c[order] for c in key]
                    fresh = np.ones(len(first), dtype=bool)
                    fresh[1:] = np.any([c[1:] != c[:-1] for c in key], axis=0)
                    begin = np.flatnonzero(fresh)
                    key, n = [c[begin] for c in key], np.diff(np.append(begin, len(first)))
                else:
                    found, n = np.unique(key[0], return_counts=True)
                    key = [found]
                columns = [pa.array(c) for c in key] + [pa.nulls(len(n), pa.int64())] * (len(NUMBERS) - len(key))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n.astype(np.int64))], names=[*NUMBERS, "n"])

    return run


def unpack(size: int, vocabulary: Vocabulary):
    """Ids of the words of phrases, and the prints of phrases."""
    up = powers(BASE, size)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = np.zeros((batch.num_rows, size), np.int64)
            for k in range(size):
                pair = batch.column((size - 1 - k) // 2).to_numpy()
                number[:, k] = pair >> 32 if (size - 1 - k) % 2 else pair & 0xFFFFFFFF
            value = (mix(vocabulary.prints[number]) * up).sum(axis=1, dtype=np.uint64) + np.uint64(size)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(size))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(ends, pa.array(vocabulary.ids[number].reshape(-1).view(np.int64))),
                    pa.array(np.full(batch.num_rows, size, np.int32)), pa.array(shortened(mix(value)).view(np.int64)), batch.column(len(NUMBERS)),
                ],
                names=["ids", "words", "print", "a"],
            )

    return run


def bitmap_of(prints: DataFrame, bits: int) -> Bitmap:
    """The bitmap of a table of prints, put together by tasks; at most 2 ** (bits - 6) rows come to the driver."""
    at = F.shiftrightunsigned("print", 64 - bits)
    word = prints.groupBy(F.shiftright(at, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(print, {64 - bits}) & 63 AS INT))")).alias("bits")
    )
    rows = word.toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Bitmap(out)


# --- spelling out --------------------------------------------------------------------------


def parted(prints: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each of n things the first thing that is the same, where equal things have equal prints."""
    first = np.arange(len(prints))
    left = np.arange(len(prints))
    while len(left):
        _, begin, of = np.unique(prints[left], return_index=True, return_inverse=True)
        first[left] = left[begin][of]
        left = left[~same(left, first[left])]
    return first


def spread(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def same_bytes(words: Words, data: np.ndarray):
    size = words.end - words.start

    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        equal = size[a] == size[b]
        n = np.where(equal, size[a], 0)
        within = spread(n)
        differ = np.append(0, np.cumsum(data[np.repeat(words.start[a], n) + within] != data[np.repeat(words.start[b], n) + within]))
        stop = np.cumsum(n)
        return equal & (differ[stop] == differ[stop - n])

    return same


def bytes_of(words: Words, data: np.ndarray, place: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts of the runs of ``size`` words at ``place``, words parted by a space: bytes, and the length of each."""
    each = (place[:, None] + np.arange(size)).reshape(-1)
    length = (words.end - words.start)[each]
    within = spread(length + 1)
    source = np.repeat(words.start[each], length + 1) + within
    space = within == np.repeat(length, length + 1)
    out = np.where(space, 32, data[np.minimum(source, len(data) - 1)]).astype(np.uint8)
    last = np.cumsum(length + 1)[size - 1 :: size] - 1
    return np.delete(out, last), length.reshape(-1, size).sum(axis=1) + size - 1


class Pool:
    """Phrases a task has met, by print: their texts, counts and least documents.  Texts of one print may differ."""

    def __init__(self):
        none = np.zeros(0, np.int64)
        self.prints, self.data = np.zeros(0, np.uint64), np.zeros(0, np.uint8)
        self.columns = {name: none for name in ("lang", "words", "n", "doc", "start", "length")}

    def add(self, prints: np.ndarray, data: np.ndarray, columns: dict[str, np.ndarray]) -> None:
        """Phrases of a block, each text once; equal ones are added up, others join the pool."""
        own = self.columns
        at = np.searchsorted(self.prints, prints)
        old = np.flatnonzero(np.append(self.prints, np.uint64(0))[at] == prints)
        old = old[at[old] < len(self.prints)]
        for name in ("lang", "words", "length"):
            old = old[own[name][at[old]] == columns[name][old]]
        n = columns["length"][old]
        differ = np.append(0, np.cumsum(
            data[np.repeat(columns["start"][old], n) + spread(n)] != self.data[np.repeat(own["start"][at[old]], n) + spread(n)]
        ))
        stop = np.cumsum(n)
        old = old[differ[stop] == differ[stop - n]]
        own["n"][at[old]] += columns["n"][old]
        own["doc"][at[old]] = np.minimum(own["doc"][at[old]], columns["doc"][old])
        new = np.ones(len(prints), dtype=bool)
        new[old] = False
        if new.any():
            n = columns["length"][new]
            texts = data[np.repeat(columns["start"][new], n) + spread(n)]
            added = columns | {"start": np.zeros(len(prints), np.int64)}
            added["start"][new] = len(self.data) + np.cumsum(n) - n
            joined = np.concatenate([self.prints, prints[new]])
            order = np.argsort(joined, kind="stable")
            self.prints, self.data = joined[order], np.concatenate([self.data, texts])
            self.columns = {name: np.concatenate([own[name], added[name][new]])[order] for name in own}

    def rows(self, names: list[str]) -> pa.RecordBatch:
        own = self.columns
        order = np.argsort(own["start"])  # texts follow each other in the data
        ends = np.append(0, np.cumsum(own["length"][order])).astype(np.int32)
        texts = pa.StringArray.from_buffers(len(order), pa.py_buffer(ends), pa.py_buffer(self.data))
        doc = own["doc"][order]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()).take(pa.array(own["lang"][order])), texts, pa.array(own["words"][order].astype(np.int32)),
                pa.array(own["n"][order]), pa.array(doc, mask=doc == MISSING), pa.array(self.prints[order].view(np.int64)),
            ],
            names=["lang", "phrase", "words", "n", "doc", "print"],
        )


def spell(bitmaps: list[Bitmap | None]):
    """Texts of frequent prints, or of all where there is no bitmap, and how often each stands in a task's texts."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, pool, names = Reader(SMALL_BLOCK), Pool(), {}
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            known = np.array([names.setdefault(name, len(names)) for name in langs.dictionary.to_pylist()], dtype=np.int64)
            codes, docs = known[langs.indices.to_numpy()], batch.column(2).fill_null(MISSING).to_numpy()
            for runs in reader.runs(batch.column(1), batch.column(0)):
                words, data = runs.words, runs.block.data
                data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
                alike = same_bytes(words, data)
                word = parted(words.hash, alike) if len(bitmaps) > 1 else None
                code = codes[runs.block.first : runs.block.first + runs.block.n]
                for size, bitmap in enumerate(bitmaps, 1):
                    at = frequent_at(runs, size, bitmap)
                    if not len(at):
                        continue

                    def same(a, b, at=at, size=size):
                        x, y = at[a], at[b]
                        equal = code[words.text[x]] == code[words.text[y]]
                        if word is None:
                            return equal & alike(x, y)
                        for k in range(size):
                            equal &= word[x + k] == word[y + k]
                        return equal

                    prints = runs.prints(at, size)
                    first = parted(prints, same)
                    own = first == np.arange(len(first))
                    group, of = np.flatnonzero(own), (np.cumsum(own) - 1)[first]
                    least = np.full(len(group), MISSING)
                    np.minimum.at(least, of, docs[runs.block.first + words.text[at]])
                    text, length = bytes_of(words, data, at[group], size)
                    pool.add(prints[group], text, {
                        "lang": code[words.text[at[group]]], "words": np.full(len(group), size), "n": np.bincount(of, minlength=len(group)),
                        "doc": least, "start": np.cumsum(length) - length, "length": length,
                    })
                if len(pool.prints) > POOL or len(pool.data) > POOL_BYTES:
                    yield from cut(pool.rows(list(names)))
                    pool = Pool()
        yield from cut(pool.rows(list(names)))

    return run


def cut(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, max(rows.num_rows, 1), ROWS):
        yield rows.slice(at, ROWS)


def spell_words():
    """Texts of all words and how often each stands in a task's texts; the sums per language are rows without a text."""
    spelled_out = spell([None])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = []
        for rows in spelled_out(batches):
            sums.append(pa.table({"lang": rows["lang"], "n": rows["n"]}).group_by("lang").aggregate([("n", "sum")]))
            yield rows.select(["lang", "phrase", "print", "n"])
        total = pa.concat_tables(sums).group_by("lang").aggregate([("n_sum", "sum")]).combine_chunks()
        none = total.num_rows
        for part in pa.table({
            "lang": total["lang"], "phrase": pa.nulls(none, pa.string()), "print": pa.nulls(none, pa.int64()), "n": total["n_sum_sum"],
        }).to_batches():
            yield part

    return run


def counted_words(texts: DataFrame, min_count: int) -> DataFrame:
    """(lang, phrase, words, print, a) of words whose print stands ``min_count`` times; without a text, all words per
    language.  All texts of a print come, frequent or not."""
    # Dealt by print, which serves the sums of texts and of prints.
    each = texts.mapInArrow(spell_words(), WORDS).repartition("print").groupBy("print", "lang", "phrase").agg(F.sum("n").alias("a"))
    often = each.withColumn("total", F.sum("a").over(W.partitionBy("print"))).filter((F.col("total") >= min_count) | F.col("print").isNull())
    return often.select("lang", "phrase", F.lit(1).alias("words"), "print", "a")


def spelled(texts: DataFrame, bitmaps: list[Bitmap]) -> DataFrame:
    found = texts.mapInArrow(spell(bitmaps), SPELLED).groupBy("lang", "phrase", "words", "print")
    return found.agg(F.sum("n").alias("a"), F.min("doc").alias("first_doc"))


def vocabulary_of(words: DataFrame, min_count: int) -> tuple[DataFrame, Vocabulary]:
    """Frequent words with their ids, and the same as arrays: sixteen bytes a word come to the driver, and the texts
    of words that share a print with another."""
    several = words.groupBy("print").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("print")
    shared = words.join(several, "print").select("print", "lang", "phrase", "a").collect()
    often = words.filter(F.col("a") >= min_count).withColumn("id", F.col("print"))
    if shared:
        often = often.join(several, "print", "left_anti").select(often.columns)
    ids = np.sort(often.select("print").toArrow()["print"].to_numpy().view(np.uint64))
    if not shared:
        return often, Vocabulary(ids, ids, np.zeros(0, np.uint64), {})
    told = [r for r in shared if r["a"] >= min_count]
    free = np.setdiff1d(np.arange(len(ids) + len(told), dtype=np.uint64), ids)[: len(told)]
    given = [(int(i), r["lang"], r["phrase"]) for i, r in zip(free, told)]
    table = words.sparkSession.createDataFrame(given, "id long, lang string, phrase string")
    often = often.unionByName(words.join(table, ["lang", "phrase"]).select(often.columns))
    prints = np.append(ids, np.array([r["print"] for r in told], np.int64).view(np.uint64))
    ids = np.append(ids, free)
    order = np.argsort(ids)
    ids, prints = ids[order], prints[order]
    own = {(lang, phrase.encode()): int(np.searchsorted(ids, np.uint64(i))) for i, lang, phrase in given}
    return often, Vocabulary(ids, prints, np.unique(np.array([r["print"] for r in shared], np.int64).view(np.uint64)), own)


def with_texts(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, print) of phrases given by the ids of their words."""
    each = phrases.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", F.col("phrase").alias("word")), "id")
    put = each.groupBy("ids", "words", "a", "print").agg(
        F.min("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("in_order")
    )
    return put.select("lang", F.array_join(F.col("in_order.word"), " ").alias("phrase"), "words", "a", "print")


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``longest`` words that stand at least ``min_count`` times, and all words per language.

    (lang, phrase, words, a, print) and (lang, n).
    """
    texts = texts_of(docs)
    plain = texts.select("lang", "text")
    summed = keep(counted_words(texts, min_count), "phrases-words")
    totals = summed.filter("phrase IS NULL").select("lang", F.col("a").alias("n"))
    words, vocabulary = vocabulary_of(summed.filter("phrase IS NOT NULL"), min_count)
    found, shorter = words.select("lang", "phrase", "words", "a", "print"), None
    for size in range(2, longest + 1):
        if not len(vocabulary.ids):
            break
        counted = plain.mapInArrow(count(size, vocabulary, shorter), NUMBERED).groupBy(*NUMBERS).agg(F.sum("n").alias("n"))
        often = keep(counted.filter(F.col("n") >= min_count).mapInArrow(unpack(size, vocabulary), UNPACKED), "phrases-numbered")
        shorter = bitmap_of(often.select("print"), bits)
        if not shorter.bits.any():
            break
        found = found.unionByName(with_texts(often, words))
    return keep(found, "phrases-frequent"), totals


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
        F.col("doc_id").cast("long").alias("doc"),
    )


# --- scores --------------------------------------------------------------------------------


def part(words: Column, begin: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, begin, size), " ")


def exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, absorb_pct: int = ABSORB_PCT, bits: int = FILTER_BITS,
    first_doc: bool = True,
) -> DataFrame:
    """The first ``top`` phrases per language: (lang, rank, phrase, a, l, r, n, score, first_doc).

    ``docs`` needs doc_id, text and lang.  The smallest document a phrase stands in is looked up for these phrases
    alone, in one more reading of the texts; without ``first_doc`` that column is left out.  A phrase cut in two has the score floor(1000 * a * n / (l * r));
    its lowest-scoring cut counts.  A phrase of which a longer one holds ``absorb_pct`` hundredths of the
    occurrences is left out.
    """
    known, totals = frequent(docs, min_count, longest, bits)
    candidates = known.filter("words > 1")
    cuts = candidates.select("lang", "phrase", "words", "a", F.split("phrase", " ").alias("w"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    halves = cuts.select(
        "lang", "phrase", "a", "k", part(F.col("w"), F.lit(1), F.col("k")).alias("left"),
        part(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("right"),
    )
    side = lambda name, n: known.select("lang", F.col("phrase").alias(name), F.col("a").alias(n))
    scored = halves.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    product = (F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).cast("decimal(38,0)")
    scored = scored.withColumn("above", product).withColumn("below", (exact("l") * exact("r")).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("above div below"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    # A phrase inside a longer one by several words is inside one longer by a single word, as frequent or more.
    longer = candidates.filter("words > 2").select("lang", "a", "words", F.split("phrase", " ").alias("w"))
    inner = F.explode(F.array(*[part(F.col("w"), F.lit(b), F.col("words") - 1) for b in (1, 2)]))
    around = longer.select("lang", "a", inner.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (100 * exact("longer") < F.lit(absorb_pct) * F.col("cut.a").cast("decimal(19,0)"))
    )
    order = W.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("cut.a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    ranked = ranked.select("lang", "rank", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")
    if not first_doc:
        return ranked
    ranked = keep(ranked, "phrases-ranked")
    chosen = keep(ranked.join(known.select("lang", "phrase", "words", "print"), ["lang", "phrase"]).select("words", "print"), "phrases-chosen")
    bitmaps = [bitmap_of(chosen.filter(F.col("words") == size).select("print"), bits) for size in range(1, longest + 1)]
    return ranked.join(spelled(texts_of(docs), bitmaps).select("lang", "phrase", "first_doc"), ["lang", "phrase"]).select(*ranked.columns, "first_doc")
