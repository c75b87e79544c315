"""What the toxicity models read."""

import gc
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from layover.llm import toxicity


def scores(spark, toxic, fine, probes):
    docs = [(i, (toxic if i % 2 else fine)(i)) for i in range(400)] + [(1000 + k, t) for k, t in enumerate(probes)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    rows = toxicity.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), labels).collect()
    found = {r["doc_id"]: r["score"] for r in rows}
    return [found[1000 + k] for k in range(len(probes))]


def test_words_are_read_to_their_end(spark):
    low, high = scores(
        spark, lambda i: f"some text internationalbad number {i}", lambda i: f"some text internationalfine number {i}",
        ["some text internationalfine number 7", "some text internationalbad number 7"],
    )
    assert low < 0.3 and high > 0.7


def test_runs_without_spaces_are_read_throughout(spark):
    plain = lambda i: "".join(chr(0x4E00 + (i * 37 + k * 101) % 3000) for k in range(30))
    around = lambda i, own: plain(i // 2 % 20) + own + plain(i // 2 % 20 + 20)
    toxic, fine = (lambda i, own=own: around(i, own) for own in ("\u8a9e\u8a9f", "\u8a90\u8a9e"))
    found = scores(spark, toxic, fine, [f(i) for f in (fine, toxic) for i in range(0, 40, 2)])
    assert max(found[:20]) < 0.3 and min(found[20:]) > 0.7


def test_corpus_words_grow_with_the_corpus_and_rare_ones_stay(spark):
    texts = [f"Same words and rare{i}" for i in range(500)]
    docs = spark.createDataFrame([(t,) for t in texts * 2], "text string").repartition(4)
    found = [bytes(r["word"]).decode() for r in docs.mapInArrow(toxicity.corpus_words, "word binary").distinct().collect()]
    assert sorted(found) == sorted({w for t in texts for w in t.lower().split()})


def plain(corpus, classes, order):
    """Kneser-Ney word by word with dictionaries: the difference of both log-likelihoods of a word."""
    spelt = lambda word: ["<"] + list(word) + [">"]
    low = lambda text: "".join(c.lower() if c.isascii() else c for c in text)
    before = {}
    for word in {w for t in corpus for w in low(t).split()}:
        s = spelt(word)
        for k in range(1, len(s)):
            for m in range(1, order):
                if k - m >= 0:
                    before.setdefault(tuple(s[k - m + 1 : k + 1]), set()).add(s[k - m])
    lower, counts = {}, []
    for gram, symbols in before.items():
        lower.setdefault(gram[:-1], {})[gram[-1]] = len(symbols)
    for texts in classes:
        counts.append({})
        for t in texts:
            for word in set(low(t).split()):
                s = spelt(word)
                for k in range(1, len(s)):
                    after = counts[-1].setdefault(tuple(s[max(0, k - order + 1) : k]), {})
                    after[s[k]] = after.get(s[k], 0) + 1

    def interpolated(after, symbol, below):
        if not after:
            return below
        total = sum(after.values())
        return max(after.get(symbol, 0) - 0.75, 0) / total + 0.75 * len(after) / total * below

    def value(word):
        s, out = spelt(low(word)), 0.0
        for k in range(1, len(s)):
            history, p = s[max(0, k - order + 1) : k], 1 / len(lower[()])
            for m in range(1, len(history) + 1):
                p = interpolated(lower.get(tuple(history[len(history) - m + 1 :])), s[k], p)
            one, two = (interpolated(c.get(tuple(history)), s[k], p) for c in counts)
            out += math.log(two / one)
        return out

    return value


def test_equals_plain_kneser_ney(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcd\u00e9\u0416") for _ in range(rng.randrange(1, 9)))
    known = [word() for _ in range(60)]
    texts = [" ".join(rng.choice(known) if rng.random() < 0.8 else word().upper() for _ in range(rng.randrange(0, 12))) for _ in range(60)]
    classes = [texts[0:20], texts[20:40]]
    counted = [toxicity.grams(each) for each in classes]
    found = toxicity.Grams.merged(counted)
    docs = spark.createDataFrame([(t,) for t in [*texts, None, texts[3]]], "text string").repartition(4)
    model = toxicity.build(counted, found, toxicity.Shared.load(toxicity.continuations(docs, found), found).chance(found))
    value = plain(texts, classes, toxicity.ORDER)
    probes = texts + ["", "a", "zz abcd", "dcbaabcd" * 3]
    got = np.concatenate([model.features(b.n, w, s)[:, 0] for b, w, s in toxicity.spellings(pa.array(probes))])
    np.testing.assert_allclose(got, [np.mean([value(w) for w in t.split()] or [0.0]) for t in probes], rtol=1e-9, atol=1e-12)


def test_without_labels_or_texts(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None), (None, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs.limit(0), none).collect() == []
    assert {r["predicted"] for r in toxicity.score(docs, none).collect()} == {0}


def test_an_expression_of_one_document_counts(spark):
    learn = [["all fine here", "more words here"], ["all fine here", "more vileword here"]]
    counted = [toxicity.grams(each) for each in learn]
    found = toxicity.Grams.merged(counted)
    docs = spark.createDataFrame([(t,) for each in learn for t in each], "text string")
    model = toxicity.build(counted, found, toxicity.Shared.load(toxicity.continuations(docs, found), found).chance(found))
    mean = [model.features(b.n, w, s)[0, 0] for t in ("all vileword", "all words") for b, w, s in toxicity.spellings(pa.array([t]))]
    assert mean[0] > 0 > mean[1]


@pytest.mark.parametrize("text,known", [
    ("one two", ["one", "two"]),
    ("ab\u65e5\u672cc d\u00e9", ["ab", "\u65e5\u672c", "\u672c", "c", "d\u00e9"]),
    ("\u65e5\u672c\u8a9e\u6587\u5b57", ["\u65e5\u672c\u8a9e\u6587", "\u672c\u8a9e\u6587\u5b57", "\u8a9e\u6587\u5b57", "\u6587\u5b57", "\u5b57"]),
])
def test_words(text, known):
    found = [block.data[a:b].tobytes().decode() for block, words, _ in toxicity.spellings(pa.array([text])) for a, b in zip(words.start, words.end)]
    assert found == known


def test_lower_orders_of_the_classes_are_let_go(spark, monkeypatch):
    """While the driver loads the shared orders, only the merged n-grams still have lower ones."""
    held, load = [], toxicity.Shared.load

    def watched(table, found):
        held.append(sum(len(g.lower) for g in gc.get_objects() if isinstance(g, toxicity.Grams)) - len(found.lower))
        return load(table, found)

    monkeypatch.setattr(toxicity.Shared, "load", watched)
    docs = spark.createDataFrame([(i, f"word{i % 7} some text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.score(docs, labels).count() == 60
    assert held == [0]
