"""Collocations against a plain count."""

import random
import re
from collections import Counter

import pytest

from layover.llm import phrases
from tests.conftest import SF, SF_SMALL

LOWER = {c: c + 32 for c in range(65, 91)}


def plain(docs: list[tuple], least: int, top: int = 2000, absorb: int = 100) -> list[tuple]:
    count, total, holder = Counter(), Counter(), {}
    for doc, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    count[key] += 1
                    if doc is not None:
                        holder[key] = min(doc, holder.get(key, doc))
    known = {key: a for key, a in count.items() if a >= least}
    rows = {}
    for (lang, w), a in known.items():
        inside = [b for (other, x), b in known.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
        if len(w) > 1 and not any(100 * b >= absorb * a for b in inside):
            cuts = [(1000 * a * total[lang] // (known[lang, w[:k]] * known[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), known[lang, w[:k]], known[lang, w[k:]], holder.get((lang, w))))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, total[lang], -s, d)
        for lang, found in rows.items() for rank, (s, a, p, l, r, d) in enumerate(sorted(found, key=lambda f: f[:3]), 1) if rank <= top
    )


def found(docs, least, **options):
    return sorted(tuple(r) for r in phrases.collocations(docs, min_count=least, **options).collect())


def triples(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang").collect()]


def noise(seed: int) -> list[tuple]:
    random.seed(seed)
    words = ["a", "B", "the", "New", "york", "é", "日本", "x\x00", " ", "it's", "-"]
    gaps = [" ", "  ", "\t", " \t ", ", ", ".", " !? ", "\n", "\r\n", "\x0b"]
    docs = []
    for k in range(60):
        text = "".join(x for _ in range(random.randrange(60)) for x in (random.choice(words), random.choices(gaps, [20, 3, 2, 1, 2, 2, 1, 1, 1, 1])[0]))
        docs.append((random.choice([None, k, k // 2]), random.choice([text, text + " New York city hall", " " + text]), random.choice(["en", "en", None, "und", "日本語の長い名前"])))
    return docs + docs[:5] + [(99, None, "en"), (98, "", "xx"), (97, " .,", "yy")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_a_plain_count(spark, seed):
    docs = noise(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    assert found(df, 3) == plain(docs, 3)
    assert found(df, 2, top=7, absorb_pct=60) == plain(docs, 2, 7, 60)


def test_colliding_prints_cost_no_count(spark, monkeypatch):
    """Prints of 5 bits, blocks of 2 KB, a bitmap of 64 bits: nearly everything collides."""
    docs = noise(4)
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(2)
    monkeypatch.setattr(phrases, "PRINT_BITS", 5)
    monkeypatch.setattr(phrases, "BLOCK", 2048)
    assert found(df, 4, bits=7) == plain(docs, 4)


def test_words_with_one_hash_are_told_apart():
    import numpy as np
    import pyarrow as pa

    block = next(phrases.blocks(pa.array(["ab cd ab ef cd", "AB abc x"])))
    words = phrases.Reader().hasher.words(block)
    data = np.where((block.data >= 65) & (block.data <= 90), block.data + 32, block.data).astype(np.uint8)
    first = phrases.parted(np.zeros(len(words.hash), np.uint64), phrases.same_bytes(words, data))
    assert list(first) == [0, 1, 0, 3, 1, 0, 6, 7]


@pytest.mark.parametrize("folder, least", [(SF_SMALL, 20), (SF, 100)])
def test_the_test_table(spark, folder, least):
    df = spark.read.parquet(f"{folder}/documents.parquet")
    assert found(df, least) == plain(triples(df), least)


def test_odd_rows_and_large_counts(spark, odd, none):
    assert found(odd, 2) == plain(triples(odd), 2)
    assert found(none, 1) == []
    long_text = spark.createDataFrame([(1, "ab cd " * 300_000, "en"), (2, "ef " * 5, None)], "doc_id long, text string, lang string")
    assert found(long_text, 100) == plain(triples(long_text), 100)
