"""Benchmark passages against a plain search, word by word."""

import random
import re

import pytest

from layover.llm import decontam
from tests.conftest import SF, SF_SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs: list[tuple], items: list[tuple], size: int = 10) -> list[tuple]:
    windows: dict = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, named = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    named |= windows[tuple(w[i : i + n])]
        out.append((doc, len(w), sorted(hit), sorted(str(x) for x in named if x is not None)))
    return sorted(out, key=str)


def found(docs, items, **options) -> list[tuple]:
    rows = decontam.contamination(docs, items, **options).collect()
    for r in rows:
        assert all(a["stop"] < b["start"] for a, b in zip(r["hits"], r["hits"][1:]))
    return sorted(((r["doc_id"], r["n_words"], [k for h in r["hits"] for k in range(h["start"], h["stop"])], r["items"]) for r in rows), key=str)


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string").repartition(2),
    )


@pytest.mark.parametrize("folder", [SF_SMALL, SF])
def test_the_test_tables(spark, folder):
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    pairs = [[tuple(r) for r in df.select(*c).collect()] for df, c in ((docs, ("doc_id", "text")), (items, ("item_id", "text")))]
    assert found(docs, items) == plain(*pairs)


def random_tables(seed: int):
    """Few different words, so that windows meet often, part of the way and across edges."""
    random.seed(seed)
    say = lambda n: " ".join(random.choices(["a", "B", "c1", "é", "日本", "a,b"], k=n))
    items = [(k, say(random.choice([0, 1, 2, 3, 5, 9, 10, 11, 25]))) for k in range(30)]
    items += [(3, say(12)), (None, say(4)), (50, None), (51, " ,. "), (52, items[8][1])]
    docs = [(k, say(random.choice([0, 1, 5, 9, 10, 40, 300]))) for k in range(40)]
    docs += [(k + 100, f"{say(20)}\n{text}; {say(7)}") for k, (_, text) in enumerate(items)]
    docs += [(None, say(30)), (None, None), (7, say(3)), docs[5], docs[5]]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_few_words(spark, seed):
    docs, items = random_tables(seed)
    assert found(*frames(spark, docs, items)) == plain(docs, items)


def test_long_windows_only(spark):
    """No short items: cursors move on by up to nine words."""
    random.seed(3)
    say = lambda n: " ".join(f"w{random.randrange(40)}" for _ in range(n))
    items = [(k, say(random.randint(10, 40))) for k in range(30)]
    docs = [(k, " ".join([say(random.randint(0, 300)), *[x for _, x in random.sample(items, 2)], say(random.randint(0, 9))])) for k in range(40)]
    docs += [(k + 50, " ".join(items[k][1].split()[:9])) for k in range(20)]
    assert found(*frames(spark, docs, items)) == plain(docs, items)


def test_many_shards_find_the_same(spark):
    docs, items = random_tables(4)
    frame = frames(spark, docs, items)
    assert found(*frame, shard_bytes=30_000) == plain(docs, items)


def test_equal_hashes_are_told_apart_by_bytes(spark, monkeypatch):
    """With a block's hash that knows only its words' lengths, comparing the bytes decides."""
    import numpy as np

    from layover.llm.decontam import Reader, search, shards
    import pyarrow as pa

    docs, items = random_tables(5)
    monkeypatch.setattr(decontam, "pair", lambda a, b: decontam.mix(np.ones(len(a), np.uint64)))
    monkeypatch.setattr(decontam, "AT_ONCE", 50)
    _, table = frames(spark, docs, items)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in docs], pa.int64()), pa.array([t for _, t in docs]), pa.nulls(len(docs), pa.int64()),
         pa.array([[]] * len(docs), decontam.HITS), pa.array([[]] * len(docs), pa.list_(pa.string()))],
        names=["doc_id", "text", "n_words", "hits", "items"],
    )
    (tables, names), = shards(table, 10, 1 << 30)
    rows = [r for b in search(tables, names)(iter([batch])) for r in b.to_pylist()]
    got = sorted(((r["doc_id"], r["n_words"], [k for h in r["hits"] for k in range(h["start"], h["stop"])], sorted(r["items"])) for r in rows), key=str)
    assert got == plain(docs, items)
    assert Reader().space[ord("-")] and not Reader().space[0xE9]


def test_odd_rows_and_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "five words five six seven"), (2, "Shared1word shared2word shared3word"), (3, "word")], "item_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert found(odd, items) == plain(docs, [tuple(r) for r in items.collect()])
    assert found(odd, nothing) == plain(docs, [])
    assert found(none, items) == [] == found(none, nothing)
    hit = {t for (i, t), (_, _, h, _) in zip(docs, [plain([d], [tuple(r) for r in items.collect()])[0] for d in docs]) if h}
    rest = decontam.clean(odd, items)
    assert rest.schema == odd.schema
    assert sorted(map(str, rest.collect())) == sorted(str(r) for r in odd.collect() if r["text"] not in hit)
