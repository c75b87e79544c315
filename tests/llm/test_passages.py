"""Repeated passages against a plain comparison of words and lines, which knows nothing of anchors and pieces."""

import random
import re

import pytest

from layover.llm import passages
from tests.conftest import SF, SF_SMALL
from tests.llm.test_text import pairs

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def whole(raw: bytes, bounds: list[tuple]) -> set:
    """(first word, word after) of every line and every paragraph."""
    out = set()
    for edge in (rb"\n", rb"\n[\x20\x09-\x0D]*\n"):
        stops = [m.start() for m in re.finditer(edge, raw)] + [len(raw)]
        for a, b in zip([0, *stops], stops):
            inside = [k for k, (x, y) in enumerate(bounds) if a <= x and y <= b]
            if inside:
                out.add((inside[0], inside[-1] + 1))
    return out


def plain(docs: list[tuple], least: int = 13) -> dict:
    """doc_id -> text without the words of windows, lines and paragraphs that stand at an earlier place."""
    found, first, lines = {}, {}, {}
    for i, t in sorted(d for d in docs if None not in d):
        bounds = [(m.start(), m.end()) for m in WORD.finditer(t.encode())]
        found[i] = bounds, [t.encode()[a:b].lower() for a, b in bounds]
    windows = lambda words: [(k, tuple(words[k : k + least])) for k in range(len(words) - least + 1)]
    for i, (_, words) in found.items():
        for k, w in windows(words):
            first.setdefault(w, (i, k))
        for a, b in sorted(whole(dict(docs)[i].encode(), found[i][0])):
            lines.setdefault(tuple(words[a:b]), (i, a))
    out = dict(docs)
    for i, (bounds, words) in found.items():
        gone = set()
        for k, w in windows(words):
            doc, at = first[w]
            if doc != i or k >= at + least:
                gone.update(range(k, k + least))
        raw = out[i].encode()
        for a, b in whole(raw, bounds):
            if lines[tuple(words[a:b])] != (i, a):
                gone.update(range(a, b))
        ends = [a for a, _ in bounds[1:]] + [len(raw)]
        kept = [raw[a:end] for k, ((a, _), end) in enumerate(zip(bounds, ends)) if k not in gone]
        out[i] = (raw[: bounds[0][0] if bounds else len(raw)] + b"".join(kept)).decode()
    return out


def cut(spark, docs):
    return dict(pairs(passages.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))))


def test_passages_go_with_all_words_that_agree(spark):
    """Inside lines, in other surroundings each time, from 13 words on; 12 words stay."""
    random.seed(5)
    word = lambda: f"w{random.randrange(10**9)}"
    docs, own = [], []
    for n in (12, 13, 14, 20, 25, 30, 51):
        for _ in range(20):
            shared = [word() for _ in range(n)]
            for _ in range(2):
                before, after = [[word() for _ in range(random.randint(1, 20))] for _ in range(2)]
                docs.append((len(docs), " ".join(before + shared + after)))
                own.append(before + (shared if len(docs) % 2 or n < 13 else []) + after)
    got = cut(spark, docs)
    assert got == plain(docs)
    assert all(got[i].split() == w for i, w in enumerate(own))


def test_equal_lines_are_cut_alike_in_any_surroundings(spark):
    random.seed(6)
    word = lambda: f"w{random.randrange(10**9)}"
    docs = []
    for n in range(13, 26):
        line = " ".join(word() for _ in range(n))
        docs += [(len(docs) + k, f"{word()} {word()}\n{line}\n{word()}") for k in range(3)]
    got = cut(spark, docs)
    assert got == plain(docs)
    assert all(len(got[i].split()) == 3 for i, _ in docs if i % 3)


def test_whole_lines_and_paragraphs_go_whatever_their_length(spark):
    docs = [
        (0, "Page\nfirst own text here\n\nAll rights reserved\n"),
        (1, "second own text there\nALL  rights\treserved\nand more of it\npage"),
        (2, "all rights reserved in a line of its own\npage one"),
        (3, "third text\n \nAll rights\nreserved\n\npage"),
        (4, "}\n}\nnew"), (5, "all rights reserved"), (6, "new\nnewer"),
    ]
    got = cut(spark, docs)
    assert got == plain(docs)
    assert got[0] == docs[0][1] and got[2] == docs[2][1]
    assert got[1] == "second own text there\nand more of it\n" and got[3] == "third text\n \n"
    assert got[4] == "}\nnew" and got[5] == "" and got[6] == "newer"


def test_repeats_within_a_text_and_few_different_words(spark):
    random.seed(7)
    docs = [(0, "word " * 400), (1, "a b " * 60 + "c"), (2, "b a " * 60), (3, ""), (4, None), (5, " ")]
    docs += [(10 + k, " ".join(random.choice("ab") for _ in range(300))) for k in range(5)]
    docs += [(20 + k, " ".join(random.choices(["one", "two", "Three", "\n"], [9, 3, 2, 1], k=200))) for k in range(5)]
    assert cut(spark, docs) == plain(docs)


@pytest.mark.parametrize("folder", [SF_SMALL, SF])
def test_the_test_table_against_words(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert dict(pairs(passages.remove_repeats(docs))) == plain(pairs(docs))


def test_spans_are_what_was_removed(spark, odd):
    before = dict(pairs(odd.filter("doc_id IS NOT NULL")))
    for r in passages.remove_repeats(odd).filter("doc_id IS NOT NULL").collect():
        raw = (before[r["doc_id"]] or "").encode()
        for s in reversed(r["spans"]):
            raw = raw[: s["start"]] + raw[s["end"] :]
        assert raw.decode() == (r["text"] or "")
