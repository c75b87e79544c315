"""Only segments that may hold a window of another one are merged."""

import numpy as np
import pyarrow as pa

from layover.llm import bwt
from layover.llm.blocks import Hasher, blocks
from tests.llm.test_bwt_merge import plain


def segments_of(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Anchors and bytes of all segments of texts."""
    block = next(blocks(pa.array(texts, pa.binary())))
    _, start, n, anchor, _ = bwt.anchors_of(Hasher(lower=False), block)
    return anchor, [block.data[a : a + k - 1 + bwt.LENGTH].tobytes() for a, k in zip(start, n)]


def merged(monkeypatch, texts: list[bytes]) -> tuple[int, int]:
    """Bytes of segments and of those that went through the merge, which has to be right."""
    anchor, segments = segments_of(texts)
    first = np.random.default_rng(len(texts)).permutation(len(segments)).astype(np.int64)
    taken, real = [0], bwt.first_documents
    monkeypatch.setattr(bwt, "first_documents", lambda first, data, size: taken.append(len(data)) or real(first, data, size))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(anchor.view(np.int64)), pa.array(range(len(segments)), pa.int64()), pa.array(first), pa.array(segments, pa.binary())],
        names=["anchor", "segment", "first", "bytes"],
    )
    rows = [r for b in bwt.merge(iter([batch])) for r in b.to_pylist()]
    assert [r["segment"] for r in rows] == list(range(len(segments)))
    found = []
    for row, segment in zip(rows, segments):
        runs, windows = row["runs"], len(segment) - bwt.LENGTH + 1
        for run, stop in zip(runs, [r["at"] for r in runs[1:]] + [windows]):
            found += [run["first"]] * (stop - run["at"])
    size = np.array([len(s) for s in segments])
    assert found == plain(first, np.frombuffer(b"".join(segments), np.uint8), size)
    monkeypatch.setattr(bwt, "first_documents", real)
    return int(size.sum()), sum(taken)


def test_segments_with_nothing_but_the_anchor_in_common_are_not_merged(monkeypatch):
    rng = np.random.default_rng(5)
    common = bytes(rng.integers(97, 123, 24).astype(np.uint8))
    texts = [bytes(rng.integers(97, 123, 60).astype(np.uint8)) + common + bytes(rng.integers(97, 123, 60).astype(np.uint8)) for _ in range(20)]
    whole, taken = merged(monkeypatch, texts)
    assert taken == 0 and whole > 20 * bwt.LENGTH


def test_every_shared_window_is_found_wherever_its_anchor_lies(monkeypatch):
    rng = np.random.default_rng(6)
    for kinds in (1, 2, 3, 26):
        source = rng.integers(97, 97 + kinds, 300).astype(np.uint8)
        texts = []
        for _ in range(30):
            a, n = int(rng.integers(0, 240)), int(rng.integers(50, 60))
            texts.append(bytes(rng.integers(97, 97 + kinds, 30).astype(np.uint8)) + source[a : a + n].tobytes() + bytes(rng.integers(97, 97 + kinds, 30).astype(np.uint8)))
        merged(monkeypatch, texts)
