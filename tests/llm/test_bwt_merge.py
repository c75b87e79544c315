"""The merge of two transforms against windows compared one by one."""

import numpy as np
import pytest

from layover.llm import bwt


def plain(first, data, size):
    """Smallest document of every window, from a table of all windows."""
    begin = np.cumsum(size) - size
    windows = [
        (bytes(data[b + i : b + i + bwt.LENGTH]), f) for b, n, f in zip(begin, size, first) for i in range(n - bwt.LENGTH + 1)
    ]
    least = {}
    for window, f in windows:
        least[window] = min(f, least.get(window, f))
    return [least[w] for w, _ in windows]


@pytest.mark.parametrize("kinds", [1, 2, 60, 254, 255, 256])
@pytest.mark.parametrize("segments", [2, 3, 40])
def test_windows_get_their_first_documents(kinds, segments):
    rng = np.random.default_rng(kinds * 100 + segments)
    source = rng.integers(0, kinds, 400).astype(np.uint8)
    pieces = [source[a : a + bwt.LENGTH + int(n)] for a, n in zip(rng.integers(0, 300, segments), rng.integers(0, 31, segments))]
    pieces[-1] = np.arange(256, dtype=np.uint8)[:kinds].repeat(50)[: max(50, kinds * 50)]
    size, data = np.array([len(p) for p in pieces]), np.concatenate(pieces)
    first = rng.permutation(segments).astype(np.int64)
    assert bwt.first_documents(first, data, size).tolist() == plain(first, data, size)


def test_two_bytes_are_taken_at_a_time(monkeypatch):
    entries = []
    real = bwt.interleave
    monkeypatch.setattr(bwt, "interleave", lambda one, two, rounds: entries.append(rounds) or real(one, two, rounds))
    data = np.frombuffer(b"ab" * 60, dtype=np.uint8)
    bwt.first_documents(np.array([1, 2]), data, np.array([60, 60]))
    assert entries == [bwt.LENGTH // 2]
