"""Python workers give back what their tasks have freed."""

import re
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from layover.llm import minhash, packing, passages, phrases, scratch, toxicity

PINS = []


def held() -> int:
    """MB of this process that no file backs."""
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) >> 10


def greedy(batches):
    """Takes 200 MB in small parts and frees them, but for the last one, above which nothing lies."""
    parts = [np.ones(8_000, np.int64) for _ in range(3_200)]
    PINS.append(np.ones(8_000, np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([len(parts)])], names=["n"])


@pytest.mark.skipif(sys.platform != "linux", reason="memory is read as Linux tells it")
def test_freed_memory_goes_back_when_a_task_ends():
    before = held()
    assert [b.num_rows for b in scratch.gives_back(greedy)(iter([]))] == [1]
    assert held() - before < 60


def test_a_task_that_fails_or_is_left_gives_back_too(monkeypatch):
    calls = []
    monkeypatch.setattr(scratch, "trim_here", lambda: calls.append(1))
    for _ in scratch.gives_back(greedy)(iter([])):
        break

    def fails(batches):
        yield from greedy(batches)
        raise ValueError

    with pytest.raises(ValueError):
        list(scratch.gives_back(fails)(iter([])))
    assert calls == [1, 1]


def test_tasks_of_the_pipeline_give_back():
    tasks = [
        toxicity.corpus_words, toxicity.corpus_grams(np.zeros(0, np.uint64)), toxicity.accepting(None, 0, 0.7), minhash.sign,
        minhash.overlaps(75), minhash.differences(75), passages.cut_pieces(13), passages.cut_windows(13), passages.locate(1),
        packing.cut("{}", 1024), phrases.spell([None]), phrases.count(2, None, None),
    ]
    assert [t for t in tasks if not hasattr(t, "__wrapped__")] == []
