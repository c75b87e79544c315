"""Memory of the task that spells phrases out."""

import tracemalloc

import numpy as np
import pyarrow as pa

from layover.llm import phrases

ROWS = 1200
#: Bytes that spelling may take for a batch of four megabytes of text, whose words are few.
MOST = 150 << 20


def test_spelling_takes_little_memory_for_much_text():
    words = np.array([f"word{i:03d}" for i in range(50)])
    rng = np.random.default_rng(1)
    texts = [" ".join(words[rng.integers(0, 50, 450)]) for _ in range(ROWS)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * ROWS), pa.array(texts), pa.array(range(ROWS), pa.int64())], names=["lang", "text", "doc"]
    )
    everything = phrases.Bitmap(np.full(16, np.iinfo(np.uint64).max, dtype=np.uint64))
    tracemalloc.start()
    try:
        rows = sum(b.num_rows for b in phrases.spell([everything])(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 50
    assert peak < MOST, f"{peak >> 20} MB"
