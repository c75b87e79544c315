"""Vectors that can be compared: known id, no null and only finite components, at least one of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows of (vec_id, vector, …) that take part, with their length as ``dim``."""
    limit = F.lit(float("inf"))
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit))
    return rows.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & sound).withColumn(
        "dim", F.size(vector)
    )


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def packed(**arrays: np.ndarray) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    import io

    with np.load(io.BytesIO(data)) as found:
        return {k: found[k] for k in found.files}
