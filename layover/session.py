"""Session settings the operators rely on, and the shared folder they may write to."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Runtime settings, safe to apply to a session somebody else made.  Hot join keys are split by
# adaptive execution; the "force" flag keeps that true when a later step wants the same keys.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

TARGET_PARTITION_BYTES = 128 * 1024 * 1024


def tune(spark: SparkSession, shuffle_bytes: int | None = None) -> SparkSession:
    """Apply the runtime settings; size the shuffle when the caller knows how much it moves.

    ``shuffle_bytes`` is the expected size of the largest shuffle.  Adaptive execution merges
    partitions that turn out small, so the number is an upper bound and may be generous.
    """
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    if shuffle_bytes:
        wanted = -(-shuffle_bytes // TARGET_PARTITION_BYTES)
        floor = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.shuffle.partitions", str(max(floor, wanted)))
    return spark


def configured_dir(spark: SparkSession) -> str | None:
    """The shared folder the session names, from ``spark.checkpoint.dir`` or its checkpoint folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    return (named or context.getCheckpointDir() or "").rstrip("/") or None


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach; its name comes from the session's owner."""
    folder = configured_dir(spark)
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return folder


#: Paths handed out and not yet removed.
_PATHS: list[str] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is ever overwritten.  ``sweep`` removes them."""
    _PATHS.append(f"{shared_dir(spark)}/layover-{label}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def sweep(spark: SparkSession) -> int:
    """Remove what was written under the paths handed out so far; how many there were.

    For the session's owner, once no result that reads them is needed any more.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = 0
    while _PATHS:
        base = _PATHS.pop()
        for suffix in ("", "-in", "-state"):
            path = jvm.org.apache.hadoop.fs.Path(base + suffix)
            found += bool(path.getFileSystem(conf).delete(path, True))
    return found
