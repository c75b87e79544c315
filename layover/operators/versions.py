"""Versioned tables without a table format.

A versioned table holds every row that ever lived, with the snapshot that added it and the one
that removed it (NULL = live).  Rows need no key, so tables with repeated rows work.  Snapshot ids
grow with each commit.  Commits are a small table (snapshot_id, committed_at).

Store such a table partitioned by ``added_snapshot``: a read of an old version then skips the
folders of later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from layover.functions.clock import moment, parse_moment
from layover.operators.mutate import is_true

ADDED, REMOVED = "added_snapshot", "removed_snapshot"


# --- writing versions ----------------------------------------------------------------------


def add_rows(versions: DataFrame | None, rows: DataFrame, snapshot: int) -> DataFrame:
    """Append rows in a new snapshot; without a table this creates one."""
    fresh = rows.withColumn(ADDED, F.lit(snapshot)).withColumn(REMOVED, F.lit(None).cast("int"))
    return fresh if versions is None else versions.unionByName(fresh)


def remove_rows(versions: DataFrame, condition: Column | str, snapshot: int) -> DataFrame:
    """Mark live rows that meet a condition as removed by a new snapshot."""
    gone = is_true(condition) & F.col(REMOVED).isNull()
    return versions.withColumn(REMOVED, F.when(gone, F.lit(snapshot)).otherwise(F.col(REMOVED)))


def replace_rows(
    versions: DataFrame, condition: Column | str, rows: DataFrame, snapshot: int
) -> DataFrame:
    """Remove rows and add others in one snapshot."""
    return add_rows(remove_rows(versions, condition, snapshot), rows, snapshot)


# --- the log -------------------------------------------------------------------------------


def commit(commits: DataFrame, snapshot: int, as_of=None) -> DataFrame:
    """The commit log with one more snapshot, which must be newer than all others.

    Write rows with ``add_rows`` or ``remove_rows`` first: a snapshot shows once it is committed.
    """
    newer = F.raise_error(F.lit("a snapshot must be newer than those committed"))
    latest = commits.agg(F.max("snapshot_id").alias("latest"))
    row = latest.select(
        F.when(F.col("latest") >= snapshot, newer).otherwise(F.lit(snapshot)).cast(commits.schema["snapshot_id"].dataType).alias("snapshot_id"),
        moment(as_of).cast(commits.schema["committed_at"].dataType).alias("committed_at"),
    )
    return commits.unionByName(row, allowMissingColumns=True)


def snapshot_log(versions: DataFrame, commits: DataFrame) -> DataFrame:
    """Per snapshot: commit time, operation, rows added and removed.

    One scan of the table; each row counts at most once as added and once as removed, and the
    counts are folded before the shuffle.
    """
    changes = (
        versions.select(
            F.explode(
                F.array(
                    F.struct(F.col(ADDED).alias("snapshot_id"), F.lit(1).alias("a"), F.lit(0).alias("r")),
                    F.struct(F.col(REMOVED).alias("snapshot_id"), F.lit(0).alias("a"), F.lit(1).alias("r")),
                )
            ).alias("c")
        )
        .filter("c.snapshot_id IS NOT NULL")
        .groupBy(F.col("c.snapshot_id").alias("snapshot_id"))
        .agg(F.sum("c.a").alias("added_rows"), F.sum("c.r").alias("removed_rows"))
    )
    added, removed = F.coalesce("added_rows", F.lit(0)), F.coalesce("removed_rows", F.lit(0))
    operation = (
        F.when((added > 0) & (removed > 0), "overwrite").when(removed > 0, "delete").otherwise("append")
    )
    return commits.join(changes, "snapshot_id", "left").select(
        "snapshot_id",
        "committed_at",
        operation.alias("operation"),
        added.alias("added_rows"),
        removed.alias("removed_rows"),
    )


def snapshot_history(commits: DataFrame) -> DataFrame:
    """When each snapshot became current, and the one before it.

    Works on the commit log of one table, one row per commit, never on the table's rows.  The log is
    put in order by a single task: it must stay a log of commits, not of changes.
    """
    order = W.orderBy("committed_at", "snapshot_id")
    return commits.select(
        F.col("committed_at").alias("made_current_at"),
        "snapshot_id",
        F.lag("snapshot_id").over(order).alias("parent_id"),
    )


def first_snapshot(commits: DataFrame) -> DataFrame:
    """The earliest snapshot, as one row."""
    return commits.agg(
        F.min_by("snapshot_id", F.struct("committed_at", "snapshot_id")).alias("snapshot_id"),
        F.min("committed_at").alias("committed_at"),
    )


# --- reading versions ----------------------------------------------------------------------


def visible(snapshot: Column) -> Column:
    """Rows added by then and not yet removed."""
    return (F.col(ADDED) <= snapshot) & (F.col(REMOVED).isNull() | (F.col(REMOVED) > snapshot))


def read_current(versions: DataFrame) -> DataFrame:
    return versions.filter(F.col(REMOVED).isNull()).drop(ADDED, REMOVED)


def read_snapshot(versions: DataFrame, snapshot: int | Column) -> DataFrame:
    """The table as a snapshot left it."""
    at = snapshot if isinstance(snapshot, Column) else F.lit(snapshot)
    return versions.filter(visible(at)).drop(ADDED, REMOVED)


def snapshot_at(commits: DataFrame, as_of) -> Column:
    """Latest snapshot committed at or before an instant, as a scalar; NULL before the first."""
    newest = F.max_by("snapshot_id", F.struct("committed_at", "snapshot_id"))
    return commits.filter(F.col("committed_at") <= moment(as_of)).agg(newest).scalar()


def read_as_of(versions: DataFrame, commits: DataFrame, as_of) -> DataFrame:
    """The table as it was at an instant; before the first commit it is empty."""
    return read_snapshot(versions, snapshot_at(commits, as_of))


def read_as_of_text(versions: DataFrame, commits: DataFrame, text: str) -> DataFrame:
    """The same with the instant written as text, in any form the time parser reads."""
    return read_as_of(versions, commits, parse_moment(F.lit(text)))


def read_as_of_millis(versions: DataFrame, commits: DataFrame, millis: int) -> DataFrame:
    """The same with the instant as milliseconds since 1970, in UTC."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.lit(millis).cast("decimal(20,0)") / 1000
    return read_as_of(
        versions, commits, start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
    )


def compare(versions: DataFrame, snapshot: int | Column) -> DataFrame:
    """Rows now, rows at a snapshot, and the difference, from one scan."""
    at = snapshot if isinstance(snapshot, Column) else F.lit(snapshot)
    now = F.count_if(F.col(REMOVED).isNull())
    then = F.count_if(visible(at))
    return versions.agg(
        now.alias("current_rows"), then.alias("past_rows"), (now - then).alias("rows_added")
    )
