"""Updates, deletes and merges as functions from table to table.

Each reads a table and returns its next state; the caller writes that to a new place.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layover.operators.keys import attach, one_row_per_key


def is_true(condition: Column | str) -> Column:
    """The condition with NULL read as false, as UPDATE and DELETE do."""
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return F.coalesce(condition, F.lit(False))


def update_where(table: DataFrame, condition: Column | str, values: Mapping[str, Column]) -> DataFrame:
    """Set columns on the rows that meet a condition, all from the row's old values."""
    hit = is_true(condition)
    return table.select(
        *[
            F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in table.columns
        ]
    )


def delete_where(table: DataFrame, condition: Column | str) -> DataFrame:
    return table.filter(~is_true(condition))


def replace_rows(table: DataFrame, condition: Column | str, rows: DataFrame) -> DataFrame:
    """Delete the rows that meet a condition and append others."""
    return delete_where(table, condition).unionByName(rows)


def append_rows(table: DataFrame, rows: DataFrame) -> DataFrame:
    """All rows of both, repeats kept."""
    return table.unionByName(rows)


def update_from_keys(
    table: DataFrame, keys: DataFrame, on: str, values: Mapping[str, Column]
) -> DataFrame:
    """Set columns on the rows whose key occurs in another table."""
    found = keys.select(on).distinct().withColumn("__found", F.lit(True))
    marked = attach(table, found, on)
    return update_where(marked, F.col("__found"), values).select(*table.columns)


def merge_upsert(
    table: DataFrame, source: DataFrame, on: str, matched: Mapping[str, Column]
) -> DataFrame:
    """Matched rows take the given expressions, source rows without a match are inserted.

    Expressions see the table's columns by name and the source's as ``new_<name>``.  Source keys
    that are not null must be unique, or the job fails.  Written as a left join plus an anti join, because a hot
    key of the table could not be split in a full outer join.
    """
    loose = source.filter(F.col(on).isNull())  # matches nothing, so it is inserted
    source = one_row_per_key(source.filter(F.col(on).isNotNull()), on)
    fresh = source.select(
        on, F.lit(True).alias("__found"), *[F.col(c).alias(f"new_{c}") for c in source.columns if c != on]
    )
    joined = attach(table, fresh, on)
    updated = update_where(joined, F.col("__found"), matched).select(*table.columns)
    inserted = source.join(table.select(on).distinct(), on, "left_anti").unionByName(loose)
    return updated.unionByName(inserted, allowMissingColumns=True).select(*table.columns)


def one_per_key(table: DataFrame, on: str) -> DataFrame:
    """One row per key: the smallest by the other columns in order, so the survivor is fixed."""
    rest = [c for c in table.columns if c != on]
    least = F.min(F.struct(*rest))
    return table.groupBy(on).agg(least.alias("__row")).select(on, "__row.*").select(*table.columns)


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both with a flag per side, NULLs equal; folded before the one shuffle."""
    both = left.withColumns({"__l": F.lit(True), "__r": F.lit(False)}).unionByName(
        right.withColumns({"__l": F.lit(False), "__r": F.lit(True)})
    )
    return both.groupBy(*left.columns).agg(F.max("__l").alias("__l"), F.max("__r").alias("__r"))


def common_values(left: DataFrame, right: DataFrame) -> DataFrame:
    """Set intersection.  Spark's own would send a value's repeats to one task."""
    return _sides(left, right).filter("__l AND __r").drop("__l", "__r")


def missing_values(left: DataFrame, right: DataFrame) -> DataFrame:
    """Set difference: distinct rows of the left that the right does not have."""
    return _sides(left, right).filter("__l AND NOT __r").drop("__l", "__r")


def sample_by_key(table: DataFrame, key: str, fraction: float, seed: int = 3) -> DataFrame:
    """Sample that always picks the same keys: a hash of seed and key against the fraction."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return table.filter(place < F.lit(int(fraction * 2**32)))
