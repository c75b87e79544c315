"""Key-driven building blocks shared by the operators.

Fact tables may hold a third of their rows under one key.  The rules followed here:

* a lookup side is reduced to one row per key first, so a join never multiplies rows;
* facts stay on the left of ``left``, ``inner``, ``left_semi`` and ``left_anti`` joins, the shapes
  in which adaptive execution can split a hot key over many tasks;
* both sides join on the key *and its hash*.  Adaptive execution splits a join only when each side
  comes straight out of a shuffle.  A lookup that was just grouped by the key would be joined where
  it is, and its hot facts could not be split; asking for the hash as well makes the planner shuffle
  the (folded, small) lookup once more.  The hash has few values, as it is shuffled with every fact;
* no broadcast hints: the planner broadcasts a side only when its measured size is small.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH = "__key_hash"
HASH_VALUES = 16
SALT = "__salt"

# Types whose equal values always hash alike.  Other key types join on the key alone.
HASHABLE = (T.StringType, T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType, T.DateType)


def _can_hash(facts: DataFrame, lookup: DataFrame, keys: list[str]) -> bool:
    kinds = [(facts.schema[k].dataType, lookup.schema[k].dataType) for k in keys]
    return all(left == right and isinstance(left, HASHABLE) for left, right in kinds)


def match(facts: DataFrame, lookup: DataFrame, on: str | list[str], how: str) -> DataFrame:
    """Join in which a hot key of the facts can be split, even against a lookup just grouped."""
    keys = [on] if isinstance(on, str) else list(on)
    if not _can_hash(facts, lookup, keys):
        return facts.join(lookup, keys, how)
    hashed = [df.withColumn(HASH, F.pmod(F.xxhash64(*keys), F.lit(HASH_VALUES)).cast("byte")) for df in (facts, lookup)]
    return hashed[0].join(hashed[1], [*keys, HASH], how).drop(HASH)


def attach(
    facts: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """Join facts to a lookup holding one row per key; hot keys are split by adaptive execution.

    ``salts`` spreads all keys without its help: facts take the number of the partition they sit
    in, and the lookup is repeated once per salt.
    """
    if not salts or salts < 2:
        return match(facts, lookup, on, how)
    keys = [on] if isinstance(on, str) else list(on)
    spread = facts.withColumn(SALT, F.pmod(F.spark_partition_id(), F.lit(salts)))
    copies = lookup.withColumn(SALT, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return spread.join(copies, [*keys, SALT], how).drop(SALT)


def rows_for(facts: DataFrame, key: str, wanted: str | Iterable[str] | DataFrame) -> DataFrame:
    """Rows whose key is wanted: one value, a short list, or a column of another table.

    Values become a pushed-down filter; a table becomes a semi join on its distinct keys.
    """
    if isinstance(wanted, DataFrame):
        return match(facts, wanted.select(key).distinct(), key, "left_semi")
    if isinstance(wanted, str):
        return facts.filter(F.col(key) == F.lit(wanted))
    return facts.filter(F.col(key).isin(list(wanted)))


def one_row_per_key(source: DataFrame, on: str | list[str], what: str = "source") -> DataFrame:
    """The source itself, failing at run time when a key has two rows."""
    keys = [on] if isinstance(on, str) else list(on)
    rest = [c for c in source.columns if c not in keys]
    row = F.any_value(F.struct(*rest)) if rest else F.lit(None)
    clash = F.raise_error(F.lit(f"{what} has more than one row for a key of {', '.join(keys)}"))
    grouped = source.groupBy(*keys).agg(
        F.when(F.count(F.lit(1)) > 1, clash).otherwise(row).alias("__row")
    )
    return grouped.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def newest_first(at: str, tie: str) -> list[Column]:
    """Newest first, unknown times last, ties by id so that results repeat."""
    return [F.col(at).desc_nulls_last(), F.col(tie).desc()]


def newest_rank(at: Column, tie: Column) -> Column:
    """Value whose maximum is the newest row; unknown times rank below all others."""
    return F.struct(at.isNotNull().alias("known"), at.alias("at"), tie.alias("tie"))
