"""Mixing sources to target weights, with DataFrame functions only.

Sources in code point order (null last) weigh 1, 2, 3, repeating, or as a table says, and share all
words of the corpus.  A target stops at ``max_rate`` times its source's size and the excess goes to
the others by weight.  A document is taken floor(rate) times, and once more if a hash of its id falls
below the rest, so reruns agree and no state is kept.

A null text has size 0, a null id hashes like the word "null", a null source is a source of its own.
Repeated rows are decided alike.  Sources without words have target 0 and give nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = 3
MAX_RATE = 3
SEED = 17
#: A table of sources with at most this many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, max_rate: int = MAX_RATE, weights: DataFrame | None = None) -> DataFrame:
    """Target words per source: (source, source_size, weight, target).

    ``sized`` has (source, size); one row per source remains before anything is ordered.  ``weights``
    may name (source, weight) with positive weights, one row per source; missing sources then weigh 1.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    if weights is None:
        weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % CYCLE + 1).cast("long"))
    else:
        given = weights.select(F.col("source").alias("__s"), F.col("weight").cast("long").alias("__w"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("__s")), "left").select(
            "source", "source_size", F.coalesce("__w", F.lit(1).cast("long")).alias("weight")
        )
    # Sources reach their cap in the order of cap per weight.  A source is capped if, with all before
    # it capped, its share of what is left is not below its cap.
    cap = F.col("source_size") * max_rate
    order = W.orderBy((cap.cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    left_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    judged = weighed.withColumn("capped", cap * left_weight <= left * F.col("weight"))
    free = F.col("capped") == F.lit(False)
    rest = F.sum("source_size").over(everything) - F.coalesce(
        F.sum(F.when(F.col("capped"), cap)).over(everything), F.lit(0)
    )
    rest_weight = F.sum(F.when(free, F.col("weight"))).over(everything)
    share = (F.col("weight") * rest).cast("double") / rest_weight.cast("double")
    return judged.select(
        "source", "source_size", "weight", F.when(F.col("capped"), cap.cast("double")).otherwise(share).alias("target")
    )


def coin(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest of the key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def copies(docs: DataFrame, max_rate: int = MAX_RATE, weights: DataFrame | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with (size, source_size, target, copies) beside its own columns; no row is lost.

    Columns of ``docs`` with those names are replaced.
    """
    made = ["size", "source_size", "target", "copies"]
    sized = docs.select(
        *[F.col(c) for c in docs.columns if c not in made], n_words(F.col("text")).alias("size")
    )
    targets = source_targets(sized.select("source", "size"), max_rate, weights).checkpoint()
    found = targets.select(F.col("source").alias("__source"), "source_size", "target")
    if targets.count() <= BROADCAST_SOURCES:
        found = F.broadcast(found)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    extra = (coin(F.col("doc_id"), seed) < F.col("__rate") - F.floor("__rate")).cast("int")
    return (
        sized.join(found, F.col("source").eqNullSafe(F.col("__source")), "left")
        .withColumn("__rate", rate)
        .withColumn("copies", (F.floor("__rate") + extra).cast("int"))
        .drop("__source", "__rate")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as it is taken.  All its columns come back as they were."""
    own = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    counted = copies(own, **options)
    again = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return counted.filter(F.col("copies") > 0).withColumn("again", again).select("row.*")
