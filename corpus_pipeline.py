"""A training corpus from documents: toxic ones out, one of each near-copy, no repeated passage, mixed, packed.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; ``run`` writes each
result to the shared folder and reads it back as the next one's documents.  All stages but the last
return the columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layover.llm import minhash, mixing, packing, passages, toxicity
from layover.llm.registry import tokenizer_json
from layover.llm.scratch import keep, read, release


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models do not reject; labels come from the table beside."""
    return toxicity.accept(docs, read(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-copies.

    Rows without an id all stay.  Of rows that share an id one stays for each different text.
    """
    copies = minhash.classes(docs).filter("NOT kept").select("doc_id").distinct()
    rest = docs.join(copies, "doc_id", "left_anti").select(*docs.columns)
    ids = rest.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    again = ids.filter("n > 1").select("doc_id").checkpoint()
    if not again.limit(1).count():
        return rest
    once = rest.join(again, "doc_id", "left_anti").select(*docs.columns)
    several = rest.join(again, "doc_id", "left_semi").select(*docs.columns)
    return once.unionByName(several.dropDuplicates(["doc_id", "text"]))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand in an earlier place; ``n_chars`` follows the text.

    All other columns come back as they were, whatever their names.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    own = docs.select("doc_id", "text", *([F.struct(*rest).alias("row")] if rest else []))
    cut = passages.remove_repeats(own)
    columns = {c: F.col("row")[c] for c in rest} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in rest:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.size("spans") > 0, F.length("text").cast(kind)).otherwise(columns["n_chars"])
    return cut.select(*[columns[c].alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in their sequences."""
    return packing.pack(docs, tokenizer_json())


STAGES = [
    ("toxicity", without_toxic),
    ("near-copies", one_of_near_copies),
    ("repeated passages", without_repeats),
    ("mixing", mixed),
    ("packing", packed),
]

#: No stage but mixing can be said in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark)  # the next stage begins without the plans and shuffles of this one
    return docs
