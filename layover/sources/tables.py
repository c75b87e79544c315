"""Reading, creating and writing the tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layover.session import new_path
from layover.sources.schemas import SCHEMAS


# --- reading -------------------------------------------------------------------------------


def read_table(spark: SparkSession, path: str, table: str, format: str = "parquet") -> DataFrame:
    """A declared table from files, with its declared schema and no inference."""
    return spark.read.format(format).schema(SCHEMAS[table]).load(path)


def read_profiles(spark: SparkSession, format: str = "parquet", **options) -> DataFrame:
    """Customer profiles from any Spark source; ``sources/profiles.py`` has a folder and a database in ranges."""
    return spark.read.format(format).options(**options).load()


# --- creating ------------------------------------------------------------------------------


def create_table(
    spark: SparkSession, table: str, path: str | None = None, name: str | None = None
) -> str:
    """Drop and create an empty declared table; with a path its data lives there."""
    name = name or table
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, path=path, source="parquet", schema=SCHEMAS[table])
    return name


def create_tables(spark: SparkSession, folder: str | None = None, prefix: str = "") -> list[str]:
    """Drop and create every declared table."""
    return [
        create_table(spark, t, f"{folder}/{prefix}{t}" if folder else None, f"{prefix}{t}")
        for t in SCHEMAS
    ]


def create_from(df: DataFrame, name: str, path: str) -> DataFrame:
    """Create a table from a query, stored under a path, and read it back."""
    df.writeTo(name).using("parquet").option("path", path).create()
    return df.sparkSession.table(name)


# --- writing -------------------------------------------------------------------------------


def write_new(
    df: DataFrame, path: str, partition_by: list[str] | None = None, compression: str | None = None
) -> DataFrame:
    """Write to a path that must not exist yet, and read it back."""
    writer = df.write.mode("errorifexists")
    if compression:
        writer = writer.option("compression", compression)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write a result to the shared folder once and go on from there.

    Worth it for a result used several times, or for a lookup about to meet a large table: the
    planner then knows its true size, and if that is small the large table is not shuffled.
    """
    return write_new(df, new_path(df.sparkSession, label))


def write_bucketed(df: DataFrame, name: str, path: str, key: str, buckets: int) -> DataFrame:
    """Catalog table stored in buckets of a key: joins and counts on the key need no shuffle.

    Use the same number of buckets for tables that meet often, such as inventory and choices.
    """
    # One shuffle up front, so a bucket is one file instead of one per writing task.
    spread = df.repartition(buckets, key)
    spread.write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows to a path."""
    writer = df.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def insert_into(df: DataFrame, name: str) -> None:
    """Append a query's rows to a catalog table, columns matched by name."""
    columns = df.sparkSession.table(name).columns
    df.select(*columns).write.insertInto(name)


# --- reports -------------------------------------------------------------------------------


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    return _union(
        [
            df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
            for name, df in tables.items()
        ]
    )


def schema_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Declared columns per table with the type found.  Reads schemas only, no rows."""
    rows = [
        (name, i, f.name, f.dataType.simpleString(), dict(df.dtypes).get(f.name) == f.dataType.simpleString())
        for name, df in tables.items()
        for i, f in enumerate(SCHEMAS[name].fields, start=1)
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(
        rows, "table_name string, ordinal int, column_name string, declared_type string, as_declared boolean"
    )


def fill_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Filled values per declared column: one scan of every table."""

    def one(name: str, df: DataFrame) -> DataFrame:
        columns = [f.name for f in SCHEMAS[name].fields]
        filled = df.agg(*[F.count(c).alias(c) for c in columns])
        return filled.unpivot([], columns, "column_name", "filled_values").withColumn("table_name", F.lit(name))

    return _union([one(name, df) for name, df in tables.items()])


def data_files(df: DataFrame) -> DataFrame:
    """Files behind a table with their size and row count."""
    return df.groupBy(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_size").alias("file_size"),
    ).agg(F.count(F.lit(1)).alias("rows"))


def layout(spark: SparkSession, name: str) -> DataFrame:
    """Location, provider and properties of a catalog table."""
    return spark.sql(f"DESCRIBE EXTENDED {name}").filter(
        F.col("col_name").isin("Location", "Provider", "Table Properties", "Type")
    )


JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def rows_as_json(df: DataFrame) -> DataFrame:
    """Each row as JSON text, NULL fields and microseconds included; write with ``.write.text``."""
    return df.select(F.to_json(F.struct("*"), JSON_OPTIONS).alias("row"))
