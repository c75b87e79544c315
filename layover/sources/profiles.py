"""Customer profiles kept outside Spark: a folder of JSON lines, or a database.

``write_profiles`` lays the folder out by the hash of the customer; the data source ``profile_folder`` reads it.
A filter on the customer reaches the reader: only the parts of the customers asked for are listed and opened, and
other customers' rows do not leave the reader.  Without a filter every file is a task of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyarrow import json as arrow_json
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.pandas.types import to_arrow_schema

from layover.sources.schemas import SCHEMAS

KEY = "customer_id"
PARTS = 64
#: Rows of a file, and with it of a reading task.
FILE_ROWS = 1_000_000
#: Without it Spark does not offer filters to a reader written in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


# --- a folder ------------------------------------------------------------------------------


def part_of(key: Column, parts: int) -> Column:
    """The part of a customer: unsigned crc32 of the id; rows without an id lie in part -1."""
    return F.coalesce(F.pmod(F.crc32(key.cast("binary")), F.lit(parts)), F.lit(-1))


def write_profiles(
    profiles: DataFrame, path: str, parts: int = PARTS, files_per_part: int = 1, file_rows: int = FILE_ROWS
) -> None:
    """Write profiles as JSON lines, laid out by customer; the path must not exist yet.

    More files per part spread a customer with a large share of the rows over as many tasks.
    """
    spread = F.pmod(F.xxhash64(*profiles.columns), F.lit(files_per_part))
    placed = profiles.withColumn("part", part_of(F.col(KEY), parts)).repartition(parts, "part", spread)
    writer = placed.write.partitionBy("part").option("maxRecordsPerFile", file_rows)
    writer.option("ignoreNullFields", "false").json(path)


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder; ``file:/x`` is accepted as Spark writes it."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)


@dataclass
class ProfileFile(InputPartition):
    path: str


class ProfileReader(DataSourceReader):
    """Reads the files of a folder; ``wanted`` are the customers asked for, None for all."""

    def __init__(self, schema: T.StructType, path: str, parts: int):
        self.schema, self.path, self.parts = schema, path, parts
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality and IN on the customer, and that there is one; the rest stays with Spark."""
        for found in filters:
            values = self.values(found)
            if values is None:
                yield found
            else:
                self.wanted = values if self.wanted is None else self.wanted & values

    @staticmethod
    def values(found: Filter) -> set[str] | None:
        """The customers a filter allows, None if it is not for the reader."""
        if getattr(found, "attribute", None) != (KEY,):
            return None
        if isinstance(found, EqualTo) or (isinstance(found, EqualNullSafe) and found.value is not None):
            return set() if found.value is None else {found.value}
        return {v for v in found.value if v is not None} if isinstance(found, In) else None

    def partitions(self) -> list[InputPartition]:
        system, folder = open_folder(self.path)
        if self.wanted is None:
            listed = [fs.FileSelector(folder, recursive=True)]
        else:
            numbers = sorted({zlib.crc32(v.encode()) % self.parts for v in self.wanted})
            listed = [fs.FileSelector(f"{folder}/part={n}", allow_not_found=True) for n in numbers]
        infos = [info for selector in listed for info in system.get_file_info(selector)]
        # Names that begin with a dot or an underscore are not data.
        files = [i.path for i in infos if i.is_file and i.size and not i.base_name.startswith((".", "_"))]
        return [ProfileFile(p) for p in sorted(files)]

    def read(self, partition: ProfileFile) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without files still has one partition, of nothing
            return
        system, _ = open_folder(self.path)
        schema = to_arrow_schema(self.schema)
        options = arrow_json.ParseOptions(explicit_schema=schema, unexpected_field_behavior="ignore")
        with system.open_input_stream(partition.path, compression="detect") as stream:
            for batch in arrow_json.open_json(stream, parse_options=options):
                batch = batch.select(schema.names)
                if self.wanted is not None:
                    batch = batch.filter(pc.is_in(batch.column(KEY), pa.array(sorted(self.wanted), pa.string())))
                yield batch


class ProfileFolder(DataSource):
    """``spark.read.format("profile_folder").load(path)``; option ``parts`` as the folder was written."""

    @classmethod
    def name(cls) -> str:
        return "profile_folder"

    def schema(self) -> T.StructType:
        return SCHEMAS["passenger_profiles"]

    def reader(self, schema: T.StructType) -> ProfileReader:
        return ProfileReader(schema, self.options["path"], int(self.options.get("parts", PARTS)))


def read_folder(spark: SparkSession, path: str, parts: int = PARTS, schema: T.StructType | None = None) -> DataFrame:
    """Profiles of a folder; a filter on the customer opens the files of that customer's part only.

    Null ids are read when no filter asks for customers.  Fields a line lacks are null; others are left out.
    An empty or missing part has no rows.
    """
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ProfileFolder)
    reader = spark.read.format("profile_folder").option("parts", parts)
    return (reader.schema(schema) if schema else reader).load(path)


# --- a database ----------------------------------------------------------------------------


def key_bounds(ids: DataFrame, parts: int, key: str = KEY, sampled: int = 100_000) -> list[str]:
    """At most ``parts - 1`` customers that cut all customers into ranges of similar size.

    Taken from a sample of ``sampled`` different ids, drawn by their hash, so the driver sees no more than that.
    """
    drawn = ids.filter(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key)).limit(sampled)
    # Utf-8 bytes, the order in which Spark compares strings.
    found = sorted((r[0] for r in drawn.collect()), key=lambda v: v.encode())
    return sorted({found[len(found) * i // parts] for i in range(1, parts)} if found else set(), key=lambda v: v.encode())


def range_predicates(bounds: list[str], key: str = KEY) -> list[str]:
    """Conditions that cut a table at the bounds: each row, also one without a key, meets exactly one."""
    quoted = ["'" + b.replace("'", "''") + "'" for b in bounds]
    if not quoted:
        return ["1 = 1"]
    middle = [f"{key} >= {low} AND {key} < {high}" for low, high in zip(quoted, quoted[1:])]
    return [f"{key} < {quoted[0]} OR {key} IS NULL", *middle, f"{key} >= {quoted[-1]}"]


def read_database(spark: SparkSession, url: str, table: str, bounds: list[str], key: str = KEY, **properties: str) -> DataFrame:
    """Profiles of a database table, a connection per range of customers; filters are pushed by Spark itself.

    The bounds should be compared by the database byte by byte, as any other collation moves rows between ranges
    (none is lost or read twice) and makes them uneven.
    """
    return spark.read.jdbc(url, table, predicates=range_predicates(bounds, key), properties=properties)
