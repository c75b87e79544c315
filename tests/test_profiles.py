"""Profiles from outside Spark: what the reader opens, and that nothing is lost."""

import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualNullSafe, EqualTo, In, IsNotNull, StringStartsWith

from layover.session import new_path
from layover.sources import profiles as pf
from layover.sources.schemas import SCHEMAS

SCHEMA = SCHEMAS["passenger_profiles"]
PARTS = 7


def profile(key, name="A B", spend=1.5):
    return (key, name, "GOLD", spend, 3, "ECONOMY", 0.25)


@pytest.fixture(scope="module")
def folder(spark):
    rows = [profile(f"CUST-{i}", name=f'Nam"e\n{i} é') for i in range(300)]
    rows += [profile("CUST-7")] * 3 + [profile(None, None, None)] * 2 + [profile("")]
    df = spark.createDataFrame(rows, SCHEMA)
    path = new_path(spark, "profiles")
    pf.write_profiles(df, path, PARTS, files_per_part=2)
    return df, path


def opened(df):
    return {r[0] for r in df.select(F.spark_partition_id()).distinct().collect()}


def test_all_rows_come_back(spark, folder):
    df, path = folder
    found = pf.read_folder(spark, path, PARTS)
    assert found.schema == SCHEMA
    assert sorted(map(str, found.collect())) == sorted(map(str, df.collect()))
    assert sorted(map(str, pf.read_folder(spark, "file:" + path.removeprefix("file:"), PARTS).collect())) == sorted(map(str, df.collect()))


def test_a_filter_on_the_customer_reaches_the_reader(spark, folder):
    df, path = folder
    asked = pf.read_folder(spark, path, PARTS).filter(F.col("customer_id") == "CUST-7")
    plan = asked._jdf.queryExecution().explainString(asked.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    print(plan)
    assert "CUST-7" in plan.split("PushedFilters")[1].splitlines()[0]
    # Spark is left with no condition on the customer but that there is one.
    assert not [line for line in plan.splitlines() if line.startswith("Condition") and "CUST-7" in line]
    assert asked.count() == 4
    assert asked.rdd.getNumPartitions() <= 2 < pf.read_folder(spark, path, PARTS).rdd.getNumPartitions()


@pytest.mark.parametrize("condition", [
    "customer_id IN ('CUST-1', 'CUST-299', 'nobody')", "customer_id = 'nobody'", "customer_id <=> 'CUST-3'", "customer_id IS NULL",
    "customer_id <=> NULL", "customer_id = ''", "customer_id = 'CUST-1' AND customer_id = 'CUST-2'", "customer_id LIKE 'CUST-1%'",
    "customer_id = 'CUST-7' AND lifetime_spend_usd > 1", "customer_id = 'CUST-7' OR lifetime_spend_usd IS NULL",
    "customer_id IN ('CUST-1', NULL)", "customer_id > 'CUST-5'", "NOT customer_id = 'CUST-1'", "full_name = 'A B'",
])
def test_filters_give_what_spark_gives(spark, folder, condition):
    df, path = folder
    found = pf.read_folder(spark, path, PARTS).filter(condition).collect()
    assert sorted(map(str, found)) == sorted(map(str, df.filter(condition).collect()))


def test_only_parts_asked_for_are_listed(folder):
    _, path = folder
    reader = pf.ProfileReader(SCHEMA, path, PARTS)
    kept = [IsNotNull(("customer_id",)), StringStartsWith(("customer_id",), "C"), EqualTo(("full_name",), "x")]
    taken = [In(("customer_id",), ("CUST-1", "CUST-2")), EqualNullSafe(("customer_id",), "CUST-2")]
    assert list(reader.pushFilters([*kept, *taken])) == kept
    assert reader.wanted == {"CUST-2"}
    number = zlib.crc32(b"CUST-2") % PARTS
    assert reader.partitions() and all(f"/part={number}/" in p.path for p in reader.partitions())


def test_fields_missing_unknown_and_empty_folders(spark, tmp_path):
    (tmp_path / "part=0").mkdir()
    (tmp_path / "part=0" / "a.json").write_text('{"customer_id": "x", "extra": {"a": 1}, "lifetime_flights": 2}\n{"full_name": "y"}\n')
    (tmp_path / "part=0" / "_SUCCESS").write_text("no data")
    (tmp_path / "part=0" / "empty.json").write_text("")
    rows = pf.read_folder(spark, str(tmp_path), 1).collect()
    assert sorted((str(r.customer_id), str(r.full_name), r.lifetime_flights) for r in rows) == [("None", "y", None), ("x", "None", 2)]
    empty = new_path(spark, "profiles")
    pf.write_profiles(spark.createDataFrame([], SCHEMA), empty, PARTS)
    assert pf.read_folder(spark, empty, PARTS).count() == 0


def test_ranges_of_a_database_hold_every_row_once(spark, folder):
    df, _ = folder
    odd = df.unionByName(df.limit(1).withColumn("customer_id", F.lit("it's é")))
    bounds = pf.key_bounds(odd, 5)
    assert len(bounds) == 4
    for cuts in (bounds, bounds[:1], [], ["it's é"]):
        met = sum((F.expr(p).cast("int") for p in map(lambda p: f"coalesce({p}, false)", pf.range_predicates(cuts))), F.lit(0))
        assert odd.filter(met != 1).count() == 0
    sizes = [odd.filter(p).count() for p in pf.range_predicates(bounds)]
    assert max(sizes) < 2 * odd.count() / 5
    assert pf.key_bounds(odd.limit(0), 5) == []
