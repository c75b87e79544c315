"""Reading, creating and writing tables."""

import json

import pytest
from pyspark.sql import functions as F

from layover.session import new_path, shared_dir
from layover.sources import seeds, tables
from layover.sources.schemas import SCHEMAS
from layover.sources.testviews import spark_view
from tests.conftest import SF_SMALL


def test_create_seed_and_count(spark):
    folder = new_path(spark, "tables")
    names = tables.create_tables(spark, folder, prefix="layover_t_")
    try:
        for table in seeds.ROWS:
            tables.insert_into(seeds.seed(spark, table), f"layover_t_{table}")
        counts = tables.row_counts({t: spark.table(f"layover_t_{t}") for t in SCHEMAS}).collect()
        found = {r["table_name"]: r["rows"] for r in counts}
        assert found == {t: len(seeds.ROWS.get(t, [])) for t in SCHEMAS}
        for table in SCHEMAS:
            assert [(f.name, f.dataType) for f in spark.table(f"layover_t_{table}").schema] == [
                (f.name, f.dataType) for f in SCHEMAS[table]
            ]
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_written_tables_read_back_with_partitions(spark):
    versions = spark_view(spark, SF_SMALL, "v_order_versions")
    path = new_path(spark, "versions")
    back = tables.write_new(versions, path, ["added_snapshot"])
    assert back.count() == versions.count()
    from layover.operators.versions import read_snapshot
    from tests.test_scale import plan_of

    plan = plan_of(read_snapshot(spark.read.parquet(path), 3))
    assert "PartitionFilters: [isnotnull(added_snapshot" in plan and "<= 3" in plan
    with pytest.raises(Exception, match="already exists"):
        tables.write_new(versions, path)


def test_log_stored_by_day_skips_folders(spark):
    from layover.operators import audit as au
    from layover.sources.testviews import AS_OF
    from tests.test_scale import plan_of

    log = spark_view(spark, SF_SMALL, "v_exec")
    path = new_path(spark, "log")
    tables.append(au.with_day(log), path, [au.DAY])
    stored = spark.read.parquet(path)
    week = au.within(stored, "1w", AS_OF)
    assert "PartitionFilters: [(isnull(executed_day" in plan_of(week) and ">= 2024-01-24" in plan_of(week)
    ids = lambda df: sorted(r["exec_id"] for r in df.select("exec_id").collect())
    assert ids(week) == ids(au.within(log, "1w", AS_OF))
    late = au.since(stored, "2024-01-20T12:00:00Z")
    assert ids(late) == ids(au.since(log, "2024-01-20T12:00:00Z"))
    assert "PartitionFilters: [(isnull(executed_day" in plan_of(late)
    assert ids(au.since(stored, "no time")) == ids(log)
    same = lambda df: df.collect()[0].asDict()
    assert same(au.execution_stats(stored, "1d", AS_OF)) == same(au.execution_stats(log, "1d", AS_OF))


def test_settled_choices_leave_a_large_inventory_where_it_is(spark):
    from layover.operators import inventory
    from tests.test_scale import plan_of

    stock = spark_view(spark, SF_SMALL, "v_inventory")
    path = new_path(spark, "stock")
    stock.write.parquet(path)
    stock = spark.read.parquet(path)
    choices = stock.groupBy("pnr").agg(F.min("alternate_flight").alias("chosen_flight"))
    settled = tables.settle(choices)
    plan = plan_of(inventory.confirm_and_release(stock, settled))
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted(map(repr, inventory.confirm_and_release(stock, settled).collect())) == sorted(
        map(repr, inventory.confirm_and_release(stock, choices).collect())
    )


@pytest.mark.parametrize("format", ["parquet", "json", "orc"])
def test_profiles_from_any_source(spark, format):
    profiles = spark_view(spark, SF_SMALL, "v_profile")
    path = new_path(spark, "profiles")
    profiles.write.format(format).save(path)
    assert tables.read_profiles(spark, format, path=path).count() == profiles.count()
    assert tables.read_table(spark, path, "passenger_profiles", format).schema == SCHEMAS["passenger_profiles"]


def test_rows_as_json_keeps_null_fields(spark):
    rows = tables.rows_as_json(seeds.seed(spark, "unstructured_chat_signals")).collect()
    parsed = [json.loads(r["row"]) for r in rows]
    assert {p["signal_id"] for p in parsed} == {"SIG-01", "SIG-02", "SIG-03"}
    assert all("message_text" in p for p in parsed)
    assert [p["message_text"] for p in parsed if p["signal_id"] == "SIG-03"] == [None]


def test_files_and_layout(spark):
    path = new_path(spark, "files")
    spark.range(100).repartition(4).write.parquet(path)
    files = tables.data_files(spark.read.parquet(path)).collect()
    assert len(files) == 4 and sum(r["rows"] for r in files) == 100 and all(r["file_size"] > 0 for r in files)
    name = "layover_layout_test"
    try:
        tables.create_from(spark.range(3).toDF("id"), name, new_path(spark, "layout"))
        layout = {r["col_name"]: r["data_type"] for r in tables.layout(spark, name).collect()}
        assert layout["Provider"] == "parquet" and "layover-layout-" in layout["Location"]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        assert shared_dir(spark) == configured.rstrip("/")
    assert new_path(spark, "x") != new_path(spark, "x")
