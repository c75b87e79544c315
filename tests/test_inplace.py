"""Changes in place touch the parts of their keys and nothing else."""

import pytest
from pyspark.sql import functions as F

from layover.operators import inventory, mutate
from layover.session import new_path
from layover.sources import inplace
from layover.sources.testviews import spark_view
from tests.conftest import SF_SMALL

PARTS = 32


def files(spark, path):
    rows = spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()
    return {r["f"].split(f"{inplace.PART}=")[1] for r in rows}


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("per_part", [1, 3])
def test_a_hold_rewrites_the_parts_of_its_pnrs(spark, per_part):
    table = spark_view(spark, SF_SMALL, "v_inventory").withColumn("pnr", F.expr("CASE WHEN pnr LIKE '%9' THEN NULL ELSE pnr END"))
    path = new_path(spark, "inplace-test")
    inplace.write_laid_out(table, path, "pnr", PARTS, per_part)
    before = files(spark, path)
    pnrs = table.filter("pnr IS NOT NULL").select("pnr").distinct().orderBy("pnr").limit(5)
    flights = [r[0] for r in table.select("alternate_flight").distinct().collect()]
    hold = lambda rows: inventory.place_holds(rows, pnrs, flights)
    touched = inplace.change_keys(spark, path, table.schema, "pnr", pnrs, hold, PARTS, per_part)
    after = files(spark, path)
    assert 1 <= len(touched) <= 5
    part = lambda f: int(f.split("/")[0])
    assert {f for f in before if part(f) not in touched} == {f for f in after if part(f) not in touched}
    assert not {f for f in before if part(f) in touched} & after
    assert rows_of(inplace.read_laid_out(spark, path, table.schema)) == rows_of(hold(table))


def test_parts_may_become_empty_and_rows_may_not_move(spark):
    table = spark.createDataFrame([(k, f"v{k}") for k in range(100)] + [(None, "none")], "k long, v string")
    path = new_path(spark, "inplace-test")
    inplace.write_laid_out(table, path, "k", 8)
    keys = spark.createDataFrame([(3,)], "k long")
    part = inplace.part_of(F.col("k"), 8)
    number = keys.select(part).first()[0]
    with pytest.raises(ValueError):
        inplace.change_keys(spark, path, table.schema, "k", keys, lambda rows: rows.withColumn("k", F.col("k") + 1), 8)
    assert rows_of(inplace.read_laid_out(spark, path, table.schema)) == rows_of(table)
    assert inplace.change_keys(spark, path, table.schema, "k", keys, lambda rows: mutate.delete_where(rows, F.lit(True)), 8) == [number]
    assert rows_of(inplace.read_laid_out(spark, path, table.schema)) == rows_of(table.filter(part != number))
    assert inplace.change_keys(spark, path, table.schema, "k", keys.limit(0), lambda rows: rows, 8) == []
    nothing = spark.createDataFrame([(None,)], "k long")
    assert inplace.change_keys(spark, path, table.schema, "k", nothing, lambda rows: rows.withColumn("v", F.lit("x")), 8) == [-1]
