"""Large tables go into parts step by step, and no step's shuffle or next state outlives it."""

import glob
import os
from collections import Counter

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from layover.operators import mutate
from layover.session import new_path, shared_dir
from layover.sources import inplace


@pytest.fixture
def table(spark):
    rows = [(k if k % 11 else None, f"v{k}", k % 3) for k in range(3000)]
    return spark.createDataFrame(rows, "k long, v string, n int").repartition(3)


def rows_of(df):
    return sorted(map(str, df.collect()))


def local(spark, path):
    return path.removeprefix("file:")


def files_by_part(spark, path):
    names = glob.glob(f"{local(spark, path)}/{inplace.PART}=*/*.parquet")
    return Counter(int(os.path.dirname(n).rsplit("=")[1]) for n in names)


def on_disk(spark, label):
    return sorted(os.path.basename(p) for p in glob.glob(f"{local(spark, shared_dir(spark))}/layover-{label}-*"))


@pytest.mark.parametrize("parts,per_part,again", [(1, 1, True), (7, 1, False), (32, 3, True), (100, 2, False)])
def test_steps_give_the_same_parts(spark, table, monkeypatch, parts, per_part, again):
    keys = spark.createDataFrame([(k,) for k in range(0, 3000, 7)] + [(None,)], "k long")
    change = lambda rows: mutate.update_where(rows, "n = 1 OR k IS NULL", {"v": F.lit("changed")})
    found = []
    for limit in (0, 1 << 40):
        monkeypatch.setattr(inplace, "GROUP_BYTES", limit)
        path = new_path(spark, "inplace-steps")
        inplace.write_laid_out(table, path, "k", parts, per_part, read_again=again)
        assert rows_of(inplace.read_laid_out(spark, path, table.schema)) == rows_of(table)
        assert max(files_by_part(spark, path).values()) <= per_part
        touched = inplace.change_keys(spark, path, table.schema, "k", keys, change, parts, per_part)
        assert max(files_by_part(spark, path).values()) <= per_part
        part = inplace.part_of(F.col("k"), parts)
        state = inplace.read_laid_out(spark, path, table.schema)
        want = change(table.filter(part.isin(touched))).unionByName(table.filter(~part.isin(touched)))
        assert rows_of(state) == rows_of(want)
        placed = spark.read.parquet(path).filter(inplace.PART + " <> -1 OR k IS NOT NULL")
        assert placed.filter(F.col(inplace.PART) != part).isEmpty()
        found.append((touched, sorted(files_by_part(spark, path))))
    assert found[0] == found[1]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_what_is_set_aside_goes_step_by_step(spark, table, monkeypatch):
    monkeypatch.setattr(inplace, "GROUP_BYTES", 0)
    path, left, written = new_path(spark, "inplace-steps"), [], []
    held = {label: on_disk(spark, label) for label in ("to-lay-out", "changed-parts")}

    def new(label):
        found = [p for p in on_disk(spark, label) if p not in held[label]]
        return [g for p in found for g in glob.glob(f"{local(spark, shared_dir(spark))}/{p}/{inplace.GROUP}=*")]

    def let_go(session):
        left.append(len(new("to-lay-out") + new("changed-parts")))
        written.append(sum(files_by_part(spark, f"{path}-in").values()))

    monkeypatch.setattr(inplace, "_let_go", let_go)
    inplace.write_laid_out(table, path, "k", 32)
    assert left == list(range(inplace.GROUPS - 1, -1, -1))
    assert written == sorted(set(written)) and written[-1] == 33
    left.clear()
    keys = table.select("k").distinct()
    inplace.change_keys(spark, path, table.schema, "k", keys, lambda rows: rows.withColumn("v", F.lit("x")), 32)
    assert left == list(range(inplace.GROUPS - 1, -1, -1))
    assert not new("to-lay-out") + new("changed-parts")
    assert {label: on_disk(spark, label) for label in held} == held
    assert inplace.read_laid_out(spark, path, table.schema).filter("v <> 'x'").isEmpty()


def test_shuffles_of_earlier_steps_are_let_go(spark, table, monkeypatch):
    """Before, all rows stood in one shuffle beside the table."""
    monkeypatch.setattr(inplace, "GROUP_BYTES", 0)
    seen, plain = [], inplace._dealt
    monkeypatch.setattr(inplace, "_dealt", lambda rows, step, *rest: seen.append((step, plain(rows, step, *rest).count())) or plain(rows, step, *rest))
    path = new_path(spark, "inplace-steps")
    inplace.write_laid_out(table, path, "k", 64, read_again=True)
    assert [s for s, _ in seen] == [[0, 1], [2, 3], [4, 5], [6, 7]]
    assert sum(n for _, n in seen) == 3000 and max(n for _, n in seen) < 1500


def test_a_table_appears_when_it_is_whole(spark, table):
    path = new_path(spark, "inplace-steps")
    table.limit(10).write.parquet(f"{path}-in/{inplace.PART}=3")  # of a job that died
    inplace.write_laid_out(table, path, "k", 8)
    assert rows_of(inplace.read_laid_out(spark, path, table.schema)) == rows_of(table)
    with pytest.raises(AnalysisException):
        inplace.write_laid_out(table, path, "k", 8)
    empty = new_path(spark, "inplace-steps")
    inplace.write_laid_out(table.limit(0), empty, "k", 8)
    assert inplace.read_laid_out(spark, empty, table.schema).isEmpty()
