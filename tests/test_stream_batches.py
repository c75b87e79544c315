"""What the pairs of two streams write and read on their way."""

from layover import session
from layover.registry import queries
from tests.conftest import SF_SMALL


def test_pairs_carry_only_their_columns_in_many_files(spark):
    queries()["staged_then_resolved_stream"](spark, SF_SMALL)
    path = [p for p in session._PATHS if "-pairs-" in p][-1] + "-in"
    files = spark.read.parquet(path)
    assert sorted(files.columns) == ["customer_id", "exec_id", "executed_at", "scenario", "status"]
    assert 3 < len(files.inputFiles()) <= 48
