"""Streamed tables that are folders of files, as large tables are, and single files."""

import pytest

from layover.registry import queries
from layover.session import new_path
from layover.sources.testviews import base_table, spark_view
from tests.conftest import SF_SMALL

STREAMS = {"chat_ingest_stream": ("conversations", "v_chat"), "misconnect_trigger_stream": ("orders", "v_flight_events")}


@pytest.mark.parametrize("name", sorted(STREAMS))
def test_a_folder_streams_as_its_file_does(spark, name):
    base, view = STREAMS[name]
    path = new_path(spark, "folders")
    base_table(spark, SF_SMALL, base).repartition(3).write.parquet(f"{path}/{base}.parquet")
    from_folder, from_file = (queries()[name](spark, d) for d in (path, SF_SMALL))
    assert from_folder.count() > 0
    assert from_folder.exceptAll(from_file).count() == from_file.exceptAll(from_folder).count() == 0
    assert spark_view(spark, path, view).count() >= from_folder.count()
