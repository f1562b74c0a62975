"""The stateless note screen runs unchanged as an incremental (availableNow) stream."""

import uuid

from cohortlens import streaming
from cohortlens.sources import fixtures as fx
from tests.conftest import SF001


def test_incremental_screen_matches_batch(spark, tmp_path):
    notes = fx.notes(spark, SF001)
    src = str(tmp_path / "in")
    notes.write.parquet(src)
    sink = str(tmp_path / "out")
    streaming.run_incremental(spark, src, notes.schema, sink, name=f"t{uuid.uuid4().hex}")
    got = spark.read.parquet(sink).count()
    assert got == streaming.screened_notes(notes).count() > 0
