"""Incremental runs of the per-note operators.

The reference has no streaming. The per-note operators here are stateless column
expressions, so the same code runs on a streaming DataFrame. This module only runs the note
filters and rule predictions over note files as they arrive (``availableNow`` trigger,
checkpointed in the shared checkpoint folder). Key de-duplication and everything downstream
stay batch jobs over the resulting table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import cohort
from cohortlens.operators.rules import rule_predictions_wide
from cohortlens.session import ensure_checkpoint_dir


def screened_notes(notes: DataFrame) -> DataFrame:
    """Stateless part of the cohort funnel (F3-F7, F8, F9, F10) plus wide rule predictions."""
    kept = notes.filter(cohort.before_cutoff() & cohort.not_ed_note() & cohort.has_text()
                        & cohort.delivery_related() & cohort.final_status()
                        & cohort.not_discharge_instructions() & cohort.not_discharge_orders())
    kept = kept.withColumn("Report_Number", cohort.sanitize_report_number())
    return rule_predictions_wide(kept, key=kept.columns)


def run_incremental(spark: SparkSession, source_dir: str, schema, sink_dir: str, name: str = "screened_notes"):
    """Process every note Parquet file that arrived since the last run, then stop."""
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}"
    stream = spark.readStream.schema(schema).parquet(source_dir)
    out = screened_notes(stream).withColumn("_processed_at", F.current_timestamp())
    q = (out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
