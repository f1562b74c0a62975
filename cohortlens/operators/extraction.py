"""Blood-loss extraction against gold spans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions import normalize
from cohortlens.functions.regex import java_regex
from cohortlens.functions.rules import EBL_GROUPS, LABEL_RULES
from cohortlens.operators import metrics

BLOOD_LOSS = "estimated blood loss"
KEY = ["Report_Number", "EMPI", "Report_Date_Time"]


def ebl_regex_predictions(notes: DataFrame) -> DataFrame:
    """Every blood-loss rule match, non-empty groups in match order, then K1/K3."""
    pattern = java_regex(LABEL_RULES[BLOOD_LOSS], ignore_case=True)
    return notes.withColumn("predictions", normalize.matched_groups(F.col("Report_Text"), pattern, EBL_GROUPS)).withColumn(
        "clean_predictions", normalize.clean_predictions(BLOOD_LOSS, F.col("predictions")))


def clean_gold(gold: DataFrame) -> DataFrame:
    """``clean_spans`` of the gold ``spans``, cleaned as annotations."""
    return gold.withColumn("clean_spans", normalize.clean_predictions(BLOOD_LOSS, F.col("spans"), clean_type="annotation"))


def regex_against_gold(gold: DataFrame, notes: DataFrame) -> DataFrame:
    """Gold spans (raw and cleaned) and the rule's predictions of each note of ``gold``."""
    preds = ebl_regex_predictions(notes).select(*KEY, "predictions", "clean_predictions")
    return clean_gold(gold).join(preds, KEY, "left")


def answers_against_gold(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """M5 extraction: gold spans, cleaned and de-duplicated as the evaluate path does, and a run's answers; a note without
    an answer has no predictions."""
    spans = clean_gold(gold).withColumn("spans", metrics.distinct_sorted("clean_spans")).drop("clean_spans")
    return spans.join(preds.drop("MRN_Type"), KEY, "left").withColumn(
        "clean_predictions", F.coalesce("clean_predictions", F.array().cast("array<string>")))


def with_clean_span(annotations: DataFrame) -> DataFrame:
    """``clean_span`` (K3 in annotation mode for blood loss, else the span)."""
    return annotations.withColumn("clean_span", F.when(
        F.col("label_type") == BLOOD_LOSS, normalize.clean_str(F.col("span"), BLOOD_LOSS, "annotation")).otherwise(F.col("span")))
