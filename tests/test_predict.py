"""Chunking arithmetic and the pluggable Python model path."""

import re

import pandas as pd
from pyspark.sql import functions as F

from cohortlens.functions.concepts import CONCEPT_RULES
from cohortlens.operators import predict
from cohortlens.plans import catalog
from tests.conftest import SF001


def test_chunk_windows_overlap_by_stride(spark):
    words = " ".join(f"w{i}" for i in range(1000))
    df = spark.createDataFrame([("1", 1, None, None, words)],
                               "Report_Number string, EMPI long, Report_Date_Time timestamp_ntz, MRN_Type string, Report_Text string")
    rows = predict.chunk_notes(df, 400, stride=128).orderBy("chunk_idx").collect()
    # step 272: windows start at 0, 272, 544, 816 (the last one reaches the end)
    assert [r.chunk_text.split()[0] for r in rows] == ["w0", "w272", "w544", "w816"]
    assert all(len(r.chunk_text.split()) == 400 for r in rows[:-1]) and rows[-1].chunk_text.split()[-1] == "w999"


def test_batch_model_matches_rule_model(spark):
    notes = catalog.q_cohort_delivery(spark, SF001)
    runs = {"csection": ("c-section", "disch_summary_curr_delivery_V2")}
    rx = re.compile(CONCEPT_RULES["csection"], flags=re.IGNORECASE)

    def py_model(prompts: pd.Series, chunks: pd.Series) -> pd.Series:
        return chunks.map(lambda t: "Yes" if rx.search(t) else "No")

    a = predict.predict_runs(notes, runs, predict.RuleModel(rules={"csection": CONCEPT_RULES["csection"]}))
    b = predict.predict_runs(notes, runs, predict.BatchModel(py_model))
    key = ["Report_Number", "EMPI", "Report_Date_Time"]
    ja = a.select(*key, F.array_join("raw_preds", "|").alias("x"))
    jb = b.select(*key, F.array_join("raw_preds", "|").alias("x"))
    assert ja.count() == jb.count() > 0
    assert ja.exceptAll(jb).count() == 0
