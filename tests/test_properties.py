"""Brute-force checks on the small fixture: native span offsets and blood-loss extraction
against Python's ``re`` on the same texts, and pipeline invariants."""

import re

from pyspark.sql import functions as F

from cohortlens.functions.rules import LABEL_RULES, SPAN_RULES
from cohortlens.operators import cohort, extraction, spans
from cohortlens.plans import catalog
from cohortlens.sources import fixtures as fx
from tests.conftest import SF001


def _cohort(spark):
    return cohort.delivery_cohort(fx.notes(spark, SF001))


def test_single_group_offsets_equal_python_finditer(spark):
    notes = _cohort(spark).select("EMPI", "Report_Number", "Report_Date_Time", "Report_Text").cache()
    got = {(r.EMPI, r.Report_Number, str(r.Report_Date_Time), r.start, r.end, r.cui)
           for r in spans.single_group_spans(notes).collect()}
    exp = set()
    for r in notes.collect():
        for label, p, n in SPAN_RULES:
            if n != 1:
                continue
            for m in re.finditer(p, r.Report_Text, flags=re.IGNORECASE):
                s, e = m.span(1)
                exp.add((r.EMPI, r.Report_Number, str(r.Report_Date_Time), s, e, spans._cui(label)))
    assert got == exp and len(exp) > 0


def test_laceration_anatomy_spans(spark):
    """P31 worked by hand: the site nearest behind a tear that is not denied, or before one that no "no" follows."""
    texts = {1: "tear of the vaginal wall", 2: "no laceration, vaginal birth", 3: "perineal laceration repaired",
             4: "perineal tear , no bleeding", 5: "laceration, vaginal delivery", 6: "a tear\nvaginal", 7: None}
    notes = spark.createDataFrame([(k, "r", None, t) for k, t in texts.items()],
                                  "EMPI long, Report_Number string, Report_Date_Time timestamp_ntz, Report_Text string")
    rules = [r for r in spans.multi_rules() if r[0] == catalog.ANATOMY]
    got = {(r.EMPI, texts[r.EMPI][r.start:r.end], r.start) for r in spans.multi_group_spans(notes, rules).collect()}
    assert got == {(1, "vaginal", 12), (3, "perineal", 0)}


def test_blood_loss_groups_equal_python_findall(spark):
    notes = _cohort(spark)
    got = {(r.EMPI, r.Report_Number, r.Report_Date_Time): list(r.predictions)
           for r in extraction.ebl_regex_predictions(notes).collect()}
    for r in notes.collect():
        found = re.findall(LABEL_RULES["estimated blood loss"], r.Report_Text, flags=re.IGNORECASE)
        exp = [str(i) for s in found for i in s if i != ""]
        assert got[(r.EMPI, r.Report_Number, r.Report_Date_Time)] == exp


def test_funnel_is_monotone(spark):
    rows = catalog.QUERIES["cohort_funnel"](spark, SF001).orderBy("step_idx").collect()
    for a, b in zip(rows, rows[1:]):
        assert b.n_rows <= a.n_rows and b.n_patients <= a.n_patients


def test_train_and_test_patients_disjoint(spark):
    s = catalog.QUERIES["split_binary"](spark, SF001)
    both = (s.groupBy("label", "EMPI").agg(F.countDistinct("split").alias("k")).filter("k > 1").count())
    assert both == 0
    per_label = s.filter("split = 'train'").groupBy("label").agg(F.countDistinct("EMPI").alias("n")).collect()
    assert all(r.n <= 50 for r in per_label)


def test_composite_not_below_inputs(spark):
    c = catalog.QUERIES["composite_accreta"](spark, SF001)
    bad = c.filter((F.col("predictions") < F.col("predictions_accreta"))
                   | (F.col("predictions") < F.coalesce("predictions_percreta", F.lit(0)))).count()
    assert bad == 0


def test_annotation_join_keeps_annotation_count(spark):
    from cohortlens.operators import labels
    ann = catalog._annotations_delivery(spark, SF001)
    _, _, joined = labels.prep_data(catalog._cohort(spark, SF001), ann)
    assert joined.count() == ann.count()


def test_funnel_counts_null_keys_as_values(spark):
    cols = fx.NOTE_FIELDS
    base = dict.fromkeys(cols) | {"Report_Type": "DS", "Report_Status": "F", "Report_Text": "delivery"}
    schema = fx.notes(spark, SF001).schema
    rows = [tuple((base | x)[c] for c in cols) for x in ({"EMPI": 1, "Report_Number": "a"}, {"EMPI": None})]
    r = cohort.funnel_stats(spark.createDataFrame(rows, schema)).filter("step_idx = 0").first()
    assert (r.n_rows, r.n_patients, r.n_report_numbers, r.n_notes) == (2, 2, 2, 2)


def test_dedup_limits_before_the_shuffle_and_filters_first(spark):
    plan = cohort.delivery_cohort(fx.notes(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert plan.index("WindowGroupLimit") < plan.rindex("Filter")


def test_no_text_is_lost_by_deduplication(spark):
    notes = fx.notes(spark, "/root/testdata/sf0.01")
    kept = cohort.candidate_notes(notes)
    assert cohort.dedup_on_key(kept).count() == kept.select("Report_Text", *cohort.NOTE_KEY).distinct().count()


def test_join_check_raises_on_shared_keys(spark):
    import pytest
    from cohortlens.operators import labels
    ann = catalog._annotations_delivery(spark, SF001)
    labels.join_keeps_count(ann, labels.prep_data(catalog._cohort(spark, SF001), ann)[2])
    with pytest.raises(ValueError):
        labels.join_keeps_count(ann, ann.union(ann))


def test_a_note_with_many_matches_is_linear(spark):
    import time
    df = spark.createDataFrame([(1, "x", None, "uterine atony bakri " * 4000)],
                               "EMPI long, Report_Number string, Report_Date_Time timestamp_ntz, Report_Text string")
    spans.single_group_spans(df.limit(0)).count()
    t0 = time.time()
    assert spans.single_group_spans(df).count() >= 8000
    assert time.time() - t0 < 30


def test_stage_key_follows_the_input_files(spark, tmp_path):
    from cohortlens.sources import stage
    p = str(tmp_path / "in")
    spark.range(3).write.parquet(p)
    before = stage.input_state(spark, [p])
    assert before == stage.input_state(spark, [p])
    spark.range(5).write.mode("append").parquet(p)
    assert before != stage.input_state(spark, [p])


def test_note_files_and_model_factory(spark, tmp_path):
    from cohortlens.operators import predict
    from cohortlens.sources import readers
    df = spark.createDataFrame([("a_1.txt", "one\nline"), ("b_2.txt", None)], "file_name string, Report_Text string")
    readers.export_note_files(df, str(tmp_path / "notes"))
    assert {(f.name, f.read_text()) for f in (tmp_path / "notes").iterdir()} == {("a_1.txt", "one\nline"), ("b_2.txt", "")}

    def load():
        return lambda prompts, chunks: ["Yes" if "line" in c else f"{len(chunks)}" for c in chunks]

    model = predict.BatchModel(load=load, batch_size=1)
    got = df.coalesce(1).na.fill("").select("file_name", model.answer(F.lit("r"), F.lit("p"), F.col("Report_Text")).alias("a"))
    assert {(r.file_name, r.a) for r in got.collect()} == {("a_1.txt", "Yes"), ("b_2.txt", "1")}


def test_no_local_checkpoint_folder_off_a_local_master():
    import pytest
    from types import SimpleNamespace
    from cohortlens.session import ensure_checkpoint_dir
    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://x:7077"))
    with pytest.raises(ValueError):
        ensure_checkpoint_dir(far)
