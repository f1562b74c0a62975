"""Query catalogue: name -> Spark job over a test-data folder, and its DuckDB oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import annotations, asof, cohort, extraction, labels, metrics, phenotype, predict, proximity, rules, sampling, spans
from cohortlens.functions import normalize
from cohortlens.functions.concepts import COMPOSITE_GOLD, CONCEPT_RULES, CONCEPT_RUNS
from cohortlens.functions.prompts import get_prompt
from cohortlens.functions.rules import LABEL_RULES
from cohortlens.functions.regex import java_regex
from cohortlens.plans import oracle, oracle_answers
from cohortlens.session import ensure_checkpoint_dir
from cohortlens.sources import fixtures as fx
from cohortlens.sources import readers
from cohortlens.sources.stage import stage_table

Query = Callable[[SparkSession, str], DataFrame]


def q_cohort_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.delivery_cohort(fx.notes(spark, sf_dir))


def q_cohort_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.funnel_stats(fx.notes(spark, sf_dir))


def _cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery cohort as a stage table (the reference's filtered cohort file)."""
    return stage_table(spark, "delivery_cohort", sf_dir, lambda: cohort.delivery_cohort(fx.notes(spark, sf_dir)),
                       inputs=[f"{sf_dir}/documents.parquet"])


def _families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proximity.code_families(proximity.diagnoses_before(fx.diagnoses(spark, sf_dir)))


def q_dx_families(spark, sf_dir):
    return _families(spark, sf_dir)


def q_dx_proximity_butwick(spark, sf_dir):
    return proximity.proximity_join(_cohort(spark, sf_dir), _families(spark, sf_dir), definition="butwick")


def q_dx_proximity_zheutlin(spark, sf_dir):
    return proximity.proximity_join(_cohort(spark, sf_dir), _families(spark, sf_dir), definition="zheutlin")


def q_dx_nearest(spark, sf_dir):
    return asof.nearest(_cohort(spark, sf_dir), _families(spark, sf_dir))


def q_dx_nearest_window(spark, sf_dir):
    return proximity.proximity_join(_cohort(spark, sf_dir), _families(spark, sf_dir), definition=None,
                                    one_per_note=True)


def q_cohort_linked(spark, sf_dir):
    """Families -> ±14 d join -> zheutlin codes -> inpatient -> same instant, in seeded order."""
    pairs = proximity.proximity_join(_cohort(spark, sf_dir), _families(spark, sf_dir), definition="zheutlin")
    linked = pairs.filter((F.col("Inpatient_Outpatient") == "Inpatient") & (F.col("abs_diff_days") == 0))
    return sampling.seeded_shuffle(linked, key=[*sampling.NOTE_KEY, "Date", "Code", "Encounter_number"])


def q_dx_left_join(spark, sf_dir):
    """Every cohort note with its diagnoses within 14 days, or once without any."""
    return proximity.proximity_join(_cohort(spark, sf_dir), _families(spark, sf_dir), definition=None, how="left")


def q_dx_left_all(spark, sf_dir):
    """J1 at any distance: every cohort note with every diagnosis of its patient, or once without any; patients with
    over 100 rows on a side are split into cells."""
    return asof.all_pairs(_cohort(spark, sf_dir).drop("Report_Text"), _families(spark, sf_dir), cell_rows=100)


def q_rules_binary_long(spark, sf_dir):
    """Every binary rule on every cohort note, long form."""
    return rules.rule_predictions(_cohort(spark, sf_dir))


ANNOTATORS = ["annA", "annB"]


def _annotation_files(spark, sf_dir):
    """Annotator files (D4 arrays per note file) shaped from the fixture records."""
    return annotations.nest_annotation_records(fx.raw_annotations(spark, sf_dir))


def _annotations_flat(spark, sf_dir):
    return annotations.flatten_annotations(_annotation_files(spark, sf_dir), ANNOTATORS, empi_type="bigint")


def _annotations_delivery(spark, sf_dir):
    """Processed annotations as a stage table (the reference's processed annotation file)."""
    return stage_table(spark, "delivery_annotations", sf_dir,
                       lambda: annotations.drop_non_delivery(_annotations_flat(spark, sf_dir)),
                       inputs=[f"{sf_dir}/documents.parquet"])


def _annotated(spark, sf_dir):
    """The annotated notes of the cohort as a stage table: labels, scoring and runs read them."""
    def build():
        return labels.prep_data(_cohort(spark, sf_dir), _annotations_delivery(spark, sf_dir))[1]
    return stage_table(spark, "annotated_notes", sf_dir, build, inputs=[f"{sf_dir}/documents.parquet"])


def _prep(spark, sf_dir):
    """L1 on the stage tables: (annotations, annotated notes, annotations joined to notes)."""
    return labels.prep_data(_annotated(spark, sf_dir), _annotations_delivery(spark, sf_dir), restricted=True)


def q_annotations_flat(spark, sf_dir):
    """Annotator files -> flat span table."""
    return _annotations_flat(spark, sf_dir)


def q_annotations_delivery(spark, sf_dir):
    """J9."""
    return annotations.drop_non_delivery(_annotations_flat(spark, sf_dir))


def q_annotation_label_counts(spark, sf_dir):
    """A2."""
    return annotations.label_counts(_annotations_delivery(spark, sf_dir))


def q_annotation_label_numbers(spark, sf_dir):
    """N9 + A2: the label table with its numbers, and how often each label was given."""
    return annotations.numbered_label_counts(_annotations_flat(spark, sf_dir))


def q_notes_by_patient(spark, sf_dir):
    """The place of every exported note in the order that the note sink writes."""
    keys = fx.notes(spark, sf_dir).select(*sampling.NOTE_KEY)
    return sampling.ranked(readers.by_patient(keys))


def q_cohort_shuffled(spark, sf_dir):
    """The place of every cohort note in the seeded shuffle."""
    return sampling.ranked(sampling.seeded_shuffle(_cohort(spark, sf_dir).select(*sampling.NOTE_KEY)))


def q_annotator_stats(spark, sf_dir):
    """A3 (before the non-delivery removal, as in the reference)."""
    return annotations.annotator_note_counts(_annotations_flat(spark, sf_dir))


def q_annotations_empty(spark, sf_dir):
    """annotator files that hold nothing once rejected and undecided annotations are gone."""
    return annotations.empty_annotation_files(_annotation_files(spark, sf_dir))


def q_non_delivery_notes(spark, sf_dir):
    """IO17: the notes that annotators marked as not about a delivery."""
    return annotations.non_delivery_notes(_annotations_flat(spark, sf_dir))


def q_label_delivery_note(spark, sf_dir):
    """L4: the delivery_note label of every exported note."""
    marked = fx.notes(spark, sf_dir).withColumn(
        "Is_Delivery_Note", F.coalesce(cohort.delivery_related(), F.lit(False)).cast("int"))
    return labels.delivery_note_label(marked).select(*labels.LABEL_KEY, "delivery_note")


def q_label_value_counts(spark, sf_dir):
    """A2 on labels: notes for each label and value."""
    return labels.label_value_counts(_labels_binary(spark, sf_dir))


def q_labels_binary(spark, sf_dir):
    """L1 + L3 (J4, J6, F20, F21) for all binary labels."""
    ann, notes, _ = _prep(spark, sf_dir)
    return labels.binary_labels(notes, ann)


def _ie_labels(spark, sf_dir):
    _, notes, joined = _prep(spark, sf_dir)
    return labels.ie_labels(joined, notes, "estimated blood loss", clean_span=False)


def q_labels_ie(spark, sf_dir):
    """L2 (A4, J7, U2, J8, L5) for the blood-loss extraction label, raw spans."""
    return _ie_labels(spark, sf_dir).withColumn("spans", F.array_join("spans", " || "))


def _regex_eval(spark, sf_dir):
    notes = _annotated(spark, sf_dir)
    gold = _labels_binary(spark, sf_dir)
    preds = rules.rule_predictions(notes, labels=[l for l in rules.BINARY_RULE_LABELS
                                                  if l in set(labels.BINARY_LABELS)])
    return labels.against_gold(preds.drop("MRN_Type"), gold, ["label", "Report_Number", "EMPI", "Report_Date_Time"])


def q_metrics_regex_binary(spark, sf_dir):
    """R31 + A13-A18: regex predictions scored against annotation labels, one row per label."""
    return metrics.binary_metrics(_regex_eval(spark, sf_dir))


def q_class_report(spark, sf_dir):
    """A19."""
    return metrics.class_report(_regex_eval(spark, sf_dir))


def _concept_preds(spark, sf_dir):
    return phenotype.concept_predictions(_cohort(spark, sf_dir))


def q_concept_predictions(spark, sf_dir):
    """Rule-model predictions for the 23 phenotype concepts on every cohort note."""
    return _concept_preds(spark, sf_dir)


def _q_composite(name):
    def q(spark, sf_dir):
        inputs = [c for c, _, _ in phenotype.COMPOSITES[name][0]]
        return phenotype.composite(phenotype.concept_predictions(_cohort(spark, sf_dir), inputs), name)
    q.__doc__ = f"C1-C4 composite {name}."
    return q


def _with_gaps(preds):
    """Predictions of which some were never made: no anchor concept for notes without a site, and some optional
    concepts missing at one site (J10-J13: inner, left and null rules)."""
    mt, c = F.col("MRN_Type"), F.col("concept")
    missing = (mt.isNull() & c.isin(*GAPS_WITHOUT_SITE)) | ((mt == GAP_SITE) & c.isin(*GAPS_AT_SITE))
    return preds.filter(~F.coalesce(missing, F.lit(False)))


GAPS_WITHOUT_SITE = ["accreta", "atony", "PPH_surgical_extension"]
GAP_SITE, GAPS_AT_SITE = "MGH", ["percreta", "coagulopathy", "csection", "PPH_surgical_damage_ligament", "ffp"]


def q_composite_with_gaps(spark, sf_dir):
    """C1-C4 over predictions with gaps, in one frame."""
    preds = _with_gaps(_concept_preds(spark, sf_dir))
    parts = [phenotype.composite(preds, name).select(*labels.LABEL_KEY, F.lit(name).alias("composite"), "predictions")
             for name in phenotype.COMPOSITES]
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def q_subtypes_with_gaps(spark, sf_dir):
    """T1-T6 over predictions with gaps."""
    return phenotype.subtypes(_with_gaps(_concept_preds(spark, sf_dir)))


def q_subtypes_by_run(spark, sf_dir):
    """T1 + J14: subtypes of the annotated notes, and of the notes with a PPH prediction, whose c-section predictions
    come from a run over all notes."""
    annotated = _annotated(spark, sf_dir)
    cohort_notes = _cohort(spark, sf_dir)
    pph = cohort_notes.filter(F.col("Report_Text").rlike(java_regex(LABEL_RULES["PPH"], ignore_case=True)))
    others = [c for c in CONCEPT_RUNS if c != "csection"]
    own = phenotype.concept_predictions(pph, others)
    csection = phenotype.restrict_to_keys(phenotype.concept_predictions(cohort_notes, ["csection"]),
                                          own.filter("concept = 'manual_extraction'"))
    preds = phenotype.predictions_of_runs({"subtype_annotated": phenotype.concept_predictions(annotated),
                                           "model_predicted_PPH": own.unionByName(csection)})
    return phenotype.subtypes(preds, key=[*labels.LABEL_KEY, "run_type"])


def _scratch(spark, name):
    """A fresh folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def q_io_notes_roundtrip(spark, sf_dir):
    """IO1-IO4, IO6, F3, F17: all notes written as multi-line exports and read again."""
    path = _scratch(spark, "exports")
    readers.write_note_exports(fx.notes(spark, sf_dir), path)
    return readers.read_notes(spark, path, name_filter="*.txt")


def q_io_csv_roundtrip(spark, sf_dir):
    """IO9, IO10: the cohort written as CSV and read again."""
    path, notes = _scratch(spark, "csv"), _cohort(spark, sf_dir)
    readers.write_table(notes, path, fmt="csv")
    return readers.read_note_csv(spark, path, notes.schema)


def q_io_split_export(spark, sf_dir):
    """IO16: the split of each label in a folder of its own, all read again."""
    path = _scratch(spark, "splits")
    readers.write_splits(_split_binary(spark, sf_dir), path)
    return spark.read.parquet(path)


def q_normalize_predicates(spark, sf_dir):
    """K14 on every cohort note."""
    t = F.col("Report_Text")
    return _cohort(spark, sf_dir).select(
        "EMPI", "Report_Number", "Report_Date_Time", normalize.has_numbers(t).alias("has_numbers"),
        normalize.has_single_digit_or_10(t).alias("has_single_digit_or_10"),
        normalize.is_text_number(t).alias("is_text_number"))


def _q_normalize(labels_):
    def q(spark, sf_dir):
        return fx.answers(spark, sf_dir, labels_).withColumn(
            "clean", normalize.clean_str(F.col("answer"), F.col("label_type")))
    q.__doc__ = "K2 with the cleaners of " + ", ".join(labels_) + "."
    return q


NORMALIZED = {
    "normalize_transfusion": ["transfusion amount", "transfusion type"],    # K4, K12
    "normalize_laceration": ["laceration grade", "laceration anatomy"],     # K5, K13
    "normalize_gestational_age": ["gestational age"],                       # K6
    "normalize_times": ["time of delivery"],                                # K7, K10
    "normalize_dates": ["date of delivery"],                                # K8, K9
}
LISTED = [x for names in NORMALIZED.values() for x in names] + ["estimated blood loss"]


def q_normalize_blood_loss(spark, sf_dir):
    """Answers of models and of annotators."""
    a = F.col("answer")
    return fx.answers(spark, sf_dir, ["estimated blood loss"]).select(
        "*", normalize.clean_blood_loss(a).alias("clean_prediction"),
        normalize.clean_blood_loss(a, "annotation").alias("clean_annotation"))


def q_normalize_fractions(spark, sf_dir):
    """K11."""
    return fx.answers(spark, sf_dir, ["fraction"]).withColumn("value", normalize.frac_to_float(F.col("answer")))


def q_normalize_lists(spark, sf_dir):
    """K1: two answers of a note and label, cleaned, emptied and split together."""
    before = fx.answers(spark, sf_dir, LISTED, shift=1).withColumnRenamed("answer", "before")
    both = fx.answers(spark, sf_dir, LISTED).join(before, ["doc_id", "label_type"])
    clean = normalize.clean_predictions(F.col("label_type"), F.array("before", "answer"))
    return both.select("doc_id", "label_type", F.array_join(clean, " || ").alias("clean"))


def q_subtypes(spark, sf_dir):
    """19-input subtype frame (J13 as one pivot aggregation)."""
    return phenotype.subtypes(_concept_preds(spark, sf_dir))


def q_sample_annotators(spark, sf_dir):
    """W4 + W5 + IO13: 100 seeded-sample notes split over three annotators, with file names."""
    smp = sampling.sample_notes(_cohort(spark, sf_dir), 100)
    return sampling.assign_annotators(smp, ["annA", "annB", "annC"])


def _labels_binary(spark, sf_dir):
    """The labelled notes as a stage table: scoring and splits read it several times."""
    return stage_table(spark, "labels_binary", sf_dir, lambda: q_labels_binary(spark, sf_dir),
                       inputs=[f"{sf_dir}/documents.parquet"])


def _labels_ie(spark, sf_dir):
    """The extraction labels (spans as arrays) with their label, as a stage table."""
    def build():
        return _ie_labels(spark, sf_dir).withColumn("label", F.lit("estimated blood loss"))
    return stage_table(spark, "labels_ie", sf_dir, build, inputs=[f"{sf_dir}/documents.parquet"])


def _split_binary(spark, sf_dir):
    return sampling.stratified_patient_split(_labels_binary(spark, sf_dir), y="y")


def q_split_binary(spark, sf_dir):
    """W8 + F18 + J16: per-label patient split (50 training patients)."""
    return _split_binary(spark, sf_dir)


def q_split_label_counts(spark, sf_dir):
    """A5/A6."""
    return sampling.split_label_counts(_split_binary(spark, sf_dir))


def q_split_ie(spark, sf_dir):
    """W9 + F19: patient split for the blood-loss extraction label."""
    out = sampling.stratified_patient_split(_labels_ie(spark, sf_dir), y="span_extracted", ie=True)
    return out.withColumn("spans", F.array_join("spans", " || "))


CHUNK_RUN = ("c-section", "disch_summary_curr_delivery_V2")


def chunk_budget() -> int:
    return predict.MAX_LENGTH - predict.prompt_tokens(get_prompt(*CHUNK_RUN)[0])


def q_chunk_notes(spark, sf_dir):
    """M3: overlapping 512-token windows (stride 128) of every cohort note for one prompt."""
    return predict.chunk_notes(_cohort(spark, sf_dir), chunk_budget())


def q_predict_concepts(spark, sf_dir):
    """The 23 phenotype prompt runs over chunked notes with the offline rule model."""
    model = predict.RuleModel(rules=dict(CONCEPT_RULES))
    out = predict.predict_runs(_cohort(spark, sf_dir), dict(CONCEPT_RUNS), model)
    return out.select("Report_Number", "EMPI", "Report_Date_Time", "MRN_Type", "run", "label", "prompt_desc",
                      "prompt", "prediction_type", predict.binary_from_answers().alias("predictions"),
                      F.array_join("raw_preds", "|").alias("raw_preds"), F.size("raw_preds").cast("long").alias("n_chunks"))


def _ebl_eval(spark, sf_dir):
    return extraction.regex_against_gold(_labels_ie(spark, sf_dir), _annotated(spark, sf_dir))


def q_ebl_regex_predictions(spark, sf_dir):
    """R29 + K1 + K3 on annotated notes, with cleaned gold spans."""
    e = _ebl_eval(spark, sf_dir)
    return e.select("Report_Number", "EMPI", "Report_Date_Time", "MRN_Type",
                    *[F.array_join(c, " || ").alias(c) for c in ("spans", "clean_spans", "predictions", "clean_predictions")])


def q_metrics_regex_ie(spark, sf_dir):
    """R31 + A20: extraction scores of the blood-loss rule against cleaned gold spans."""
    return metrics.ie_metrics(_ebl_eval(spark, sf_dir), gold="clean_spans", pred="clean_predictions")


def q_annotations_processed(spark, sf_dir):
    """Processed annotation table with ``clean_span`` (K3, annotation mode, for blood loss)."""
    return extraction.with_clean_span(_annotations_delivery(spark, sf_dir))


def q_spans_plain(spark, sf_dir):
    """P-single rules without lookaround."""
    return spans.single_group_spans(_cohort(spark, sf_dir), spans.single_rules(lookaround=False))


def q_spans_lookaround(spark, sf_dir):
    """P-single rules with lookaround."""
    return spans.single_group_spans(_cohort(spark, sf_dir), spans.single_rules(lookaround=True))


#: The one rule with groups and lookaround at once, which has no SQL.
ANATOMY = "laceration anatomy"


def q_spans_multi(spark, sf_dir):
    """P-multi rules: offsets of the first participating group."""
    return spans.multi_group_spans(_cohort(spark, sf_dir), [r for r in spans.multi_rules() if r[0] != ANATOMY])


def q_spans_anatomy(spark, sf_dir):
    """P31, the rule with groups and lookaround."""
    return spans.multi_group_spans(_cohort(spark, sf_dir), [r for r in spans.multi_rules() if r[0] == ANATOMY])


def q_metrics_composites(spark, sf_dir):
    """Each composite scored against the annotation label it stands for (annotated notes)."""
    preds = phenotype.concept_predictions(_annotated(spark, sf_dir), phenotype.composite_inputs(list(COMPOSITE_GOLD)))
    gold = _labels_binary(spark, sf_dir).where(F.col("label").isin(list(COMPOSITE_GOLD.values())))
    return metrics.binary_metrics(phenotype.composites_against_gold(preds, gold, COMPOSITE_GOLD))


def q_metrics_zero_shot_binary(spark, sf_dir):
    """M5, binary path: the concept runs on annotated notes, joined to their gold labels and scored, a row per run."""
    notes = _annotated(spark, sf_dir)
    model = predict.RuleModel(rules=dict(CONCEPT_RULES))
    key = ["Report_Number", "EMPI", "Report_Date_Time"]
    preds = predict.predict_runs(notes, dict(CONCEPT_RUNS), model).select(
        *key, "run", "label", predict.binary_from_answers().alias("prediction"))
    gold = _labels_binary(spark, sf_dir).select(*key, "label", "y")
    ev = labels.against_gold(preds, gold, [*key, "label"]).drop("label").withColumnRenamed("run", "label")
    return metrics.binary_metrics(ev)


EBL_RUN = {"ebl": ("estimated blood loss", "disch_summary")}


def _zero_shot_ebl(spark, sf_dir):
    model = predict.ExtractRuleModel(rules={"ebl": LABEL_RULES["estimated blood loss"]})
    preds = predict.zero_shot(_annotated(spark, sf_dir), EBL_RUN, model)
    return extraction.answers_against_gold(_labels_ie(spark, sf_dir), preds)


def q_zero_shot_extraction(spark, sf_dir):
    """M5 extraction path (A9 + K1): chunked blood-loss extraction with the rule stand-in model."""
    z = _zero_shot_ebl(spark, sf_dir)
    return z.select("Report_Number", "EMPI", "Report_Date_Time", "MRN_Type", "prompt",
                    *[F.array_join(c, " || ").alias(c) for c in ("spans", "raw_preds", "extracted", "clean_predictions")])


def q_metrics_zero_shot_ie(spark, sf_dir):
    """A20 on the zero-shot extraction run (gold spans de-duplicated as the evaluate path does)."""
    return metrics.ie_metrics(_zero_shot_ebl(spark, sf_dir), gold="spans", pred="clean_predictions")


QUERIES: dict[str, Query] = {
    "cohort_delivery": q_cohort_delivery,
    "cohort_funnel": q_cohort_funnel,
    "dx_families": q_dx_families,
    "dx_proximity_butwick": q_dx_proximity_butwick,
    "dx_proximity_zheutlin": q_dx_proximity_zheutlin,
    "dx_nearest": q_dx_nearest,
    "dx_nearest_window": q_dx_nearest_window,
    "cohort_linked": q_cohort_linked,
    "dx_left_join": q_dx_left_join,
    "dx_left_all": q_dx_left_all,
    "rules_binary_long": q_rules_binary_long,
    "annotations_flat": q_annotations_flat,
    "annotations_delivery": q_annotations_delivery,
    "annotation_label_counts": q_annotation_label_counts,
    "annotation_label_numbers": q_annotation_label_numbers,
    "notes_by_patient": q_notes_by_patient,
    "cohort_shuffled": q_cohort_shuffled,
    "annotator_stats": q_annotator_stats,
    "annotations_empty": q_annotations_empty,
    "non_delivery_notes": q_non_delivery_notes,
    "label_delivery_note": q_label_delivery_note,
    "label_value_counts": q_label_value_counts,
    "labels_binary": q_labels_binary,
    "labels_ie": q_labels_ie,
    "metrics_regex_binary": q_metrics_regex_binary,
    "class_report": q_class_report,
    "concept_predictions": q_concept_predictions,
    "composite_accreta": _q_composite("accreta_composite"),
    "composite_dic": _q_composite("dic_composite"),
    "composite_surgical": _q_composite("surgical_composite"),
    "composite_manual": _q_composite("manual_composite"),
    "subtypes": q_subtypes,
    "sample_annotators": q_sample_annotators,
    "split_binary": q_split_binary,
    "split_label_counts": q_split_label_counts,
    "split_ie": q_split_ie,
    "chunk_notes": q_chunk_notes,
    "predict_concepts": q_predict_concepts,
    "ebl_regex_predictions": q_ebl_regex_predictions,
    "metrics_regex_ie": q_metrics_regex_ie,
    "annotations_processed": q_annotations_processed,
    "spans_plain": q_spans_plain,
    "spans_lookaround": q_spans_lookaround,
    "spans_multi": q_spans_multi,
    "spans_anatomy": q_spans_anatomy,
    "metrics_composites": q_metrics_composites,
    "metrics_zero_shot_binary": q_metrics_zero_shot_binary,
    "composite_with_gaps": q_composite_with_gaps,
    "subtypes_with_gaps": q_subtypes_with_gaps,
    "subtypes_by_run": q_subtypes_by_run,
    "io_notes_roundtrip": q_io_notes_roundtrip,
    "io_csv_roundtrip": q_io_csv_roundtrip,
    "io_split_export": q_io_split_export,
    "normalize_predicates": q_normalize_predicates,
    "normalize_blood_loss": q_normalize_blood_loss,
    **{name: _q_normalize(labels_) for name, labels_ in NORMALIZED.items()},
    "normalize_fractions": q_normalize_fractions,
    "normalize_lists": q_normalize_lists,
    "zero_shot_extraction": q_zero_shot_extraction,
    "metrics_zero_shot_ie": q_metrics_zero_shot_ie,
}

ORACLE: dict[str, Callable[[], str]] = {
    "cohort_delivery": oracle.cohort_delivery,
    "cohort_funnel": oracle.cohort_funnel,
    "dx_families": oracle.dx_families,
    "dx_proximity_butwick": lambda: oracle.dx_proximity("butwick"),
    "dx_proximity_zheutlin": lambda: oracle.dx_proximity("zheutlin"),
    "dx_nearest": oracle.dx_nearest,
    "dx_nearest_window": oracle.dx_nearest_window,
    "cohort_linked": oracle.cohort_linked,
    "rules_binary_long": oracle.rules_binary_long,
    "annotations_flat": oracle.annotations_flat,
    "annotations_delivery": oracle.annotations_delivery,
    "annotation_label_counts": oracle.annotation_label_counts,
    "annotation_label_numbers": oracle.annotation_label_numbers,
    "notes_by_patient": oracle.notes_by_patient,
    "cohort_shuffled": oracle.cohort_shuffled,
    "annotator_stats": oracle.annotator_stats,
    "annotations_empty": oracle.annotations_empty,
    "non_delivery_notes": oracle.non_delivery_notes,
    "label_delivery_note": oracle.label_delivery_note,
    "label_value_counts": oracle.label_value_counts,
    "labels_binary": oracle.labels_binary,
    "labels_ie": oracle.labels_ie,
    "metrics_regex_binary": oracle.metrics_regex_binary,
    "class_report": oracle.class_report,
    "concept_predictions": oracle.concept_predictions,
    "composite_accreta": lambda: oracle.composite("accreta_composite"),
    "composite_dic": lambda: oracle.composite("dic_composite"),
    "composite_surgical": lambda: oracle.composite("surgical_composite"),
    "composite_manual": lambda: oracle.composite("manual_composite"),
    "subtypes": oracle.subtypes,
    "sample_annotators": oracle.sample_annotators,
    "split_binary": oracle.split_binary,
    "split_label_counts": oracle.split_label_counts,
    "split_ie": oracle.split_ie,
    "chunk_notes": lambda: oracle.chunk_notes(chunk_budget()),
    "predict_concepts": oracle.predict_concepts,
    "annotations_processed": oracle.annotations_processed,
    "ebl_regex_predictions": oracle.ebl_regex_predictions,
    "metrics_regex_ie": oracle.metrics_regex_ie,
    "zero_shot_extraction": lambda: oracle.zero_shot_extraction(get_prompt(*EBL_RUN["ebl"])[0]),
    "metrics_zero_shot_ie": lambda: oracle.metrics_zero_shot_ie(get_prompt(*EBL_RUN["ebl"])[0]),
    "spans_plain": oracle.spans_plain,
    "spans_multi": oracle.spans_multi,
    "spans_lookaround": oracle.spans_lookaround,
    "metrics_composites": oracle.metrics_composites,
    "metrics_zero_shot_binary": oracle.metrics_zero_shot_binary,
    "composite_with_gaps": lambda: oracle.composite_with_gaps(GAPS_WITHOUT_SITE, GAP_SITE, GAPS_AT_SITE),
    "subtypes_with_gaps": lambda: oracle.subtypes(oracle.gaps(GAPS_WITHOUT_SITE, GAP_SITE, GAPS_AT_SITE)),
    "dx_left_join": oracle.dx_left_join,
    "dx_left_all": oracle.dx_left_all,
    "subtypes_by_run": oracle.subtypes_by_run,
    "io_notes_roundtrip": oracle.io_notes_roundtrip,
    "io_csv_roundtrip": oracle.cohort_delivery,
    "io_split_export": oracle.io_split_export,
    "normalize_predicates": oracle.normalize_predicates,
    "normalize_blood_loss": oracle_answers.blood_loss,
    **{name: (lambda labels_=labels_: oracle_answers.cleaned(labels_)) for name, labels_ in NORMALIZED.items()},
    "normalize_fractions": oracle_answers.fractions,
    "normalize_lists": lambda: oracle_answers.lists(LISTED, normalize.MULTI_VALUE_LABELS + ["date of delivery"]),
}
