"""Composite concepts and PPH subtypes.

Predictions stay in long form (key, concept, prediction). A composite or the 19-input subtype
frame is ONE grouped aggregation on the note key (a pivot with a fixed value list), not a chain
of joins: one shuffle instead of 18, with map-side partial aggregation. Join semantics of the
reference are kept with presence flags: the anchor concept must be present (left joins anchored
on it) and inner-joined inputs must be present too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.concepts import COMPOSITES, CONCEPT_RULES, CONCEPT_RUNS, SUBTYPE_INPUTS
from cohortlens.operators.labels import against_gold
from cohortlens.operators.rules import PRED_KEY, rule_predictions


def concept_predictions(notes: DataFrame, concepts: list[str] | None = None, text: str = "Report_Text") -> DataFrame:
    """Note-level predictions of the offline rule model for each concept:
    ``key + [concept, label, prompt_desc, prediction]``."""
    concepts = concepts or list(CONCEPT_RUNS)
    long = rule_predictions(notes, labels=concepts, text=text, rules=CONCEPT_RULES).withColumnRenamed("label", "concept")
    runs = F.create_map(*[F.lit(x) for c in concepts for x in (c, CONCEPT_RUNS[c][0])])
    prompts = F.create_map(*[F.lit(x) for c in concepts for x in (c, CONCEPT_RUNS[c][1])])
    return long.select(*[c for c in long.columns if c not in ("concept", "prediction")], "concept",
                       F.element_at(runs, F.col("concept")).alias("label"),
                       F.element_at(prompts, F.col("concept")).alias("prompt_desc"), "prediction")


def restrict_to_keys(preds: DataFrame, others: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Predictions whose EMPI, Report_Number and Report_Date_Time each occur among ``others``, tested one by one
    as the reference does (not as a tuple). Null is a value like others."""
    for k in key or ["EMPI", "Report_Number", "Report_Date_Time"]:
        known = others.select(F.col(k).alias("_known")).distinct()
        preds = preds.join(known, F.col(k).eqNullSafe(F.col("_known")), "left_semi")
    return preds


def same_count(preds: DataFrame, others: DataFrame) -> None:
    """J14 check: raises if the restricted predictions are not as many as the others."""
    a, b = preds.count(), others.count()
    if a != b:
        raise ValueError(f"{a} restricted predictions, {b} expected: the keys cross over between notes")


def predictions_of_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """The predictions of several run types in one frame, told apart by ``run_type``."""
    parts = [p.withColumn("run_type", F.lit(name)) for name, p in runs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sum_nonnull(cols: list[Column]) -> Column:
    out = F.lit(0)
    for c in cols:
        out = out + F.coalesce(c, F.lit(0))
    return out


def composite(preds: DataFrame, name: str, key: list[str] | None = None) -> DataFrame:
    """Combine concept predictions of the same note into one composite prediction."""
    inputs, rule = COMPOSITES[name]
    key = [c for c in (key or PRED_KEY) if c in preds.columns]
    p = preds.filter(F.col("concept").isin([c for c, _, _ in inputs]))
    aggs = []
    for concept, suffix, _ in inputs:
        hit = F.col("concept") == concept
        aggs.append(F.max(F.when(hit, F.col("prediction"))).alias(f"predictions_{suffix}"))
        aggs.append(F.max(hit.cast("int")).alias(f"_has_{suffix}"))
    g = p.groupBy(*key).agg(*aggs)
    for concept, suffix, required in inputs:
        if required:
            g = g.filter(F.col(f"_has_{suffix}") == 1)
    cols = [F.col(f"predictions_{s}") for _, s, _ in inputs]
    if rule == "any":
        pred = F.when(_sum_nonnull(cols) >= 1, 1).otherwise(0)
    else:  # manual extraction without c-section
        pred = F.when((cols[0] == 1) & F.coalesce(cols[1] == 0, F.lit(False)), 1).otherwise(0)
    return g.select(*key, *[f"predictions_{s}" for _, s, _ in inputs], pred.cast("int").alias("predictions"))


def _composite_expr(name: str, col_of) -> Column:
    """Composite prediction from already pivoted concept columns (NULL when a required input is
    absent, i.e. the composite row would not exist)."""
    inputs, rule = COMPOSITES[name]
    cols = [col_of(c) for c, _, _ in inputs]
    present = F.lit(True)
    for c, _, required in inputs:
        if required:
            present = present & (F.col(f"_has_{c}") == 1)
    if rule == "any":
        pred = F.when(_sum_nonnull(cols) >= 1, 1).otherwise(0)
    else:
        pred = F.when((cols[0] == 1) & F.coalesce(cols[1] == 0, F.lit(False)), 1).otherwise(0)
    return F.when(present, pred)


def composite_inputs(names: list[str]) -> list[str]:
    """The concepts that the composites are made of."""
    return sorted({c for n in names for c, _, _ in COMPOSITES[n][0]})


def _pivot(preds: DataFrame, concepts: list[str], key: list[str]) -> DataFrame:
    """One row per note: ``_p_<concept>`` (its prediction) and ``_has_<concept>`` (1 if there is one)."""
    aggs = []
    for c in concepts:
        hit = F.col("concept") == c
        aggs.append(F.max(F.when(hit, F.col("prediction"))).alias(f"_p_{c}"))
        aggs.append(F.max(hit.cast("int")).alias(f"_has_{c}"))
    return preds.filter(F.col("concept").isin(concepts)).groupBy(*key).agg(*aggs)


def composites_against_gold(preds: DataFrame, gold: DataFrame, stands_for: dict[str, str]) -> DataFrame:
    """Label (the composite), prediction and y, a row for each note and composite that exists and has a gold label.

    One pivot of the predictions gives all composites, one pivot of the gold labels (key, label, y) their truth; the two
    meet in one join on the note key."""
    key = ["Report_Number", "EMPI", "Report_Date_Time"]
    wide = _pivot(preds, composite_inputs(list(stands_for)), key)
    made = wide.select(*key, *[_composite_expr(n, lambda c: F.col(f"_p_{c}")).alias(n) for n in stands_for])
    truth = gold.groupBy(*key).agg(*[F.max(F.when(F.col("label") == lab, F.col("y"))).alias(f"_y_{n}") for n, lab in stands_for.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("prediction"), F.col(f"_y_{n}").alias("y")) for n in stands_for])
    return against_gold(made, truth, key).select(*key, F.inline(rows)).where("prediction IS NOT NULL AND y IS NOT NULL")


def subtypes(preds: DataFrame, key: list[str] | None = None, anchor: str = "atony") -> DataFrame:
    """One pivot of all concept predictions per note (composites for accreta and DIC are
    computed inside the same row), anchored on atony, plus the four subtype flags.
    One scan of the predictions and one shuffle on the note key."""
    key = [c for c in (key or PRED_KEY) if c in preds.columns]
    needed = sorted({c for _, c in SUBTYPE_INPUTS if c not in COMPOSITES}
                    | {c for n in ("accreta_composite", "dic_composite") for c, _, _ in COMPOSITES[n][0]})
    wide = _pivot(preds, needed, key).filter(F.col(f"_has_{anchor}") == 1)
    col_of = lambda c: F.col(f"_p_{c}")
    src = {s_: (_composite_expr(c, col_of) if c in COMPOSITES else col_of(c)) for s_, c in SUBTYPE_INPUTS}
    wide = wide.select(*key, *[v.alias(f"predictions_{k}") for k, v in src.items()])
    p = lambda s_: F.col(f"predictions_{s_}")
    tone = _sum_nonnull([p("atony"), p("methergine"), p("cytotec"), p("hemabate")])
    tissue = F.when((p("accreta") == 1) | (p("retained_poc") == 1) | (p("d_and_c") == 1)
                    | ((p("manual_extraction") == 1) & (p("csection") == 0)), 1).otherwise(0)
    thrombus = _sum_nonnull([p("dic"), p("cryo"), p("platelets"), p("ffp")])
    trauma = F.when((p("uterine_rupture") == 1) | (p("oleary") == 1) | (p("PPH_surgical_extension") == 1)
                    | (p("PPH_surgical_damage_artery") == 1) | (p("PPH_surgical_damage_ligament") == 1)
                    | ((p("laceration") == 1) & (thrombus == 0) & (tone == 0) & (tissue == 0)), 1).otherwise(0)
    b = lambda c: F.when(F.coalesce(c, F.lit(0)) >= 1, 1).otherwise(0).cast("int")
    return wide.select(*key, *[f"predictions_{s_}" for s_, _ in SUBTYPE_INPUTS],
                       b(tone).alias("has_tone_subtype_model"), b(tissue).alias("has_tissue_subtype_model"),
                       b(thrombus).alias("has_thrombus_subtype_model"),
                       b(trauma).alias("has_trauma_subtype_model_lacerations_no_other_cause"))
