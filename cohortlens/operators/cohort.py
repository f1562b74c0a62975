"""Delivery-note cohort: filters, key de-duplication and the auditable funnel.

The cohort filters first (the date and status predicates reach the scan), then keeps one row per key: only rows
that pass F3-F7 are shuffled, and of a key's copies one for each map task. The funnel turns each row into a few
numbers in the scan, so no text leaves it, and counts from one small row per note key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.functions.regex import java_regex

NOTE_KEY = ["EMPI", "Report_Number", "Report_Date_Time"]

# ---------------------------------------------------------------------------
# These must equal the reference's cohort definition.
# ---------------------------------------------------------------------------
DATE_CUTOFF = "2015-05-01"
ED_DESCRIPTIONS = ["ED Observation Discharge Summary", "ED Discharge Summary"]
DELIVERY_PATTERN = "labor |delivery|L&D|cesarean section|c-section|estimated EDC|pregnancy"
FINAL_STATUS = "F"
INSTRUCTIONS_HEADER = "Discharge Instructions"
INSTRUCTIONS_PATTERN = "Please bring these discharge instructions to your follow-up appointments."
ORDERS_LITERAL = "****** DISCHARGE ORDERS ******"

FUNNEL_STEPS = ["read", "before_cutoff", "non_ed", "has_text", "delivery_regex",
                "final_status", "dedup", "no_discharge_instructions", "no_discharge_orders"]

# --- single predicates (Column level, usable in any filter) -----------------------------------

def before_cutoff(col: str = "Report_Date_Time", cutoff: str = DATE_CUTOFF) -> Column:
    """strict ``< cutoff`` (pushed down to the Parquet scan)."""
    return F.col(col) < F.lit(cutoff).cast("timestamp_ntz")


def not_ed_note(col: str = "Report_Description") -> Column:
    """pandas ``!=`` keeps nulls, so compare null-safely."""
    c = F.col(col)
    return ~c.eqNullSafe(ED_DESCRIPTIONS[0]) & ~c.eqNullSafe(ED_DESCRIPTIONS[1])


def has_text(col: str = "Report_Text") -> Column:
    """F5."""
    return F.col(col).isNotNull()


def delivery_related(col: str = "Report_Text") -> Column:
    """case-insensitive regex search."""
    return F.coalesce(F.col(col).rlike(java_regex(DELIVERY_PATTERN, ignore_case=True)), F.lit(False))


def final_status(col: str = "Report_Status") -> Column:
    """F7."""
    return F.coalesce(F.col(col) == FINAL_STATUS, F.lit(False))


def not_discharge_instructions(col: str = "Report_Text") -> Column:
    """F8: drop notes holding both the header and the boilerplate sentence (case-sensitive regex)."""
    t = F.col(col)
    both = t.rlike(java_regex(INSTRUCTIONS_HEADER)) & t.rlike(java_regex(INSTRUCTIONS_PATTERN))
    return ~F.coalesce(both, F.lit(False))


def not_discharge_orders(col: str = "Report_Text") -> Column:
    """literal substring exclusion."""
    return ~F.coalesce(F.col(col).contains(ORDERS_LITERAL), F.lit(False))


def sanitize_report_number(col: str = "Report_Number") -> Column:
    """literal ``/`` -> ``_``."""
    return F.replace(F.col(col), F.lit("/"), F.lit("_"))


# --- DataFrame operators ---------------------------------------------------------------------

def dedup_on_key(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keep one row per key (nulls are equal), the one with the smallest hash of all its columns.

    The reference keeps the first in file order, which Spark does not have; rows of a key that differ are told apart
    by the hash, so the choice is deterministic. ``row_number() <= 1`` plans as a partial ``WindowGroupLimit`` before
    the shuffle, so a hot key ships one row per map task, not all of its copies.
    """
    keys = keys or NOTE_KEY
    w = Window.partitionBy(*keys).orderBy("_order")
    return (df.withColumn("_order", F.xxhash64(*df.columns)).withColumn("_rn", F.row_number().over(w))
            .filter("_rn <= 1").drop("_rn", "_order"))


def candidate_notes(notes: DataFrame) -> DataFrame:
    """F3 -> F4 -> F5 -> F6 -> F7."""
    return notes.filter(before_cutoff() & (F.col("Report_Status") == FINAL_STATUS) & not_ed_note() & has_text()
                        & delivery_related())


def delivery_cohort(notes: DataFrame) -> DataFrame:
    """G1: F3 -> F4 -> F5 -> F6 -> F7 -> A11 -> F10 -> F8 -> F9 on raw notes."""
    return (dedup_on_key(candidate_notes(notes)).filter(not_discharge_instructions() & not_discharge_orders())
            .withColumn("Report_Number", sanitize_report_number()))


def note_steps(notes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per note key: ``_rows`` (rows that survive each step up to F7) and ``_reached`` (last step of the key).

    The steps behind the de-duplication are those of the row that :func:`dedup_on_key` keeps.
    """
    keys = keys or NOTE_KEY
    pre = [before_cutoff(), not_ed_note(), has_text(), delivery_related(), final_status()]
    passed, step = F.lit(True), F.lit(0)
    for i, p in enumerate(pre, start=1):
        passed = passed & F.coalesce(p, F.lit(False))
        step = F.when(passed, F.lit(i)).otherwise(step)
    last = len(pre)
    post = (F.when(~not_discharge_instructions(), F.lit(last + 1)).when(~not_discharge_orders(), F.lit(last + 2))
            .otherwise(F.lit(last + 3)))
    slim = notes.select(*keys, step.alias("_step"), F.when(step == last, post).alias("_post"),
                        F.xxhash64(*notes.columns).alias("_order"))
    rows = [F.count(F.when(F.col("_step") >= i, 1)).alias(f"_n{i}") for i in range(last + 1)]
    kept = F.min(F.when(F.col("_step") == last, F.struct("_order", "_post"))).alias("_kept")
    by_key = slim.groupBy(*keys).agg(*rows, F.max("_step").alias("_step"), kept)
    return by_key.select(*keys, F.array(*[f"_n{i}" for i in range(last + 1)]).alias("_rows"),
                         F.coalesce("_kept._post", "_step").alias("_reached"))


def funnel_stats(notes: DataFrame) -> DataFrame:
    """Rows, distinct patients / report numbers / (report, patient) / full keys per step,
    plus rows and patients removed by the step. A null counts as a value, as in the reference.

    A patient (or report number) reaches the furthest step that one of its notes reaches, so each count is the number of
    groups whose largest step is at least the row's. The table by note key (one scan of the notes) gives a row for each
    of the four groupings, and all of them are reduced in one aggregation by (grouping, key)."""
    n = len(FUNNEL_STEPS)
    pre = n - 3
    names = {"n_patients": ["EMPI"], "n_report_numbers": ["Report_Number"], "n_patient_reports": ["Report_Number", "EMPI"],
             "n_notes": NOTE_KEY}
    keyed = note_steps(notes)

    def group(name: str, cols: list[str]) -> Column:
        none = {c: F.lit(None).cast(keyed.schema[c].dataType) for c in NOTE_KEY}
        rows = F.col("_rows") if name == "n_notes" else F.lit(None).cast(keyed.schema["_rows"].dataType)
        return F.struct(F.lit(name).alias("of"), *[(F.col(c) if c in cols else none[c]).alias(c) for c in NOTE_KEY],
                        rows.alias("_rows"), "_reached")

    grouped = keyed.select(F.inline(F.array(*[group(k, v) for k, v in names.items()]))).groupBy("of", *NOTE_KEY).agg(
        F.max("_reached").alias("_top"), F.first("_rows").alias("_rows"))

    def counts(name: str) -> Column:
        return F.array(*[F.count(F.when((F.col("of") == name) & (F.col("_top") >= i), 1)) for i in range(n)]).alias(name)

    # rows before the de-duplication are added up, behind it each key is one row
    rows = [F.coalesce(F.sum(F.col("_rows")[i]), F.lit(0)) for i in range(pre)] \
        + [F.count(F.when((F.col("of") == "n_notes") & (F.col("_top") >= i), 1)) for i in range(pre, n)]
    one = grouped.agg(F.array(*rows).alias("n_rows"), *[counts(k) for k in names])
    zipped = F.arrays_zip("n_rows", *names)
    out = one.select(F.posexplode(zipped).alias("step_idx", "c")).select("step_idx", "c.*")
    names = F.array(*[F.lit(s) for s in FUNNEL_STEPS])
    # one row per funnel step (9 rows): an unpartitioned lag is bounded by the step count
    w = Window.orderBy("step_idx")
    return out.filter("n_rows > 0").select(
        "step_idx", names[F.col("step_idx")].alias("step"), "n_rows", "n_patients", "n_report_numbers",
        "n_patient_reports", "n_notes",
        F.coalesce(F.lag("n_rows").over(w) - F.col("n_rows"), F.lit(0)).alias("removed_rows"),
        F.coalesce(F.lag("n_patients").over(w) - F.col("n_patients"), F.lit(0)).alias("removed_patients"),
    )
