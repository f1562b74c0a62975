"""Diagnosis-code families and note <-> diagnosis time proximity.

Scale notes
-----------
* The ±N-day band join never joins on the patient id alone (a patient can hold a large share of
  all rows): both sides carry a time bucket of N days and the diagnosis side is replicated to the
  three buckets a match can fall in, so the equi-key is (EMPI, bucket) and the band is a residual
  predicate. The note side (which carries the text) is shuffled once and never replicated.
* Joins at any distance are in :mod:`cohortlens.operators.asof`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.cohort import DATE_CUTOFF, NOTE_KEY

# ---------------------------------------------------------------------------
# Must equal the reference's code definitions.
# ---------------------------------------------------------------------------
CODE_FAMILIES = {
    "pph": ["666"],
    "obstetric_trauma": ["665", "664"],
    "zheutlin_specific": ["656", "641"],
}
ZHEUTLIN_CODES = ['666.32', '666.24', '666.22', '666.20', '666.14', '666.12', '666.10', '666.04', '666.02',
                  '666.00', '665.24', '665.22', '665.20', '656.03', '656.00', '641.91', '641.81', '641.33',
                  '641.31', '641.30', '641.11']
BUTWICK_PREFIXES = ["666.0", "666.1", "666.2"]
WINDOW_DAYS = 14

DAY_MICROS = 86_400_000_000


def _micros(col: Column) -> Column:
    """Micro-seconds since epoch of a TIMESTAMP_NTZ, independent of the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col)


def _starts_with_any(col: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | col.startswith(p)
    return out


def diagnoses_before(dx: DataFrame, cutoff: str = DATE_CUTOFF) -> DataFrame:
    """IO5 date cut-off ``Date < cutoff`` (pushed to the scan)."""
    return dx.filter(F.col("Date") < F.lit(cutoff).cast("timestamp_ntz"))


def code_families(dx: DataFrame) -> DataFrame:
    """The three code families as one OR filter (one scan; prefixes are disjoint, so this
    equals the union of the three family frames), tagged with its family."""
    code = F.col("Code").cast("string")
    fam = None
    for name, prefixes in CODE_FAMILIES.items():
        cond = _starts_with_any(code, prefixes)
        fam = F.when(cond, F.lit(name)) if fam is None else fam.when(cond, F.lit(name))
    all_prefixes = [p for ps in CODE_FAMILIES.values() for p in ps]
    return (dx.withColumn("Code", code).filter(_starts_with_any(code, all_prefixes))
            .withColumn("family", fam))


def definition_filter(definition: str) -> Column:
    """F12 (zheutlin: exact code list) / F13 (butwick: 666.0/666.1/666.2 prefixes)."""
    if definition == "zheutlin":
        return F.col("Code").isin(ZHEUTLIN_CODES)
    if definition == "butwick":
        return _starts_with_any(F.col("Code"), BUTWICK_PREFIXES)
    raise ValueError(f"unknown PPH code definition: {definition}")


def _with_day_diff(df: DataFrame) -> DataFrame:
    diff = (_micros(F.col("Report_Date_Time")) - _micros(F.col("Date"))) / F.lit(float(DAY_MICROS))
    return df.withColumn("diff_days", diff).withColumn("abs_diff_days", F.abs(F.col("diff_days")))


def proximity_join(notes: DataFrame, dx: DataFrame, window_days: int = WINDOW_DAYS,
                   definition: str | None = "butwick", one_per_note: bool = False, how: str = "inner") -> DataFrame:
    """J1 + J3 (+F12/F13, F16): every (note, diagnosis) pair of the same patient with
    ``-window_days <= diff_days <= window_days``; ``one_per_note`` keeps the nearest (W1). With ``how='left'`` a note
    without such a diagnosis (or without patient or time) stays once, its diagnosis columns null."""
    if definition:
        dx = dx.filter(definition_filter(definition))
    width = window_days * DAY_MICROS
    nb = F.floor(_micros(F.col("Report_Date_Time")) / F.lit(width))
    db = F.floor(_micros(F.col("Date")) / F.lit(width))
    dx_b = dx.select("EMPI", *[c for c in dx.columns if c != "EMPI"],
                     F.explode(F.array(db - 1, db, db + 1)).alias("_bucket"))
    notes_b = notes.withColumn("_bucket", nb)
    # a pair meets in exactly one bucket, so the window belongs to the join condition
    dx_b = dx_b.withColumnRenamed("EMPI", "_dx_empi").withColumnRenamed("_bucket", "_dx_bucket")
    apart = _micros(F.col("Report_Date_Time")) - _micros(F.col("Date"))
    near = (F.col("EMPI") == F.col("_dx_empi")) & (F.col("_bucket") == F.col("_dx_bucket")) & apart.between(-width, width)
    joined = _with_day_diff(notes_b.join(dx_b, near, how).drop("_dx_empi", "_bucket", "_dx_bucket"))
    if one_per_note:
        joined = nearest_per_note(joined)
    return joined


def nearest_per_note(pairs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row per note, smallest ``abs_diff_days`` then Date, Code, Encounter_number."""
    key = key or NOTE_KEY
    w = Window.partitionBy(*key).orderBy("abs_diff_days", "Date", "Code", "Encounter_number")
    return pairs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
