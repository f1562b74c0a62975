"""Notes and diagnoses at any distance (J1, J2) when one patient may hold a large share of both.

* :func:`all_pairs` is the unbounded left join of notes with the diagnoses of their patient. A patient with many rows is
  found by counting (heavy hitters), and the grid of its notes and diagnoses is cut into cells: its notes are dealt into
  rows and its diagnoses into columns, each note goes to every column and each diagnosis to every row. All other
  patients are one cell. The join is on (patient, row, column), so no task holds one patient's whole product, and
  pairs are made once each.
* :func:`nearest` is an as-of join by one prefix scan. Notes and diagnoses are dealt into ranges of (patient, time) and
  sorted; a diagnosis carries the next one of its patient, so a single forward pass knows for every note the last
  diagnosis before it and the first behind it. The last diagnosis of each range is carried over the range edges (one
  row per range), so a patient may span any number of ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.proximity import _micros, _with_day_diff
from cohortlens.session import ensure_checkpoint_dir

#: Rows of one patient, on one side, that a cell of the join holds; beyond, the patient is split.
CELL_ROWS = 20_000
#: Most patients that are split; with more, cells grow, so that the table of split patients stays small enough to ship.
MOST_SPLIT = 100_000


def split_patients(notes: DataFrame, dx: DataFrame, cell_rows: int = CELL_ROWS, patient: str = "EMPI") -> DataFrame:
    """patient, _rows and _columns: the cells of every patient with over ``cell_rows`` notes or diagnoses.

    At most 2 x MOST_SPLIT patients: a cell never holds under (all rows) / MOST_SPLIT rows."""
    counted = notes.select(patient, F.lit(1).alias("n"), F.lit(0).alias("d")).unionAll(
        dx.select(patient, F.lit(0).alias("n"), F.lit(1).alias("d"))).where(F.col(patient).isNotNull()) \
        .groupBy(patient).agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    most = counted.agg(F.max(F.greatest("n", "d")), F.sum(F.col("n") + F.col("d"))).first()
    cell = max(cell_rows, (most[1] or 0) // MOST_SPLIT)
    if (most[0] or 0) <= cell:
        counted = counted.limit(0)
    return counted.where((F.col("n") > cell) | (F.col("d") > cell)).select(
        patient, F.greatest(F.ceil(F.col("n") / cell), F.lit(1)).cast("int").alias("_rows"),
        F.greatest(F.ceil(F.col("d") / cell), F.lit(1)).cast("int").alias("_columns"))


def _dealt(df: DataFrame, split: DataFrame, own: str, other: str, patient: str) -> DataFrame:
    """``df`` with its cells: a place on its own side by the hash of the row (equal rows share one), and every place of
    the other side."""
    one = F.lit(1)
    placed = df.join(F.broadcast(split), patient, "left").select(
        *df.columns, F.pmod(F.xxhash64(*df.columns), F.coalesce(own + "s", one)).cast("int").alias(own),
        F.coalesce(other + "s", one).alias("_places"))
    return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("_places") - 1)))


def all_pairs(notes: DataFrame, dx: DataFrame, cell_rows: int = CELL_ROWS, patient: str = "EMPI") -> DataFrame:
    """Every note with every diagnosis of its patient, and diff_days / abs_diff_days; a note without any (or
    without a patient) stays once, its diagnosis columns null. Repeated rows pair again.

    A note of a patient with several columns meets diagnoses in at least one of them, so there the copies without a
    match are dropped. Columns: those of notes, then those of diagnoses without the patient."""
    split = split_patients(notes, dx, cell_rows, patient)
    left = _dealt(notes, split, "_row", "_column", patient)
    right = _dealt(dx, split, "_column", "_row", patient).drop("_places") \
        .withColumnsRenamed({patient: "_patient", "_row": "_dx_row", "_column": "_dx_column"}).withColumn("_match", F.lit(True))
    same = (F.col(patient) == F.col("_patient")) & (F.col("_row") == F.col("_dx_row")) & (F.col("_column") == F.col("_dx_column"))
    joined = left.join(right, same, "left").where("_match OR _places = 1")
    return _with_day_diff(joined.select(*notes.columns, *[c for c in dx.columns if c != patient]))


def _carried(ranged: DataFrame) -> dict[int, tuple]:
    """For each range, the last diagnosis row (patient, number of its row) of the ranges before it, as (patient, payload)."""
    last = ranged.where("_kind = 0").groupBy("_range").agg(F.max(F.struct("EMPI", "_us", "_dx")).alias("l")).collect()
    out, now = {}, None
    by_range = {r["_range"]: (r["l"]["EMPI"], r["l"]["_us"], r["l"]["_dx"]) for r in last}
    for i in range(max(by_range, default=-1) + 2):
        out[i] = now
        now = by_range.get(i, now)
    return out


def events_by_time(notes: DataFrame, dx: DataFrame) -> DataFrame:
    """Notes and diagnoses in ranges of (EMPI, time), sorted: _range, EMPI, _us, _kind (0 diagnosis, 1 note), _dx (the
    diagnosis and the next one of its patient), _note; notes and diagnoses without patient or time are left out.

    Diagnoses are first reduced to the least row of each patient and instant; a patient's first one stands once more
    before all notes. Written to the checkpoint folder, as what follows reads it twice."""
    ensure_checkpoint_dir(notes.sparkSession)
    rest = ["Code", "Encounter_number", *[c for c in dx.columns if c not in ("EMPI", "Date", "Code", "Encounter_number")]]
    day = dx.where("EMPI IS NOT NULL AND Date IS NOT NULL").groupBy("EMPI", "Date").agg(F.min(F.struct(*rest)).alias("_best"))
    own = F.struct(_micros(F.col("Date")).alias("us"), "Date", "_best")
    w = Window.partitionBy("EMPI").orderBy("Date")
    day = day.select("EMPI", own.alias("own"), F.lead(own).over(w).alias("after"), F.row_number().over(w).alias("rn"))
    none = F.lit(None).cast(day.schema["own"].dataType)
    start = F.struct(F.lit(-2**63).alias("us"), F.struct(none.alias("before"), F.col("own").alias("behind")).alias("_dx"))
    here = F.struct(F.col("own.us").alias("us"), F.struct(F.col("own").alias("before"), F.col("after").alias("behind")).alias("_dx"))
    marks = day.select("EMPI", F.explode(F.when(F.col("rn") == 1, F.array(start, here)).otherwise(F.array(here))).alias("m"))
    marks = marks.select("EMPI", F.col("m.us").alias("_us"), F.lit(0).alias("_kind"), "m._dx")
    rows = notes.where("EMPI IS NOT NULL AND Report_Date_Time IS NOT NULL").select(
        "EMPI", _micros(F.col("Report_Date_Time")).alias("_us"), F.lit(1).alias("_kind"),
        F.struct(*[c for c in notes.columns if c != "EMPI"]).alias("_note"))
    events = marks.unionByName(rows, allowMissingColumns=True)
    order = ["EMPI", "_us", "_kind", F.xxhash64("_note")]
    return events.repartitionByRange(*order).sortWithinPartitions(*order[:3]) \
        .withColumn("_range", F.spark_partition_id()).checkpoint()


def nearest(notes: DataFrame, dx: DataFrame) -> DataFrame:
    """Every note that has a diagnosis of its patient at any distance, with the nearest one and diff_days; ties go
    to the earlier date, then to the least Code and Encounter_number."""
    ranged = events_by_time(notes, dx)
    carry = _carried(ranged)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: pa.Table | None = None  # the last diagnosis row so far: EMPI, _dx
        for b in batches:
            t = pa.Table.from_batches([b])
            if now is None:
                before = carry.get(b.column("_range")[0].as_py()) if b.num_rows else None
                now = t.select(["EMPI", "_dx"]).slice(0, 0)
                if before is not None:
                    value = before[2].asDict(recursive=True)
                    now = pa.table([pa.array([before[0]], t.schema.field("EMPI").type), pa.array([value], t.schema.field("_dx").type)],
                                   names=["EMPI", "_dx"])
            kind = t.column("_kind").to_numpy()
            known = pa.concat_tables([now, t.select(["EMPI", "_dx"])])
            at = np.where(kind == 0, np.arange(len(kind)) + len(now), -1)
            last = np.maximum.accumulate(np.concatenate([[0 if len(now) else -1], at]))[1:]
            note = np.flatnonzero((kind == 1) & (last >= 0))
            found = known.take(pa.array(last[note]))
            own = t.select(["EMPI", "_us", "_note"]).take(pa.array(note))
            same = pc.fill_null(pc.equal(own.column("EMPI"), found.column("EMPI")), False)
            yield from own.append_column("_dx", found.column("_dx")).filter(same).combine_chunks().to_batches()
            if (kind == 0).any() or len(now):
                end = int(last[-1]) if len(last) else 0
                now = known.slice(end, 1).combine_chunks() if end >= 0 else now
    schema = ranged.select("EMPI", "_us", "_note", "_dx").schema
    found = ranged.select("EMPI", "_us", "_kind", "_dx", "_note", "_range").mapInArrow(scan, schema)
    before, behind = F.col("_dx.before"), F.col("_dx.behind")
    back = before.isNotNull() & (behind.isNull() | (F.col("_us") - before["us"] <= behind["us"] - F.col("_us")))
    best = found.select("EMPI", "_note.*", F.when(back, before).otherwise(behind).alias("_d"))
    columns = [c for c in notes.columns if c != "EMPI"]
    out = best.where("_d IS NOT NULL").select("EMPI", *columns, F.col("_d.Date").alias("Date"), "_d._best.*")
    return _with_day_diff(out)
