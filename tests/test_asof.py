"""Unbounded left join and as-of join against brute force, with a patient that holds most rows."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import asof
from cohortlens.plans import catalog
from tests.conftest import SF001

NOTE = "EMPI long, Report_Number string, Report_Date_Time timestamp_ntz, Report_Text string"
DX = "EMPI long, Date timestamp_ntz, Code string, Encounter_number long, Name string"
DAY = datetime(2014, 1, 1)


def tables(spark, n_notes, n_dx, seed):
    random.seed(seed)

    def patient():
        return random.choice([7, 7, 7, 7, *range(5), None])
    notes = [(patient(), f"r{i}", random.choice([None, DAY + timedelta(hours=6 * random.randrange(400))]), f"text {i}") for i in range(n_notes)]
    dx = [(random.choice([7, 7, 7, 1, 2, None, 99]), random.choice([None, *[DAY + timedelta(days=random.randrange(-20, 120)) for _ in range(9)]]),
           random.choice(["666.0", "665.1"]), random.randrange(50), f"d{i}") for i in range(n_dx)]
    return notes, dx, spark.createDataFrame(notes, NOTE), spark.createDataFrame(dx, DX)


@pytest.mark.parametrize("cell_rows", [1, 7, 50, 20_000])
def test_left_join_at_any_distance(spark, cell_rows):
    notes, dx, n, d = tables(spark, 150, 90, cell_rows)
    n, notes = n.unionAll(n.limit(3)), notes + [tuple(r) for r in n.limit(3).collect()]  # repeated rows
    got = Counter(tuple(r)[:8] for r in asof.all_pairs(n, d, cell_rows).collect())
    exp = Counter()
    for x in notes:
        mine = [y for y in dx if y[0] == x[0] and x[0] is not None]
        exp.update([(*x, *y[1:]) for y in mine] or [(*x, None, None, None, None)])
    assert got == exp
    assert asof.all_pairs(n, d.limit(0), cell_rows).count() == len(notes)
    assert asof.all_pairs(n.limit(0), d, cell_rows).count() == 0


def test_a_hot_patient_is_cut_into_cells(spark):
    _, _, n, d = tables(spark, 600, 500, 3)
    split = {r["EMPI"]: (r["_rows"], r["_columns"]) for r in asof.split_patients(n, d, 50).collect()}
    assert split[7][0] >= 4 and split[7][1] >= 4 and None not in split
    assert asof.split_patients(n, d, 10_000).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_nearest_over_range_edges(spark, seed):
    notes, dx, n, d = tables(spark, 200, 60, seed)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged = asof.events_by_time(n, d)
        assert ranged.where("EMPI = 7").agg(F.count_distinct("_range")).first()[0] > 1
        got = {r["Report_Number"]: (r["Date"], r["Code"], r["Encounter_number"], r["Name"], r["diff_days"]) for r in asof.nearest(n, d).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    exp = {}
    for empi, number, at, _ in notes:
        mine = [(abs(at - y[1]), y[1], y[2], y[3], y[4]) for y in dx if empi is not None and at and y[1] and y[0] == empi]
        if mine:
            best = min(mine)
            exp[number] = (*best[1:], (at - best[1]) / timedelta(days=1))
    assert got == exp and exp
    assert asof.nearest(n, d.limit(0)).count() == 0


def test_nearest_reads_each_table_once(spark):
    import re
    notes, dx = catalog._cohort(spark, SF001), catalog._families(spark, SF001)
    caught = []
    real = type(notes).checkpoint
    try:
        type(notes).checkpoint = lambda self, eager=True: caught.append(self) or real(self, eager)
        asof.nearest(notes, dx).count()
    finally:
        type(notes).checkpoint = real
    plan = caught[0]._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert len(re.findall(r"FileScan", plan)) == 2
