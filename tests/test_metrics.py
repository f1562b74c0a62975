"""Binary and extraction metrics on hand-worked confusion tables."""

import pytest

from cohortlens.operators import labels as L
from cohortlens.operators import metrics as M
from cohortlens.operators import phenotype as P


def _df(spark, pairs, label="x"):
    return spark.createDataFrame([(label, y, p) for y, p in pairs], "label string, y int, prediction int")


def test_two_class(spark):
    r = M.binary_metrics(_df(spark, [(1, 1), (1, 0), (0, 0), (0, 0), (0, 1)])).collect()[0]
    assert (r.tp, r.tn, r.fp, r.fn, r.n) == (1, 2, 1, 1, 2)
    assert r.acc == pytest.approx(0.6) and r.micro_f1 == pytest.approx(0.6)
    assert r.binary_f1 == pytest.approx(0.5)
    assert r.macro_f1 == pytest.approx((0.5 + 2 * 2 / (2 * 2 + 2)) / 2)
    assert r.precision == pytest.approx(0.5) and r.recall == pytest.approx(0.5)
    assert r.specificity == pytest.approx(2 / 3) and r.NPV == pytest.approx(2 / 3)


def test_single_class_gives_minus_one(spark):
    r = M.binary_metrics(_df(spark, [(0, 0), (0, 0)])).collect()[0]
    assert (r.tp, r.tn, r.fp, r.fn, r.n) == (-1, -1, -1, -1, -2)
    assert r.precision == -1 and r.specificity == -1 and r.NPV == -1
    assert r.acc == 1.0 and r.macro_f1 == 1.0 and r.binary_f1 == 0.0 and r.recall == 0.0


def test_ie_metrics(spark):
    df = spark.createDataFrame([(["800.0", "800.0"], ["800.0"]), (["1200.0"], []), ([], ["500.0"])],
                               "spans array<string>, clean_predictions array<string>")
    r = M.ie_metrics(df).collect()[0]
    # found 1 of 3 gold spans; 1 of 2 predictions; complete recall only for the empty-gold note
    assert r.recall_labels == pytest.approx(1 / 3) and r.precision_labels == pytest.approx(1 / 2)
    assert r.recall_notes == pytest.approx(1 / 3) and r.exact_match_notes == pytest.approx(1 / 3)
    assert r.total_notes_with_true_annotation == 2


def test_stored_gold_labels_are_not_broadcast(spark, tmp_path):
    key = ["Report_Number", "EMPI"]
    rows = spark.range(2000).selectExpr("concat('n', id) AS Report_Number", "id % 7 AS EMPI", "explode(array('a', 'b', 'c')) AS label")
    rows.selectExpr("*", "CAST(EMPI = 3 AS int) AS y").write.parquet(str(tmp_path / "gold"))
    rows.where("EMPI > 2").selectExpr("*", "CAST(label = 'a' AS int) AS prediction").write.parquet(str(tmp_path / "preds"))
    gold, preds = spark.read.parquet(str(tmp_path / "gold")), spark.read.parquet(str(tmp_path / "preds"))
    wide = preds.withColumnRenamed("label", "concept").selectExpr("*", "TIMESTAMP_NTZ '2014-01-01' AS Report_Date_Time")
    stamped = gold.selectExpr("*", "TIMESTAMP_NTZ '2014-01-01' AS Report_Date_Time")
    for found in (L.against_gold(preds, gold, [*key, "label"]), P.composites_against_gold(wide, stamped, {"accreta_composite": "a"})):
        assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    got = M.binary_metrics(L.against_gold(preds, gold, [*key, "label"])).collect()
    seen = [i % 7 for i in range(2000) if i % 7 > 2]
    assert {(r.label, r.tp + r.fn, r.tp) for r in got if r.label == "a"} == {("a", seen.count(3), seen.count(3))}
    assert sorted(r.label for r in got) == ["a", "b", "c"]
