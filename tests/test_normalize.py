"""K-rules on hand-worked values (each expected value worked out from the reference's rules)."""

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import normalize as N


def _run(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "s string")
    return [r[0] for r in df.select(fn(F.col("s"))).collect()]


def test_blood_loss_prediction(spark):
    vals = ["1200 cc.", "800ml", "2 liters", "EBL 500-800 cc", "one liter", "50", "<1000", "1,200 ml",
            "One liter", "0.5 L", "1-1/2 liters", "ebl: 300", "ebl:300"]
    # "ebl: 300": exactly one character may sit between "ebl" and the number (the reference's
    # f-string turns ".{1,7}?" into ".(1, 7)?"), so ": " is one too many and nothing is found.
    exp = ["1200.0", "800.0", "2000.0", "800.0", "1000.0", "", "1000.0", "1200.0", "", "", "1500.0", "", "300.0"]
    assert _run(spark, N.clean_blood_loss, vals) == exp


def test_blood_loss_annotation_keeps_two_digits(spark):
    assert _run(spark, lambda c: N.clean_blood_loss(c, "annotation"), ["50"]) == ["50.0"]


def test_times(spark):
    vals = ["10:15 PM", "1015", "930", "12:05 AM", "5 PM", "25:00", "12"]
    assert _run(spark, N.clean_time, vals) == ["22:15:00", "10:15:00", "09:30:00", "00:05:00", "17:00:00", None, None]


def test_time_of_delivery(spark):
    assert _run(spark, N.clean_time_of_delivery, ["delivered on 3/5/2014 at 10:15 PM"]) == ["22:15:00"]


def test_dates(spark):
    vals = ["03/04/2014", "3/5/14", "March 5", "5/13", "2/30", "13/2014", "march 5, 2014", "5 march"]
    exp = ["2014-03-04", "2014-03-05", "03-05", "05-13", "02-2030", "13/2014", "2014-03-05", "03-05"]
    assert _run(spark, N.clean_date, vals) == exp


def test_two_digit_year_pivot(spark):
    assert _run(spark, N.clean_date, ["1/2/85", "1/2/68"]) == ["1985-01-02", "2068-01-02"]


def test_small_cleaners(spark):
    assert _run(spark, N.clean_transfusion_amount, ["two units", "3 units of prbc", "no number", "none"]) == ["two", "3", "", "one"]
    assert _run(spark, N.clean_laceration_grade, ["2nd degree", "second degree", "severe"]) == ["2", "second", ""]
    assert _run(spark, N.clean_gestational_age, ["39 weeks", "term"]) == ["39", ""]
    assert _run(spark, N.clean_transfusion_type, ["2 units prbc", "saline"]) == ["prbc", ""]
    assert _run(spark, N.clean_laceration_anatomy, ["second degree perineal, 2"]) == ["perineal"]


def test_clean_predictions_splits_multi_values(spark):
    df = spark.createDataFrame([(["1200 cc", "EBL 500-800 cc", "unrelated"],)], "p array<string>")
    out = df.select(N.clean_predictions("estimated blood loss", F.col("p"))).collect()[0][0]
    assert out == ["1200.0", "800.0"]


@pytest.mark.parametrize("s,exp", [("1/2", 0.5), ("1 1/2", 1.5), ("-1 1/2", -1.5), ("3/4/2014", None), ("1,5", 15.0)])
def test_fractions(spark, s, exp):
    assert _run(spark, N.frac_to_float, [s]) == [exp]


def test_large_blood_loss_has_no_exponent(spark):
    vals = ["10000000", "ebl 12345678", "1200"]
    assert _run(spark, N.clean_blood_loss, vals) == ["10000000.0", "12345678.0", "1200.0"]


def test_lenient_blood_loss(spark):
    assert _run(spark, lambda c: N.clean_blood_loss(c, lenient=True), ["ebl: 300", "ebl is 450", ""]) == ["300.0", "450.0", ""]


def test_lines_and_spaces_follow_python(spark):
    from cohortlens.functions.regex import java_regex
    df = spark.createDataFrame([("placenta\u00a0previa",), ("placenta\rprevia",)], "s string")
    assert [r[0] for r in df.select(F.col("s").rlike(java_regex(r"placenta\s*previa"))).collect()] == [True, True]
    assert _run(spark, N.clean_blood_loss, ["300\rebl", "300\nebl"]) == ["300.0", ""]


def test_column_label_with_any_date(spark):
    df = spark.createDataFrame([("3/5/14", "date of admission"), (" x ", "other")], "s string, l string")
    assert [r[0] for r in df.select(N.clean_str(F.col("s"), F.col("l"))).collect()] == ["2014-03-05", "x"]
