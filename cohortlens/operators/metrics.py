"""Evaluation (A13-A20, U4, U5): one grouped aggregation per metric table, formulas as columns.

Binary metrics follow the reference's record: accuracy, micro/macro/binary F1, the guarded
precision (−1 with all four counts −1 when only one class occurs), recall_score recall,
specificity, NPV and n = tp + fn. Undefined ratios (0/0) are NULL (the reference writes NaN).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column, zero: float | None = 0.0) -> Column:
    r = num.cast("double") / den.cast("double")
    return F.when(den > 0, r).otherwise(F.lit(zero).cast("double"))


def confusion_counts(df: DataFrame, group: list[str], y: str = "y", pred: str = "prediction") -> DataFrame:
    """tp/tn/fp/fn per group in one pass."""
    yc, pc = F.col(y), F.col(pred)
    return df.groupBy(*group).agg(
        F.sum(((yc == 1) & (pc == 1)).cast("long")).alias("tp"),
        F.sum(((yc == 0) & (pc == 0)).cast("long")).alias("tn"),
        F.sum(((yc == 0) & (pc == 1)).cast("long")).alias("fp"),
        F.sum(((yc == 1) & (pc == 0)).cast("long")).alias("fn"),
    )


def binary_metrics(df: DataFrame, group: list[str] | None = None, y: str = "y", pred: str = "prediction") -> DataFrame:
    """A13-A18 per group (e.g. per label)."""
    group = group or ["label"]
    c = confusion_counts(df, group, y, pred)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    n_all = tp + tn + fp + fn
    pos_seen = (tp + fn + fp) > 0
    neg_seen = (tn + fp + fn) > 0
    f1_pos = _ratio(2 * tp, 2 * tp + fp + fn)
    f1_neg = _ratio(2 * tn, 2 * tn + fp + fn)
    two = pos_seen & neg_seen
    macro = F.when(two, (f1_pos + f1_neg) / 2).when(pos_seen, f1_pos).otherwise(f1_neg)
    acc = _ratio(tp + tn, n_all)
    neg1 = F.lit(-1).cast("double")
    return c.select(
        *group,
        acc.alias("acc"),
        acc.alias("micro_f1"),
        macro.alias("macro_f1"),
        f1_pos.alias("binary_f1"),
        F.when(two, _ratio(tp, tp + fp)).otherwise(neg1).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        F.when(two, _ratio(tn, tn + fp, None)).otherwise(neg1).alias("specificity"),
        F.when(two, _ratio(tn, tn + fn, None)).otherwise(neg1).alias("NPV"),
        *[F.when(two, F.col(x)).otherwise(F.lit(-1)).cast("long").alias(x) for x in ("tp", "tn", "fp", "fn")],
        F.when(two, tp + fn).otherwise(F.lit(-2)).cast("long").alias("n"),
    )


def class_report(df: DataFrame, group: list[str] | None = None, y: str = "y", pred: str = "prediction") -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted averages, over the
    classes present in either column."""
    group = group or ["label"]
    c = confusion_counts(df, group, y, pred)
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    classes = F.array(
        F.struct(F.lit("0").alias("cls"), tn.alias("hit"), (tn + fn).alias("npred"), (tn + fp).alias("ntrue")),
        F.struct(F.lit("1").alias("cls"), tp.alias("hit"), (tp + fp).alias("npred"), (tp + fn).alias("ntrue")))
    seen = F.filter(classes, lambda x: x["npred"] + x["ntrue"] > 0)
    per = F.transform(seen, lambda x: F.struct(
        x["cls"].alias("cls"), _ratio(x["hit"], x["npred"]).alias("precision"), _ratio(x["hit"], x["ntrue"]).alias("recall"),
        _ratio(2 * x["hit"], x["npred"] + x["ntrue"]).alias("f1_score"), x["ntrue"].cast("long").alias("support")))

    def total(field: str, weighted: bool = False) -> Column:
        values = F.transform("_per", lambda x: (x[field] * x["support"] if weighted else x[field]).cast("double"))
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)

    support = total("support").cast("long")
    scores = ["precision", "recall", "f1_score"]
    macro = F.struct(F.lit("macro avg").alias("cls"), *[(total(f) / F.size("_per")).alias(f) for f in scores],
                     support.alias("support"))
    weighted = F.struct(F.lit("weighted avg").alias("cls"), *[
        _ratio(total(f, True), support).alias(f) for f in scores], support.alias("support"))
    return c.select(*group, per.alias("_per")).select(*group, F.inline(F.concat("_per", F.array(macro, weighted))))


def ie_metrics(df: DataFrame, gold: str = "spans", pred: str = "clean_predictions",
               group: list[str] | None = None) -> DataFrame:
    """A20 (+U4/U5): label- and note-level extraction scores.

    Complete recall compares the size of the intersection of the two sets with the length of
    the gold list, as the reference does (duplicate gold spans never count as recalled)."""
    group = group or []
    g, p = F.col(gold), F.col(pred)
    inter = F.size(F.array_intersect(g, p))
    exact = (F.size(F.array_except(g, p)) == 0) & (F.size(F.array_except(p, g)) == 0)
    agg = df.groupBy(*group).agg(
        F.sum(inter).alias("found"), F.sum(F.size(g)).alias("n_gold"), F.sum(F.size(p)).alias("n_pred"),
        F.sum((inter == F.size(g)).cast("long")).alias("complete"),
        F.sum(exact.cast("long")).alias("exact"),
        F.sum((F.size(g) > 0).cast("long")).alias("with_gold"),
        F.count(F.lit(1)).alias("n_notes"))
    return agg.select(
        *group,
        _ratio(F.col("found"), F.col("n_gold"), None).alias("recall_labels"),
        _ratio(F.col("found"), F.col("n_pred"), None).alias("precision_labels"),
        _ratio(F.col("complete"), F.col("n_notes"), None).alias("recall_notes"),
        _ratio(F.col("exact"), F.col("n_notes"), None).alias("exact_match_notes"),
        F.col("with_gold").cast("long").alias("total_notes_with_true_annotation"),
    )


def distinct_sorted(col: str | Column) -> Column:
    """``np.unique`` of a list."""
    c = F.col(col) if isinstance(col, str) else col
    return F.array_sort(F.array_distinct(c))
