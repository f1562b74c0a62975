"""Regex rule classification of notes.

One Arrow pass with an automaton tells for each note which rules it can match at all
(:mod:`cohortlens.operators.rule_index`); only those run, as ``rlike`` in the JVM. All flags are made in one projection
and turned into the long (key, label, prediction) form with one explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.regex import java_regex
from cohortlens.functions.rules import BINARY_RULE_LABELS, LABEL_RULES
from cohortlens.operators.rule_index import MOST_RULES, may_match, possible_rules

PRED_KEY = ["Report_Number", "EMPI", "Report_Date_Time", "MRN_Type"]


def rule_match(label: str, text: str | Column = "Report_Text", rules: dict[str, str] | None = None) -> Column:
    """0/1 flag: does the case-insensitive rule of ``label`` match anywhere in ``text``."""
    rules = rules or LABEL_RULES
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(t.rlike(java_regex(rules[label], ignore_case=True)), F.lit(False)).cast("int")


def _flags(notes: DataFrame, labels: list[str], text: str, key: list[str], rules: dict[str, str]) -> tuple[DataFrame, list[Column]]:
    """Notes with the mask of the rules that they may match, and the flag of each label: its rule runs if its bit is set."""
    groups = [labels[i:i + MOST_RULES] for i in range(0, len(labels), MOST_RULES)]
    masked = notes.select(*key, text, *[possible_rules(F.col(text), [rules[x] for x in g]).alias(f"_mask{i}")
                                        for i, g in enumerate(groups)])
    flags = [F.when(may_match(F.col(f"_mask{i}"), bit), rule_match(x, text, rules)).otherwise(0)
             for i, g in enumerate(groups) for bit, x in enumerate(g)]
    return masked, flags


def rule_predictions(notes: DataFrame, labels: list[str] | None = None, text: str = "Report_Text",
                     key: list[str] | None = None, rules: dict[str, str] | None = None) -> DataFrame:
    """Long-form binary predictions: ``key + [label, prediction]`` for every note and label."""
    labels = labels or BINARY_RULE_LABELS
    key = [c for c in (key or PRED_KEY) if c in notes.columns]
    masked, flags = _flags(notes, labels, text, key, rules or LABEL_RULES)
    rows = F.array(*[F.struct(F.lit(x).alias("label"), f.alias("prediction")) for x, f in zip(labels, flags, strict=True)])
    return masked.select(*key, F.inline(rows))


def rule_predictions_wide(notes: DataFrame, labels: list[str] | None = None, text: str = "Report_Text",
                          key: list[str] | None = None) -> DataFrame:
    """Same predictions, one column per label (sink-side pivot without a shuffle)."""
    labels = labels or BINARY_RULE_LABELS
    key = [c for c in (key or PRED_KEY) if c in notes.columns]
    masked, flags = _flags(notes, labels, text, key, LABEL_RULES)
    return masked.select(*key, *[f.alias(x) for x, f in zip(labels, flags, strict=True)])
