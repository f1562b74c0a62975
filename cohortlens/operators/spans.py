"""Regex pre-annotation with character offsets.

All rules run in one Arrow pass over the notes, and on a note only those whose literals it holds
(:mod:`cohortlens.operators.rule_index`): Spark has no function that returns the offset of a regex group, and
offsets built from split lengths cost the square of the number of matches. A pass is linear in the text for each rule,
and both kinds of rules see the same (Python) dialect. Multi-group rules give the first participating group.
Output: ``key + [start, end, cui]`` (0-based, half-open), one row per suggested span.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.rules import LABEL_ALIASES, SPAN_RULES
from cohortlens.operators.rule_index import possible

NOTE_KEY = ["EMPI", "Report_Number", "Report_Date_Time"]
SPAN_TYPE = "array<struct<start:int,end:int,cui:string>>"


def _cui(label: str) -> str:
    return LABEL_ALIASES.get(label, label)


def _has_lookaround(p: str) -> bool:
    return any(t in p for t in ("(?<!", "(?<=", "(?!", "(?="))


def single_rules(lookaround: bool | None = None) -> list[tuple[str, str]]:
    out = [(l, p) for l, p, n in SPAN_RULES if n == 1]
    if lookaround is not None:
        out = [(l, p) for l, p in out if _has_lookaround(p) == lookaround]
    return out


def multi_rules() -> list[tuple[str, str, int]]:
    return [(l, p, n) for l, p, n in SPAN_RULES if n > 1]


def single_group_spans(notes: DataFrame, rules: list[tuple[str, str]] | None = None, text: str = "Report_Text",
                       key: list[str] | None = None) -> DataFrame:
    """Spans of the rules whose one group is the whole match."""
    rules = rules if rules is not None else single_rules()
    return multi_group_spans(notes, [(label, p, 1) for label, p in rules], text, key)


def _multi_udf(rules: list[tuple[str, str, int]]):
    patterns = tuple(p for _, p, _ in rules)
    compiled = [(1 << i, re.compile(p, flags=re.IGNORECASE), _cui(l), n) for i, (l, p, n) in enumerate(rules)]

    @F.pandas_udf(SPAN_TYPE)
    def spans(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = []
            if isinstance(t, str):
                mask = possible(t, patterns)
                for bit, rx, cui, n in compiled:
                    for m in rx.finditer(t) if mask & bit else ():
                        g = next((i for i in range(1, n + 1) if m.group(i) is not None), None)
                        if g is not None:
                            s, e = m.span(g)
                            found.append({"start": s, "end": e, "cui": cui})
            out.append(found)
        return pd.Series(out)
    return spans


def multi_group_spans(notes: DataFrame, rules: list[tuple[str, str, int]] | None = None, text: str = "Report_Text",
                      key: list[str] | None = None) -> DataFrame:
    key = [c for c in (key or NOTE_KEY) if c in notes.columns]
    rules = rules if rules is not None else multi_rules()
    udf = _multi_udf(rules)
    return notes.filter(F.col(text).isNotNull()).select(*key, F.inline(udf(F.col(text))))


def preannotate(notes: DataFrame, text: str = "Report_Text", key: list[str] | None = None) -> DataFrame:
    """All 32 rules in one pass."""
    return multi_group_spans(notes, SPAN_RULES, text, key)
