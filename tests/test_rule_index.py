"""No rule is missed by the literal index, and few are run for nothing."""

import random
import re

import pytest
from pyspark.sql import functions as F

from cohortlens.functions.rules import LABEL_RULES, SPAN_RULES
from cohortlens.operators import rule_index as ri
from cohortlens.operators import rules
from cohortlens.plans import catalog
from cohortlens.sources import fixtures as fx
from tests.conftest import SF001

PATTERNS = tuple(LABEL_RULES.values()) + tuple(p for _, p, _ in SPAN_RULES)


@pytest.mark.parametrize("pattern,literals", [
    ("abc", {"abc"}), ("(ab|cde)f*", {"ab", "cde"}), ("(ab|c*)", None), ("[ab]+", None), ("x(?:abc)?", {"x"}), ("(?<!no )(laceration)", {"laceration"}),
    ("a{2,3}bcd", {"bcd"}), (r"\d+ (?:ml|cc)", {"ml", "cc"}), ("ABC|(?:x|(?=abc))", None), ("é", None)])
def test_required_literals(pattern, literals):
    assert ri.required_literals(pattern) == (literals and frozenset(literals))


def test_every_rule_of_the_tables_needs_a_literal():
    assert all(ri.required_literals(p) for p in PATTERNS) and len(PATTERNS) <= ri.MOST_RULES


def test_no_match_is_missed():
    random.seed(8)
    compiled = [re.compile(p, re.IGNORECASE) for p in PATTERNS]
    words = [*fx.PHRASES, *[x for p in PATTERNS for x in ri.required_literals(p)], "placenta", "accreta", "no", "hx of", "12", "3/4/2014",
             "10:15 PM", "degree", "\n", "ſpontaneous vertex", "BAKRİ", "baKri", " ", "units", "of", "D and C", "39", "weeks", "lmp"]
    hits = 0
    for _ in range(3000):
        text = random.choice([" ", "", "  "]).join(random.choices(words, k=random.randint(1, 6)))
        text = random.choice([str, str.upper, str.title])(text)
        mask = ri.possible(text, PATTERNS)
        for i, rx in enumerate(compiled):
            if rx.search(text):
                hits += 1
                assert mask >> i & 1, (text, PATTERNS[i])
    assert hits > 5000


def test_masks_spare_most_rules(spark):
    notes = catalog._cohort(spark, SF001)
    masked = notes.select(ri.possible_rules(F.col("Report_Text"), list(PATTERNS)).alias("m"))
    assert masked.agg(F.avg(F.bit_count("m"))).first()[0] < 10
    assert ri.possible("nothing to see here", PATTERNS) == 0
    empty = spark.createDataFrame([(None,), ("",)], "t string").select(ri.possible_rules(F.col("t"), list(PATTERNS)).alias("m"))
    assert [r.m for r in empty.collect()] == [0, 0]


def test_guarded_rules_equal_plain_ones(spark):
    notes = catalog._cohort(spark, SF001)
    wide = rules.rule_predictions_wide(notes).select(*LABELS)
    plain = notes.select(*[rules.rule_match(x).alias(x) for x in LABELS])
    assert wide.exceptAll(plain).count() == 0 and wide.count() == plain.count()
    many = {f"{x}{i}": LABEL_RULES[x] for x in LABELS for i in range(3)}  # more rules than a mask holds
    got = rules.rule_predictions(notes, list(many), rules=many).groupBy("label").agg(F.sum("prediction").alias("n")).collect()
    exp = plain.agg(*[F.sum(x).alias(x) for x in LABELS]).first()
    assert {r.label: r.n for r in got} == {k: exp[k[:-1]] for k in many}


LABELS = rules.BINARY_RULE_LABELS
