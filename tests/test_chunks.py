"""Chunks as offset ranges, and runs that are interrupted and started again."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions.concepts import CONCEPT_RULES, CONCEPT_RUNS
from cohortlens.operators import chunks, predict, resume
from cohortlens.plans import catalog
from tests.conftest import SF001

KEY = "Report_Number string, EMPI long, Report_Date_Time timestamp_ntz, MRN_Type string"
RUNS = {c: CONCEPT_RUNS[c] for c in ("csection", "accreta")}
TOKENIZER = chunks.RegexTokenizer()


def brute_ranges(spans, budget, stride):
    """Windows of ``budget`` tokens, ``budget - stride`` apart, up to the first that holds the last token."""
    starts = [0]
    while starts[-1] + budget < len(spans):
        starts.append(starts[-1] + budget - stride)
    return [(spans[s][0], spans[min(s + budget, len(spans)) - 1][1] - spans[s][0]) for s in starts] if spans else [(0, 0)]


@pytest.mark.parametrize("n", [0, 1, 199, 200, 201, 272, 273, 1000])
def test_ranges_cover_the_note_and_overlap(n):
    spans = [(3 * i, 3 * i + 2) for i in range(n)]
    assert chunks.ranges_of(spans, 200, 128) == brute_ranges(spans, 200, 128)


@pytest.mark.parametrize("note_first", [False, True])
@pytest.mark.parametrize("kind", ["regex", "file"])
def test_every_chunk_is_a_substring(spark, kind, note_first):
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("word_bpe_49k.json")
    tokenizer = chunks.RegexTokenizer(model_max_length=300) if kind == "regex" else chunks.FileTokenizer(path, 300)
    notes = catalog._cohort(spark, SF001)
    extra = spark.createDataFrame([("e", 1, None, None, ""), ("s", 2, None, None, " \n "), ("n", 3, None, None, None),
                                   ("l", 4, None, None, "é\U0001f600 übel. " * 3000)], f"{KEY}, Report_Text string")
    notes = notes.select(extra.columns).unionByName(extra)
    prompt = "Was there a c-section? Answer yes or no."
    budget = chunks.note_budget(prompt, tokenizer, 400, 128, note_first)
    assert budget == (300 if note_first else 400) - tokenizer.marks - len(tokenizer.offsets([prompt])[0])
    got = {}
    for r in chunks.chunk_notes_offsets(notes, prompt, tokenizer, 400, 128, note_first).collect():
        got.setdefault((r.Report_Number, r.EMPI, r.Report_Date_Time), []).append(r)
    texts = {(r.Report_Number, r.EMPI, r.Report_Date_Time): r.Report_Text for r in notes.collect()}
    assert set(got) == {k for k, t in texts.items() if t is not None}
    for k, rows in got.items():
        rows.sort(key=lambda r: r.chunk_idx)
        spans = tokenizer.offsets([texts[k]])[0]
        assert [(r.start, r.length) for r in rows] == brute_ranges(spans, budget, 128)
        assert all(r.chunk_text == texts[k][r.start:r.start + r.length] and r.n_tokens == len(spans) for r in rows)


class FewAtATime(chunks.RegexTokenizer):
    """Refuses more than a part of a batch, unless it is one note."""

    def offsets(self, texts):
        assert len(texts) <= chunks.PART_NOTES
        assert len(texts) <= 1 or sum(len(t.encode()) for t in texts) <= 256 << 10
        return super().offsets(texts)


def test_a_batch_is_tokenized_in_parts_of_bounded_bytes(spark):
    texts = ["", None, "é word 12 " * 30_000, *["some words here " * 4000] * 40, None, *["short one"] * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").coalesce(1)
    got = {r.id: r.c for r in df.select("id", chunks.chunk_ranges(F.col("t"), FewAtATime(), [300, 200]).alias("c")).collect()}
    assert [got[i] is None for i in range(len(texts))] == [t is None for t in texts]
    for i in (0, 2, 3, 42, 44):
        spans = TOKENIZER.offsets([texts[i]])[0]
        assert [(r.budget, r.start, r.length) for r in got[i]] == [(b, *x) for b in (200, 300) for x in brute_ranges(spans, b, 128)]


def test_a_long_prompt_is_an_error():
    with pytest.raises(ValueError, match="no room"):
        chunks.note_budget("word " * 500, TOKENIZER)


def asked(folder):
    return sorted(line for f in folder.glob("*") for line in f.read_text().splitlines())


class Counting:
    """Answers by rule, writes down what it was asked, and fails on chunks that hold ``poison``."""

    def __init__(self, folder, poison=None):
        self.folder, self.poison = str(folder), poison

    def model(self):
        folder, poison = self.folder, self.poison

        def ask(prompts: pd.Series, texts: pd.Series) -> pd.Series:
            import os
            import uuid
            if poison and texts.str.contains(poison).any():
                raise RuntimeError("the model is gone")
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.writelines(f"{p[:40]}|{t}\n" for p, t in zip(prompts, texts.str.replace("\n", " "), strict=True))
            return texts.map(lambda t: "Yes" if "section" in t else "No")
        return predict.BatchModel(ask)


def small_notes(spark, n=12):
    rows = [(f"r{i}", None if i == 3 else i, None, None if i % 2 else "BWH", f"note {i}: " + ("section " if i % 3 else "") + "word " * 700)
            for i in range(n)]
    return spark.createDataFrame(rows, f"{KEY}, Report_Text string")


def rows_of(df):
    return sorted(map(str, df.select("Report_Number", "EMPI", "MRN_Type", "run", "raw_preds", "predictions").collect()))


def test_interrupted_run_equals_one_run_and_asks_nothing_twice(spark, tmp_path):
    notes = small_notes(spark)
    for d in ("whole", "first", "second", "third"):
        (tmp_path / d).mkdir()
    whole = resume.run_unlabelled(notes, RUNS, Counting(tmp_path / "whole").model(), str(tmp_path / "a"), TOKENIZER, parts=8, waves=4)
    path = str(tmp_path / "b")
    assert resume.answer_waves(notes, RUNS, Counting(tmp_path / "first").model(), path, TOKENIZER, parts=8, waves=4, stop_after=2) == 2
    again = resume.run_unlabelled(notes, RUNS, Counting(tmp_path / "second").model(), path, TOKENIZER, parts=8, waves=4)
    assert rows_of(again) == rows_of(whole) and len(rows_of(whole)) == 24
    first, second = asked(tmp_path / "first"), asked(tmp_path / "second")
    assert first and second and sorted(first + second) == asked(tmp_path / "whole")
    third = resume.run_unlabelled(notes, RUNS, Counting(tmp_path / "third").model(), path, TOKENIZER, parts=8, waves=4)
    assert rows_of(third) == rows_of(whole) and asked(tmp_path / "third") == []


def test_a_run_that_dies_goes_on_where_it_was(spark, tmp_path):
    notes, path = small_notes(spark), str(tmp_path / "b")
    (tmp_path / "log").mkdir()
    with pytest.raises(Exception, match="the model is gone"):
        resume.answer_waves(notes, RUNS, Counting(tmp_path / "log", poison="note 7:").model(), path, TOKENIZER, parts=12, waves=12)
    before = resume.read_answers(spark, path, KEY).count()
    found = resume.run_unlabelled(notes, RUNS, Counting(tmp_path / "log").model(), path, TOKENIZER, parts=12, waves=12)
    one = resume.run_unlabelled(notes, RUNS, Counting(tmp_path / "log").model(), str(tmp_path / "c"), TOKENIZER, parts=12, waves=12)
    assert rows_of(found) == rows_of(one)
    answers = resume.read_answers(spark, path, KEY)
    assert 0 < before < answers.count()
    assert answers.groupBy("Report_Number", "run", "chunk_idx").count().where("count > 1").count() == 0


def test_new_notes_and_new_runs_are_added(spark, tmp_path):
    path, model = str(tmp_path / "b"), predict.RuleModel(rules={c: CONCEPT_RULES[c] for c in RUNS})
    resume.run_unlabelled(small_notes(spark, 5), {"csection": RUNS["csection"]}, model, path, TOKENIZER, parts=4, waves=2)
    found = resume.run_unlabelled(small_notes(spark, 9), RUNS, model, path, TOKENIZER, parts=4, waves=2)
    whole = resume.run_unlabelled(small_notes(spark, 9), RUNS, model, str(tmp_path / "c"), TOKENIZER, parts=4, waves=2)
    assert rows_of(found) == rows_of(whole) and len(rows_of(found)) == 18
    none = resume.run_unlabelled(small_notes(spark, 9).limit(0), RUNS, model, str(tmp_path / "d"), TOKENIZER)
    assert none.count() == 0
