"""Chunked batch prediction with a pluggable model.

Plan: notes -> token arrays -> overlapping chunks (one row per chunk, exploded inside the scan
stage) -> answer per chunk -> gather answers per note (chunk order kept) -> note prediction.

* Chunking is native: whitespace tokens (``split``), chunk starts from ``sequence`` and
  ``slice``. The note is truncated, never the prompt; the token budget is
  ``max_length - prompt tokens`` and consecutive chunks overlap by ``stride`` tokens.
* Models: :class:`RuleModel` (default, offline) answers with the concept's rule as a JVM
  ``rlike`` per chunk, so the default path has no Python at all; :class:`BatchModel` wraps any
  Python callable ``f(prompts: pd.Series, chunks: pd.Series) -> pd.Series`` of answers and runs
  it through an Arrow ``pandas_udf`` (batched, one model load per Python worker), which is where
  a real language model plugs in.
* Chunk rows are repartitioned before the model so long notes (many chunks) spread over tasks.
* The per-note gather is bounded by the number of chunks of one note.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.prompts import get_prompt
from cohortlens.functions.regex import java_regex

PRED_KEY = ["Report_Number", "EMPI", "Report_Date_Time", "MRN_Type"]
MAX_LENGTH = 512
STRIDE = 128
YES = ["Yes", "yes"]
UNANSWERABLE = "unanswerable"


def whitespace_tokens(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")


def prompt_tokens(prompt: str) -> int:
    return len(prompt.split())


def chunk_column(tokens: Column, budget: Column | int, stride: int = STRIDE) -> Column:
    """Array of (chunk_idx, chunk_text) covering ``tokens`` with ``budget``-token windows
    overlapping by ``stride``."""
    b = budget if isinstance(budget, Column) else F.lit(budget)
    step = b - F.lit(stride)
    n = F.size(tokens)
    k = F.when(n <= b, F.lit(1)).otherwise(F.lit(1) + F.ceil((n - b) / step).cast("int"))
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(
        i.alias("chunk_idx"),
        F.array_join(F.slice(tokens, i * step + 1, b), " ").alias("chunk_text")))


def chunk_notes(notes: DataFrame, budget: int | str, text: str = "Report_Text",
                key: list[str] | None = None, stride: int = STRIDE) -> DataFrame:
    """M3: one row per chunk: ``key + [chunk_idx, n_tokens, chunk_text]``. ``budget`` is a token
    count or the name of a column holding it."""
    key = [c for c in (key or PRED_KEY) if c in notes.columns]
    b = F.col(budget) if isinstance(budget, str) else F.lit(budget)
    if isinstance(budget, int) and budget <= stride:
        raise ValueError("token budget must exceed the stride")
    extra = [budget] if isinstance(budget, str) else []
    t = notes.select(*key, *extra, whitespace_tokens(F.col(text)).alias("_tok"))
    return t.select(*key, *extra, F.size("_tok").alias("n_tokens"), F.inline(chunk_column(F.col("_tok"), b, stride)))


@dataclass(frozen=True)
class RuleModel:
    """Offline stand-in model: answers 'Yes' when the rule of the run matches the chunk."""
    rules: dict[str, str]           # run id -> Python-syntax rule (applied case-insensitively)

    def answer(self, run: Column, prompt: Column, chunk: Column) -> Column:
        out = F.lit(None).cast("string")
        for rid, pattern in self.rules.items():
            hit = chunk.rlike(java_regex(pattern, ignore_case=True))
            out = F.when(run == rid, F.when(hit, F.lit("Yes")).otherwise(F.lit("No"))).otherwise(out)
        return out


@dataclass(frozen=True)
class ExtractRuleModel:
    """Offline stand-in for extraction prompts: answers with the first text the run's rule matches
    in the chunk, else 'unanswerable'."""
    rules: dict[str, str]

    def answer(self, run: Column, prompt: Column, chunk: Column) -> Column:
        out = F.lit(None).cast("string")
        for rid, pattern in self.rules.items():
            rx = java_regex(pattern, ignore_case=True)
            got = F.when(chunk.rlike(rx), F.regexp_extract(chunk, rx, 0)).otherwise(F.lit(UNANSWERABLE))
            out = F.when(run == rid, got).otherwise(out)
        return out


@dataclass(frozen=True)
class BatchModel:
    """Pluggable Python model: ``predict(prompts, chunks) -> answers`` on pandas Series.

    ``load`` builds ``predict`` inside the Python worker, once for each partition that it serves, so a large model is
    never pickled into the plan. ``batch_size`` bounds the rows of a call (default: an Arrow batch)."""
    predict: Callable | None = None
    load: Callable[[], Callable] | None = None
    batch_size: int | None = None

    def answer(self, run: Column, prompt: Column, chunk: Column) -> Column:
        predict, load, size = self.predict, self.load, self.batch_size

        @F.pandas_udf("string")
        def _answer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            fn = load() if load else predict
            for prompts, chunks in batches:
                step = size or max(len(chunks), 1)
                parts = [pd.Series(fn(prompts.iloc[i:i + step], chunks.iloc[i:i + step])).astype("string")
                         for i in range(0, len(chunks), step)]
                yield pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype="string")

        return _answer(prompt, chunk)


def run_table(spark, runs: dict[str, tuple[str, str]], max_length: int = MAX_LENGTH) -> DataFrame:
    """Dimension of runs: run id, label, prompt_desc, prompt, prediction type, token budget.
    One row per requested run (bounded by the request), broadcast to the chunk stage."""
    rows = []
    for rid, (label, desc) in runs.items():
        prompt, ptype = get_prompt(label, desc)
        rows.append((rid, label, desc, prompt, ptype, max_length - prompt_tokens(prompt)))
    return spark.createDataFrame(rows, "run string, label string, prompt_desc string, prompt string, "
                                       "prediction_type string, budget int")


def predict_runs(notes: DataFrame, runs: dict[str, tuple[str, str]], model, max_length: int = MAX_LENGTH,
                 stride: int = STRIDE, text: str = "Report_Text", key: list[str] | None = None,
                 tokenize: Callable[[Column], Column] | None = None) -> DataFrame:
    """M4 + A7: per (note, run) the list of chunk answers in chunk order (``raw_preds``).

    A note is tokenised once (``tokenize``: text column -> array of tokens; default: by white space) and chunked in
    its row for each distinct token budget; the chunks meet the runs of their budget in the same stage. Only answers
    are shuffled, by note key and run; the run table joins behind."""
    key = [c for c in (key or PRED_KEY) if c in notes.columns]
    spark = notes.sparkSession
    rt = run_table(spark, runs, max_length)
    budgets = sorted({max_length - prompt_tokens(get_prompt(l, d)[0]) for l, d in runs.values()})
    if min(budgets) <= stride:
        raise ValueError("prompt leaves no room for the note at this max_length/stride")
    tokens = notes.select(*key, (tokenize or whitespace_tokens)(F.col(text)).alias("_tok"))

    def windows(b: int) -> Column:
        return F.transform(chunk_column(F.col("_tok"), b, stride), lambda c: F.struct(
            F.lit(b).alias("budget"), c["chunk_idx"].alias("chunk_idx"), c["chunk_text"].alias("chunk_text")))

    chunks = tokens.select(*key, F.inline(F.flatten(F.array(*[windows(b) for b in budgets]))))
    x = chunks.join(F.broadcast(rt.select("budget", "run", "prompt")), "budget", "inner")
    ans = x.withColumn("answer", model.answer(F.col("run"), F.col("prompt"), F.col("chunk_text")))
    return (ans.groupBy(*key, "run").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "answer"))).alias("_a"))
            .join(F.broadcast(rt.drop("budget")), "run")
            .select(*key, "run", "label", "prompt_desc", "prompt", "prediction_type",
                    F.transform("_a", lambda s: s["answer"]).alias("raw_preds")))


def binary_from_answers(raw: str | Column = "raw_preds") -> Column:
    """1 if any chunk answered exactly 'Yes' or 'yes'."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.exists(c, lambda a: a.isin(YES)).cast("int")


def extraction_from_answers(raw: str | Column = "raw_preds") -> Column:
    """A9 (first half): drop 'unanswerable', distinct and sorted."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.array_sort(F.array_distinct(F.filter(c, lambda a: a != UNANSWERABLE)))


def zero_shot(notes: DataFrame, runs: dict[str, tuple[str, str]], model, **kw) -> DataFrame:
    """M5/M6: predictions per (note, run); binary runs get ``predictions`` 0/1, extraction runs
    get the cleaned list in ``clean_predictions`` (see :func:`cohortlens.functions.normalize.clean_predictions`)."""
    from cohortlens.functions.normalize import clean_predictions
    out = predict_runs(notes, runs, model, **kw)
    preds = extraction_from_answers()
    clean = clean_predictions(F.col("label"), preds)
    return out.select(
        "*",
        F.when(F.col("prediction_type") == "binary", binary_from_answers()).alias("predictions"),
        F.when(F.col("prediction_type") == "extraction", preds).alias("extracted"),
        F.when(F.col("prediction_type") == "extraction", F.array_sort(F.array_distinct(clean)))
         .alias("clean_predictions"),
    )
