"""Runs over unlabelled notes that write what they have and can be started again (M6).

Notes are dealt into parts by the hash of their key, and parts are answered in waves; each wave is one job whose answers
are committed to ``path/answers/run=../part=../attempt=..`` by dynamic partition overwrite. A job that is submitted
twice writes the same partitions again instead of adding to them, and one that dies leaves the waves before it (and
whatever partitions it had committed) as they are.

A later call, after an interruption or with more notes or runs, asks the model only for chunks without an answer: the
answered chunks of a note are gathered by note key, joined to the notes of a wave, and taken out of the note's chunk
list before any chunk becomes a row. A wave without earlier answers needs no join and no shuffle.

Predictions of notes are then written to ``path/predictions/run=..``, again by dynamic overwrite of the runs concerned.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.prompts import get_prompt
from cohortlens.operators import predict
from cohortlens.operators.chunks import OffsetTokenizer, chunk_ranges, chunk_text, note_budget
from cohortlens.operators.predict import MAX_LENGTH, PRED_KEY, STRIDE
from cohortlens.sources.stage import path_exists

Runs = dict[str, tuple[str, str]]


def run_table(spark: SparkSession, runs: Runs, tokenizer: OffsetTokenizer, max_length: int = MAX_LENGTH,
              stride: int = STRIDE, note_first: bool = False) -> DataFrame:
    """run, label, prompt_desc, prompt, prediction_type, budget: a row per requested run."""
    rows = []
    for run, (label, desc) in runs.items():
        prompt, kind = get_prompt(label, desc)
        rows.append((run, label, desc, prompt, kind, note_budget(prompt, tokenizer, max_length, stride, note_first)))
    return spark.createDataFrame(rows, "run string, label string, prompt_desc string, prompt string, "
                                       "prediction_type string, budget int")


def read_answers(spark: SparkSession, path: str, key_schema: str) -> DataFrame | None:
    """All committed answers below ``path``: key, chunk_idx, answer, run, part, attempt; None before the first commit."""
    if not path_exists(spark, f"{path}/answers"):
        return None
    return spark.read.schema(f"{key_schema}, chunk_idx int, answer string, run string, part int, attempt int").parquet(
        f"{path}/answers")


def answer_waves(notes: DataFrame, runs: Runs, model, path: str, tokenizer: OffsetTokenizer, max_length: int = MAX_LENGTH,
                 stride: int = STRIDE, note_first: bool = False, text: str = "Report_Text", key: list[str] | None = None,
                 parts: int = 16, waves: int = 4, stop_after: int | None = None) -> int:
    """Answer every chunk of ``notes`` for every run that has no answer below ``path`` yet; how many waves were run.

    ``key`` must tell notes apart (nulls count as a value); notes without text have no chunk. ``parts`` and the
    tokenization must stay the same between calls for one ``path``. ``stop_after`` ends the call after so many waves."""
    spark = notes.sparkSession
    key = [c for c in (key or PRED_KEY) if c in notes.columns]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in notes.select(*key).schema)
    table = run_table(spark, runs, tokenizer, max_length, stride, note_first)
    per_budget: dict[int, list[str]] = {}
    for r in table.select("run", "budget").collect():  # a row per requested run
        per_budget.setdefault(r["budget"], []).append(r["run"])
    dealt = notes.where(F.col(text).isNotNull()).select(
        *key, F.col(text).alias("_text"), F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int").alias("part"))
    ranges = chunk_ranges(F.col("_text"), tokenizer, list(per_budget), stride)
    runs_of = F.create_map(*[x for b, names in per_budget.items() for x in (F.lit(b), F.array(*map(F.lit, names)))])
    wanted = F.flatten(F.transform(ranges, lambda c: F.transform(runs_of[c["budget"]], lambda r: F.struct(
        r.alias("run"), c["chunk_idx"].alias("chunk_idx"), c["start"].alias("start"), c["length"].alias("length")))))
    done = 0
    for wave in range(waves):
        if stop_after is not None and done >= stop_after:
            break
        mine = dealt.where(F.col("part") % waves == wave).withColumn("_wanted", wanted)
        before = read_answers(spark, path, schema)
        before = before.where((F.col("part") % waves == wave) & F.col("run").isin(list(runs))) if before is not None else None
        last = before.agg(F.max("attempt")).first()[0] if before is not None else None
        if last is not None:
            known = before.groupBy(*[F.col(c).alias(f"_key_{c}") for c in key]).agg(
                F.collect_set(F.struct("run", "chunk_idx")).alias("_known"))
            same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in key])
            mine = mine.join(known, same, "left").select(*key, "_text", "part", F.when(F.col("_known").isNull(), F.col("_wanted")).otherwise(F.filter(
                    "_wanted", lambda w: ~F.array_contains("_known", F.struct(w["run"], w["chunk_idx"])))).alias("_wanted"))
        cut = F.transform("_wanted", lambda w: F.struct(
            w["run"].alias("run"), w["chunk_idx"].alias("chunk_idx"),
            chunk_text(F.col("_text"), w["start"], w["length"]).alias("_chunk")))
        todo = mine.select(*key, "part", F.inline(cut)).join(F.broadcast(table.select("run", "prompt")), "run")
        answers = todo.withColumn("answer", model.answer(F.col("run"), F.col("prompt"), F.col("_chunk")))
        # answers are short: they are dealt by partition, so that each partition is one file and not one of every task
        answers.select(*key, "chunk_idx", "answer", "run", "part", F.lit((last or 0) + 1).alias("attempt")) \
            .repartition("run", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "part", "attempt") \
            .parquet(f"{path}/answers")
        done += 1
    return done


def note_predictions(answers: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """A7-A9 on stored answers: per note and run raw_preds (in chunk order) and predictions (0 or 1, extraction: null).

    A chunk that has several answers (two calls at once) keeps one of them, the least."""
    one = answers.groupBy(*key, "run", "chunk_idx").agg(F.min("answer").alias("answer"))
    raw = one.groupBy(*key, "run").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "answer"))).alias("_a"))
    out = raw.join(F.broadcast(table.drop("budget", "prompt")), "run").select(
        *key, "run", "label", "prompt_desc", "prediction_type", F.transform("_a", lambda a: a["answer"]).alias("raw_preds"))
    return out.withColumn("predictions", F.when(F.col("prediction_type") == "binary", predict.binary_from_answers()))


def run_unlabelled(notes: DataFrame, runs: Runs, model, path: str, tokenizer: OffsetTokenizer, key: list[str] | None = None,
                   max_length: int = MAX_LENGTH, stride: int = STRIDE, note_first: bool = False, **waves) -> DataFrame:
    """M6: answer what is not answered yet, write the predictions of ``runs``, and return them as they were written."""
    spark = notes.sparkSession
    key = [c for c in (key or PRED_KEY) if c in notes.columns]
    answer_waves(notes, runs, model, path, tokenizer, max_length, stride, note_first, key=key, **waves)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in notes.select(*key).schema)
    found = read_answers(spark, path, schema).where(F.col("run").isin(list(runs)))
    table = run_table(spark, runs, tokenizer, max_length, stride, note_first)
    out = note_predictions(found, table, key)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(f"{path}/predictions")
    return spark.read.schema(out.schema).parquet(f"{path}/predictions").where(F.col("run").isin(list(runs))).select(*out.columns)
