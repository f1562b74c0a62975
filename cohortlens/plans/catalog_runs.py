"""Queries over chunk ranges and resumable runs, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.concepts import CONCEPT_RULES, CONCEPT_RUNS
from cohortlens.functions.prompts import get_prompt
from cohortlens.operators import chunks, predict, resume
from cohortlens.plans import catalog, oracle

TOKENIZER = chunks.RegexTokenizer()
#: The note before the prompt: the model's own length holds, here a shorter one, so that the two orders differ.
NOTE_FIRST_TOKENIZER = chunks.RegexTokenizer(model_max_length=384)


def q_chunk_notes_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: sub-word chunks of every cohort note as offset ranges, prompt first and note first."""
    prompt = get_prompt(*catalog.CHUNK_RUN)[0]
    notes = catalog._cohort(spark, sf_dir)
    parts = []
    for first, tokenizer in ((False, TOKENIZER), (True, NOTE_FIRST_TOKENIZER)):
        c = chunks.chunk_notes_offsets(notes, prompt, tokenizer, note_first=first)
        parts.append(c.select(*predict.PRED_KEY, F.lit(first).alias("note_first"), "chunk_idx", "n_tokens", "start", "length",
                              F.md5(chunks.model_input(F.lit(prompt), F.col("chunk_text"), first)).alias("input_md5")))
    return parts[0].unionByName(parts[1])


def q_predictions_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: the concept runs over all cohort notes, stopped after half of the waves, started again, and read as written."""
    path, notes = catalog._scratch(spark, "unlabelled"), catalog._cohort(spark, sf_dir)
    model = predict.RuleModel(rules=dict(CONCEPT_RULES))
    resume.answer_waves(notes, dict(CONCEPT_RUNS), model, path, TOKENIZER, parts=4, waves=2, stop_after=1)
    found = resume.run_unlabelled(notes, dict(CONCEPT_RUNS), model, path, TOKENIZER, parts=4, waves=2)
    return found.select(*predict.PRED_KEY, "run", "label", "prompt_desc", "prediction_type", "predictions",
                        F.array_join("raw_preds", "|").alias("raw_preds"), F.size("raw_preds").cast("long").alias("n_chunks"))


QUERIES = {"chunk_notes_offsets": q_chunk_notes_offsets, "predictions_resumed": q_predictions_resumed}


# --- DuckDB SQL ---------------------------------------------------------------------------------------------------
_SPACE = r"[\x20\x09-\x0D]*"


def _token_ctes() -> str:
    """toks: a row per token of each cohort note, with its characters; sized: notes with their number of tokens."""
    rx = oracle._sql_str(f"{_SPACE}({TOKENIZER.pattern})")
    return f"""
numbered AS (SELECT *, row_number() OVER () AS nid FROM cohort),
pieces AS (
  SELECT nid, generate_subscripts(f, 1) AS i, unnest(f) AS f, unnest(w) AS w
  FROM (SELECT nid, regexp_extract_all(Report_Text, {rx}, 0) AS f, regexp_extract_all(Report_Text, {rx}, 1) AS w FROM numbered)),
toks AS (
  SELECT nid, i - 1 AS tok, sum(length(f)) OVER (PARTITION BY nid ORDER BY i) AS stop_, length(w) AS size_ FROM pieces),
sized AS (SELECT n.nid, count(t.tok) AS n_tokens FROM numbered n LEFT JOIN toks t USING (nid) GROUP BY n.nid)"""


def _range_ctes(budgets: str) -> str:
    """rng: nid, budget, chunk_idx, start, length from ``budgets`` (a relation with a column budget)."""
    return f"""
cks AS (
  SELECT s.nid, s.n_tokens, b.budget, k.k AS chunk_idx, k.k * (b.budget - 128) AS lo,
         least(k.k * (b.budget - 128) + b.budget, s.n_tokens) - 1 AS hi
  FROM sized s CROSS JOIN {budgets} b,
       unnest(range(0, 1 + CASE WHEN s.n_tokens > b.budget
                                THEN CAST(ceil((s.n_tokens - b.budget) / (b.budget - 128)::DOUBLE) AS BIGINT) ELSE 0 END)) AS k(k)),
rng AS (
  SELECT c.nid, c.n_tokens, c.budget, c.chunk_idx, CAST(coalesce(a.stop_ - a.size_, 0) AS BIGINT) AS start,
         CAST(coalesce(z.stop_ - a.stop_ + a.size_, 0) AS BIGINT) AS length
  FROM cks c LEFT JOIN toks a ON a.nid = c.nid AND a.tok = c.lo LEFT JOIN toks z ON z.nid = c.nid AND z.tok = c.hi)"""


def chunk_notes_offsets_sql() -> str:
    prompt = get_prompt(*catalog.CHUNK_RUN)[0]
    p = oracle._sql_str(prompt)
    both = ", ".join(f"({chunks.note_budget(prompt, t, note_first=f)}, {str(f).lower()})"
                     for f, t in ((False, TOKENIZER), (True, NOTE_FIRST_TOKENIZER)))
    return oracle.with_fixtures(oracle.cohort_ctes(), _token_ctes(), f"orders(budget, note_first) AS (VALUES {both})",
                                _range_ctes("orders"), select=f"""
SELECT n.Report_Number, n.EMPI, n.Report_Date_Time, n.MRN_Type, o.note_first, CAST(r.chunk_idx AS INTEGER) AS chunk_idx,
  CAST(r.n_tokens AS INTEGER) AS n_tokens, CAST(r.start AS INTEGER) AS start, CAST(r.length AS INTEGER) AS length,
  md5(CASE WHEN o.note_first THEN substring(n.Report_Text, r.start + 1, r.length) || chr(10) || {p}
           ELSE {p} || chr(10) || substring(n.Report_Text, r.start + 1, r.length) END) AS input_md5
FROM rng r JOIN numbered n USING (nid) JOIN orders o ON o.budget = r.budget""")


def predictions_resumed_sql() -> str:
    rows = []
    for c, (label, desc) in CONCEPT_RUNS.items():
        prompt, kind = get_prompt(label, desc)
        rows.append("(" + ", ".join(map(oracle._sql_str, (c, label, desc, kind))) + f", {chunks.note_budget(prompt, TOKENIZER)})")
    whens = " ".join(f"WHEN {oracle._sql_str(c)} THEN {oracle.duck_pattern(CONCEPT_RULES[c], 'ch.chunk_text')}" for c in CONCEPT_RUNS)
    return oracle.with_fixtures(oracle.cohort_ctes(), _token_ctes(), f"""
runs(run, label, prompt_desc, prediction_type, budget) AS (VALUES {", ".join(rows)})""",
                                _range_ctes("(SELECT DISTINCT budget FROM runs)"), f"""
texts AS (SELECT r.*, substring(n.Report_Text, r.start + 1, r.length) AS chunk_text FROM rng r JOIN numbered n USING (nid)),
chx AS (SELECT *, {oracle.positional_split_cols('chunk_text')} FROM texts),
ans AS (SELECT ch.nid, ch.chunk_idx, r.run, r.label, r.prompt_desc, r.prediction_type,
        CASE WHEN (CASE r.run {whens} END) THEN 'Yes' ELSE 'No' END AS answer
  FROM chx ch JOIN runs r ON r.budget = ch.budget)""", select="""
SELECT n.Report_Number, n.EMPI, n.Report_Date_Time, n.MRN_Type, run, label, prompt_desc, prediction_type,
  CAST(max(CASE WHEN answer = 'Yes' THEN 1 ELSE 0 END) AS INTEGER) AS predictions,
  string_agg(answer, '|' ORDER BY chunk_idx) AS raw_preds, count(*) AS n_chunks
FROM ans JOIN numbered n USING (nid)
GROUP BY n.nid, n.Report_Number, n.EMPI, n.Report_Date_Time, n.MRN_Type, run, label, prompt_desc, prediction_type""")


ORACLE = {"chunk_notes_offsets": chunk_notes_offsets_sql, "predictions_resumed": predictions_resumed_sql}
