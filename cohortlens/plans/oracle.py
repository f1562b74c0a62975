"""DuckDB oracle SQL: an independent, plain-SQL statement of every registered query.

The driver runs these on DuckDB against the same parquet tables and compares with the
Spark result. The fixture views are re-derived here in SQL (twin of
:mod:`cohortlens.sources.fixtures`); nothing is shared with the Spark code path except the
fixed literal values.
"""

from __future__ import annotations

from cohortlens.sources import fixtures as fx


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(_sql_str(v) for v in values) + "]"


def fixture_ctes() -> str:
    """CTEs: notes0 (one row per document), notes_v (raw export), dx_v, annot_raw."""
    phrases = _list(fx.PHRASES)
    codes = _list(fx.CODES)
    labs = ", ".join(f"({p}, {_sql_str(l)}, {_sql_str(s)})" for p, l, s in fx.PHRASE_LABELS)
    return f"""
keys0 AS (
  SELECT *, CASE WHEN doc_id % 97 = 5 THEN NULL WHEN doc_id % 10 = 3 THEN {fx.SKEWED_PATIENT}
                 ELSE doc_id // {fx.DOCS_PER_PATIENT} END AS EMPI FROM documents),
notes0 AS (
  SELECT d.doc_id,
    CAST(d.EMPI AS BIGINT) AS EMPI,
    'E' || CAST(d.EMPI AS VARCHAR) AS EPIC_PMRN,
    CASE WHEN d.doc_id % 31 = 0 THEN NULL WHEN d.EMPI % 3 = 0 THEN 'MGH'
         WHEN d.doc_id % 5 = 0 AND d.EMPI % 2 = 1 THEN 'MGH' ELSE 'BWH' END AS MRN_Type,
    CASE WHEN d.EMPI % 3 = 0 THEN 'MGH' ELSE 'BWH' END || '-' || CAST(d.EMPI AS VARCHAR) AS MRN,
    CASE WHEN d.doc_id % 89 <> 7 THEN CASE WHEN d.EMPI % 3 = 0 THEN 'MGH' ELSE 'BWH' END || '/'
         || CAST(d.doc_id // {fx.DOCS_PER_REPORT} AS VARCHAR) END AS Report_Number,
    CAST(DATE '{fx.BASE_DATE}' + CAST((d.doc_id * 37) % 700 AS INTEGER) AS TIMESTAMP)
      + to_hours(CAST((d.doc_id % 3) * 8 AS INTEGER)) AS Report_Date_Time,
    CASE d.doc_id % 11 WHEN 0 THEN 'ED Discharge Summary' WHEN 1 THEN 'ED Observation Discharge Summary'
         WHEN 2 THEN NULL ELSE 'Discharge Summary' END AS Report_Description,
    CASE WHEN d.doc_id % 7 = 0 THEN 'P' ELSE 'F' END AS Report_Status,
    'DS' AS Report_Type,
    CASE WHEN d.doc_id % 53 = 0 THEN NULL
         ELSE d.text || ' | ' || ({phrases})[CAST(d.doc_id % {len(fx.PHRASES)} AS INTEGER) + 1] END AS Report_Text
  FROM keys0 d),
notes_v AS (
  SELECT EMPI, EPIC_PMRN, MRN_Type, MRN, Report_Number, Report_Date_Time, Report_Description,
         Report_Status, Report_Type, Report_Text FROM notes0
  UNION ALL
  SELECT EMPI, EPIC_PMRN, MRN_Type, MRN, Report_Number, Report_Date_Time, Report_Description,
         Report_Status, Report_Type, Report_Text FROM notes0 WHERE doc_id % 25 = 0),
dx_v AS (
  SELECT e.user_id AS EMPI,
    CAST(DATE '{fx.BASE_DATE}' + CAST(CASE WHEN e.event_id % {fx.DATED_LIKE_A_NOTE} = 0
      THEN ((e.user_id * {fx.DOCS_PER_PATIENT} + e.event_id % {fx.DOCS_PER_PATIENT}) * 37) % 700
      ELSE (e.event_id * 13) % 700 END AS INTEGER) AS TIMESTAMP) AS Date,
    'Diagnosis ' || ({codes})[CAST(e.event_id % {len(fx.CODES)} AS INTEGER) + 1] AS Name,
    'ICD9' AS Code_Type,
    ({codes})[CAST(e.event_id % {len(fx.CODES)} AS INTEGER) + 1] AS Code,
    e.event_type AS Flag,
    CASE WHEN e.event_type IN ('purchase', 'signup') THEN 'Inpatient' ELSE 'Outpatient' END AS Inpatient_Outpatient,
    e.event_id AS Encounter_number
  FROM events e),
lab(pid, label_type, span) AS (VALUES {labs}),
annot_raw AS (
  SELECT n.doc_id, n.EMPI, replace(n.Report_Number, '/', '_') AS Report_Number, n.Report_Date_Time,
    CASE WHEN n.doc_id % 2 = 0 THEN 'annA' ELSE 'annB' END AS annotator,
    CASE WHEN n.doc_id % 17 = 0 THEN 'rejected' WHEN n.doc_id % 19 = 0 THEN 'undecided' ELSE 'accepted' END AS decision,
    l.label_type,
    CAST(length(n.Report_Text) - length(({phrases})[l.pid + 1]) + strpos(({phrases})[l.pid + 1], l.span) - 1 AS INTEGER) AS start,
    CAST(length(n.Report_Text) - length(({phrases})[l.pid + 1]) + strpos(({phrases})[l.pid + 1], l.span) - 1
         + length(l.span) AS INTEGER) AS "end",
    n.Report_Text
  FROM notes0 n JOIN lab l ON l.pid = n.doc_id % {len(fx.PHRASES)}
  WHERE n.Report_Text IS NOT NULL AND n.EMPI IS NOT NULL AND n.Report_Number IS NOT NULL)"""


def with_fixtures(*ctes: str, select: str) -> str:
    body = ",\n".join([fixture_ctes()] + [c for c in ctes if c])
    return f"WITH {body}\n{select}"


# --- cohort (G1, A1) ---------------------------------------------------------------------------

def cohort_ctes() -> str:
    from cohortlens.operators import cohort as c
    order = "EPIC_PMRN, MRN_Type, MRN, Report_Description, Report_Status, Report_Type, Report_Text"
    return f"""
g1_flags AS (
  SELECT *,
    coalesce(Report_Date_Time < TIMESTAMP '{c.DATE_CUTOFF}', false) AS p1,
    (Report_Description IS DISTINCT FROM {_sql_str(c.ED_DESCRIPTIONS[0])}
     AND Report_Description IS DISTINCT FROM {_sql_str(c.ED_DESCRIPTIONS[1])}) AS p2,
    Report_Text IS NOT NULL AS p3,
    coalesce(regexp_matches(Report_Text, {_sql_str('(?i)' + c.DELIVERY_PATTERN)}), false) AS p4,
    coalesce(Report_Status = '{c.FINAL_STATUS}', false) AS p5
  FROM notes_v),
g1_pre AS (
  SELECT *, CASE WHEN NOT p1 THEN 0 WHEN NOT p2 THEN 1 WHEN NOT p3 THEN 2 WHEN NOT p4 THEN 3
                 WHEN NOT p5 THEN 4 ELSE 5 END AS pre
  FROM g1_flags),
g1_first AS (
  SELECT *, (pre = 5 AND row_number() OVER (PARTITION BY EMPI, Report_Number, Report_Date_Time
                                             ORDER BY pre DESC, {order}) = 1) AS first_copy
  FROM g1_pre),
g1_tagged AS (
  SELECT *, CASE WHEN NOT first_copy THEN pre
    WHEN coalesce(contains(Report_Text, {_sql_str(c.INSTRUCTIONS_HEADER)})
                  AND regexp_matches(Report_Text, {_sql_str(c.INSTRUCTIONS_PATTERN)}), false) THEN 6
    WHEN coalesce(contains(Report_Text, {_sql_str(c.ORDERS_LITERAL)}), false) THEN 7
    ELSE 8 END AS reached
  FROM g1_first),
cohort AS (
  SELECT EMPI, EPIC_PMRN, MRN_Type, MRN, replace(Report_Number, '/', '_') AS Report_Number, Report_Date_Time,
         Report_Description, Report_Status, Report_Type, Report_Text
  FROM g1_tagged WHERE reached = 8)"""


def cohort_delivery() -> str:
    return with_fixtures(cohort_ctes(), select="SELECT * FROM cohort")


def cohort_funnel() -> str:
    from cohortlens.operators import cohort as c
    steps = ", ".join(f"({i}, {_sql_str(s)})" for i, s in enumerate(c.FUNNEL_STEPS))
    return with_fixtures(cohort_ctes(), f"""
steps(step_idx, step) AS (VALUES {steps}),
agg AS (
  SELECT s.step_idx, s.step, count(*) AS n_rows,
    count(DISTINCT {{'e': t.EMPI}}) AS n_patients,
    count(DISTINCT {{'r': t.Report_Number}}) AS n_report_numbers,
    count(DISTINCT {{'r': t.Report_Number, 'e': t.EMPI}}) AS n_patient_reports,
    count(DISTINCT {{'r': t.Report_Number, 'e': t.EMPI, 't': t.Report_Date_Time}}) AS n_notes
  FROM g1_tagged t JOIN steps s ON s.step_idx <= t.reached
  GROUP BY s.step_idx, s.step)""", select="""
SELECT step_idx, step, n_rows, n_patients, n_report_numbers, n_patient_reports, n_notes,
  coalesce(lag(n_rows) OVER (ORDER BY step_idx) - n_rows, 0) AS removed_rows,
  coalesce(lag(n_patients) OVER (ORDER BY step_idx) - n_patients, 0) AS removed_patients
FROM agg""")


# --- diagnosis proximity (F11-F16, J1-J3, G2) --------------------------------------------------

def _dx_ctes() -> str:
    from cohortlens.operators import proximity as p
    from cohortlens.operators.cohort import DATE_CUTOFF
    conds = {name: " OR ".join(f"starts_with(Code, '{x}')" for x in prefixes)
             for name, prefixes in p.CODE_FAMILIES.items()}
    case = " ".join(f"WHEN {c} THEN '{name}'" for name, c in conds.items())
    every = " OR ".join(f"({c})" for c in conds.values())
    return f"""
fam AS (
  SELECT *, CASE {case} END AS family FROM dx_v
  WHERE Date < TIMESTAMP '{DATE_CUTOFF}' AND ({every})),
pairs_all AS (
  SELECT c.*, f.Date, f.Name, f.Code_Type, f.Code, f.Flag, f.Inpatient_Outpatient, f.Encounter_number, f.family,
    (epoch_us(c.Report_Date_Time) - epoch_us(f.Date)) / 86400000000.0 AS diff_days,
    abs((epoch_us(c.Report_Date_Time) - epoch_us(f.Date)) / 86400000000.0) AS abs_diff_days
  FROM cohort c JOIN fam f ON c.EMPI = f.EMPI),
pairs_14 AS (SELECT * FROM pairs_all WHERE diff_days BETWEEN -{p.WINDOW_DAYS} AND {p.WINDOW_DAYS})"""


def _def_cond(definition: str) -> str:
    from cohortlens.operators import proximity as p
    if definition == "zheutlin":
        return "Code IN (" + ", ".join(_sql_str(c) for c in p.ZHEUTLIN_CODES) + ")"
    return "(" + " OR ".join(f"starts_with(Code, '{x}')" for x in p.BUTWICK_PREFIXES) + ")"


def dx_families() -> str:
    return with_fixtures(cohort_ctes(), _dx_ctes(), select="SELECT * FROM fam")


def dx_proximity(definition: str) -> str:
    return with_fixtures(cohort_ctes(), _dx_ctes(),
                         select=f"SELECT * FROM pairs_14 WHERE {_def_cond(definition)}")


def dx_left_join() -> str:
    from cohortlens.operators import proximity as p
    diff = "(epoch_us(c.Report_Date_Time) - epoch_us(f.Date)) / 86400000000.0"
    return with_fixtures(cohort_ctes(), _dx_ctes(), select=f"""
SELECT c.*, f.Date, f.Name, f.Code_Type, f.Code, f.Flag, f.Inpatient_Outpatient, f.Encounter_number, f.family,
       {diff} AS diff_days, abs({diff}) AS abs_diff_days
FROM cohort c LEFT JOIN fam f ON c.EMPI = f.EMPI AND {diff} BETWEEN -{p.WINDOW_DAYS} AND {p.WINDOW_DAYS}""")


def dx_left_all() -> str:
    diff = "(epoch_us(c.Report_Date_Time) - epoch_us(f.Date)) / 86400000000.0"
    return with_fixtures(cohort_ctes(), _dx_ctes(), select=f"""
SELECT c.* EXCLUDE (Report_Text), f.Date, f.Name, f.Code_Type, f.Code, f.Flag, f.Inpatient_Outpatient, f.Encounter_number,
       f.family, {diff} AS diff_days, abs({diff}) AS abs_diff_days
FROM cohort c LEFT JOIN fam f ON c.EMPI = f.EMPI""")


def io_notes_roundtrip() -> str:
    """Every field as text (null: empty), each line of the text closed and the next one set off by a blank. A line of ten
    fields opens a note, so a text ends before such a line; what it opens has no valid time."""
    from cohortlens.operators.cohort import DATE_CUTOFF
    fields = ", ".join(f"coalesce(CAST({f} AS VARCHAR), '') AS {f}" for f in fx.NOTE_FIELDS
                       if f not in ("Report_Date_Time", "Report_Text"))
    return with_fixtures(select=f"""
SELECT * REPLACE (array_to_string(Report_Text, chr(10) || ' ') || chr(10) AS Report_Text) FROM (
  SELECT {fields}, Report_Date_Time,
    lines[1:coalesce(nullif(list_position(list_transform(lines, lambda x: len(string_split(x, '|')) = 10), true), 0),
                     len(lines) + 1) - 1] AS Report_Text
  FROM (SELECT *, string_split(Report_Text, chr(10)) AS lines FROM notes_v)
  WHERE lines IS NOT NULL AND Report_Date_Time < TIMESTAMP '{DATE_CUTOFF}')
WHERE len(Report_Text) > 0""")


def dx_nearest() -> str:
    return with_fixtures(cohort_ctes(), _dx_ctes(), select="""
SELECT * FROM pairs_all
QUALIFY row_number() OVER (PARTITION BY EMPI, Report_Number, Report_Date_Time
                           ORDER BY abs_diff_days, Date, Code, Encounter_number) = 1""")


def dx_nearest_window() -> str:
    return with_fixtures(cohort_ctes(), _dx_ctes(), select="""
SELECT * FROM pairs_14
QUALIFY row_number() OVER (PARTITION BY EMPI, Report_Number, Report_Date_Time
                           ORDER BY abs_diff_days, Date, Code, Encounter_number) = 1""")


def cohort_linked() -> str:
    return with_fixtures(cohort_ctes(), _dx_ctes(), select=f"""
SELECT * FROM pairs_14
WHERE {_def_cond('zheutlin')} AND Inpatient_Outpatient = 'Inpatient' AND abs_diff_days = 0""")


# --- regex rules (R1-R27) -----------------------------------------------------------------------
# RE2 has no lookaround. Lookbehind-only rules become a prefix alternation that spells out every
# allowed 3-character context; rules with a lookahead are tested per occurrence: the text is split
# on each literal alternative, occurrence positions are prefix sums of piece lengths, and the
# characters around each occurrence are tested directly.

_NOT_NO = r"(?s:^.{0,2}|[^n]..|.[^o].|..[^ ])"
_NOT_NO_NOR_HX_OF = r"(?s:^.{0,2}|[^no]..|n[^o].|no[^ ]|o[^f].|of[^ ]|(?:^.{0,2}|[^h]..|.[^x].|..[^ ])of )"

# label -> list of (literal, split column, condition on 1-based position p of the occurrence)
_NO_BEFORE = "(p >= 4 AND lower(substr({t}, p - 3, 3)) = 'no ')"
_POSITIONAL = {
    'laceration': [
        ("laceration", "NOT " + _NO_BEFORE + " AND NOT regexp_matches(substr({t}, p + 10, 12), '^[^\\n]{{0,10}}(?i:no)')"),
        ("tear", "NOT " + _NO_BEFORE + " AND NOT regexp_matches(substr({t}, p + 4, 12), '^[^\\n]{{0,10}}(?i:no)')"),
    ],
    'platelets': [
        ("platelets", "NOT (p >= 4 AND regexp_matches(substr({t}, p - 3, 3), '^[0-9]{{2}} $'))"
                      " AND NOT regexp_matches(substr({t}, p + 9, 12), '^[^\\n]{{0,10}}[0-9]{{2}}')"),
    ],
}


def _split_col(lit: str) -> str:
    return "_lens_" + "".join(ch for ch in lit if ch.isalnum())


def positional_split_cols(t: str = "Report_Text") -> str:
    """Select-list items with piece lengths of the text split on every positional literal."""
    lits = sorted({lit for alts in _POSITIONAL.values() for lit, _ in alts})
    return ", ".join(
        f"list_transform(string_split_regex({t}, '(?i){lit}'), lambda x: length(x)) AS {_split_col(lit)}"
        for lit in lits)


def duck_pattern(pattern: str, t: str = "Report_Text") -> str:
    """DuckDB boolean expression equal to a case-insensitive Python ``re.search`` of ``pattern``."""
    from cohortlens.functions.rules import LABEL_RULES
    for label in _POSITIONAL:
        if pattern == LABEL_RULES[label]:
            parts = []
            for lit, cond in _POSITIONAL[label]:
                lens = _split_col(lit)
                pos = f"CAST(list_sum(list_slice({lens}, 1, k)) + (k - 1) * {len(lit)} + 1 AS BIGINT)"
                c = cond.format(t=t).replace("p ", f"{pos} ").replace("(p", f"({pos}")
                parts.append(f"coalesce(len(list_filter(range(1, len({lens})), lambda k: {c})) > 0, false)")
            return "(" + " OR ".join(parts) + ")"
    if pattern.startswith("(?<!hx of )(?<!no )"):
        rx = _NOT_NO_NOR_HX_OF + "(?:" + pattern[len("(?<!hx of )(?<!no )"):] + ")"
    elif pattern.startswith("(?<!no )"):
        rx = _NOT_NO + "(?:" + pattern[len("(?<!no )"):] + ")"
    else:
        rx = pattern
    if "(?<" in rx.replace(_NOT_NO, "").replace(_NOT_NO_NOR_HX_OF, "") or "(?!" in rx:
        raise ValueError(f"no RE2 form for {pattern}")
    return f"coalesce(regexp_matches({t}, {_sql_str('(?i)' + rx)}), false)"


def duck_rule(label: str, t: str = "Report_Text") -> str:
    from cohortlens.functions.rules import LABEL_RULES
    return duck_pattern(LABEL_RULES[label], t)


def rule_label_values(labels: list[str]) -> str:
    return "rule_labels(label) AS (VALUES " + ", ".join(f"({_sql_str(l)})" for l in labels) + ")"


def rule_case(labels: list[str], t: str = "Report_Text") -> str:
    whens = " ".join(f"WHEN {_sql_str(l)} THEN {duck_rule(l, t)}" for l in labels)
    return f"CAST(CASE l.label {whens} END AS INTEGER)"


def rules_binary_long() -> str:
    from cohortlens.functions.rules import BINARY_RULE_LABELS
    return with_fixtures(cohort_ctes(), f"""
rx AS (SELECT *, {positional_split_cols()} FROM cohort),
{rule_label_values(BINARY_RULE_LABELS)}""", select=f"""
SELECT c.Report_Number, c.EMPI, c.Report_Date_Time, c.MRN_Type, l.label,
       {rule_case(BINARY_RULE_LABELS).replace('Report_Text', 'c.Report_Text')} AS prediction
FROM rx c CROSS JOIN rule_labels l""")


# --- annotations, labels, metrics -----------------------------------------------------------------

def annotation_ctes() -> str:
    from cohortlens.functions.rules import LABEL_CATEGORIES, TRANSFUSION_SPAN_RULES, TRANSFUSION_SOURCE_LABEL
    cats = ", ".join(f"({_sql_str(k)}, {_sql_str(v)})" for k, v in LABEL_CATEGORIES.items())
    sub = " UNION ALL ".join(
        f"SELECT {_sql_str(l)} AS label, EMPI, Report_Number FROM annot_deliv "
        f"WHERE label_type = {_sql_str(TRANSFUSION_SOURCE_LABEL)} AND regexp_matches(span, {_sql_str('(?i)' + p)})"
        for l, p in TRANSFUSION_SPAN_RULES.items())
    return f"""
cats(label_type, label_category) AS (VALUES {cats}),
annot_flat AS (
  SELECT a.EMPI, a.Report_Number, a.Report_Date_Time, a.label_type,
         coalesce(c.label_category, 'Other') AS label_category, a.start, a."end",
         regexp_replace(substr(a.Report_Text, a.start + 1, a."end" - a.start), '[,:.]$|^[,:.]', '', 'g') AS span,
         a.annotator
  FROM annot_raw a LEFT JOIN cats c ON c.label_type = a.label_type
  WHERE a.decision NOT IN ('rejected', 'undecided')),
annot_deliv AS (
  SELECT * FROM annot_flat f WHERE NOT EXISTS (
    SELECT 1 FROM annot_flat n WHERE n.label_type = 'not a delivery note'
      AND n.EMPI = f.EMPI AND n.Report_Number = f.Report_Number)),
annotated AS (
  SELECT * FROM cohort c WHERE EXISTS (
    SELECT 1 FROM annot_deliv a WHERE a.EMPI = c.EMPI AND a.Report_Number = c.Report_Number)),
lab_member AS (
  SELECT label_type AS label, EMPI, Report_Number FROM annot_deliv
  UNION ALL {sub}),
bin_labels(label) AS (VALUES {", ".join(f"({_sql_str(l)})" for l in _binary_label_list())}),
labels_long AS (
  SELECT n.Report_Number, n.EMPI, n.Report_Date_Time, n.MRN_Type, b.label,
    CAST((EXISTS (SELECT 1 FROM lab_member m WHERE m.label = b.label AND m.EMPI = n.EMPI))
     AND (EXISTS (SELECT 1 FROM lab_member m WHERE m.label = b.label AND m.Report_Number = n.Report_Number)) AS INTEGER) AS y
  FROM annotated n CROSS JOIN bin_labels b)"""


def _binary_label_list() -> list[str]:
    from cohortlens.functions.rules import BINARY_LABELS
    return [l for l in BINARY_LABELS if l != "delivery_note"]


def annotations_flat() -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(), select="SELECT * FROM annot_flat")


def annotations_delivery() -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(), select="SELECT * FROM annot_deliv")


def annotation_label_counts() -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(),
                         select="SELECT label_type, count(*) AS n FROM annot_deliv GROUP BY label_type")


def annotation_label_numbers() -> str:
    from cohortlens.functions.rules import LABEL_CATEGORIES
    rows = ", ".join(f"({_sql_str(k)}, {_sql_str(v)}, {i})" for i, (k, v) in enumerate(LABEL_CATEGORIES.items(), 1))
    return with_fixtures(cohort_ctes(), annotation_ctes(), f"""
tab(label_type, label_category, number) AS (VALUES {rows}),
cnt AS (SELECT label_type, count(*) AS n FROM annot_flat GROUP BY label_type)""", select="""
SELECT label_type, t.label_category, CAST(number AS INTEGER) AS number, CAST(number - 1 AS INTEGER) AS place, coalesce(n, 0) AS n
FROM tab t FULL JOIN cnt USING (label_type)""")


def notes_by_patient() -> str:
    return with_fixtures(select="""
SELECT EMPI, Report_Number, Report_Date_Time,
  row_number() OVER (ORDER BY EMPI NULLS FIRST, Report_Number NULLS FIRST, Report_Date_Time NULLS FIRST) AS rank FROM notes_v""")


def cohort_shuffled(seed: int = 42) -> str:
    return with_fixtures(cohort_ctes(), select=f"""
SELECT EMPI, Report_Number, Report_Date_Time, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', CAST(EMPI AS VARCHAR),
  Report_Number, CAST(Report_Date_Time AS VARCHAR)))) AS rank FROM cohort""")


def annotator_stats() -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(), select="""
SELECT annotator, count(DISTINCT Report_Number) AS n_report_numbers, count(DISTINCT EMPI) AS n_patients
FROM annot_flat GROUP BY annotator""")


def annotations_empty() -> str:
    """A file is empty if each of its records is rejected or undecided; its name ends in .json."""
    return with_fixtures(select="""
SELECT annotator || '_notes_empi_' || CAST(EMPI AS VARCHAR) || '_note_' || Report_Number || '_time_'
       || strftime(Report_Date_Time, '%Y-%m-%d %H:%M:%S') || '.json' AS file_name
FROM annot_raw GROUP BY ALL HAVING bool_and(decision IN ('rejected', 'undecided'))""")


def non_delivery_notes() -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(), select="""
SELECT EMPI, Report_Number FROM annot_flat WHERE label_type = 'not a delivery note'""")


def label_delivery_note() -> str:
    from cohortlens.operators.labels import LABEL_KEY
    return with_fixtures(cohort_ctes(), select=f"""
SELECT {', '.join(LABEL_KEY)}, CAST(p4 AS INTEGER) AS delivery_note FROM g1_flags""")


def label_value_counts() -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(),
                         select="SELECT label, y, count(*) AS n FROM labels_long GROUP BY label, y")


def labels_binary() -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(), select="SELECT * FROM labels_long")


def labels_ie(label: str = "estimated blood loss") -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(), f"""
grp AS (
  SELECT a.EMPI, a.Report_Number, n.Report_Date_Time, min(n.MRN_Type) AS MRN_Type,
         list(a.span ORDER BY a.start, a."end", a.span) AS spans
  FROM annot_deliv a JOIN annotated n ON n.EMPI = a.EMPI AND n.Report_Number = a.Report_Number
   AND n.Report_Date_Time = a.Report_Date_Time
  WHERE a.label_type = {_sql_str(label)}
  GROUP BY a.EMPI, a.Report_Number, n.Report_Date_Time),
ie AS (
  SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, spans FROM grp g
  WHERE g.EMPI IN (SELECT EMPI FROM annotated) AND g.Report_Number IN (SELECT Report_Number FROM annotated)
  UNION ALL
  SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, CAST([] AS VARCHAR[]) AS spans FROM annotated n
  WHERE n.EMPI NOT IN (SELECT EMPI FROM grp) OR n.Report_Number NOT IN (SELECT Report_Number FROM grp))""",
                         select="""
SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, array_to_string(spans, ' || ') AS spans,
       CAST(len(spans) > 0 AS INTEGER) AS span_extracted FROM ie""")


def _regex_eval_ctes() -> str:
    from cohortlens.functions.rules import BINARY_RULE_LABELS
    labels = [l for l in _binary_label_list() if l in BINARY_RULE_LABELS]
    return f"""
rx AS (SELECT *, {positional_split_cols()} FROM annotated),
{rule_label_values(labels)},
preds AS (
  SELECT c.Report_Number, c.EMPI, c.Report_Date_Time, l.label,
         {rule_case(labels).replace('Report_Text', 'c.Report_Text')} AS prediction
  FROM rx c CROSS JOIN rule_labels l),
ev AS (
  SELECT y.label, y.y, p.prediction FROM labels_long y JOIN preds p
    ON p.label = y.label AND p.EMPI = y.EMPI AND p.Report_Number = y.Report_Number
   AND p.Report_Date_Time = y.Report_Date_Time),
cm AS (
  SELECT label, sum(CASE WHEN y = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN y = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS tn,
    sum(CASE WHEN y = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN y = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS fn
  FROM ev GROUP BY label)"""


def metrics_regex_binary() -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(), _regex_eval_ctes(), select="""
SELECT label,
  CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0.0 END AS acc,
  CASE WHEN tp + tn + fp + fn > 0 THEN (tp + tn) / (tp + tn + fp + fn) ELSE 0.0 END AS micro_f1,
  CASE WHEN tp + fn + fp > 0 AND tn + fp + fn > 0 THEN
         ((CASE WHEN 2*tp + fp + fn > 0 THEN 2*tp / (2*tp + fp + fn) ELSE 0.0 END)
        + (CASE WHEN 2*tn + fp + fn > 0 THEN 2*tn / (2*tn + fp + fn) ELSE 0.0 END)) / 2
       WHEN tp + fn + fp > 0 THEN (CASE WHEN 2*tp + fp + fn > 0 THEN 2*tp / (2*tp + fp + fn) ELSE 0.0 END)
       ELSE (CASE WHEN 2*tn + fp + fn > 0 THEN 2*tn / (2*tn + fp + fn) ELSE 0.0 END) END AS macro_f1,
  CASE WHEN 2*tp + fp + fn > 0 THEN 2*tp / (2*tp + fp + fn) ELSE 0.0 END AS binary_f1,
  CASE WHEN tp + fn + fp > 0 AND tn + fp + fn > 0 THEN (CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END)
       ELSE -1.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN tp + fn + fp > 0 AND tn + fp + fn > 0 THEN (CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END)
       ELSE -1.0 END AS specificity,
  CASE WHEN tp + fn + fp > 0 AND tn + fp + fn > 0 THEN (CASE WHEN tn + fn > 0 THEN tn / (tn + fn) END)
       ELSE -1.0 END AS NPV,
  CAST(CASE WHEN tp + fn + fp > 0 AND tn + fp + fn > 0 THEN tp ELSE -1 END AS BIGINT) AS tp,
  CAST(CASE WHEN tp + fn + fp > 0 AND tn + fp + fn > 0 THEN tn ELSE -1 END AS BIGINT) AS tn,
  CAST(CASE WHEN tp + fn + fp > 0 AND tn + fp + fn > 0 THEN fp ELSE -1 END AS BIGINT) AS fp,
  CAST(CASE WHEN tp + fn + fp > 0 AND tn + fp + fn > 0 THEN fn ELSE -1 END AS BIGINT) AS fn,
  CAST(CASE WHEN tp + fn + fp > 0 AND tn + fp + fn > 0 THEN tp + fn ELSE -2 END AS BIGINT) AS n
FROM cm""")


def class_report() -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(), _regex_eval_ctes(), """
per AS (
  SELECT label, cls, CASE WHEN npred > 0 THEN hit / npred ELSE 0.0 END AS precision,
    CASE WHEN ntrue > 0 THEN hit / ntrue ELSE 0.0 END AS recall,
    CASE WHEN npred + ntrue > 0 THEN 2 * hit / (npred + ntrue) ELSE 0.0 END AS f1_score,
    CAST(ntrue AS BIGINT) AS support
  FROM (SELECT label, '0' AS cls, tn AS hit, tn + fn AS npred, tn + fp AS ntrue FROM cm
        UNION ALL SELECT label, '1', tp, tp + fp, tp + fn FROM cm) WHERE npred + ntrue > 0)""", select="""
SELECT * FROM per
UNION ALL SELECT label, 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM per GROUP BY label
UNION ALL SELECT label, 'weighted avg',
  CASE WHEN sum(support) > 0 THEN sum(precision * support) / sum(support) ELSE 0.0 END,
  CASE WHEN sum(support) > 0 THEN sum(recall * support) / sum(support) ELSE 0.0 END,
  CASE WHEN sum(support) > 0 THEN sum(f1_score * support) / sum(support) ELSE 0.0 END,
  CAST(sum(support) AS BIGINT) FROM per GROUP BY label""")


# --- phenotype (C1-C4, T1-T6) -----------------------------------------------------------------------

def gaps(without_site: list[str], site: str, at_site: list[str]) -> str:
    """Condition on predictions that exist."""
    names = lambda xs: ", ".join(_sql_str(x) for x in xs)
    return (f"WHERE NOT coalesce((c.MRN_Type IS NULL AND k.concept IN ({names(without_site)}))"
            f" OR (c.MRN_Type = {_sql_str(site)} AND k.concept IN ({names(at_site)})), false)")


def composite_with_gaps(without_site: list[str], site: str, at_site: list[str]) -> str:
    from cohortlens.functions.concepts import COMPOSITES
    parts = " UNION ALL ".join(f"SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, {_sql_str(n)} AS composite, "
                               f"predictions FROM {_composite_sql(n)}" for n in COMPOSITES)
    return with_fixtures(cohort_ctes(), concept_ctes(where=gaps(without_site, site, at_site)), select=parts)


def normalize_predicates() -> str:
    from cohortlens.functions.normalize import TEXT_NUMBER
    return with_fixtures(cohort_ctes(), select=f"""
SELECT EMPI, Report_Number, Report_Date_Time, regexp_matches(Report_Text, '[0-9]') AS has_numbers,
  regexp_matches(Report_Text, '(^|[^0-9])([0-9]|10)($|[^0-9])') AS has_single_digit_or_10,
  regexp_matches(lower(Report_Text), {_sql_str(TEXT_NUMBER)}) AS is_text_number FROM cohort""")


def concept_ctes(notes: str = "cohort", where: str = "") -> str:
    from cohortlens.functions.concepts import CONCEPT_RULES, CONCEPT_RUNS
    vals = ", ".join(f"({_sql_str(c)}, {_sql_str(l)}, {_sql_str(p)})" for c, (l, p) in CONCEPT_RUNS.items())
    whens = " ".join(f"WHEN {_sql_str(c)} THEN {duck_pattern(CONCEPT_RULES[c], 'c.Report_Text')}"
                     for c in CONCEPT_RUNS)
    return f"""
crx AS (SELECT *, {positional_split_cols()} FROM {notes}),
concepts(concept, label, prompt_desc) AS (VALUES {vals}),
cpreds AS (
  SELECT c.Report_Number, c.EMPI, c.Report_Date_Time, c.MRN_Type, k.concept, k.label, k.prompt_desc,
         CAST(CASE k.concept {whens} END AS INTEGER) AS prediction
  FROM crx c CROSS JOIN concepts k {where})"""


def _composite_sql(name: str, src: str = "cpreds") -> str:
    from cohortlens.functions.concepts import COMPOSITES
    inputs, rule = COMPOSITES[name]
    cols = ", ".join(f"max(CASE WHEN concept = {_sql_str(c)} THEN prediction END) AS predictions_{s}, "
                     f"max(CASE WHEN concept = {_sql_str(c)} THEN 1 ELSE 0 END) AS has_{s}" for c, s, _ in inputs)
    req = " AND ".join(f"has_{s} = 1" for _, s, r in inputs if r)
    if rule == "any":
        pred = "CASE WHEN " + " + ".join(f"coalesce(predictions_{s}, 0)" for _, s, _ in inputs) + " >= 1 THEN 1 ELSE 0 END"
    else:
        a, b = inputs[0][1], inputs[1][1]
        pred = f"CASE WHEN predictions_{a} = 1 AND coalesce(predictions_{b} = 0, false) THEN 1 ELSE 0 END"
    outs = ", ".join(f"predictions_{s}" for _, s, _ in inputs)
    return f"""(SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, {outs}, CAST({pred} AS INTEGER) AS predictions
  FROM (SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, {cols} FROM {src}
        GROUP BY Report_Number, EMPI, Report_Date_Time, MRN_Type) WHERE {req})"""


def composite(name: str) -> str:
    return with_fixtures(cohort_ctes(), concept_ctes(), select=f"SELECT * FROM {_composite_sql(name)}")


def concept_predictions() -> str:
    return with_fixtures(cohort_ctes(), concept_ctes(), select="SELECT * FROM cpreds")


def subtypes_by_run() -> str:
    pph = f"""pph AS (SELECT * FROM (SELECT *, {positional_split_cols()} FROM cohort) WHERE {duck_rule('PPH')})"""
    runs = {"subtype_annotated": subtypes(notes="annotated", before=[annotation_ctes()]),
            "model_predicted_PPH": subtypes(notes="pph", before=[pph])}
    return "\nUNION ALL\n".join(f"SELECT *, '{name}' AS run_type FROM ({sql})" for name, sql in runs.items())


def subtypes(where: str = "", notes: str = "cohort", before: list[str] | None = None) -> str:
    from cohortlens.functions.concepts import SUBTYPE_INPUTS
    cols = ", ".join(f"max(CASE WHEN concept = {_sql_str(c)} THEN prediction END) AS predictions_{s}"
                     for s, c in SUBTYPE_INPUTS)
    names = ", ".join(f"predictions_{s}" for s, _ in SUBTYPE_INPUTS)
    nz = lambda s: f"coalesce(predictions_{s}, 0)"
    return with_fixtures(cohort_ctes(), *(before or []), concept_ctes(notes, where), f"""
sub_src AS (
  SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, concept, prediction FROM cpreds
  UNION ALL SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, 'accreta_composite', predictions
    FROM {_composite_sql('accreta_composite')}
  UNION ALL SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, 'dic_composite', predictions
    FROM {_composite_sql('dic_composite')}),
wide AS (
  SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, {cols},
         max(CASE WHEN concept = 'atony' THEN 1 ELSE 0 END) AS has_anchor
  FROM sub_src GROUP BY Report_Number, EMPI, Report_Date_Time, MRN_Type),
flags AS (
  SELECT *, {nz('atony')} + {nz('methergine')} + {nz('cytotec')} + {nz('hemabate')} AS tone,
    CASE WHEN predictions_accreta = 1 OR predictions_retained_poc = 1 OR predictions_d_and_c = 1
          OR (predictions_manual_extraction = 1 AND predictions_csection = 0) THEN 1 ELSE 0 END AS tissue,
    {nz('dic')} + {nz('cryo')} + {nz('platelets')} + {nz('ffp')} AS thrombus
  FROM wide WHERE has_anchor = 1)""", select=f"""
SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, {names},
  CAST(CASE WHEN tone >= 1 THEN 1 ELSE 0 END AS INTEGER) AS has_tone_subtype_model,
  CAST(CASE WHEN tissue >= 1 THEN 1 ELSE 0 END AS INTEGER) AS has_tissue_subtype_model,
  CAST(CASE WHEN thrombus >= 1 THEN 1 ELSE 0 END AS INTEGER) AS has_thrombus_subtype_model,
  CAST(CASE WHEN predictions_uterine_rupture = 1 OR predictions_oleary = 1 OR predictions_PPH_surgical_extension = 1
        OR predictions_PPH_surgical_damage_artery = 1 OR predictions_PPH_surgical_damage_ligament = 1
        OR (predictions_laceration = 1 AND thrombus = 0 AND tone = 0 AND tissue = 0) THEN 1 ELSE 0 END AS INTEGER)
    AS has_trauma_subtype_model_lacerations_no_other_cause
FROM flags""")


# --- sampling and splits (W4-W9, F18-F19, J16, A5-A6) ----------------------------------------------

def sample_annotators(n: int = 100, annotators: tuple[str, ...] = ("annA", "annB", "annC"), seed: int = 42) -> str:
    names = "[" + ", ".join(_sql_str(a) for a in annotators) + "]"
    return with_fixtures(cohort_ctes(), f"""
smp AS (
  SELECT *, md5(concat_ws('|', '{seed}', CAST(EMPI AS VARCHAR), Report_Number, CAST(Report_Date_Time AS VARCHAR))) AS h
  FROM cohort ORDER BY h LIMIT {n}),
asg AS (SELECT *, ({names})[ntile({len(annotators)}) OVER (ORDER BY h)] AS annotator FROM smp)""", select="""
SELECT EMPI, EPIC_PMRN, MRN_Type, MRN, Report_Number, Report_Date_Time, Report_Description, Report_Status,
       Report_Type, Report_Text, annotator,
       annotator || '_notes_empi_' || CAST(EMPI AS VARCHAR) || '_note_' || Report_Number || '_time_'
         || strftime(Report_Date_Time, '%Y-%m-%d %H:%M:%S') || '.txt' AS file_name
FROM asg""")


def _split_ctes(src: str, y: str, ie: bool, n_train: int = 50, seed: int = 42) -> str:
    if ie:
        keep = ("(coalesce(l.MRN_Type = 'BWH', false) OR (l.MRN_Type IS NULL AND coalesce(contains(l.Report_Number, 'BWH'), false)))"
                " AND NOT EXISTS (SELECT 1 FROM {src} e WHERE e.label = l.label AND e.EMPI = l.EMPI AND e.MRN_Type <> 'BWH')")
    else:
        keep = ("coalesce(l.MRN_Type = 'BWH', false) AND NOT EXISTS (SELECT 1 FROM {src} e WHERE e.label = l.label"
                " AND e.EMPI = l.EMPI AND NOT coalesce(e.MRN_Type = 'BWH', false))")
    keep = keep.format(src=src)
    return f"""
pool AS (SELECT * FROM {src} l WHERE {keep}),
pat AS (SELECT label, EMPI, sum({y}) AS pos FROM pool GROUP BY label, EMPI),
pat2 AS (SELECT *, CASE WHEN sum(pos) OVER (PARTITION BY label) >= 2 THEN CAST(pos > 0 AS INTEGER) ELSE 0 END AS stratum
         FROM pat),
sizes AS (SELECT label, stratum, count(*) AS ns FROM pat2 GROUP BY label, stratum),
q1 AS (SELECT *, least({n_train}, sum(ns) OVER (PARTITION BY label)) AS target, sum(ns) OVER (PARTITION BY label) AS total
       FROM sizes),
q2 AS (SELECT *, floor(target * ns / total) AS base, target * ns / total - floor(target * ns / total) AS frac FROM q1),
q3 AS (SELECT *, target - sum(base) OVER (PARTITION BY label) AS leftover,
              row_number() OVER (PARTITION BY label ORDER BY frac DESC, stratum) AS rk FROM q2),
quota AS (SELECT label, stratum, base + CASE WHEN rk <= leftover THEN 1 ELSE 0 END AS quota FROM q3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, stratum
                                        ORDER BY md5(concat_ws('|', '{seed}', CAST(EMPI AS VARCHAR))), EMPI) AS rn
           FROM pat2),
train AS (SELECT r.label, r.EMPI FROM ranked r JOIN quota q ON q.label = r.label AND q.stratum = r.stratum
          WHERE r.rn <= q.quota),
split AS (SELECT l.*, CASE WHEN t.EMPI IS NOT NULL THEN 'train' ELSE 'test' END AS split
          FROM {src} l LEFT JOIN train t ON t.label = l.label AND t.EMPI = l.EMPI)"""


def split_binary() -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(), _split_ctes("labels_long", "y", False),
                         select="SELECT * FROM split")


def io_split_export() -> str:
    return f"SELECT * REPLACE (replace(label, '/', '_') AS label) FROM ({split_binary()})"


def split_label_counts() -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(), _split_ctes("labels_long", "y", False), select="""
SELECT label, split, count(*) AS n_notes, CAST(sum(y) AS BIGINT) AS n_positive FROM split GROUP BY label, split""")


def split_ie() -> str:
    base = labels_ie()
    # reuse the IE label CTEs: everything before the final SELECT of labels_ie()
    head, _ = base.rsplit("\nSELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, array_to_string", 1)
    return head + """,
ie_l AS (SELECT 'estimated blood loss' AS label, Report_Number, EMPI, Report_Date_Time, MRN_Type,
                array_to_string(spans, ' || ') AS spans, CAST(len(spans) > 0 AS INTEGER) AS span_extracted FROM ie),""" + \
        _split_ctes("ie_l", "span_extracted", True) + "\nSELECT * FROM split"


# --- chunking and chunked rule-model prediction (M3-M5, A7, A8) -----------------------------------------

def _chunk_sql(src: str, budget_expr: str, stride: int = 128, extra: str = "") -> str:
    return f"""
SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type{extra}, len(tok) AS n_tokens, CAST(i AS INTEGER) AS chunk_idx,
       array_to_string(list_slice(tok, i * ({budget_expr} - {stride}) + 1,
                                  i * ({budget_expr} - {stride}) + {budget_expr}), ' ') AS chunk_text
FROM (SELECT *, string_split_regex(regexp_replace(Report_Text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS tok FROM {src}) t,
     unnest(range(0, CASE WHEN len(tok) <= {budget_expr} THEN 1
                          ELSE 1 + CAST(ceil((len(tok) - {budget_expr}) / ({budget_expr} - {stride})) AS INTEGER) END)) AS r(i)"""


def chunk_notes(budget: int) -> str:
    return with_fixtures(cohort_ctes(), select=_chunk_sql("cohort", str(budget)))


def _predict_ctes(notes: str) -> str:
    from cohortlens.functions.concepts import CONCEPT_RULES, CONCEPT_RUNS
    from cohortlens.functions.prompts import get_prompt
    rows = []
    for c, (l, d) in CONCEPT_RUNS.items():
        p, t = get_prompt(l, d)
        rows.append(f"({_sql_str(c)}, {_sql_str(l)}, {_sql_str(d)}, {_sql_str(p)}, {_sql_str(t)}, {512 - len(p.split())})")
    whens = " ".join(f"WHEN {_sql_str(c)} THEN {duck_pattern(CONCEPT_RULES[c], 'ch.chunk_text')}" for c in CONCEPT_RUNS)
    return f"""
runs(run, label, prompt_desc, prompt, prediction_type, budget) AS (VALUES {", ".join(rows)}),
nb AS (SELECT c.*, b.budget FROM {notes} c CROSS JOIN (SELECT DISTINCT budget FROM runs) b),
chunks AS ({_chunk_sql("nb", "budget", extra=", budget")}),
chx AS (SELECT *, {positional_split_cols('chunk_text')} FROM chunks),
ans AS (
  SELECT ch.Report_Number, ch.EMPI, ch.Report_Date_Time, ch.MRN_Type, ch.chunk_idx, r.run, r.label, r.prompt_desc,
         r.prompt, r.prediction_type, CASE WHEN (CASE r.run {whens} END) THEN 'Yes' ELSE 'No' END AS answer
  FROM chx ch JOIN runs r ON r.budget = ch.budget)"""


def metrics_zero_shot_binary() -> str:
    head, select = metrics_regex_binary().split("\nSELECT label,\n", 1)
    return with_fixtures(cohort_ctes(), annotation_ctes(), _predict_ctes("annotated"), """
ev AS (
  SELECT a.run AS label, y.y, max(CASE WHEN a.answer IN ('Yes', 'yes') THEN 1 ELSE 0 END) AS prediction
  FROM ans a JOIN labels_long y ON y.label = a.label AND y.EMPI = a.EMPI AND y.Report_Number = a.Report_Number
   AND y.Report_Date_Time = a.Report_Date_Time
  GROUP BY a.run, a.EMPI, a.Report_Number, a.Report_Date_Time, y.y),
cm AS (
  SELECT label, sum(CASE WHEN y = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN y = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS tn,
    sum(CASE WHEN y = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN y = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS fn
  FROM ev GROUP BY label)""", select="SELECT label,\n" + select)


def predict_concepts() -> str:
    return with_fixtures(cohort_ctes(), _predict_ctes("cohort"), select="""
SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, run, label, prompt_desc, prompt, prediction_type,
       CAST(max(CASE WHEN answer IN ('Yes', 'yes') THEN 1 ELSE 0 END) AS INTEGER) AS predictions,
       string_agg(answer, '|' ORDER BY chunk_idx) AS raw_preds, count(*) AS n_chunks
FROM ans GROUP BY Report_Number, EMPI, Report_Date_Time, MRN_Type, run, label, prompt_desc, prompt, prediction_type""")


# --- span pre-annotation (P-single rules without lookaround) ----------------------------------------------

# --- blood-loss extraction (R28-R30, K1, K3, A9, A20) ----------------------------------------------------
# RE2 has no lookahead. Where the rule asks that no digit follows, the next character is matched in a group of its own,
# which is taken off what was found.

_EBL_WORDS = "one|two|three|four|five|six|seven|eight|nine"


def _ebl_rule() -> tuple[str, int]:
    """The blood-loss rule for RE2 and the number of the group that holds the character too much."""
    from cohortlens.functions.rules import LABEL_RULES
    rx = LABEL_RULES["estimated blood loss"]
    rx = rx.replace("(?![0-9]) (?:", " (?:")  # a blank follows anyway
    rx = rx.replace("(?![0-9]) ?(?:liters| l )?)", "(?: (?:liters| l )?|liters| l |([^0-9])|$))")
    if "(?!" in rx:
        raise ValueError("the rule has changed")
    return rx, 5


def _groups(text: str, rx: str, n: int) -> str:
    """What each match of ``rx`` holds in its one group."""
    cols = [f"regexp_extract_all({text}, {_sql_str('(?i)' + rx)}, {g})" for g in range(1, n + 1)]
    return f"list_transform(list_zip({', '.join(cols)}), lambda z: concat({', '.join(f'z[{g}]' for g in range(1, n + 1))}))"


def _blood_loss_sql(text: str, annotation: bool) -> str:
    """List of the millilitres, as text, that a blood-loss text holds."""
    ell = r"(?:l(?:$|[^a-zA-Z])|liters?)"
    number = (r"([\d./-]+)[^\n]ebl|ebl[^\n]([\d./-]+)|(?:([\d./-]+) ?" + ell + r")|(?:(\d,?\d\d\d?)+? ?(?:ml|cc|c))"
              r"|(^[<>]?[\d.,/-]+$)|(^(?:" + _EBL_WORDS + r")$)|(?:^|[^a-zA-Z])(" + _EBL_WORDS + ") " + ell)
    words = " ".join(f"WHEN '{w}' THEN '{i}000'" for i, w in enumerate(_EBL_WORDS.split("|"), 1))
    count = lambda c: f"len(n) - len(replace(n, '{c}', ''))"
    upper = (f"CASE WHEN {count('-')} = 1 AND {count('/')} = 0 THEN split_part(n, '-', 2) "
             "ELSE replace(n, '-', ' ') END")
    part = lambda g: f"TRY_CAST(regexp_extract(v, '^(?:([0-9.]+) )?([0-9.]+)/([0-9.]+)$', {g}) AS DOUBLE)"
    frac = f"coalesce({part(1)}, 0) + {part(2)} / nullif({part(3)}, 0)"
    value = f"CASE WHEN contains(v, '/') THEN {frac} ELSE TRY_CAST(replace(v, ',', '') AS DOUBLE) END"
    nums = f"list_transform({_groups(text, number, 7)}, lambda n: {upper})"
    nums = f"list_transform({nums}, lambda w: CASE w {words} ELSE w END)"
    nums = f"list_filter({nums}, lambda w: NOT starts_with(w, '0'))"
    nums = f"list_transform({nums}, lambda w: replace(replace(w, '>', ''), '<', ''))"
    nums = f"list_filter(list_transform({nums}, lambda v: {value}), lambda x: x IS NOT NULL AND x <> 0)"
    nums = f"list_transform({nums}, lambda x: CASE WHEN x < 10 THEN x * 1000 ELSE x END)"
    if not annotation:
        nums = f"list_filter({nums}, lambda x: NOT (x >= 10 AND x < 100))"
    return f"list_transform({nums}, lambda x: CAST(x AS VARCHAR))"


def annotations_processed() -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(), select=f"""
SELECT *, CASE WHEN label_type = 'estimated blood loss'
               THEN array_to_string({_blood_loss_sql('span', True)}, '|') ELSE span END AS clean_span FROM annot_deliv""")


def _ebl_gold_ctes() -> str:
    """ie (gold spans of each annotated note) as in ``labels_ie``, with the cleaned ones."""
    ctes = labels_ie().split("grp AS (", 1)[1].rsplit("\nSELECT Report_Number", 1)[0]
    clean = f"flatten(list_transform(spans, lambda s: {_blood_loss_sql('s', True)}))"
    return f"grp AS ({ctes},\nebl_gold AS (SELECT *, {clean} AS clean_spans FROM ie)"


def _ebl_eval_ctes() -> str:
    rx, _ = _ebl_rule()
    rx = rx.replace("([^0-9])", "[^0-9]")
    return f"""
{_ebl_gold_ctes()},
ebl_found AS (SELECT Report_Number, EMPI, Report_Date_Time, list_filter({_groups('Report_Text', rx, 4)}, lambda x: x <> '')
                AS predictions FROM annotated),
ebl_ev AS (
  SELECT g.*, f.predictions,
    flatten(list_transform(f.predictions, lambda s: {_blood_loss_sql('s', False)})) AS clean_predictions
  FROM ebl_gold g LEFT JOIN ebl_found f USING (Report_Number, EMPI, Report_Date_Time))"""


def ebl_regex_predictions() -> str:
    lists = ", ".join(f"array_to_string({c}, ' || ') AS {c}" for c in
                      ("spans", "clean_spans", "predictions", "clean_predictions"))
    return with_fixtures(cohort_ctes(), annotation_ctes(), _ebl_eval_ctes(),
                         select=f"SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, {lists} FROM ebl_ev")


def _ie_metrics(src: str, gold: str, pred: str) -> str:
    """The common values of both lists (as sets) against the lengths of the lists."""
    return f"""
SELECT sum(common) / nullif(sum(n_gold), 0) AS recall_labels, sum(common) / nullif(sum(n_pred), 0) AS precision_labels,
       avg(CAST(common = n_gold AS INTEGER)) AS recall_notes, avg(CAST(same AS INTEGER)) AS exact_match_notes,
       count(*) FILTER (n_gold > 0) AS total_notes_with_true_annotation
FROM (SELECT len(list_intersect(list_distinct({gold}), {pred})) AS common, len({gold}) AS n_gold, len({pred}) AS n_pred,
             list_sort(list_distinct({gold})) = list_sort(list_distinct({pred})) AS same FROM {src})"""


def metrics_regex_ie() -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(), _ebl_eval_ctes(),
                         select=_ie_metrics("ebl_ev", "clean_spans", "clean_predictions"))


def _zero_shot_ctes(prompt: str) -> str:
    rx, extra = _ebl_rule()
    m = lambda g: f"regexp_extract(chunk_text, {_sql_str('(?i)' + rx)}, {g})"
    answer = (f"CASE WHEN regexp_matches(chunk_text, {_sql_str('(?i)' + rx)}) "
              f"THEN left({m(0)}, len({m(0)}) - len({m(extra)})) ELSE 'unanswerable' END")
    return f"""
{_ebl_gold_ctes()},
zs_chunks AS ({_chunk_sql("annotated", str(512 - len(prompt.split())))}),
zs AS (SELECT Report_Number, EMPI, Report_Date_Time, list({answer} ORDER BY chunk_idx) AS raw_preds
       FROM zs_chunks GROUP BY Report_Number, EMPI, Report_Date_Time),
zs_found AS (SELECT *, list_sort(list_distinct(list_filter(raw_preds, lambda x: x <> 'unanswerable'))) AS extracted FROM zs),
zs_ev AS (
  SELECT g.Report_Number, g.EMPI, g.Report_Date_Time, g.MRN_Type, list_sort(list_distinct(g.clean_spans)) AS spans,
    CASE WHEN f.raw_preds IS NOT NULL THEN {_sql_str(prompt)} END AS prompt, f.raw_preds, f.extracted,
    coalesce(list_sort(list_distinct(flatten(list_transform(f.extracted, lambda s: {_blood_loss_sql('s', False)})))), [])
      AS clean_predictions
  FROM ebl_gold g LEFT JOIN zs_found f USING (Report_Number, EMPI, Report_Date_Time))"""


def zero_shot_extraction(prompt: str) -> str:
    lists = ", ".join(f"array_to_string({c}, ' || ') AS {c}" for c in
                      ("spans", "raw_preds", "extracted", "clean_predictions"))
    return with_fixtures(cohort_ctes(), annotation_ctes(), _zero_shot_ctes(prompt),
                         select=f"SELECT Report_Number, EMPI, Report_Date_Time, MRN_Type, prompt, {lists} FROM zs_ev")


def metrics_zero_shot_ie(prompt: str) -> str:
    return with_fixtures(cohort_ctes(), annotation_ctes(), _zero_shot_ctes(prompt),
                         select=_ie_metrics("zs_ev", "spans", "clean_predictions"))


def spans_plain() -> str:
    from cohortlens.operators.spans import _cui, single_rules
    parts = []
    for label, p in single_rules(lookaround=False):
        rx = _sql_str("(?i)" + p)
        parts.append(f"""
SELECT EMPI, Report_Number, Report_Date_Time, {_sql_str(_cui(label))} AS cui,
       list_transform(string_split_regex(Report_Text, {rx}), lambda x: length(x)) AS pl,
       list_transform(regexp_extract_all(Report_Text, {rx}), lambda x: length(x)) AS ml
FROM cohort WHERE Report_Text IS NOT NULL""")
    return with_fixtures(cohort_ctes(), "sp AS (" + " UNION ALL ".join(parts) + ")", select="""
SELECT EMPI, Report_Number, Report_Date_Time,
       CAST(coalesce(list_sum(list_slice(pl, 1, i)), 0) + coalesce(list_sum(list_slice(ml, 1, i - 1)), 0) AS INTEGER) AS start,
       CAST(coalesce(list_sum(list_slice(pl, 1, i)), 0) + coalesce(list_sum(list_slice(ml, 1, i)), 0) AS INTEGER) AS "end",
       cui
FROM sp, unnest(range(1, len(ml) + 1)) AS r(i)""")


# --- spans with groups or lookaround (P1-P7, P11, P15-P18, P28-P30, P32) ---------------------------------------
# A rule with groups is stated as alternatives (before, group, behind), each part a group of its own: where a match
# begins is the sum of the pieces and matches before it, and the group begins behind its "before". A rule with lookaround
# is matched without it, and each occurrence is tested by the characters around it.

_GA, _HOUR = r"[0-9]{1,2}w[0-9]{1,2}d", r"[0-9]{1,2}:[0-9]{1,2} (?:AM|PM)"
_DAY = r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"
_GROUP_RULES = {
    "gestational age": [("", r"[0-9./]+", r"\s+(?:weeks|wk|wks|week)\s+gestation"), (r"gestational age:\s+", _GA, ""),
                        ("", _GA, " gestation"), ("", r"[0-9 /+-]+", "(?:wk|w|wks|week|weeks) ga")],
    "date of delivery": [("delivery date: ", _DAY, ""), ("delivered.*on ", _DAY, ""), ("(?:date of delivery|delivery date).*?", _DAY, "")],
    "time of delivery": [(" delivery time: ", _HOUR, ""), ("delivered.*at ", _HOUR, ""), ("(?:time of delivery|delivery date).*?", _HOUR, "")],
    "estimated date of delivery": [("edc.{0,10}?", "[0-9/-]+", ""), ("estimated date of delivery.*?", "[0-9/-]+", ""),
                                   ("estimated edc.*?", "[0-9]{1,2}/[0-9]{1,2}/[0-9]{1,2}", "")],
    "last menstrual period": [("last menstrual period.{0,50}?", _DAY, ""), ("lmp ", _DAY, "")],
    "estimated blood loss": [("", "[0-9]+", " ?(?:ml)? blood loss"), ("blood loss.*?", "[0-9]+", "(?: *cc)?"),
                             (r"ebl:?\s*", "[0-9]+", ""), ("pph.{0,10}", "[0-9]+", " ?cc")],
    "transfusion amount": [("transfusion.*", "[0-9]", " units"), ("", "[0-9]", " units prbc")],
    "laceration grade": [("", "[a-z0-9]*", " degree (?:laceration|tear)"), ("laceration.*?", "[a-z0-9]*", " degrees?")],
}
# label -> (core without lookaround, what each occurrence is tested for)
_LOOK_RULES = {
    "PPH": (r"pphemorrhage|pph |postpartum\s*hemorrhage|post-partum\s*hemorrhage", "no, hx"),
    "uterine atony": ("uterine atony|atony", "no"), "placenta previa": (r"placenta\s*previa", "no"),
    "placenta accreta spectrum": (r"placenta\s*accreta|placenta\s*percreta|placenta\s*increta", "no"),
    "retained products of conception": ("retained poc|retained products of conception", "no"),
    "abruption of the placenta": ("placental abruption|abruptio placenta|abruptio placentae", "no"),
    "laceration": ("laceration|tear", "no, no behind"),
    "transfusion type": (r"packed\s*red\s*blood\s*cells|red\s*blood\s*cells|plasma|platelets|prbc|cryoprecipitate|cryo|ffp", "count"),
}
_SPAN_KEY = "EMPI, Report_Number, Report_Date_Time"


def _matches(label: str, rx: str, extra: str = "") -> str:
    """Rows (key, cui, text, lengths of pieces and matches) of one rule."""
    full = _sql_str("(?i)" + rx)
    return f"""
SELECT {_SPAN_KEY}, {_sql_str(label)} AS cui, Report_Text AS t{extra},
       list_transform(string_split_regex(Report_Text, {full}), lambda x: length(x)) AS pl,
       list_transform(regexp_extract_all(Report_Text, {full}), lambda x: length(x)) AS ml
FROM cohort WHERE Report_Text IS NOT NULL"""


_AT = "CAST(coalesce(list_sum(list_slice(pl, 1, i)), 0) + coalesce(list_sum(list_slice(ml, 1, i - 1)), 0) AS BIGINT)"


def spans_multi() -> str:
    parts = []
    for label, alternatives in _GROUP_RULES.items():
        rx = "|".join(f"({a})({g})({b})" for a, g, b in alternatives)
        full = _sql_str("(?i)" + rx)

        def lens(offset: int, n: int = len(alternatives), full: str = full) -> str:
            lists = ", ".join(f"regexp_extract_all(Report_Text, {full}, {3 * k + offset})" for k in range(n))
            return f"list_transform(list_zip({lists}), lambda z: length(concat({', '.join(f'z[{k + 1}]' for k in range(n))})))"
        parts.append(_matches(label, rx, f", {lens(1)} AS bl, {lens(2)} AS gl"))
    return with_fixtures(cohort_ctes(), "sp AS (" + " UNION ALL ".join(parts) + ")", select=f"""
SELECT {_SPAN_KEY}, CAST({_AT} + bl[i] AS INTEGER) AS start, CAST({_AT} + bl[i] + gl[i] AS INTEGER) AS "end", cui
FROM sp, unnest(range(1, len(ml) + 1)) AS r(i)""")


def spans_lookaround() -> str:
    parts = [_matches(label, rx, f", {_sql_str(kind)} AS kind") for label, (rx, kind) in _LOOK_RULES.items()]
    no = "(a >= 3 AND lower(substr(t, a - 2, 3)) = 'no ')"
    return with_fixtures(cohort_ctes(), "sp AS (" + " UNION ALL ".join(parts) + ")", f"""
occ AS (SELECT *, a + ml[i] AS z FROM (SELECT sp.*, i, {_AT} AS a FROM sp, unnest(range(1, len(ml) + 1)) AS r(i))),
tested AS (SELECT *, CASE kind
    WHEN 'no' THEN NOT {no}
    WHEN 'no, hx' THEN NOT {no} AND NOT (a >= 6 AND lower(substr(t, a - 5, 6)) = 'hx of ')
    WHEN 'no, no behind' THEN NOT {no} AND NOT regexp_matches(substr(t, z + 1, 12), '^[^\n]{{0,10}}(?i:no)')
    ELSE lower(substr(t, a + 1, 9)) <> 'platelets' OR (NOT (a >= 3 AND regexp_matches(substr(t, a - 2, 3), '^[0-9]{{2}} $'))
         AND NOT regexp_matches(substr(t, z + 1, 12), '^[^\n]{{0,10}}[0-9]{{2}}')) END AS ok FROM occ)""", select=f"""
SELECT {_SPAN_KEY}, CAST(a AS INTEGER) AS start, CAST(z AS INTEGER) AS "end", cui FROM tested WHERE ok
UNION ALL
SELECT {_SPAN_KEY}, CAST(a + 8 AS INTEGER), CAST(z AS INTEGER), cui FROM tested
WHERE NOT ok AND cui = 'uterine atony' AND z - a = 13""")


# --- composite metrics (C5) --------------------------------------------------------------------------------

def metrics_composites() -> str:
    from cohortlens.functions.concepts import COMPOSITE_GOLD
    union = " UNION ALL ".join(
        f"SELECT {_sql_str(name)} AS label, y.y, c.predictions AS prediction FROM {_composite_sql(name)} c "
        f"JOIN labels_long y ON y.label = {_sql_str(gold)} AND y.EMPI = c.EMPI AND y.Report_Number = c.Report_Number "
        f"AND y.Report_Date_Time = c.Report_Date_Time"
        for name, gold in COMPOSITE_GOLD.items())
    sql = metrics_regex_binary()
    head, select = sql.split("\nSELECT label,\n", 1)
    return with_fixtures(cohort_ctes(), annotation_ctes(), concept_ctes("annotated"), f"""
ev AS ({union}),
cm AS (
  SELECT label, sum(CASE WHEN y = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN y = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS tn,
    sum(CASE WHEN y = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN y = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS fn
  FROM ev GROUP BY label)""", select="SELECT label,\n" + select)
