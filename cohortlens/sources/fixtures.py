"""Fixture views over the driver's test tables.

The reference works on protected hospital exports that are not shipped, so every
registered query runs on views that Spark derives from the driver tables:

* ``notes``       – one discharge note per ``documents`` row (whole text, never a prefix),
                    with the note header fields derived from ``doc_id``; some documents
                    are exported twice (exact duplicates), as real exports are.
* ``diagnoses``   – one diagnosis row per ``events`` row.
* ``raw_annotations`` – annotator decisions on the notes; each span is located inside the note text, so ``start``/``end`` are real offsets.

All of it is column arithmetic on a single scan of each table (no joins, no
shuffles); the small phrase/code tables are literal arrays indexed per row.
The DuckDB twin of these views lives in :mod:`cohortlens.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the fixture (test-data shaping, not reference logic).
# ---------------------------------------------------------------------------
PHRASES = [
    "Delivery by cesarean section. EBL 1200 cc. Uterine atony treated with hemabate.",
    "No uterine atony. EBL: 800ml. SVD. pregnancy",
    "PPH of 2 liters blood loss, Bakri balloon placed after delivery.",
    "No pregnancy complications. platelets 250 on admission",
    "Transfused 2 units prbc and platelets given; dic suspected after delivery",
    "laceration repaired after labor , second degree tear",
    "No laceration. Labor induced with misoprostol. delivery",
    "hx of PPH ; placenta previa in pregnancy",
    "manual removal of the placenta, retained placenta, delivery",
    "c-section with uterine extension, hysterectomy",
    "Discharge Instructions. Please bring these discharge instructions to your follow-up appointments. delivery",
    "****** DISCHARGE ORDERS ****** delivery",
    "estimated EDC 03/04/2014, lmp 05/28/2013, delivered on 3/5/2014 at 10:15 PM",
    "39 weeks gestation. L&D admission. EBL 500-800 cc",
    "methergine and cytotec given; FFP and cryo transfused; delivery",
    "Cardiology follow-up, routine.",
    "Placenta accreta with placenta percreta found at cesarean section; hysterectomy for placenta increta.",
    "Placental abruption at delivery, no placenta accreta. Coagulopathy, low platelets.",
    "Dilation and curettage for retained POC after delivery.",
    "Uterine rupture in labor , artery laceration repaired; broad ligament laceration.",
    "B-Lynch and O'Leary sutures placed at cesarean section for uterine atony.",
    "Vacuum extraction, then forceps delivery of a vertex infant.",
    "Extension of the uterine incision, extension into the vagina; delivery with PPH .",
    "Vaginal laceration and a tear of the perineal body, no tear periurethral region; perineal delivery, vaginal laceration.",
    "Delivery: transfusion of 2 units, platelets 30 after; no uterine atony, no placental abruption; time of delivery 3:05 AM.",
]
#: One diagnosis in so many is dated like a note of its patient.
DATED_LIKE_A_NOTE = 3
CODES = ["666.02", "666.12", "666.22", "666.32", "665.24", "664.01",
         "656.03", "641.11", "650", "V27.0", "669.71", "641.91"]
# (phrase index, label_type, span text inside that phrase)
PHRASE_LABELS = [
    (0, "c-section", "cesarean section"), (0, "estimated blood loss", "1200 cc."),
    (1, "estimated blood loss", "800ml"), (2, "PPH", "PPH"), (2, "estimated blood loss", "2 liters"),
    (4, "transfusion type", "prbc"), (4, "transfusion type", "platelets"),
    (5, "laceration", "laceration"), (7, "placenta previa", "placenta previa"),
    (8, "manual extraction of placenta", "manual removal"), (9, "hysterectomy", "hysterectomy"),
    (14, "transfusion type", "FFP"), (14, "transfusion type", "cryo"),
    (15, "not a delivery note", "routine."),
    (16, "placenta accreta spectrum", "Placenta accreta"), (16, "hysterectomy", "hysterectomy"),
    (17, "abruption of the placenta", "Placental abruption"),
    (18, "dilation & curettage", "Dilation and curettage"),
    (18, "retained products of conception", "retained POC"),
    (19, "Uterine rupture", "Uterine rupture"), (19, "laceration", "laceration"),
    (20, "B-Lynch sutures", "B-Lynch"), (20, "O'Leary sutures", "O'Leary"), (20, "uterine atony", "uterine atony"),
    (21, "vaginal - vacuum extraction", "Vacuum extraction"), (21, "vaginal - forceps", "forceps"),
    (22, "PPH - surgical causes", "Extension"), (22, "PPH", "PPH"),
]
BASE_DATE = "2014-01-01"
#: Documents of a patient and of a report number: both grow with the table, and a report number is shared between
#: patients now and then. Every tenth document belongs to one patient, who is skewed at any size.
DOCS_PER_PATIENT, DOCS_PER_REPORT, SKEWED_PATIENT = 7, 4, 1


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pick(values: list[str], idx: Column) -> Column:
    """Literal lookup ``values[idx]`` evaluated per row (no join)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), idx.cast("int") + 1)


def _base_day(offset_days: Column) -> Column:
    return F.date_add(F.lit(BASE_DATE).cast("date"), offset_days.cast("int")).cast("timestamp_ntz")


def _note_columns(d: DataFrame) -> DataFrame:
    doc = F.col("doc_id")
    empi = (F.when(doc % 97 == 5, F.lit(None).cast("bigint")).when(doc % 10 == 3, F.lit(SKEWED_PATIENT).cast("bigint"))
            .otherwise(F.floor(doc / DOCS_PER_PATIENT)))
    site = F.when(empi % 3 == 0, F.lit("MGH")).otherwise(F.lit("BWH"))
    mrn_type = (F.when(doc % 31 == 0, F.lit(None).cast("string"))
                .when(empi % 3 == 0, F.lit("MGH"))
                .when((doc % 5 == 0) & (empi % 2 == 1), F.lit("MGH"))
                .otherwise(F.lit("BWH")))
    desc = (F.when(doc % 11 == 0, F.lit("ED Discharge Summary"))
            .when(doc % 11 == 1, F.lit("ED Observation Discharge Summary"))
            .when(doc % 11 == 2, F.lit(None).cast("string"))
            .otherwise(F.lit("Discharge Summary")))
    ts = _base_day((doc * 37) % 700) + F.make_dt_interval(F.lit(0), ((doc % 3) * 8).cast("int"))
    text = F.when(doc % 53 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.col("text"), F.lit(" | "), _pick(PHRASES, doc % len(PHRASES))))
    return d.select(
        doc.alias("doc_id"),
        empi.alias("EMPI"),
        F.concat(F.lit("E"), empi.cast("string")).alias("EPIC_PMRN"),
        mrn_type.alias("MRN_Type"),
        F.concat(site, F.lit("-"), empi.cast("string")).alias("MRN"),
        F.when(doc % 89 != 7, F.concat(site, F.lit("/"), F.floor(doc / DOCS_PER_REPORT).cast("string")))
         .alias("Report_Number"),
        ts.alias("Report_Date_Time"),
        desc.alias("Report_Description"),
        F.when(doc % 7 == 0, F.lit("P")).otherwise(F.lit("F")).alias("Report_Status"),
        F.lit("DS").alias("Report_Type"),
        text.alias("Report_Text"),
    )


NOTE_FIELDS = ["EMPI", "EPIC_PMRN", "MRN_Type", "MRN", "Report_Number", "Report_Date_Time",
               "Report_Description", "Report_Status", "Report_Type", "Report_Text"]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw note export: the 10 note fields; every 25th document appears twice."""
    n = _note_columns(_docs(spark, sf_dir))
    copies = F.sequence(F.lit(1), F.when(F.col("doc_id") % 25 == 0, 2).otherwise(1))
    return n.select(*NOTE_FIELDS, F.explode(copies).alias("_copy")).drop("_copy")


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnosis export (D2 layout) from ``events``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    eid = F.col("event_id")
    code = _pick(CODES, eid % len(CODES))
    return e.select(
        F.col("user_id").alias("EMPI"),
        _base_day(F.when(eid % DATED_LIKE_A_NOTE == 0, ((F.col("user_id") * DOCS_PER_PATIENT + eid % DOCS_PER_PATIENT) * 37) % 700)
                  .otherwise((eid * 13) % 700)).alias("Date"),
        F.concat(F.lit("Diagnosis "), code).alias("Name"),
        F.lit("ICD9").alias("Code_Type"),
        code.alias("Code"),
        F.col("event_type").alias("Flag"),
        F.when(F.col("event_type").isin("purchase", "signup"), F.lit("Inpatient"))
         .otherwise(F.lit("Outpatient")).alias("Inpatient_Outpatient"),
        eid.alias("Encounter_number"),
    )


def raw_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotator records (one per label assertion) on every note with text and a key to name its file by.

    Columns: EMPI, Report_Number (as written in the annotator file name, i.e. with
    ``/`` replaced by ``_``), Report_Date_Time, annotator, decision, label_type,
    start, end (0-based, half-open code-point offsets into Report_Text).
    """
    n = _note_columns(_docs(spark, sf_dir)).filter(
        F.col("Report_Text").isNotNull() & F.col("EMPI").isNotNull() & F.col("Report_Number").isNotNull())
    labs = F.array(*[F.struct(F.lit(p).alias("pid"), F.lit(l).alias("label_type"), F.lit(s).alias("span"))
                     for p, l, s in PHRASE_LABELS])
    pid = (F.col("doc_id") % len(PHRASES)).cast("int")
    doc = F.col("doc_id")
    phrase = _pick(PHRASES, pid)
    mine = F.filter(labs, lambda x: x["pid"] == pid)
    out = n.select(
        "doc_id", "EMPI", F.regexp_replace("Report_Number", "/", "_").alias("Report_Number"),
        "Report_Date_Time", "Report_Text", phrase.alias("_phrase"),
        F.when(doc % 2 == 0, F.lit("annA")).otherwise(F.lit("annB")).alias("annotator"),
        F.when(doc % 17 == 0, F.lit("rejected")).when(doc % 19 == 0, F.lit("undecided"))
         .otherwise(F.lit("accepted")).alias("decision"),
        F.explode(mine).alias("_l"),
    )
    start = F.length("Report_Text") - F.length("_phrase") + F.instr("_phrase", F.col("_l.span")) - 1
    return out.select(
        "doc_id", "EMPI", "Report_Number", "Report_Date_Time", "annotator", "decision",
        F.col("_l.label_type").alias("label_type"),
        start.cast("int").alias("start"),
        (start + F.length(F.col("_l.span"))).cast("int").alias("end"),
        "Report_Text",
    )


#: Every so many documents, an annotator file that is no JSON.
BROKEN_FILE = 41


def annotator_file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_name, Report_Text, json: annotator files as three versions of a tool write them.

    One record for each label; or one record for all labels of a note, with offsets as text and a label too many; or
    one record with categories as plain names and a span too many, and fields that the others do not have."""
    from cohortlens.operators.annotations import _category_map, annotation_file_name
    raw = raw_annotations(spark, sf_dir)
    name = F.regexp_replace(annotation_file_name(F.col("annotator"), "", F.col("EMPI"), F.col("Report_Number"),
                                                 F.col("Report_Date_Time")), r"\.txt$", ".json")
    category = F.coalesce(F.element_at(_category_map(), F.col("label_type")), F.lit("Other"))
    files = raw.groupBy(name.alias("file_name"), "doc_id", "decision").agg(
        F.min("Report_Text").alias("Report_Text"),
        F.sort_array(F.collect_list(F.struct("start", "end", "label_type", category.alias("category")))).alias("m"))

    def label(x: Column, plain: bool = False) -> Column:
        kinds = F.array(x["category"]) if plain else F.array(F.struct(x["category"].alias("type")))
        return F.struct(F.lit(1).alias("labelId"), x["label_type"].alias("title"), kinds.alias("categories"))

    def span(x: Column, kind: str = "int") -> Column:
        return F.struct(x["start"].cast(kind).alias("start"), x["end"].cast(kind).alias("end"))

    own = F.transform("m", lambda x: F.struct(F.col("decision"), F.lit(True).alias("CUIMode"), F.array(label(x)).alias("labels"),
                                              F.array(span(x)).alias("spans")))
    more = F.concat(F.transform("m", lambda x: label(x)), F.transform(F.slice("m", 1, 1), lambda x: label(x)))
    textual = F.array(F.struct("decision", more.alias("labels"), F.transform("m", lambda x: span(x, "string")).alias("spans")))
    spans = F.concat(F.transform("m", lambda x: span(x)), F.transform(F.slice("m", 1, 1), lambda x: span(x)))
    named = F.array(F.struct("decision", F.lit("v3").alias("tool"), F.transform("m", lambda x: label(x, True)).alias("labels"),
                             spans.alias("spans"), F.array(F.lit(1), F.lit(2)).alias("history")))
    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, F.to_json(own)).when(kind == 1, F.to_json(textual)).otherwise(F.to_json(named))
    return files.select("file_name", "Report_Text",
                        F.when(F.col("doc_id") % BROKEN_FILE == 0, F.lit("[{")).otherwise(text).alias("json"))


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demographic export from ``customer``: a patient number, a name with a ``|`` now and then, a segment, an address."""
    c = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        c.alias("EMPI"), F.when(c % 5 == 0, F.concat(F.col("c_name"), F.lit(' | "'))).otherwise(F.col("c_name")).alias("Name"),
        F.col("c_mktsegment").alias("Segment"), F.when(c % 7 != 0, F.date_add(F.lit("1950-01-01").cast("date"), (c % 20000).cast("int")))
        .cast("string").alias("Date_of_Birth"))


# ---------------------------------------------------------------------------
# Fixed values of the fixture: answers as models and annotators write them, with {fields} filled from each document.
# ---------------------------------------------------------------------------
ANSWERS = {
    "estimated blood loss": [
        "{ml} cc", "EBL {ml}", "{ml} EBL", "{lo}-{ml} ml", "{k} liters", "<{ml}", "{word}", "{th},{c3} ml", "{dd}",
        "no blood loss noted", "1/2 liter", "1-1/2 liters", "0.5 l", "{word} liters", "{th}0000000"],
    "transfusion amount": ["{word} units of prbc", "{one} units", "10 units", "1{one} units", "1/{one} unit", "not given"],
    "transfusion type": [
        "{one} units prbc", "{dd} ml saline", "{one} Units of Platelets", "packed red blood cells x{one}", "cryo {one} u"],
    "laceration grade": ["{one}th degree", "second-degree", "severe", "1{one}th degree", "grade {one}"],
    "laceration anatomy": ["second degree perineal, {one}", "2nd degree vaginal", "periurethral", "{one} degrees"],
    "gestational age": [
        "{ga} weeks", "{ga} {gd}/7 weeks", "{ga}w{gd}d", "{ga} wks", "term", "on {m}/{d}/{y} at {ga} weeks"],
    "time of delivery": [
        "{h}:{mm} PM", "born at {h}:{mm} am", "{H}:{mm}", "{HH}{mm}", "{H}:{mm}:{ss}", "{one} PM", "{h}:{mm}p.m. EST",
        "{mo}/{da}/{y} at {h}:{mm} AM", "{H}:{mm} or {h}:{mm} PM", "3{one}:{mm}", "not recorded"],
    "date of delivery": [
        "{mo}/{da}/{y}", "{m}/{d}/{yy}", "{m}-{d}-{yy}", "{month} {d}, {y}", "{month} {d}", "{m}/{d}", "{m}/{y}",
        "{m}/{d}/{y}, then {mo}/{da}/{yy}", "unknown"],
    "fraction": ["{one}/8", "{k} {one}/8", "-{k} {one}/8", "{th},{c3}", "{ml}", "{one}/8/{one}"],
}
NUMBER_NAMES = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
               "november", "december"]


def _answer_fields(n: Column, size: Column) -> dict[str, Column]:
    """Fields of the answers, from the document's number and the length of its text."""
    def pad(c: Column, width: int = 2) -> Column:
        return F.lpad(c.cast("string"), width, "0")

    one, hour, month, day, year = 1 + (n + size) % 9, 1 + size % 12, 1 + size % 12, 1 + n % 28, 2010 + n % 9
    plain = {"ml": 100 + (n * 37 + size) % 2900, "lo": 100 + n % 50, "k": 1 + size % 4, "th": 1 + n % 9,
             "dd": 10 + size % 90, "one": one, "ga": 24 + size % 18, "gd": n % 7, "h": hour, "H": size % 24,
             "m": month, "d": day, "y": year}
    padded = {"c3": pad(size % 1000, 3), "mm": pad(n * 7 % 60), "ss": pad((n + size) % 60), "HH": pad(size % 24),
              "mo": pad(month), "da": pad(day), "yy": pad(year % 100)}
    named = {"word": _pick(NUMBER_NAMES, one - 1), "month": _pick(MONTH_NAMES, month - 1)}
    return {**{k: v.cast("string") for k, v in plain.items()}, **padded, **named}


def answers(spark: SparkSession, sf_dir: str, labels: list[str], shift: int = 0) -> DataFrame:
    """doc_id, label_type, answer: for every document one answer to each label (``shift`` places before its own)."""
    n = F.col("doc_id")
    fields = _answer_fields(n, F.coalesce(F.length("text"), F.lit(0)))

    def filled(label: str) -> Column:
        size = len(ANSWERS[label])
        out = _pick(ANSWERS[label], (n + (size - shift)) % size)
        for name in sorted({f for a in ANSWERS[label] for f in fields if "{" + f + "}" in a}):
            out = F.replace(out, F.lit("{" + name + "}"), fields[name])
        return out

    rows = F.array(*[F.struct(F.lit(x).alias("label_type"), filled(x).alias("answer")) for x in labels])
    return _docs(spark, sf_dir).select("doc_id", F.inline(rows))
