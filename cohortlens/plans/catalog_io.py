"""Queries that write exports and read them again through the library's readers, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators import annotations, metrics
from cohortlens.plans import catalog, oracle
from cohortlens.sources import annotation_files, readers
from cohortlens.sources import fixtures as fx
from cohortlens.sources.note_files import read_files


def _annotator_files(spark: SparkSession, sf_dir: str) -> str:
    path = catalog._scratch(spark, "annotator-files")
    annotation_files.write_annotation_files(fx.annotator_file_texts(spark, sf_dir), path)
    return path


def q_io_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO11, IO12, N1-N7: annotator files of three shapes, with several labels and spans in a record and lists of unequal
    length, written, read and flattened."""
    files = annotation_files.read_annotation_files(spark, _annotator_files(spark, sf_dir))
    return annotations.flatten_annotations(files, catalog.ANNOTATORS, empi_type="bigint")


def q_io_annotations_unreadable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotator files that are no JSON array."""
    return annotation_files.unreadable_files(spark, _annotator_files(spark, sf_dir))


def q_category_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with more or less than one category, on files where every fifth note's labels got a second one."""
    texts = fx.annotator_file_texts(spark, sf_dir)
    number = F.regexp_extract("file_name", r"empi_([0-9]+)_", 1).cast("bigint")
    two = F.when(number % 5 == 0, F.replace("json", F.lit('"categories":["'), F.lit('"categories":["Second","'))).otherwise(F.col("json"))
    path = catalog._scratch(spark, "annotator-files")
    annotation_files.write_annotation_files(texts.withColumn("json", two), path)
    found = annotations.category_violations(annotation_files.read_annotation_files(spark, path))
    return found.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))


def q_io_diagnoses_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO3-IO5, F1, F2, F17: all diagnoses written as pipe-delimited files and read again up to the cut-off."""
    path = catalog._scratch(spark, "diagnoses")
    readers.write_diagnoses(fx.diagnoses(spark, sf_dir), path)
    return readers.read_diagnoses(spark, path, "*.csv")


def q_io_demographics_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO7: all demographics written as pipe-delimited files and read again, every field as text."""
    path = catalog._scratch(spark, "demographics")
    readers.write_demographics(fx.demographics(spark, sf_dir), path)
    return readers.read_demographics(spark, path, "*.csv")


METRICS = "label string, acc double, macro_f1 double, binary_f1 double, precision double, recall double, tp long, tn long, fp long, fn long, n long"


def q_io_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO14: the metrics of each label written as a JSON file of its own, all read again."""
    path = catalog._scratch(spark, "metrics")
    annotation_files.write_metrics(metrics.binary_metrics(catalog._regex_eval(spark, sf_dir)), path, "label", "regex_")
    return annotation_files.read_metrics(spark, path, METRICS)


def q_io_preannotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO13, IO15: every cohort note as a text file and its suggested spans as a CSV file beside it; names and sizes of
    the text files, and the lines of the CSV files, read again."""
    path = catalog._scratch(spark, "notes-for-annotation")
    notes = catalog._cohort(spark, sf_dir).where("EMPI IS NOT NULL AND Report_Number IS NOT NULL").withColumn(
        "file_name", annotations.annotation_file_name(F.lit("annA"), "", F.col("EMPI"), F.col("Report_Number"), F.col("Report_Date_Time")))
    readers.export_note_files(notes, path)
    annotation_files.export_preannotations(notes, path)
    texts = read_files(spark, path, "*.txt").select("file_name", F.length("content").alias("n_chars"))
    lines = read_files(spark, path, "*.csv").select(
        F.regexp_replace("file_name", r"\.csv$", ".txt").alias("file_name"), F.size(F.split("content", "\n")).alias("lines"))
    return texts.join(lines, "file_name").select("file_name", "n_chars", (F.col("lines") - 2).alias("n_spans"))


QUERIES = {
    "io_annotations": q_io_annotations, "io_annotations_unreadable": q_io_annotations_unreadable,
    "category_violations": q_category_violations, "io_diagnoses_roundtrip": q_io_diagnoses_roundtrip,
    "io_demographics_roundtrip": q_io_demographics_roundtrip, "io_metrics_json": q_io_metrics_json,
    "io_preannotations": q_io_preannotations,
}


# --- DuckDB SQL ---------------------------------------------------------------------------------------------------
_NAME = ("annotator || '_notes_empi_' || CAST(EMPI AS VARCHAR) || '_note_' || Report_Number || '_time_' || "
         "strftime(Report_Date_Time, '%Y-%m-%d %H:%M:%S')")


def io_annotations() -> str:
    ctes = oracle.annotation_ctes().replace("FROM annot_raw a LEFT JOIN", f"FROM annot_read a LEFT JOIN")
    return oracle.with_fixtures(
        oracle.cohort_ctes(), f"annot_read AS (SELECT * FROM annot_raw WHERE doc_id % {fx.BROKEN_FILE} <> 0)", ctes,
        select="SELECT * FROM annot_flat")


def io_annotations_unreadable() -> str:
    return oracle.with_fixtures(select=f"""
SELECT DISTINCT {_NAME} || '.json' AS file_name, 'no JSON array' AS reason FROM annot_raw WHERE doc_id % {fx.BROKEN_FILE} = 0""")


def category_violations() -> str:
    return oracle.with_fixtures(select=f"""
SELECT {_NAME} || '.json' AS file_name, count(*) AS n FROM annot_raw
WHERE doc_id % {fx.BROKEN_FILE} <> 0 AND doc_id % 3 = 2 AND EMPI % 5 = 0 AND decision NOT IN ('rejected', 'undecided')
GROUP BY 1""")


def io_diagnoses_roundtrip() -> str:
    from cohortlens.operators.cohort import DATE_CUTOFF
    return oracle.with_fixtures(select=f"""
SELECT CAST(EMPI AS VARCHAR) AS EMPI, Date, Name, Code_Type, Code, Flag, Inpatient_Outpatient,
  CAST(Encounter_number AS VARCHAR) AS Encounter_number FROM dx_v WHERE Date < TIMESTAMP '{DATE_CUTOFF}'""")


def io_demographics_roundtrip() -> str:
    return """
SELECT CAST(c_custkey AS VARCHAR) AS EMPI, CASE WHEN c_custkey % 5 = 0 THEN c_name || ' | "' ELSE c_name END AS Name,
  c_mktsegment AS Segment,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER) AS VARCHAR) END AS Date_of_Birth
FROM customer"""


def io_metrics_json() -> str:
    names = ", ".join(f.split()[0] for f in METRICS.split(", "))
    return f"SELECT {names} FROM ({oracle.metrics_regex_binary()})"


ORACLE = {
    "io_annotations": io_annotations, "io_annotations_unreadable": io_annotations_unreadable,
    "category_violations": category_violations, "io_diagnoses_roundtrip": io_diagnoses_roundtrip,
    "io_demographics_roundtrip": io_demographics_roundtrip, "io_metrics_json": io_metrics_json,
}
