"""Annotator files of any shape (IO11, IO12), pre-annotations and metrics as files (IO14, IO15).

Annotation tools differ in the fields they write: offsets as numbers or as text, categories as objects or names, fields
left out or added. A file is parsed once into a VARIANT, and only what the library needs is taken out of it by path,
with a cast that gives null where a field has another type. A file that is no JSON array is kept apart, not dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.spans import preannotate
from cohortlens.sources.note_files import read_files, write_files


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _label(v: Column) -> Column:
    types = F.transform(_list(v, "$.categories"), lambda c: F.coalesce(
        F.try_variant_get(c, "$.type", "string"), F.try_variant_get(c, "$.name", "string"), F.try_variant_get(c, "$", "string")))
    return F.struct(F.try_variant_get(v, "$.title", "string").alias("title"),
                    F.transform(types, lambda t: F.struct(t.alias("type"))).alias("categories"))


def _offset(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "int"), F.try_variant_get(v, path, "string").try_cast("int"))


def parse_annotations(content: Column) -> Column:
    """The annotations of a file as an array of (decision, labels (title, categories (type)), spans (start, end)); null
    if the text is no JSON array."""
    return F.transform(F.try_variant_get(F.try_parse_json(content), "$", "array<variant>"), lambda a: F.struct(
        F.try_variant_get(a, "$.decision", "string").alias("decision"),
        F.transform(_list(a, "$.labels"), _label).alias("labels"),
        F.transform(_list(a, "$.spans"), lambda s: F.struct(
            _offset(s, "$.start").alias("start"), _offset(s, "$.end").alias("end"))).alias("spans")))


def _marks_and_texts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The JSON files (parsed) and the text files below ``path``, with the name that a pair shares."""
    marks = read_files(spark, path, "*.json").select(
        "folder", F.regexp_replace("file_name", r"(\.txt)?\.json$", "").alias("_base"), "file_name",
        parse_annotations(F.col("content")).alias("annotations"))
    texts = read_files(spark, path, "*.txt").select(
        "folder", F.regexp_replace("file_name", r"\.txt$", "").alias("_base"), F.col("content").alias("Report_Text"))
    return marks, texts


def read_annotation_files(spark: SparkSession, path: str) -> DataFrame:
    """IO11 + IO12: file_name, annotations and Report_Text of every ``.json`` file and the ``.txt`` file of its name.

    As in the reference, a JSON file needs its text; one without is left out (see :func:`unreadable_files`)."""
    marks, texts = _marks_and_texts(spark, path)
    return marks.where("annotations IS NOT NULL").join(texts, ["folder", "_base"]).select("file_name", "Report_Text", "annotations")


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name and reason of the annotation files that :func:`read_annotation_files` leaves out."""
    marks, texts = _marks_and_texts(spark, path)
    found = marks.select("folder", "_base", "file_name", F.col("annotations").isNull().alias("_bad")) \
        .join(texts.select("folder", "_base", F.lit(True).alias("_text")), ["folder", "_base"], "left")
    return found.where("_bad OR _text IS NULL").select(
        "file_name", F.when(F.col("_bad"), F.lit("no JSON array")).otherwise(F.lit("no text")).alias("reason"))


def write_annotation_files(files: DataFrame, path: str) -> None:
    """file_name, Report_Text and ``json`` (the array as text) as one ``.json`` and one ``.txt`` file each, in one job."""
    text_name = F.regexp_replace("file_name", r"(\.txt)?\.json$", ".txt")
    rows = F.array(F.struct(F.col("file_name"), F.col("json").alias("content")),
                   F.struct(text_name.alias("file_name"), F.col("Report_Text").alias("content")))
    write_files(files.select(F.lit("").alias("folder"), F.inline(rows)), path)


def _csv_field(c: Column) -> Column:
    return F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def export_preannotations(notes: DataFrame, path: str, name: str = "file_name", text: str = "Report_Text") -> None:
    """IO15: a CSV file (start, end, cui) beside each note's file, named after it; a note without spans gets the head only."""
    spans = preannotate(notes, text, key=[name])
    line = F.concat_ws(",", F.col("start").cast("string"), F.col("end").cast("string"), _csv_field(F.col("cui")))
    per_note = spans.groupBy(name).agg(F.sort_array(F.collect_list(F.struct("start", "end", "cui", line.alias("line")))).alias("_s"))
    rows = notes.select(name).join(per_note, name, "left")
    body = F.concat_ws("\n", F.lit("start,end,cui"), F.transform("_s", lambda s: s["line"]))
    write_files(rows.select(F.lit("").alias("folder"), F.regexp_replace(name, r"\.txt$", ".csv").alias("file_name"),
                            F.concat(body, F.lit("\n")).alias("content")), path)


def write_metrics(metrics: DataFrame, path: str, by: str, prefix: str = "") -> None:
    """IO14: the record of each value of ``by`` as ``<prefix><value>_metrics.json``, ``/`` and blanks in it replaced by ``_``."""
    own = F.regexp_replace(F.col(by).cast("string"), "[/ ]", "_")
    write_files(metrics.select(F.lit("").alias("folder"), F.concat(F.lit(prefix), own, F.lit("_metrics.json")).alias("file_name"),
                               F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("content")), path)


def read_metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All ``*_metrics.json`` files below ``path`` as rows of ``schema``."""
    found = read_files(spark, path, "*_metrics.json")
    return found.select(F.from_json("content", schema).alias("m")).select("m.*")
