"""Readers and sinks for the raw hospital exports and annotation files (IO1-IO17).

Multi-line note exports (IO1) are read as text lines and re-assembled without putting a whole file in one task: each
split of a file finds its own notes, and only the pieces at its edges meet those of its neighbours.
Annotator files and other files of one row each are in :mod:`cohortlens.sources.annotation_files`.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.sources.note_files import write_files

NOTE_FIELDS = ["EMPI", "EPIC_PMRN", "MRN_Type", "MRN", "Report_Number", "Report_Date_Time",
               "Report_Description", "Report_Status", "Report_Type", "Report_Text"]
DATE_FORMATS = ["M/d/yyyy h:mm:ss a", "M/d/yyyy h:mm a", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy",
                "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"]

def parse_timestamp(col: str) -> F.Column:
    """first format that parses (NULL otherwise), TIMESTAMP_NTZ."""
    c = F.trim(F.col(col))
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]).cast("timestamp_ntz")


def _fields(line: str) -> list[str] | None:
    """The fields of a line that opens a note (ten of them), else None."""
    return line.split("|") if line.count("|") == len(NOTE_FIELDS) - 1 else None


def _note_rows(batches):
    """Notes of each file split, in one pass over its lines. Rows: file, blk, kind, header, body.

    kind 0: a note that ends in its split; 1: lines before the first note of the split, which belong to the last note of
    an earlier one; 2: the last note that begins in the split, which may go on in the next."""
    at, header, body, kind, out = None, None, [], 1, []

    def close(last: bool) -> None:
        if at is not None and (header is not None or body):
            out.append((*at, 2 if last and header is not None else kind, header, body))

    def rows() -> pa.RecordBatch:
        files, blks, kinds, headers, bodies = zip(*out, strict=True) if out else ([],) * 5
        out.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(files, pa.string()), pa.array(blks, pa.int64()), pa.array(kinds, pa.int32()),
             pa.array(headers, pa.string()), pa.array(bodies, pa.list_(pa.string()))], names=["file", "blk", "kind", "header", "body"])
    for b in batches:
        for file, blk, line in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (file, blk) != at:
                close(True)
                at, header, body, kind = (file, blk), None, [], 1
                if blk == 0:
                    continue  # the column line of the file
            if _fields(line) is not None:
                close(False)
                header, body, kind = line, [], 0
            else:
                body.append(line)
        yield rows()
    close(True)
    yield rows()


def read_note_exports(spark: SparkSession, path: str, name_filter: str = "*Dis*.txt",
                      drop_last: bool = False) -> DataFrame:
    """IO1-IO4, IO6: note exports -> one row per note with the 10 note fields.

    A line opens a note when it splits into exactly 10 fields; the following lines are the note body, joined by a
    space, each keeping its line break, and replace field 10. The first line of each file (column header) is skipped;
    lines before the first note and notes without body lines are dropped; ``drop_last`` reproduces the reference's loss
    of each file's last note.

    One pass over the lines of each split finds its notes; only the first and the last piece of a split (at most two
    rows) are stitched to those of the splits beside it, so no line is shuffled or sorted.
    """
    lines = spark.read.option("pathGlobFilter", name_filter).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"), "value")
    found = lines.mapInArrow(_note_rows, "file string, blk bigint, kind int, header string, body array<string>")
    edges = found.where("kind > 0").withColumn(
        "note", F.sum((F.col("kind") == 2).cast("long")).over(Window.partitionBy("file").orderBy("blk", "kind")))
    pieces = F.sort_array(F.collect_list(F.struct("blk", "kind", "body")))
    stitched = edges.where("note > 0").groupBy("file", "note").agg(
        F.max("header").alias("header"), F.flatten(F.transform(pieces, lambda x: x["body"])).alias("body"))
    if drop_last:
        last = stitched.groupBy("file").agg(F.max("note").alias("note"))
        stitched = stitched.join(last, ["file", "note"], "left_anti")
    notes = found.where("kind = 0").select("header", "body").unionByName(stitched.select("header", "body"))
    fields = F.split(F.col("header"), r"\|", -1)
    body = F.concat_ws(" ", F.transform("body", lambda x: F.concat(x, F.lit("\n"))))
    cols = [F.element_at(fields, i + 1).alias(n) for i, n in enumerate(NOTE_FIELDS[:-1])]
    return notes.where(F.size("body") > 0).select(*cols, body.alias("Report_Text"))


def read_notes(spark: SparkSession, path: str, name_filter: str = "*Dis*.txt", cutoff: str = "2015-05-01") -> DataFrame:
    """IO6: exports -> notes with parsed timestamps before ``cutoff``."""
    n = read_note_exports(spark, path, name_filter)
    n = n.withColumn("Report_Date_Time", parse_timestamp("Report_Date_Time"))
    return n.filter(F.col("Report_Date_Time") < F.lit(cutoff).cast("timestamp_ntz"))


def read_pipe_table(spark: SparkSession, path: str, name_filter: str, schema: str | None = None) -> DataFrame:
    """IO3/IO4/IO9: every matching pipe-delimited file with a header, concatenated."""
    r = spark.read.option("pathGlobFilter", name_filter).option("header", True).option("sep", "|").option("escape", '"')
    if schema:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", False)
    return r.csv(path)


def read_note_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """IO9: a note table written by :func:`write_table` as CSV, line breaks and quotes inside fields kept."""
    return (spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"')
            .option("escape", '"').csv(path))


def read_diagnoses(spark: SparkSession, path: str, name_filter: str = "*Dia.txt*", cutoff: str = "2015-05-01") -> DataFrame:
    """IO5 + F1/F2/F17: diagnoses with Code kept as text, parsed Date, ``Date < cutoff``."""
    d = read_pipe_table(spark, path, name_filter)
    d = (d.withColumn("Date", parse_timestamp("Date"))
         .withColumnRenamed("Diagnosis_Name", "Name").withColumnRenamed("Diagnosis_Flag", "Flag"))
    keep = [c for c in ["EMPI", "Date", "Name", "Code_Type", "Code", "Flag", "Inpatient_Outpatient", "Encounter_number"]
            if c in d.columns]
    return d.select(*keep).filter(F.col("Date") < F.lit(cutoff).cast("timestamp_ntz"))


def read_demographics(spark: SparkSession, path: str, name_filter: str = "*Dem.txt*") -> DataFrame:
    """IO7."""
    return read_pipe_table(spark, path, name_filter)


# --- sinks -----------------------------------------------------------------------------------------

def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """IO10/IO15/IO16/IO17: Parquet by default, CSV with header on request, optional partitions."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":  # fields with quotes and line breaks, and blanks at their ends, come back as they were
        (w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(path))
    else:
        w.format(fmt).save(path)


def safe_label(label: str | F.Column) -> F.Column:
    """IO16: a label as it may stand in a path ('/' becomes '_')."""
    c = F.col(label) if isinstance(label, str) else label
    return F.replace(c, F.lit("/"), F.lit("_"))


def write_splits(split: DataFrame, path: str, label: str = "label") -> None:
    """IO16: one folder for each label, named by :func:`safe_label`."""
    write_table(split.withColumn(label, safe_label(label)), path, partition_by=[label])


def by_patient(notes: DataFrame) -> DataFrame:
    """Notes in order of EMPI (null first), number and time, in ranges over the partitions."""
    order = ["EMPI", "Report_Number", "Report_Date_Time"]
    return notes.repartitionByRange(*order).sortWithinPartitions(*order)


def write_note_exports(notes: DataFrame, path: str) -> None:
    """Notes as multi-line export files (the layout that :func:`read_note_exports` reads): a column line at the head of
    each file, then for each note a line of fields and the lines of its text. One file for each partition. W2: sorted by
    EMPI (null first) over the files in their order; a patient's notes follow by number and time, over files if many."""
    columns = "|".join(NOTE_FIELDS)

    def with_head(batches):
        head = True
        for b in batches:
            lines = b["value"].tolist()
            yield pd.DataFrame({"value": [columns, *lines] if head else lines})
            head = False

    fields = [F.coalesce(F.date_format("Report_Date_Time", "M/d/yyyy h:mm:ss a") if f == "Report_Date_Time"
                         else F.col(f).cast("string"), F.lit("")) for f in NOTE_FIELDS[:-1]]
    head = F.concat(F.concat_ws("|", *fields), F.lit("|"))
    value = F.when(F.col("Report_Text").isNull(), head).otherwise(F.concat(head, F.lit("\n"), F.col("Report_Text")))
    by_patient(notes).select(value.alias("value")).mapInPandas(with_head, "value string").write.mode("overwrite").text(path)


def write_diagnoses(dx: DataFrame, path: str) -> None:
    """Diagnoses as pipe-delimited files with a header, in the layout that :func:`read_diagnoses` reads, sorted by EMPI."""
    named = dx.withColumnsRenamed({"Name": "Diagnosis_Name", "Flag": "Diagnosis_Flag"}) \
        .withColumn("Date", F.date_format("Date", "M/d/yyyy h:mm:ss a"))
    _write_pipes(named, path)


def write_demographics(people: DataFrame, path: str) -> None:
    """IO7's layout: pipe-delimited with a header, sorted by EMPI."""
    _write_pipes(people, path)


def _write_pipes(df: DataFrame, path: str) -> None:
    df.repartitionByRange("EMPI").sortWithinPartitions("EMPI").write.mode("overwrite").option("header", True) \
        .option("sep", "|").option("escape", '"').csv(path)


def export_note_files(notes: DataFrame, path: str, name: str = "file_name", text: str = "Report_Text") -> None:
    """IO13: one text file per note, by its name, in one job."""
    write_files(notes.select(F.lit("").alias("folder"), F.col(name).alias("file_name"), F.col(text).alias("content")), path)
