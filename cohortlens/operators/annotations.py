"""Annotator output processing (IO11-IO12 shape, N1-N9, F22-F23, J9, A2-A3).

Input is one record per annotator file: ``file_name`` plus the annotation array of that file
(D4 layout: decision, labels[title, categories[type]], spans[start, end]) and the note text of
the file. Everything below is array/column expressions per file plus one anti join; no
per-file Python and no driver loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.rules import LABEL_CATEGORIES

REJECTED = ["rejected", "undecided"]
NON_DELIVERY_LABEL = "not a delivery note"
PUNCT_EDGES = r"[,:.]$|^[,:.]"


def annotation_file_name(annotator, sample: str, empi, report_number, ts):
    """IO13 file name ``{annotator}_notes{sample}_empi_{EMPI}_note_{Report_Number}_time_{time}.txt``."""
    return F.concat(annotator, F.lit(f"_notes{sample}_empi_"), empi.cast("string"), F.lit("_note_"),
                    report_number, F.lit("_time_"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(".txt"))


def nest_annotation_records(flat: DataFrame, sample: str = "") -> DataFrame:
    """Shape flat annotator records into per-file D4 arrays (what the JSON reader produces).
    The group is one note file, whose annotation list is bounded by what one annotator marked."""
    rec = F.struct(
        F.col("decision"),
        F.lit(True).alias("CUIMode"), F.lit(False).alias("experimentMode"),
        F.array(F.struct(F.lit(0).alias("labelId"), F.col("label_type").alias("title"),
                         F.array(F.struct(F.coalesce(F.element_at(_category_map(), F.col("label_type")),
                                                     F.lit("Other")).alias("type"))).alias("categories"))
                ).alias("labels"),
        F.array(F.struct(F.col("start").alias("start"), F.col("end").alias("end"))).alias("spans"),
    )
    fname = annotation_file_name(F.col("annotator"), sample, F.col("EMPI"), F.col("Report_Number"),
                                 F.col("Report_Date_Time"))
    return (flat.withColumn("file_name", F.regexp_replace(fname, r"\.txt$", ".json"))
            .groupBy("file_name").agg(F.min("Report_Text").alias("Report_Text"),
                                      F.sort_array(F.collect_list(F.struct("start", "end", rec.alias("a"))))
                                      .alias("_a"))
            .select("file_name", "Report_Text", F.transform("_a", lambda x: x["a"]).alias("annotations")))


def _category_map():
    return F.create_map(*[F.lit(x) for kv in LABEL_CATEGORIES.items() for x in kv])


def prune_annotations(files: DataFrame) -> DataFrame:
    """N1 + F22: drop tool-only fields, categories -> list of type, drop rejected/undecided."""
    kept = F.filter("annotations", lambda a: ~F.coalesce(a["decision"].isin(REJECTED), F.lit(False)))
    pruned = F.transform(kept, lambda a: F.struct(
        a["decision"].alias("decision"),
        F.transform(a["labels"], lambda l: F.struct(
            l["title"].alias("title"),
            F.transform(l["categories"], lambda c: c["type"]).alias("categories"))).alias("labels"),
        a["spans"].alias("spans")))
    return files.withColumn("annotations", pruned)


def empty_annotation_files(files: DataFrame) -> DataFrame:
    """F23 report: files whose annotation list is empty after pruning."""
    return prune_annotations(files).filter(F.size("annotations") == 0).select("file_name")


def flatten_annotations(files: DataFrame, annotators: list[str], empi_type: str = "string") -> DataFrame:
    """One row per (label, span) pair of every kept annotation.

    ``zip(labels, spans)`` stops at the shorter list, so both are sliced to the shorter length
    before ``arrays_zip`` (which would pad with nulls)."""
    f = prune_annotations(files).filter(F.size("annotations") > 0)
    ann = F.lit("")
    for a in annotators:  # last listed name contained in the file name wins
        ann = F.when(F.col("file_name").contains(a), F.lit(a)).otherwise(ann)
    pairs = F.flatten(F.transform("annotations", lambda a: F.arrays_zip(
        F.slice(a["labels"], 1, F.least(F.size(a["labels"]), F.size(a["spans"]))).alias("label"),
        F.slice(a["spans"], 1, F.least(F.size(a["labels"]), F.size(a["spans"]))).alias("span"))))
    x = f.select(
        F.regexp_extract("file_name", r"empi_([0-9]+)_", 1).cast(empi_type).alias("EMPI"),
        F.regexp_extract("file_name", r"note_(.+)_time", 1).alias("Report_Number"),
        F.to_timestamp_ntz(F.regexp_extract("file_name", r"time_(.+?)(?:\.txt)?(?:\.json)?$", 1)).alias("Report_Date_Time"),
        ann.alias("annotator"), "Report_Text", F.explode(pairs).alias("p"))
    start, end = F.col("p.span.start").cast("int"), F.col("p.span.end").cast("int")
    span = F.substring(F.col("Report_Text"), start + 1, end - start)
    return x.select(
        "EMPI", "Report_Number", "Report_Date_Time",
        F.col("p.label.title").alias("label_type"),
        F.get(F.col("p.label.categories"), F.lit(0)).alias("label_category"),
        start.alias("start"), end.alias("end"),
        F.regexp_replace(span, PUNCT_EDGES, "").alias("span"),
        "annotator",
    )


def category_violations(files: DataFrame) -> DataFrame:
    """N3 data-quality check: label assertions that do not carry exactly one category."""
    labels = F.flatten(F.transform("annotations", lambda a: a["labels"]))
    return (prune_annotations(files).select("file_name", F.explode(labels).alias("l"))
            .filter(F.size(F.col("l.categories")) != 1))


def drop_non_delivery(annotations: DataFrame) -> DataFrame:
    """Remove every annotation of a note that carries a 'not a delivery note' annotation."""
    nd = annotations.filter(F.col("label_type") == NON_DELIVERY_LABEL).select("EMPI", "Report_Number").distinct()
    return annotations.join(nd, ["EMPI", "Report_Number"], "left_anti")


def non_delivery_notes(annotations: DataFrame) -> DataFrame:
    """IO17 side output: (EMPI, Report_Number) of the non-delivery annotations."""
    return annotations.filter(F.col("label_type") == NON_DELIVERY_LABEL).select("EMPI", "Report_Number")


def label_counts(annotations: DataFrame, by: str = "label_type") -> DataFrame:
    """A2: value counts."""
    return annotations.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def label_table(spark: SparkSession) -> DataFrame:
    """label_type, label_category, number (from 1, as the annotation tool lists the label) and place (from 0, as its
    lookup does), in the order of the label table."""
    rows = [(label, category, i + 1, i) for i, (label, category) in enumerate(LABEL_CATEGORIES.items())]
    return spark.createDataFrame(rows, "label_type string, label_category string, number int, place int")


def numbered_label_counts(annotations: DataFrame) -> DataFrame:
    """A2 with N9: every label of the table with its number and its annotations (0 if none), and labels beyond the table,
    whose number is null."""
    return label_table(annotations.sparkSession).join(label_counts(annotations), "label_type", "full").select(
        "label_type", "label_category", "number", "place", F.coalesce("n", F.lit(0)).alias("n"))


def annotator_note_counts(annotations: DataFrame) -> DataFrame:
    """A3: distinct report numbers and patients per annotator."""
    return annotations.groupBy("annotator").agg(
        F.count_distinct("Report_Number").alias("n_report_numbers"),
        F.count_distinct("EMPI").alias("n_patients"))
