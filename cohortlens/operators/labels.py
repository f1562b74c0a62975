"""Gold labels from annotations.

Binary labels are produced for all labels in one pass, in long form (note key, label, y).
Membership of EMPI and Report_Number is tested independently, as the reference does (a note
whose patient has the label on another note and whose report number carries the label for
another patient still counts); ``paired=True`` tests the (EMPI, Report_Number) pair instead.
The label sets are (label, key) tables joined on equality: Spark/AQE pick broadcast only when
the set is small at run time; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.rules import BINARY_LABELS, TRANSFUSION_SOURCE_LABEL, TRANSFUSION_SPAN_RULES
from cohortlens.functions.regex import java_regex
from cohortlens.session import ensure_checkpoint_dir

NOTE_KEY = ["EMPI", "Report_Number", "Report_Date_Time"]
LABEL_KEY = ["Report_Number", "EMPI", "Report_Date_Time", "MRN_Type"]


def prep_data(notes: DataFrame, annotations: DataFrame, restricted: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """L1: (annotations, annotated notes, annotations left-joined to notes). ``restricted``: ``notes`` are the annotated
    ones already.

    J4 uses a semi join on de-duplicated (EMPI, Report_Number), so a note with several annotations is not multiplied.
    J5 joins on the whole note key: an annotation carries the time of its note, and two notes may share patient and
    report number. As the note key is unique in the cohort, the join keeps the number of annotations, which
    :func:`join_keeps_count` checks."""
    keys = annotations.select("EMPI", "Report_Number").distinct()
    annotated = notes if restricted else notes.join(keys.hint("merge"), ["EMPI", "Report_Number"], "left_semi")
    joined = annotations.join(annotated, [c for c in NOTE_KEY if c in annotations.columns], "left")
    return annotations, annotated, joined


def join_keeps_count(annotations: DataFrame, joined: DataFrame) -> None:
    """J5 check: raises if the join to the notes changed the number of annotations."""
    before, after = annotations.count(), joined.count()
    if before != after:
        raise ValueError(f"{before} annotations became {after} rows: the note key is not unique")


def _label_membership(annotations: DataFrame, labels: list[str]) -> DataFrame:
    """(label, EMPI, Report_Number) rows of annotations that assert each label."""
    parts = []
    plain = [l for l in labels if l not in TRANSFUSION_SPAN_RULES]
    if plain:
        parts.append(annotations.filter(F.col("label_type").isin(plain))
                     .select(F.col("label_type").alias("label"), "EMPI", "Report_Number"))
    sub = [l for l in labels if l in TRANSFUSION_SPAN_RULES]
    if sub:
        tt = annotations.filter(F.col("label_type") == TRANSFUSION_SOURCE_LABEL)
        hits = F.array(*[F.when(F.col("span").rlike(java_regex(TRANSFUSION_SPAN_RULES[l], ignore_case=True)),
                                F.lit(l)) for l in sub])
        parts.append(tt.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("label"),
                               "EMPI", "Report_Number"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def binary_labels(notes: DataFrame, annotations: DataFrame, labels: list[str] | None = None,
                  paired: bool = False, key: list[str] | None = None) -> DataFrame:
    """L3 for many labels at once: ``key + [label, y]``; y = 1 if the note carries the label."""
    labels = labels or [l for l in BINARY_LABELS if l != "delivery_note"]
    key = [c for c in (key or LABEL_KEY) if c in notes.columns]
    member = _label_membership(annotations, labels)

    def label_sets(cols: list[str], name: str) -> DataFrame:
        """At most one entry of each label for a key, so a hot key has one short row; not to be broadcast, see
        :func:`against_gold`."""
        return member.groupBy(*cols).agg(F.collect_set("label").alias(name)).dropna(subset=cols).hint("merge")

    def has(name: str, label: Column) -> Column:
        return F.coalesce(F.array_contains(F.col(name), label), F.lit(False))

    slim = notes.select(*key)
    if paired:
        slim = slim.join(label_sets(["EMPI", "Report_Number"], "_p"), ["EMPI", "Report_Number"], "left")
        test = lambda x: has("_p", x)
    else:
        slim = slim.join(label_sets(["EMPI"], "_e"), "EMPI", "left").join(
            label_sets(["Report_Number"], "_r"), "Report_Number", "left")
        test = lambda x: has("_e", x) & has("_r", x)
    out = slim.withColumn("label", F.explode(F.array(*[F.lit(x) for x in labels])))
    return out.select(*key, "label", test(F.col("label")).cast("int").alias("y"))


def delivery_note_label(notes: DataFrame, column: str = "Is_Delivery_Note") -> DataFrame:
    """L4."""
    return notes.withColumnRenamed(column, "delivery_note")


def ie_labels(joined: DataFrame, notes: DataFrame, label: str, clean_span: bool = True,
              key: list[str] | None = None) -> DataFrame:
    """L2 + L5 for one extraction label.

    * labelled notes: gold span lists per note (A4) from the annotation/note join, keeping notes
      whose EMPI and Report_Number each occur in ``notes`` (J8, independent membership);
    * the other notes of ``notes`` (EMPI or Report_Number not among the labelled ones, J7) get an
      empty list (U2);
    * ``span_extracted`` = list non-empty.
    Spans are ordered by their start offset (the reference keeps file order). The span list is
    one note's annotations, bounded by what annotators marked on that note."""
    key = [c for c in (key or LABEL_KEY) if c in notes.columns]
    span_col = "clean_span" if clean_span else "span"
    one = joined.filter((F.col("label_type") == label) & F.col("EMPI").isNotNull()
                        & F.col("Report_Number").isNotNull() & F.col("Report_Date_Time").isNotNull()
                        & F.col("Report_Text").isNotNull())
    groups = (one.groupBy("EMPI", "Report_Number", "Report_Date_Time")
              .agg(F.first("MRN_Type", ignorenulls=True).alias("MRN_Type"),
                   F.sort_array(F.collect_list(F.struct("start", "end", F.col(span_col).alias("s")))).alias("_s"))
              .withColumn("spans", F.transform("_s", lambda x: x["s"])).drop("_s"))
    ensure_checkpoint_dir(notes.sparkSession)
    groups = groups.checkpoint()  # a row per labelled note, used four times
    in_e = notes.select("EMPI").distinct()
    in_r = notes.select("Report_Number").distinct()
    labelled = groups.join(in_e, ["EMPI"], "left_semi").join(in_r, ["Report_Number"], "left_semi")
    has_e = groups.select("EMPI").distinct().withColumn("_he", F.lit(1))
    has_r = groups.select("Report_Number").distinct().withColumn("_hr", F.lit(1))
    rest = (notes.select(*key).join(has_e, ["EMPI"], "left").join(has_r, ["Report_Number"], "left")
            .filter(F.col("_he").isNull() | F.col("_hr").isNull())
            .select(*key, F.array().cast("array<string>").alias("spans")))
    out = labelled.select(*key, "spans").unionByName(rest)
    return out.withColumn("span_extracted", (F.size("spans") > 0).cast("int"))


def against_gold(preds: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """Predictions joined to their gold labels by a merge join on ``on``.

    A stored gold table repeats a few values and keys, so its files are far smaller than its rows; a join chosen by the
    size of the files would send all rows to the driver and to each executor."""
    return gold.hint("merge").join(preds, on)


def label_value_counts(labels_long: DataFrame) -> DataFrame:
    """A2 on labels: count of notes per (label, y)."""
    return labels_long.groupBy("label", "y").agg(F.count(F.lit(1)).alias("n"))
