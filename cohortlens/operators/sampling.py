"""Seeded sampling, annotator assignment and patient-level stratified splits (W2-W9, F18-F19,
J16, A5-A6, IO13 naming).

Randomness is replaced by a seeded hash order (``md5(seed|key)``), which is deterministic,
identical on every engine and needs no driver-side RNG. Top-n selections use a literal bound
(``limit n`` / ``row_number <= n``), which Spark executes as per-partition top-n before the
shuffle; quota tables hold one row per (label, stratum) and are the only thing broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.operators.annotations import annotation_file_name
from cohortlens.session import ensure_checkpoint_dir

NOTE_KEY = ["EMPI", "Report_Number", "Report_Date_Time"]
SEED = 42
N_TRAIN = 50
SITE = "BWH"


def seeded_hash(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sample_notes(notes: DataFrame, n: int, seed: int = SEED, key: list[str] | None = None) -> DataFrame:
    """``n`` notes chosen by seeded hash order (a sampling operator: the limit is the feature)."""
    key = key or NOTE_KEY
    return notes.withColumn("_h", seeded_hash(seed, *key)).orderBy("_h").limit(n)


def assign_annotators(sample: DataFrame, annotators: list[str], sample_name: str = "") -> DataFrame:
    """W5 + IO13: split the sample into len(annotators) near-equal consecutive chunks (first
    ``n mod k`` chunks get one extra) and name each note's annotator text file.
    The window spans the sample only (``n`` rows, a parameter)."""
    names = F.array(*[F.lit(a) for a in annotators])
    w = Window.orderBy("_h")
    ann = F.element_at(names, F.ntile(len(annotators)).over(w))
    out = sample.withColumn("annotator", ann)
    fname = annotation_file_name(F.col("annotator"), sample_name, F.col("EMPI"), F.col("Report_Number"),
                                 F.col("Report_Date_Time"))
    return out.withColumn("file_name", fname).drop("_h")


def seeded_shuffle(df: DataFrame, seed: int = SEED, key: list[str] | None = None) -> DataFrame:
    """Deterministic shuffle order."""
    key = key or [c for c in NOTE_KEY if c in df.columns]
    return df.withColumn("_h", seeded_hash(seed, *key)).orderBy("_h").drop("_h")


def ranked(df: DataFrame, name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in its order (from 1), as a global sort left it.

    Rows are numbered inside their partition and shifted by the rows of the partitions before (one row each), so no
    task holds more than its partition. The frame is written to the checkpoint folder first: its order is then fixed."""
    ensure_checkpoint_dir(df.sparkSession)
    fixed = df.checkpoint().withColumns({
        "_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return fixed.join(F.broadcast(before), "_part").select(*df.columns, (F.col("_before") + F.col("_in") + 1).alias(name))


def single_site_patients(notes: DataFrame, ie: bool = False, site: str = SITE) -> DataFrame:
    """F18 (binary): notes at ``site`` of patients never seen elsewhere (null site counts as elsewhere).
    F19 (ie=True): null site does not count as elsewhere, and null-site notes whose Report_Number
    contains the site name are kept too. A patient's sites do not depend on a label, so they are looked up once."""
    mt = F.col("MRN_Type")
    elsewhere_cond = (mt != site) if ie else ~F.coalesce(mt == site, F.lit(False))
    elsewhere = notes.filter(elsewhere_cond).select("EMPI").distinct()
    keep = F.coalesce(mt == site, F.lit(False))
    if ie:
        keep = keep | (mt.isNull() & F.coalesce(F.col("Report_Number").contains(site), F.lit(False)))
    return notes.filter(keep).join(elsewhere, "EMPI", "left_anti")


def stratified_patient_split(notes: DataFrame, y: str = "y", group: list[str] | None = None,
                             n_train: int = N_TRAIN, seed: int = SEED, ie: bool = False) -> DataFrame:
    """W8/W9 + J16: choose ``n_train`` training patients per group among single-site patients,
    stratified on "patient has a positive note" when at least two positive notes exist, with
    largest-remainder quotas; every note of a training patient is 'train', all others 'test'."""
    group = group or ["label"]
    pool = single_site_patients(notes, ie=ie)
    pat = pool.groupBy(*group, "EMPI").agg(F.sum(y).alias("_pos"))
    pos_total = pat.groupBy(*group).agg(F.sum("_pos").alias("_npos"))
    pat = pat.join(pos_total, group, "inner").withColumn(
        "_stratum", F.when(F.col("_npos") >= 2, (F.col("_pos") > 0).cast("int")).otherwise(F.lit(0)))
    # quota table: one row per (group, stratum)
    sizes = pat.groupBy(*group, "_stratum").agg(F.count(F.lit(1)).alias("_ns"))
    wg = Window.partitionBy(*group)
    total = F.sum("_ns").over(wg)
    target = F.least(F.lit(n_train), total)
    exact = target * F.col("_ns") / total
    sizes = sizes.withColumn("_base", F.floor(exact).cast("long")).withColumn("_frac", exact - F.col("_base"))
    sizes = sizes.withColumn("_left", target - F.sum("_base").over(wg))
    rank = F.row_number().over(wg.orderBy(F.col("_frac").desc(), F.col("_stratum").asc()))
    quota = sizes.withColumn("_quota", F.col("_base") + (rank <= F.col("_left")).cast("long")) \
        .select(*group, "_stratum", "_quota")
    ws = Window.partitionBy(*group, "_stratum").orderBy("_h", "EMPI")
    ranked = (pat.withColumn("_h", seeded_hash(seed, "EMPI"))
              .withColumn("_rn", F.row_number().over(ws)).filter(F.col("_rn") <= n_train))
    train = (ranked.join(F.broadcast(quota), group + ["_stratum"], "inner")
             .filter(F.col("_rn") <= F.col("_quota")).select(*group, "EMPI").withColumn("_train", F.lit(1)))
    out = notes.join(train, group + ["EMPI"], "left")
    return out.withColumn("split", F.when(F.col("_train") == 1, "train").otherwise("test")).drop("_train")


def split_label_counts(split_notes: DataFrame, y: str = "y", group: list[str] | None = None) -> DataFrame:
    """Notes and positive notes per (label, split)."""
    group = group or ["label"]
    return split_notes.groupBy(*group, "split").agg(F.count(F.lit(1)).alias("n_notes"),
                                                   F.sum(y).cast("long").alias("n_positive"))
