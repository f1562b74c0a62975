"""IO8 materialise-or-reuse: Parquet stage tables in the shared checkpoint folder.

A stage table is computed once, written under ``spark.checkpoint.dir`` (the cluster's shared
folder; set only for local runs) and read back, which cuts the lineage: later jobs restart from
the table, not from the raw scans, and survive executor loss without recomputing it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.session import ensure_checkpoint_dir

STAGE_VERSION = "1"
_CODE_HASH: str | None = None


def _code_fingerprint() -> str:
    """Hash of the package sources: a code change never reuses a stage table written by older code."""
    global _CODE_HASH
    if _CODE_HASH is None:
        from pathlib import Path
        h = hashlib.sha1()
        root = Path(__file__).resolve().parents[1]
        for f in sorted(root.rglob("*.py")):
            h.update(f.read_bytes())
        _CODE_HASH = h.hexdigest()[:12]
    return _CODE_HASH


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any file system that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def _exists(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, path + "/_SUCCESS")


def input_state(spark: SparkSession, paths: list[str]) -> str:
    """Names, sizes and times of the files below ``paths``: other files at the same place are other input."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    h = hashlib.sha1()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        files = fs.listFiles(p, True)
        found = []
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}")
        h.update("\n".join(sorted(found)).encode())
    return h.hexdigest()


def stage_path(spark: SparkSession, name: str, params: str) -> str:
    key = hashlib.sha1(f"{name}|{params}|{STAGE_VERSION}|{_code_fingerprint()}".encode()).hexdigest()[:16]
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/stage/{name}-{key}"


def stage_table(spark: SparkSession, name: str, params: str, build: Callable[[], DataFrame],
                overwrite: bool = False, inputs: list[str] | None = None) -> DataFrame:
    """Read the stage table if it was written before from the same ``inputs`` (file or folder paths) by the same code
    (and ``overwrite`` is False), else build, write and read it."""
    path = stage_path(spark, name, f"{params}|{input_state(spark, inputs or [])}")
    if overwrite or not _exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
