"""Many small files as rows: one row per file (folder, file_name, content).

Spark's own writers make a folder of part files for each target and its paths cannot hold ``:``, which the annotators'
file names contain. This module writes and reads single files by their names, through the file systems of ``pyarrow.fs``
(local or mounted folders, HDFS, object stores); the path must be one that driver and executors share.

* Reader (:func:`read_files`): a task lists the files, by name only, and deals the names out to tasks of about
  ``part_files`` files (more files where there would be over ``MOST_PARTS`` tasks), which open them; only files that fit
  ``name_filter`` are opened. The driver gets the number of files and no names. Local and mounted folders are listed as a
  stream; ``pyarrow.fs`` gives a folder of another file system whole, so there the listing task holds the largest folder.
* Writer (a data source): tasks write below ``_staging-<job>``, each with a sorted list of the places of its files, and
  report the name of that list; only the commit moves files to their places, so a job that fails, or a task that is tried
  twice, leaves nothing behind. The commit merges the lists as streams: it holds a few lines of each, not all names. Two
  rows for one place are an error. With ``overwrite`` the folders that the job writes to lose their old files in the commit,
  which lists them on the driver; other folders stay.
"""

from __future__ import annotations

import fnmatch
import heapq
import io
import json
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAMES = "folder string, file_name string"
SCHEMA = f"{NAMES}, content string"
STAGING = "_staging-"
#: Lists that a commit reads at once (more are merged in levels), and files that it moves at once.
MOST_LISTS, MOVED = 256, 4096
#: Tasks that a read is dealt out to at most (or the session's shuffle partitions, if more), and characters after which a task
#: passes on what it has read.
MOST_PARTS, BATCH_CHARS = 1024, 4 << 20


def file_system(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _entries(where, folder: str) -> Iterator[tuple[str, bool, bool]]:
    """(name, is a file, is a folder) of what is in ``folder``; nothing if there is no such folder."""
    from pyarrow import fs

    if not isinstance(where, fs.LocalFileSystem):
        for f in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            yield f.base_name, f.is_file, f.type == fs.FileType.Directory
        return
    try:
        found = os.scandir(folder or "/")
    except FileNotFoundError:
        return
    with found:
        for e in found:
            yield e.name, e.is_file(), e.is_dir()


def listed(path: str, pattern: str = "*") -> Iterator[tuple[str, str]]:
    """(folder below ``path``, file name) of all files whose name fits ``pattern``, in the order in which they are found; none if
    there is no such folder."""
    where, root = file_system(path)
    root, folders = root.rstrip("/"), [""]
    while folders:
        folder = folders.pop()
        for name, is_file, is_folder in _entries(where, f"{root}/{folder}" if folder else root):
            if not folder and name.startswith(STAGING):
                continue
            if is_folder:
                folders.append(f"{folder}/{name}" if folder else name)
            elif is_file and fnmatch.fnmatchcase(name, pattern):
                yield folder, name


def _contents(path: str) -> Callable:
    """A task's work: the files of the names that it gets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = file_system(path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["folder", "file_name", "content"])
        for b in batches:
            for folder, name in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with where.open_input_stream("/".join(x for x in (root.rstrip("/"), folder, name) if x)) as f:
                    rows.append((folder, name, f.read().decode("utf-8")))
                size += sum(map(len, rows[-1]))
                if size >= BATCH_CHARS:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()
    return run


def _write_list(where, path: str, places: Iterable[list[str]]) -> str:
    """``places`` (folder, file name, staged path) as a file of a line each; its path."""
    with where.open_output_stream(path) as f:
        for part in batched(places, MOVED):
            f.write("".join(json.dumps(p) + "\n" for p in part).encode())
    return path


def _read_list(where, path: str) -> Iterator[list[str]]:
    with where.open_input_stream(path, buffer_size=1 << 16) as f:
        yield from map(json.loads, io.TextIOWrapper(f, "utf-8"))


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: the path of its sorted list of (folder, file name, staged path)."""

    places: str


class NoteFilesWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.staging = f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        where, root = file_system(self.path)
        own, files = f"{root.rstrip('/')}/{self.staging}/{uuid.uuid4().hex}", []
        where.create_dir(own, recursive=True)
        for i, row in enumerate(iterator):
            folder, name = (row["folder"] or "").strip("/"), row["file_name"]
            if not name or "/" in name or name in (".", "..") or ".." in folder.split("/") or folder.startswith(STAGING):
                raise ValueError(f"no file can be named {name!r} in {folder!r}")
            with where.open_output_stream(f"{own}/{i}") as f:
                f.write((row["content"] or "").encode("utf-8"))
            files.append([folder, name, f"{own}/{i}"])
        return Written(_write_list(where, f"{own}/places", sorted(files)))

    def commit(self, messages: list[Written | None]) -> None:
        where, root = file_system(self.path)
        root = root.rstrip("/")
        lists = [m.places for m in messages if m is not None]
        while len(lists) > MOST_LISTS:
            lists = [_write_list(where, f"{root}/{self.staging}/{uuid.uuid4().hex}", heapq.merge(*[_read_list(where, x) for x in part]))
                     for part in batched(lists, MOST_LISTS)]

        def places() -> Iterator[list[str]]:
            return heapq.merge(*[_read_list(where, x) for x in lists])

        before = None
        for folder, name, _ in places():
            if (folder, name) == before:
                self.abort(messages)
                raise ValueError("several rows have the same folder and file name")
            before = folder, name
        last = None
        with ThreadPoolExecutor(16) as pool:
            for part in batched(places(), MOVED):
                for folder in dict.fromkeys(p[0] for p in part):
                    if folder != last:  # the first file of a folder
                        self._prepare(where, f"{root}/{folder}".rstrip("/"))
                    last = folder
                list(pool.map(lambda p: where.move(p[2], "/".join(x for x in (root, p[0], p[1]) if x)), part))
        self._clean(where, root)

    def _prepare(self, where, target: str) -> None:
        where.create_dir(target, recursive=True)
        if self.overwrite:
            for there, name in list(listed(target)):
                if not there:
                    where.delete_file(f"{target}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        where, root = file_system(self.path)
        self._clean(where, root.rstrip("/"))

    def _clean(self, where, root: str) -> None:
        from pyarrow import fs

        if where.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            where.delete_dir(f"{root}/{self.staging}")


class NoteFiles(DataSource):
    """``spark.write.format("note_files")``; option: path."""

    @classmethod
    def name(cls) -> str:
        return "note_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> NoteFilesWriter:
        return NoteFilesWriter(self.options, overwrite)


def read_files(spark: SparkSession, path: str, name_filter: str = "*", part_files: int = 256) -> DataFrame:
    """folder, file_name, content of the files below ``path`` whose names fit ``name_filter``.

    A job counts the files first, to deal them out. A name goes to the same task whenever it is listed, so a listing
    that is repeated after a failure gives no file twice. The names are an RDD's, whose size Spark does not estimate: from a
    small frame it would take the files for few and send them all to the driver for a broadcast join."""
    found = spark.sparkContext.parallelize([path], 1).flatMap(lambda p: listed(p, name_filter))
    most = max(MOST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = min(max(1, -(-found.count() // part_files)), most)
    names = spark.createDataFrame(found, NAMES, verifySchema=False)
    return names.repartition(parts, "folder", "file_name").mapInArrow(_contents(path), SCHEMA)


def write_files(files: DataFrame, path: str, overwrite: bool = False) -> None:
    """Each row of ``files`` (folder, file_name, content; null content is empty) as a file below ``path``, in one job; files
    of the same place are replaced, with ``overwrite`` the folders written to lose their other files."""
    files.sparkSession.dataSource.register(NoteFiles)
    files.select("folder", "file_name", "content").write.format("note_files").mode("overwrite" if overwrite else "append") \
        .option("path", path).save()
