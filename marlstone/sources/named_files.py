"""A data source that writes one file for each row, under a name that the row tells, and a reader of such files that the driver never lists.

``df(path, value).write.format("named_files").mode("append").save(folder)``. Each task writes its files, whole, into a staging folder beside the
target and a list of their names; what it tells the driver is where that list is. When all tasks are done, the driver moves the files of
one list after the other to their places, so files appear only if the whole job has succeeded, each of them at once and whole, and one
of that name before it is replaced. A task that fails, is tried again or runs twice leaves nothing; if the job fails, the staging folder goes.
The folder can be in any store that Arrow's file systems reach: local or shared disks, HDFS, S3, GCS.
"""

from __future__ import annotations

import io
import json
import os
import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase
from functools import partial
from itertools import batched

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files that the driver moves at once, and lines of a list that it holds.
MOVES, LINES = 32, 10_000
#: Levels of folders that are dealt out to tasks one by one; what lies below a folder of the last one is walked by its task.
LEVELS = 2
#: Rows and bytes of texts that a reading task holds, one text more at most.
ROWS, BYTES = 1000, 1 << 20


@dataclass
class Listed(WriterCommitMessage):
    """Where a task has listed its files, or None if it had none."""

    place: str | None


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder:
        folder = folder.removeprefix("file:")
        return fs.LocalFileSystem(), os.path.abspath(folder)
    return fs.FileSystem.from_uri(folder)


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, folder: str, fresh: bool = False):
        self.folder = folder.rstrip("/")
        if fresh:
            store, root = _store(self.folder)
            if store.get_file_info(root).type == fs.FileType.Directory and store.get_file_info(fs.FileSelector(root)):
                raise ValueError(f"{self.folder} isn't empty")
        self.staging = f"{self.folder}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Listed:
        store, root = _store(self.staging)
        task = TaskContext.get()
        own = f"{root}/{task.partitionId()}-{task.taskAttemptId()}"
        listed = None
        try:
            for k, row in enumerate(iterator):
                if not row["path"] or row["path"].startswith("/") or ".." in row["path"].split("/"):
                    raise ValueError(f"no place under the folder: {row['path']!r}")
                if listed is None:
                    store.create_dir(own, recursive=True)
                    listed = store.open_output_stream(f"{own}/list")
                with store.open_output_stream(f"{own}/{k}") as f:
                    f.write((row["value"] or "").encode())
                listed.write((json.dumps([f"{own}/{k}", row["path"]]) + "\n").encode())
        finally:
            if listed is not None:
                listed.close()
        return Listed(None if listed is None else f"{own}/list")

    def commit(self, messages: list[Listed | None]) -> None:
        store, root = _store(self.folder)

        def move(line: bytes) -> None:
            staged, path = json.loads(line)
            store.move(staged, f"{root}/{path}")

        with ThreadPoolExecutor(MOVES) as pool:
            for message in messages:
                if message is None or message.place is None:
                    continue
                with io.BufferedReader(store.open_input_stream(message.place)) as f:
                    for lines in batched(f, LINES):
                        parents = {f"{root}/{json.loads(x)[1]}".rsplit("/", 1)[0] for x in lines}
                        list(pool.map(lambda parent: store.create_dir(parent, recursive=True), parents))
                        list(pool.map(move, lines))
        self.abort(messages)

    def abort(self, messages: list[Listed | None]) -> None:
        store, staging = _store(self.staging)
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class NamedFiles(DataSource):
    """Rows (path string, value string): a file of that text at that place under the folder. A null value is an empty file; an empty path, or one that
    leaves the folder, is an error. Paths must differ: of equal ones any is kept. Files that no row names stay; with the option fresh the folder must be empty."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "path string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> NamedFilesWriter:
        if overwrite:
            raise ValueError("named_files replaces files one by one: use mode append")
        return NamedFilesWriter(self.options["path"], self.options.get("fresh") == "true")


def write_named_files(files: DataFrame, folder: str, fresh: bool = False) -> None:
    """files(path, value) as files under folder, which is empty before if ``fresh``; other columns are ignored."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("path", "value").write.format("named_files").option("fresh", str(fresh).lower()).mode("append").save(folder)


def without_file(rows: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """The rows whose ``path`` is no file under folder; a null or empty path is none.

    Each task asks the store for the places of its own rows, a batch at a time, so nothing is listed, whatever else the folder holds. A folder that
    doesn't exist has no file.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder.rstrip("/"))
        for batch in batches:
            places = batch.column(path).to_pylist()
            found = iter(store.get_file_info([f"{root}/{p}" for p in places if p]))
            yield batch.filter(pa.array([not p or next(found).type != fs.FileType.File for p in places], pa.bool_()))

    return rows.mapInArrow(work, rows.schema)


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(place, is a folder) of what lies in a folder, without hidden names and empty files; a local folder is never held whole."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            yield from ((f"{folder}/{x.name}", x.is_dir()) for x in found if not _hidden(x.name) and (x.is_dir() or x.stat().st_size))
    else:
        yield from ((x.path, x.type == fs.FileType.Directory) for x in store.get_file_info(fs.FileSelector(folder)) if not _hidden(x.base_name) and (x.type == fs.FileType.Directory or x.size))


def _hidden(name: str) -> bool:
    """Names that Spark's readers leave out too."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _below(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    for place, is_folder in _entries(store, folder):
        if is_folder:
            yield from _below(store, place)
        else:
            yield place, False


def tasks_can_list(folder: str, glob: str) -> bool:
    """Whether named_paths takes them: a store that Arrow reaches, a folder without a pattern, and no pattern of names but * and ?."""
    try:
        _store(folder)
    except (ValueError, OSError, ImportError):
        return False
    return not re.search(r"[*?\[{\\]", folder) and not re.search(r"[\[{\\]", glob)


def named_paths(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(place, path): the files under folder, or folder itself if it is a file, whose names match glob; path is what Spark's readers call them. Hidden names and empty files are left out as they are there.

    Tasks list the folders: the first LEVELS one by one, each in any task, then each folder of the last level with all below it. The driver sees no name.
    """
    store, root = _store(folder.rstrip("/"))
    top = store.get_file_info(root)
    if top.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    base = f"file:{_encoded(root)}" if isinstance(store, fs.LocalFileSystem) else folder.rstrip("/")

    def listed(found: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(folder.rstrip("/"))[0]
        given = ((r["place"], r["folder"]) for b in batches for r in b.to_pylist())
        each = (x for place, is_folder in given for x in (found(store, place) if is_folder else [(place, False)]))
        kept = ((place, is_folder, base + _encoded(place[len(root) :])) for place, is_folder in each if is_folder or fnmatchcase(place.rsplit("/", 1)[-1], glob))
        for some in batched(kept, ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*some, strict=True)], ["place", "folder", "path"])

    out = spark.createDataFrame([(root, top.type == fs.FileType.Directory, base)] if top.type == fs.FileType.Directory or top.size else [], "place string, folder boolean, path string")
    for found in [_entries] * LEVELS:
        out = _dealt(out.mapInArrow(partial(listed, found), out.schema))
    return out.mapInArrow(partial(listed, _below), out.schema).select("place", "path")


def _dealt(rows: DataFrame) -> DataFrame:
    # the number is given, as names are small and few tasks would get the work of all
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def texts_of(paths: DataFrame, folder: str) -> DataFrame:
    """(path, value): each file of paths(place, path), whole; tasks read one after the other."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _store(folder.rstrip("/"))[0]
        held: list[tuple[str, bytes]] = []
        size = 0
        for r in (r for b in batches for r in b.to_pylist()):
            with store.open_input_stream(r["place"]) as f:
                held.append((r["path"], f.read()))
            size += len(held[-1][1])
            if size > BYTES or len(held) == ROWS:
                yield _texts(held)
                held, size = [], 0
        if held:
            yield _texts(held)

    return _dealt(paths.select("place", "path")).mapInArrow(read, "path string, value binary").withColumn("value", F.col("value").cast("string"))


def _texts(held: list[tuple[str, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in held], pa.string()), pa.array([v for _, v in held], pa.binary())], ["path", "value"])


def _encoded(place: str) -> str:
    """As Java writes the path of a URI."""
    return re.sub(r"[^\w!.~'()*:@&=+$,;/-]", lambda m: m[0] if ord(m[0]) > 127 else f"%{ord(m[0]):02X}", place)
