"""Files of a folder written by tasks, changed all together: posts as documents, feeds in parts.

write_files(rows, folder) takes rows(path, text, was): text is what the file is to hold, null for a file that is to go;
`was` is where it lay before, so a renamed post loses its old file in the same commit. Tasks write to a staging folder,
each with a list of what it staged. The commit is one small file; before it the folder is as it was, whatever task
failed, and after it the moves are made, by tasks again, from the lists. They can be made twice: a commit whose moves
were cut short is finished by the next write, or by recovered(), and a staging folder without its commit goes.

Files are dealt out by path, a few thousand to a task, when they are staged, moved and read, so that each step has more tasks
where there are more files; read_files() lists folders in tasks too, one level at a time, and the driver holds no list.

Each file changes by a rename, so a reader sees it whole, old or new. Defined results: paths are relative, without
empty, `.` or `..` segments, and named once, or nothing is written; a file that is to go and isn't there is gone; a path
that one row leaves and another takes is the other's.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from palimpsest.functions.text import is_tree_path
from palimpsest.session import written

STAGING, COMMITS = ".staging", ".commits"
MOVES = "staged string, path string, was string"
#: Files that a task stages, moves or reads.
FILES_A_TASK = 1 << 12


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a path, and the path on it."""
    local = re.sub("^file:/+", "/", path)
    return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(path)


@dataclass
class Staged(WriterCommitMessage):
    files: int


class FolderFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return "path string, text string, was string"

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options["path"], self.options["commit"])


class FolderWriter(DataSourceWriter):
    def __init__(self, path: str, commit: str):
        self.path, self.id = path, commit

    def write(self, iterator: Iterator) -> Staged:
        """One task's files, each under a name of its own, and its list of moves beside them."""
        where, folder = opened(self.path)
        own = f"{folder}/{STAGING}/{self.id}"
        task, moves = uuid.uuid4().hex, []
        for name in ("lists", task):
            where.create_dir(f"{own}/{name}")
        for n, row in enumerate(iterator):
            staged = None
            if row.text is not None:
                staged = f"{own}/{task}/{n}"
                with where.open_output_stream(staged) as out:
                    out.write(row.text.encode())
            moves.append({"staged": staged, "path": row.path, "was": row.was})
        with where.open_output_stream(f"{own}/lists/{task}.json") as out:
            out.write("".join(json.dumps(m) + "\n" for m in moves).encode())
        return Staged(len(moves))

    def commit(self, messages: list) -> None:
        """From here on the write counts. A task that ran twice has left two lists; those of the tasks that count say how many rows there are."""
        where, folder = opened(self.path)
        where.create_dir(f"{folder}/{COMMITS}")
        with where.open_output_stream(f"{folder}/{COMMITS}/{self.id}.part") as out:
            out.write(json.dumps({"files": sum(m.files for m in messages if m is not None)}).encode())
        where.move(f"{folder}/{COMMITS}/{self.id}.part", f"{folder}/{COMMITS}/{self.id}")

    def abort(self, messages: list) -> None:
        where, folder = opened(self.path)
        if where.get_file_info(f"{folder}/{STAGING}/{self.id}").type != fs.FileType.NotFound:
            where.delete_dir(f"{folder}/{STAGING}/{self.id}")


def write_files(rows: DataFrame, folder: str) -> int:
    """Puts, renames and removes files of a folder, all or none; gives how many rows there were."""
    spark = rows.sparkSession
    rows = rows.select("path", "text", "was" if "was" in rows.columns else F.lit(None).cast("string").alias("was"))
    bad = lambda c: F.col(c).isNotNull() & ~is_tree_path(F.concat(F.lit("/"), F.col(c)))
    told = rows.agg(F.count("*").alias("n"), F.count_distinct("path").alias("paths"), F.count_if(F.col("path").isNull() | bad("path") | bad("was")).alias("bad")).first()
    if told.bad or told.paths < told.n:
        raise ValueError(f"{told.bad} paths that name no file, {told.n - told.paths} named again")
    recovered(spark, folder)
    spark.dataSource.register(FolderFiles)
    commit = uuid.uuid4().hex
    _by_path(rows, told.n).write.format("folder_files").option("path", folder).option("commit", commit).mode("append").save()
    _moved(spark, folder, commit)
    return told.n


def _by_path(rows: DataFrame, n: int) -> DataFrame:
    """n rows dealt out in the order of their paths, so that a task has few folders."""
    return rows.repartitionByRange(max(1, -(-n // FILES_A_TASK)), "path")


def recovered(spark: SparkSession, folder: str) -> int:
    """Finishes the commits whose moves were cut short, clears what never came to its commit, and gives how many were finished. No write may be at it."""
    where, root = opened(folder)
    names = lambda part: [f.base_name for f in where.get_file_info(fs.FileSelector(f"{root}/{part}", allow_not_found=True))]
    commits = [n for n in names(COMMITS) if not n.endswith(".part")]
    for commit in commits:
        _moved(spark, folder, commit)
    for left in names(STAGING):
        where.delete_dir(f"{root}/{STAGING}/{left}")
    for left in names(COMMITS):
        where.delete_file(f"{root}/{COMMITS}/{left}")
    return len(commits)


def _moved(spark: SparkSession, folder: str, commit: str) -> None:
    """Makes the moves of a commit: files into their places first, then what is to go, but for places that were taken."""
    where, root = opened(folder)
    lists = f"{root}/{STAGING}/{commit}/lists"
    if where.get_file_info(lists).type != fs.FileType.NotFound:
        scheme = folder[: len(folder) - len(root)] if folder.endswith(root) else "file:"
        moves = spark.read.schema(MOVES).json(f"{scheme}{lists}")
        left = moves.filter("was is not null").select(F.col("was").alias("path"), F.lit(None).cast("string").alias("staged"))
        named = moves.select("path", "staged").unionByName(left)
        last = _by_path(named, named.count()).groupBy("path").agg(F.max("staged").alias("staged"))  # one list of a task that ran twice will do
        for rows, act in ((last.filter("staged is not null"), _put), (last.filter("staged is null"), _gone)):
            rows.select("staged", "path").mapInArrow(lambda batches, act=act: act(batches, folder), "n long").agg(F.sum("n")).collect()
        where.delete_dir(f"{root}/{STAGING}/{commit}")
    if where.get_file_info(f"{root}/{COMMITS}/{commit}").type != fs.FileType.NotFound:
        where.delete_file(f"{root}/{COMMITS}/{commit}")


def _put(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    where, root = opened(folder)
    made = None
    for batch in batches:
        for staged, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if where.get_file_info(staged).type != fs.FileType.NotFound:  # else moved before the cut
                if made != (made := f"{root}/{path}".rpartition("/")[0]):
                    where.create_dir(made)
                where.move(staged, f"{root}/{path}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})


def _gone(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    where, root = opened(folder)
    for batch in batches:
        for path in batch.column(1).to_pylist():
            if where.get_file_info(f"{root}/{path}").type == fs.FileType.File:
                where.delete_file(f"{root}/{path}")
        yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})


def _listed(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """What lies in folders named below `folder`, hidden names left out."""
    where, root = opened(folder)
    for batch in batches:
        for path in batch.column(0).to_pylist():
            found = where.get_file_info(fs.FileSelector(f"{root}/{path}".rstrip("/")))
            for at in range(0, len(found), FILES_A_TASK):
                some = [f for f in found[at : at + FILES_A_TASK] if f.base_name[:1] not in (".", "_")]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([f"{path}/{f.base_name}".lstrip("/") for f in some], pa.string()),
                    "deeper": pa.array([f.type == fs.FileType.Directory for f in some], pa.bool_()),
                })


def read_files(spark: SparkSession, folder: str, names: str = "") -> DataFrame:
    """(path, content) of the files anywhere below a folder whose names match a regular expression, paths as write_files() has them."""
    level, files = spark.createDataFrame([("",)], "path string"), []
    while not level.isEmpty():
        found = written(level.mapInArrow(lambda batches: _listed(batches, folder), "path string, deeper boolean"), "listed")
        files.append(found.filter(~F.col("deeper") & F.regexp_extract("path", "[^/]*$", 0).rlike(names)).select("path"))
        deeper = found.filter("deeper").select("path")
        level = deeper.repartitionByRange(max(1, -(-deeper.count() // 16)), "path")
    paths = reduce(DataFrame.unionByName, files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = opened(folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.column(0).slice(at, 64)
                contents = []
                for path in some.to_pylist():
                    with where.open_input_stream(f"{root}/{path}", compression=None) as file:
                        contents.append(file.read())
                yield pa.RecordBatch.from_arrays([some, pa.array(contents, pa.binary())], names=["path", "content"])

    return _by_path(paths, paths.count()).mapInArrow(read, "path string, content binary")


def feed_parts(items: DataFrame, order: str, per_part: int, title: str) -> DataFrame:
    """(path, text): items(item, a number from 0 in `order`) as RSS files of so many items each, for write_files()."""
    part = F.floor(F.col(order) / per_part)
    body = items.groupBy(part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "item"))), lambda s: s["item"]), "\n").alias("items"))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0">\n<channel>\n<title>{title}</title>\n'
    return body.select(F.concat(F.lit("feed-"), F.lpad(F.col("part").cast("string"), 6, "0"), F.lit(".xml")).alias("path"), F.concat(F.lit(head), "items", F.lit("\n</channel>\n</rss>\n")).alias("text"))
