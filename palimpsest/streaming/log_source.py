"""A growing log in numbered files as a stream of lines, read on from (file number, byte).

spark.dataSource.register(NumberedLog), then spark.readStream.format("numbered_log").option("path", folder). A log is the
files of a folder whose names end in a number (binlog.000009, binlog.000010): they are read in the order of the numbers,
and bytes appended to a file that was read come in the next batch. An offset is a number and a byte, at a line's begin;
it is kept in the query's checkpoint, so a restart loses and doubles nothing. Batches are cut into byte ranges of
`rangeBytes`, each read by a task of its own. A line without its end is left for later while its file is the newest, and
ends with the file once there is a newer one.

Rows: number, file, position, next_position (where the next line begins), value. A file that has become shorter than
what was read of it, or that is gone, is an error. Paths are opened by Arrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "number long, file string, position long, next_position long, value string"
#: Bytes of a range, and of one read.
RANGE, READ = 64 << 20, 1 << 20


@dataclass
class Range(InputPartition):
    file: str
    number: int
    begin: int
    end: int


class NumberedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "numbered_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


class LogReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range = int(options.get("rangebytes", options.get("rangeBytes", RANGE)))

    def _open(self):
        local = re.sub("^file:/+", "/", self.path)
        return (fs.LocalFileSystem(), local) if local.startswith("/") else fs.FileSystem.from_uri(self.path)

    def files(self) -> list[tuple[int, str, int]]:
        """(number, path, size) by number."""
        where, folder = self._open()
        found = where.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return sorted((int(m[1]), f.path, f.size) for f in found if f.is_file and (m := re.search(r"(?:^|\.)(\d+)$", f.base_name)))

    def initialOffset(self) -> dict:
        return {"number": -1, "position": 0}

    def latestOffset(self) -> dict:
        files = self.files()
        if not files:
            return self.initialOffset()
        number, file, size = files[-1]
        return {"number": number, "position": self._last_line(file, size)}

    def _last_line(self, file: str, size: int) -> int:
        """Where the last whole line ends."""
        where, _ = self._open()
        with where.open_input_file(file) as f:
            end = size
            while end > 0:
                begin = max(0, end - READ)
                at = f.read_at(end - begin, begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files, out = {n: (path, size) for n, path, size in self.files()}, []
        if start["number"] >= 0 and (start["number"] not in files or files[start["number"]][1] < start["position"]):
            raise ValueError(f"file {start['number']} of the log has lost what was read of it")
        for number in sorted(n for n in files if start["number"] <= n <= end["number"]):
            path, size = files[number]
            begin = start["position"] if number == start["number"] else 0
            stop = end["position"] if number == end["number"] else size
            out += [Range(path, number, at, min(at + self.range, stop)) for at in range(begin, stop, self.range)]
            if out and out[-1].number == number:
                out[-1].end = stop
        marked = []
        for r in out:  # a range that isn't its file's first in this batch may begin within a line
            r.first = r.begin == (start["position"] if r.number == start["number"] else 0)
            r.stop = end["position"] if r.number == end["number"] else files[r.number][1]
            marked.append(r)
        return marked

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The lines that begin in the range, to their ends."""
        where, _ = self._open()
        name = partition.file.rpartition("/")[2]
        with where.open_input_file(partition.file) as f:
            at = partition.begin
            if not partition.first:  # the line that the range begins in is the range before's
                at = self._next(f, at - 1, partition.stop)
            held, rows = b"", []
            read = at
            while at < partition.end:
                if (cut := held.find(b"\n")) < 0 and read < partition.stop:
                    more = f.read_at(min(READ, partition.stop - read), read)
                    held, read = held + more, read + len(more)
                    continue
                line = held if cut < 0 else held[: cut + 1]
                held = held[len(line) :]
                rows.append((partition.number, name, at, at + len(line), line.rstrip(b"\n").decode("utf-8", "replace")))
                at += len(line)
                if len(rows) == 4096:
                    yield self._batch(rows)
                    rows = []
            if rows:
                yield self._batch(rows)

    @staticmethod
    def _next(f, at: int, stop: int) -> int:
        """Where the first line begins after a byte."""
        while at < stop:
            part = f.read_at(min(READ, stop - at), at)
            if (cut := part.find(b"\n")) >= 0:
                return at + cut + 1
            at += len(part)
        return stop

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["number", "file", "position", "next_position", "value"])

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint holds the offset."""


def offsets(text: str) -> tuple[int, int]:
    """(number, position) of an offset as a checkpoint keeps it."""
    said = json.loads(text)
    return said["number"], said["position"]
