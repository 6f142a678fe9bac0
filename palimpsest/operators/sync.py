"""Stores that exchange chunks: what is missing is copied, then a named reference moves by compare-and-set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.content import missing, put_once, reachable
from palimpsest.operators.history import fast_forwards, forebears
from palimpsest.session import written


def lacking(chunks: DataFrame, have: DataFrame, roots: DataFrame) -> DataFrame:
    """The chunks(hash, data, refs) that roots(hash) lead to and have(hash) lacks.

    One anti join finds what the other side lacks at all; only among those is anything followed, so an exchange of a few
    chunks costs the same whatever the history behind them, and a long history few rounds. The other side has, with a
    chunk, all that it leads to. A reference to a chunk that neither side has is an error.
    """
    new = written(missing(chunks.select("hash", "refs"), have), "lacking")
    found = written(forebears(new.select(F.col("hash").alias("node"), "refs"), roots.select(F.col("hash").alias("node"))).withColumnRenamed("node", "hash"), "found")
    named = new.join(found, "hash").select(F.explode("refs").alias("hash")).unionByName(roots.select("hash"))
    if lost := missing(missing(named, found), have).distinct().limit(5).collect():
        raise ValueError(f"chunks that neither side has: {[r.hash for r in lost]}")
    return chunks.join(found, "hash")


def to_copy(chunks: DataFrame, have: DataFrame, root: str) -> DataFrame:
    """The chunks(hash, data, refs) reached from root that have(hash) lacks, with their depth, a round for each step: for shallow trees only, lacking() for histories."""
    new = written(missing(chunks.select("hash", "refs"), have), "lacking")
    edges = new.select(F.col("hash").alias("node"), F.explode("refs").alias("ref"))
    wanted = reachable(edges, chunks.sparkSession.createDataFrame([(root,)], "node string")).withColumnRenamed("node", "hash")
    return chunks.join(missing(wanted, have), "hash")


def descends(commits: DataFrame, new: str, old: str | None) -> bool:
    """Whether commit new has old among its forebears in commits(hash, parents), so that a reference may move without a merge."""
    if old is None or old == new:
        return True
    graph = commits.select(F.col("hash").alias("node"), F.col("parents").alias("refs"))
    return fast_forwards(graph, commits.sparkSession.createDataFrame([(new, old)], "new string, old string")).first().forward


class Refs:
    """References as numbered files, name/number, each holding a hash; the file system lets one writer make a number."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str) -> int:
        folder = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return max((int(f.getPath().getName()) for f in self.fs.listStatus(folder)), default=0) if self.fs.exists(folder) else 0

    def get(self, name: str) -> str | None:
        return self._read(name, self._at(name))

    def _read(self, name: str, number: int) -> str | None:
        if not number:
            return None
        stream = self.fs.open(self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{number}"))
        try:
            return stream.readUTF()
        finally:
            stream.close()

    def compare_and_set(self, name: str, old: str | None, new: str) -> bool:
        """Whether the reference was old and is new now; false if another writer came first."""
        number = self._at(name)
        if self._read(name, number) != old:
            return False
        try:
            stream = self.fs.create(self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/{number + 1}"), False)
        except Exception as taken:
            if "FileAlreadyExists" in str(taken):
                return False
            raise
        stream.writeUTF(new)
        stream.close()
        return True


def _one(chunks: DataFrame, root: str) -> DataFrame:
    return chunks.sparkSession.createDataFrame([(root,)], "hash string")


def push(local: DataFrame, remote: DataFrame, refs: Refs, name: str, new: str, commits: DataFrame) -> tuple[DataFrame, int, str]:
    """(remote's chunks after it, how many moved, up-to-date or pushed): chunks go first and the reference last, so a push that fails leaves the reference where it was.

    Refused where the reference is not among new's forebears in commits(hash, parents), or has moved in the meantime.
    """
    old = refs.get(name)
    if old == new:
        return remote, 0, "up-to-date"
    if not descends(commits, new, old):
        raise ValueError("push refused: not a fast-forward")
    moved = written(lacking(local, remote, _one(local, new)).select(remote.columns), "moved")
    after = put_once(remote, moved)
    if not refs.compare_and_set(name, old, new):
        raise ValueError("push refused: the reference has moved; fetch first")
    return after, moved.count(), "pushed"


def fetch(local: DataFrame, remote: DataFrame, refs: Refs, name: str) -> tuple[DataFrame, str | None]:
    """local's chunks with what the remote reference reaches, and that reference's hash; no local reference moves."""
    at = refs.get(name)
    return (local, None) if at is None else (put_once(local, written(lacking(remote, local, _one(remote, at)).select(local.columns), "moved")), at)
