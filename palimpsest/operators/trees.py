"""Stored tables with digest trees: a commit rewrites the buckets that changed, a diff reads the buckets that differ.

A version is a folder with two tables. nodes(level, node, digest, n, location) has a row for each bucket (level 0), for
each FAN buckets, and so on up to one root; location says which version's folder holds a bucket's rows. rows are stored
by bucket, so that a bucket is a folder of files. Buckets are by a hash of the key: a row that comes or goes touches its
own bucket and no other. The number of buckets is part of the format and is kept with the version, as is a hash of the
schema.

Nodes are small (as many as buckets, whatever the table's size) and are compared on the driver from the root down; rows
are read, compared and written by tasks.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.content import row_lanes, set_digest
from palimpsest.operators.diff import both_sides
from palimpsest.session import shared_folder

FAN = 16
BUCKET = "_bucket"
NODES = "level int, node long, digest string, n long, location string"


def schema_hash(schema: T.StructType) -> str:
    """SHA-256 of names and types in order; comments, metadata and nullability don't matter."""
    return hashlib.sha256("\x1f".join(f"{f.name}\x1e{f.dataType.simpleString()}" for f in schema.fields).encode()).hexdigest()


@dataclass(frozen=True)
class Tree:
    """One version of a table."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    buckets: int

    def nodes(self) -> DataFrame:
        return self.spark.read.schema(NODES).parquet(f"{self.path}/nodes")

    @property
    def root(self) -> str:
        """The digest of the whole table with its schema: equal for equal rows, whatever their order and history."""
        return self.nodes().orderBy(F.desc("level")).first().digest + ":" + schema_hash(self.schema)[:16]

    def _of(self, key: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets))

    def rows(self, some: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets: only these buckets' folders are read."""
        leaves = self.nodes().filter("level = 0 and n > 0")
        places: dict[str, list[int]] = {}
        for r in (leaves if some is None else leaves.filter(F.col("node").isin(some))).collect():
            places.setdefault(r.location, []).append(r.node)
        stored = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.LongType())])
        parts = [self.spark.read.schema(stored).parquet(f"{where}/rows").filter(F.col(BUCKET).isin(own)) for where, own in sorted(places.items())]
        empty = self.spark.createDataFrame([], stored)
        return reduce(DataFrame.unionByName, parts, empty) if not parts else reduce(DataFrame.unionByName, parts)

    def read(self) -> DataFrame:
        return self.rows().drop(BUCKET)

    def get(self, *key) -> DataFrame:
        """The row of a key, from its own bucket."""
        values = [F.lit(v).cast(self.schema[k].dataType) for k, v in zip(self.keys, key)]
        bucket = self.spark.range(1).select(self._of(values).alias("b")).first().b
        return self.rows([bucket]).drop(BUCKET).filter(reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(v) for k, v in zip(self.keys, values))))

    def changed_buckets(self, other: Tree) -> list[int]:
        """Buckets whose digests differ, found from the root down."""
        if (self.buckets, self.keys) != (other.buckets, other.keys):
            raise ValueError("trees of different keys or numbers of buckets can't be compared")
        a, b = ({(r.level, r.node): r.digest for r in t.nodes().collect()} for t in (self, other))
        level, differ = max(k for k, _ in a), [0]
        while differ:
            differ = [n for n in differ if a.get((level, n)) != b.get((level, n))]
            if not level:
                return differ
            level, differ = level - 1, [c for n in differ for c in range(n * FAN, (n + 1) * FAN) if (level - 1, c) in a or (level - 1, c) in b]
        return []

    def diff(self, other: Tree) -> DataFrame:
        """(keys, a, b): rows of this version and of the other, as structs, where they differ; null on the side that has none."""
        some = self.changed_buckets(other)
        a, b = (t.rows(some).drop(BUCKET) for t in (self, other))
        whole = lambda s: F.when(F.col(f"{s}._in"), F.struct(*[F.col(f"{s}.`{c}`").alias(c) for c in self.schema.names]))
        rows = both_sides(a, b, list(self.keys), "full_outer").select(*[F.coalesce(f"a.`{k}`", f"b.`{k}`").alias(k) for k in self.keys], whole("a").alias("a"), whole("b").alias("b"))
        return rows.filter(~F.col("a").eqNullSafe(F.col("b")))

    def commit(self, changed: DataFrame | None = None, gone: DataFrame | None = None) -> Tree:
        """The next version: whole rows put in by key, keys of `gone` taken out; only their buckets are read and written."""
        touched = [t.select(self._of([F.col(k) for k in self.keys]).alias("b")) for t in (changed, gone) if t is not None]
        some = [r.b for r in reduce(DataFrame.unionByName, touched).distinct().collect()] if touched else []  # bucket numbers
        if not some:
            return self
        rows, out = self.rows(some).drop(BUCKET), [t.select(*self.keys) for t in (changed, gone) if t is not None]
        meets = reduce(lambda x, y: x & y, (F.col(f"a.`{k}`").eqNullSafe(F.col(f"o.`{k}`")) for k in self.keys))
        rows = rows.alias("a").join(reduce(DataFrame.unionByName, out).alias("o"), meets, "left_anti")
        if changed is not None:
            rows = rows.unionByName(changed.select(self.schema.names))
        return _write(self.spark, rows, self.keys, self.schema, self.buckets, {r.node: (r.digest, r.n, r.location) for r in self.nodes().filter("level = 0").collect()}, some)

    def compact(self) -> Tree:
        """All rows in one folder."""
        return build(self.read(), self.keys, self.buckets)


def build(rows: DataFrame, keys: tuple[str, ...], buckets: int = 256) -> Tree:
    """The first version of a table."""
    return _write(rows.sparkSession, rows, tuple(keys), rows.schema, buckets, {}, None)


def _write(spark: SparkSession, rows: DataFrame, keys: tuple[str, ...], schema: T.StructType, buckets: int, leaves: dict, some: list[int] | None) -> Tree:
    path = f"{shared_folder(spark)}/tree-{uuid.uuid4().hex}"
    placed = rows.select(*schema.names).withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    placed.repartition(BUCKET, F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(max(1, spark.sparkContext.defaultParallelism // buckets)))).write.partitionBy(BUCKET).parquet(f"{path}/rows")
    stored = T.StructType([*schema.fields, T.StructField(BUCKET, T.LongType())])
    digest = set_digest(row_lanes(schema.names, schema))
    told = spark.read.schema(stored).parquet(f"{path}/rows").groupBy(BUCKET).agg(digest.alias("digest"), F.count("*").alias("n")).collect()  # a row a bucket
    leaves = {k: v for k, v in leaves.items() if k not in set(some or [])} | {r[BUCKET]: (r.digest, r.n, path) for r in told}
    level, nodes = {k: d for k, (d, _, _) in leaves.items()}, [(0, k, d, n, where) for k, (d, n, where) in leaves.items()]
    height, width = 0, buckets
    while width > 1 or not height:
        above: dict[int, list] = {}
        for k in sorted(level):
            above.setdefault(k // FAN, []).append(f"{k}={level[k]}")
        height, width = height + 1, -(-width // FAN)
        level = {k: hashlib.sha256(",".join(own).encode()).hexdigest() for k, own in above.items()} or ({0: hashlib.sha256(b"").hexdigest()} if width == 1 else {})
        nodes += [(height, k, d, None, None) for k, d in level.items()]
    spark.createDataFrame(nodes, NODES).coalesce(1).write.parquet(f"{path}/nodes")
    return Tree(spark, path, tuple(keys), schema, buckets)


def database_commit(prior: dict[str, Tree], tables: dict[str, tuple[DataFrame, tuple[str, ...]]], dirty: set[str], buckets: int = 256) -> dict[str, Tree]:
    """A version of several tables: one whose schema is as before and that is not dirty keeps its tree, others are built."""
    kept = lambda name, rows: name in prior and name not in dirty and schema_hash(prior[name].schema) == schema_hash(rows.schema)
    return {name: prior[name] if kept(name, rows) else build(rows, keys, buckets) for name, (rows, keys) in sorted(tables.items())}


def database_root(trees: dict[str, Tree]) -> str:
    return hashlib.sha256(",".join(f"{name}={trees[name].root}" for name in sorted(trees)).encode()).hexdigest()
