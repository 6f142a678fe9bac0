"""Tables stored in key order as trees whose shape their keys alone decide.

Rows lie in leaves by key. A key whose hash ends in LEAF_BITS zeros begins a leaf, one with FAN_BITS zeros more begins a
node above as well, and so on: where leaves and nodes are cut depends on the keys that are there and not on the order
they came in. So equal tables have equal roots whatever their history, and a row that comes or goes changes its leaf and
the nodes above it, or joins or parts two of them at each level. Leaves grow in number with the table and keep their size.

Building sorts by ranges of keys; each range counts the leaves that begin in it, and only these counts, one a range,
pass the driver. A commit reads and writes the leaves of the keys it touches; what it knows of all leaves (a row for
some thousand) is numbered and digested again. Look-ups and range scans read by key, so Parquet's statistics leave out
what lies elsewhere; diffs go down from the root where digests differ.

Defined results: a null key is a key, below all others; of rows of one key the last by `order` counts, or the greatest;
an empty table has a root too; columns of a commit are taken by name.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.content import row_lanes, set_digest
from palimpsest.operators.diff import both_sides
from palimpsest.operators.overlay import meets
from palimpsest.operators.trees import schema_hash
from palimpsest.session import dropped, shared_folder, written

LEAF_BITS, FAN_BITS, LEVELS = 10, 4, 12


def boundary(keys: tuple[str, ...], leaf_bits: int = LEAF_BITS, of: str = "") -> Column:
    """The level up to which a key begins nodes: 0 for none, 1 for a leaf; `of` is a struct that holds the key."""
    parts = [F.col(f"{of}.`{k}`" if of else f"`{k}`") for k in keys]
    h = F.xxhash64(*[x for p in parts for x in (p.isNull(), p)])
    zeros = F.bit_count(F.bitwise_not(h).bitwiseAND(F.coalesce(F.try_subtract(h, F.lit(1)), F.lit((1 << 63) - 1))))
    return F.when(zeros < leaf_bits, 0).otherwise(F.least(1 + F.floor((zeros - leaf_bits) / FAN_BITS), F.lit(LEVELS))).cast("int")


def counted(rows: DataFrame, order: list[str], begins: str, name: str) -> DataFrame:
    """rows with how many rows up to them, in that order, have `begins`: ranges of the order count on their own, and one number a range passes the driver."""
    placed = written(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    so_far = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = {r._p: r.n for r in placed.groupBy("_p").agg(F.count_if(begins).alias("n")).collect()}
    shift, total = [], 0
    for p in sorted(ends):
        shift.append((p, total))
        total += ends[p]
    base = rows.sparkSession.createDataFrame(shift, "_p int, _base long")
    own = placed.withColumn(name, F.sum(F.col(begins).cast("long")).over(so_far))
    return own.join(F.broadcast(base), "_p").withColumn(name, F.col(name) + F.col("_base")).drop("_p", "_base")


@dataclass(frozen=True)
class OrderedTree:
    """One version."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    schema: T.StructType
    leaf_bits: int

    def _start(self) -> T.StructType:
        return T.StructType([self.schema[k] for k in self.keys])

    def nodes(self) -> DataFrame:
        """(level, number, start, parent, digest, n, location, leaf): leaves are level 0; start is null in a level's first node; location and leaf say where a leaf's rows are."""
        return self.spark.read.schema(_nodes_schema(self._start())).parquet(f"{self.path}/nodes")

    @property
    def root(self) -> str:
        top = self.nodes().orderBy(F.desc("level")).limit(1).collect()
        return (top[0].digest if top else "") + ":" + schema_hash(self.schema)[:16]

    # Reading

    def _stored(self, location: str) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_leaf", T.LongType())])).parquet(f"{location}/rows")

    def _rows(self, leaves: DataFrame, where: Column | None = None) -> DataFrame:
        """The rows of some leaves, of which those that `where` (over keys) holds for."""
        places = [r.location for r in leaves.select("location").distinct().collect()]  # a version each, few after compact()
        parts = []
        for place in sorted(places):
            rows = self._stored(place) if where is None else self._stored(place).filter(where)
            parts.append(rows.join(leaves.filter(F.col("location") == place).select(F.col("leaf").alias("_leaf")), "_leaf", "left_semi").select(self.schema.names))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows; in_order() sorts them."""
        return self._rows(self.nodes().filter("level = 0"))

    def in_order(self) -> DataFrame:
        return self.read().orderBy(*self.keys)

    def _key(self, values: tuple) -> Column:
        return F.struct(*[F.lit(v).cast(self.schema[k].dataType).alias(k) for k, v in zip(self.keys, values)])

    def range(self, low: tuple | None = None, high: tuple | None = None) -> DataFrame:
        """Rows with low <= key <= high: of leaves that can hold one, and of their files what the first key's statistics don't rule out."""
        leaves, own, first = self.nodes().filter("level = 0"), F.struct(*[F.col(f"`{k}`") for k in self.keys]), self.keys[0]
        where = F.lit(True)
        if high is not None:
            leaves = leaves.filter(F.col("start").isNull() | (F.col("start") <= self._key(high)))
            where = where & (own <= self._key(high)) & (F.col(f"`{first}`").isNull() | (F.col(f"`{first}`") <= self._key(high)[first]))
        if low is not None:
            at = leaves.filter(F.col("start") <= self._key(low)).agg(F.max("number")).first()[0]
            leaves = leaves if at is None else leaves.filter(F.col("number") >= at)
            where = where & (own >= self._key(low))
            where = where & (F.col(f"`{first}`") >= self._key(low)[first]) if low[0] is not None else where
        return self._rows(leaves, where)

    def get(self, *key) -> DataFrame:
        return self.range(key, key)

    def _differing(self, other: OrderedTree) -> DataFrame:
        """This version's leaves that the other lacks, from the root down: only nodes under one that differs are compared."""
        mine, theirs = self.nodes(), other.nodes().select("level", "start", "digest")
        top = mine.agg(F.max("level")).first()[0]
        found = None
        for level in range(top if top is not None else 0, -1, -1):
            some = mine.filter(F.col("level") == level)
            if found is not None:
                some = some.join(found.select(F.col("number").alias("parent")), "parent", "left_semi")
            same = (F.col("a.digest") == F.col("b.digest")) & F.col("a.start").eqNullSafe(F.col("b.start"))
            found = written(some.alias("a").join(theirs.filter(F.col("level") == level).alias("b"), same, "left_anti"), "differing")
        return found

    def diff(self, other: OrderedTree) -> DataFrame:
        """(keys, a, b): rows of this version and of the other, as structs, where they differ; null on the side that has none."""
        if (self.keys, self.leaf_bits, schema_hash(self.schema)) != (other.keys, other.leaf_bits, schema_hash(other.schema)):
            raise ValueError("trees of different keys, leaves or schemas can't be compared")
        a, b = self._rows(self._differing(other)), other._rows(other._differing(self))
        whole = lambda s: F.when(F.col(f"{s}._in"), F.struct(*[F.col(f"{s}.`{c}`").alias(c) for c in self.schema.names]))
        rows = both_sides(a, b, list(self.keys), "full_outer").select(*[F.coalesce(f"a.`{k}`", f"b.`{k}`").alias(k) for k in self.keys], whole("a").alias("a"), whole("b").alias("b"))
        return rows.filter(~F.col("a").eqNullSafe(F.col("b")))

    # Writing

    def commit(self, changed: DataFrame | None = None, gone: DataFrame | None = None, order: Column | None = None) -> OrderedTree:
        """The next version: whole rows put in by key, keys of `gone` taken out; only the leaves of these keys are read and written."""
        put = None if changed is None else written(_one_each(changed, self.keys, self.schema, order), "changed")
        named = [t.select(*self.keys) for t in (put, gone) if t is not None]
        if not named:
            return self
        keys = written(reduce(DataFrame.unionByName, named).distinct(), "keys")
        leaves = self.nodes().filter("level = 0")
        starts = leaves.filter("start is not null").select("start.*", F.lit(0).alias("_kind"), F.lit(True).alias("_begins"))
        both = counted(starts.unionByName(keys.select(*self.keys, F.lit(1).alias("_kind"), F.lit(False).alias("_begins"))), [*self.keys, "_kind"], "_begins", "number")
        met = both.filter("_kind = 1").select("number")
        if gone is not None:  # where a leaf's first key goes, what is left of it joins the leaf before
            ends = both.filter("_kind = 0").alias("s").join(gone.select(*self.keys).distinct().alias("g"), meets("s", "g", self.keys))
            met = met.unionByName(ends.select((F.col("number") - 1).alias("number")))
        met = written(met.distinct(), "met")
        rows = self._rows(leaves.join(met, "number", "left_semi")).alias("a").join(keys.alias("k"), meets("a", "k", self.keys), "left_anti")
        rows = rows if put is None else rows.unionByName(put)
        return _write(self.spark, rows, self.keys, self.schema, self.leaf_bits, leaves.join(met, "number", "left_anti"))

    def compact(self) -> OrderedTree:
        """All rows in one folder."""
        return build(self.read(), self.keys, self.leaf_bits)


def _nodes_schema(start: T.StructType) -> T.StructType:
    plain = [("level", T.IntegerType()), ("number", T.LongType()), ("parent", T.LongType()), ("digest", T.StringType()), ("n", T.LongType()), ("location", T.StringType()), ("leaf", T.LongType())]
    fields = [T.StructField(n, k) for n, k in plain]
    return T.StructType([*fields[:2], T.StructField("start", start), *fields[2:]])


def _one_each(rows: DataFrame, keys: tuple[str, ...], schema: T.StructType, order: Column | None) -> DataFrame:
    whole = F.struct(*[F.col(f"`{c}`") for c in schema.names])
    return rows.groupBy(*keys).agg((F.max(whole) if order is None else F.max_by(whole, order)).alias("_row")).select("_row.*")


def build(rows: DataFrame, keys: tuple[str, ...], leaf_bits: int = LEAF_BITS, order: Column | None = None) -> OrderedTree:
    """The first version of a table; leaves of about 2 ** leaf_bits rows."""
    return _write(rows.sparkSession, _one_each(rows, keys, rows.schema, order), tuple(keys), rows.schema, leaf_bits, None)


def _write(spark: SparkSession, rows: DataFrame, keys: tuple[str, ...], schema: T.StructType, leaf_bits: int, others: DataFrame | None) -> OrderedTree:
    path = f"{shared_folder(spark)}/ordered-{uuid.uuid4().hex}"
    tree = OrderedTree(spark, path, keys, schema, leaf_bits)
    marked = counted(rows.select(schema.names).withColumn("_begins", boundary(keys, leaf_bits) > 0), list(keys), "_begins", "_leaf")
    marked.drop("_begins").sortWithinPartitions(*keys).write.parquet(f"{path}/rows")
    key = F.struct(*[F.col(f"`{k}`") for k in keys])
    leaves = tree._stored(path).groupBy("_leaf").agg(F.when(F.col("_leaf") > 0, F.min(key)).alias("start"), set_digest(row_lanes(schema.names, schema)).alias("digest"), F.count("*").alias("n"))
    leaves = leaves.select("start", "digest", "n", F.lit(path).alias("location"), F.col("_leaf").alias("leaf"))
    if others is not None:
        leaves = leaves.unionByName(others.select(leaves.columns))
    level, parts = 0, []
    up = F.when(F.col("start").isNull(), F.lit(0)).otherwise(boundary(keys, leaf_bits, "start"))
    now = written(leaves.withColumn("up", up).withColumn("begins", F.col("up") > 0), "leaves")
    now = counted(now, ["start"], "begins", "number")
    while True:
        now = written(counted(now.withColumn("begins", F.col("up") > level + 1), ["start"], "begins", "parent"), "nodes")
        parts.append(now.select(F.lit(level).alias("level"), "number", "start", "parent", "digest", "n", "location", "leaf"))
        if now.count() <= 1:  # the root
            break
        above = now.withColumn("name", F.to_json(F.struct("start"))).groupBy(F.col("parent").alias("number"))
        digest = set_digest([F.xxhash64(F.lit(seed), "name", "digest") for seed in (1, 2)])
        now = above.agg(F.min(F.struct(F.col("start").isNotNull().alias("later"), "start", "up")).alias("first"), digest.alias("digest"), F.sum("n").alias("n"))
        now = now.select("number", F.when(F.col("number") > 0, F.col("first.start")).alias("start"), F.col("first.up").alias("up"), "digest", "n", F.lit(None).cast("string").alias("location"), F.lit(None).cast("long").alias("leaf"))
        level += 1
    reduce(DataFrame.unionByName, parts).write.parquet(f"{path}/nodes")
    for part in parts[:-1]:
        dropped(part)
    return tree


def root_of(trees: dict[str, OrderedTree]) -> str:
    """The digest of a database of such tables."""
    return hashlib.sha256(",".join(f"{n}={trees[n].root}" for n in sorted(trees)).encode()).hexdigest()
