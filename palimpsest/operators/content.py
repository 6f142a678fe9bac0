"""Content addressing: row and blob hashes, bucket digests, garbage, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.session import written


def _plain(c: str, kind: T.DataType | None) -> Column:
    """A value that text or a hash tells from every other: nested values as JSON with their nulls, maps by sorted entries."""
    col = F.col(f"`{c}`")
    if isinstance(kind, T.MapType):
        col = F.array_sort(F.map_entries(col))
    if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)):
        return F.when(F.col(f"`{c}`").isNotNull(), F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"}))
    return F.hex(col) if isinstance(kind, T.BinaryType) else col


def _kinds(columns: list[str], schema: T.StructType | None) -> list[T.DataType | None]:
    return [schema[c].dataType if schema is not None else None for c in columns]


def row_hash(columns: list[str], schema: T.StructType | None = None) -> Column:
    """SHA-256 over the columns as text, nulls told from all texts and no two rows alike; cast or format what prints differently elsewhere first.

    Nested and binary columns need the schema. The separator is escaped inside values.
    """
    texts = [_plain(c, kind).cast("string") for c, kind in zip(columns, _kinds(columns, schema))]
    safe = [F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit("\x1f"), F.lit("\\_")) for t in texts]
    tagged = [F.coalesce(F.concat(F.lit("V:"), t), F.lit("N")) for t in safe]
    return F.sha2(F.concat_ws("\x1f", *tagged), 256)


def row_lanes(columns: list[str], schema: T.StructType) -> list[Column]:
    """Two 64-bit hashes of a row, of different seeds; each value comes after a mark of whether it is null, as hashes pass over nulls."""
    marked = [x for c, kind in zip(columns, _kinds(columns, schema)) for x in (F.col(f"`{c}`").isNull(), _plain(c, kind))]
    return [F.xxhash64(F.lit(seed), *marked) for seed in (1, 2)]


def set_digest(lanes: list[Column]) -> Column:
    """An aggregate: one digest of all rows with these hashes, whatever their order, repeated rows counted; a sum of each half of each hash and their number."""
    halves = [h for lane in lanes for h in (lane.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(lane, 32))]
    return F.sha2(F.concat_ws("-", *[F.sum(h).cast("string") for h in halves], F.count("*").cast("string")), 256)


def buckets(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """(bucket, digest, n): a digest that does not depend on order, from partial sums rather than a sorted list."""
    return rows.groupBy(bucket).agg(set_digest(row_lanes(rows.columns, rows.schema)).alias("digest"), F.count("*").alias("n"))


def stored_once(blobs: DataFrame, text: str = "text") -> DataFrame:
    """(hash, size, refs) of the distinct texts."""
    hashed = blobs.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("hash"), F.length(F.encode(F.coalesce(text, F.lit("")), "UTF-8")).cast("long").alias("size"))
    return hashed.groupBy("hash").agg(F.first("size").alias("size"), F.count("*").alias("refs"))


def garbage(blobs: DataFrame, *live: DataFrame) -> DataFrame:
    """Blobs that none of the live tables' hashes name."""
    for table in live:
        blobs = blobs.join(table.select("hash"), "hash", "left_anti")
    return blobs


def missing(wanted: DataFrame, present: DataFrame) -> DataFrame:
    return wanted.join(present.select("hash"), "hash", "left_anti")


def put_once(store: DataFrame, new: DataFrame) -> DataFrame:
    """store(hash, data, refs) with the new chunks that it lacks, each once; a chunk whose hash is not that of its data is refused."""
    if wrong := new.filter(~F.sha2("data", 256).eqNullSafe(F.col("hash"))).select("hash").limit(5).collect():
        raise ValueError(f"chunks that are not what their hashes say: {[r.hash for r in wrong]}")
    return store.unionByName(missing(new, store).dropDuplicates(["hash"]).select(store.columns))


def garbage_totals(blobs: DataFrame, *live: DataFrame) -> DataFrame:
    """One row for a dry run over blobs(hash, size): how many there are and their bytes, before and after, and what would go."""
    marked = blobs.withColumn("_live", F.lit(False))
    for table in live:
        named = table.select("hash").distinct().withColumn("_named", F.lit(True))
        marked = marked.join(named, "hash", "left").withColumn("_live", F.col("_live") | F.coalesce("_named", F.lit(False))).drop("_named")
    size = lambda which: F.coalesce(F.sum(F.when(which, F.col("size"))), F.lit(0)).cast("long")
    alive = F.col("_live")
    return marked.agg(F.count("*").alias("blobs"), size(F.lit(True)).alias("bytes"), F.count_if(alive).alias("kept"), size(alive).alias("kept_bytes"), F.count_if(~alive).alias("freed"), size(~alive).alias("freed_bytes"))


def reachable(edges: DataFrame, roots: DataFrame, until: str | None = None) -> DataFrame:
    """(node, depth): nodes reached from roots(node) by edges(node, ref), at their least depth; each round's frontier is distinct and new.

    A round a step away from the roots, however many: where depth doesn't matter, history.forebears() takes fewer. With
    `until`, the search ends as soon as that node is met.
    """
    seen = frontier = written(roots.select("node").distinct().withColumn("depth", F.lit(0).cast("long")), "frontier")
    depth = 0
    while True:
        depth += 1
        frontier = frontier.join(edges, "node").select(F.col("ref").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth).cast("long"))
        frontier = written(frontier, "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:  # a plan of few parts
            seen = written(seen, "seen")
        if until is not None and not frontier.filter(F.col("node") == until).isEmpty():
            return seen
