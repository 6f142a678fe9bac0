"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

1. Equal vectors become one class. A class's vector is rotated at random and cut into blocks; each block has a random
   codebook, and a filter is one codeword of every block. A vector is list-decoded to all filters whose direction it
   exceeds by the threshold (and to its best filter in any case); how many codes are used follows from the recall of
   one, measured on random pairs just at the cosine asked for.
2. Within a filter every vector is compared with the filter's smallest id only. Vectors within half the link angle of
   one such leader form its core: they are linked with each other by the triangle inequality, without being compared.
3. Cores that share a filter are compared by their leaders, each pair once: too far apart for any link, so close that
   all their members are linked, or in between, where their members are compared. So a group of n close copies costs
   about n comparisons, not n * n, and its link counts are still exact. Where a filter holds many cores, they are dealt
   into blocks, and tasks compare two blocks at a time as matrices; only pairs close enough leave a task.
4. All cosines are of the original numbers in double precision. Links make components by large-star and small-star.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite number is linked with nothing;
vectors of different lengths are not linked; a null id keeps null as its component and is linked with nothing;
repeated rows of one id are one vector if they are equal, and different vectors if not; labels and other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, map_groups, written
from palimpsest.llm.components import connected_components
from palimpsest.session import table

#: Filters a vector meets in one code, on average.
LIST = 16
#: Vectors of a task that looks up filters; cores of a filter up to which its pairs are listed; cores of a block beyond that.
TASK, FEW, BLOCK = 50_000, 64, 1024


@dataclass(frozen=True)
class CapFilters:
    dim: int
    blocks: int
    words: int
    alpha: float
    codes: int

    def code(self, number: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The rotation and the codebooks of one code, from its number alone."""
        rng = np.random.default_rng([self.dim, self.blocks, self.words, number])
        rotation = np.linalg.qr(rng.standard_normal((self.dim, self.dim)))[0]
        books = [_unit(rng.standard_normal((self.words, len(part)))) for part in np.array_split(np.arange(self.dim), self.blocks)]
        return rotation, books

    def scorer(self, number: int) -> Callable[[np.ndarray], list[np.ndarray]]:
        """A code's function: for each block, the score of every vector with every codeword; blocks count alike, whatever their length."""
        rotation, books = self.code(number)

        def scores(vectors: np.ndarray) -> list[np.ndarray]:
            turned = np.pad(vectors, ((0, 0), (0, self.dim - vectors.shape[1]))) @ rotation
            return [_unit(p) @ book.T / math.sqrt(self.blocks) for p, book in zip(np.array_split(turned, self.blocks, axis=1), books)]

        return scores

    def scores(self, vectors: np.ndarray, number: int) -> list[np.ndarray]:
        return self.scorer(number)(vectors)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def decode(scores: list[np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all vectors: the filters whose block scores add up to alpha, or else a vector's best."""
    tops = [s.max(1) for s in scores]
    least = np.minimum(alpha, sum(tops) - 1e-12)
    rows, ids, sums = np.arange(len(least)), np.zeros(len(least), np.int64), np.zeros(len(least))
    for block, s in enumerate(scores):
        rest = sum(tops[block + 1 :], np.zeros(len(least)))
        owner, word = np.nonzero(s >= (least - rest - sum(tops[:block]))[:, None])
        own = np.bincount(owner, minlength=len(least))
        begins, n = np.cumsum(own) - own, own[rows]
        at = np.repeat(begins[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
        rows, sums = np.repeat(rows, n), np.repeat(sums, n) + s[owner[at], word[at]]
        kept = sums >= (least - rest)[rows]
        rows, sums, ids = rows[kept], sums[kept], (np.repeat(ids, n) * s.shape[1] + word[at])[kept]
    return rows, ids


def fit_filters(dim: int, vectors: int, cosine: float, miss: float = 1e-5) -> CapFilters:
    """Sizes for so many vectors: filters outnumber them about 256 to 1, and all codes together miss a pair at `cosine` with a chance of `miss`."""
    dim = max(dim, 16)
    blocks = 2 if vectors <= 1 << 22 else 3
    words = int(np.clip(2 ** math.ceil(math.log2((256 * max(1, vectors)) ** (1 / blocks))), 256, 4096))
    rng, high, step = np.random.default_rng(dim), 1.0, 1 / 64
    scored = CapFilters(dim, blocks, words, 0.0, 1).scores(rng.standard_normal((200, dim)), 0)
    met_by = lambda alpha: len(decode(scored, alpha)[0]) / 200
    while met_by(high - step) <= LIST:  # from above, where lists are short
        high -= step
    for _ in range(6):
        step /= 2
        high -= step if met_by(high - step) <= LIST else 0
    x = _unit(rng.standard_normal((400, dim)))
    aside = rng.standard_normal((400, dim))
    aside = _unit(aside - (aside * x).sum(1, keepdims=True) * x)
    y = cosine * x + math.sqrt(1 - cosine**2) * aside
    one = CapFilters(dim, blocks, words, high, 1)
    (row_a, a), (row_b, b) = decode(one.scores(x, 0), high), decode(one.scores(y, 0), high)
    places = words**blocks
    met = len(np.unique(np.intersect1d(row_a * places + a, row_b * places + b) // places)) / len(x)
    return CapFilters(dim, blocks, words, high, math.ceil(math.log(miss) / math.log(1 - min(met, 0.99))))


def _filters_of(classes: DataFrame, caps: CapFilters, tasks: int) -> DataFrame:
    """(key, node): the filters of every class's vector."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1))
            vectors = _unit(vectors / np.abs(vectors).max(1, keepdims=True)) if len(vectors) else vectors
            for number in range(caps.codes):
                scores_of = caps.scorer(number)
                for start in range(0, len(nodes), 128):
                    rows, found = decode(scores_of(vectors[start : start + 128]), caps.alpha)
                    yield pa.RecordBatch.from_pydict({"key": found + number * caps.words**caps.blocks, "node": nodes[start + rows]})

    return classes.select("node", "vector").repartition(tasks).mapInArrow(listed, "key long, node long")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _cosines(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(a, b) with their cosine, in double precision."""

    def measured(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = _matrix(batch.column(2)), _matrix(batch.column(3))
        a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
        cosine = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["a", "b", "cosine"])

    of = classes.select("node", "vector")
    both = pairs.join(of.toDF("a", "va"), "a").join(of.toDF("b", "vb"), "b").select("a", "b", "va", "vb")
    return map_batches(both, measured, "a long, b long, cosine double", rows=4096)


def _close_in_blocks(many: DataFrame, classes: DataFrame, cores: DataFrame, angle: float) -> DataFrame:
    """The pairs (a, b) of cores of one filter, of many(key, core, n), that are close enough for any of their members to be linked."""
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("core", F.lit(1)), blocks)
    two = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.xxhash64("key", F.least(own, k), F.greatest(own, k)))
    dealt = many.select(F.explode(two).alias("g"), "core").join(cores.select("core", "radius"), "core")
    dealt = dealt.join(classes.select(F.col("node").alias("core"), "vector"), "core").select("g", "core", "radius", "vector")

    def close(rows: pa.Table) -> dict[str, list]:
        ids, radius, vectors = rows.column(1).to_numpy(), rows.column(2).to_numpy(), _matrix(rows.column(3).combine_chunks())
        vectors, a, b = _unit(vectors / np.abs(vectors).max(1, keepdims=True)), [], []
        for start in range(0, len(ids), 256):
            turn = np.arccos(np.clip(vectors[start : start + 256] @ vectors.T, -1, 1))
            i, j = np.nonzero(turn <= angle + radius[start : start + 256, None] + radius + 1e-6)
            x, y = ids[start + i], ids[j]
            a.append(x[x < y])
            b.append(y[x < y])
        return {"a": np.concatenate(a), "b": np.concatenate(b)}

    return map_groups(dealt, close, "a long, b long")


def _linked(classes: DataFrame, dim: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(node, n_links) where it is above none, and the links (a, b) that make the components, for vectors of one length."""
    size = classes.count()
    caps = fit_filters(dim, size, cosine)
    angle = math.acos(cosine)
    tasks = max(classes.sparkSession.sparkContext.defaultParallelism, -(-size // TASK))
    met = written(_filters_of(classes, caps, tasks), "filters")
    hubs = met.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = written(met.join(hubs, "key"), "shared")
    stars = shared.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    close = written(_cosines(stars, classes).filter(F.col("cosine") >= math.cos(angle / 2) + 1e-9), "close")
    members = close.select(F.col("b").alias("node")).distinct()
    led = close.join(members, close["a"] == members["node"], "left_anti").groupBy("b").agg(F.min(F.struct("a", "cosine")).alias("to"))
    led = led.select(F.col("b").alias("node"), F.col("to.a").alias("core"), F.acos(F.least("to.cosine", F.lit(1.0))).alias("away"))
    placed = written(
        classes.select("node", "copies").join(led, "node", "left")
        .select("node", "copies", F.coalesce("core", "node").alias("core"), F.coalesce("away", F.lit(0.0)).alias("away")), "placed",
    )
    cores = placed.groupBy("core").agg(F.sum("copies").alias("weight"), F.max("away").alias("radius"))

    inside = shared.select("key", "node").join(placed.select("node", "core"), "node").select("key", "core").distinct()
    mixed = inside.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    inside = written(inside.join(mixed, "key"), "inside")
    few = inside.filter(F.col("n") <= FEW).select("key", "core")
    pairs = few.toDF("key", "a").join(few.toDF("key", "b"), "key").filter("a < b").select("a", "b")
    many = inside.filter(F.col("n") > FEW)
    if not many.isEmpty():
        pairs = pairs.unionByName(_close_in_blocks(many, classes, cores, angle))
    pairs = pairs.distinct()
    apart = _cosines(pairs, classes).withColumn("angle", F.acos(F.least("cosine", F.lit(1.0))))
    apart = apart.join(cores.toDF("a", "weight_a", "radius_a"), "a").join(cores.toDF("b", "weight_b", "radius_b"), "b")
    reach = F.col("radius_a") + F.col("radius_b")
    apart = written(apart.filter((F.col("cosine") >= cosine) | (reach > 0) & (F.col("angle") <= angle + reach + 1e-7)).withColumn("reach", reach), "apart")
    alone = F.col("reach") == 0  # two single vectors: their cosine has decided
    whole = apart.filter(alone | (F.col("angle") + F.col("reach") <= angle - 1e-7))
    some = apart.filter(~alone & (F.col("angle") + F.col("reach") > angle - 1e-7)).select("a", "b")
    own = placed.select("core", "node")
    each = some.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    single = written(_cosines(each, classes).filter(F.col("cosine") >= cosine).select("a", "b"), "single")

    by_core = whole.select(F.col("a").alias("core"), F.col("weight_b").alias("more")).unionByName(whole.select(F.col("b").alias("core"), F.col("weight_a").alias("more")))
    by_core = cores.join(by_core.groupBy("core").agg(F.sum("more").alias("more")), "core", "left").select("core", (F.col("weight") + F.coalesce("more", F.lit(0))).alias("n"))
    ends = single.unionByName(single.select(F.col("b").alias("a"), F.col("a").alias("b")))
    by_node = ends.join(placed.select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("m"))
    counts = placed.join(by_core, "core").join(by_node, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"))
    links = placed.filter("node <> core").select(F.col("core").alias("a"), F.col("node").alias("b")).unionByName(whole.select("a", "b")).unionByName(single)
    return counts, links


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors(vec_id, embedding)."""
    kind = "array<double>" if "double" in dict(vectors.dtypes)["embedding"] else "array<float>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("vector"))
    sound = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.coalesce(F.isnan(x), F.lit(True)))
    sound = sound & F.exists("vector", lambda x: x != 0) & F.col("vec_id").isNotNull()
    same = rows.filter(sound).groupBy("vector").agg(F.min("vec_id").alias("least"), F.count_distinct("vec_id").alias("copies"))
    classes = written(same.withColumn("node", F.monotonically_increasing_id()), "classes")  # an id may stand for several vectors: classes have numbers of their own
    counts = links = None
    for (dim,) in classes.select(F.size("vector")).distinct().collect():
        n, found = _linked(classes.filter(F.size("vector") == dim), dim, cosine)
        counts, links = (n, found) if counts is None else (counts.unionByName(n), links.unionByName(found))
    if counts is None:
        empty = F.when(F.col("vec_id").isNotNull(), F.lit(True)).otherwise(False)
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), empty.alias("kept"))
    own = classes.join(connected_components(links), "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    least = own.groupBy("component").agg(F.min("least").alias("component_id"))
    found = own.join(least, "component").select("node", "component_id")
    named = classes.join(counts, "node").join(found, "node").select("vector", "n_links", "component_id")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    out = rows.join(named.withColumn("sound", F.lit(True)), ["sound", "vector"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, whatever their labels, linked at a cosine of 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0
), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept FROM embeddings e JOIN m USING (vec_id) LEFT JOIN n USING (vec_id)
"""
