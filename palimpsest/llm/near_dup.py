"""MinHash near-duplicates: universal hash minima in bands, signature check, full-set check, star-shaped components.

1. Row by row: the set of distinct word shingles (64-bit hashes), MINIMA minima of it under universal hashes, one key a
   band, one byte each of SIGNATURE minima, and a 128-bit digest of the set.
2. Equal sets become one class, before anything else; only classes go on, whatever number of copies they stand for.
3. Within a band's bucket every class is paired with one hub, never all with all. Pairs pass a signature check that is
   six standard deviations wide of the threshold, then the exact check on both full sets. A hub of very many pairs is
   dealt to several tasks, each with a copy of its row.
4. Components of the links found. Where a bucket then still holds several components, tasks compare the classes of
   different components in blocks, by signature and by full set, and give back just the links that join components: a
   link between classes of one bucket is either found or both are in one component already.

Bands are as long as MISS allows: 40 of 8 minima for a threshold of 0.85, where a pair just at the threshold shares no
bucket with a chance of 3 in a million; 53 of 6 for 0.8.

Defined results: a null text has no words; a text without words has an empty set and is linked with nothing; a text
of fewer words than a shingle is one shingle; a null doc_id is linked with nothing and has a null component; repeated
rows of one doc_id are one node; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, map_groups, written
from palimpsest.llm.components import connected_components
from palimpsest.llm.text_hash import ODD, mixed, word_hashes
from palimpsest.session import table

MINIMA, SIGNATURE = 320, 256
#: The chance that a pair just at the threshold shares no band.
MISS = 1e-5
#: Up to this many ids (8 bytes each) are broadcast to fetch texts by; more are joined by shuffle.
BROADCAST_IDS = 500_000

#: Buckets take their hubs in so many different orders of the classes, so that a class meets several hubs of a large group.
HUBS = 4
#: Rows of a bucket that one task holds with as many others.
BLOCK = 1024

_RNG = np.random.default_rng(21)
_MULTIPLY = (_RNG.integers(0, 1 << 32, MINIMA, np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, MINIMA, np.uint64).astype(np.uint32)


@dataclass(frozen=True)
class Likeness:
    words: int = 5
    #: Linked where 100 * intersection >= percent * union.
    percent: int = 80

    def banding(self) -> tuple[int, int]:
        """(bands, rows): the longest bands that MISS allows."""
        for rows in range(16, 1, -1):
            if (1 - (self.percent / 100) ** rows) ** (MINIMA // rows) <= MISS:
                return MINIMA // rows, rows
        return MINIMA, 1


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    word, edges = word_hashes([t.lower() for t in texts])  # bytes.lower() is A-Z only
    n = max(0, len(word) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += word[k : k + n] * ODD[k]
    rolled = mixed(rolled)
    sets = []
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a >= words:
            sets.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            sets.append(mixed((word[a:b] * ODD[32 : 32 + b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(docs: DataFrame, like: Likeness) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, keys, sig) of docs(doc_id, text)."""
    (bands, per), words = like.banding(), like.words
    band_of, lane = np.arange(bands, dtype=np.uint64)[:, None], ODD[16 : 16 + per][None, :, None]

    def signed(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()], words)
        sizes = np.array([len(s) for s in sets])
        some = np.flatnonzero(sizes)
        n = len(sets)
        digest, keys = np.zeros((2, n), np.uint64), np.zeros((n, bands), np.uint64)
        sig = np.zeros((n, SIGNATURE), np.uint8)
        if len(some):
            flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
            digest[0, some] = np.add.reduceat(mixed(flat + ODD[60]), at)
            digest[1, some] = np.bitwise_xor.reduceat(mixed(flat * ODD[61]), at)
            high, least = (flat >> np.uint64(32)).astype(np.uint32), np.empty((MINIMA, len(some)), np.uint32)
            for i in range(MINIMA):
                np.minimum.reduceat(high * _MULTIPLY[i] + _ADD[i], at, out=least[i])
            rows = (least[: bands * per].reshape(bands, per, -1).astype(np.uint64) * lane).sum(1)
            keys[some] = mixed(rows + band_of * ODD[62]).T
            sig[some] = (least[:SIGNATURE] * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).T
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists, pa.array([r.tobytes() for r in sig], pa.binary())],
            names=["doc_id", "n_shingles", "d1", "d2", "keys", "sig"],
        )

    schema = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, sig binary"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), signed, schema, rows=96)


def _slack(like: Likeness) -> float:
    """Six standard deviations of the share of equal minima, at the threshold."""
    return 6 * (like.percent * (100 - like.percent) / SIGNATURE) ** 0.5 / 100


def _shared_ends(pairs: DataFrame) -> DataFrame:
    """(node, parts) of the ends that more than BLOCK of the pairs (a, b) share, hubs of large buckets: at most two for every BLOCK pairs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    shared = written(ends.filter("parts > 1"), "shared")
    return F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared


def _with_ends(pairs: DataFrame, rows: DataFrame, shared: DataFrame) -> DataFrame:
    """pairs(a, b) with the value of both ends out of rows(node, value), as value_a and value_b; a shared end meets its pairs in as many parts as `shared` says."""
    value, parts = rows.columns[1], F.coalesce("parts", F.lit(1))
    dealt = rows.join(shared, "node", "left").select("node", value, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    for end, other in (("a", "b"), ("b", "a")):
        part = F.pmod(F.xxhash64(other), parts).alias("part")
        pairs = pairs.join(shared.withColumnRenamed("node", end), end, "left").select(*pairs.columns, part)
        pairs = pairs.join(dealt.toDF(end, f"{value}_{end}", "part"), [end, "part"]).drop("part")
    return pairs


def _alike(pairs: DataFrame, classes: DataFrame, shared: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in a share of `least` or more."""

    def agreeing(batch: pa.RecordBatch) -> pa.RecordBatch:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SIGNATURE) for k in (2, 3))
        return batch.filter(pa.array((a == b).mean(1) >= least)).select([0, 1])

    both = _with_ends(pairs, classes.select("node", "sig"), shared).select("a", "b", "sig_a", "sig_b")
    return map_batches(both, agreeing, "a long, b long", rows=4096)


def _sets_of(nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, items) for the nodes, made again from their whole texts."""
    if nodes.count() <= BROADCAST_IDS:
        nodes = F.broadcast(nodes)
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()], words)
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))], names=["node", "items"])

    return map_batches(texts, made, "node long, items array<long>", rows=96)


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) of classes that are linked: by their signatures, then by their full sets."""
    shared_ends = _shared_ends(pairs)
    near = written(_alike(pairs, classes, shared_ends, like.percent / 100 - _slack(like)), "near")
    nodes = near.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = written(_sets_of(nodes, docs, like.words), "sets")
    both = _with_ends(near, sets, shared_ends)
    shared = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - F.col("shared")
    return both.withColumn("shared", shared).filter(F.col("shared") * 100 >= union * like.percent).select("a", "b").distinct()


def _blocks(rows: DataFrame) -> DataFrame:
    """rows(key, n, node, part) as (g, node, part): a bucket of more than BLOCK rows is dealt into blocks, a group for each two of them."""
    blocks = F.ceil(F.col("n") / BLOCK)
    own = F.pmod(F.xxhash64("node", F.lit(1)), blocks)
    two = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda k: F.xxhash64("key", F.least(own, k), F.greatest(own, k)))
    return rows.select(F.explode(two).alias("g"), "node", "part")


def _links_across(groups: DataFrame, classes: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """Links (a, b) between different parts of a group of (g, node, part): as many as join the parts that belong together.

    Each member of the smaller parts is compared with all others inside the task, by signature and then by full set;
    only what passes leaves the task.
    """
    least, percent = like.percent / 100 - _slack(like), like.percent

    def others(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nodes, parts = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        names, counts = np.unique(parts, return_counts=True)
        return nodes, parts, np.flatnonzero(parts != names[counts.argmax()])

    def near(rows: pa.Table) -> dict[str, list] | None:
        nodes, parts, few = others(rows)
        sig = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8).reshape(-1, SIGNATURE)
        passing = np.zeros(len(nodes), bool)
        for x in few:
            hit = ((sig == sig[x]).mean(1) >= least) & (parts != parts[x])
            if hit.any():
                passing |= hit
                passing[x] = True
        return {"g": rows.column(0).to_numpy()[passing], "node": nodes[passing], "part": parts[passing]}

    def linked(rows: pa.Table) -> dict[str, list] | None:
        nodes, parts, few = others(rows)
        root = {p: p for p in parts.tolist()}

        def top(p: int) -> int:
            while root[p] != p:
                root[p] = p = root[root[p]]
            return p

        sizes = np.array([len(v) for v in rows.column(3)])
        at = np.cumsum(sizes) - sizes
        _, coded = np.unique(np.concatenate([c.flatten().to_numpy() for c in rows.column(3).chunks]), return_inverse=True)
        a, b, mark = [], [], np.zeros(coded.max() + 1, bool)
        for x in few:
            own = coded[at[x] : at[x] + sizes[x]]
            mark[own] = True
            shared = np.add.reduceat(mark[coded], at, dtype=np.int64)
            mark[own] = False
            for y in np.flatnonzero((shared * 100 >= percent * (sizes + sizes[x] - shared)) & (parts != parts[x])):
                p, q = top(int(parts[x])), top(int(parts[y]))
                if p != q:
                    root[max(p, q)] = min(p, q)
                    a.append(nodes[x])
                    b.append(nodes[y])
        return {"a": a, "b": b}

    signed = groups.join(classes.select("node", "sig"), "node").select("g", "node", "part", "sig")
    passed = written(map_groups(signed, near, "g long, node long, part long"), "passed")
    sets = _sets_of(passed.select("node").distinct(), docs, like.words)
    return map_groups(passed.join(sets, "node").select("g", "node", "part", "items"), linked, "a long, b long")


def near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of docs(doc_id, text)."""
    signed = written(signatures(docs, like), "signed")
    ids = ["n_shingles", "d1", "d2"]
    classes = written(
        signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*ids)
        .agg(F.min("doc_id").alias("node"), F.min_by(F.struct("keys", "sig"), "doc_id").alias("of"))
        .select("node", *ids, "of.keys", "of.sig"), "classes",
    )
    buckets = classes.select("node", F.explode("keys").alias("key"))
    order = F.xxhash64("node", F.pmod("key", F.lit(HUBS)))
    hubs = buckets.groupBy("key").agg(F.min_by("node", order).alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = written(buckets.join(hubs, "key"), "members")
    stars = members.filter("node <> hub").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    links = written(_confirmed(written(stars, "pairs"), classes, docs, like), "links")
    found = written(connected_components(links), "found")

    # What a star can't see: links between classes of a bucket that are still apart.
    apart = members.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    mixed = apart.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).filter("low < high")
    rest = written(_links_across(_blocks(apart.join(mixed.select("key", "n"), "key")), classes, docs, like).distinct(), "rest")
    if not rest.isEmpty():
        chains = found.filter("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b"))
        found = written(connected_components(chains.unionByName(rest)), "found")

    named = classes.select(*ids, "node").join(found, "node", "left").select(*ids, F.coalesce("component", "node").alias("component_id"))
    rows = signed.select("doc_id", *ids).join(named, ids, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def without_near_duplicates(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """The rows of docs, all their columns, less all but the least doc_id of each component; rows of a null doc_id stay."""
    judged = written(near_duplicates(docs, like), "judged")
    gone = judged.filter("not kept and doc_id is not null").select("doc_id")
    kept = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)
    again = judged.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(once)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component: three-word shingles, 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), Likeness(words=3, percent=85))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w
), c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)
"""
