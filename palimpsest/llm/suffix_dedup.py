"""Repeated passages by a family of sorted suffix tables that grows by batches, and exact matches between suffixes.

1. Of all suffixes of a text only some are indexed. Every window of `least` bytes picks the suffix whose first PREFIX
   bytes have the smallest hash, the leftmost of equal ones; equal windows pick alike, so two equal passages of `least`
   bytes share an indexed suffix at the same place in them. About one suffix in seventy is picked. Equal texts count
   once; what stands in two whole copies goes altogether.
2. Suffixes come in batches. A batch's prefixes are sorted into a table (level 0), scanned against all levels that are
   there, and two levels of equal size are merged into one of twice the size before the next batch comes. So a batch
   is compared with all before it in a logarithmic number of tables, and nothing old is sorted again but by merging.
3. Suffixes whose prefix occurs again, anywhere, are candidates. Each brings the bytes around it that its windows cover.
   Equal surroundings collapse into one before they meet. Within a task the suffixes of one prefix are sorted twice, by
   the bytes from the suffix on and by the bytes before it, backwards; from common prefix lengths of neighbours in both
   suffix arrays follows, for each window, whether another one holds the same bytes. These comparisons are of the bytes
   themselves. A prefix with more than BLOCK different surroundings is dealt out: its windows are counted by 128 bits
   of hash.
4. A document loses the bytes that its repeated windows cover.

Defined results: a null text counts as empty, and texts of fewer than `least` bytes lose nothing; matches never cross
documents; strings are judged on the input, not on what is left; repeated rows, with one doc_id or several, are copies
of each other; a null doc_id is kept; a very long text is indexed in pieces that overlap, with the same result; an
empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import dropped, ragged, sliced_by_bytes, written
from palimpsest.llm.text_hash import _powers, mixed
from palimpsest.session import table

LEAST, PREFIX = 200, 64
#: Batches that a whole table is dealt into.
BATCHES = 4
#: Bytes whose windows are hashed at a time.
PIECE = 1 << 18
#: Different surroundings of one prefix that one task sorts; rows of a task's sort.
BLOCK, SORTED = 4096, 20_000
#: Up to this many ids are broadcast to fetch texts by; more are joined by shuffle.
BROADCAST_IDS = 500_000

_RNG = np.random.default_rng(12)
_BYTES = _RNG.integers(0, 1 << 64, (2, 256), np.uint64)
_PLACE = 24


def _rolling(data: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of every `width` bytes in a row."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[lane][data] * down[: len(data)], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * up[: len(data) - width + 1])


def picked(data: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `least` bytes the place of the suffix that it picks; and the prefix hash at every place."""
    keys, width = _rolling(data, PREFIX), least - PREFIX + 1
    rank = (keys >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(keys), dtype=np.uint64)
    rows = np.pad(rank, (0, -len(rank) % width), constant_values=np.uint64(2**64 - 1)).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    n = len(keys) - width + 1
    low = np.minimum(back[:n], ahead[width - 1 : width - 1 + n])
    return (low & np.uint64((1 << _PLACE) - 1)).astype(np.int64), keys


def suffixes(texts: list[bytes], least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, key, place, first, last) of the picked suffixes: those of one text lie together, by place; first and last window that pick it."""
    found = []
    lengths = np.array([len(t) for t in texts])
    long = [n for n, t in enumerate(texts) if len(t) > PIECE]
    rest = np.flatnonzero((lengths >= least) & (lengths <= PIECE))
    jobs = []
    if len(rest):
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths[rest]) // PIECE)) + 1
        jobs += [(own, np.cumsum(lengths[own]) - lengths[own], b"".join(texts[n] for n in own), np.zeros(len(own), np.int64)) for own in np.split(rest, cuts)]
    for n in long:  # pieces that overlap by all but one byte of a window
        jobs += [(np.array([n]), np.zeros(1, np.int64), texts[n][start : start + PIECE + least - 1], np.array([start])) for start in range(0, len(texts[n]) - least + 1, PIECE)]
    for own, begins, joined, shift in jobs:
        data = np.frombuffer(joined, np.uint8)
        at, keys = picked(data, least)
        of = np.searchsorted(begins, np.arange(len(at)), "right") - 1
        ends = np.append(begins[1:], len(data))
        inside = np.flatnonzero(np.arange(len(at)) + least <= ends[of])
        new = np.ones(len(inside), bool)
        new[1:] = (at[inside[1:]] != at[inside[:-1]]) | (np.diff(inside) > 1)
        first = inside[new]
        last = inside[np.append(np.flatnonzero(new)[1:] - 1, len(inside) - 1)] if len(inside) else first
        move = (shift - begins)[of[first]]
        found.append((own[of[first]], keys[at[first]], at[first] + move, first + move, last + move))
    if not found:
        return tuple(np.zeros(0, np.uint64 if k == 1 else np.int64) for k in range(5))
    columns = [np.concatenate(c) for c in zip(*found)]
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


INDEXED = "doc_id long, digest binary, n_bytes long, keys array<long>"


def indexed(docs: DataFrame, least: int) -> DataFrame:
    """Each document with its digest, its size and the prefix hashes of its picked suffixes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced_by_bytes(batches, "text", PIECE):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            owner, key, *_ = suffixes(texts, least)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([len(t) for t in texts], pa.int64()),
                _lists(key.view(np.int64), owner, len(texts), pa.int64()),
            ], names=[x.split()[0] for x in INDEXED.split(", ")])

    return docs.mapInArrow(each, INDEXED)


class SuffixFamily:
    """Sorted tables of distinct prefix hashes, each of a power of two of batches, the larger ones first; two of a size are one before a batch comes."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []
        self.met: list[DataFrame] = []

    def add(self, keys: DataFrame) -> None:
        """A batch of (key), a row for each suffix: noted are prefixes that it holds twice or that a level holds."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            self.levels.append((2 * size, written(a.unionByName(b).distinct().sortWithinPartitions("key"), "level")))
            dropped(a)
            dropped(b)
        counts = written(keys.groupBy("key").agg((F.count("*") > 1).alias("twice")).sortWithinPartitions("key"), "level")
        met, new = counts.filter("twice").select("key"), counts.select("key")
        if self.levels:
            met = met.unionByName(new.join(reduce(DataFrame.unionByName, (t for _, t in self.levels)), "key", "left_semi"))
        self.met.append(written(met, "met"))
        self.levels.append((1, new))

    def repeated(self) -> DataFrame:
        """The prefixes (key) that occurred more than once so far."""
        return reduce(DataFrame.unionByName, self.met).distinct()


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(doc_id, digest, ...) with the text of a document of that id and digest."""
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = docs.withColumn("digest", digest)
    some = _few(wanted.select("digest"))
    rows = rows.join(some, "digest", "left_semi").alias("r")
    both = rows.join(wanted.alias("w"), (F.col("r.digest") == F.col("w.digest")) & F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")))
    return both.select(*[F.col(f"w.{c}") for c in wanted.columns], F.col("r.text"))


REGIONS = "node long, key long, place int, first int, last int, content binary, region binary"


def regions(texts: DataFrame, least: int) -> DataFrame:
    """The candidates of texts(node, keys, text) with the bytes that their windows cover, and a digest of these and of where the suffix lies in them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced_by_bytes(batches, "text", PIECE):
            nodes, own = part.column("node").to_numpy(), [(t or "").encode() for t in part.column("text").to_pylist()]
            owner, key, place, first, last = suffixes(own, least)
            key = key.view(np.int64)
            wanted = part.column("keys")
            among = np.repeat(np.arange(len(own)), pc.list_value_length(wanted).to_numpy())
            of = lambda text, k: k + text * np.int64(0x1E3779B97F4A7C15)  # noqa: E731  a stray one is a candidate too many
            some = np.flatnonzero(np.isin(of(owner, key), of(among, pc.list_flatten(wanted).to_numpy())))
            around = [own[owner[k]][first[k] : last[k] + least] for k in some]
            content = [hashlib.blake2b(b"%d %d " % (place[k] - first[k], last[k] - first[k]) + r, digest_size=16).digest() for k, r in zip(some, around)]
            numbers = [pa.array(x[some], pa.int32()) for x in (place, first, last)]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[owner[some]]), pa.array(key[some]), *numbers, pa.array(content, pa.binary()), pa.array(around, pa.binary())], names=[x.split()[0] for x in REGIONS.split(", ")])

    return texts.select("node", "keys", "text").mapInArrow(each, REGIONS)


def _common(rows: np.ndarray, group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row, in that order, has in common with the one before; -1 where the group is another."""
    sorted_rows, own = rows[order], group[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    lcp = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return np.concatenate([[-1], np.where(own[1:] == own[:-1], lcp, -1)])


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(p[:width].ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def matched(group: np.ndarray, ahead: np.ndarray, behind: np.ndarray, around: list[bytes], copies: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(row, back): the windows, by how far before the suffix they begin, that two rows of a group hold, or one that has copies.

    ahead and behind say how many windows' bytes lie before the suffix and which of them are its own: those that begin
    behind to ahead bytes before it. around are the bytes from the first window's begin to the last one's end.
    """
    n, width = len(around), least - PREFIX + 1
    right = _padded([r[a:] for r, a in zip(around, ahead)], least)
    left = _padded([r[:a][::-1] for r, a in zip(around, ahead)], width)
    ranks = []
    for rows in (right, left):
        whole = np.concatenate([np.ascontiguousarray(group.astype(">u8")).view(np.uint8).reshape(n, 8), rows], 1)
        order = np.argsort(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), kind="stable")
        ranks.append((order, _common(rows, group, order)))
    row, back = [], []
    for d in range(int(behind.min()), int(ahead.max()) + 1):
        classes = []
        for (order, lcp), deep in zip(ranks, (least - d, d)):
            of = np.empty(n, np.int64)
            of[order] = np.cumsum(lcp < deep)
            classes.append(of)
        some = np.flatnonzero((behind <= d) & (d <= ahead))
        _, at = np.unique(classes[0][some] * (n + 1) + classes[1][some], return_inverse=True)
        hit = some[np.bincount(at, weights=copies[some])[at] > 1]
        row.append(hit)
        back.append(np.full(len(hit), d))
    return np.concatenate(row), np.concatenate(back)


#: Which windows of some bytes occur again, as runs: they begin lo to hi bytes before the suffix.
FOUND = "key long, content binary, back array<struct<lo:int,hi:int>>"


def _found_in_groups(contents: DataFrame, least: int) -> DataFrame:
    """FOUND for contents(key, content, ahead, behind, region, copies) whose prefixes have few surroundings each: whole groups at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> pa.RecordBatch:
            key, ahead, behind, copies = (rows.column(c).to_numpy() for c in ("key", "ahead", "behind", "copies"))
            row, back = matched(key.view(np.uint64), ahead, behind, rows.column("region").to_pylist(), copies, least)
            order = np.argsort(row, kind="stable")
            row, back = row[order], back[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (back[1:] != back[:-1] + 1)
            ends = np.append(new[1:], True) if len(row) else new
            runs = pa.StructArray.from_arrays([pa.array(back[x], pa.int32()) for x in (new, ends)], ["lo", "hi"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[new], np.arange(len(key) + 1)).astype(np.int32)), runs)
            return pa.RecordBatch.from_arrays([rows.column("key").combine_chunks(), rows.column("content").combine_chunks(), lists], names=["key", "content", "back"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= SORTED:
                rows = pa.Table.from_batches(held)
                keys = rows.column("key").to_numpy()
                at = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
                if at:
                    yield done(rows[:at])
                held = pa.Table.to_batches(rows[at:])
        if held:
            yield done(pa.Table.from_batches(held))

    return contents.select("key", "content", "ahead", "behind", "region", "copies").repartition("key").sortWithinPartitions("key").mapInArrow(each, FOUND)


def _found_by_hash(contents: DataFrame, least: int) -> DataFrame:
    """FOUND for prefixes with many surroundings: every window's 128 bits of hash are counted, wherever its row lies."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                own, ahead = part.column("region").to_pylist(), part.column("ahead").to_numpy()
                n = np.array([len(r) - least + 1 for r in own])
                data, begins = np.frombuffer(b"".join(own), np.uint8), np.cumsum([0] + [len(r) for r in own])[:-1]
                at, row = ragged(begins, n), np.repeat(np.arange(len(own)), n)
                hashes = [pa.array(_rolling(data, least, lane)[at].view(np.int64)) for lane in (0, 1)]
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([*hashes, *[part.column(c).take(rows) for c in ("key", "content", "copies")], pa.array((ahead[row] - (at - begins[row])).astype(np.int32))], names=["h1", "h2", "key", "content", "copies", "back"])

    windows = contents.mapInArrow(each, "h1 long, h2 long, key long, content binary, copies long, back int")
    counts = windows.groupBy("h1", "h2").agg(F.sum("copies").alias("n")).filter("n > 1").select("h1", "h2")
    return windows.join(counts, ["h1", "h2"], "left_semi").groupBy("key", "content").agg(F.collect_list(F.struct(F.col("back").alias("lo"), F.col("back").alias("hi"))).alias("back"))


def _covered(texts: DataFrame, least: int) -> DataFrame:
    """(node, n_removed, n_spans, kept_sha256) of texts(node, at, text), `at` from where on windows go, and to where."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced_by_bytes(batches, "text", PIECE):
            out: list[list] = [[], [], []]
            for text, at in zip(part.column("text").to_pylist(), part.column("at")):
                data = np.frombuffer(text.encode(), np.uint8)
                steps = np.zeros(len(data) + 1, np.int32)
                np.add.at(steps, at.values.field("lo").to_numpy(), 1)
                np.add.at(steps, at.values.field("hi").to_numpy() + least, -1)
                gone = np.cumsum(steps[:-1]) > 0
                out[0].append(int(gone.sum()))
                out[1].append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                out[2].append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["node", "n_removed", "n_spans", "kept_sha256"])

    return texts.select("node", "at", "text").mapInArrow(each, "node long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(indexed(docs, least).withColumn("row", F.monotonically_increasing_id()), "indexed")
    one = F.min(F.struct("row", "doc_id"))
    classes = written(rows.groupBy("digest").agg(one.alias("one"), F.count("*").alias("copies")).select("digest", F.col("one.row").alias("node"), F.col("one.doc_id").alias("doc_id"), "copies"), "classes")
    picked_by = rows.select(F.col("row").alias("node"), "keys").join(classes.select("node"), "node", "left_semi").select("node", F.explode("keys").alias("key"))
    entries = written(picked_by, "entries", codec="zstd")
    heads = written(rows.select("doc_id", "digest", "n_bytes"), "heads")
    dropped(rows)

    family = SuffixFamily()
    for batch in range(batches):
        family.add(entries.filter(F.pmod(F.xxhash64("node"), F.lit(batches)) == batch).select("key"))
    repeated = written(family.repeated(), "repeated")
    wanted = entries.join(repeated, "key", "left_semi").groupBy("node").agg(F.collect_set("key").alias("keys"))
    wanted = written(wanted.join(classes.select("node", "digest", "doc_id"), "node"), "wanted")
    around = written(regions(_texts_of(docs, wanted), least), "regions", codec="zstd")

    distinct = around.groupBy("key", "content", (F.col("place") - F.col("first")).alias("ahead"), (F.col("place") - F.col("last")).alias("behind"), "region")
    contents = written(distinct.agg(F.count("*").alias("copies")), "contents", codec="zstd")
    sizes = contents.groupBy("key").agg(F.count("*").alias("n"), F.sum("copies").alias("all"))
    contents = contents.join(sizes.filter("all > 1"), "key")
    found = contents.filter("n = 1").select("key", "content", F.array(F.struct(F.col("behind").alias("lo"), F.col("ahead").alias("hi"))).alias("back"))
    found = found.unionByName(_found_in_groups(contents.filter(f"n > 1 and n <= {BLOCK}"), least)).unionByName(_found_by_hash(contents.filter(f"n > {BLOCK}"), least))

    single = classes.filter("copies = 1").select("node", "digest", "doc_id")
    marks = around.select("node", "key", "content", "place").join(found.filter("size(back) > 0"), ["key", "content"])
    marks = marks.join(single.select("node"), "node", "left_semi").select("node", F.transform("back", lambda d: F.struct((F.col("place") - d["hi"]).alias("lo"), (F.col("place") - d["lo"]).alias("hi"))).alias("at"))
    marks = written(marks.groupBy("node").agg(F.flatten(F.collect_list("at")).alias("at")).join(single, "node"), "marks", codec="zstd")
    changed = written(_covered(_texts_of(docs, marks), least), "changed")

    digests = classes.select("digest", "copies", "node")
    out = heads.join(digests.join(changed, "node", "left").drop("node"), "digest")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= least)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
    )


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of their repeated 200-byte strings."""
    return without_repeats(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents), t AS MATERIALIZED (SELECT r, doc_id, x, CAST(length(x) // 2 AS BIGINT) AS n FROM d),
w AS MATERIALIZED (SELECT r, p, md5(substr(x, 2 * p + 1, 400)) AS h FROM (SELECT r, x, unnest(range(0, n - 199)) AS p FROM t WHERE n >= 200)),
hits AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
runs AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS g FROM hits),
spans AS (SELECT r, g, min(p) AS a, max(p) + 200 AS b FROM runs GROUP BY 1, 2), gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS c FROM spans),
kept AS (SELECT r, string_agg(substr(x, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS k, max(b) AS e, count(*) AS n_spans, sum(b - a) AS n_removed FROM gaps JOIN t USING (r) GROUP BY 1)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN e IS NULL THEN x ELSE k || substr(x, 2 * e + 1) END)) AS kept_sha256 FROM t LEFT JOIN kept USING (r)
"""
