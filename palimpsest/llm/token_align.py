"""Alignment of two tokenizers by byte ranges, with corpus-wide counts of linked ids under a minimal perfect hash.

1. Each text is cut at single spaces between characters that are no white space, where neither tokenizer ever joins
   bytes; the distinct chunks of a slice are encoded once and laid out again. A text's ids are kept as a table, with what
   needs no counts: offsets where tokens of both sides end cut them into groups, and every stretch between two ends of
   either side is one link, since each side covers the text once.
2. The distinct id pairs are dealt to shards by a hash, and a task makes each shard's minimal perfect hash: levels of
   bits, a key standing where it is alone, the others going a level down; a pair's number is the rank of its bit. The
   pairs lie in that order too, so that a look-up is verified against the pair itself.
3. Up to PAIRS pairs at a time go to all tasks as such an index. Tasks read the kept ids, align them again and count in a
   dense vector under the hash; the vectors are added up a tree, in chunks. More pairs than that take further rounds.
4. A second reading aligns once more and looks up the counts of each document's links.

Defined results: texts that are null or empty, or whose bytes one side does not give back, have no tokens, zeros and an
empty groups_sha256; such a text in one row does not touch the others; a null doc_id is kept; repeated rows count as
often as they occur; special tokens' strings in texts are plain text; a very long text is aligned whole, alone in its
slice; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import ragged, sliced_by_bytes, written
from palimpsest.llm.packing import LONG_RUN, ByteBpe
from palimpsest.llm.text_hash import mixed
from palimpsest.session import table

VOCABULARIES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Bytes of text encoded at a time; chunks whose ids a task remembers.
SLICE, REMEMBERED = 1 << 20, 200_000
#: Pairs that one index holds: at 12 bytes each the bound on what is broadcast at once. Pairs of a shard, and counts of a chunk.
PAIRS, SHARD, CHUNK = 16_000_000, 1 << 16, 1 << 14
#: Vectors that one task adds up.
FAN = 16
_MOST_LEVELS = 48


class Tokenizers:
    """Both sides with the bytes of their ids, and the ids of chunks met so far."""

    def __init__(self, a: str, b: str):
        self.bpe, self.pieces = ByteBpe(a), sentencepiece.SentencePieceProcessor(model_file=b)
        special = set(self.bpe.fast._special_tokens.values())
        of_a = [b"" if n in special else self.bpe.fast.decode_single_token_bytes(n) for n in range(self.bpe.fast.n_vocab)]
        of_b = []
        for n in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(n)
            of_b.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(n) else piece.replace("▁", " ").encode())
        self.bytes_a, self.bytes_b = of_a, of_b
        self.lengths = [np.array([len(x) for x in of], np.int64) for of in (of_a, of_b)]
        if any(" " in piece.lstrip(" ") for piece in (x.decode("utf-8", "replace") for x in of_b)):
            raise ValueError("a piece joins what stands on both sides of a space: texts can't be cut there")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.sizes, self.sound = [np.zeros(0, np.uint32)] * 2, [np.zeros(0, np.int64)] * 2, np.zeros(0, bool)

    def numbers(self, chunks: list[bytes]) -> np.ndarray:
        """Where ids, sizes and sound (whether b gives the bytes back) have each chunk, a space and what follows it."""
        if len(self.known) > REMEMBERED:
            self._forget()
        if new := [c for c in chunks if c not in self.known]:
            texts, plain = [c.decode() for c in new], self.bpe.fast.encode_ordinary
            of_a = [plain(t) if len(t) <= LONG_RUN else self.bpe.ids(t).tolist() for t in texts]
            of_b = self.pieces.encode([t[1:] for t in texts], num_threads=1)
            for side, lists in enumerate((of_a, of_b)):
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                self.ids[side] = np.concatenate([self.ids[side], np.fromiter(chain.from_iterable(lists), np.uint32, int(sizes.sum()))])
                self.sizes[side] = np.concatenate([self.sizes[side], sizes])
            own = self.bytes_b
            self.sound = np.concatenate([self.sound, np.array([b"".join([own[n] for n in b]) == c for c, b in zip(new, of_b)], bool)])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))


_INNER = np.array([b > 0x20 and b != 0x7F and b not in (0xC2, 0xE1, 0xE2, 0xE3) for b in range(256)])  # can't begin white space
_PLAIN, _TWO, _THREE = (np.array([lo <= b <= hi for b in range(256)]) for lo, hi in ((0x21, 0x7E), (0xC3, 0xDF), (0xE4, 0xEF)))


def _cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where chunks begin: at the begin of each text, and at single spaces between characters that are surely no white space."""
    at = np.flatnonzero(data == 0x20)
    at = at[(at >= 3) & (at < len(data) - 1)]
    before = _PLAIN[data[at - 1]] | (data[at - 1] >= 0x80) & (_TWO[data[at - 2]] | (data[at - 2] >= 0x80) & _THREE[data[at - 3]])
    return np.union1d(begins, at[before & _INNER[data[at + 1]]])


def encoded(of: Tokenizers, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ids of both sides of each text; both empty where a side does not give the bytes back."""
    some = [n for n, t in enumerate(texts) if t]
    out: list = [(np.zeros(0, np.uint32),) * 2] * len(texts)
    if not some:
        return out
    joined = b"".join(b" " + texts[n] for n in some)
    data = np.frombuffer(joined, np.uint8)
    begins = np.cumsum([0] + [len(texts[n]) + 1 for n in some])
    cuts = _cuts(data, begins[:-1])
    offsets = np.concatenate([cuts, [len(data)]]).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(joined)]).dictionary_encode()
    number = of.numbers(chunks.dictionary.to_pylist())[chunks.indices.to_numpy()]
    edges, sides = np.searchsorted(cuts, begins), []
    for side in (0, 1):
        sizes = of.sizes[side]
        places, own = np.cumsum(sizes) - sizes, sizes[number]
        sides.append((of.ids[side][ragged(places[number], own)], np.concatenate([[0], np.cumsum(own)])[edges]))
    sound = np.logical_and.reduceat(of.sound[number], edges[:-1])
    for k, n in enumerate(some):
        a, b = (ids[at[k] : at[k + 1]] for ids, at in sides)
        if not sound[k]:  # a chunk is not given back: ask for the whole text, as one
            whole = of.pieces.encode(texts[n].decode())
            b = np.array(whole, np.uint32)
            if b"".join(of.bytes_b[i] for i in whole) != b" " + texts[n]:
                continue
        if of.lengths[0][a].sum() == len(texts[n]) + 1:
            out[n] = a, b
    return out


@dataclass
class Links:
    """The links of many texts: ids of both sides, and where each text's begin (one more entry than texts)."""

    a: np.ndarray
    b: np.ndarray
    edges: np.ndarray
    #: Of each link: whether a token of that side ends with it.
    ends_a: np.ndarray
    ends_b: np.ndarray


def linked(ids_a: np.ndarray, ids_b: np.ndarray, count_a: np.ndarray, lengths: list[np.ndarray]) -> Links:
    """Links of texts laid one after the other, each of both sides' tokens or of none; count_a is how many of a each has."""
    at_a, at_b = np.cumsum(lengths[0][ids_a], dtype=np.int64), np.cumsum(lengths[1][ids_b], dtype=np.int64)
    flags = np.zeros((2, int(at_a[-1]) + 1 if len(at_a) else 1), bool)
    flags[0, at_a], flags[1, at_b] = True, True
    cut = np.flatnonzero(flags[0] | flags[1])
    ends_a, ends_b = flags[0, cut], flags[1, cut]
    n_a, n_b = np.cumsum(ends_a), np.cumsum(ends_b)
    last = np.concatenate([[0], np.cumsum(count_a)])
    edges = np.searchsorted(n_a, last, "left") + (last > 0)  # a text ends with its last token of a
    edges[last == 0] = 0
    return Links(ids_a[n_a - ends_a], ids_b[n_b - ends_b], edges, ends_a, ends_b)


def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of all ids, to the right in a row of their own, and how many each has."""
    width = len(str(size - 1))
    rows = np.array([list(str(n).rjust(width).encode()) for n in range(size)], np.uint8)
    return rows, np.array([len(str(n)) for n in range(size)])


class GroupTexts:
    """The groups of texts as `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, size: int):
        self.rows, self.lengths = _digits(size)
        self.width = self.rows.shape[1]

    def of(self, links: Links, ids_a: np.ndarray, ids_b: np.ndarray, count_a: np.ndarray, count_b: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The written groups of each text, and how many groups it has."""
        both = links.ends_a & links.ends_b
        until_a, until_b = np.cumsum(links.ends_a)[both], np.cumsum(links.ends_b)[both]  # tokens up to each group's end
        group_a, group_b = (np.repeat(np.arange(len(u)), np.diff(u, prepend=0)) for u in (until_a, until_b))
        place_a = np.arange(len(ids_a)) + np.concatenate([[0], until_b])[group_a]
        place_b = np.arange(len(ids_b)) + until_a[group_b]
        ids, marks = np.empty(len(ids_a) + len(ids_b), np.int64), np.full(len(ids_a) + len(ids_b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        marks[place_a[until_a - 1]], marks[place_b[until_b - 1]] = ord("|"), ord(";")
        table = np.empty((len(ids), self.width + 1), np.uint8)
        table[:, :-1], table[:, -1] = self.rows[ids], marks
        sizes = self.lengths[ids]
        flat = table[np.arange(self.width + 1) >= (self.width - sizes)[:, None]].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes + 1)])[np.concatenate([[0], np.cumsum(count_a + count_b)])]
        groups = np.diff(np.searchsorted(np.flatnonzero(both), links.edges))
        return [flat[x : max(x, y - 1)] for x, y in zip(ends[:-1], ends[1:])], groups


KEPT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids_a binary, ids_b binary"


def tokenized(docs: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """KEPT columns of docs(doc_id, text); ids are numbers of that kind, one after the other."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Tokenizers(a, b)
        groups = GroupTexts(max(len(of.bytes_a), len(of.bytes_b)))
        for part in sliced_by_bytes(batches, "text", SLICE):
            pairs = encoded(of, [(t or "").encode() for t in part.column("text").to_pylist()])
            count_a, count_b = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
            ids_a, ids_b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
            links = linked(ids_a, ids_b, count_a, of.lengths)
            told, n_groups = groups.of(links, ids_a, ids_b, count_a, count_b)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array(count_a), pa.array(count_b), pa.array(n_groups), pa.array(np.diff(links.edges)),
                pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in told], pa.string()),
                *[pa.array([p[k].astype(kind).tobytes() for p in pairs], pa.binary()) for k in (0, 1)],
            ], names=[x.split()[0] for x in KEPT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, KEPT)


@dataclass(frozen=True)
class Aligner:
    """Links of kept rows, a slice at a time, with each link's pair as one number."""

    #: How many bytes each id of either side has; how ids are kept.
    lengths: list[np.ndarray]
    kind: str

    @classmethod
    def of(cls, both: Tokenizers) -> Aligner:
        return cls([x.astype(np.uint8 if x.max() < 256 else np.int32) for x in both.lengths], "<u2" if max(map(len, both.lengths)) <= 1 << 16 else "<u4")

    @property
    def size_b(self) -> int:
        return len(self.lengths[1])

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """(rows, the links' pairs, where each row's begin)."""
        for part in sliced_by_bytes(batches, "ids_a", SLICE):
            rows = [part.column(c).to_pylist() for c in ("ids_a", "ids_b")]
            ids_a, ids_b = (np.frombuffer(b"".join(r), self.kind) for r in rows)
            count_a = np.array([len(x) for x in rows[0]]) // np.dtype(self.kind).itemsize
            links = linked(ids_a, ids_b, count_a, self.lengths)
            yield part, links.a.astype(np.int64) * self.size_b + links.b, links.edges


def distinct_pairs(kept: DataFrame, align: Aligner) -> DataFrame:
    """(pair) of all links, once each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for _, pairs, _ in align.slices(batches):
            found.append(np.unique(pairs))
            held += len(found[-1])
            if held > 4_000_000:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0])
                if held > 2_000_000:
                    yield pa.RecordBatch.from_pydict({"pair": found[0]})
                    found, held = [], 0
        if found:
            yield pa.RecordBatch.from_pydict({"pair": np.unique(np.concatenate(found))})

    return kept.select("ids_a", "ids_b").mapInArrow(each, "pair long").distinct()


# The minimal perfect hash


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mixed(keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((level + 1) * 0xD1342543DE82EF95 % (1 << 64)))


def _bits(n: int) -> int:
    """Bits of a level for n keys, in whole words."""
    return -(-max(2 * n, 64) // 64) * 64


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys left at each level, the levels' bits as words, the keys by number) of distinct keys."""
    left, sizes, words, placed = keys, [], [], []
    while len(left):
        if len(sizes) == _MOST_LEVELS:
            raise ValueError("keys are not distinct")
        m, level = _bits(len(left)), len(sizes)
        at = (_hash(left, level) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m)[at] == 1
        bits = np.zeros(m, np.uint8)
        bits[at[alone]] = 1
        sizes.append(len(left))
        words.append(np.packbits(bits, bitorder="little").view("<u8"))
        placed.append(left[alone][np.argsort(at[alone])])
        left = left[~alone]
    return np.array(sizes, np.int64), np.concatenate(words), np.concatenate(placed)


class PairIndex:
    """The hashes of several shards as one: numbers run on from shard to shard, and a look-up is verified."""

    def __init__(self, shards: int, some: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """some: of the shards held, out of so many, what perfect_hash() gave."""
        self.shards = shards
        deep = max((len(s[0]) for s in some.values()), default=0)
        self.size, self.base = np.zeros((shards, deep), np.int64), np.zeros((shards, deep), np.int64)
        at = 0
        for shard in sorted(some):
            for level, n in enumerate(some[shard][0]):
                self.size[shard, level], self.base[shard, level] = _bits(int(n)), at
                at += _bits(int(n))
        order = sorted(some)
        self.words = np.concatenate([some[s][1] for s in order]) if order else np.zeros(0, "<u8")
        self.keys = np.concatenate([some[s][2] for s in order]) if order else np.zeros(0, np.int64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return (_hash(keys, -1) % np.uint64(self.shards)).astype(np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; -1 for a key that is not held."""
        out, shard = np.full(len(keys), -1, np.int64), self.shard(keys)
        left = np.arange(len(keys))
        for level in range(self.size.shape[1]):
            left = left[self.size[shard[left], level] > 0]
            at = (_hash(keys[left], level) % self.size[shard[left], level].astype(np.uint64)).astype(np.int64) + self.base[shard[left], level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) > 0
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.before[at[hit] >> 6] + below
            left = left[~hit]
        right = out >= 0
        right[right] = self.keys[out[right]] == keys[right]
        return np.where(right, out, -1)


def hashed_shards(pairs: DataFrame, shards: int) -> DataFrame:
    """(shard, sizes, words, keys) as binaries: the minimal perfect hash of each shard of pairs."""
    empty = PairIndex(shards, {})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(empty.shard(batch.column(0).to_numpy())), batch.column(0)], names=["shard", "pair"])

    def made(rows: pa.Table) -> pa.Table:
        parts = perfect_hash(np.sort(rows.column("pair").to_numpy()))
        columns = [pa.array([x.tobytes()], pa.binary()) for x in parts]
        return pa.Table.from_arrays([rows.column("shard").combine_chunks()[:1], *columns], names=["shard", "sizes", "words", "keys"])

    return pairs.mapInArrow(dealt, "shard long, pair long").groupBy("shard").applyInArrow(made, "shard long, sizes binary, words binary, keys binary")


def dense_counts(kept: DataFrame, index, align: Aligner) -> DataFrame:
    """(chunk, counts): how many links each pair of the broadcast index has, chunk by chunk; the tasks' vectors added up a tree."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = index.value
        counts = np.zeros(-(-len(of.keys) // CHUNK) * CHUNK, np.int64)
        for _, pairs, _ in align.slices(batches):
            once = pa.array(pairs).value_counts()
            found = of.numbers(once.field("values").to_numpy())
            np.add.at(counts, found[found >= 0], once.field("counts").to_numpy()[found >= 0])
        chunks = counts.reshape(-1, CHUNK)
        some, task = np.flatnonzero(chunks.any(1)), TaskContext.get().partitionId()
        for start in range(0, len(some), 64):
            own = some[start : start + 64]
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(own), "task": pa.array(np.full(len(own), task, np.int64)), "counts": pa.array([chunks[k].tobytes() for k in own], pa.binary())})

    def added(rows: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in rows.column("counts"):
            total += np.frombuffer(x.as_py(), np.int64)
        return pa.Table.from_arrays([rows.column(0).combine_chunks()[:1], rows.column(1).combine_chunks()[:1], pa.array([total.tobytes()], pa.binary())], names=["chunk", "task", "counts"])

    schema = "chunk long, task long, counts binary"
    tasks, rows = kept.rdd.getNumPartitions(), kept.select("ids_a", "ids_b").mapInArrow(counted, schema)
    while True:
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("chunk", "task").applyInArrow(added, schema)
        tasks = -(-tasks // FAN)
        if tasks == 1:
            return rows.select("chunk", "counts")


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None, pairs_at_once: int | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of docs(doc_id, text)."""
    a, b = a or public_tokenizers.path(VOCABULARIES[0]), b or public_tokenizers.path(VOCABULARIES[1])
    at_once, spark = pairs_at_once or PAIRS, docs.sparkSession
    align = Aligner.of(Tokenizers(a, b))
    kept = written(tokenized(docs, a, b, align.kind).withColumn("row", F.monotonically_increasing_id()), "tokens", codec="zstd")
    pairs = written(distinct_pairs(kept, align), "pairs")
    n = pairs.count()
    shards = max(1, -(-n // min(SHARD, at_once)))
    hashes = written(hashed_shards(pairs, shards), "hashes")
    rounds = max(1, -(-n // at_once))

    def index_of(turn: int) -> PairIndex:
        rows = hashes.filter(F.col("shard") % rounds == turn).collect()  # about at_once pairs of 8 bytes
        return PairIndex(shards, {r.shard: tuple(np.frombuffer(x, np.int64 if k != 1 else "<u8") for k, x in enumerate((r.sizes, r.words, r.keys))) for r in rows})

    best, summed = np.zeros(align.size_b, np.int64), []
    for turn in range(rounds):
        index = spark.sparkContext.broadcast(index_of(turn))
        summed.append(written(dense_counts(kept, index, align), "counts"))
        np.maximum.at(best, index.value.keys % align.size_b, _vector(summed[-1], len(index.value.keys)))
        index.unpersist()

    parts = [_looked_up(kept, spark.sparkContext.broadcast((index_of(turn), _vector(summed[turn], None), best)), align) for turn in range(rounds)]
    out = parts[0]
    if rounds > 1:
        for more in parts[1:]:
            out = out.unionByName(more)
        sums = [F.sum(c).alias(c) for c in ("n_best", "count_sum")]
        out = out.groupBy("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").agg(*sums)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _vector(chunks: DataFrame, n: int | None) -> np.ndarray:
    """The counts of one index, out of their chunks."""
    rows = {r.chunk: np.frombuffer(r.counts, np.int64) for r in chunks.collect()}
    out = np.concatenate([rows.get(k, np.zeros(CHUNK, np.int64)) for k in range(max(rows, default=-1) + 1)] or [np.zeros(0, np.int64)])
    return out if n is None else np.pad(out, (0, max(0, n - len(out))))[:n]


def _looked_up(kept: DataFrame, held, align: Aligner) -> DataFrame:
    """kept's rows with n_best and count_sum over the links whose pairs the broadcast (index, counts, best) holds."""
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    names = [x.split()[0] for x in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, best = held.value
        for part, pairs, edges in align.slices(batches):
            coded = pa.array(pairs).dictionary_encode()
            once = coded.dictionary.to_numpy()
            number = index.numbers(once)
            count = np.where(number >= 0, np.append(counts, 0)[np.minimum(number, len(counts))], 0)
            top = (number >= 0) & (count == best[once % align.size_b])
            links = coded.indices.to_numpy()
            sums = [pa.array(np.diff(np.concatenate([[0], np.cumsum(x.astype(np.int64)[links])])[edges])) for x in (top, count)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names[:-2]], *sums], names=names)

    return kept.select(*names[:-2], "ids_a", "ids_b").mapInArrow(each, schema)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both public tokenizers over every document."""
    return aligned(table(spark, sf_dir, "documents"))
