"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit distance.

Texts are sequences of lower-cased words; in scripts without spaces (Chinese, Japanese, Thai and the like) each character
is a word. A random walk over a sequence writes out the word it stands on, 2 w times, and
moves on or stays by a random bit of step and word; equal words met in step make equal bits, so sequences at a small edit
distance fall into step again after each edit and agree in most places written (Hamming distance for edit distance). An
LSH table samples a few of the places. Every item is indexed by its windows at all offsets, w words long (4, 8 or 16,
half to two thirds of a short item; longer items have many windows), so documents can be read at every (w / 4)-th
word and still meet each aligned item several times. How many tables there are follows from their recall, measured on
random edits of the items at the very threshold. A window that falls out of step with every item is dropped at the
first sampled place that says so. Where MOST_TABLES tables don't reach RECALL, and for items too short for any edit to
be allowed, runs of equal words take the tables' place: n words with at most k edits hold a run of n / (k + 1) words
unchanged, so looking up all such runs misses nothing.

Where a window meets an item, the item is laid against the document around that place: it is contained if some passage
of the document is within `edits` percent of its words by edit distance, which is computed in full.

Defined results: items of fewer than five words must be met exactly; null or empty texts match nothing; null ids are passed
on as they are; of several places at the same distance the first counts; repeated rows give repeated results; equal items are
searched once and given under each of their ids; a pass over the documents takes items of WORDS words together, so a
larger benchmark takes several; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, written
from palimpsest.llm.text_hash import NOT_WORD, ODD, mixed, word_hashes
from palimpsest.session import table

#: Item words of one pass over the documents: the bound on the index that is broadcast, some 12 bytes a word and table.
WORDS = 500_000
RECALL, MOST_TABLES = 0.998, 64
#: The longest run of words that is looked up.
LONGEST_RUN = 16

#: Scripts that put no spaces between words, and the UTF-8 bytes that their characters begin with.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_LEADS = bytes([0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0])


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    coded = []
    for t in texts:
        data = (t or "").lower().encode("utf-8", "surrogatepass")
        if len(data.translate(None, _LEADS)) != len(data):
            data = UNSPACED.sub(r" \g<0> ", t.lower()).encode("utf-8", "surrogatepass")
        coded.append(data)
    return word_hashes(coded, NOT_WORD)


@dataclass
class Table:
    """One walk and the places sampled of it, with the item windows' keys."""

    width: int
    places: np.ndarray
    salt: np.uint64
    maps: list[np.ndarray] | None = None  # by place: which leading 16 bits some item window shows there
    keys: np.ndarray | None = None
    order: np.ndarray | None = None  # the item window of each key
    owner: np.ndarray | None = None  # item and offset of each window, packed; the same array for all tables of a width

    @property
    def stride(self) -> int:
        return max(1, self.width // 4)

    @classmethod
    def draw(cls, width: int, number: int) -> Table:
        rng = np.random.default_rng([width, number])
        places = np.sort(rng.choice(2 * width, 3 if width < 8 else 4, replace=False))
        return cls(width, places, rng.integers(0, 1 << 64, dtype=np.uint64) | np.uint64(1))

    def walk(self, words: np.ndarray, starts: np.ndarray, prune: bool) -> tuple[np.ndarray, np.ndarray]:
        """The starts still in play and their keys; words must go on for 2 * width words after the last start."""
        coins = mixed(words * self.salt)
        at, key = starts.copy(), np.zeros(len(starts), np.uint64)
        sampled = {int(p): k for k, p in enumerate(self.places)}
        for step in range(int(self.places[-1]) + 1):
            k = sampled.get(step)
            if k is not None:
                shown = words[at]
                if prune:
                    kept = np.flatnonzero(self.maps[k][shown >> np.uint64(48)])
                    at, starts, key, shown = at[kept], starts[kept], key[kept], shown[kept]
                key = key + shown * ODD[k]
            at += ((coins[at] >> np.uint64(step)) & np.uint64(1)).astype(at.dtype)
        return starts, mixed(key)

    def index(self, words: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> None:
        coins, at = mixed(words * self.salt), starts.copy()
        self.maps = []
        for step in range(int(self.places[-1]) + 1):
            if step in self.places:
                seen = np.zeros(1 << 16, bool)
                seen[words[at] >> np.uint64(48)] = True
                self.maps.append(seen)
            at += ((coins[at] >> np.uint64(step)) & np.uint64(1)).astype(at.dtype)
        keys = self.walk(words, starts, False)[1]
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys, self.owner = keys[self.order], owner

    def meet(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, owner) of every document window that shares a key with an item window."""
        return _equal_keys(self, *self.walk(words, starts, True))


def _equal_keys(table: Table | Runs, starts: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.searchsorted(table.keys, keys, "left"), np.searchsorted(table.keys, keys, "right")
    n = high - low
    rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(starts, n), table.owner[table.order[rows]]


class Runs:
    """All runs of `width` words of some items, met by equal runs."""

    stride = 1

    def __init__(self, width: int, words: np.ndarray, starts: np.ndarray, owner: np.ndarray):
        self.width, self.owner = width, owner
        self.first = np.zeros(1 << 16, bool)
        self.first[words[starts] >> np.uint64(48)] = True
        keys = self._keys(words, starts)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]

    def _keys(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        key = np.zeros(len(starts), np.uint64)
        for k in range(self.width):
            key += words[starts + k] * ODD[k]
        return mixed(key)

    def meet(self, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = starts[self.first[words[starts] >> np.uint64(48)]]
        return _equal_keys(self, starts, self._keys(words, starts))


@dataclass
class Index:
    items: list[np.ndarray]  # the words of each item
    ids: list
    tables: list[Table | Runs]


def _width(n: int) -> int:
    return 16 if n >= 32 else 8 if n >= 12 else 4


def _windows(index: Index, own: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The items' words laid out with room behind each, the starts of all their windows, and whose they are."""
    flat = np.concatenate([np.append(index.items[n], np.full(2 * width, ODD[n % 32] + np.uint64(n), np.uint64)) for n in own])
    at, starts, owner = 0, [], []
    for n in own:
        offsets = np.arange(len(index.items[n]) - width + 1)
        starts.append(at + offsets)
        owner.append(n << 32 | offsets)
        at += len(index.items[n]) + 2 * width
    return flat, np.concatenate(starts), np.concatenate(owner)


def _add_runs(index: Index, own: list[int], edits: int) -> None:
    by_run = defaultdict(list)
    for n in own:
        size = len(index.items[n])
        by_run[min(LONGEST_RUN, size // (size * edits // 100 + 1))].append(n)
    index.tables += [Runs(run, *_windows(index, some, run)) for run, some in sorted(by_run.items())]


def build_index(ids: list, texts: list[str | None], edits: int = 20) -> Index:
    words, edges = _words(texts)
    kept = [(i, words[a:b]) for i, a, b in zip(ids, edges[:-1], edges[1:]) if b > a]
    index = Index([w for _, w in kept], [i for i, _ in kept], [])
    by_width, short = defaultdict(list), []
    for n, item in enumerate(index.items):
        if len(item) * edits < 100 or len(item) < 4:
            short.append(n)
        else:
            by_width[_width(len(item))].append(n)
    _add_runs(index, short, edits)
    for width, own in sorted(by_width.items()):
        flat, starts, owner = _windows(index, own, width)
        missed, tables = _edited([index.items[n] for n in own], edits), []
        left = np.ones(len(missed), bool)
        while len(tables) < MOST_TABLES and left.mean() > 1 - RECALL:
            drawn = Table.draw(width, len(tables))
            drawn.index(flat, starts, owner)
            tables.append(drawn)
            for k in np.flatnonzero(left):
                left[k] = not len(drawn.meet(missed[k], np.arange(0, len(missed[k]) - 2 * width, drawn.stride))[0])
        if left.mean() <= 1 - RECALL:
            index.tables += tables
        else:
            _add_runs(index, own, edits)
    return index


def _edited(items: list[np.ndarray], edits: int, trials: int = 1000) -> list[np.ndarray]:
    """Items drawn at random with as many random edits as still count, each behind up to 15 other words and before 40 more."""
    rng, out = np.random.default_rng(5), []
    for n in rng.integers(len(items), size=trials):
        words = items[n].tolist()
        for _ in range(len(words) * edits // 100):
            kind, at, new = rng.integers(3), int(rng.integers(len(words))), int(rng.integers(1 << 62))
            words[at : at + int(kind > 0)] = [new] * int(kind < 2)  # insert, replace, delete
        before, after = rng.integers(0, 1 << 64, rng.integers(16), np.uint64), rng.integers(0, 1 << 64, 40, np.uint64)
        out.append(np.concatenate([before, np.array(words, np.uint64), after]))
    return out


def edits_of(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The least edit distance of item to a stretch of passage, and where that stretch ends."""
    steps = np.arange(len(passage) + 1)
    row = np.zeros(len(passage) + 1, np.int64)
    for k, word in enumerate(item):
        best = np.minimum(row[1:] + 1, row[:-1] + (passage != word))
        row = np.minimum.accumulate(np.concatenate([[k + 1], best]) - steps) + steps
    return int(row.min()), int(row.argmin())


def held(index: Index, texts: list[str | None], edits: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(text, item) -> (distance, end word): the items that some texts hold, all by their places."""
    words, edges = _words(texts)
    long = np.concatenate([words, mixed(np.arange(1, 40, dtype=np.uint64))])  # what walks read after the last text
    met: set[tuple[int, int, int]] = set()
    starts: dict[int, np.ndarray] = {}
    for t in index.tables:
        if t.stride not in starts:
            starts[t.stride] = np.concatenate([np.arange(a, b, t.stride) for a, b in zip(edges[:-1], edges[1:])])
        for start, owner in zip(*t.meet(long, starts[t.stride])):
            met.add((int(np.searchsorted(edges, start, "right")) - 1, int(owner) >> 32, int(start) - (int(owner) & 0xFFFFFFFF)))
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for doc, n, start in sorted(met):
        item = index.items[n]
        most = len(item) * edits // 100
        if best.get((doc, n), (most + 1,))[0] == 0:
            continue
        a = max(int(edges[doc]), start - most)
        passage = words[a : min(int(edges[doc + 1]), max(a, start + len(item) + 2 * most))]
        if np.isin(item, passage).sum() < len(item) - most:  # fewer words in common than any such stretch has
            continue
        distance, end = edits_of(item, passage)
        if distance <= most and distance < best.get((doc, n), (most + 1,))[0]:
            best[doc, n] = distance, a + end - int(edges[doc])
    return best


def _indexes(items: DataFrame, edits: int) -> Iterator[Index]:
    """The indexes of items(item, text), WORDS words or so in each; one at least."""
    sizes = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]  # a word has two characters at least, but for unspaced scripts
    passes = max(1, -(-sizes // (2 * WORDS)))
    for number in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == number).orderBy("text").collect()
        yield build_index([r.item for r in rows], [r.text for r in rows], edits)


def _distinct_items(benchmark: DataFrame) -> DataFrame:
    """(item, text): every different text of the benchmark once, numbered."""
    texts = benchmark.select("text").filter("text is not null").distinct()
    return written(texts.select(F.monotonically_increasing_id().alias("item"), "text"), "items")


def leaks(docs: DataFrame, benchmark: DataFrame, edits: int = 20) -> DataFrame:
    """(doc_id, item_id, distance, words, end_word): every benchmark item that a document of docs(doc_id, text) holds."""
    items, out, names = _distinct_items(benchmark), None, ["doc_id", "item", "distance", "words", "end_word"]
    for index in _indexes(items, edits):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def found(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            index, ids = shared.value, batch.column(0).to_pylist()
            best = held(index, batch.column(1).to_pylist(), edits)
            rows = [(ids[doc], index.ids[n], d, len(index.items[n]), end) for (doc, n), (d, end) in sorted(best.items())]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)], names=names)

        part = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), found, ", ".join(f"{n} long" for n in names), rows=96)
        out = part if out is None else out.unionByName(part)
    named = benchmark.select("item_id", F.col("text").alias("said")).join(items, F.col("said") == F.col("text")).select("item", "item_id")
    return out.join(named, "item").select("doc_id", "item_id", *names[2:])


def without_leaks(docs: DataFrame, benchmark: DataFrame, edits: int = 20) -> DataFrame:
    """The rows of docs, all their columns, whose text holds no benchmark item; nothing is shuffled."""
    at = docs.columns.index("text")
    for index in _indexes(_distinct_items(benchmark), edits):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            kept = np.ones(batch.num_rows, bool)
            for doc, _ in held(shared.value, batch.column(at).to_pylist(), edits):
                kept[doc] = False
            return batch.filter(pa.array(kept))

        docs = map_batches(docs, clean, docs.schema, rows=96)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) with the item's words in the document, up to one edit in five words."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
