"""Best-fit packing by hierarchical residuals.

Each task tokenizes its documents, cuts the longer ones and packs the pieces best-fit (longest first) into sequences of
`size` tokens. Nearly full sequences are done. The others become items of their own: they are dealt to fewer tasks,
packed best-fit again, and so on up the tree, until one task has seen what is left, or, where even that would be more
than `items_per_task` items, until a round merges nothing. Tokens and texts never move; after the first pass only
(sequence, length) rows do, and at the end each piece looks up where its sequence came to lie.

Defined results: a null text counts as empty, and an empty text is one piece of one token, the end mark; a null doc_id
is kept as it is; repeated rows are packed as often as they occur; a document longer than `size` has its short piece
first; of pieces of one length the first in its task is placed first; a very long text is tokenized whole; an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm.common import written
from palimpsest.session import table

SIZE = 2048
#: Pieces that one best-fit run takes in, and items of a task in the later rounds: the bound on a task's memory.
WINDOW = 100_000
#: A sequence with so few tokens free is done.
NEARLY = 4
VOCABULARY = "byte_bpe_50k.json"
LONG_RUN = 20_000


class ByteBpe:
    """The ids that the tokenizers file gives; with `added`, as by the library's defaults, an added token's text in a document is that token.

    tiktoken runs its merges, several times as fast; texts with a run of LONG_RUN characters without white space, on
    which its merging is quadratic, go to the tokenizers library itself.
    """

    def __init__(self, path: str, added: bool = False):
        self.path, self.added = path, added
        model = json.load(open(path, encoding="utf-8"))
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level BPE writes other bytes as U+0100 and up
        others = [b for b in range(256) if b not in set(printable)]
        byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in model["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.exact: Tokenizer | None = None

    def ids(self, text: str) -> np.ndarray:
        if len(text) > LONG_RUN and max(map(len, text.split()), default=0) > LONG_RUN:
            if self.exact is None:
                self.exact = Tokenizer.from_file(self.path)
                self.exact.encode_special_tokens = not self.added
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all" if self.added else set(), disallowed_special=()), "<u4")


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the bins' lengths: longest first, each into the fullest bin that holds it."""
    bins, offsets, filled = [0] * len(lengths), [0] * len(lengths), []
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by free tokens
    free_mask = 0  # bit n: some bin has n tokens free
    for item in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        length = lengths[item]
        fits = free_mask >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            chosen = open_bins[free].pop()
            if not open_bins[free]:
                free_mask &= ~(1 << free)
        else:
            chosen, free = len(filled), size
            filled.append(0)
        bins[item], offsets[item] = chosen, filled[chosen]
        filled[chosen] += length
        if free := free - length:
            open_bins[free].append(chosen)
            free_mask |= 1 << free
    return bins, offsets, filled


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, bin_length long"


def pack_locally(docs: DataFrame, size: int, path: str) -> DataFrame:
    """Every piece of docs(doc_id, text) with the sequence (`bin`) that its own task put it in."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, added=True)
        made = TaskContext.get().partitionId() << 40
        names = [n.rpartition(" ")[0] for n in PIECES.split(", ")]
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, rows
            bins, offsets, filled = best_fit([r[3] for r in rows], size)
            columns = [*zip(*rows), [made + b for b in bins], offsets, [filled[b] for b in bins]]
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
            made, rows = made + len(filled), []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(bpe.ids(text.as_py() or ""), np.uint32(0))
                start, length = 0, len(ids) % size or size
                for piece in range(-(-len(ids) // size)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
                    start, length = start + length, size
                if len(rows) >= WINDOW:
                    yield flush()
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(packed, PIECES)


def repack(bins: DataFrame, tasks: int, turn: int, size: int) -> DataFrame:
    """bins(bin, length) dealt to so many tasks and packed best-fit: (bin, parent, shift, parent_length); a parent is named after its first bin."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), schema=pa.schema([("bin", pa.int64()), ("length", pa.int64())]))
        ids, lengths = got.column(0).to_pylist(), got.column(1).to_pylist()
        at, offsets, filled = best_fit(lengths, size)
        first = {b: ids[i] for i, b in enumerate(at) if offsets[i] == 0}
        yield pa.RecordBatch.from_pydict({"bin": pa.array(ids, pa.int64()), "parent": pa.array([first[b] for b in at], pa.int64()), "shift": pa.array(offsets, pa.int64()), "parent_length": pa.array([filled[b] for b in at], pa.int64())})

    dealt = bins.select("bin", "length").repartition(tasks, F.xxhash64("bin", F.lit(turn)))
    return dealt.mapInArrow(packed, "bin long, parent long, shift long, parent_length long")


def pack(docs: DataFrame, size: int = SIZE, path: str | None = None, items_per_task: int = WINDOW, merge: int = 8) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs(doc_id, text)."""
    path = path or public_tokenizers.path(VOCABULARY)
    pieces = written(pack_locally(docs, size, path), "pieces")
    part_full = pieces.filter((F.col("bin_offset") == 0) & (F.col("bin_length") < size - NEARLY))
    left = part_full.select("bin", F.col("bin_length").alias("length"))
    tasks, n, turn, placed = pieces.rdd.getNumPartitions(), left.count(), 0, None
    while n > 1:
        tasks = max(1, -(-tasks // merge), -(-n // items_per_task))
        moved = written(repack(left, tasks, turn, size), f"round{turn}")
        step = moved.select(F.col("bin").alias("sequence_id"), "parent", "shift")
        if placed is None:
            placed = step.select(F.col("sequence_id").alias("bin"), F.col("parent").alias("sequence_id"), "shift")
        else:
            up = step.withColumnRenamed("shift", "more")
            placed = placed.join(up, "sequence_id", "left").select("bin", F.coalesce("parent", "sequence_id").alias("sequence_id"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        left = moved.filter((F.col("shift") == 0) & (F.col("parent_length") < size - NEARLY)).select(F.col("parent").alias("bin"), F.col("parent_length").alias("length"))
        before, n, turn = n, left.count(), turn + 1
        if tasks == 1 or n == before and turn > 2:
            break
    if placed is None:
        placed = left.select("bin", F.col("bin").alias("sequence_id"), F.lit(0).alias("shift"))
    return pieces.join(placed, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
