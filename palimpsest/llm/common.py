"""What the training-data operators share: tables in the cluster's shared folder, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from palimpsest.session import dropped, written  # noqa: F401


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, rows: int = 256) -> DataFrame:
    """fn over slices of at most `rows` rows of each Arrow batch, so that a task holds few texts at once; nothing is shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                yield fn(batch.slice(start, rows))

    return df.mapInArrow(each, schema)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, one run after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def sliced_by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices whose texts in `column` have `most` bytes together, or one row where that has more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def map_groups(df: DataFrame, fn: Callable[[pa.Table], dict[str, list] | None], schema: str) -> DataFrame:
    """fn over the rows of each value of df's first column, a long; many small groups share one pass and one output batch.

    A group must fit in a task's memory: callers split large ones into blocks first.
    """
    key = df.columns[0]
    names = [field.rpartition(" ")[0].strip() for field in schema.split(",")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = rows.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            out: dict[str, list] = {n: [] for n in names}
            for a, b in zip(edges[:-1], edges[1:]):
                for n, values in (fn(rows.slice(a, b - a)) or {}).items():
                    out[n].extend(values)
            if out[names[0]]:
                yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in out.items()})

        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(0)[batch.num_rows - 1].as_py()
            at = int(np.argmax(batch.column(0).to_numpy() == last))  # where the last group, still open, begins
            if held and (at or held[-1].column(0)[0].as_py() != last):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = []
            elif at:
                yield from done(pa.Table.from_batches([batch.slice(0, at)]))
            held.append(batch.slice(at))
        if held:
            yield from done(pa.Table.from_batches(held))

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(each, schema)
