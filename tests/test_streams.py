"""Logs that grow and rotate, and transactions cut at every place."""

from __future__ import annotations

import json

import pytest

from palimpsest.streaming import cdc
from palimpsest.streaming.log_source import NumberedLog
from palimpsest.streaming.txn import EVENTS, Brackets, committed, step


def read_on(spark, folder, tmp_path, got):
    """All lines that are new since the last call, by the same checkpoint."""
    spark.dataSource.register(NumberedLog)
    stream = spark.readStream.format("numbered_log").option("path", str(folder)).option("rangeBytes", 40).load()
    out = []

    def take(batch, _):
        out.extend((r.number, r.position, r.next_position, r.value) for r in batch.collect())

    stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(once=True).start().awaitTermination()
    got.extend(sorted(out))
    return [v for _, _, _, v in sorted(out)]


def test_a_log_that_grows_and_rotates(spark, tmp_path):
    folder, got = tmp_path / "log", []
    folder.mkdir()
    (folder / "binlog.000009").write_text("".join(f"line {k} {'x' * (k % 50)}\n" for k in range(30)) + "half")
    (folder / "index").write_text("not a log\n")
    assert read_on(spark, folder, tmp_path, got) == [f"line {k} {'x' * (k % 50)}" for k in range(30)]
    with (folder / "binlog.000009").open("a") as f:
        f.write(" is whole\nmore\n")
    assert read_on(spark, folder, tmp_path, got) == ["half is whole", "more"]
    with (folder / "binlog.000009").open("a") as f:
        f.write("last of nine, no end")
    (folder / "binlog.000010").write_text("ten 1\n\nten 3 é😀\n")
    assert read_on(spark, folder, tmp_path, got) == ["last of nine, no end", "ten 1", "", "ten 3 é😀"]
    (folder / "binlog.000011").write_text("")
    assert read_on(spark, folder, tmp_path, got) == []
    (folder / "binlog.000011").write_text("z" * 500 + "\n")
    assert read_on(spark, folder, tmp_path, got) == ["z" * 500]
    ends = {}
    for number, position, after, _ in got:  # each line begins where the one before ended
        assert position == ends.get(number, 0)
        ends[number] = after


def test_positions_go_by_number(spark):
    rows = [("d", f"log.{n}", p) for n, p in ((9, 500), (10, 4), (2, 900))] + [("e", "x.000001", 7)]
    got = cdc.positions(spark.createDataFrame(rows, "database string, next_file string, next_position long"))
    assert {tuple(r) for r in got.collect()} == {("d", "log.10", 4), ("e", "x.000001", 7)}


LOG = [
    ("begin",), ("table", 1, "posts", ["id", "t"]), ("row", 1, "a"), ("row", 2, "lost"), ("commit",), ("row", 1, "alone"), ("begin",), ("row", 1, "b"), ("table", 2, "meta", ["k"]), ("row", 2, "m"),
    ("table", 1, "posts", ["id", "t", "u"]), ("row", 1, "c"), ("commit",), ("begin",), ("row", 1, "undone"), ("rollback",), ("begin",), ("commit",), ("begin",), ("row", 2, "n"), ("commit",),
]


def events(log):
    out = []
    for k, e in enumerate(LOG):
        out.append((log, 9 + k // 8, 100 * (k % 8), e[0], e[1] if len(e) > 1 else None, e[2] if e[0] == "table" else None, e[3] if e[0] == "table" else None, json.dumps({"v": e[2]}) if e[0] == "row" else None))
    return out


def plain(log):
    from types import SimpleNamespace

    names, now, tables, waiting = [x.split()[0] for x in EVENTS.split(", ")], Brackets(), {}, []
    return [r for e in events(log) for r in step(log, now, tables, waiting, SimpleNamespace(**dict(zip(names, e))))]


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_rows_of_a_plain_run():
    got = [(r[1], r[2], r[5], r[6], json.loads(r[8])["v"], r[9]) for r in plain("x")]
    lost = "table 2 was not announced"
    assert got == [(0, 0, "posts", 1, "a", None), (0, 1, None, None, "lost", lost), (1, 0, "posts", 1, "alone", None), (2, 0, "posts", 1, "b", None), (2, 1, "meta", 1, "m", None), (2, 2, "posts", 2, "c", None), (3, 0, "meta", 1, "n", None)]


def test_a_stream_cut_at_every_place_equals_one_batch(rocks, tmp_path):
    """Log k is cut after its k-th event, and what it had last is sent once more; all logs go in two batches of one stream."""
    spark, folder = rocks, tmp_path / "in"
    logs = [f"cut{k}" for k in range(len(LOG) + 1)]
    parts = [[e for k, log in enumerate(logs) for e in events(log)[:k]], [e for k, log in enumerate(logs) for e in events(log)[max(0, k - 1) :]]]
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").json(str(folder))
        stream = spark.readStream.schema(EVENTS).json(str(folder))
        committed(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=lambda r: (r[0], r[1], r[2]))
    want = sorted((r for log in logs for r in plain(log)), key=lambda r: (r[0], r[1], r[2]))
    assert [tuple(list(x) if isinstance(x, list) else x for x in r) for r in got] == want


def test_a_log_without_tables_or_waiting_rows_reads_neither():
    from pyspark.sql import Row

    from palimpsest.streaming.txn import Transactions

    class State:
        said = None
        get = lambda self: self.said
        exists = lambda self: self.said is not None

        def update(self, value):
            self.said = value

    logs = Transactions()
    logs.now, logs.tables, logs.waiting = State(), None, None  # a call of either would fail
    event = lambda position: Row(log="a", number=1, position=position, kind="row", table_id=1, name=None, columns=None, row=str(position))
    assert [r.row for r in logs.handleInputRows(("a",), iter([event(2), event(1)]), None)] == ["1", "2"]
    assert [r.row for r in logs.handleInputRows(("a",), iter([event(2), event(3)]), None)] == ["3"]
