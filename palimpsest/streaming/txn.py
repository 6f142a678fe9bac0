"""Transactions over a stream: rows wait in keyed state for their commit, and come out together and in order.

events(log, number, position, kind, table_id, name, columns, row): a log of each `log`, in the order of (number,
position). A table event says which table a table_id stands for from now on, and its columns; a row event is a change of
the table that its table_id stands for at that moment; begin, commit and rollback bracket transactions. What a batch cuts
in two waits in the state, so where batches are cut makes no difference.

Rows out: log, txn (how many transactions of the log were committed before), place in it, number and position, table,
version (how often that table_id was announced), columns, row, gap. A row whose table_id nobody announced is a gap: it
comes out in its place with the reason. A rolled-back transaction has no rows. Row events outside of a transaction are
one of their own each. Repeated positions count once: a log may be sent again from an earlier place.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "log string, txn long, place int, number long, position long, table string, version int, columns array<string>, row string, gap string"
_NAMES = [x.split()[0] for x in OUT.split(", ")]
EVENTS = "log string, number long, position long, kind string, table_id long, name string, columns array<string>, row string"


class Brackets:
    """What is known of one log between two events."""

    def __init__(self, done: int = 0, at: tuple[int, int] = (-1, -1), inside: bool = False):
        self.done, self.at, self.inside = done, at, inside


def step(log: str, now: Brackets, tables: dict, waiting: list, event) -> Iterator[tuple]:
    """One event of a log: changes what is known and yields the rows that are out with it."""
    at = (int(event.number), int(event.position))
    if at <= now.at:
        return
    now.at = at
    if event.kind == "begin":
        now.inside = True
    elif event.kind == "table":
        version = tables[event.table_id][2] + 1 if event.table_id in tables else 1
        tables[event.table_id] = (event.name, list(event.columns), version)
    elif event.kind == "row":
        name, columns, version = tables.get(event.table_id, (None, None, None))
        gap = None if name is not None else f"table {int(event.table_id)} was not announced"
        waiting.append((*at, name, version, columns, event.row, gap))
    if event.kind == "rollback":
        waiting.clear()
        now.inside = False
    elif event.kind == "commit" or (event.kind == "row" and not now.inside):
        for place, row in enumerate(waiting):
            yield (log, now.done, place, row[0], row[1], row[2], row[3], row[4], row[5], row[6])
        now.done += bool(waiting)
        waiting.clear()
        now.inside = False


class Transactions(StatefulProcessor):
    """State of a log: where it is and how much waits, the tables announced, and the rows of the open transaction, one list entry each.

    Each call of a state is a message to Spark and back: tables and waiting rows are read only where there are some.
    Events come as rows, as a log has few of them in a batch and a frame for each log costs more than they do.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "done long, number long, position long, inside boolean, announced boolean, waits int")
        self.tables = handle.getMapState("tables", "table_id long", "name string, columns string, version int")
        self.waiting = handle.getListState("waiting", "number long, position long, name string, version int, columns string, row string, gap string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = sorted(rows, key=lambda e: (e.number, e.position))
        said = self.now.get()
        now = Brackets(said[0], (said[1], said[2]), said[3]) if said is not None else Brackets()
        tables = {k[0]: (v[0], json.loads(v[1]), v[2]) for k, v in self.tables.iterator()} if said is not None and said[4] else {}
        known = dict(tables)
        kept = said[5] if said is not None else 0
        waiting = [(r[0], r[1], r[2], r[3], None if r[4] is None else json.loads(r[4]), r[5], r[6]) for r in self.waiting.get()] if kept else []
        out, cleared = [], False
        for event in events:
            out += list(step(key[0], now, tables, waiting, event))
            cleared |= not waiting
        for k, v in tables.items():
            if known.get(k) != v:
                self.tables.updateValue((int(k),), (v[0], json.dumps(v[1]), v[2]))
        flat = [(r[0], r[1], r[2], r[3], None if r[4] is None else json.dumps(r[4]), r[5], r[6]) for r in waiting]
        if kept and not cleared:
            if flat[kept:]:
                self.waiting.appendList(flat[kept:])  # only what is new is written
        elif flat:
            self.waiting.put(flat)
        elif kept:
            self.waiting.clear()
        self.now.update((now.done, now.at[0], now.at[1], now.inside, bool(tables), len(waiting)))
        for row in out:
            yield Row(**dict(zip(_NAMES, row)))

    def close(self) -> None:
        pass


def committed(events: DataFrame) -> DataFrame:
    """OUT rows of EVENTS; a stream needs the RocksDB state store."""
    return events.groupBy("log").transformWithState(Transactions(), OUT, "Append", "None")
