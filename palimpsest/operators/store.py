"""Tables that outlive their session: copy-on-write tables kept in a folder, several of them and named references in one store.

A store is a folder of numbered manifests and of the row folders that they name. A manifest says all there is to know of
a version: each table's base, keys and schema, its net change so far, and the references. A version is published by
making the next number's file; that is the only step that readers see, so several tables and references move together
or not at all, and of two writers at one version the second is refused, unless they touched nothing in common: then its
changes go on top of the other's.

A statement writes what it did when it is made: for each row it met, keys, old row and new row. So rand(),
current_timestamp() and sources that change later have the values of that moment, for every reader and every session;
the journal is these folders, and nothing is evaluated again. Reading lays the last change of each key over the base: one
scan of the base, one of the changes, whatever the number of statements. After FOLD statements a table's changes are
folded into one row a key, so a read opens a bounded number of folders. Bases are never rewritten, only compacted to new ones.

Defined results: as in overlay.py; a statement in a transaction sees those before it; an abandoned or refused
transaction leaves no row folders, and those of a writer that died go with vacuum(); times never run backwards from one
version to the next, whatever the writers' clocks say.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.overlay import meets, true, without_keys
from palimpsest.operators.pointers import NumberedFiles
from palimpsest.session import numbered

#: Folders of changes that a read opens at most, besides the folded ones.
FOLD = 16
_MANIFEST = "version long, at string, message string, changes array<struct<table string, seq long, op string, rows string>>"


class Conflict(Exception):
    """Another writer published first, and touched what this one did."""


@dataclass(frozen=True)
class Table:
    """What a manifest says of one table."""

    base: str | None
    keys: tuple[str, ...]
    schema: str
    #: The folded changes, and the folders of changes since.
    net: str | None = None
    runs: tuple[str, ...] = ()
    #: The least key given to a new row so far, zero at first; the statement up to which the table was marked clean.
    least_key: int = 0
    clean: int = 0

    @property
    def kind(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


@dataclass(frozen=True)
class State:
    """One version of a store."""

    version: int = 0
    #: The greatest number of a statement; numbers grow within a table, and writers that don't meet may give one number to statements of different tables.
    seq: int = 0
    at: str = "1970-01-01T00:00:00.000000Z"
    tables: dict[str, Table] = field(default_factory=dict)
    refs: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, text: str | None) -> State:
        if text is None:
            return cls()
        said = json.loads(text)
        tables = {n: Table(**{k: tuple(v) if isinstance(v, list) else v for k, v in t.items()}) for n, t in said["tables"].items()}
        return cls(said["version"], said["seq"], said["at"], tables, said["refs"])


def _after(before: str) -> str:
    """This moment, or a microsecond after the time before where this machine's clock is behind."""
    form = "%Y-%m-%dT%H:%M:%S.%fZ"
    last = datetime.strptime(before, form).replace(tzinfo=timezone.utc)
    return max(datetime.now(timezone.utc), last + timedelta(microseconds=1)).strftime(form)


class Store:
    """A store at one version; versions are read again by number, and never change."""

    def __init__(self, spark: SparkSession, path: str, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = NumberedFiles(spark, f"{self.path}/log")
        number = self.log.latest() if version is None else version
        text = self.log.read(number)
        if number and text is None:
            raise ValueError(f"no version {number}")
        self.state = State.of(text)

    @property
    def version(self) -> int:
        return self.state.version

    def table(self, name: str) -> DataFrame:
        """The rows of a table as this version has them."""
        return _rows(self.spark, self.state.tables[name])

    def ref(self, name: str) -> str | None:
        return self.state.refs.get(name)

    def begin(self) -> Transaction:
        return Transaction(self)

    def journal(self, name: str, since: int | datetime = 1, until: int | None = None) -> DataFrame:
        """(seq, op, at, keys, old, new) of a table's statements from a number or a time on, rows as structs; a truncation's rows are removals (D)."""
        log = self.spark.read.schema(_MANIFEST).json(f"{self.log.folder}/*").filter(F.col("version") <= self.version) if self.version else self.spark.createDataFrame([], _MANIFEST)
        told = log.select("version", "at", F.explode("changes").alias("c")).filter(F.col("c.table") == name).select("version", "at", "c.seq", "c.op", "c.rows")
        if isinstance(since, datetime):
            told = told.filter(F.to_timestamp("at") >= F.lit(since))
        else:
            told = told.filter(F.col("seq") >= since)
        told = (told if until is None else told.filter(F.col("seq") <= until)).orderBy("seq").collect()  # a row a statement
        table = self.state.tables[name]
        out = self.spark.createDataFrame([], _change_schema(table)).withColumn("at", F.lit(None).cast("timestamp"))
        if folders := [r.rows for r in told if r.op in "IUD"]:
            when = self.spark.createDataFrame([(r.seq, r.at) for r in told], "_seq long, at string")
            rows = self.spark.read.schema(_change_schema(table)).parquet(*folders)
            out = rows.join(F.broadcast(when), "_seq").select(*rows.columns, F.to_timestamp("at").alias("at"))
        for r in told:
            if r.op == "T":
                whole = F.struct(*[F.col(f"`{c}`") for c in table.kind.names])
                gone = Store(self.spark, self.path, r.version - 1).table(name)
                gone = gone.select(*table.keys, F.lit(r.seq).alias("_seq"), F.lit("D").alias("_op"), whole.alias("_old"), F.lit(None).cast(table.kind).alias("_new"), F.to_timestamp(F.lit(r.at)).alias("at"))
                out = out.unionByName(gone)
        return out.select(F.col("_seq").alias("seq"), F.col("_op").alias("op"), "at", *table.keys, F.col("_old").alias("old"), F.col("_new").alias("new"))

    def dirty(self, name: str, since: int | None = None) -> DataFrame:
        """(keys, op): the keys written since a statement, or since the table was marked clean, each with its last op."""
        first = self.state.tables[name].clean + 1 if since is None else since
        return self.journal(name, first).groupBy(*self.state.tables[name].keys).agg(F.max_by("op", "seq").alias("op"))

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what no version needs that is among the newest `keep`, nor the journal, and gives how many row folders went."""
        used: set[str] = set()
        for number in range(1, self.log.latest() + 1):
            text = self.log.read(number)
            if text is None:
                continue
            said = json.loads(text)
            used |= {c["rows"] for c in said["changes"] if c["rows"]}
            if number > self.log.latest() - keep:
                used |= {p for t in said["tables"].values() for p in (t["base"], t["net"], *t["runs"]) if p}
        where, gone = self.log.where(f"{self.path}/rows"), 0
        for f in self.log.fs.listStatus(where) if self.log.fs.exists(where) else []:
            if (name := f"{self.path}/rows/{f.getPath().getName()}") not in used:
                self.log.remove(name)
                gone += 1
        return gone


class Transaction:
    """Statements that become one version, or nothing."""

    def __init__(self, store: Store):
        self.store, self.spark, self.state = store, store.spark, store.state
        self.changes: list[dict] = []
        self.touched: set[str] = set()
        self.moved: dict[str, tuple[str | None, str | None]] = {}
        self.made: list[str] = []

    # What can be done

    def create_table(self, name: str, rows: DataFrame, keys: tuple[str, ...]) -> None:
        """A table whose base is a copy of the rows; base_at() takes a folder as it is."""
        if name in self.state.tables:
            raise ValueError(f"there is a table {name}")
        self._put(name, Table(self._write(rows), tuple(keys), rows.schema.json()))

    def base_at(self, name: str, path: str, keys: tuple[str, ...]) -> None:
        """A table over Parquet files that are there and will not change; they are not read now."""
        if name in self.state.tables:
            raise ValueError(f"there is a table {name}")
        self._put(name, Table(path, tuple(keys), self.spark.read.parquet(path).schema.json()))

    def table(self, name: str) -> DataFrame:
        return _rows(self.spark, self.state.tables[name])

    def insert(self, name: str, rows: DataFrame, order: Column | None = None) -> None:
        """Whole rows; one that meets a key replaces what is there. Of equal keys the last by `order` counts, or else the greatest row."""
        table = self.state.tables[name]
        whole = F.struct(*[F.col(f"`{c}`") for c in table.kind.names])
        one = rows.groupBy(*table.keys).agg((F.max(whole) if order is None else F.max_by(whole, order)).alias("_new"))
        old = self.table(name).select(whole.alias("_old"), *table.keys)
        both = one.alias("n").join(old.alias("o"), meets("n", "o", table.keys), "left")
        self._change(name, "I", both.select(*[F.col(f"n.`{k}`") for k in table.keys], "_old", "_new"))

    def insert_new(self, name: str, rows: DataFrame) -> None:
        """Rows without a key get keys below zero, below all that were given before, in this session or another."""
        table = self.state.tables[name]
        (key,), least = table.keys, table.least_key
        if not least:
            least = min(0, self.table(name).agg(F.min(key)).first()[0] or 0)
        new = numbered(rows.select(*[c for c in table.kind.names if c != key]), "_n")
        whole = [(F.lit(least) - F.col("_n") - 1).cast(table.kind[key].dataType).alias(c) if c == key else F.col(f"`{c}`") for c in table.kind.names]
        made = new.select(F.struct(*whole).alias("_new"))
        self._change(name, "I", made.select(F.col(f"_new.`{key}`").alias(key), F.lit(None).cast(table.kind).alias("_old"), "_new"))
        self._put(name, replace(self.state.tables[name], least_key=int(least) - new.count()))

    def update(self, name: str, where: Column, sets: dict[str, Column]) -> None:
        table = self.state.tables[name]
        if wrong := [c for c in sets if c in table.keys or c not in table.kind.names]:
            raise ValueError(f"can't set {wrong}")
        new = [sets[c].cast(table.kind[c].dataType).alias(c) if c in sets else F.col(f"`{c}`") for c in table.kind.names]
        self._change(name, "U", self._met(name, where, F.struct(*new)))

    def delete(self, name: str, where: Column) -> None:
        self._change(name, "D", self._met(name, where, F.lit(None).cast(self.state.tables[name].kind)))

    def truncate(self, name: str) -> None:
        """One mark, whatever the table's size; the journal finds the rows in the version before."""
        if any(c["table"] == name for c in self.changes):
            self.delete(name, F.lit(True))  # the version before lacks what this transaction did
            return
        table = self.state.tables[name]
        self.state = replace(self.state, seq=self.state.seq + 1)
        self.changes.append({"table": name, "seq": self.state.seq, "op": "T", "rows": None})
        self._put(name, replace(table, base=None, net=None, runs=()))

    def compact(self, name: str) -> None:
        """The merged rows as a new base; no row changes."""
        self._put(name, replace(self.state.tables[name], base=self._write(self.table(name)), net=None, runs=()))

    def mark_clean(self, name: str) -> None:
        self._put(name, replace(self.state.tables[name], clean=self.state.seq))

    def set_ref(self, name: str, old: str | None, new: str | None) -> None:
        """A reference that must be old now and when the transaction is committed; a null new takes it away."""
        if self.state.refs.get(name) != old:
            raise Conflict(f"{name} is {self.state.refs.get(name)}, not {old}")
        first = self.moved[name][0] if name in self.moved else old
        self.moved[name] = (first, new)
        refs = {k: v for k, v in self.state.refs.items() if k != name}
        self.state = replace(self.state, refs=refs if new is None else refs | {name: new})

    # How it ends

    def commit(self, message: str = "") -> Store:
        """The store with all of it; Conflict where another writer touched the same tables or references first."""
        try:
            while True:
                state = replace(self.state, version=self.state.version + 1, at=_after(self.state.at))
                if self.store.log.publish(state.version, json.dumps(asdict(state) | {"message": message, "changes": self.changes})):
                    return Store(self.spark, self.store.path, state.version)
                self._follow()
        except Exception:
            self.rollback()
            raise

    def rollback(self) -> None:
        for folder in self.made:
            self.store.log.remove(folder)
        self.made = []

    def _follow(self) -> None:
        """On top of what was published meanwhile, if that touched nothing of this."""
        other = Store(self.spark, self.store.path)
        before, now = self.store.state, other.state
        if now.version <= self.state.version:
            raise Conflict("another writer is at it")
        if both := sorted(n for n in self.touched if before.tables.get(n) != now.tables.get(n)):
            raise Conflict(f"tables {both} were changed by another writer")
        if both := sorted(n for n, (old, _) in self.moved.items() if now.refs.get(n) != old):
            raise Conflict(f"references {both} were moved by another writer")
        refs = {k: v for k, v in now.refs.items() if k not in self.moved} | {k: v for k, (_, v) in self.moved.items() if v is not None}
        tables = now.tables | {n: self.state.tables[n] for n in self.touched}
        self.state = State(now.version, max(now.seq, self.state.seq), now.at, tables, refs)

    # What it is made of

    def _put(self, name: str, table: Table) -> None:
        self.touched.add(name)
        self.state = replace(self.state, tables=self.state.tables | {name: table})

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.store.path}/rows/{uuid.uuid4().hex}"
        self.made.append(folder)
        rows.write.parquet(folder)
        return folder

    def _met(self, name: str, where: Column, new: Column) -> DataFrame:
        table = self.state.tables[name]
        whole = F.struct(*[F.col(f"`{c}`") for c in table.kind.names])
        return self.table(name).filter(true(where)).select(*table.keys, whole.alias("_old"), new.alias("_new"))

    def _change(self, name: str, op: str, rows: DataFrame) -> None:
        """A statement's rows (keys, _old, _new) are written now."""
        seq, table = self.state.seq + 1, self.state.tables[name]
        folder = self._write(rows.select(*table.keys, F.lit(seq).cast("long").alias("_seq"), F.lit(op).alias("_op"), "_old", F.col("_new").cast(table.kind).alias("_new")))
        self.state = replace(self.state, seq=seq)
        self.changes.append({"table": name, "seq": seq, "op": op, "rows": folder})
        table = replace(table, runs=(*table.runs, folder))
        if len(table.runs) >= FOLD:
            table = replace(table, net=self._write(_net(self.spark, table)), runs=())
        self._put(name, table)


def _change_schema(table: Table) -> T.StructType:
    keys = [table.kind[k] for k in table.keys]
    return T.StructType([*keys, T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType()), T.StructField("_old", table.kind), T.StructField("_new", table.kind)])


def _net(spark: SparkSession, table: Table) -> DataFrame:
    """(keys, _seq, _new): the last change of each key; a null _new is a row that is gone."""
    schema = T.StructType([f for f in _change_schema(table) if f.name not in ("_op", "_old")])
    folders = [*([table.net] if table.net else []), *table.runs]
    rows = spark.read.schema(schema).parquet(*folders)
    if len(folders) == 1:  # one row a key already
        return rows
    last = rows.groupBy(*table.keys).agg(F.max_by(F.struct("_seq", "_new"), "_seq").alias("_last"))
    return last.select(*table.keys, "_last._seq", "_last._new")


def _rows(spark: SparkSession, table: Table) -> DataFrame:
    kind = table.kind
    base = spark.createDataFrame([], kind) if table.base is None else spark.read.schema(kind).parquet(table.base)
    if not table.net and not table.runs:
        return base
    net = _net(spark, table)
    return without_keys(base, net, table.keys).unionByName(net.filter("_new is not null").select("_new.*"))
