"""Copy-on-write tables: a base that is never changed, and the statements written over it.

A statement (insert, update, delete, truncate) is kept as what it says, not as the rows it meets: nothing runs when a
table is opened or written to. A read lays the statements over the base as projections, filters and, for inserted rows,
one anti join by key, so that filters, joins, limits and aggregates written over read() see the merged rows, and a merged
read is one scan of the base with its column pruning and, for predicates on columns that no statement sets, its filter
pushdown. Where more than a few updates follow each other, every INLINED-th is a wall for such filters, so that the plan
grows with the statements and not with their product; stored() gives the pushdown back. The journal of old and new rows is worked out when it is read. stored() writes the net change (changed rows and
tombstones, never the base) and gives a table over it that has no statements.

A log of operations that comes from elsewhere, rows of (seq, op, changed, all columns of the table) with op I (a whole
row), U (a patch of the columns named in `changed`; a patch may set NULL) or D, is folded to one net change a key by
fold() and laid over a base by apply_net().

Defined results: a predicate that is null meets no row; a statement sees what the statements before it left; rows of one
key in one insert count as one, the greatest by the other columns in order; a null key is a key like any other.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.session import numbered, written

#: Updates in a row that a filter written over them may be pushed through: each copies the expressions of the one before.
INLINED = 3


def meets(a: str, b: str, keys: list[str] | tuple[str, ...]) -> Column:
    """Null-safe equality of all key columns of two aliases."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys))


def without_keys(rows: DataFrame, others: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    return rows.alias("a").join(others.select(*keys).alias("b"), meets("a", "b", keys), "left_anti")


def fold(ops: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One net change a key, in one aggregation: (keys, last whole-row op or null, a struct for each patched column or null)."""
    others = [c for c in columns if c not in keys]
    whole = F.when(F.col("op").isin("I", "D"), F.col("seq"))
    patch = []
    for c in others:
        named = F.array_contains("changed", c)
        patch.append(F.max_by(F.when(named, F.struct("seq", c)), F.when(named, F.col("seq"))).alias(f"_{c}"))
    net = ops.groupBy(*keys).agg(F.max(whole).alias("_at"), F.max_by("op", whole).alias("_op"), *patch)
    since = lambda c: F.when(F.col("_at").isNull() | (F.col(f"_{c}.seq") >= F.col("_at")), F.struct(F.col(f"_{c}.`{c}`").alias(c)))
    return net.select(*keys, "_op", *[F.when(F.col(f"_{c}").isNotNull(), since(c)).alias(f"_{c}") for c in others])


def apply_net(base: DataFrame, net: DataFrame, keys: list[str]) -> DataFrame:
    """base under the net changes: rows that no change touches, as they are, patched rows, and new or replaced rows.

    The first part, nearly all of a large base, is a plain scan and an anti join, so filters on any column reach the scan.
    net is read three times: pass a stored table where it is dear to make.
    """
    others = [c for c in base.columns if c not in keys]
    untouched = without_keys(base, net, keys)
    both = base.alias("b").join(net.filter("_op is null").alias("n"), meets("b", "n", keys))
    patched = both.select(*[F.col(f"b.{c}") if c in keys else F.when(F.col(f"n._{c}").isNotNull(), F.col(f"n._{c}")[c]).otherwise(F.col(f"b.{c}")).alias(c) for c in base.columns])
    new = net.filter("_op = 'I'").select(*keys, *[F.col(f"_{c}")[c].alias(c) for c in others])
    return untouched.unionByName(patched).unionByName(new)


@dataclass(frozen=True)
class Statement:
    seq: int
    op: str  # I, U, D or T (truncate)
    at: datetime
    where: Column | None = None
    sets: tuple[tuple[str, Column], ...] = ()
    rows: DataFrame | None = None


@dataclass(frozen=True)
class VersionedTable:
    """base with keys, and the statements so far; every write gives a new table and leaves the old one as it was."""

    base: DataFrame
    keys: tuple[str, ...]
    statements: tuple[Statement, ...] = ()

    @property
    def seq(self) -> int:
        return self.statements[-1].seq if self.statements else 0

    def read(self) -> DataFrame:
        return self.as_of(self.seq)

    def as_of(self, seq: int) -> DataFrame:
        """The rows as the statement of that number left them."""
        rows, sets = self.base, 0
        for s in self.statements:
            if s.seq > seq:
                break
            if s.op == "U":
                sets += 1
                rows = _apply(rows, self._set(s), sets % INLINED == 0)
            elif s.op == "I":
                rows = without_keys(rows, s.rows, self.keys).unionByName(s.rows)
            else:
                rows = rows.filter(~true(s.where))
        return rows

    def _set(self, s: Statement) -> dict[str, Column]:
        kinds = {f.name: f.dataType for f in self.base.schema.fields}
        return {c: F.when(true(s.where), value.cast(kinds[c])).otherwise(F.col(c)) for c, value in s.sets}

    def _next(self, op: str, **said) -> VersionedTable:
        return replace(self, statements=(*self.statements, Statement(self.seq + 1, op, datetime.now(timezone.utc), **said)))

    def insert(self, rows: DataFrame) -> VersionedTable:
        """Whole rows; one that meets a key replaces what is there (REPLACE and upsert are the same)."""
        others = [c for c in self.base.columns if c not in self.keys]
        one = rows.groupBy(*self.keys).agg(F.max(F.struct(*others)).alias("_row")) if others else rows.select(*self.keys).distinct()
        return self._next("I", rows=one.select(*[F.col(c) if c in self.keys or not others else F.col(f"_row.`{c}`").alias(c) for c in self.base.columns]))

    def insert_new(self, rows: DataFrame) -> VersionedTable:
        """Rows without a key: each gets a key below all keys there are and below zero, so that it meets none of the base's."""
        (key,) = self.keys
        least = self.read().agg(F.least(F.min(key), F.lit(0))).first()[0] or 0
        new = numbered(rows.select(*[c for c in self.base.columns if c != key]), "_n")
        return self.insert(new.withColumn(key, (F.lit(least) - F.col("_n") - 1).cast(self.base.schema[key].dataType)).select(self.base.columns))

    def update(self, where: Column, sets: dict[str, Column]) -> VersionedTable:
        """Sets columns in all rows that match, from the values before; keys can't be set."""
        if wrong := [c for c in sets if c in self.keys or c not in self.base.columns]:
            raise ValueError(f"can't set {wrong}")
        return self._next("U", where=where, sets=tuple(sets.items()))

    def delete(self, where: Column) -> VersionedTable:
        return self._next("D", where=where)

    def truncate(self) -> VersionedTable:
        """One mark, whatever the table's size."""
        return self._next("T", where=F.lit(True))

    def changes(self, seq: int) -> DataFrame:
        """What one statement did: seq, op, at, keys, old_row, new_row (JSON); a truncation removes rows (D)."""
        s = next(s for s in self.statements if s.seq == seq)
        before, image = self.as_of(seq - 1), F.to_json(F.struct(*self.base.columns))
        if s.op == "I":
            old = before.withColumn("old_row", image).select(*self.keys, "old_row").alias("o")
            rows = s.rows.withColumn("new_row", image).alias("r").join(old, meets("r", "o", self.keys), "left").select(*[F.col(f"r.`{k}`") for k in self.keys], "old_row", "new_row")
        else:
            rows = before.filter(true(s.where)).withColumn("old_row", image)
            rows = rows.withColumns(self._set(s)).withColumn("new_row", image) if s.op == "U" else rows.withColumn("new_row", F.lit(None).cast("string"))
        return rows.select(F.lit(s.seq).cast("long").alias("seq"), F.lit("D" if s.op == "T" else s.op).alias("op"), F.lit(s.at).alias("at"), *self.keys, "old_row", "new_row")

    def changes_since(self, since: int | datetime) -> DataFrame:
        """The journal from that statement, or that time, on, in the order of the statements."""
        some = [s.seq for s in self.statements if (s.at >= since if isinstance(since, datetime) else s.seq >= since)]
        if not some:
            return VersionedTable(self.base.filter(F.lit(False)), self.keys).truncate().changes(1)
        return reduce(DataFrame.unionByName, (self.changes(n) for n in some)).orderBy("seq")

    def dirty(self, since: int = 1) -> DataFrame:
        """The keys written since, each with its last op; a table fresh from stored() or compact() has none."""
        return self.changes_since(since).groupBy(*self.keys).agg(F.max_by("op", "seq").alias("op"))

    def net(self) -> DataFrame:
        """The base's columns and `_gone`: rows that the statements changed or made, and tombstones; the base is read once."""
        rows, sets = self.base.withColumns({"_touched": F.lit(False), "_gone": F.lit(False)}), 0
        for s in self.statements:
            if s.op == "I":
                rows = without_keys(rows, s.rows, self.keys).unionByName(s.rows.withColumns({"_touched": F.lit(True), "_gone": F.lit(False)}))
                continue
            sets += 1
            met = true(s.where) & ~F.col("_gone")
            mark = {"_touched": F.lit(True) if s.op == "T" else F.col("_touched") | met}
            if s.op == "U":
                mark |= {c: F.when(~F.col("_gone"), value).otherwise(F.col(c)) for c, value in self._set(s).items()}
            else:
                mark["_gone"] = F.col("_gone") | met
            rows = _apply(rows, mark, sets % INLINED == 0)
        return rows.filter("_touched").drop("_touched")

    def stored(self) -> VersionedTable:
        """The same table with its net change written to the shared folder, and no statements."""
        if not self.statements:
            return self
        net = written(self.net(), "overlay")
        return VersionedTable(without_keys(self.base, net, self.keys).unionByName(net.filter("not _gone").drop("_gone")), self.keys)

    def compact(self, path: str) -> VersionedTable:
        """The merged rows written to a new path, as the base of a table without writes."""
        self.read().write.parquet(path)
        return VersionedTable(self.base.sparkSession.read.schema(self.base.schema).parquet(path), self.keys)


def _apply(rows: DataFrame, sets: dict[str, Column], wall: bool) -> DataFrame:
    """rows with the columns set. Behind a wall they come out of a generator of one row, through which filters on other columns go and filters on these don't."""
    if not wall:
        return rows.withColumns(sets)
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in sets]
    return rows.select(*kept, F.inline_outer(F.array(F.struct(*[value.alias(c) for c, value in sets.items()])))).select(*[F.col(f"`{c}`") for c in rows.columns])


def true(where: Column) -> Column:
    return F.coalesce(where, F.lit(False))


def local_table(like: DataFrame, keys: tuple[str, ...]) -> VersionedTable:
    """A table that has no base: all its rows come from writes."""
    return VersionedTable(like.filter(F.lit(False)), keys)
