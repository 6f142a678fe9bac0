"""Differences between two states of a table, three-way merges, and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.content import buckets, row_hash


def both_sides(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Both tables as a and b, joined on their keys, null-safe; `_in` is true on the sides that have the row."""
    left, right = a.withColumn("_in", F.lit(True)).alias("a"), b.withColumn("_in", F.lit(True)).alias("b")
    return left.join(right, reduce(lambda x, y: x & y, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)), how)


def diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, changed): added, removed or changed rows from a to b, and the names of the columns that differ."""
    others = [c for c in a.columns if c not in keys and c in b.columns]
    differs = [F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in others]
    kind = F.when(F.col("a._in").isNull(), "added").when(F.col("b._in").isNull(), "removed").otherwise("changed")
    changed = F.when(kind == "changed", F.array_compact(F.array(*differs))).otherwise(F.array().cast("array<string>"))
    out = both_sides(a, b, keys, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], kind.alias("kind"), changed.alias("changed"))
    return out.filter((F.col("kind") != "changed") | (F.size("changed") > 0))


def change_counts(before: dict[str, DataFrame], after: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(table, kind, n) over two states of a whole database; a table that one of them lacks is empty there."""
    parts = []
    for name in sorted(before.keys() | after.keys()):
        some = before.get(name, after.get(name)).limit(0)
        counts = diff(before.get(name, some), after.get(name, some), keys[name]).groupBy("kind").agg(F.count("*").alias("n"))
        parts.append(counts.select(F.lit(name).alias("table"), "kind", "n"))
    return reduce(DataFrame.unionByName, parts)


def diff_by_buckets(a: DataFrame, b: DataFrame, keys: list[str], n: int = 64) -> DataFrame:
    """diff(), but rows are compared only in buckets whose digests differ."""
    marked = [t.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(n))) for t in (a, b)]
    roots = [buckets(t, keys, "_bucket") for t in marked]
    unequal = roots[0].toDF("_bucket", "x", "n").join(roots[1].toDF("_bucket", "y", "m"), "_bucket", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select("_bucket")
    return diff(*[t.join(F.broadcast(unequal), "_bucket", "left_semi").drop("_bucket") for t in marked], keys)  # n rows at most


def three_way(base: DataFrame, source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, decision): noop, apply, keep or conflict for every key of any of the three states; absent differs from all."""
    columns = [c for c in base.columns if c not in keys]
    sides = []
    for n, t in enumerate((base, source, target)):
        sides.append(t.select(*keys, F.lit(n).alias("side"), row_hash(columns, t.schema).alias("hash")))
    got = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy(*keys).agg(*[F.max(F.when(F.col("side") == n, F.col("hash"))).alias(name) for n, name in enumerate("bst")])
    equal = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    decision = F.when(equal("s", "t"), "noop").when(equal("b", "t"), "apply").when(equal("b", "s"), "keep").otherwise("conflict")
    return got.select(*keys, decision.alias("decision"))


def merged(base: DataFrame, source: DataFrame, target: DataFrame, keys: list[str], strategy: str = "abort") -> DataFrame:
    """The target after the merge: conflicts go to 'theirs' (the source) or stay with 'ours'; 'abort' raises if there are any."""
    plan = three_way(base, source, target, keys)
    if strategy == "abort":
        if some := plan.filter("decision = 'conflict'").limit(20).collect():
            raise ValueError(f"conflicts on {[tuple(r[k] for k in keys) for r in some]}")
    taken = plan.filter(F.col("decision").isin("apply", *(["conflict"] if strategy == "theirs" else []))).select(*keys)
    on = lambda t: reduce(lambda x, y: x & y, (t[k].eqNullSafe(taken[k]) for k in keys))
    return target.join(taken, on(target), "left_anti").unionByName(source.join(taken, on(source), "left_semi"))


def reconcile(source: DataFrame, target: DataFrame, keys: list[str], protected: Column | None = None) -> DataFrame:
    """(keys, action): what makes target equal to source; protected rows of the target are never deleted."""
    others = [c for c in target.columns if c not in keys and c in source.columns]
    equal = reduce(lambda x, y: x & y, (F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in others), F.lit(True))
    left = target if protected is None else target.withColumn("_held", F.coalesce(protected, F.lit(False)))
    action = F.when(F.col("b._in").isNull(), "insert").when(F.col("a._in").isNull(), "delete").when(~equal, "update")
    rows = both_sides(source, left, keys, "full_outer").withColumn("action", action)
    if protected is not None:
        rows = rows.filter((F.col("action") != "delete") | ~F.col("b._held"))
    return rows.filter("action is not null").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], "action")


def applied(source: DataFrame, target: DataFrame, keys: list[str], protected: Column | None = None) -> DataFrame:
    """The target made equal to the source, as reconcile() says: protected rows stay where the source has none of their key. Other columns than the source's are refused."""
    if schema_changes(source, target):
        raise ValueError("the tables' columns differ; reconcile them first")
    rows = source.select(target.columns)
    if protected is None:
        return rows
    held = target.filter(F.coalesce(protected, F.lit(False))).alias("a")
    meets = reduce(lambda x, y: x & y, (F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`")) for k in keys))
    return rows.unionByName(held.join(rows.select(*keys).alias("b"), meets, "left_anti"))


def schema_changes(source: DataFrame, target: DataFrame) -> list[tuple[str, str]]:
    """(column, add or drop) to give target the source's columns, names compared without case; both at once are refused."""
    have, want = {c.lower(): c for c in target.columns}, {c.lower(): c for c in source.columns}
    add = [(c, "add") for k, c in want.items() if k not in have]
    drop = [(c, "drop") for k, c in have.items() if k not in want]
    if add and drop:
        raise ValueError("columns are both added and dropped; a rename can't be told from that")
    return add + drop


def with_schema_of(target: DataFrame, source: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in source.schema.fields}
    for name, change in schema_changes(source, target):
        target = target.withColumn(name, F.lit(None).cast(kinds[name])) if change == "add" else target.drop(name)
    return target
