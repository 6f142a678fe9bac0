"""Ordered trees: roots that only the rows decide, commits, look-ups, ranges and diffs against plain dicts."""

from __future__ import annotations

import random

import pytest

from palimpsest.operators import ordered as O

SCHEMA = "k long, s string, v long"


def frame(spark, rows):
    return spark.createDataFrame([(k, s, v) for (k, s), v in rows.items()], SCHEMA)


def shown(df):
    return {(r.k, r.s): r.v for r in df.collect()}


@pytest.mark.parametrize("seed", [1])
def test_roots_are_of_the_rows_whatever_their_history(spark, seed):
    rng = random.Random(seed)
    rows = {(rng.choice([None, *range(40)]), rng.choice(["a", "b", None])): rng.choice([None, 1, 2]) for _ in range(110)}
    tree, versions = O.build(frame(spark, rows), ("k", "s"), 2), []
    assert shown(tree.read()) == rows
    starts = [r for r in tree.nodes().filter("level = 0").collect()]
    assert len(starts) > 10 and sum(r.n for r in starts) == len(rows)
    for turn in range(2):
        first = [r.start for r in tree.nodes().filter("level = 0 and start is not null").collect()]
        gone = [(r.k, r.s) for r in rng.sample(first, 2)] + rng.sample(sorted(rows, key=str), 5) if turn else rng.sample(sorted(rows, key=str), 3)
        put = {(rng.randrange(60), "c"): turn for _ in range(4)} | {k: 9 + turn for k in rng.sample(sorted(rows, key=str), 4) if k not in gone}
        put = {k: v for k, v in put.items() if k not in gone}
        versions.append((tree, dict(rows)))
        rows = {k: v for k, v in rows.items() if k not in gone} | put
        tree = tree.commit(frame(spark, put), spark.createDataFrame(gone, "k long, s string"))
        assert shown(tree.read()) == rows
    assert tree.root == O.build(frame(spark, dict(sorted(rows.items(), key=str))), ("k", "s"), 2).root != versions[-1][0].root
    old, before = versions[0]
    got = {(r.k, r.s): (r.a and (r.a.v,), r.b and (r.b.v,)) for r in old.diff(tree).collect()}
    assert got == {k: ((before[k],) if k in before else None, (rows[k],) if k in rows else None) for k in before.keys() | rows.keys() if (k in before, before.get(k)) != (k in rows, rows.get(k))}


def test_lookups_ranges_and_order(spark):
    rows = {(k, "x"): k for k in range(0, 200, 2)} | {(None, "n"): -1}
    tree = O.build(frame(spark, rows), ("k", "s"), 3)
    assert shown(tree.get(50, "x")) == {(50, "x"): 50} and tree.get(51, "x").count() == 0 and shown(tree.get(None, "n")) == {(None, "n"): -1}
    assert shown(tree.range((33, "a"), (60, "x"))) == {(k, "x"): k for k in range(34, 62, 2)}
    assert shown(tree.range(high=(4, "a"))) == {(None, "n"): -1, (0, "x"): 0, (2, "x"): 2} and tree.range((190, "z")).count() == 4
    assert [r.v for r in tree.in_order().collect()] == [-1, *range(0, 200, 2)]
    plan = tree.range((33, "a"), (60, "x"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,33)" in plan and "LessThanOrEqual(k,60)" in plan


def test_one_row_changes_few_nodes_and_equal_keys_are_one(spark):
    df = spark.range(2000).selectExpr("id * 2 as k", "'x' as s", "id as v")
    tree = O.build(df, ("k", "s"), 4)
    then = tree.commit(spark.createDataFrame([(2001, "x", 1), (2001, "x", 7), (2001, "x", 3)], SCHEMA))
    nodes = lambda t: {(r.level, str(r.start), r.digest) for r in t.nodes().collect()}
    height = max(r.level for r in tree.nodes().select("level").collect())
    assert height >= 2 and len(nodes(then) - nodes(tree)) <= 2 * (height + 1) and len(nodes(tree)) > 100
    assert shown(then.get(2001, "x")) == {(2001, "x"): 7} and [(r.k, r.a) for r in tree.diff(then).collect()] == [(2001, None)]
    back = then.commit(gone=spark.createDataFrame([(2001, "x")], "k long, s string"))
    assert back.root == tree.root and len({r.location for r in then.nodes().filter("level = 0").collect()}) == 2
    assert back.compact().root == tree.root


def test_empty_tables(spark):
    none = O.build(spark.createDataFrame([], SCHEMA), ("k", "s"), 2)
    one = none.commit(spark.createDataFrame([(1, "a", 5)], SCHEMA))
    assert none.read().count() == 0 and none.get(1, "a").count() == 0 and shown(one.read()) == {(1, "a"): 5}
    assert [(r.k, r.b.v) for r in none.diff(one).collect()] == [(1, 5)] and one.commit(gone=spark.createDataFrame([(1, "a")], "k long, s string")).root == none.root
