"""Digests tell apart what differs: nulls that move, separators inside values, nested nulls."""

from __future__ import annotations

import random

import pytest

from palimpsest.operators import content as C
from palimpsest.operators import diff as D

SCHEMA = "k long, x long, y long, s string, a array<string>, m map<string,int>, b binary"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_bucket_digests_see_a_null_that_moves(spark):
    a = spark.createDataFrame([(1, None, 5), (2, 1, 1)], "k long, x long, y long")
    b = spark.createDataFrame([(1, 5, None), (2, 1, 1)], "k long, x long, y long")
    assert [r.k for r in D.diff_by_buckets(a, b, ["k"]).collect()] == [r.k for r in D.diff(a, b, ["k"]).collect()] == [1]


def test_row_hash_of_separators_and_nested_values(spark):
    rows = [("a\x1fV:b", "c"), ("a", "b\x1fV:c"), ("a\\_V:b", "c"), ("a\\", "\x1f"), ("a", "\\\x1f"), (None, "N"), ("N", None), (None, None), ("", "")]
    df = spark.createDataFrame(rows, "x string, y string")
    assert df.select(C.row_hash(["x", "y"]).alias("h")).distinct().count() == len(rows)
    nested = spark.createDataFrame([([None],), (["null"],), (None,), ([],), (["a", "b"],), (["a, b"],)], "a array<string>")
    assert nested.select(C.row_hash(["a"], nested.schema).alias("h")).distinct().count() == 6
    lanes = nested.select(C.row_lanes(["a"], nested.schema)[0].alias("h"))
    assert lanes.distinct().count() == 6


def test_a_change_across_a_separator_is_applied(spark):
    of = lambda x, y: spark.createDataFrame([(1, x, y)], "k long, x string, y string")
    got = D.three_way(of("a\x1fV:b", "c"), of("a", "b\x1fV:c"), of("a\x1fV:b", "c"), ["k"]).collect()
    assert [r.decision for r in got] == ["apply"]


@pytest.mark.parametrize("seed", [1])
def test_bucket_diff_equals_plain_diff_on_random_rows(spark, seed):
    rng = random.Random(seed)

    def row(k):
        value = lambda: rng.choice([None, 1, 2])
        return (k, value(), value(), rng.choice([None, "", "N", "V:"]), rng.choice([None, [], [None], ["x", None], [None, "x"]]), rng.choice([None, {"p": 1}, {"p": None}]), rng.choice([None, b"", b"\xff"]))

    before = {k: row(k) for k in range(120)}
    after = {k: (row(k) if rng.random() < 0.2 else r) for k, r in before.items() if rng.random() < 0.95}
    a, b = table(spark, list(before.values())).drop("m"), table(spark, list(after.values())).drop("m")
    assert sorted(map(str, D.diff_by_buckets(a, b, ["k"], 16).collect())) == sorted(map(str, D.diff(a, b, ["k"]).collect()))
    moved = [r for r in before.values()]
    rng.shuffle(moved)
    of = lambda rows: table(spark, rows).agg(C.set_digest(C.row_lanes(SCHEMA.replace("map<string,int>", "m").split()[::2], table(spark, rows).schema)).alias("d")).first().d
    assert of(list(before.values())) == of(moved) != of(list(after.values()))


def test_trees_of_unequal_tables_have_unequal_roots(spark):
    from palimpsest.operators import trees as T

    schema = "k long, x long, y long, m map<string,int>"
    a = T.build(spark.createDataFrame([(1, None, 5, {"p": None}), (2, 1, 1, None)], schema), ("k",), 16)
    b = T.build(spark.createDataFrame([(1, 5, None, {"p": None}), (2, 1, 1, None)], schema), ("k",), 16)
    assert a.root != b.root and len(a.changed_buckets(b)) == 1
    same = T.build(spark.createDataFrame([(2, 1, 1, None), (1, None, 5, {"p": None})], schema), ("k",), 16)
    assert a.root == same.root


def test_cycle_of_branches(spark):
    from palimpsest.operators import branches as B

    for cycle in (["b", "a"], ["b", "c", "a"]):
        rows = list(zip("abc", cycle)) + [("root", None), ("leaf", "root")]
        with pytest.raises(ValueError, match="ancestors"):
            B.chains(spark.createDataFrame(rows, "branch string, parent string")).count()


def test_dealt_out_rows_go_into_more_parts_as_they_grow(spark, monkeypatch):
    from palimpsest import session

    monkeypatch.setattr(session, "DEALT_ROWS", 100)
    out = session.dealt(spark.range(1000), "id")
    assert out.rdd.getNumPartitions() == 10 and out.distinct().count() == 1000


def test_median_by_ranges_that_narrow(spark, monkeypatch):
    from statistics import median

    from palimpsest import session

    monkeypatch.setattr(session, "RANGE_BITS", 5)
    rng = random.Random(3)
    for values in ([5], [-3, 4], [7, 7, 7, 9], [-(2**63), 2**63 - 1, 0, None], [rng.randrange(-5000, 5000) for _ in range(400)], [rng.choice([1, 1000]) for _ in range(301)]):
        assert session.median(spark.createDataFrame([(v,) for v in values], "k long"), "k") == median(v for v in values if v is not None)
    assert session.median(spark.createDataFrame([(None,)], "k int"), "k") is None
