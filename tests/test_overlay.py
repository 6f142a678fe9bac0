"""Copy-on-write tables: random logs against a plain model, and the quirks that must not come back."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.overlay import VersionedTable, apply_net, fold, local_table


@pytest.fixture
def base(spark):
    return spark.createDataFrame([(k, f"a{k}", k * 10) for k in range(8)], "k long, a string, c long")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_log_equals_a_dict(spark, base, seed):
    rng, model, log = random.Random(seed), {k: [f"a{k}", k * 10] for k in range(8)}, []
    for seq in range(1, 120):
        k, op = rng.randrange(14), rng.choice("IUUD")
        a, c = rng.choice([None, f"n{seq}"]), rng.choice([None, seq])
        changed = ["a", "c"] if op == "I" else rng.choice([["a"], ["c"], ["a", "c"]]) if op == "U" else []
        log.append((seq, k, op, changed, a, c))
        if op == "I":
            model[k] = [a, c]
        elif op == "D":
            model.pop(k, None)
        elif k in model:
            model[k] = [a if "a" in changed else model[k][0], c if "c" in changed else model[k][1]]
    ops = spark.createDataFrame(log, "seq long, k long, op string, changed array<string>, a string, c long")
    got = apply_net(base, fold(ops, ["k"], base.columns), ["k"])
    assert rows(got) == sorted(((k, *v) for k, v in model.items()), key=str)


def test_a_patch_moves_rows_in_and_out_of_a_filter(base):
    t = VersionedTable(base, ("k",)).update(F.col("k") == 3, {"a": F.lit("moved")})
    assert t.read().filter("a = 'a3'").count() == 0
    assert t.read().filter("a = 'moved'").count() == 1


def test_writes_leave_base_and_older_versions_alone(base):
    before = rows(base)
    t = VersionedTable(base, ("k",))
    t.update(F.col("k") > 2, {"c": F.lit(None).cast("long")}).delete(F.col("k") == 0).truncate()
    assert rows(base) == before == rows(t.read())


def test_null_can_be_patched_in(base):
    t = VersionedTable(base, ("k",)).update(F.col("k") == 1, {"a": F.lit(None).cast("string")})
    assert t.read().filter("a is null").count() == 1


def test_insert_over_a_row_replaces_it_and_delete_hides_it_for_good(spark, base):
    one = spark.createDataFrame([(2, "new", 5)], base.schema)
    t = VersionedTable(base, ("k",)).insert(one)
    assert rows(t.read().filter("k = 2")) == [(2, "new", 5)]
    assert t.delete(F.col("k") == 2).read().filter("k = 2").count() == 0
    assert rows(t.delete(F.col("k") == 2).insert(one).read().filter("k = 2")) == [(2, "new", 5)]


def test_update_of_nothing_changes_nothing(base):
    t = VersionedTable(base, ("k",)).update(F.col("k") == 99, {"a": F.lit("x")})
    assert rows(t.read()) == rows(base) and t.changes_since(1).count() == 0


def test_limit_and_order_come_after_the_merge(spark, base):
    t = VersionedTable(base, ("k",)).insert(spark.createDataFrame([(-1, "new", 999)], base.schema))
    assert [r.k for r in t.read().orderBy(F.desc("c")).limit(1).collect()] == [-1]


def test_composite_and_null_keys(spark):
    base = spark.createDataFrame([(1, "x", 1), (1, None, 2), (2, "x", 3)], "a long, b string, v long")
    t = VersionedTable(base, ("a", "b")).update(F.col("b").isNull(), {"v": F.lit(9).cast("long")}).delete((F.col("a") == 1) & (F.col("b") == "x"))
    assert rows(t.read()) == [(1, None, 9), (2, "x", 3)]


def test_journal_has_old_and_new(base):
    t = VersionedTable(base, ("k",)).update(F.col("k") == 1, {"a": F.lit("z")}).delete(F.col("k") == 1)
    told = {r.seq: (r.op, r.old_row, r.new_row) for r in t.changes_since(1).collect()}
    assert told[1] == ("U", '{"k":1,"a":"a1","c":10}', '{"k":1,"a":"z","c":10}')
    assert told[2] == ("D", '{"k":1,"a":"z","c":10}', None)


def test_local_table_and_compaction(spark, base, tmp_path):
    t = local_table(base, ("k",)).insert(base.filter("k < 3"))
    assert t.read().count() == 3
    assert rows(t.compact(str(tmp_path / "v1")).read()) == rows(t.read())


def test_filter_on_an_unpatched_column_reaches_the_scan(spark, base, tmp_path):
    base.write.parquet(str(tmp_path / "base"))
    stored = spark.read.parquet(str(tmp_path / "base"))
    t = VersionedTable(stored, ("k",)).delete(F.col("k") == 3)
    plan = t.read().filter("k = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,5)" in plan


def test_random_statements_equal_a_dict(spark, base):
    rng = random.Random(5)
    for _ in range(3):
        t, model = VersionedTable(base, ("k",)), {r.k: (r.a, r.c) for r in base.collect()}
        for n in range(9):
            kind, k = rng.choice("IIUUUDDT" if n == 4 else "IIUUUDD"), rng.randrange(10)
            if kind == "I":
                new = [(k, f"i{n}", n), (k + 20, None, n)]
                t = t.insert(spark.createDataFrame(new, base.schema))
                model |= {x: (a, c) for x, a, c in new}
            elif kind == "U":
                t = t.update(F.col("c") % 3 == k % 3, {"c": F.col("c") + k, "a": F.lit(None)})
                model = {x: (None, c + k) if c % 3 == k % 3 else (a, c) for x, (a, c) in model.items()}
            elif kind == "D":
                t = t.delete(F.col("k") % 4 == k % 4)
                model = {x: v for x, v in model.items() if x % 4 != k % 4}
            else:
                t, model = t.truncate(), {}
        want = sorted(((k, *v) for k, v in model.items()), key=str)
        assert rows(t.read()) == want
        stored = t.stored()
        assert rows(stored.read()) == want and not stored.statements and stored.dirty().count() == 0
        assert rows(stored.insert(base.limit(1)).delete(F.lit(True)).stored().read()) == []


def test_nothing_runs_on_writing_and_the_base_is_read_once(spark, base, tmp_path):
    base.write.parquet(str(tmp_path / "base"))
    stored = spark.read.parquet(str(tmp_path / "base"))
    t = VersionedTable(stored, ("k",)).update(F.col("k") % 2 == 0, {"a": F.lit("x")}).delete(F.col("c") > 50).update(F.col("k") == 1, {"c": F.lit(0)})
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Exchange" not in plan


def test_new_rows_get_keys_below_zero(spark, base):
    new = spark.createDataFrame([(f"n{k}", k) for k in range(5)], "a string, c long").repartition(3)
    t = VersionedTable(base, ("k",)).insert_new(new)
    assert sorted(r.k for r in t.read().filter("k < 0").collect()) == [-5, -4, -3, -2, -1]
    assert sorted(r.k for r in t.insert_new(new.limit(2)).read().filter("k < 0").collect()) == [-7, -6, -5, -4, -3, -2, -1]


def test_keys_cannot_be_set_and_equal_keys_of_an_insert_are_one(spark, base):
    with pytest.raises(ValueError):
        VersionedTable(base, ("k",)).update(F.lit(True), {"k": F.lit(1)})
    twice = spark.createDataFrame([(50, "a", 1), (50, "b", 1)], base.schema)
    assert rows(VersionedTable(base, ("k",)).insert(twice).read().filter("k = 50")) == [(50, "b", 1)]


def test_journal_by_time_and_the_dirty_keys(base):
    t = VersionedTable(base, ("k",)).update(F.col("k") == 1, {"a": F.lit("z")})
    later = t.delete(F.col("k") < 3)
    assert [(r.seq, r.k) for r in later.changes_since(later.statements[1].at).orderBy("k").collect()] == [(2, 0), (2, 1), (2, 2)]
    assert sorted((r.k, r.op) for r in later.dirty().collect()) == [(0, "D"), (1, "D"), (2, "D")]
    assert sorted((r.k, r.op) for r in t.truncate().dirty(2).collect()) == [(k, "D") for k in range(8)]
