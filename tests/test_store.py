"""Stored tables: sessions, pinned values, journal, conflicts, several tables at once, and faults between the steps."""

from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.pointers import NumberedFiles
from palimpsest.operators.store import FOLD, Conflict, Store


@pytest.fixture
def store(spark, tmp_path):
    t = Store(spark, str(tmp_path / "store")).begin()
    t.create_table("a", spark.createDataFrame([(k, k % 3, "x") for k in range(20)], "id long, v long, s string"), ("id",))
    t.create_table("b", spark.createDataFrame([(1, 1, None), (1, 2, "q"), (None, 1, "n")], "p long, q long, s string"), ("p", "q"))
    return t.commit("first")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def again(store):
    return Store(store.spark.newSession(), store.path)


def test_another_session_sees_rows_journal_keys_and_dirt(store):
    t = store.begin()
    t.update("a", F.col("v") == 1, {"v": F.lit(100), "s": F.lit(None)})
    t.insert_new("a", t.spark.createDataFrame([(7, "n"), (8, "m")], "v long, s string"))
    second = t.commit()
    t = second.begin()
    t.delete("a", F.col("v") == 100)
    third = t.commit()
    other = again(third)
    assert rows(other.table("a")) == rows(third.table("a")) == sorted([(k, k % 3, "x") for k in range(20) if k % 3 != 1] + [(-1, 7, "n"), (-2, 8, "m")], key=str)
    assert rows(Store(other.spark, other.path, 2).table("a")) == rows(second.table("a"))
    journal = other.journal("a").collect()
    assert [r.seq for r in journal if r.op == "I"] == [2, 2] and {r.seq for r in journal} == {1, 2, 3}
    assert {(r.id, r.old.v, r.new.v) for r in journal if r.seq == 1} == {(k, 1, 100) for k in range(1, 20, 3)}
    assert all(r.new is None and r.old.v == 100 and r.old.s is None for r in journal if r.seq == 3)
    at = min(r.at for r in journal if r.seq == 3).replace(tzinfo=timezone.utc)
    assert {r.seq for r in other.journal("a", since=at).collect()} == {3}
    assert other.journal("a", since=datetime(2999, 1, 1, tzinfo=timezone.utc)).count() == 0
    assert {(r.id, r.op) for r in other.dirty("a").collect()} == {(k, "D") for k in range(1, 20, 3)} | {(-1, "I"), (-2, "I")}
    t = other.begin()
    t.mark_clean("a")
    t.insert_new("a", t.spark.createDataFrame([(9, "o")], "v long, s string"))
    last = again(t.commit())
    assert rows(last.table("a").filter("id < 0").select("id")) == [(-1,), (-2,), (-3,)]
    assert rows(last.dirty("a")) == [(-3, "I")]


def test_values_are_of_the_moment_they_were_written(store):
    t = store.begin()
    t.update("a", F.lit(True), {"v": (F.rand() * 1e9).cast("long"), "s": F.current_timestamp().cast("string")})
    done = t.commit()
    assert rows(done.table("a")) == rows(again(done).table("a")) == rows(done.table("a"))


def test_the_second_of_two_writers_is_refused_on_the_same_table(store):
    one, two = store.begin(), again(store).begin()
    one.delete("a", F.col("id") == 1)
    two.delete("a", F.col("id") == 2)
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert again(store).table("a").filter("id = 2").count() == 1
    assert again(store).vacuum() == 0  # a refused writer leaves nothing


def test_writers_of_different_things_both_count(store):
    one, two = store.begin(), again(store).begin()
    one.set_ref("main", None, "c1")
    one.delete("a", F.col("id") == 1)
    two.set_ref("other", None, "c2")
    two.update("b", F.col("q") == 2, {"s": F.lit("two")})
    one.commit()
    two.commit()
    now = again(store)
    assert [(r.seq, r.new.s) for r in now.journal("b").collect()] == [(1, "two")] and now.table("b").filter("s = 'two'").count() == 1
    assert (now.ref("main"), now.ref("other"), now.table("a").count(), now.version) == ("c1", "c2", 19, 3)
    with pytest.raises(Conflict):
        now.begin().set_ref("main", "c0", "c9")
    stale = store.begin()
    stale.set_ref("main", None, "c5")
    with pytest.raises(Conflict):
        stale.commit()


@pytest.mark.parametrize("step", range(5))
def test_a_fault_after_any_step_leaves_all_or_nothing(store, monkeypatch, step):
    """Two tables and a reference move together; the writer dies after so many writes of the file system."""
    before = {n: rows(store.table(n)) for n in ("a", "b")}
    left = [step]

    def dies(real):
        def call(*args, **more):
            if left[0] == 0:
                raise OSError("the writer died")
            left[0] -= 1
            return real(*args, **more)

        return call

    t = again(store).begin()
    monkeypatch.setattr(t, "_write", dies(t._write))
    monkeypatch.setattr(NumberedFiles, "publish", dies(NumberedFiles.publish))
    monkeypatch.setattr(t, "rollback", lambda: None)  # a dead writer doesn't clear up

    def work():
        t.delete("a", F.col("id") < 5)
        t.update("b", F.col("q") == 1, {"s": F.lit("new")})
        t.insert("b", t.spark.createDataFrame([(9, 9, "z")], "p long, q long, s string"))
        t.set_ref("main", None, "c1")
        t.commit()

    if step == 4:
        work()
    else:
        with pytest.raises(OSError):
            work()
    monkeypatch.undo()
    now = again(store)
    if step == 4:
        assert now.ref("main") == "c1" and now.table("a").count() == 15 and now.table("b").count() == 4
    else:
        assert now.ref("main") is None and {n: rows(now.table(n)) for n in ("a", "b")} == before
        assert now.vacuum() == step and {n: rows(now.table(n)) for n in ("a", "b")} == before


def test_a_half_written_manifest_is_no_version(store, spark, monkeypatch):
    log = NumberedFiles(spark, f"{store.path}/log")
    stream = log.fs.create(log.where(log.at(2)), False)
    stream.write(bytearray(b'{"version": 2, "ta'))
    stream.close()
    assert again(store).version == 1
    t = store.begin()
    t.delete("a", F.col("id") == 1)
    with pytest.raises(Conflict):  # its writer may be at it
        t.commit()
    monkeypatch.setattr("palimpsest.operators.pointers.GRACE", -1.0)
    t = again(store).begin()
    t.delete("a", F.col("id") == 1)
    assert t.commit().version == 2 and again(store).table("a").count() == 19


def test_truncation_is_one_mark(store):
    t = store.begin()
    t.truncate("a")
    t.insert("a", t.spark.createDataFrame([(1, 5, "new"), (1, 6, "later")], "id long, v long, s string"), order=-F.col("v"))
    done = again(t.commit())
    assert rows(done.table("a")) == [(1, 5, "new")]
    journal = done.journal("a").collect()
    assert sum(r.op == "D" for r in journal) == 20 and [(r.id, r.old, r.new.v) for r in journal if r.op == "I"] == [(1, None, 5)]


def test_many_statements_equal_a_dict_and_open_few_folders(spark, tmp_path):
    rng = random.Random(4)
    want = {k: (k, k % 5, "x") for k in range(40)}
    t = Store(spark, str(tmp_path / "s")).begin()
    t.create_table("t", spark.createDataFrame(list(want.values()), "id long, v long, s string"), ("id",))
    store = t.commit()
    for n in range(FOLD + 3):
        t, a, b = store.begin(), rng.randrange(5), rng.randrange(60)
        if n % 4 == 0:
            t.delete("t", F.col("id") == b)
            want.pop(b, None)
        elif n % 4 == 1:
            t.insert("t", spark.createDataFrame([(b, a, f"i{n}")], "id long, v long, s string"))
            want[b] = (b, a, f"i{n}")
        else:
            t.update("t", F.col("v") == a, {"v": F.col("v") + 1, "s": F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("s"))})
            want = {k: (k, v + 1, None if k % 2 == 0 else s) if v == a else (k, v, s) for k, (_, v, s) in want.items()}
        store = t.commit()
    assert rows(store.table("t")) == sorted(want.values(), key=str)
    assert len(store.state.tables["t"].runs) < FOLD and store.journal("t").select("seq").distinct().count() <= FOLD + 3
    t = store.begin()
    t.compact("t")
    assert rows(again(t.commit()).table("t")) == sorted(want.values(), key=str)


def test_composite_and_null_keys(store):
    t = store.begin()
    t.insert("b", t.spark.createDataFrame([(None, 1, "replaced"), (1, 2, None), (5, 5, "five")], "p long, q long, s string"))
    t.delete("b", F.col("p").isNull() & (F.col("q") == 7))
    done = t.commit()
    assert rows(done.table("b")) == sorted([(1, 1, None), (1, 2, None), (None, 1, "replaced"), (5, 5, "five")], key=str)
    assert {(r.p, r.q, r.old and r.old.s) for r in done.journal("b").collect()} == {(None, 1, "n"), (1, 2, "q"), (5, 5, None)}
