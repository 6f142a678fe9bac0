"""Files written together: renames, removals, failed tasks, cut commits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from palimpsest.sources import files as S
from palimpsest.sources import folder as W

SCHEMA = "path string, text string, was string"


def held(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*") if p.is_file()}


def test_files_come_move_and_go_together(spark, tmp_path):
    root = tmp_path / "site"
    first = [(f"posts/{k}-a.md", f"text {k} é", None) for k in range(20)]
    assert W.write_files(spark.createDataFrame(first, SCHEMA).repartition(3), str(root)) == 20
    assert held(root) == {p: t for p, t, _ in first}
    then = [("posts/1-new.md", "text 1 é", "posts/1-a.md"), ("posts/2-a.md", None, None), ("posts/3-a.md", "four", "posts/4-a.md"), ("posts/4-a.md", "three", "posts/3-a.md"), ("deep/er/x.md", "", None), ("posts/none.md", None, None)]
    W.write_files(spark.createDataFrame(then, SCHEMA).repartition(2), str(root))
    want = {p: t for p, t, _ in first} | {"posts/1-new.md": "text 1 é", "posts/3-a.md": "four", "posts/4-a.md": "three", "deep/er/x.md": ""}
    del want["posts/1-a.md"], want["posts/2-a.md"]
    assert held(root) == want


@pytest.mark.parametrize("rows", [[("../x", "t", None)], [("a/./b", "t", None)], [(None, "t", None)], [("a", "t", None), ("a", "u", None)], [("a", "t", "/b")]])
def test_bad_paths_write_nothing(spark, tmp_path, rows):
    with pytest.raises(ValueError):
        W.write_files(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "site"))
    assert held(tmp_path) == {}


def test_a_failed_task_leaves_the_folder_as_it_was(spark, tmp_path):
    W.write_files(spark.createDataFrame([("a", "old", None)], SCHEMA), str(tmp_path))
    boom = spark.range(40).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"), F.when(F.col("id") < 39, F.lit("new")).otherwise(F.raise_error(F.lit("boom")).cast("string")).alias("text"), F.lit(None).cast("string").alias("was"))
    with pytest.raises(Exception, match="boom"):
        W.write_files(boom.repartition(4).union(spark.createDataFrame([("a", "changed", None)], SCHEMA)), str(tmp_path))
    assert {k: v for k, v in held(tmp_path).items() if not k.startswith(".")} == {"a": "old"}
    assert W.recovered(spark, str(tmp_path)) == 0 and held(tmp_path) == {"a": "old"}


@pytest.mark.parametrize("cut", ["before any move", "between put and gone"])
def test_a_cut_commit_is_finished(spark, tmp_path, monkeypatch, cut):
    W.write_files(spark.createDataFrame([("a", "old", None), ("b", "b", None)], SCHEMA), str(tmp_path))
    real = W._moved

    def dies(*args):
        if cut == "between put and gone":
            with monkeypatch.context() as m:
                m.setattr(W, "_gone", None)
                try:
                    real(*args)
                except TypeError:
                    pass
                except Exception:
                    pass
        raise OSError("the writer died")

    monkeypatch.setattr(W, "_moved", dies)
    with pytest.raises(OSError):
        W.write_files(spark.createDataFrame([("c", "old", "a"), ("b", None, None)], SCHEMA), str(tmp_path))
    monkeypatch.setattr(W, "_moved", real)
    assert W.recovered(spark, str(tmp_path)) == 1
    assert held(tmp_path) == {"c": "old"} and W.recovered(spark, str(tmp_path)) == 0


def test_posts_and_feeds_are_read_back(spark, tmp_path):
    posts = spark.range(1, 8).select("id", F.create_map(F.lit("post_title"), F.concat(F.lit('t "'), F.col("id").cast("string"))).alias("fields"), F.array().cast("array<struct<meta_key:string,meta_value:string>>").alias("meta"), F.lit("body").alias("body"))
    W.write_files(S.rendered(posts).select(F.concat(F.col("id").cast("string"), F.lit("-x.md")).alias("path"), "text"), str(tmp_path / "posts"))
    back = S.read_posts(spark, str(tmp_path / "posts"))
    assert {r.id: r.fields["post_title"] for r in back.collect()} == {k: f't "{k}' for k in range(1, 8)}
    items = S.feed_items(spark.range(7).selectExpr("id as post_id", "concat('a & ', id) as title", "'post' as post_type", "'c' as content")).withColumn("n", F.col("post_id"))
    W.write_files(W.feed_parts(items, "n", 3, "feed"), str(tmp_path / "feed"))
    assert len(held(tmp_path / "feed")) == 3
    assert sorted(r.title for r in S.read_feed(spark, str(tmp_path / "feed")).collect()) == [f"a & {k}" for k in range(7)]


def test_more_files_take_more_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FILES_A_TASK", 8)
    tasks = []
    real = W._by_path
    monkeypatch.setattr(W, "_by_path", lambda rows, n: tasks.append(real(rows, n).rdd.getNumPartitions()) or real(rows, n))
    rows = [(f"{k % 3}/deep/{k}-a.md" if k % 2 else f"{k}-a.md", f"text {k}", None) for k in range(50)]
    W.write_files(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path))
    W.write_files(spark.createDataFrame([("1/other.txt", "x", None), ("1/deep/_no.md", "x", None), ("1/deep/new.md", "y", "1/deep/1-a.md")], SCHEMA), str(tmp_path))
    got = {r.path: bytes(r.content).decode() for r in W.read_files(spark, str(tmp_path), r"\.md$").collect()}
    want = {p: t for p, t, _ in rows} | {"1/deep/new.md": "y"}
    del want["1/deep/1-a.md"]
    assert got == want and tasks[:2] == [7, 7] and tasks[-1] == 7
    assert W.read_files(spark, str(tmp_path), r"\.none$").count() == 0
