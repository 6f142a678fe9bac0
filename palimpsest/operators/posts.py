"""Posts and their meta rows as two tables that are written together.

posts(id, parent, slug, ...) and meta(meta_id, post_id, meta_key, meta_value). Every function gives new tables; a write that
would leave two posts or two meta rows of one id, or a meta row without a post, raises and gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import numbered


def _only(rows: DataFrame, what: str) -> None:
    if some := rows.limit(5).collect():
        raise ValueError(f"{what}: {[r[0] for r in some]}")


def _with_ids(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new with an id above all there are where it brings none (null or not above 0), and old's columns."""
    top = old.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    brings = F.coalesce(F.col(key) > 0, F.lit(False))
    own = new.filter(brings)
    top = max(top, own.agg(F.coalesce(F.max(key), F.lit(0))).first()[0])
    made = numbered(new.filter(~brings), "_n").withColumn(key, F.col("_n") + top + 1)
    rows = own.select(old.columns).unionByName(made.select(old.columns))
    _only(rows.groupBy(key).count().filter("count > 1"), f"{key} twice")
    _only(rows.join(old.select(key), key, "left_semi").select(key), f"{key} exists")
    return rows


def insert_posts(posts: DataFrame, new: DataFrame) -> DataFrame:
    """posts and the new ones: an id that is null or not above 0 becomes the next above the greatest."""
    return posts.unionByName(_with_ids(posts, new, "id"))


def delete_posts(posts: DataFrame, meta: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the posts of ids(id) and their meta rows; a post that others have as parent can't go without them."""
    left = posts.join(ids, "id", "left_anti")
    _only(left.join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").select("id"), "posts below a deleted one")
    return left, meta.join(ids.select(F.col("id").alias("post_id")), "post_id", "left_anti").select(meta.columns)


def renumber_posts(posts: DataFrame, meta: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after posts of moves(id, new_id) got other ids: their children and meta rows follow them."""
    _only(moves.filter("new_id is null or new_id <= 0").select("id"), "no id above 0")
    to = lambda key: moves.select(F.col("id").alias(key), F.col("new_id").alias("_to"))
    out = posts.join(to("id"), "id", "left").withColumn("id", F.coalesce("_to", "id")).drop("_to")
    out = out.join(to("parent"), "parent", "left").withColumn("parent", F.coalesce("_to", "parent")).drop("_to").select(posts.columns)
    _only(out.groupBy("id").count().filter("count > 1"), "id twice")
    return out, meta.join(to("post_id"), "post_id", "left").withColumn("post_id", F.coalesce("_to", "post_id")).select(meta.columns)


def insert_meta(posts: DataFrame, meta: DataFrame, new: DataFrame) -> DataFrame:
    _only(new.join(posts.select(F.col("id").alias("post_id")), "post_id", "left_anti").select("post_id"), "no such post")
    return meta.unionByName(_with_ids(meta, new, "meta_id"))


def move_meta(posts: DataFrame, meta: DataFrame, moves: DataFrame) -> DataFrame:
    """meta after the rows of moves(meta_id, to) went to other posts."""
    _only(moves.join(posts.select(F.col("id").alias("to")), "to", "left_anti").select("to"), "no such post")
    return meta.join(moves, "meta_id", "left").withColumn("post_id", F.coalesce("to", "post_id")).select(meta.columns)
