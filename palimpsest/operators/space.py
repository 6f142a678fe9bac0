"""Space of snapshots that share what they hold.

What a line of snapshots 0, 1, 2 ... holds is kept as lives: (hash, size, born, died) for each stretch of snapshots
that show a thing, from the one it came with to the one that first lacks it. A thing that stays for a thousand snapshots
is one row, and sizes of all snapshots, of what one alone holds, and of what a deletion of a range frees, come from sums
by born and died: small tables, a row for a snapshot or for a pair of them, whatever the number of things.

Defined results: a thing shown at several paths of a snapshot counts once there; lives that touch or overlap are one; a
null died is one that goes on; a null size counts as none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lives(shown: DataFrame) -> DataFrame:
    """(hash, size, born, died) from shown(snap, hash, size), whatever paths: each run of snapshots in a row is one life."""
    once = shown.groupBy("hash", "snap").agg(F.max("size").alias("size"))
    run = F.col("snap") - F.row_number().over(Window.partitionBy("hash").orderBy("snap"))
    return once.withColumn("_run", run).groupBy("hash", "_run").agg(F.max("size").alias("size"), F.min("snap").alias("born"), (F.max("snap") + 1).alias("died")).drop("_run")


def grown(known: DataFrame, shown: DataFrame, snap: int) -> DataFrame:
    """The lives after one more snapshot, which shows shown(hash, size): what it shows goes on or is born, what it lacks has died; no older snapshot is read."""
    new = shown.groupBy("hash").agg(F.max("size").alias("new_size"), F.lit(True).alias("_shown"))
    going, over = known.filter("died is null"), known.filter("died is not null")
    both = going.join(new, "hash", "full_outer")
    born, died = F.coalesce("born", F.lit(snap).cast("long")), F.when(F.col("_shown").isNull(), F.lit(snap).cast("long"))
    return over.unionByName(both.select("hash", F.coalesce("size", "new_size").alias("size"), born.alias("born"), died.alias("died")))


def _merged(of: DataFrame, n: int) -> DataFrame:
    """Sizes and numbers by (born, last), both within 0 to n - 1: at most n * n rows."""
    last = F.least(F.coalesce("died", F.lit(n)), F.lit(n)) - 1
    some = of.select(F.greatest("born", F.lit(0)).cast("long").alias("born"), last.cast("long").alias("last"), F.coalesce("size", F.lit(0)).alias("size")).filter("born <= last")
    return some.groupBy("born", "last").agg(F.count("*").alias("things"), F.sum("size").cast("long").alias("size"))


def space(of: DataFrame, n: int) -> DataFrame:
    """(snap, n, bytes, own) of snapshots 0 to n - 1: how many things each holds, their bytes, and the bytes that no other holds."""
    sums = _merged(of, n)
    steps = sums.select(F.explode(F.array(F.struct(F.col("born").alias("snap"), F.col("things"), "size"), F.struct((F.col("last") + 1).alias("snap"), (-F.col("things")).alias("things"), (-F.col("size")).alias("size")))).alias("s"))
    every = sums.sparkSession.range(n).select(F.col("id").alias("snap"), F.lit(0).cast("long").alias("things"), F.lit(0).cast("long").alias("size"))
    by_snap = steps.select("s.*").unionByName(every).groupBy("snap").agg(F.sum("things").alias("things"), F.sum("size").alias("size"))
    so_far = Window.orderBy("snap").rowsBetween(Window.unboundedPreceding, 0)  # n + 1 rows
    held = by_snap.select("snap", F.sum("things").over(so_far).alias("n"), F.sum("size").over(so_far).alias("bytes")).filter(F.col("snap") < n)
    own = sums.filter("born = last").select(F.col("born").alias("snap"), F.col("size").alias("own"))
    return held.join(own, "snap", "left").select("snap", "n", "bytes", F.coalesce("own", F.lit(0)).cast("long").alias("own"))


def freed(of: DataFrame, n: int) -> DataFrame:
    """(first, last, freed): the bytes that go with all snapshots from first to last, for every range: those whose whole life lies in it.

    Sums over a grid of n by n, along one side and then along the other.
    """
    sums = _merged(of, n)
    ids = sums.sparkSession.range(n)
    grid = ids.select(F.col("id").alias("born"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("last"))
    filled = grid.join(sums.select("born", "last", "size"), ["born", "last"], "left").withColumn("size", F.coalesce("size", F.lit(0)))
    until = Window.partitionBy("born").orderBy("last").rowsBetween(Window.unboundedPreceding, 0)
    since = Window.partitionBy("last").orderBy(F.desc("born")).rowsBetween(Window.unboundedPreceding, 0)
    both = filled.withColumn("size", F.sum("size").over(until)).withColumn("freed", F.sum("size").over(since))
    return both.filter("born <= last").select(F.col("born").alias("first"), "last", F.col("freed").cast("long").alias("freed"))
