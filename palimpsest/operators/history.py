"""Histories with merges: who descends from whom, and where two lines of work parted.

A graph(node, refs) is any graph without cycles, refs being an array of nodes: commits and their parents, or chunks and
what they refer to. It is covered by chains: a node goes on the chain of its first reference if it is the least of those
that could, and begins a chain otherwise. Places on chains are found by doubling pointers, so a chain of n nodes takes
log2(n) rounds. What a node reaches is then one number for each chain that it meets, the highest place on it; these
numbers spread along the references that leave a chain, in as many rounds as a path changes chains, and a number that
another one covers goes no further: all earlier ones are looked at in rounds 1, 2, 4, 8 and so on, as reading them in each
would cost far more than what is found twice, and so there are never over twice as many rounds as it takes. Long histories are long chains, so rounds grow with merges within merges
and not with the number of commits.

Defined results: references to nodes that the graph lacks lead nowhere; repeated references count once; a node is its
own forebear; a cycle of first references is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import written


def chain_places(graph: DataFrame) -> DataFrame:
    """(node, chain, place): each node's chain, named by its lowest node, and how far above that it lies."""
    known = graph.select("node", F.get("refs", F.lit(0)).alias("up"))
    first = known.filter("up is not null").join(known.select(F.col("node").alias("up")), "up", "left_semi")
    below = first.groupBy("up").agg(F.min("node").alias("node"))  # one of those that stand on a node is its chain's next
    own = known.select("node").join(below, "node", "left")
    last = written(own.select("node", F.coalesce("up", "node").alias("chain"), F.col("up").isNotNull().cast("long").alias("place"), F.col("up").isNotNull().alias("going")), "chains")
    ended = []
    while not last.filter("going").isEmpty():
        if len(ended) > 40:
            raise ValueError("nodes that are their own forebears")
        ended.append(last.filter("not going"))  # their pointers are at the lowest node
        on = _all([*ended, last.filter("going")]).filter("place > 0").select(F.col("node").alias("chain"), F.col("chain").alias("low"), F.col("place").alias("more"))
        on_from = last.filter("going").join(on, "chain", "left")
        last = written(on_from.select("node", F.coalesce("low", "chain").alias("chain"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("low").isNotNull().alias("going")), "chains")
    return _all([*ended, last]).drop("going")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def crossings(graph: DataFrame, places: DataFrame) -> DataFrame:
    """(chain, place, to, at, ref): the references that leave a chain; ref is the node at that place of the other."""
    links = graph.select("node", F.explode(F.array_distinct("refs")).alias("ref"))
    links = links.join(places.select(F.col("node").alias("ref"), F.col("chain").alias("to"), F.col("place").alias("at")), "ref").join(places, "node")
    return links.filter("chain <> to").select("chain", "place", "to", "at", "ref")


def reached(starts: DataFrame, cross: DataFrame, by: list[str], highs: list[str], floor: str | None = None) -> DataFrame:
    """(by, chain, highs): the highest places on each chain that starts(by, chain, highs) lead to, for each value of `by`; -1 is none.

    With `floor`, a column of `by`, references to nodes below it are not followed. A round writes only what it comes to, and in
    rounds whose number is a power of two only what is new of that.
    """
    keys, old = [*by, "chain"], [f"was_{h}" for h in highs]
    none = F.lit(-1).cast("long")
    tops = lambda rows, names: rows.groupBy(*keys).agg(*[F.max(n).alias(n) for n in names])
    fresh = written(tops(starts, highs).select(*keys, *highs, *[none.alias(w) for w in old]), "reached")
    parts = []
    while not fresh.isEmpty():
        parts.append(fresh.select(*keys, *highs))
        may = [F.col("c.ref") >= F.col(f"f.{floor}")] if floor else []
        new = reduce(lambda x, y: x | y, [(F.col("c.place") <= F.col(f"f.{h}")) & (F.col("c.place") > F.col(f"f.{w}")) for h, w in zip(highs, old)])
        out = fresh.alias("f").join(cross.alias("c"), reduce(lambda x, y: x & y, may, (F.col("f.chain") == F.col("c.chain")) & new))
        out = out.select(*[f"f.{k}" for k in by], F.col("c.to").alias("chain"), *[F.when(F.col("c.place") <= F.col(f"f.{h}"), F.col("c.at")).otherwise(none).alias(h) for h in highs], *[none.alias(w) for w in old])
        if len(parts) & (len(parts) - 1):
            fresh = written(tops(out, highs).select(*keys, *highs, *[none.alias(w) for w in old]), "reached")
            continue
        before = _all(parts).select(*keys, *[none.alias(h) for h in highs], *[F.col(h).alias(w) for h, w in zip(highs, old)])
        more = tops(out.unionByName(before), [*highs, *old]).filter(reduce(lambda x, y: x | y, [F.col(h) > F.col(w) for h, w in zip(highs, old)]))
        fresh = written(more.select(*keys, *[F.greatest(h, w).alias(h) for h, w in zip(highs, old)], *old), "reached")
    return tops(_all(parts), highs) if parts else fresh.select(*keys, *highs)


def ordered(graph: DataFrame) -> bool:
    """Whether all nodes are greater than what they refer to, so that nothing below a node leads to it."""
    return graph.select("node", F.explode("refs").alias("ref")).filter("ref >= node").isEmpty()


def forebears(graph: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) of all that the roots(node) lead to, themselves included.

    Nodes that refer to nothing, often by far the most, are on no chain: they are looked up once, when all that refer to them are found.
    """
    refers = F.coalesce(F.size("refs"), F.lit(0)) > 0
    inner = graph.filter(refers)
    places = written(chain_places(inner), "places")
    cross = written(crossings(inner, places), "crossings")
    high = reached(roots.select("node").distinct().join(places, "node"), cross, [], ["place"]).select("chain", F.col("place").alias("high"))
    within = written(places.join(high, "chain").filter("place <= high").select("node"), "within")
    named = inner.join(within, "node").select(F.explode("refs").alias("node")).unionByName(roots.select("node"))
    return within.unionByName(graph.filter(~refers).select("node").join(named, "node", "left_semi"))


def fast_forwards(graph: DataFrame, moves: DataFrame) -> DataFrame:
    """moves(new, old) of references with `forward`: whether old is new or one of its forebears; a null old always is, an unknown one never.

    Where nodes are numbered in the order in which they came, nothing below the lowest old of a new one is looked at.
    """
    places = written(chain_places(graph), "places")
    cross = written(crossings(graph, places), "crossings")
    asked = written(moves.filter("old is not null and new <> old").select("new", "old").distinct(), "moves")
    by = ["new", "least"] if ordered(graph) else ["new"]
    starts = asked.groupBy("new").agg(F.min("old").alias("least")).join(places.withColumnRenamed("node", "new"), "new").select(*by, "chain", "place")
    high = reached(starts, cross, by, ["place"], "least" if len(by) > 1 else None)
    low = asked.join(places.select(F.col("node").alias("old"), "chain", F.col("place").alias("low")), "old")
    met = low.join(high.select("new", "chain", "place"), ["new", "chain"]).filter("place >= low")
    same = F.col("old").isNull() | (F.col("old") == F.col("new"))
    return moves.join(met.select("new", "old", F.lit(True).alias("forward")), ["new", "old"], "left").withColumn("forward", F.coalesce("forward", same, F.lit(False)))


def merge_bases(graph: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, base) for pairs(a, b): their common forebears that are no forebears of another one; several where merges crossed, none where there are none.

    On each chain that both reach only the highest common place can be one, and it is none if a node that refers to it is
    common too: the last step from another common forebear would go through such a node.
    """
    places = written(chain_places(graph), "places")
    cross = written(crossings(graph, places), "crossings")
    asked = pairs.select("a", "b").distinct()
    sides = [asked.join(places.withColumnRenamed("node", x), x).select("a", "b", "chain", *[(F.col("place") if x == y else F.lit(-1).cast("long")).alias(f"p{y}") for y in "ab"]) for x in "ab"]
    high = reached(_all(sides), cross, ["a", "b"], ["pa", "pb"])
    both = written(high.filter("pa >= 0 and pb >= 0").select("a", "b", "chain", F.least("pa", "pb").alias("place")), "common")
    over = cross.select(F.col("to").alias("chain"), F.col("at").alias("place"), F.col("chain").alias("by"), F.col("place").alias("from"))
    above = both.join(over, ["chain", "place"]).select("a", "b", "chain", "by", "from")
    covered = above.join(both.select("a", "b", F.col("chain").alias("by"), "place"), ["a", "b", "by"]).filter("from <= place").select("a", "b", "chain").distinct()
    some = both.join(covered, ["a", "b", "chain"], "left_anti")
    return some.join(places, ["chain", "place"]).select("a", "b", F.col("node").alias("base"))
