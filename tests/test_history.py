"""Forebears, moves and merge bases on random histories against plain sets."""

from __future__ import annotations

import random

import pytest

from palimpsest.operators import history as H


def graph(seed, n=60):
    rng, refs = random.Random(seed), {}
    for k in range(n):
        some = [] if k == 0 or rng.random() < 0.05 else [k - 1 if rng.random() < 0.6 else rng.randrange(k)]
        if some and rng.random() < 0.4:
            some += [rng.randrange(k) for _ in range(rng.choice([1, 1, 2]))]
        refs[k] = some
    refs[n - 1] = refs[n - 1] + [999]  # unknown
    return refs


def closure(refs):
    out = {}
    for k in sorted(refs):
        out[k] = {k}.union(*[out[r] for r in refs[k] if r in out])
    return out


def frame(spark, refs):
    return spark.createDataFrame([(k, r) for k, r in refs.items()], "node long, refs array<long>")


@pytest.mark.parametrize("seed", [1])
def test_random_histories(spark, seed):
    refs = graph(seed)
    known, df, rng = closure(refs), frame(spark, refs), random.Random(seed)
    roots = rng.sample(range(60), 3)
    assert {r.node for r in H.forebears(df, spark.createDataFrame([(k,) for k in roots], "node long")).collect()} == set().union(*[known[k] for k in roots])
    moves = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(5, None), (7, 7), (9, 12345), (777, 3)]
    got = {(r.new, r.old): r.forward for r in H.fast_forwards(df, spark.createDataFrame(moves, "new long, old long")).collect()}
    assert got == {(a, b): b is None or a == b or b in known.get(a, set()) for a, b in moves}
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)]
    want = set()
    for a, b in pairs:
        common = known[a] & known[b]
        want |= {(a, b, x) for x in common if not any(x in known[y] for y in common - {x})}
    assert {tuple(r) for r in H.merge_bases(df, spark.createDataFrame(pairs, "a long, b long")).collect()} == want


def test_long_chain_and_a_cycle(spark):
    n = 300
    df = spark.range(n).selectExpr("id as node", "case when id = 0 then array() else array(id - 1) end as refs")
    assert H.forebears(df, spark.createDataFrame([(n - 1,)], "node long")).count() == n
    with pytest.raises(ValueError):
        H.chain_places(frame(spark, {1: [2], 2: [3], 3: [1]}))


def test_crossed_merges_have_two_bases(spark):
    df = frame(spark, {1: [], 2: [1], 3: [1], 4: [2, 3], 5: [3, 2]})
    assert {r.base for r in H.merge_bases(df, spark.createDataFrame([(4, 5)], "a long, b long")).collect()} == {2, 3}


def test_numbered_histories_are_looked_at_down_to_the_old_one_only(spark):
    refs = {k: [r for r in own if r < 60] for k, own in graph(2).items()}
    known, df, rng = closure(refs), frame(spark, refs), random.Random(2)
    assert H.ordered(df) and not H.ordered(frame(spark, {1: [2], 2: []}))
    moves = [(a, max(0, a - rng.randrange(12))) for a in range(60)]
    got = {(r.new, r.old): r.forward for r in H.fast_forwards(df, spark.createDataFrame(moves, "new long, old long")).collect()}
    assert got == {(a, b): b in known[a] for a, b in moves}
    cross = spark.createDataFrame([(9, 0, 5, 0, 5), (5, 0, 2, 0, 2)], "chain long, place long, to long, at long, ref long")
    starts = spark.createDataFrame([(9, 4, 9, 0)], "new long, least long, chain long, place long")
    assert {r.chain for r in H.reached(starts, cross, ["new", "least"], ["place"], "least").collect()} == {9, 5}


def test_earlier_rounds_are_looked_at_in_few_rounds(spark, monkeypatch):
    read, real = [], H.written
    monkeypatch.setattr(H, "written", lambda df, label: read.append(len({f.rpartition("/")[0] for f in df.inputFiles() if "/reached-" in f})) or real(df, label))
    cross = spark.createDataFrame([(k, 0, k + 1, 0, 0) for k in range(11)] + [(11, 0, 9, 0, 0)], "chain long, place long, to long, at long, ref long")
    starts = spark.createDataFrame([(1, 0, 0)], "new long, chain long, place long")
    assert {r.chain for r in H.reached(starts, cross, ["new"], ["place"]).collect()} == set(range(12))
    assert len(read) <= 17 and read[3] == read[5] == read[6] == read[7] == 1 and read[8] == 8  # it ends though two chains lead to each other


def test_nodes_that_refer_to_nothing_are_on_no_chain(spark, monkeypatch):
    df = frame(spark, {1: [], 2: [1, 7, 7], 3: [2, 8], 4: [9, 99], 7: [], 8: [], 9: None, 10: [], 11: []})
    real, seen = H.chain_places, []
    monkeypatch.setattr(H, "chain_places", lambda g: seen.extend(r.node for r in g.collect()) or real(g))
    assert sorted(r.node for r in H.forebears(df, spark.createDataFrame([(3,), (10,), (10,), (500,)], "node long")).collect()) == [1, 2, 3, 7, 8, 10]
    assert sorted(seen) == [2, 3, 4]
    assert H.forebears(df, df.select("node").limit(0)).count() == 0
