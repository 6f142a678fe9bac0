"""Space of snapshots against sets."""

from __future__ import annotations

import random

from palimpsest.operators import space as SP


def test_lives_and_sums_equal_sets(spark):
    rng, n = random.Random(6), 7
    size = {f"h{k}": rng.choice([None, 1, 10, 100]) for k in range(30)}
    snaps = [set(rng.sample(sorted(size), rng.randrange(4, 20))) for _ in range(n)]
    shown = spark.createDataFrame([(s, h, size[h]) for s, own in enumerate(snaps) for h in own for _ in range(1 + (h == "h3"))], "snap long, hash string, size long")
    of, known = SP.lives(shown), spark.createDataFrame([], "hash string, size long, born long, died long")
    for s in range(n):
        known = spark.createDataFrame(SP.grown(known, shown.filter(shown.snap == s), s).collect(), known.schema)
    bytes_of = lambda hs: sum(size[h] or 0 for h in hs)
    for lived in (of, known):
        got = {r.snap: (r.n, r.bytes, r.own) for r in SP.space(lived, n).collect()}
        alone = lambda s: [h for h in snaps[s] if (s == 0 or h not in snaps[s - 1]) and (s == n - 1 or h not in snaps[s + 1])]
        assert got == {s: (len(snaps[s]), bytes_of(snaps[s]), bytes_of(alone(s))) for s in range(n)}
    one_life = [(h, s) for h in size for s in range(n) if h in snaps[s] and (s == 0 or h not in snaps[s - 1])]
    ends = {(h, s): next(e for e in range(s, n) if e == n - 1 or h not in snaps[e + 1]) for h, s in one_life}
    want = {(a, b): sum(size[h] or 0 for (h, s), e in ends.items() if a <= s and e <= b) for a in range(n) for b in range(a, n)}
    assert {(r.first, r.last): r.freed for r in SP.freed(known, n).collect()} == want
