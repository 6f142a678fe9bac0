"""Repeated passages against a plain version."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import suffix_dedup as sd


def plain(docs, least=200):
    texts = [(t or "").encode() for _, t in docs]
    seen = Counter(t[p : p + least] for t in texts for p in range(len(t) - least + 1))
    rows = []
    for (d, _), t in zip(docs, texts):
        gone = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if seen[t[p : p + least]] > 1:
                gone[p : p + least] = b"\x01" * least
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        rows.append((d, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(rows, key=str)


def documents():
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "été", "日本", f"w{rng.randrange(3000)}", f"x{rng.randrange(10**6)}"])
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(n) for n in (30, 45, 60, 200)]
    docs = []
    for _ in range(60):
        parts = [prose(rng.choice([3, 20, 60])) for _ in range(3)]
        if rng.random() < 0.6:
            own = rng.choice(shared)
            a = rng.randrange(len(own) // 2)
            parts.insert(rng.randrange(4), own[a : a + rng.randrange(150, 500)])
        docs.append(" ".join(parts))
    docs += [docs[0]] * 3 + [docs[1] + "!", "?" + docs[1], None, "", "short", "short", "a" * 199, "b" * 200, "b" * 201, "c" * 1000, "ab" * 400, "\0" * 230, "\0" * 260, shared[3] * 3]
    return [(None if k == 5 else k // 2, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("block", [4096, 2])
def test_repeats_equal_a_plain_version(spark, monkeypatch, block):
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "PIECE", 2500)
    monkeypatch.setattr(sd, "SORTED", 20)
    docs = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("clash"), "digest": F.lit(1), "keys": F.lit(None).cast("int"), "n_bytes": F.lit(0)})
    got = sd.without_repeats(df)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs)


def test_empty_table(spark):
    assert sd.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.sampled_from([1, 2, 4]), st.integers(0, 300))
def test_equal_windows_pick_alike(seed, letters, shift):
    rng = random.Random(seed)
    text = bytes(rng.randrange(97, 97 + letters) for _ in range(700))
    other = bytes(rng.randrange(97, 97 + letters) for _ in range(shift)) + text[100:500]
    _, keys, place, first, last = sd.suffixes([text])
    windows = {p: (int(k), int(a) - p) for k, a, x, y in zip(keys, place, first, last) for p in range(x, y + 1)}
    assert set(windows) == set(range(len(text) - 199))
    _, keys, place, first, last = sd.suffixes([other])
    for k, a, x, y in zip(keys, place, first, last):
        for p in range(max(x, shift), y + 1):
            assert windows[p - shift + 100] == (int(k), int(a) - p)


def test_family_keeps_few_levels(spark):
    family, seen = sd.SuffixFamily(), Counter()
    for batch in range(7):
        keys = [batch, 100 + batch // 2, 200] + [300 + batch] * (batch % 2 + 1)
        seen.update(keys)
        family.add(spark.createDataFrame([(k,) for k in keys], "key long"))
        assert sum(size for size, _ in family.levels) == batch + 1 and len(family.levels) <= 4
    assert {r.key for r in family.repeated().collect()} == {k for k, n in seen.items() if n > 1}
