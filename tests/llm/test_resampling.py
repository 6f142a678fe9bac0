"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from palimpsest.llm import resampling


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def plain(docs, target, percent=25):
    s, t = Counter(), Counter()
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            side.update(features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    rows = []
    for d, x in docs:
        words, own = features(x)
        weight, score = sum(map(gain, own)) // max(1, len(own)), None
        if d is not None:
            h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([d, len(own), weight, score, len(words)])
    may = sorted((r for r in rows if r[4] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    ranks = {id(r): n + 1 for n, r in enumerate(may[: percent * len(may) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=str)


def texts(n):
    rng = random.Random(3)
    words = ["The", "and", "x9", "Straße", "été", "日本", "a" * 300, "b" * 256, "c" * 257] + [f"w{k}" for k in range(60)]
    return [rng.choice([" ", ", ", "\n", " -"]).join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 200]))) for _ in range(n)]


def test_resampling_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 3000)
    some = texts(120)
    docs = list(enumerate(some)) + [(7, some[7]), (7, some[8]), (500, None), (501, ""), (502, " .\x00 "), (None, some[3]), (-4, "w" * 50_000 + " " + some[1])]
    target = texts(140)[120:] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "bucket": F.lit(1), "score": F.lit(None).cast("int")})
    got = resampling.resampled(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(docs, target)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resampled(none, none).count() == 0
    docs = [(k, f"word{k} " * 30) for k in range(9)]
    assert sorted((tuple(r) for r in resampling.resampled(spark.createDataFrame(docs, none.schema), none).collect()), key=str) == plain(docs, [])
