"""Operators over the whole set: near-duplicates of texts and of vectors, components, packing, the pipeline."""

from __future__ import annotations

import random
import re
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import components, decontaminate, embedding_dup, language_id, near_dup, packing, quality

LONG = " ".join(f"w{k % 977}" for k in range(30_000))


def parts(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = parts({n for ab in links for n in ab}, links)
    assert got == {n: want[n] for a, b in links if a != b for n in (a, b)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def brute_near(docs, like):
    sets = {d: shingles(t, like.words) for d, t in docs}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= like.percent * len(sets[a] | sets[b])]
    return {d: (len(s), parts(sets, links)[d]) for d, s in sets.items()}


@pytest.mark.parametrize("like", [near_dup.Likeness(), near_dup.Likeness(3, 85)])
def test_near_duplicates_equal_brute_force(spark, like):
    rng = random.Random(6)
    base = [[rng.choice(["a", "b", f"w{rng.randrange(500)}"]) for _ in range(rng.choice([4, 30, 120]))] for _ in range(12)]
    docs = [(1000, LONG), (1001, LONG + " more"), (1002, None), (1003, ""), (1004, " \n"), (1005, "Two Words"), (1006, "two words"), (1007, "one")]
    for k in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = f"x{k}"
        docs.append((k, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"node": F.lit(1), "key": F.lit("clash"), "kept": F.lit(0)})
    rows = near_dup.near_duplicates(df, like).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_near(docs, like)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_a_hot_bucket_is_split_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rng, docs = random.Random(7), []
    base = [f"w{k}" for k in range(100)]
    for k in range(60):
        words = list(base)
        for at in rng.sample(range(100), rng.choice([0, 1, 2, 3, 4, 5, 6])):
            words[at] = f"x{k}"
        docs.append((k, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), near_dup.Likeness(3, 85)).collect()}
    assert got == brute_near(docs, near_dup.Likeness(3, 85))


def test_near_duplicates_with_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string").withColumn("extra", F.lit(1))
    assert sorted(map(str, (tuple(r) for r in near_dup.near_duplicates(df).collect()))) == ["(1, 2, 1, True)", "(1, 2, 1, True)", "(2, 2, 1, False)", "(None, 2, None, False)"]
    assert sorted(str(r.doc_id) for r in near_dup.without_near_duplicates(df).collect()) == ["1", "None"]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0 == near_dup.without_near_duplicates(df.limit(0)).count()


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(40):
        centre = rng.standard_normal(24)
        for spread in rng.choice([0, 0.02, 0.1, 0.2, 0.25, 0.3], 8):
            rows.append((rng.uniform(0.1, 9) * (centre + spread * rng.standard_normal(24))).tolist())
    rows += [rows[0], rows[0], [2 * x for x in rows[0]]]
    vectors = [(n, v) for n, v in enumerate(rows)]
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [1.0] * 23 + [float("nan")]), (904, [1.0] * 23 + [float("inf")]), (905, [1.0] * 23 + [None]), (906, [1.0, 0.0]), (907, [1.0, 0.01]), (None, rows[0])]
    df = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<double>").withColumns({"node": F.lit(1), "vector": F.lit(2), "label": F.lit(None).cast("int")})
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dup.near_vectors(df).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = parts(range(len(rows)), zip(*(a.tolist() for a in np.nonzero(near))))
    right = sum(got[n][:2] == (int(near[n].sum()), want[n]) for n in range(len(rows)))
    assert right >= 0.98 * len(rows) and sum(got[n][0] for n in range(len(rows))) >= 0.99 * near.sum()
    assert all(got[k] == (0, k, True) for k in range(900, 906)) and got[906] == (1, 906, True) and got[907] == (1, 906, False) and got[None] == (0, None, False)
    assert embedding_dup.near_vectors(df.limit(0)).count() == 0


def test_a_vector_is_decoded_to_just_the_filters_it_exceeds():
    caps = embedding_dup.CapFilters(20, 2, 64, 0.5, 1)
    scores = caps.scores(np.random.default_rng(2).standard_normal((20, 20)), 0)
    rows, found = embedding_dup.decode(scores, 0.5)
    for n in range(20):
        total = scores[0][n][:, None] + scores[1][n]
        want = set(np.flatnonzero(total.ravel() >= 0.5)) or {int(total.argmax())}
        assert set(found[rows == n]) == want
    three = embedding_dup.CapFilters(20, 3, 16, 0.5, 1).scores(np.random.default_rng(3).standard_normal((9, 20)), 0)
    rows, found = embedding_dup.decode(three, 0.6)
    for n in range(9):
        total = three[0][n][:, None, None] + three[1][n][:, None] + three[2][n]
        assert set(found[rows == n]) == (set(np.flatnonzero(total.ravel() >= 0.6)) or {int(total.argmax())})


def test_repeated_ids_are_one_vector_and_hot_filters_are_compared_in_blocks(spark, monkeypatch):
    twice = spark.createDataFrame([(5, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [1.0, 0.01])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dup.near_vectors(twice).collect()) == [(5, 1, 5), (5, 1, 5), (7, 1, 5)]
    shared = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (7, [1.0, 0.01]), (9, [0.01, 1.0]), (11, [-1.0, 0.0]), (3, [-1.0, -1.0]), (3, [-1.0, -1.01])]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dup.near_vectors(spark.createDataFrame(shared, "vec_id long, embedding array<double>")).collect())
    assert got == [(3, 1, 3, True), (3, 1, 3, True), (5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (9, 1, 5, False), (11, 0, 11, True)]
    monkeypatch.setattr(embedding_dup, "FEW", 2)
    monkeypatch.setattr(embedding_dup, "BLOCK", 8)
    rng = np.random.default_rng(14)
    centre = rng.standard_normal(24)
    rows = [(centre + 0.2 * rng.standard_normal(24)).tolist() for _ in range(90)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dup.near_vectors(df).collect()}
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want = parts(range(90), zip(*(a.tolist() for a in np.nonzero(near))))
    assert near.sum() > 400 and got == {n: (int(near[n].sum()), want[n]) for n in range(90)}


@pytest.fixture(scope="module")
def both():
    path = public_tokenizers.path(packing.VOCABULARY)
    exact = Tokenizer.from_file(path)
    exact.encode_special_tokens = True
    return packing.ByteBpe(path), exact


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=200))
def test_ids_are_those_of_tokenizers(both, text):
    assert both[0].ids(text).tolist() == both[1].encode(text, add_special_tokens=False).ids


def test_ids_of_documents_and_of_a_long_run(spark, both):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + ["<|endoftext|> x", "ab" * 15_000]
    assert all(both[0].ids(t).tolist() == both[1].encode(t, add_special_tokens=False).ids for t in texts)


def test_packed_ids_are_those_of_the_library_defaults(spark):
    path = public_tokenizers.path(packing.VOCABULARY)
    bpe, exact = packing.ByteBpe(path, added=True), Tokenizer.from_file(path)
    texts = ["a <|endoftext|>b", "<|endoftext|><|endoftext|>", "<|endoftext|", "ab" * 15_000 + "<|endoftext|>"]
    want = [exact.encode(t, add_special_tokens=False).ids for t in texts]
    assert [bpe.ids(t).tolist() for t in texts] == want and 50256 in want[0]
    row = packing.pack(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).first()
    assert row.length == len(want[0]) + 1


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(lengths):
    bins, offsets, filled = packing.best_fit(lengths, 50)
    assert all(f <= 50 for f in filled) and sum(filled) == sum(lengths)
    for b in range(len(filled)):
        inside = sorted((offsets[i], lengths[i]) for i in range(len(lengths)) if bins[i] == b)
        assert [o for o, _ in inside] == np.cumsum([0] + [n for _, n in inside])[:-1].tolist()


def test_packing(spark, both):
    rng = random.Random(9)
    docs = [(k, " ".join(rng.choices("alpha beta gamma delta".split(), k=rng.randrange(1, 120)))) for k in range(300)]
    docs += [(400, None), (401, ""), (402, "word " * 900), (402, "word " * 900), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumns({"bin": F.lit(1), "length": F.lit("x")})
    rows = packing.pack(df, size=128, items_per_task=40).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) <= 128
    for doc_id, text in docs[:302]:
        ids = np.append(both[0].ids(text or ""), 0).astype("<u4")
        own = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) == len(ids)
        assert all(r.length == 128 for r in own[1:]) and all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    total = sum(r.length for r in rows)
    assert len(by_doc[402]) == 2 * -(-901 // 128) and by_doc[400][0].length == 1 and len(by_sequence) <= 1.07 * -(-total // 128)  # five tasks of some sixty pieces
    assert packing.pack(df.limit(0), size=128).count() == 0


def test_given_documents_are_packed_as_the_library_tokenizes_them(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("a <|endoftext|>"), "text")).otherwise(F.col("text")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    check_packing(docs, packing.op5_packing(spark, str(tmp_path)).collect())


def check_packing(docs, rows):
    exact = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc in docs.collect():
        ids = np.append(np.array(exact.encode(doc.text or "", add_special_tokens=False).ids, "<u4"), np.uint32(0)).astype("<u4")
        own = sorted(by_doc.pop(doc.doc_id), key=lambda r: r.piece)
        first = len(ids) % packing.SIZE or packing.SIZE
        want = [(0, first)] + [(at, packing.SIZE) for at in range(first, len(ids), packing.SIZE)]
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in own] == [(n, a, size, zlib.crc32(ids[a : a + size].tobytes())) for n, (a, size) in enumerate(want)]
    assert not by_doc
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) <= packing.SIZE
    assert len(by_sequence) <= 1 + 1.02 * -(-sum(r.length for r in rows) // packing.SIZE)


def test_pipeline_equals_plain_stages(spark):
    """Each stage on the given documents against what plain Python makes of the rows that the stage before kept."""
    d, (named, stages) = "/root/testdata/sf0.001", zip(*corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        tables.append(corpus_pipeline.written(stage(spark, tables[-1], d), name))
    rows = [t.collect() for t in tables]
    ids = [sorted(r.doc_id for r in some) for some in rows]

    labels = spark.read.parquet(f"{d}/labels.parquet").filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    model = quality.fit_quality(labels, docs)
    tools = quality._compressors(model)
    score = lambda t: 1 / (1 + np.exp(-np.clip(np.dot(quality.features((t or "").encode(), *tools), model.weights), -30, 30)))
    assert ids[1] == sorted(r.doc_id for r in rows[0] if score(r.text) >= 0.5)

    learned = language_id.fit_languages(tables[1].filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select("doc_id", "text", "lang"))
    bits = lambda t: language_id.code_lengths(learned, learned.tables(), [t.encode()]).min() / len(t.encode())
    assert ids[2] == sorted(r.doc_id for r in rows[1] if any(map(str.isalpha, r.text or "")) and bits(r.text) < 8)

    near = brute_near([(r.doc_id, r.text) for r in rows[2]], near_dup.Likeness())
    assert ids[3] == sorted(k for k, (_, component) in near.items() if k == component)

    items = [decontaminate._words([r.text])[0] for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    holds = lambda words: any(decontaminate.edits_of(i, words)[0] <= len(i) * 20 // 100 for i in items)
    assert ids[4] == sorted(r.doc_id for r in rows[3] if not holds(decontaminate._words([r.text])[0]))
    check_packing(tables[4], stages[-1](spark, tables[4], d).collect())
    assert named == ("quality", "language", "near_dup", "decontaminate", "pack") and len(ids[0]) > len(ids[1]) and len(ids[3]) > len(ids[4]) > 0


def test_pipeline_on_odd_documents(spark, tmp_path):
    rng, item = random.Random(10), " ".join(f"bench{k}" for k in range(20))
    words = "the river runs by old stone houses and every garden has light".split()
    docs = [(k, " ".join(rng.choices(words, k=80)), "en", "s", 1) for k in range(120)]
    docs += [(200, docs[0][1], "en", "s", 1), (201, docs[0][1] + " end", "en", "s", 1), (202, docs[1][1] + " " + item + " " + docs[2][1], "en", "s", 1)]
    docs += [(203, None, "en", "s", 1), (204, "", None, "s", 1), (205, "12 34", "en", "s", 1), (5, docs[5][1], "en", "s", 1), (None, docs[7][1], "en", "s", 1)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, columns).withColumns({"score": F.lit("clash"), "lang_pred": F.lit(1)}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, now, str(tmp_path)), name)
        assert after.columns == now.columns
        now, kept[name] = after, [r.doc_id for r in after.collect()]
    assert set(kept["quality"]) - set(kept["language"]) == {203, 204, 205}
    assert set(kept["language"]) - set(kept["near_dup"]) == {200, 201} and kept["near_dup"].count(5) == 1 and None in kept["near_dup"]
    assert set(kept["near_dup"]) - set(kept["decontaminate"]) == {202}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, kept["decontaminate"]))
    spark.createDataFrame([], spark.read.parquet(str(tmp_path / "documents.parquet")).schema).write.mode("overwrite").parquet(str(tmp_path / "none/documents.parquet"))
    for t in ("benchmark", "labels"):
        spark.read.parquet(str(tmp_path / f"{t}.parquet")).limit(0).write.parquet(str(tmp_path / f"none/{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
