"""Token alignment against a plain version, and the minimal perfect hash alone."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import token_align as ta

A, B = (public_tokenizers.path(n) for n in ta.VOCABULARIES)


def sides():
    """Plain tokenizers: text to [(id, bytes)] of each side, whole texts at once."""
    bpe = Tokenizer.from_file(A)
    bpe.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}
    pieces = sentencepiece.SentencePieceProcessor(model_file=B)

    def one(text):
        n = bpe.encode(" " + text, add_special_tokens=False)
        return [(i, bytes(byte_of[c] for c in t)) for i, t in zip(n.ids, n.tokens)]

    def two(text):
        named = [(i, pieces.id_to_piece(i)) for i in pieces.encode(text)]
        return [(i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()) for i, p in named]

    return one, two


def plain(texts):
    one, two = sides()
    links, rows, count = [], [], Counter()
    for text in texts:
        a, b = (one(text), two(text)) if text else ([], [])
        if any(b"".join(x for _, x in side) != (" " + (text or "")).encode() for side in (a, b)):
            a, b = [], []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        own, j = [], 0
        for i, s, e in spans[0]:
            while j and spans[1][j - 1][2] > s:
                j -= 1
            while j < len(spans[1]) and spans[1][j][1] < e:
                if spans[1][j][2] > s:
                    own.append((i, spans[1][j][0]))
                j += 1
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if before <= s and e <= cut) for side in spans))
            before = cut
        links.append(own)
        count.update(own)
        rows.append([len(a), len(b), len(cuts), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [(*r[:4], sum(count[x] == best[x[1]] for x in own), sum(count[x] for x in own), r[4]) for r, own in zip(rows, links)]


ODD = ["", None, " ", "  ", "a", " a ", "x \n y", "tab\tand  two   spaces ", "é à b 　 c", "▁ mark", "<s> </s> <unk> <|endoftext|> [INST]", "it's we'll’s 12 345", "\x00 \x01", "日本 語 の 文", "ﬁ Å é", "😀 😀😀 ‍", "a" * 300, " \u0085 x", "end \n"]


def some_texts(n, seed=5):
    rng = random.Random(seed)
    parts = ["the", "Straße", "été", "日本語", "x1", "12,345", "'s", "don't", " ", "  ", "\n", "\t", " ", "...", "😀", "<s>", "naïve", "ing", "▁", "ﬁ"]
    return [rng.choice(["", " "]).join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.choice([3, 20, 80]))) for _ in range(n)]


def test_alignment_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(ta, "SLICE", 2000)
    monkeypatch.setattr(ta, "REMEMBERED", 50)
    texts = ODD + some_texts(60) + ["again again"] * 3
    rows = [(None if k == 8 else k // 2, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit("clash"), "n_a": F.lit(1), "ids_a": F.lit(None).cast("int")})
    want = sorted(((d, *r) for (d, _), r in zip(rows, plain(texts))), key=str)
    for at_once in (None, 300):  # and in several rounds
        got = ta.aligned(df, pairs_at_once=at_once)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_empty_table(spark):
    assert ta.aligned(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r) for r in ta.aligned(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


OF = ta.Tokenizers(A, B)
ONE, TWO = sides()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'1. \n\t  　é日😀▁\x1c\x7f​")) | st.text(), min_size=1, max_size=4))
def test_cut_texts_have_the_ids_of_whole_texts(texts):
    for t, (a, b) in zip(texts, ta.encoded(OF, [t.encode() for t in texts])):
        own_a, own_b = (ONE(t), TWO(t)) if t else ([], [])
        same = all(b"".join(x for _, x in side) == (" " + t).encode() for side in (own_a, own_b))
        assert (a.tolist(), b.tolist()) == (([i for i, _ in own_a], [i for i, _ in own_b]) if same else ([], []))


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 1 << 40), max_size=400), st.integers(1, 5))
def test_perfect_hash(keys, shards):
    keys = np.array(sorted(keys), np.int64)
    of = ta.PairIndex(shards, {}).shard(keys)
    index = ta.PairIndex(shards, {s: ta.perfect_hash(keys[of == s]) for s in range(shards) if (of == s).any()})
    assert sorted(index.numbers(keys)) == list(range(len(keys)))
    assert (index.keys[index.numbers(keys)] == keys).all()
    others = np.setdiff1d(np.arange(1 << 10), keys)
    assert (index.numbers(others) == -1).all()
