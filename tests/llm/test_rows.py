"""Operators that judge row by row: quality, language, licences, decontamination, chats, URLs, pages."""

from __future__ import annotations

import html as html_module
import math
import random
import re
import textwrap
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import chat_format, decontaminate, html_text, language_id, license_scan, quality, url_filter

LONG = "word " * 60_000
ODD = [(1, None), (2, ""), (3, LONG), (4, "short"), (4, "short"), (None, "no id"), (5, "😀 émoji\n\n \t"), (6, "   \n")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit("clash"), "lang_pred": F.lit(1), "n": F.lit(0), "key": F.lit(2)})


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = []
    for k in range(160):
        words = [rng.choice("alpha beta gamma delta river stone light garden".split()) for _ in range(60)]
        text = " ".join(words) + "." if k % 2 else " ".join(w.upper() + "!!" for w in words)
        rows.append((k, text, k % 2))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


# Quality


def test_quality_tells_held_out_texts_apart(labelled):
    model = quality.fit_quality(labelled.filter("doc_id < 120").select("doc_id", "quality"), labelled)
    got = quality.score_quality(labelled.filter("doc_id >= 120"), model).select("quality", "score").collect()
    assert all((r.score >= 0.5) == (r.quality == 1) and 0 <= r.score <= 1 for r in got)


def test_quality_edges(spark, odd, labelled):
    model = quality.fit_quality(labelled.select("doc_id", "quality"), labelled)
    got = quality.score_quality(odd, model)
    assert got.columns == ["doc_id", "text", "lang_pred", "n", "key", "score"]
    scores = {(r.doc_id, r.text): r.score for r in got.collect()}
    assert len(got.collect()) == len(ODD) and scores[1, None] == scores[2, ""] and all(0 <= s <= 1 for s in scores.values())
    assert quality.score_quality(odd.limit(0), model).count() == 0
    untaught = quality.fit_quality(labelled.select("doc_id", "quality").limit(0), labelled)
    assert {r.score for r in quality.score_quality(odd, untaught).collect()} == {0.5}


def test_quality_scores_the_whole_text(labelled):
    model = quality.fit_quality(labelled.select("doc_id", "quality"), labelled)
    good, bad = quality._compressors(model)
    start = b"alpha beta gamma delta. " * 200
    assert quality.features(start + b"ALPHA!! BETA!! " * 400, good, bad)[1] < quality.features(start, good, bad)[1]


def test_quality_learns_from_few_texts(labelled):
    model = quality.fit_quality(labelled.filter("doc_id < 6").select("doc_id", "quality"), labelled)
    got = quality.score_quality(labelled.filter("doc_id >= 100"), model).select("quality", "score").collect()
    assert sum((r.score >= 0.5) == (r.quality == 1) for r in got) > 0.9 * len(got)


def test_held_out_documents_are_told_apart(spark):
    d = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in quality.op1_quality(spark, d).collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 50 and sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.98 * len(rows)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = [r for r in language_id.op8_language_id(spark, d).collect() if r.held_out and langs[r.doc_id]]
    assert len(rows) > 100 and sum(r.lang_pred == langs[r.doc_id] for r in rows) >= 0.98 * len(rows)


# Language


def naive_bits(texts: list[bytes], text: bytes, order: int = language_id.ORDER, least: int = 2) -> float:
    """Escape method C over dictionaries, one byte at a time."""
    trees: list[dict] = [{} for _ in range(order + 1)]
    for t in texts:
        t = bytes(order) + t
        for i in range(order, len(t)):
            for k in range(order + 1):
                trees[k].setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                trees[k][t[i - k : i]][t[i]] += 1
    total, text = 0.0, bytes(order) + text
    for i in range(order, len(text)):
        for k in range(order, -1, -1):
            seen = trees[k].get(text[i - k : i])
            if seen is None or k > 1 and sum(seen.values()) < least:
                continue
            n, q = sum(seen.values()), len(seen)
            if text[i] in seen:
                total -= math.log2(seen[text[i]] / (n + q))
                break
            total -= math.log2(q / (n + q))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    texts = {"a": [b"the cat sat on the mat", b"the hat"], "b": [b"der hut und die katze", b"und der mann"]}
    model = language_id.train(texts)
    tries = [b"the man", b"", b"und the", bytes(range(200, 256)), b"der hut sat" * 40]
    got = language_id.code_lengths(model, model.tables(), tries)
    for row, text in zip(got, tries):
        assert row == pytest.approx([naive_bits(texts[name], text) for name in model.languages], rel=1e-4, abs=1e-3)


def test_code_lengths_do_not_depend_on_segments(monkeypatch):
    model = language_id.train({"a": [b"abcabc" * 50], "b": [b"xyzxyz" * 50]})
    texts = [b"abc" * 70, b"xyzabc" * 30, b"q"]
    whole = language_id.code_lengths(model, model.tables(), texts)
    monkeypatch.setattr(language_id, "SEGMENT", 37)
    assert language_id.code_lengths(model, model.tables(), texts) == pytest.approx(whole, rel=1e-5)


def test_language_edges(spark, odd):
    known = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "x", None)], "doc_id long, text string, lang string")
    model = language_id.fit_languages(known)
    assert model.languages == ["de", "en"]
    got = language_id.identify(odd, model)
    rows = {(r.doc_id, r.text): r for r in got.collect()}
    assert rows[1, None].lang_pred == rows[2, ""].lang_pred == rows[6, "   \n"].lang_pred == "und" and rows[1, None].score == 0
    assert rows[3, LONG].lang_pred in ("de", "en") and rows[4, "short"].score > 0
    assert language_id.identify(odd.limit(0), model).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.fit_languages(known.limit(0))).collect()} == {"und"}


def test_languages_are_learned_in_one_read_of_the_texts(spark):
    rows = [(k, f"wort{k % 7} und der hund" if k % 3 else f"word{k % 7} and the dog", "de" if k % 3 else "en") for k in range(900)]
    rows += [(2000 + k, "", "fr") for k in range(900)] + [(3000, "le chien et la table", "fr"), (None, "il cane", "it"), (None, "il gatto", "it")]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_languages(known, per_language=20)
    assert model.languages == ["de", "en", "fr", "it"]
    whole = language_id.fit_languages(spark.createDataFrame([(1, "abc " * 9000, "x"), (2, "qrs " * 9000, "y")], known.schema), longest=100)
    assert whole.languages == ["x", "y"]


def test_predictions_equal_the_shortest_naive_code(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").filter("text is not null").orderBy("doc_id").limit(60).collect()
    texts: dict[str, list[bytes]] = {}
    for r in docs[:40]:
        if r.lang:
            texts.setdefault(r.lang, []).append(r.text[:600].encode())
    model = language_id.train(texts)
    rows = [(r.doc_id, r.text[:300]) for r in docs[40:]]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for doc_id, text in rows:
        bits = {name: naive_bits(own, text.encode()) for name, own in texts.items()}
        assert got[doc_id] == (min(sorted(bits), key=bits.get) if any(map(str.isalpha, text)) else "und")


# Licences


def test_licences(spark):
    docs = spark.createDataFrame(
        [(1, "Some words.\nReleased under the MIT License."), (1, "Some words.\nReleased under the MIT License."), (2, "His driver license is on the table.\nAll of it."), (3, None), (4, ""),
         (5, LONG + "\nLicensed under CC BY-NC 4.0.\n"), (None, "Licensed under the Apache License, Version 2.0."), (6, "Thanks. This work is licensed under the GNU General Public License, version 3. See below.")],
        "doc_id long, text string",
    ).withColumns({"family": F.lit(1), "row": F.lit(2)})
    weights = license_scan.fit_licenses(docs)
    got = license_scan.scan_licenses(docs, weights)
    found = sorted((str(r.doc_id), r.paragraph, r.family, r.confirmed) for r in got.collect())
    assert found == [("1", 1, "MIT", True), ("1", 1, "MIT", True), ("5", 1, "CC-BY-NC", True), ("6", 0, "GPL-3.0", True), ("None", 0, "Apache-2.0", True)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert license_scan.scan_licenses(docs.limit(0), weights).count() == 0


def test_licences_wrapped_over_lines(spark, weights):
    notice = {f: max(own, key=len) for f, own in license_scan.NOTICES.items()}
    wrapped = {f: textwrap.wrap(notice[f], 72) for f in ("MIT", "GPL-3.0", "GPL-2.0", "BSD")}
    assert all(len(lines) > 1 for lines in wrapped.values())
    docs = [(k, "A story of the river.\n\n" + "\n".join(lines) + "\n\nThe garden is old.") for k, lines in enumerate(wrapped.values())]
    docs += [(10, "/*\n * " + "\n * ".join(textwrap.wrap(notice["MIT"], 24)) + "\n */"), (11, notice["MIT"].replace(" ", "\n")), (12, "Released under the\n\nMIT License."), (13, "He has a\nnew house.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = license_scan.scan_licenses(df, weights)
    sure = sorted((r.doc_id, r.paragraph, r.family) for r in got.collect() if r.confirmed)
    assert sure == [*((k, 2, f) for k, f in enumerate(wrapped)), (10, 1, "MIT"), (11, 0, "MIT")]
    assert got.filter("doc_id < 10").count() == len(wrapped)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


NAMED = {
    "All human rights reserved to the people.": None, "This project is MIT licensed.": ("MIT", True), "GPLv3": ("GPL-3.0", False), "BSD 2-Clause": ("BSD", False),
    "Permission is hereby granted, free of charge, to any person": ("MIT", True), "He has an MIT degree and a driver license.": None, "All rights reserved.": ("proprietary", True),
    "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": ("AGPL-3.0", True),
    "Distributed under the Boost Software License, Version 1.0.": ("BSL-1.0", True), "This program is made available under the Eclipse Public License 2.0": ("EPL-2.0", True),
    "released under the GNU GPL version 2 or later": ("GPL-2.0", True), "The version was published by the foundation, free of charge to the general public.": None,
}


@pytest.fixture(scope="module")
def weights(spark):
    fitted = license_scan.fit_licenses(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    return spark.createDataFrame(fitted.collect(), fitted.schema)


def test_licences_and_near_misses(spark, weights):
    df = spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string")
    got = {r.doc_id: (r.family, r.confirmed) for r in license_scan.scan_licenses(df, weights).collect()}
    assert {t: got.get(k) for k, t in enumerate(NAMED)} == NAMED


def plain_scan(text: str, told: dict, start: list[float], templates: dict[str, list[set]]) -> set:
    """The scan of one text, word by word."""
    words_of = lambda t: [w for w in re.split(r"[\W_]+", t) if w]
    families, most = [license_scan.UNKNOWN, *license_scan.LICENSES], license_scan.LONGEST

    def judged(t):
        words = words_of(t.lower())
        own = set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}
        logits = [s + sum(told[g][k] for g in own if g in told) for k, s in enumerate(start)]
        k = max(range(len(logits)), key=lambda k: (logits[k], k))
        likeness = max((len(own & t) / len(t) for t in templates.get(families[k], [])), default=0)
        return families[k], round(1 / sum(math.exp(x - logits[k]) for x in logits), 6), round(likeness, 6)

    lines = [(n, x) for n, x in enumerate(text.split("\n")) if words_of(x) or not x.strip()]
    found = []
    for at, (n, line) in enumerate(lines):
        if not line.strip():
            continue
        found.append((n, n, *judged(line)))
        after, last = [], None
        for m, more in lines[at + 1 :]:
            if not more.strip() or len(after) >= most:
                break
            after, last = after + words_of(more)[:most], m
        if last is not None:
            found.append((n, last, *judged(" ".join(words_of(line)[-most:] + after[:most]))))
    found = [f for f in found if f[2] != license_scan.UNKNOWN]
    rank = lambda f: (f[4], f[0] - f[1], -f[0])
    return {(f[0], *f[2:]) for f in found if not any(g[0] <= f[1] and f[0] <= g[1] and (g[1] > g[0] or f[1] > f[0]) and rank(g) > rank(f) for g in found)}


def test_scan_equals_a_plain_one(spark, weights):
    told = {r.gram: r.weights for r in weights.collect()}
    start = told.pop("")

    def pairs(t):
        words = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        return {f"{a} {b}" for a, b in zip(words, words[1:])}

    templates = {f: [pairs(n) for n in own if pairs(n)] for f, own in license_scan.NOTICES.items()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 3000").collect()]
    rng, notices = random.Random(13), [n for own in license_scan.NOTICES.values() for n in own]
    for k in range(120):
        lines = [line for _ in range(rng.randrange(1, 4)) for line in (*textwrap.wrap(rng.choice(notices), rng.choice([20, 72, 500])), *rng.choice([[], [""], ["***"], ["some other words"], ["All of it, under the bridge."]]))]
        docs.append((10_000 + k, "\n".join(lines)))
    got: dict = {}
    for r in license_scan.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"), weights).collect():
        got.setdefault(r.doc_id, set()).add((r.paragraph, r.family, round(r.probability, 6), round(r.likeness, 6)))
    want = {d: p for d, t in docs if (p := plain_scan(t, told, start, templates))}
    assert set(got) == set(want) and len(got) > 110
    for d, own in want.items():
        assert [x[:2] for x in sorted(got[d])] == [x[:2] for x in sorted(own)] and np.allclose([x[2:] for x in sorted(got[d])], [x[2:] for x in sorted(own)], atol=1e-5)


def test_a_long_line_is_scanned_whole(spark, weights):
    long = "some words of a license and more words " * 12_000 + "Released under the MIT License. The end"
    got = license_scan.scan_licenses(spark.createDataFrame([(1, long)], "doc_id long, text string"), weights).collect()
    assert [(r.family, r.confirmed) for r in got] == [("MIT", True)]


# Decontamination


def brute_edits(item, passage):
    """The least edit distance of item to a stretch of passage, cell by cell."""
    row = [0] * (len(passage) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, p in enumerate(passage, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != p)))
        row = new
    return min(row)


def test_edit_distance_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 15)).astype(np.uint64), rng.integers(0, 6, rng.integers(0, 25)).astype(np.uint64)
        assert decontaminate.edits_of(a, b)[0] == brute_edits(a.tolist(), b.tolist())


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 7, 9, 11, 12, 14, 19, 23, 24, 31, 40, 55, 70, 80])))) for k in range(60)]
    items.append((60, items[5][1]))
    docs = []
    for k in range(240):
        words = rng.choices(vocabulary, k=rng.randrange(0, 200))
        if k % 2:
            item = rng.choice(items)[1].split()
            for _ in range(int(len(item) * rng.choice([0, 0.1, 0.2, 0.3]))):
                at = rng.randrange(len(item))
                item[at : at + rng.choice([0, 1])] = rng.choice([[], ["new"]])
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," for w in item]
        docs.append((k, " ".join(words)))
    want = {(d, i) for d, t in docs for i, b in items if brute_edits(b.split(), t.lower().replace(",", "").split()) <= len(b.split()) * 20 // 100}
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
    assert got <= want and len(got) >= 0.99 * len(want) > 100
    kept = {r.doc_id for r in decontaminate.without_leaks(d, b).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in got}


def test_items_that_tables_miss_are_met_by_runs(monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_TABLES", 1)
    rng = random.Random(12)
    items = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=n)) for n in (6, 13, 30, 50)]
    index = decontaminate.build_index([10, 11, 12, 13], items)
    assert any(isinstance(t, decontaminate.Runs) for t in index.tables)
    texts = []
    for item in items * 20:
        words = item.split()
        for at in rng.sample(range(len(words)), len(words) // 5):
            words[at] = "changed"
        texts.append("before it " + " ".join(words) + " after it")
    assert {(k, k % 4) for k in range(80)} <= set(decontaminate.held(index, texts, 20))


def test_items_in_scripts_without_spaces_and_ids_of_any_kind(spark):
    item = "水は百度で沸騰し零度で凍る"
    items = spark.createDataFrame([("a", item), ("b", item), ("c", "two words")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "前の文。" + item + "。後の文"), (2, "前の文。" + item.replace("百", "千") + "後"), (3, "水は百度"), (4, "Two, words!"), (5, "two other words")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontaminate.leaks(docs, items).collect())
    assert got == [(1, "a", 0), (1, "b", 0), (2, "a", 1), (2, "b", 1), (4, "c", 0)]


def test_a_benchmark_of_several_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "WORDS", 20)
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{n}" for n in range(8))) for k in range(6)], "item_id long, text string")
    docs = items.select((F.col("item_id") + 10).alias("doc_id"), F.concat(F.lit("so "), "text").alias("text"))
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == [(k + 10, k) for k in range(6)]
    assert decontaminate.without_leaks(docs, items).count() == 0


def test_leaks_edges(spark, odd):
    item = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "word word"), (5, item)], "item_id long, text string").withColumn("doc_id", F.lit(9))
    docs = odd.unionByName(spark.createDataFrame([(7, f"x {item.upper()}. y")] * 2, "doc_id long, text string"), allowMissingColumns=True)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()) == [(3, 4), (7, 1), (7, 1), (7, 5), (7, 5)]
    assert decontaminate.without_leaks(docs, items).count() == len(ODD) - 1
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), items).count() == 0


# Chats


def test_chats_round_trip(spark):
    wild = ["</s>[INST] ok [/INST]", "&lt;s>", "&amp;", "[INST]", "<s>user[INST]", "", None, "a\nb", LONG]
    turns = [(1, n, random.Random(n).choice(["user", "assistant", "a[b", None]), t) for n, t in enumerate(wild * 3)]
    turns += [(2, 0, "user", "same")] * 2 + [(None, 1, "assistant", "lost"), (3, None, "user", "first"), (3, 0, "assistant", "then")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "segments": F.lit(2)})
    chats = chat_format.format_chats(df)
    assert all("".join(s.text for s in r.segments) == r.formatted for r in chats.collect())
    back = {r.conv_id: r for r in chat_format.read_chats(chats).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r or "", t or "") for _, _, r, t in turns[: len(wild) * 3]]
    assert back[1].loss_text == "".join(t or "" for _, _, r, t in turns[: len(wild) * 3] if r == "assistant")
    assert [t.text for t in back[2].turns] == ["same", "same"] and back[2].formatted == "<s>user[INST]same[INST]same[/INST]</s>"
    assert [t.text for t in back[3].turns] == ["first", "then"] and back[None].loss_text == "lost"
    assert chat_format.format_chats(df.limit(0)).count() == 0


# URLs


def test_urls(spark):
    urls = [None, "", "nothing", "http://X.Example.COM/en/a?x#y", "https://www.example.com/en/", "http://a.b.net/es/", "http://net/fr/x", "http://org.de", "http://buy.cheap-pills.org/", "http://badnet/es/", "http://a.net/ES/"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(3, urls[3])], "page_id long, url string").withColumns({"rank": F.lit(1), "token": F.lit("x"), "best": F.lit(2), "regex": F.lit(None).cast("string")})
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark, url_filter.HOST_RULES, url_filter.SPAM_PATTERNS))
    rows = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()}
    assert got.count() == len(urls) + 1
    assert rows[0] == rows[1] == rows[2] == ("", "", None, "allow")
    assert rows[3] == ("x.example.com", "/en/a", "example.com/en/", "block") and rows[4] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert rows[5][2:] == ("net/es/", "block") and rows[6] == ("net", "/fr/x", "net/fr/", "block") and rows[7] == ("org.de", "", None, "allow")
    assert rows[8][2:] == (None, "block") and rows[9][2:] == (None, "allow") and rows[10][2:] == (None, "allow")
    assert url_filter.judge_urls(pages.limit(0), url_filter.rule_table(spark, [], ["*"])).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages.filter("page_id > 2"), url_filter.rule_table(spark, [], ["*"])).collect()} == {"block"}


def test_a_host_with_spaces_is_a_subdomain_too(spark):
    pages = spark.createDataFrame([(1, "http://a b.example.com/en/x"), (2, "http://com x/en/"), (3, "http://a.net /es/")], "page_id long, url string")
    got = url_filter.judge_urls(pages, url_filter.rule_table(spark, url_filter.HOST_RULES, []))
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == {1: ("example.com/en/", "block"), 2: (None, "allow"), 3: (None, "allow")}


# Pages


def text_of(page: str) -> str:
    article, main, rest = html_text.blocks_of(page)
    return " ".join(article or main or rest)


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>t</title><script>var a='</p>';</script></head><body><nav>n</nav><article><h1>A &amp; b</h1><p><b>c\n d<br>e<p>f&#233;</article><footer>z", "A & b c d e fé"),
    ("<main><header><h2>h</h2><i>by</i></header>x<div class='comments'><article>no</article></div><form>f</form>y</main>z", "h x y"),
    ("<div class=\"cookie-notice\">c</div><p hidden>h</p><p>a<span>b</span> c</p><aside>q</aside><!-- x --><p", "ab c"),
    ("<article>1 < 2 <style>p{}</style>&lt;b&gt;</article>", "1 < 2 <b>"),
    ("", ""), ("<article></article>", ""), ("plain", "plain"),
])
def test_page_text(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize("page, text", [
    ("<html><head><title>t</title><body><article><p>Hello world", "Hello world"), ("<head><title>t</title><p>one<p>two", "one two"),
    ("<head><meta charset='x'><style>a</style></head>b", "b"), ("<p>one</p><svg width=\"1\"/><p>two</p>", "one two"), ("<p>one<iframe/><p>two<iframe src='x'></iframe>", "one two"),
    ("<p>a<script src='x' />b()</script>c", "ac"), ("<p>a<svg><path d='x'/><text>no</text></svg>b", "ab"), ("<p>a<button>no<p>b<button>no</button>", "a b"),
    ("<p>a<select><option>no<p>b", "a b"), ("<title>no<body>a", "a"), ("<p>a<script>no<p>no", "a"), ("<header-x>a</header-x>", "a"),
    ("<main><p>one</p><article>card</article><p>two</p></main><p>no", "one card two"), ("<article>a</article><p>no", "a"), ("<div role=main>a<article>b</article></div>", "a b"),
])
def test_page_text_with_missing_ends_and_main_beside_article(page, text):
    assert text_of(page) == text


@pytest.mark.parametrize("page, text", [
    ('<div class="has-sidebar"><article><p>Text</p></article></div>', "Text"), ('<div class="content no-sidebar"><p>Text', "Text"),
    ('<article><div class="related-work"><p>Prior art</div></article>', "Prior art"), ('<article>Main</article><article class="comment"><p>First!</p></article>', "Main"),
    ('<p><span class="ad">buy <span>now</span> cheap</span> text', "text"), ('<div id="search"><article><p>Found</article></div>', "Found"),
    ('<div class="comments"><article>First!</article></div>', ""), ('<main>Main<div class="search"><article>card</article></div></main>', "Main"),
    ('<p class="notice">no<p>yes', "yes"), ("<ul><li class=ad>no<li>yes</ul>", "yes"), ('<div class="widget_2 ad-slot">no</div><div class="article-share">no</div><div class="adorable shared-memory">yes</div>', "yes"),
    ('<div role="navigation">no</div><section role="region">yes</section>', "yes"), ('<div class="side-bar">no</div><div class="sidebar-left">no</div>yes', "yes"),
])
def test_names_that_set_apart_and_names_that_do_not(page, text):
    assert text_of(page) == text


class PlainArticle(HTMLParser):
    """The article's text by the standard library's parser: blocks end at block-level tags, each with single spaces."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.inside, self.parts, self.blocks = 0, [], []

    def end_block(self):
        if text := " ".join(html_module.unescape("".join(self.parts)).split()):
            self.blocks.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("article", "h1", "p"):
            self.end_block()
        self.inside += tag == "article"
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p"):
            self.end_block()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_given_pages_equal_a_plain_parser(spark, name):
    pages = spark.read.parquet(f"/root/testdata/{name}/pages.parquet")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.op7_html_text(spark, f"/root/testdata/{name}").collect()}
    want = {}
    for page in pages.collect():
        plain = PlainArticle()
        plain.feed(re.sub(r"(?s)<(script|style)\b.*?</\1>", "", page.html or ""))
        plain.close()
        plain.end_block()
        want[page.page_id] = (" ".join(plain.blocks), len(" ".join(plain.blocks)))
    assert got == want and len(got) == pages.count() > 0


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(200):
        a, b = rng.choices("abcd", k=rng.randrange(9)), rng.choices("abcd", k=rng.randrange(9))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert len(html_text.common_lines(a, b)) == table[-1][-1]


def test_pages_are_differenced_with_the_nearest_url(spark):
    rows = [
        (1, "http://a.org/x/1", "<p>menu<p>one<p>foot"), (2, "http://a.org/x/2", "<p>menu<p>two<p>foot"), (3, "http://a.org/y/1", "<p>other<p>three"),
        (4, "http://b.org/x/1", "<p>menu<p>alone"), (5, "http://b.org/x/2", None), (6, None, "<p>solo"), (7, "http://c.org/1", "<article>same</article>"), (7, "http://c.org/1", "<article>same</article>"),
        (8, "http://d.org/1", "<p>copy"), (9, "http://d.org/2", "<p>copy"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"lines": F.lit(1), "text": F.lit("clash")})
    got = sorted((r.page_id, r.text) for r in html_text.extract_text(pages).collect())
    assert got == [(1, "one"), (2, "two"), (3, "other three"), (4, "menu alone"), (5, ""), (6, "solo"), (7, "same"), (7, "same"), (8, "copy"), (9, "copy")]
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_pages_with_an_article_are_differenced_too(spark):
    rows = [
        (1, "http://a.org/x/1", "<nav>Menu</nav><article><h1>Menu</h1><p>Read on<p>one<p>line</article><p>Read on<p>Menu"), (2, "http://a.org/x/2", "<nav>Menu</nav><article><p>two<p>line<p>Read on</article><p>Read on<p>Menu"),
        (3, "http://b.org/x/1", "<div class=ad>ours</div><article><p>ours</article><p>foot"), (4, "http://b.org/x/2", "<div class=ad>ours</div><main><p>foot<p>text</main><p>foot"),
    ]
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Menu one line", 2: "two line", 3: "ours", 4: "text"}


def test_what_stands_apart_is_compared_too(spark):
    page = "<title>t</title><nav><a>Home</a><p>News</nav>x<article><header><h1>H</h1>by</header><p>a <span class=ad>buy<br>now</span> b</article><footer>&copy; f"
    found, titles = html_text.sorted_blocks(page)
    assert [x for _, x in found] == ["Home", "News", "x", "H", "by", "a b", "buy now", "© f"] and titles == {"H"}
    assert [x for p, x in found if p == html_text.BESIDE] == ["Home", "News", "by", "© f"] and (html_text.NAMED, "buy now") in found
    rows = [
        (1, "http://a.org/x/1", "<nav><p>Home<p>News</nav><article><p>one<p>quoted</article><div class=ad>quoted</div><footer>foot</footer>"), (2, "http://a.org/x/2", "<nav><p>Home<p>News</nav><article><p>News</article><div class=ad>quoted</div><footer>foot</footer>"),
        (3, "http://b.org/x/1", "<p>Home<p>News<h1>Three</h1><p>three<p>foot"), (4, "http://b.org/x/2", "<nav><p>Home<p>News<p>Three</nav><main>four</main><footer>foot</footer>"),
        (5, "http://c.org/1", "<h1>Site</h1><p>five"), (6, "http://c.org/2", "<nav>Site</nav><h1>Site</h1><p>six"), (7, "http://d.org/1", "<nav>Menu</nav>"), (8, "http://d.org/2", "<nav>Menu</nav>eight"), (9, "http://e.org/1", None), (10, "http://f.org/1", "<nav>Menu</nav>ten<p>told"), (11, "http://f.org/2", "<nav>Menu</nav><div class=teaser>told</div>eleven"),
    ]
    got = {r.page_id: (r.text, r.n_shared) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("one quoted", 4), 2: ("News", 4), 3: ("Three three", 4), 4: ("four", 4), 5: ("five", 1), 6: ("six", 1), 7: ("", 1), 8: ("eight", 1), 9: ("", 0), 10: ("ten told", 2), 11: ("eleven", 2)}


def test_a_line_repeated_in_a_page_is_template_as_often_as_the_nearest_has_it():
    own, near = [8, 9, 1, 1, 2, 3, 1, 7], [8, 1, 1, 4, 9, 7]
    assert html_text.template_places([1, 1, 2, 3, 1], False, own, [0, 4, 1, 1, 1, 1, 1, 0], near, [0, 1, 1, 1, 4, 0])[1] == 4
    assert len(html_text.template_places([1, 1, 2, 3, 1], False, own, [0, 4, 1, 1, 1, 1, 1, 0], near, [0, 1, 1, 1, 4, 0])[0]) == 2


@pytest.mark.parametrize(
    "part, stays",
    [
        ('<div class="AdUnit">Buy</div>', False), ('<div class="sponsored-content__box">Buy</div>', False), ('<section id="discussion"><p>x</p></section>', False), ('<div class="user-feedback">x</div>', False),
        ('<div class="relatedStories2">x</div>', False), ('<div class="side_barLeft">x</div>', False), ('<div class="NavBar">x</div>', False), ('<div class="post-comments__list-items">x</div>', False),
        ('<div class="has-sidebar">x</div>', True), ('<div class="articleBody">x</div>', True), ('<p class="leadParagraph">x</p>', True), ('<div class="roadMap adventure">x</div>', True), ('<div class="main-content__2">x</div>', True),
    ],
)
def test_names_are_cut_where_words_meet(part, stays):
    page = f'<html><body><article><p>Main.</p>{part}</article><article class="teaser"><p>Other</p></article></body></html>'
    assert len(html_text.blocks_of(page)[0]) == 1 + stays
