"""XML tokens, names and edits against the standard library's parser."""

from __future__ import annotations

import random
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from palimpsest.functions import xml as X

DOC = """<?xml version="1.0"?>
<!DOCTYPE a [<!ENTITY x "y">]><a xmlns="urn:d" xmlns:p="urn:p" k="1"><!-- <b> --><p:b p:k='two &amp; "2"' xml:lang="en" xmlns:p="urn:q"><c xmlns="" p:k="3"/><![CDATA[<c>]]></p:b ><p:b k = "4">t &lt; u</p:b><e/></a>"""


def frame(spark, *docs):
    return spark.createDataFrame(list(enumerate(docs)), "id long, x string")


def test_tokens_join_to_the_document_and_names_are_resolved(spark):
    df = frame(spark, DOC, None, "", "<a><b></a>")
    rows = X.tokens(df, "id", "x")
    assert "".join(r.token for r in rows.filter("id = 0").orderBy("pos").collect()) == DOC
    some = X.elements(rows.filter("id = 0"), "id")
    got = [(r.namespace, r.local, r.depth) for r in X.element_names(some, "id").orderBy("pos").collect()]
    assert got == [("urn:d", "a", 0), ("urn:q", "b", 1), (None, "c", 2), ("urn:p", "b", 1), ("urn:d", "e", 1)]
    names = {(r.namespace, r.local, r.value) for r in X.attribute_names(some, "id").collect()}
    assert names == {(None, "k", "1"), ("urn:q", "k", 'two & "2"'), (X.XML, "lang", "en"), ("urn:q", "k", "3"), (None, "k", "4")}


def test_edits_leave_the_rest_as_it_was(spark):
    df = frame(spark, DOC, None)
    some = X.elements(X.tokens(df, "id", "x"), "id")
    edits = X.attribute_names(some, "id").filter("namespace = 'urn:q' and local = 'k'").select("id", "pos", "at", F.concat("value", F.lit('<&"')).alias("value"))
    got = {r.id: r.x for r in X.with_values(df, "id", "x", edits).collect()}
    assert got == {0: DOC.replace("""p:k='two &amp; "2"'""", 'p:k="two &amp; &quot;2&quot;&lt;&amp;&quot;"').replace('p:k="3"', 'p:k="3&lt;&amp;&quot;"'), 1: None}


def test_random_documents_equal_a_parser(spark):
    rng, docs = random.Random(9), []

    def make(depth):
        own = "".join(f' xmlns{rng.choice(["", ":p", ":q"])}="urn:{rng.randrange(4)}"' for _ in range(rng.choice([0, 0, 1])))
        tag, attrs = rng.choice(["a", "p:b", "q:c"]), rng.choice(["", ' p:k="v"', " k='w'"])
        inner = "".join(make(depth + 1) if rng.random() < 0.6 else rng.choice(["text", "&lt;", ""]) for _ in range(3)) if depth < 4 else ""
        return f"<{tag}{own}{attrs}>{inner}</{tag}>" if inner or rng.random() < 0.5 else f"<{tag}{own}{attrs}/>"

    for _ in range(12):
        docs.append(f'<r xmlns:p="urn:p" xmlns:q="urn:q">{make(0)}{make(0)}</r>')
    some = X.elements(X.tokens(frame(spark, *docs), "id", "x"), "id")
    got = {}
    for r in X.element_names(some, "id").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(f"{{{r.namespace}}}{r.local}" if r.namespace else r.local)
    assert got == {k: [e.tag for e in ET.fromstring(d).iter()] for k, d in enumerate(docs)}
    held = sorted((r.id, f"{{{r.namespace}}}{r.local}" if r.namespace else r.local, r.value) for r in X.attribute_names(some, "id").collect())
    assert held == sorted((k, n, v) for k, d in enumerate(docs) for e in ET.fromstring(d).iter() for n, v in e.attrib.items())


def test_outlines(spark):
    opml = '<opml version="2.0"><body><outline text="A &amp; B"><outline text="x" type="rss" xmlUrl="http://x/"/><outline text="y"><outline text="z"/></outline></outline><outline text="last"/></body></opml>'
    rows = X.outlines(frame(spark, opml), "id", "x").orderBy("pos").collect()
    assert [(r.level, r.text, r.url) for r in rows] == [(0, "A & B", None), (1, "x", "http://x/"), (1, "y", None), (2, "z", None), (0, "last", None)]
    at = {r.pos: r.text for r in rows}
    assert [at.get(r.parent) for r in rows] == [None, "A & B", "A & B", "y", None]
