"""Front matter, feeds, archives, byte pages; text functions on literals."""

from __future__ import annotations

import itertools
import zipfile

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import markup as M
from palimpsest.functions import text as X
from palimpsest.operators.overlay import VersionedTable
from palimpsest.sources import files


def test_posts_survive_writing_and_reading(spark, tmp_path):
    values = ["plain", 'quote " inside', "back\\slash", "two\nlines", "tab\t", "colon: x", "", "# no comment"]
    bodies = ["", "# Title\n\nText\n", "--- \nnot an end"]
    rows = [(k + 1, {"post_title": v, "post_status": "publish"}, [(f"k{k}", v), ("again", "1")], b) for k, (v, b) in enumerate(itertools.product(values, bodies))]
    posts = spark.createDataFrame(rows, "id bigint, fields map<string,string>, meta array<struct<meta_key:string,meta_value:string>>, body string")
    for r in files.rendered(posts).collect():
        folder = tmp_path / (f"{r.id}-slug" if r.id % 2 else "")
        folder.mkdir(exist_ok=True)
        (folder / ("index.md" if r.id % 2 else f"{r.id}-x.md")).write_bytes((r.text.replace("\n", "\r\n") if r.id % 3 == 0 and "\n" not in rows[r.id - 1][3] else r.text).encode())
    (tmp_path / "notes.md").write_text("no id")
    got = {r.id: r for r in files.read_posts(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and not any(r.error for r in got.values())
    for k, fields, meta, body in rows:
        assert got[k].fields == fields and [(m.meta_key, m.meta_value) for m in got[k].meta] == meta and got[k].body == body
    assert files.post_meta(files.read_posts(spark, str(tmp_path))).count() == 2 * len(rows)


@pytest.mark.parametrize("text", ["---\ntitle: 'x\n---\n", '---\ntitle: "a\\q"\n---\n', "---\nno value\n---\n", "---\ntitle: x\n"])
def test_a_bad_post_is_a_row_with_its_error(spark, tmp_path, text):
    (tmp_path / "7-bad.md").write_text(text)
    (row,) = files.read_posts(spark, str(tmp_path)).collect()
    assert row.id == 7 and row.slug == "bad" and row.error and row.body is None


def test_plus_front_matter_and_blank_lines(spark, tmp_path):
    (tmp_path / "1.md").write_text('+++\ntitle = "A"\n[[meta]]\nkey = "k"\nvalue = "v"\n+++\n\n\nBody')
    (row,) = files.read_posts(spark, str(tmp_path)).collect()
    assert row.fields == {"title": "A"} and row.body == "Body" and row.meta[0].meta_key == "k"


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>One</title><wp:post_id xmlns:wp='w'>5</wp:post_id></item><item><title>Two</title></item></channel></rss>")
    assert sorted((r.title, r.post_id) for r in files.read_feed(spark, str(tmp_path / "feed.xml")).collect()) == [("One", "5"), ("Two", None)]


def test_archives_keep_to_themselves(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/one.txt", "1")
        z.writestr("../out.txt", "2")
        z.writestr("in/", "")
    assert [(r.entry, bytes(r.content)) for r in files.read_archives(spark, str(tmp_path)).collect()] == [("in/one.txt", b"1")]


def test_pages_under_an_overlay(spark, tmp_path):
    (tmp_path / "db").write_bytes(b"a" * 4096 + b"b" * 4096 + b"c" * 10)
    base = files.byte_pages(spark, str(tmp_path / "db"))
    t = VersionedTable(base, ("path", "page_no")).update(F.col("page_no") == 2, {"bytes": F.lit(b"new")})
    assert [(r.page_no, bytes(r.bytes)[:3]) for r in t.read().orderBy("page_no").collect()] == [(1, b"aaa"), (2, b"new"), (3, b"ccc")]
    assert base.count() == 3


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


@pytest.mark.parametrize("title, slug", [("Hello, World!", "hello-world"), ("---", "post"), ("Ünï", "n"), ("a  b", "a-b"), ("", "post")])
def test_slug(spark, title, slug):
    assert one(spark, X.slug(F.col("t")), t=title) == slug


@pytest.mark.parametrize("path, good", [("/a/b", True), ("a", False), ("/a//b", False), ("/a/../b", False), ("/.", False), ("/.x/...", True), ("/", False)])
def test_tree_path(spark, path, good):
    assert one(spark, X.is_tree_path(F.col("p")), p=path) is good


def test_parents(spark):
    assert one(spark, X.parents(F.col("p")), p="/a/b/c") == ["/a", "/a/b"] and one(spark, X.parents(F.col("p")), p="/a") == []


def test_serialized_values_keep_their_lengths(spark):
    old = 'a:2:{s:1:"u";s:8:"http://a";s:1:"n";a:1:{i:0;s:13:"x http://a/é ";}}'.replace("s:13", f"s:{len('x http://a/é '.encode())}")
    got = one(spark, X.rewrite_serialized(F.col("v"), "http://a", "https://bb"), v=old)
    assert got == 'a:2:{s:1:"u";s:10:"https://bb";s:1:"n";a:1:{i:0;s:16:"x https://bb/é ";}}'
    assert one(spark, X.rewrite_serialized(F.col("v"), "a", "b"), v="author: a") == "buthor: b"


def test_links_and_active_content(spark):
    page = '<a class="x" href="/p?q">1</a><script>x</script><a onclick="f()" href="b">2</a>'
    assert one(spark, M.links(F.col("p")), p=page) == ["/p?q", "b"]
    assert one(spark, M.without_active(F.col("p")), p=page) == '<a class="x" href="/p?q">1</a><a href="b">2</a>'
    base = "http://h.org/d/page.html?x"
    for href, full in (("b", "http://h.org/d/b"), ("/b", "http://h.org/b"), ("//o.org/", "http://o.org/"), ("#t", base + "#t"), ("mailto:x", "mailto:x")):
        assert one(spark, X.absolute(F.col("h"), F.col("p")), h=href, p=base) == full


@pytest.mark.parametrize("page, clean", [
    ("<p>turn onto=left now</p>", "<p>turn onto=left now</p>"), ("<a href='javascript:x()'>a</a>", "<a>a</a>"), ('<a href="java&#x09;script:x()" id=b>a</a>', "<a id=b>a</a>"),
    ("<img src=x onerror=boom() alt='a > b'>", "<img src=x alt='a > b'>"), ('<p title="set onclick=1">t</p>', '<p title="set onclick=1">t</p>'), ("<p ONCLICK = 'x' >t</p><SCRIPT src=y></SCRIPT>", "<p >t</p>"),
    ("a < b <!-- <script>no</script> -->", "a < b <!-- <script>no</script> -->"), ("<script>never ends", ""),
])
def test_only_tags_are_cleaned(spark, page, clean):
    assert one(spark, M.without_active(F.col("p")), p=page) == clean


def test_attributes(spark):
    get = lambda tag, name: one(spark, M.attribute(F.col("t"), name), t=tag)
    assert get("<a HREF='/x y' b>", "href") == "/x y" and get("<a href=/x>", "href") == "/x" and get("<a b>", "b") == "" and get("<a data-href='x'>", "href") is None
    assert one(spark, M.links(F.col("p")), p="<a href='x'>1</a><A HREF=y>2</A><abbr href='no'><script>'<a href=no>'</script>") == ["x", "y"]
    assert one(spark, M.with_attribute_where_missing(F.col("p"), "img", "loading", "lazy"), p='<img src="a"><img loading=eager><p>img</p><img/>') == '<img src="a" loading="lazy"><img loading=eager><p>img</p><img loading="lazy"/>'
    assert one(spark, M.with_nonce(F.col("p"), "n1"), p="<style>a>b</style><script src='x' nonce=old>1<2</script>") == "<style nonce=\"n1\">a>b</style><script src='x' nonce=\"n1\">1<2</script>"
    assert one(spark, M.with_srcset(F.col("p"), [480, 768]), p="<img src='p.jpg'>") == "<img src='p.jpg' srcset=\"p.jpg?w=480 480w, p.jpg?w=768 768w\">"
    assert one(spark, M.without_attribute(F.col("t"), "rel"), t="<a rel=x title=' rel=y ' rel>") == "<a title=' rel=y '>"


def test_entities(spark):
    assert one(spark, M.decoded(F.col("t")), t="AT&amp;T &mdash; 100&percnt; &#x1F600;&#233; &amp;lt; &nope; & &#0; &#xD800; &#99999999;") == "AT&T — 100% 😀é &lt; &nope; & &#0; &#xD800; &#99999999;"


def test_references_are_decoded_once_as_a_browser_does(spark):
    import html

    t = "&#38;lt; &eacute;&colon; &#106 &#x6a; &copy2 &notit; &NotEqualTilde; &fjlig; &amp;amp; &AMP &#128; &#x80 &lt;&lt &; &&amp; &#; &#x; &unknown; &ampx"
    assert one(spark, M.decoded(F.col("t")), t=t) == html.unescape(t)
    assert one(spark, M.decoded(F.col("t"), True), t="?a=1&copy=2&copy;&ltx&lt&reg.") == "?a=1&copy=2©&ltx<®."


@pytest.mark.parametrize("tag, clean", [
    ('<a href="javascript&colon;alert(1)">', "<a>"), ('<use xlink:href="javascript:x" id=u>', "<use id=u>"), ('<object data="javascript:x"></object>', "<object></object>"), ('<iframe srcdoc="<script>x</script>" title=t>', "<iframe title=t>"),
    ('<a href="&#106avascript:alert(1)">', "<a>"), ("<img/onerror=alert(1) src=x>", "<img src=x>"), ('<a href=" java\nscript&Tab;:x">', "<a>"), ('<a href="data:text/html,x" class="k">', '<a class="k">'), ("<body onload>", "<body>"),
    ('<meta http-equiv=refresh content="0;url=javascript:x">', "<meta http-equiv=refresh>"), ('<a href="/x?u=javascript:y" title="on=1">', '<a href="/x?u=javascript:y" title="on=1">'), ("<a href=/x/y/z>", "<a href=/x/y/z>"), ('<img src="data:image/png;base64,AA"/>', '<img src="data:image/png;base64,AA"/>'),
    ('<p dir two=\'2\' / three >', '<p dir two=\'2\' / three >'),
])
def test_addresses_that_run_scripts_go(spark, tag, clean):
    assert one(spark, M.without_active(F.col("p")), p=tag) == clean


def test_elements_and_what_stands_around_them(spark):
    page = "<article><figure><img src=1><figcaption>x</figcaption></figure><p>t <img src=2></p><figure><img src=3></figure></article>"
    rows = M.elements(spark.createDataFrame([(1, page)], "k long, html string"), "k", "html")
    assert [(r.tag, r.depth) for r in rows.orderBy("pos").collect()] == [("article", 0), ("figure", 1), ("img", 2), ("figcaption", 2), ("p", 1), ("img", 2), ("figure", 1), ("img", 2)]
    assert [r.html for r in M.inside(rows, "k", "figure", "img").orderBy("pos").collect()] == ["<img src=1>", "<img src=3>"]


def test_blocks(spark):
    text = '<!-- wp:heading --><h2>a</h2><!-- /wp:heading --><!-- wp:group {"a":1} --><!-- wp:heading {"level":4} --><h4>b</h4><!-- /wp:heading --><!-- wp:my/quote {"n":5} /--><!-- /wp:group --><!-- wp:heading {"level":3} -->c<!-- /wp:heading -->'
    rows = M.block_rows(spark.createDataFrame([(1, text)], "k long, c string"), "k", "c")
    assert [(r.name, r.depth, r.void) for r in rows.orderBy("pos").collect()] == [("core/heading", 0, False), ("core/group", 0, False), ("core/heading", 1, False), ("my/quote", 1, True), ("core/heading", 0, False)]
    assert [(r.level, r.before) for r in M.skipped_levels(M.heading_levels(rows, "k"), "k").collect()] == [(4, 2)]


def test_nested_serialized_values(spark):
    inner = 's:10:"http://old"'
    got = one(spark, X.rewrite_serialized(F.col("v"), "http://old", "https://newer"), v=f's:{len(inner) + 1}:"{inner};";')
    assert got == 's:21:"s:13:"https://newer";";'


def test_maps_encodings_and_names(spark):
    assert one(spark, X.patched(F.create_map(F.lit("a"), F.col("x"), F.lit("b"), F.col("x")), F.create_map(F.lit("b"), F.col("y"))), x="1", y="2") == {"a": "1", "b": "2"}
    assert one(spark, X.sorted_keys(F.create_map(F.lit("ccc"), F.col("x"), F.lit("b"), F.col("x"), F.lit("aa"), F.col("x"))), x="1") == ["b", "aa", "ccc"]
    assert one(spark, X.salvaged(F.unhex(F.col("h"))), h="636166E9") == "café" == one(spark, X.salvaged(F.unhex(F.col("h"))), h="636166C3A9")
    assert one(spark, X.scrubbed(F.unhex(F.col("h"))), h="61FF62") == "a\ufffdb"
    assert [one(spark, X.has_noncharacters(F.col("t")), t=t) for t in ("a", "\ufdd0", "\uffff", "\U0001fffe", "\U0001f600")] == [False, True, True, True, False]
    assert one(spark, X.local_date(F.col("t"), "+02:00"), t="2024-01-31 23:30:00") == "2024-02-01 01:30:00" and one(spark, X.local_date(F.col("t"), "+02:00"), t="0000-00-00 00:00:00") == "0000-00-00 00:00:00"
    assert [one(spark, X.is_branch_name(F.col("t")), t=t) for t in ("dev", "-x", "HEAD", "a/b", "x" * 65)] == [True, False, False, False, False]
    assert one(spark, X.looks_serialized(F.col("t")), t="a:0:{}") and not one(spark, X.looks_serialized(F.col("t")), t="author: x")
    assert one(spark, X.basename(F.col("t")), t="/a/b") == "b" and one(spark, X.joined(F.col("t"), F.col("n")), t="/a/", n="/b") == "/a/b" and one(spark, X.is_slug(F.col("t")), t="a-b1")
    assert [one(spark, X.is_server_path(F.col("t")), t=t) for t in ("/.git/x", "/a/db.sqlite-wal", "/a/b.php")] == [True, True, False]


def test_pages_past_the_end_are_zeros(spark, tmp_path):
    (tmp_path / "db").write_bytes(b"a" * 8)
    base = files.byte_pages(spark, str(tmp_path / "db"), 4)
    wanted = base.select("path").distinct().withColumn("page_no", F.explode(F.array(F.lit(2), F.lit(9))))
    assert [bytes(r.bytes) for r in files.pages_at(base, wanted, 4).orderBy("page_no").collect()] == [b"aaaa", b"\0\0\0\0"]


def test_lists_of_names_are_the_callers(spark):
    known = dict(reserved=["www", "admin", "api", "mail", "localhost", "wp"], longest=63, any_case=True, first="a-zA-Z0-9_-")  # fixed values: hosts that a router of branches keeps
    good = lambda n: one(spark, X.is_branch_name(F.col("n"), **known), n=n)
    assert [good(n) for n in ("WWW", "wp", "Admin", "x" * 64, "", "a.b")] == [False] * 6 and all(good(n) for n in ("main", "-x", "_y", "x" * 63, "www2"))
    owned = ["content/db.php", "content/database/", "meta.json"]
    mine = lambda p: one(spark, X.is_server_path(F.col("p"), owned), p=p)
    assert mine("content/db.php") and mine("content/database/x/y") and not mine("content/db.php.bak") and not mine("content/databases/x") and not mine("a/.git/b")


def test_fnv_and_transforms(spark):
    def plain(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        return f"{h:016x}"

    for t in ("", "a", "foobar", "été 日本 😀" * 9):
        assert one(spark, X.fnv1a(F.col("t")), t=t) == plain(t.encode())
    df = spark.createDataFrame([("a", 1)], "t string, n int")
    assert X.transformed(df, {"t": F.upper, "n": lambda c: c + 1, "gone": F.lower}).collect()[0] == ("A", 2)
