"""Main text of web pages: what the markup settles, and page differencing with the nearest URL for what it leaves open.

Each page is read once into blocks of text, and markup says what each is: what stands in menus, page headers and footers,
asides, forms, and elements named after adverts, notices, comments and the like is set apart and never counts; what stands in
<article>, <main> or role="main" is the main text, and without such an element all other blocks, which markup leaves open,
may be. Every page is then differenced with the one nearest by URL: pages are ordered by host and path, the neighbour with
the longer common path is taken, and all blocks that both have outside of <article> and <main>, open and set apart, are
aligned by longest common subsequence, the open ones once more by themselves, as one of the two pages may have the same line
set apart as well; the shared ones are template, and each page tells how many it has. Open blocks that are template are
deleted wherever they stand: from the text of a page without <article> or <main>, and from an <article> or
<main> that repeats them (a line to share the page). Other lines of an article stay though a neighbour has them, as
neighbouring articles share lines, and so do those that only elements set apart repeat, as adverts of both pages may quote
them. On a page without an article, what the neighbour has set apart only goes too, but not its headings, as menus name the
pages next to theirs, nor what only a name sets apart there, as adverts and teasers quote other pages. Headings of an article
stay. A page whose blocks are all shared is a copy, which shows nothing: it keeps them. Blocks are compared by 64 bits of hash.

Differencing alone can't give the right text where adverts and menus differ from page to page or neighbouring articles
share lines; README has figures.

Defined results: null or empty html has an empty text; a null URL, or one without `://`, has an empty host and path;
pages of one URL are neighbours in the order of their ids; a tag cut off at the end of the page is dropped; <head> hides
nothing itself, so its end tag may be left out; a self-closed unseen element is empty (but a text up to its own end tag
next is dropped); one without an end tag ends at the next block-level tag, <script> and <style> at the end of the page;
repeated rows are returned as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import map_batches, written
from palimpsest.llm.url_filter import url_parts
from palimpsest.session import table

# Element names of HTML by what they mean here.
UNSEEN = "script style noscript template svg textarea select button iframe object canvas title audio video".split()
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
APART = set("nav footer aside form dialog menu fieldset".split())
STRUCTURE = APART | set("body article main section div header ul ol dl table blockquote figure details td".split())
BLOCK = STRUCTURE | set("p h1 h2 h3 h4 h5 h6 li dt dd tr th caption pre hr address figcaption summary center legend html thead tbody tfoot".split())
#: Elements that a second one of their kind ends.
SINGLE = set("li dt dd td th tr option".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Names in class or id that set an element apart: the name itself, or with PARTS before and after it.
NAMES = """ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion nav navbar navigation
menu breadcrumb breadcrumbs footer masthead sidebar side-bar aside cookie cookies consent gdpr notice notification alert popup modal overlay
newsletter subscribe subscription share sharing social comment comments replies reply disqus discussion discussions feedback teaser teasers related recommend recommended recommendation
recommendations widget login signup search pagination pager paywall""".split()
PARTS = """bar box block banner container wrapper wrap section area list item items links link form panel area unit slot block module inner
outer content body top bottom left right main site page global header foot primary secondary post posts article articles story stories
footer menu nav message text title widget group row thread feed button buttons icons media site user cookie newsletter social share
stories tags""".split()
ROLES = set("navigation contentinfo complementary search banner alert alertdialog dialog menu menubar form".split())
#: Where a block stands: in <article>; in <main>; in neither; in an <article> or <main> that a name sets apart; apart by a name; apart by what it is in.
ARTICLE, MAIN, OPEN, WITHIN, NAMED, BESIDE = range(6)
JOINTS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[-_]+|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_NAMES, _PARTS = set(NAMES) | {n.replace("-", "") for n in NAMES}, set(PARTS)


def _named(name: str) -> bool:
    """Whether a class or id says that its element stands apart: cut at case changes, digits, - and _, it has one of NAMES and besides only PARTS and numbers."""
    words = [w.lower() for w in JOINTS.split(name) if w]
    words = [*words, *(a + b for a, b in zip(words, words[1:]) if a + b in _NAMES and not {a, b} & _NAMES)]
    joined = {x for a, b in zip(words, words[1:]) if a + b in _NAMES for x in (a, b)}
    return any(w in _NAMES for w in words) and all(w in _NAMES or w in _PARTS or w in joined or w.isdigit() for w in words)


TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z) | <(?P<unseen>{"|".join(UNSEEN)})(?=[\s/>])(?P<own>(?:"[^"]*"|'[^']*'|[^'">])*)>
    | <(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*)> | <[!?][^>]*> | <[/!?a-zA-Z][^>]*\Z | (?P<text>[^<]+|<)""",
    re.S | re.X | re.I,
)
#: Either tag of an unseen element, and the tags that end one whose own end tag is missing.
SAME = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*>", re.I) for tag in UNSEEN}
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in UNSEEN}
BREAKS = re.compile(rf"</?(?:head|{'|'.join(sorted(BLOCK))})(?=[\s/>])", re.I)
SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/$""")
LABEL = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
MAIN_ROLE = re.compile(r"""role\s*=\s*["']?main\b""", re.I)
COMMENTS = re.compile("comment|repl(?:y|ies)|disqus|discussion|feedback", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)


def _stands_apart(tag: str, rest: str) -> int:
    """3 for an element that stands apart as what it is, 2 by a name in its class or id that says so; a name of what is in it or beside it (has-sidebar) does not."""
    if tag in APART:
        return 3
    if not rest:
        return 0
    if HIDDEN.search(rest):
        return 3
    if tag in ("body", "html", "main"):
        return 0
    by_name = 0
    for kind, value in LABEL.findall(rest):
        for name in value.strip("\"'").split():
            if kind.lower() == "role":
                if name.lower() in ROLES:
                    return 3
            elif _named(name):
                if COMMENTS.search(name):
                    return 3
                by_name = 2
    return by_name


def _after_unseen(page: str, tag: str, own: str, at: int, endless: set[str]) -> int:
    """Where the page goes on after an unseen element whose start tag ends at `at`; endless holds the tags that end no more."""
    if SELF_CLOSED.search(own):
        following = page.find("<", at)
        end = ENDS[tag].match(page, following) if tag != "svg" and following >= 0 else None
        return end.end() if end else at
    if tag not in endless:
        end = (SAME if tag in ("button", "select") else ENDS)[tag].search(page, at)  # these two don't nest: a second one ends the first
        if end and (tag not in ("button", "select") or end[1]):
            return end.end()
        if not end:
            endless.add(tag)
    broken = None if tag in ("script", "style") else BREAKS.search(page, at)
    return broken.start() if broken else len(page)


def _tokens(page: str) -> Iterator[re.Match]:
    """The page's tokens, without unseen elements."""
    at, endless = 0, set()
    while at < len(page):
        for token in TOKEN.finditer(page, at):
            if token["unseen"]:
                at = _after_unseen(page, token["unseen"].lower(), token["own"], token.end(), endless)
                break
            yield token
        else:
            return


def blocks_of(page: str) -> tuple[list[str], list[str], list[str]]:
    """The blocks in <article>, if any with those of <main> beside it; those in <main> alone; the others; none of what stands apart."""
    found = sorted_blocks(page)[0]
    which = text_places(found)
    settled, rest = [x for p, x in found if p in which and p != OPEN], [x for p, x in found if p == OPEN]
    return ([], settled, rest) if which == {MAIN} else (settled, [x for p, x in found if p == MAIN], rest)


def text_places(found: list[tuple[int, str]]) -> set[int]:
    """Where the blocks stand that are the page's text, or may be.

    An <article> or <main> inside an element that only its name sets apart (but not as comments) counts where the page
    has no other text.
    """
    have = {p for p, _ in found}
    return have & {ARTICLE, MAIN} or have & {OPEN} or {WITHIN}


def sorted_blocks(page: str) -> tuple[list[tuple[int, str]], set[str]]:
    """All blocks in page order, each with where it stands, and the texts of headings that don't stand apart."""
    found: list[tuple[int, str]] = []
    stack: list[tuple[str, int, int]] = []  # tag, how it stands (0 open, 1 only headings, 2 apart by its name, 3 apart), which list
    stands, place, heading, parts, named, beside, titles = 0, OPEN, 0, [], [], [], set()

    def close() -> None:
        for texts, where in ((parts, place), (named, NAMED), (beside, BESIDE)):
            if texts:
                text = " ".join(html.unescape("".join(texts)).split())
                if text:
                    found.append((where, text))
                    if heading and where < NAMED:
                        titles.add(text)
                texts.clear()

    def pop(n: int) -> None:
        nonlocal stands, place
        del stack[n:]
        stands, place = stack[-1][1:] if stack else (0, OPEN)

    for token in _tokens(page):
        text = token["text"]
        if text is not None:
            (parts if not stands or stands == 1 and heading else named if stands == 2 else beside).append(text)
            continue
        tag = token["tag"]
        if tag is None:
            continue
        tag, rest = tag.lower(), token["rest"]
        if token["end"]:
            if tag in BLOCK:
                close()
            if tag in HEADINGS:
                heading = 0
            if tag in STRUCTURE or stack and stack[-1][0] == tag:
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] == tag:
                        pop(n)
                        break
            continue
        if tag == "head":
            continue
        if tag == "br":
            for texts in (parts, named, beside):
                texts.append(" ")
            continue
        if tag in BLOCK:
            close()
            if stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in SINGLE):
                pop(len(stack) - 1)
        if tag in HEADINGS:
            heading = 1
        if tag in VOID or rest.endswith("/") and tag not in STRUCTURE:
            continue
        apart = _stands_apart(tag, rest)
        nested = tag not in STRUCTURE and any(tag == s[0] for s in stack)  # its end must not end an outer one that stands apart
        if tag in STRUCTURE or apart or nested:
            if apart:
                stands = 3 if apart == 3 or stands == 3 else 2
            elif tag == "header":
                stands = max(stands, 1 if place < OPEN else 3)
            is_main = tag == "main" or bool(rest and MAIN_ROLE.search(rest))
            if stands == 2 and not apart and (tag == "article" or is_main):
                stands, place = 0, WITHIN
            elif tag == "article" and not stands and place != WITHIN:
                place = ARTICLE
            elif place == OPEN and is_main:
                place = MAIN
            stack.append((tag, stands, place))
    close()
    return found, titles


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of one longest common subsequence with b: the longest rise through the places of equal lines, between equal ends."""
    first, last = 0, 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    ends = {*range(first), *range(len(a) - last, len(a))}
    where: dict[str, list[int]] = {}
    for n, line in enumerate(b[first : len(b) - last]):
        where.setdefault(line, []).append(n)
    tops: list[int] = []
    chain: list[tuple[int, tuple | None]] = []
    for n, line in enumerate(a[first : len(a) - last], first):
        for at in reversed(where.get(line, ())):
            k = bisect_left(tops, at)
            link = (n, chain[k - 1] if k else None)
            if k == len(tops):
                tops.append(at)
                chain.append(link)
            else:
                tops[k], chain[k] = at, link
    link = chain[-1] if chain else None
    while link:
        ends.add(link[0])
        link = link[1]
    return ends


def template_places(blocks: list[int], settled: bool, own: list[int], marks: list[int], near: list[int], near_marks: list[int]) -> tuple[list[int], int]:
    """Which of the page's blocks are template, and how many of its lines outside the main text the nearest page has too."""
    common = common_lines(own, near)
    if not common:
        return [], 0
    open_here = [n for n, mark in enumerate(marks) if mark == 1 or mark & 1 and not settled]
    open_there = [x for x, mark in zip(near, near_marks) if mark & 1]
    apart_there = {x for x, mark in zip(near, near_marks) if mark in (0, 2)}.difference(open_there)
    template = {open_here[k] for k in common_lines([own[n] for n in open_here], open_there)}
    template |= {n for n in common if marks[n] == 1 and own[n] in apart_there}
    if settled:
        lines = {own[n] for n in template}
        gone = [n for n, x in enumerate(blocks) if x in lines]
    else:
        place = {n: k for k, n in enumerate(n for n, mark in enumerate(marks) if mark & 1)}
        gone = sorted(place[n] for n in template)
    return gone if len(gone) < len(blocks) else [], len(common)


def _hashed(blocks: str) -> Column:
    return F.transform(blocks, lambda x: F.xxhash64(x))


def _parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path, blocks, settled, lines, marks, row).

    blocks is the main text, or what may be it; lines are hashes of all blocks outside of it (if markup has settled it; else
    of those too), marks have 1 for a line that markup leaves open, 2 for the text of a heading, 4 for what only a name sets apart.
    """
    host, path = url_parts(F.col("url"))

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        blocks, settled, lines, marks = [], [], [], []
        for page in batch.column(4).to_pylist():
            found, titles = sorted_blocks(page or "")
            which = text_places(found)
            outside = [(p, x) for p, x in found if p == OPEN or p not in which]
            blocks.append([x for p, x in found if p in which])
            settled.append(OPEN not in which)
            lines.append([x for _, x in outside])
            marks.append([(p == OPEN) + 2 * (x in titles) + 4 * (p in (WITHIN, NAMED)) for p, x in outside])
        texts = [pa.array(blocks, pa.list_(pa.string())), pa.array(settled, pa.bool_()), pa.array(lines, pa.list_(pa.string())), pa.array(marks, pa.list_(pa.int8()))]
        return pa.RecordBatch.from_arrays([*batch.columns[:4], *texts], names=["page_id", "url", "host", "path", "blocks", "settled", "lines", "marks"])

    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"), "html")
    kind = f"page_id {dict(pages.dtypes)['page_id']}, url string, host string, path string, blocks array<string>, settled boolean, lines array<string>, marks array<tinyint>"
    return map_batches(rows, read, kind, rows=64).withColumns({"lines": _hashed("lines"), "row": F.monotonically_increasing_id()})


def _shared(parsed: DataFrame) -> DataFrame:
    """(row, gone, n_shared) of the pages that share lines with the nearest page: the places of their blocks that are template, and the number of shared lines."""
    order, own = ["host", "path", "page_id"], ["settled", "lines", "marks"]
    ranked = parsed.select(*order, "row", _hashed("blocks").alias("mine"), *own).repartitionByRange(*order).sortWithinPartitions(*order)
    ranked = written(ranked.withColumn("n", F.monotonically_increasing_id()), "ranked", "zstd")  # partition, then row within it
    part = F.shiftright("n", 33).alias("part")
    sizes = {r.part: r.rows for r in ranked.groupBy(part).agg(F.count("*").alias("rows")).collect()}  # a number a partition
    before, at = [], 0
    for k in sorted(sizes):
        before.append((k, at - (k << 33)))
        at += sizes[k]
    shift = parsed.sparkSession.createDataFrame(before, "part long, shift long")
    placed = ranked.withColumn("part", F.shiftright("n", 33)).join(F.broadcast(shift), "part").withColumn("at", F.col("n") + F.col("shift"))
    placed = placed.filter(F.size("lines") > 0)
    near = placed.select(F.col("at").alias("next"), F.col("host").alias("near_host"), F.col("path").alias("near_path"))
    sides = placed.select("at", "host", "path", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side")).withColumn("next", F.col("at") + F.col("side"))
    both = sides.join(near, "next").filter(F.col("host") == F.col("near_host"))
    alike = F.size(F.filter(F.sequence(F.lit(1), F.length("path") + 1), lambda k: F.left("path", k) == F.left("near_path", k)))
    chosen = both.groupBy("at").agg(F.max(F.struct(alike.alias("rank"), (-F.col("side")).alias("side"))).alias("best")).select("at", (F.col("at") - F.col("best.side")).alias("next"))
    paired = chosen.join(placed.select(F.col("at").alias("next"), F.col("lines").alias("near"), F.col("marks").alias("near_marks")), "next").join(placed.select("at", "row", "mine", *own), "at")

    def gone(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, places, shared = [], [], []
        for row, *pair in zip(*(c.to_pylist() for c in batch.columns)):
            template, n = template_places(*pair)
            if n:
                rows.append(row)
                places.append(template)
                shared.append(n)
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(shared, pa.int64())], names=["row", "gone", "n_shared"])

    return map_batches(paired.select("row", "mine", *own, "near", "near_marks"), gone, "row long, gone array<int>, n_shared long")


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_shared) of pages(page_id, url, html); n_shared is the number of its blocks that the nearest page has outside its main text too."""
    parsed = written(_parsed(pages), "parsed", "zstd")
    shared = written(_shared(parsed), "shared", "zstd")
    own = F.when(F.size("gone") > 0, F.filter("blocks", lambda x, n: ~F.array_contains("gone", n))).otherwise(F.col("blocks"))
    return parsed.join(shared, "row", "left").select("page_id", "url", F.array_join(own, " ").alias("text"), F.coalesce("n_shared", F.lit(0).cast("long")).alias("n_shared"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    text = extract_text(table(spark, sf_dir, "pages"))
    return text.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared")
