"""Markup as tokens: tags are told from text, scripts and comments first, and edits reach only inside the tags they name.

All of it is Spark expressions: a page is cut into an array of pieces, pieces are changed one by one and joined again, so
whatever is not changed stays byte for byte. Attribute values may stand in double quotes, single quotes or none; names
are compared without case. A null page stays null.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = r"""(?is)<script\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</script\s*>|\z)|<style\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)|</?[a-z](?:"[^"]*"|'[^']*'|[^'">])*>|[^<]+|<"""
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
#: The names that HTML gives characters; those without a semicolon may be written so.
NAMED = html5
_BARE = sorted((n for n in NAMED if not n.endswith(";")), key=lambda n: (-len(n), n))
#: What numbers from 128 to 159 stand for: characters of Windows' code page, where it has one.
_WINDOWS = {n: c for n in range(128, 160) if (c := bytes([n]).decode("cp1252", "ignore"))}


def pieces(html: Column) -> Column:
    """Tags, comments, texts, and whole scripts and styles, in order; joined they are the page."""
    return F.regexp_extract_all(html, F.lit(PIECES), F.lit(0))


def _is(piece: Column, tag: str) -> Column:
    return piece.rlike(rf"(?i)^<{tag}(?=[\s/>])")


def edited(html: Column, tag: str, change: Callable[[Column], Column]) -> Column:
    """The page with `change` applied to each start tag of that name (a regular expression); of a script or style the tag alone is changed."""
    def one(p: Column) -> Column:
        head = F.regexp_extract(p, r"""(?s)^<(?:"[^"]*"|'[^']*'|[^'">])*>""", 0)
        return F.when(_is(p, tag), F.concat(change(head), F.substr(p, F.length(head) + 1))).otherwise(p)

    return F.array_join(F.transform(pieces(html), one), "")


def attribute(tag: Column, name: str) -> Column:
    """The value of a start tag's attribute: null where it has none, empty where it has no value."""
    found = F.regexp_extract_all(tag, F.lit(rf"""(?is)[\s"']{name}(?:\s*=\s*({_VALUE}))?(?=[\s/>])"""), F.lit(1))
    return F.regexp_replace(F.get(found, F.lit(0)), r"""^["']|["']$""", "")


def without_attribute(tag: Column, name: str) -> Column:
    """The start tag without attributes of that name, a regular expression; their like inside other values stays."""
    parts = F.regexp_extract_all(tag, F.lit(rf"""(?s)\s+[^\s=>"'/]+\s*=\s*{_VALUE}|[^\s]+|\s+"""), F.lit(0))
    gone = rf"(?is)^\s+(?:{name})\s*=.*$"
    kept = F.array_join(F.filter(parts, lambda p: ~p.rlike(gone)), "")
    return F.regexp_replace(kept, rf"(?i)\s+(?:{name})(?=\s*/?>$)", "")


def with_attribute(tag: Column, name: str, value: Column | str) -> Column:
    """The start tag with the attribute set; & and double quotes of the value are escaped."""
    value = F.lit(value) if isinstance(value, str) else value
    coded = F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    bare = without_attribute(tag, name)
    end = F.regexp_extract(bare, r"\s*/?>$", 0)
    return F.concat(F.substr(bare, F.lit(1), F.length(bare) - F.length(end)), F.lit(f' {name}="'), coded, F.lit('"'), end)


def with_attribute_where_missing(html: Column, tag: str, name: str, value: str) -> Column:
    return edited(html, tag, lambda t: F.when(attribute(t, name).isNull(), with_attribute(t, name, value)).otherwise(t))


def with_nonce(html: Column, nonce: str) -> Column:
    """Scripts and styles stamped for a content security policy."""
    return edited(html, "(?:script|style)", lambda t: with_attribute(t, "nonce", nonce))


def with_srcset(html: Column, widths: list[int]) -> Column:
    """Images that have a src and no srcset get one, a query of each width."""
    def change(t: Column) -> Column:
        src = attribute(t, "src")
        made = F.concat_ws(", ", *[F.concat(src, F.lit(f"?w={w} {w}w")) for w in widths])
        return F.when(src.isNotNull() & attribute(t, "srcset").isNull(), with_attribute(t, "srcset", made)).otherwise(t)

    return edited(html, "img", change)


def links(html: Column) -> Column:
    """The href values of a page's anchors, in order, entities left as they are."""
    anchors = F.filter(pieces(html), lambda p: _is(p, "a"))
    return F.filter(F.transform(anchors, lambda t: attribute(t, "href")), lambda h: h.isNotNull())


#: A start tag's name, its attributes one by one with what parts them from the one before, and whatever else it has.
_ATTRIBUTES = rf"""(?s)^<[a-zA-Z][^\s/>]*|[\s/]+[^\s=>/"'][^\s=>/]*(?:\s*=\s*{_VALUE})?|[\s/]*/?>$|."""


def without_active(html: Column) -> Column:
    """The page without scripts, on* handlers, documents inside attributes, and attributes of any name whose address runs a script; texts are left alone.

    Addresses are read as a browser does: references decoded, control characters and white space passed over.
    """
    def runs(attribute: Column) -> Column:
        name = F.lower(F.regexp_extract(attribute, r"""^[\s/]+([^\s=>/]+)""", 1))
        value = F.regexp_replace(F.regexp_extract(attribute, rf"(?s)=\s*({_VALUE})$", 1), r"""^["']|["']$""", "")
        plain = F.lower(F.regexp_replace(decoded(value, True), r"[\x00-\x20\x7f]+", ""))
        address = plain.rlike(r"^(?:javascript|vbscript|livescript):|^data:(?:text/html|image/svg|application/xhtml|text/xml)")
        refreshed = (name == "content") & plain.rlike(r"url=['\"]?(?:javascript|vbscript|data):")
        return name.rlike(r"^on[a-z]") | (name == "srcdoc") | address | refreshed

    def clean(p: Column) -> Column:
        parts = F.regexp_extract_all(p, F.lit(_ATTRIBUTES), F.lit(0))
        kept = F.filter(parts, lambda x: ~(x.rlike(r"^[\s/]+[^\s=>/]") & runs(x)))
        return F.when(p.rlike("^<[a-zA-Z]") & ~_is(p, "style"), F.array_join(kept, "")).otherwise(p)

    return F.array_join(F.transform(F.filter(pieces(html), lambda p: ~_is(p, "script")), clean), "")


def decoded(text: Column, attribute: bool = False) -> Column:
    """Character references decoded in one pass: numbers, and HTML's names, the old ones without a semicolon too; what is none stays.

    In an attribute's value, an old name before `=`, a letter or a digit is none, so that ?a=1&copy=2 stays.
    """
    bare = "|".join(_BARE) if not attribute else "(?:" + "|".join(_BARE) + ")(?![=a-zA-Z0-9])"
    parts = F.regexp_extract_all(text, F.lit(rf"(?s)&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[a-zA-Z][a-zA-Z0-9]*;|&(?:{bare})|[^&]+|&"), F.lit(0))
    named = F.map_from_arrays(F.lit(list(NAMED)), F.lit(list(NAMED.values())))  # constants, made once
    windows = F.map_from_arrays(F.lit(list(_WINDOWS)), F.lit(list(_WINDOWS.values())))

    def one(p: Column) -> Column:
        point = F.when(p.rlike("^&#[xX]"), F.conv(F.regexp_extract(p, "^&#[xX]0*([0-9a-fA-F]{1,8});?$", 1), 16, 10)).otherwise(F.regexp_extract(p, "^&#([0-9]+);?$", 1))
        code = point.try_cast("int")
        good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        number = F.coalesce(F.when(code.between(128, 159), F.try_element_at(windows, code)), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        old = F.regexp_extract(p, rf"^&({'|'.join(_BARE)})", 1) if not attribute else F.lit("")
        longer = F.when(old != "", F.concat(F.try_element_at(named, old), F.substr(p, F.length(old) + 2)))
        name = F.coalesce(F.try_element_at(named, F.substr(p, F.lit(2))), longer, p)
        return F.when(p.rlike("^&#"), F.when(F.coalesce(good, F.lit(False)), number).otherwise(p)).when(p.rlike("^&[a-zA-Z]"), name).otherwise(p)

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, one), "")).otherwise(text)


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, tag, depth, html): the start tags of each page in order, with how many elements are open around each.

    Depth is a running count of starts less ends; elements that have no end tag by definition open nothing. Ends that HTML
    lets a page leave out are not supplied.
    """
    void = r"(?i)^<(?:area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr)(?=[\s/>])|/>$"
    rows = pages.select(key, F.posexplode(pieces(F.col(html))).alias("pos", "html")).filter("html rlike '^</?[a-zA-Z]'")
    step = F.when(F.col("html").startswith("</"), -1).when(F.col("html").rlike(void) | F.col("html").rlike(r"(?is)^<(?:script|style)\b"), 0).otherwise(1)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0)).cast("long"))
    return rows.filter("html not like '</%'").select(key, F.col("pos").cast("long").alias("pos"), F.lower(F.regexp_extract("html", "^<([a-zA-Z][^\\s/>]*)", 1)).alias("tag"), "depth", "html")


def inside(rows: DataFrame, key: str, outer: str, tag: str) -> DataFrame:
    """Of elements() rows, those of `tag` directly in an `outer`: the latest element before them one level up is one."""
    opens = rows.select(key, (F.col("depth") + 1).alias("level"), "pos", F.col("tag").alias("above"))
    own = rows.withColumn("level", F.col("depth"))
    before = Window.partitionBy(key, "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    both = own.unionByName(opens, allowMissingColumns=True).withColumn("outer", F.last("above", ignorenulls=True).over(before))
    return both.filter((F.col("tag") == tag) & (F.col("outer") == outer)).select(rows.columns)


def block_rows(posts: DataFrame, key: str, content: str) -> DataFrame:
    """(key, pos, name, attrs, depth, void): the blocks of each post in order, `core/` before names that have no owner, with how many are open around each."""
    mark = F.lit(r"(<!--\s+/?wp:[a-z][a-z0-9_/-]*\s+(?:\{.*?\}\s+)?/?-->)")
    rows = posts.select(key, F.posexplode(F.regexp_extract_all(content, mark, F.lit(1))).alias("pos", "c"))
    closing, void = F.col("c").rlike(r"^<!--\s+/wp:"), F.col("c").rlike(r"/-->$")
    step = F.when(closing, -1).when(void, 0).otherwise(1)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"depth": F.coalesce(F.sum(step).over(before), F.lit(0)).cast("long"), "void": void, "closing": closing})
    name = F.regexp_extract("c", r"wp:([a-z][a-z0-9_/-]*)", 1)
    full = F.when(name.contains("/"), name).otherwise(F.concat(F.lit("core/"), name))
    return rows.filter("not closing").select(key, F.col("pos").cast("long").alias("pos"), full.alias("name"), F.nullif(F.regexp_extract("c", r"(?s)(\{.*\})", 1), F.lit("")).alias("attrs"), "depth", "void")


def skipped_levels(levels: DataFrame, key: str) -> DataFrame:
    """Of headings (key, pos, level), those more than one level below the one before (below none: level 1 is expected), with that one's level."""
    before = F.coalesce(F.lag("level").over(Window.partitionBy(key).orderBy("pos")), F.lit(1))
    return levels.withColumn("before", before.cast("int")).filter("level > before + 1")


def heading_levels(blocks: DataFrame, key: str) -> DataFrame:
    """(key, pos, level) of the heading blocks of block_rows(); level 2 where none is said."""
    return blocks.filter("name = 'core/heading'").select(key, "pos", F.coalesce(F.get_json_object("attrs", "$.level").cast("int"), F.lit(2)).alias("level"))


def stale_embeds(blocks: DataFrame, hosts: list[str]) -> DataFrame:
    """The embed blocks of block_rows() whose url is at one of the hosts or below it."""
    host = F.lower(F.try_parse_url(F.get_json_object("attrs", "$.url"), F.lit("HOST")))
    at = [(host == h) | host.endswith(f".{h}") for h in hosts]
    some = blocks.filter("name = 'core/embed'").withColumn("host", host)
    return some.filter(F.exists(F.array(*at), lambda x: x)) if hosts else some.limit(0)
