"""XML as rows of tokens, with names resolved by the namespaces in scope, edited in place.

A document is cut by one expression into tags, texts, comments, sections and instructions; joined they are the document.
Depth is a running count of tags, an element's end the next tag of its own depth. A declaration holds from its element's
start to its end, so a prefix means what the innermost declaration around it says: a join by document and prefix, kept to
those whose range holds the token, and the latest of them. Edits change values inside the tokens they name; all else
stays byte for byte.

Defined results: a null document has no tokens and stays null when edited; a prefix that nothing declares has a null
namespace; names without a prefix have the default namespace as elements and none as attributes; what is not well-formed
is cut as far as it goes; references in values are decoded for &lt; &gt; &quot; &apos; &amp; and numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.markup import decoded

_NAME = r"[^\s/>=<\"']+"
_VALUE = r"\"[^\"]*\"|'[^']*'"
TOKENS = rf"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?:[^<>\[]|\[[^\]]*\])*>|</{_NAME}\s*>|<{_NAME}(?:\s+{_NAME}\s*=\s*(?:{_VALUE}))*\s*/?>|[^<]+|<"
ATTRIBUTE = rf"(?s)(\s+{_NAME}\s*=\s*(?:{_VALUE}))"
#: Fixed value: the namespace that the prefix xml always has.
XML = "http://www.w3.org/XML/1998/namespace"


def tokens(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, pos, kind, name, depth, token): kind is start, empty, end, text, cdata, comment or other; name as written; how many elements are open around it."""
    t = F.col("token")
    rows = docs.select(key, F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(f"({TOKENS})"), F.lit(1))).alias("pos", "token"))
    tag = t.rlike(rf"^</?{_NAME}") & ~t.rlike(r"^<[!?]")
    kind = F.when(tag & t.startswith("</"), "end").when(tag & t.endswith("/>"), "empty").when(tag, "start").when(t.startswith("<![CDATA["), "cdata").when(t.startswith("<!--"), "comment").when(t.startswith("<?") | t.startswith("<!"), "other").otherwise("text")
    rows = rows.withColumns({"kind": kind, "name": F.when(tag, F.regexp_extract(t, rf"^</?({_NAME})", 1))})
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.sum(step).over(before), F.lit(0))
    return rows.withColumn("depth", (open_before - F.when(F.col("kind") == "end", 1).otherwise(0)).cast("long")).select(key, F.col("pos").cast("long").alias("pos"), "kind", "name", "depth", "token")


def elements(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, until, name, depth, token) of the elements among tokens(): where each begins and the place of its end."""
    tags = rows.filter(F.col("kind").isin("start", "empty", "end"))
    following = F.lead("pos").over(Window.partitionBy(key, "depth").orderBy("pos"))
    until = F.when(F.col("kind") == "empty", F.col("pos")).otherwise(F.coalesce(following, F.lit(1 << 62)))
    return tags.withColumn("until", until).filter("kind <> 'end'").select(key, "pos", "until", "name", "depth", "token")


def attributes(some: DataFrame, key: str) -> DataFrame:
    """(key, pos, at, attribute, value, written) of elements(): each attribute, the at-th of its tag, decoded and as it stands there."""
    each = some.select(key, "pos", F.posexplode(F.regexp_extract_all("token", F.lit(ATTRIBUTE), F.lit(1))).alias("at", "written"))
    raw = F.regexp_extract("written", rf"(?s)=\s*({_VALUE})$", 1)
    value = decoded(F.substr(raw, F.lit(2), F.length(raw) - 2))
    return each.select(key, "pos", "at", F.regexp_extract("written", rf"^\s+({_NAME})", 1).alias("attribute"), value.alias("value"), "written")


def _split(name: Column) -> tuple[Column, Column]:
    parts = F.split(name, ":", 2)
    return F.when(F.size(parts) == 2, parts[0]).otherwise(F.lit("")), F.element_at(parts, -1)


def _declared(some: DataFrame, key: str) -> DataFrame:
    """(key, prefix, uri, since, until) of the declarations in elements()."""
    own = attributes(some, key).filter(F.col("attribute").rlike("^xmlns(:|$)"))
    prefix = F.when(F.col("attribute") == "xmlns", "").otherwise(F.substr("attribute", F.lit(7)))
    return own.join(some.select(key, "pos", "until"), [key, "pos"]).select(key, prefix.alias("prefix"), F.col("value").alias("uri"), F.col("pos").alias("since"), "until")


def _resolved(named: DataFrame, some: DataFrame, key: str, name: str, by_default: bool) -> DataFrame:
    """named(key, pos, ...) with `namespace` and `local` of a name."""
    prefix, local = _split(F.col(name))
    rows = named.withColumns({"_prefix": prefix, "local": local, "_row": F.struct(*named.columns)})
    scope = _declared(some, key).alias("d")
    on = (F.col(f"r.{key}") == F.col(f"d.{key}")) & (F.col("r._prefix") == F.col("d.prefix")) & (F.col("d.since") <= F.col("r.pos")) & (F.col("r.pos") <= F.col("d.until"))
    if not by_default:
        on = on & (F.col("r._prefix") != "")
    best = rows.alias("r").join(scope, on, "left").groupBy("r._row", "r.local", "r._prefix").agg(F.max_by("d.uri", "d.since").alias("uri"))
    space = F.when(F.col("_prefix") == "xml", F.lit(XML)).otherwise(F.nullif("uri", F.lit("")))
    return best.select("_row.*", space.alias("namespace"), "local")


def element_names(some: DataFrame, key: str) -> DataFrame:
    """elements() with namespace and local name."""
    return _resolved(some, some, key, "name", True)


def attribute_names(some: DataFrame, key: str) -> DataFrame:
    """attributes() of elements() with namespace and local name; declarations are none."""
    return _resolved(attributes(some, key).filter(~F.col("attribute").rlike("^xmlns(:|$)")), some, key, "attribute", False)


def with_values(docs: DataFrame, key: str, xml: str, edits: DataFrame) -> DataFrame:
    """docs(key, xml) with the values of edits(key, pos, at, value) put into their attributes; &, < and the double quote are escaped, the rest of a document is as it was."""
    rows = tokens(docs, key, xml)
    some = attributes(elements(rows, key), key).join(edits.select(key, "pos", "at", F.col("value").alias("new")), [key, "pos", "at"])
    coded = F.replace(F.replace(F.replace("new", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    head = F.regexp_extract("written", rf"^(\s+{_NAME}\s*=\s*)", 1)
    by_tag = some.groupBy(key, "pos").agg(F.map_from_entries(F.collect_list(F.struct("at", F.concat(head, F.lit('"'), coded, F.lit('"'))))).alias("_new"))
    parts = F.regexp_extract_all("token", F.lit(ATTRIBUTE), F.lit(1))
    name, end = F.regexp_extract("token", rf"^<{_NAME}", 0), F.regexp_extract("token", r"\s*/?>$", 0)
    made = F.concat(name, F.array_join(F.transform(parts, lambda p, k: F.coalesce(F.try_element_at("_new", k), p)), ""), end)
    changed = rows.join(by_tag, [key, "pos"], "left").withColumn("token", F.when(F.col("_new").isNotNull(), made).otherwise(F.col("token")))
    whole = changed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]), "").alias("_xml"))
    return docs.join(whole, key, "left").withColumn(xml, F.coalesce("_xml", xml)).drop("_xml")


def outlines(docs: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, pos, level, parent, text, type, url) of the outlines of OPML documents: how deep each is nested, 0 at the top, and which outline it lies in."""
    tags = tokens(docs, key, xml).filter("name = 'outline'")
    step = F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", -1).otherwise(0)
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    some = tags.withColumn("level", F.coalesce(F.sum(step).over(before), F.lit(0)).cast("long")).filter("kind <> 'end'")
    said = attributes(some, key).groupBy(key, "pos").agg(F.map_from_entries(F.collect_list(F.struct(F.lower("attribute").alias("k"), "value"))).alias("a"))
    opens = some.filter("kind = 'start'").select(key, "pos", (F.col("level") + 1).alias("level"), F.col("pos").alias("opened"))
    so_far = Window.partitionBy(key, "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)  # the last one up that began before
    placed = some.select(key, "pos", "level").unionByName(opens, allowMissingColumns=True).withColumn("parent", F.last("opened", ignorenulls=True).over(so_far)).filter("opened is null")
    get = lambda k: F.try_element_at("a", F.lit(k))
    return placed.join(said, [key, "pos"], "left").select(key, "pos", "level", "parent", get("text").alias("text"), get("type").alias("type"), get("xmlurl").alias("url"))
