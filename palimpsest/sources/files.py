"""Files as tables: front-matter documents, content feeds, archives, byte pages. Spark lists and reads; Python decodes one file at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POST = "id bigint, slug string, fields map<string,string>, meta array<struct<meta_key:string,meta_value:string>>, body string, error string"
_NAME = re.compile(r"(?:^|/)(\d+)(?:-([^/]+?))?(?:\.md|/index\.md)$")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "\\": "\\", '"': '"', "'": "'"}


def _value(raw: str) -> str:
    raw = raw.strip()
    if raw[:1] not in ("'", '"'):
        return raw
    if len(raw) < 2 or raw[-1] != raw[0]:
        raise ValueError("no closing quote")

    def plain(m: re.Match) -> str:
        if m[1] not in _ESCAPES:
            raise ValueError(f"unknown escape \\{m[1]}")
        return _ESCAPES[m[1]]

    return re.sub(r"\\(.)", plain, raw[1:-1], flags=re.S)


def parse_post(text: str) -> tuple[dict[str, str], list[tuple[str, str]], str]:
    """(fields, meta rows, body) of a document with front matter between --- (key: value) or +++ (key = value) lines."""
    text = text.replace("\r\n", "\n")
    first = text.split("\n", 1)[0].strip()
    if first not in ("---", "+++"):
        return {}, [], text
    head, mark, body = text[len(first) + 1 :].partition(f"\n{first}\n")
    if not mark:
        raise ValueError("front matter has no end")
    fields: dict[str, str] = {}
    meta: list[dict[str, str]] = []
    into = fields
    for line in head.split("\n"):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        if line == "[[meta]]":
            meta.append({})
            into = meta[-1]
            continue
        key, sep, value = line.partition("=" if first == "+++" else ":")
        if not sep:
            raise ValueError(f"no value in {line!r}")
        into[_value(key)] = _value(value)
    return fields, [(m.get("key", ""), m.get("value", "")) for m in meta], body.lstrip("\n")


def read_posts(spark: SparkSession, root: str) -> DataFrame:
    """(path, id, slug, fields, meta, body, error) of every <id>[-slug].md or <id>[-slug]/index.md below root; a bad file is a row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    return parsed_posts(files.select("path", "content"))


def parsed_posts(files: DataFrame) -> DataFrame:
    """read_posts() for files(path, content) that come from elsewhere: names that are no post's are passed over."""
    named = files.filter(F.col("path").rlike(_NAME.pattern) & ~F.col("path").rlike(r"/\.[^/]*(/|$)")).select("path", "content")

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content):
                name = _NAME.search(path)
                try:
                    fields, meta, body = parse_post(bytes(content).decode("utf-8"))
                    rows.append((path, int(name[1]), name[2], fields, [{"meta_key": k, "meta_value": v} for k, v in meta], body, None))
                except (ValueError, UnicodeDecodeError) as wrong:
                    rows.append((path, int(name[1]), name[2], {}, [], None, str(wrong)))
            yield pd.DataFrame(rows, columns=["path", "id", "slug", "fields", "meta", "body", "error"])

    return named.mapInPandas(parsed, f"path string, {POST}")


def post_meta(posts: DataFrame) -> DataFrame:
    """The meta rows, numbered in the order of posts and of each post's file."""
    flat = posts.select("id", F.posexplode("meta").alias("place", "m"))
    return flat.select(F.col("id").alias("post_id"), F.col("place").cast("long").alias("place"), "m.meta_key", "m.meta_value")


def rendered(posts: DataFrame) -> DataFrame:
    """(id, text): the canonical text of posts(id, fields, meta, body), keys in order, values quoted."""

    def quoted(c):
        for plain, coded in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            c = F.replace(c, F.lit(plain), F.lit(coded))
        return F.concat(F.lit('"'), c, F.lit('"'))

    fields = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit(": "), quoted(e["value"]), F.lit("\n")))
    meta = F.transform("meta", lambda m: F.concat(F.lit("[[meta]]\nkey: "), quoted(m["meta_key"]), F.lit("\nvalue: "), quoted(m["meta_value"]), F.lit("\n")))
    text = F.concat(F.lit("---\n"), F.array_join(fields, ""), F.array_join(meta, ""), F.lit("---\n"), F.coalesce("body", F.lit("")))
    return posts.select("id", text.alias("text"))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """The items of an RSS content feed, a row each, columns named without prefixes."""
    items = spark.read.format("xml").option("rowTag", "item").option("ignoreNamespace", "true").option("excludeAttribute", "true").option("inferSchema", "false").load(path)
    return items


ITEM = "post_id bigint, title string, post_type string, content string"


def feed_items(posts: DataFrame) -> DataFrame:
    """(post_id, item): each post of posts(post_id, title, post_type, content) as an item element of a feed."""
    return posts.select("post_id", F.to_xml(F.struct("post_id", "title", "post_type", "content"), {"rowTag": "item"}).alias("item"))


def read_items(items: DataFrame) -> DataFrame:
    """The posts back from item elements."""
    return items.select(F.from_xml("item", ITEM, {"rowTag": "item"}).alias("p")).select("p.*")


def pages_at(pages: DataFrame, wanted: DataFrame, size: int = 4096) -> DataFrame:
    """wanted(path, page_no) with the bytes of pages; a page past the end, or one that nobody wrote, is all zeros."""
    found = wanted.join(pages, ["path", "page_no"], "left")
    return found.select("path", "page_no", F.coalesce("bytes", F.unhex(F.lit("00" * size))).alias("bytes"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, entry, size, content) of the files in zip archives; entries that climb out of the archive are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, content in zip(batch.path, batch.content):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    for info in z.infolist():
                        parts = info.filename.replace("\\", "/").split("/")
                        if not info.is_dir() and ".." not in parts and not info.filename.startswith("/"):
                            yield pd.DataFrame({"archive": [archive], "entry": [info.filename], "size": [info.file_size], "content": [z.read(info)]})

    return files.mapInPandas(entries, "archive string, entry string, size bigint, content binary")


def byte_pages(spark: SparkSession, path: str, size: int = 4096) -> DataFrame:
    """(path, page_no, bytes) of files, pages numbered from 1: the base of a VersionedTable keyed by (path, page_no)."""
    files = spark.read.format("binaryFile").load(path)
    n = F.ceil(F.length("content") / size).cast("int")
    pages = files.filter("length > 0").select("path", "content", F.explode(F.sequence(F.lit(1), n)).alias("page_no"))
    return pages.select("path", "page_no", F.substring("content", (F.col("page_no") - 1) * size + 1, F.lit(size)).alias("bytes"))
