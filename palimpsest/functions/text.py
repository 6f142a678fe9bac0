"""Column functions over text, paths, URLs, and the formats that the versioned tables carry."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def slug(title: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 made one hyphen, none at the ends; `post` if nothing is left."""
    made = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(made == "", "post").otherwise(made)


def is_slug(text: Column) -> Column:
    return F.coalesce(text.rlike("^[a-z0-9]+(-[a-z0-9]+)*$"), F.lit(False))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parents(path: Column) -> Column:
    """All folders above a path, the uppermost first: /a/b/c has /a and /a/b."""
    parts = F.split(F.trim(path, F.lit("/")), "/")
    deep = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(deep, lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")))


def is_tree_path(path: Column) -> Column:
    """Absolute, without empty, `.` or `..` segments and without a null character."""
    return F.coalesce(path.rlike(r"^(/(?!\.{1,2}(/|$))[^/\x00]+)+$"), F.lit(False))


def is_server_path(path: Column, owned: list[str] | None = None) -> Column:
    """Paths that belong to the server that runs a site, not to the site: those that `owned` names, whole folders by a slash at the end; or else its own folder, version control, database files."""
    if owned is not None:
        at = [path.startswith(o) if o.endswith("/") else path == o for o in owned]
        return F.coalesce(F.exists(F.array(*at), lambda x: x), F.lit(False)) if at else F.lit(False)
    return F.coalesce(path.rlike(r"(^|/)(\.git|\.server|node_modules)(/|$)|\.(sqlite|db)(-wal|-shm|-journal)?$"), F.lit(False))


#: Names that no branch may have, where the caller gives no others.
RESERVED = ["HEAD", "main", "master", "origin", "refs", "new"]


def is_branch_name(name: Column, reserved: list[str] = RESERVED, longest: int = 64, any_case: bool = False, first: str = "a-zA-Z0-9") -> Column:
    """Letters, digits, `-` and `_` after one of `first`, so many at most, and no reserved name (with `any_case`, in any case)."""
    plain = F.lower(name).isin([r.lower() for r in reserved]) if any_case else name.isin(reserved)
    return F.coalesce(name.rlike(f"^[{first}][a-zA-Z0-9_-]{{0,{longest - 1}}}$") & ~plain, F.lit(False))


def is_identifier(name: Column) -> Column:
    return F.coalesce(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), F.lit(False))


def joined(folder: Column, name: Column) -> Column:
    return F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), F.regexp_replace(name, "^/+", ""))


def url_host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def with_placeholder(text: Column, site: str, mark: str = "{{SITE}}") -> Column:
    """The site's own address made a mark, so that rows compare equal between sites; with_address puts one back."""
    return F.replace(text, F.lit(site.rstrip("/")), F.lit(mark))


def with_address(text: Column, site: str, mark: str = "{{SITE}}") -> Column:
    return F.replace(text, F.lit(mark), F.lit(site.rstrip("/")))


def is_machine_option(name: Column) -> Column:
    """Option names that belong to one site: its addresses and its transients."""
    return name.isin("siteurl", "home") | name.startswith("_transient_") | name.startswith("_site_transient_")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no built-in for it. Plain ASCII is passed through."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def looks_serialized(text: Column) -> Column:
    return F.coalesce((F.length(text) >= 2) & text.rlike(r"^(N;|[bid]:[^;]*;|s:\d+:\"|[aO]:\d+:)"), F.lit(False))


def _rewrite_value(data: bytes, at: int, old: bytes, new: bytes) -> tuple[bytes, int]:
    """One serialized value from `at` on with its strings rewritten and their lengths set right, and where it ends."""
    kind = data[at : at + 2]
    if kind == b"N;":
        return kind, at + 2
    if kind in (b"b:", b"i:", b"d:", b"r:", b"R:"):
        end = data.index(b";", at) + 1
        return data[at:end], end
    if kind == b"s:":
        colon = data.index(b":", at + 2)
        size, begin = int(data[at + 2 : colon]), colon + 2
        if data[colon + 1 : begin] != b'"' or data[begin + size : begin + size + 2] != b'";':
            raise ValueError("string length")
        inner = data[begin : begin + size]
        try:  # a string that is itself a serialized value, to its end
            text, end = _rewrite_value(inner, 0, old, new)
            if end != len(inner):
                text = inner.replace(old, new)
        except (ValueError, IndexError):
            text = inner.replace(old, new)
        return b's:%d:"%s";' % (len(text), text), begin + size + 2
    if kind in (b"a:", b"O:"):
        head_end = data.index(b":{", at) + 2
        head, n, out = data[at:head_end], int(data[at:head_end].rsplit(b":", 2)[-2]), [data[at:head_end]]
        at = head_end
        for _ in range(2 * n):
            part, at = _rewrite_value(data, at, old, new)
            out.append(part)
        if data[at : at + 1] != b"}":
            raise ValueError(f"no end after {head!r}")
        return b"".join(out) + b"}", at + 1
    raise ValueError(f"unknown value {kind!r}")


def rewrite_serialized(text: Column, old: str, new: str) -> Column:
    """old made new in plain texts and, at any depth, in the strings of serialized ones, whose lengths stay right."""

    @F.pandas_udf(T.StringType())
    def rewritten(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or old not in t:
                return t
            try:
                out, end = _rewrite_value(t.encode(), 0, old.encode(), new.encode())
                if end == len(t.encode()):
                    return out.decode()
            except (ValueError, IndexError):
                pass
            return t.replace(old, new)

        return texts.map(one)

    return rewritten(text)


def headings(html: Column) -> Column:
    """The levels of a page's headings, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<h([1-6])[\s>]"), F.lit(1)), lambda h: h.cast("int"))


def absolute(href: Column, page: Column) -> Column:
    """A link as an absolute address, seen from its page."""
    site = F.regexp_extract(page, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", 0)
    folder = F.regexp_replace(F.regexp_extract(page, "^[^?#]*", 0), "[^/]*$", "")
    return (
        F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(page, "^[^:]*:", 0), href))
        .when(href.startswith("/"), F.concat(site, href)).when(href.startswith("#"), F.concat(F.regexp_extract(page, "^[^#]*", 0), href))
        .otherwise(F.concat(folder, href))
    )


def patched(left: Column, right: Column) -> Column:
    """Two maps in one; where both have a key, the right one's value counts."""
    kept = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def sorted_keys(m: Column) -> Column:
    """A map's keys, shorter ones first, equally long ones by their bytes."""
    return F.transform(F.array_sort(F.transform(F.map_keys(m), lambda k: F.struct(F.octet_length(k).alias("n"), k.alias("k")))), lambda s: s["k"])


@F.pandas_udf(T.StringType())
def _float_text(number: pd.Series) -> pd.Series:
    def text(x: float) -> str:
        if x != x or x in (float("inf"), float("-inf")):
            return "NAN" if x != x else "INF" if x > 0 else "-INF"
        short = f"{x:.15G}"
        return "0" if x == 0 else short if float(short) == x else f"{x:.17G}"

    return number.map(text)


def float_text(number: Column) -> Column:
    """Doubles as decimal text that reads back the same: 15 digits where they do, else 17; NAN, INF, -INF; 0 for either zero."""
    return F.when(number.isNotNull(), _float_text(number))


def scrubbed(data: Column) -> Column:
    """Bytes as text, every invalid part made U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def salvaged(data: Column) -> Column:
    """Bytes as text: as UTF-8 where they are valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(data, "ISO-8859-1"))


def has_noncharacters(text: Column) -> Column:
    """Whether a text holds a code point that Unicode keeps free for good: U+FDD0 to U+FDEF, or the last two of a plane."""
    last_two = "".join(f"\\x{{{plane:X}FFFE}}\\x{{{plane:X}FFFF}}" for plane in range(17))
    return text.rlike(f"[\\x{{FDD0}}-\\x{{FDEF}}{last_two}]")


def local_date(gmt: Column, zone: str) -> Column:
    """A GMT date and time as text, in a site's own zone; what is no date stays."""
    at = F.try_to_timestamp(gmt, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm:ss"), gmt)


def fnv1a(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a text's bytes, in hex: for keys that others have made so; two halves, as a product of 64 bits overflows."""
    digits, low = F.hex(F.encode(text, "UTF-8")), F.lit(0xFFFFFFFF)
    octets = F.transform(F.filter(F.regexp_extract_all(digits, F.lit("(..)"), F.lit(1)), lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("long"))

    def step(h: Column, octet: Column) -> Column:
        right = h["low"].bitwiseXOR(octet)
        product = right * 435  # the prime is 2 ** 40 + 435
        high = h["high"] * 435 + F.shiftright(product, 32) + right * 256
        return F.struct(high.bitwiseAND(low).alias("high"), product.bitwiseAND(low).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).alias("high"), F.lit(0x84222325).alias("low"))
    return F.aggregate(octets, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0"))))


def transformed(rows: DataFrame, changes: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """rows with the caller's functions put over columns, so that states of two sites compare; columns that rows lacks are passed over."""
    return rows.withColumns({c: change(F.col(f"`{c}`")) for c, change in changes.items() if c in rows.columns})
