"""Scalar functions of the text library, as Column expressions. Lengths are in code points."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the library's data model has it: more than Java's \s. For use inside a character class.
WS = "\\t-\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
UINT32 = 4294967295


#: The same as characters, and as a class but for those of ASCII. A class of ASCII alone is tested much faster, so
#: patterns over whole texts take that first and look at the others where a character is none of ASCII.
WS_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WIDE = WS.removeprefix("\\t-\\r ")


def trim_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def norm_title(c: Column) -> Column:
    """All white space gone; the key for equal titles."""
    return F.regexp_replace(F.regexp_replace(c, "[\\t-\\r ]+", ""), f"[^\\x00-\\x9F](?<=[{WIDE}])", "")


def count_words(c: Column) -> Column:
    """Characters that aren't white space; 0 for null."""
    return F.length(norm_title(F.coalesce(c, F.lit("")))).cast("long")


def safe_str(c: Column, most: int = 200) -> Column:
    """Control characters and < > " ' / and backslash gone; cut first, then trimmed."""
    return trim_ws(F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "[\\x00-\\x1F<>\"'\\\\/]", ""), 1, most))


def is_safe_id(c: Column) -> Column:
    return F.coalesce(c.rlike("\\A[A-Za-z0-9_-]{1,80}\\z"), F.lit(False))


def fmt_words(n: Column) -> Column:
    wan = n / F.lit(10000.0)
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("0 字"))
        .when(n >= 100000, F.concat(F.floor(wan + 0.5).cast("string"), F.lit(" 万字")))
        .when(n >= 10000, F.concat(F.format_string("%.1f", F.floor(wan * 10 + 0.5) / 10), F.lit(" 万字")))
        .otherwise(F.concat(n.cast("string"), F.lit(" 字"))))


def fmt_bytes(n: Column) -> Column:
    return (
        F.when(n >= 1 << 20, F.concat(F.format_string("%.1f", F.floor(n / F.lit(1048576.0) * 10 + 0.5) / 10), F.lit(" MB")))
        .when(n >= 1 << 10, F.concat(F.floor(n / F.lit(1024.0) + 0.5).cast("string"), F.lit(" KB")))
        .otherwise(F.concat(n.cast("string"), F.lit(" B"))))


def shorten(c: Column) -> Column:
    return F.when(F.length(c) > 64, F.concat(F.substring(c, 1, 30), F.lit("…"), F.right(c, F.lit(26)))).otherwise(c)


def parse_tags(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "[,，]"), trim_ws), lambda t: t != "")


def _codes(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))


def titles_signature(titles: Column) -> Column:
    """count:hex of a 32-bit xor hash over the titles, each followed by a line feed (code units of the BMP)."""
    mask = F.lit(UINT32).cast("long")
    step = lambda h, x: (h * 33).bitwiseXOR(x).bitwiseAND(mask)
    all_codes = F.flatten(F.transform(titles, lambda t: F.concat(_codes(t), F.array(F.lit(10).cast("long")))))
    return F.concat(F.size(titles).cast("string"), F.lit(":"), F.lower(F.hex(F.aggregate(all_codes, F.lit(5381).cast("long"), step))))


def color_bucket(title: Column, buckets: int = 8) -> Column:
    mask = F.lit(UINT32).cast("long")
    return F.aggregate(_codes(title), F.lit(0).cast("long"), lambda h, x: (h * 31 + x).bitwiseAND(mask)) % buckets


def ip_hash(ip: Column) -> Column:
    return F.left(F.sha2(F.concat(F.lit("brute:"), ip), 256), F.lit(20))


def file_token(content: Column) -> Column:
    return F.left(F.sha2(content, 256), F.lit(16))


def esc_xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def b64url(c: Column) -> Column:
    return F.rtrim(F.translate(F.base64(c), "+/=\r\n", "-_ "))


def default_title(title: Column, position: Column) -> Column:
    """A blank title becomes the chapter's number, counted from 1."""
    return F.when(trim_ws(F.coalesce(title, F.lit(""))) == "", F.concat(F.lit("第"), position.cast("string"), F.lit("章"))).otherwise(title)


def title_of_file(name: Column, number: Column) -> Column:
    bare = trim_ws(F.regexp_replace(name, "(?i)\\.(txt|text)\\z", ""))
    return F.when(bare == "", F.concat(F.lit("未命名_"), number.cast("string"))).otherwise(bare)


@lru_cache(1)
def common_han() -> str:
    """Frequent characters by rule: level 1 of GB 2312, rows 16 to 55. Callers may give a set of their own."""
    cells = (bytes([row + 0xA0, cell + 0xA0]) for row in range(16, 56) for cell in range(1, 95))
    return "".join(c.decode("gb2312", "ignore") for c in cells)


def readability(c: Column, common: str | None = None) -> Column:
    """100 * share of Han characters + 0.5 * frequent ones - 60 * replacement marks - 10 * rare Han characters."""
    count = lambda cls: F.regexp_count(c, F.lit(f"[{cls}]")).cast("double")
    score = count("\\u4E00-\\u9FFF") / F.length(c) * 100 + count(common or common_han()) * 0.5 - count("\\uFFFD") * 60 - count("\\u3400-\\u4DBF\\uF900-\\uFAFF") * 10
    return F.when(F.length(c) > 0, score).otherwise(F.lit(0.0))


def read_state(read_done: Column, ch: Column, ratio: Column, updated: Column, chapters: Column, done_ratio: float = 0.9) -> Column:
    seen = F.coalesce(updated, F.lit(0)) > 0
    cc = F.coalesce(chapters, F.lit(0))
    return (
        F.when(read_done, "done").when(~read_done, F.when(seen, "reading").otherwise("unread")).when(~seen, "unread")
        .when((ch <= 0) | (cc <= 0), "reading").when((F.least(ch, cc) >= cc) & (F.coalesce(ratio, F.lit(0.0)) >= done_ratio), "done").otherwise("reading"))


def object_parts(key: Column) -> list[Column]:
    """prefix, book id and chapter key of an object key; a chapter key may hold slashes."""
    return [
        F.regexp_extract(key, "\\A(text|raw|progress|meta)/", 1).alias("prefix"),
        F.regexp_extract(key, "\\A[a-z]+/([^/.]+)", 1).alias("book_id"),
        F.regexp_extract(key, "\\Atext/[^/]+/(.+)\\.txt\\z", 1).alias("chapter_key")]


def deletable(key: Column) -> Column:
    return key.rlike("\\A(text|raw|progress)/") & ~F.contains(key, F.lit(".."))


def new_id(seed: Column) -> Column:
    """An id of the usual form, made from a seed, so that a recomputed task gives the same one."""
    return F.concat(F.lit("n_"), F.lower(F.conv(F.left(F.sha2(seed, 256), F.lit(15)), 16, 36)))


def rfc5987(c: Column) -> Column:
    """Percent-encoding for header values: letters, digits and - _ . ! ~ stay."""
    c = F.url_encode(c)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%21", "!"), ("%7E", "~")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def b64url_decode(c: Column) -> Column:
    return F.unbase64(F.translate(c, "-_", "+/"))


def client_ip(direct: Column, forwarded: Column) -> Column:
    """The header's address, else the last of those a request was forwarded by, else 'unknown'."""
    hops = F.filter(F.transform(F.split(forwarded, ","), trim_ws), lambda x: x != "")
    return F.coalesce(F.when(direct != "", direct), F.try_element_at(hops, F.lit(-1)), F.lit("unknown"))


def clamp_chapter(x: Column, chapters: Column) -> Column:
    """A place from 0 within a book."""
    return F.greatest(F.lit(0), F.least(F.greatest(F.lit(0), chapters - 1), F.coalesce(F.floor(x), F.lit(0)))).cast("long")


def progress_badge(state: Column, ch: Column, chapters: Column, compact: bool = False) -> Column:
    first = F.least(F.coalesce(ch, F.lit(0)), F.coalesce(chapters, F.lit(0)))
    at = F.concat(first.cast("string"), F.lit("/"), chapters.cast("string"))
    return F.when(state == "unread", "").when(state == "done", "✓ 已读完").when(first <= 0, "在读").otherwise(at if compact else F.concat(F.lit("读到 "), at, F.lit(" 章")))


def head_percent(place: Column, chapters: Column) -> Column:
    """How much of a book lies before a chapter; never 100. Halves are rounded up."""
    return F.greatest(F.lit(0), F.least(F.lit(99), F.floor(place / chapters * 100 + 0.5))).cast("long")


def env_number(c: Column, default: float) -> Column:
    """A setting as a number; the default where it is none or 0."""
    n = c.try_cast("double")
    return F.coalesce(F.when((n != 0) & ~F.isnan(n), n), F.lit(float(default)))


def normal_place(ch: Column, ratio: Column) -> list[Column]:
    """ch as a whole number from 0, ratio within 0 and 1; what is no number counts as 0."""
    number = lambda c: F.when(F.isnan(c) | c.isNull(), 0.0).otherwise(c)
    whole = F.when(F.abs(ratio) == float("inf"), 0.0).otherwise(number(ratio))
    return [F.greatest(F.lit(0), F.floor(number(ch))).cast("long").alias("ch"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), whole)).alias("ratio")]
