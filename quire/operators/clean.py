"""Cleaning rules for raw book text, as one Column expression; the order of the rules is part of the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import WIDE, WS


@dataclass(frozen=True)
class CleanOptions:
    strip_ref_marks: bool = True
    strip_markdown: bool = True
    clean_garbled: bool = True
    collapse_blank: bool = True
    strip_site: bool = True
    indent: bool = False
    join_soft: bool = False
    unify_quotes: bool = False


#: The substitutions of Markdown marks, in their order.
MARKDOWN = [
    ("```[^\\n]*\\n?", ""), ("`([^`]+)`", "$1"), ("!\\[([^\\]]*)\\]\\([^)]*\\)", "$1"), ("\\[([^\\]]*)\\]\\([^)]*\\)", "$1"),
    (f"(?md)^[{WS}]{{0,3}}#{{1,6}}[{WS}]+", ""), (f"(?md)^[{WS}]{{0,3}}>[{WS}]?", ""), (f"(?md)^[{WS}]{{0,3}}[-*+][{WS}]+", ""),
    (f"(?md)^[{WS}]{{0,3}}([-*_])\\1{{2,}}[{WS}]*$", ""), ("\\*\\*\\*([^*]+)\\*\\*\\*", "$1"), ("\\*\\*([^*]+)\\*\\*", "$1"),
    ("\\*([^*]+)\\*", "$1"), ("___([^_]+)___", "$1"), ("__([^_]+)__", "$1"), ("~~([^~]+)~~", "$1"),
]
#: Characters that stay.
KEPT_ASCII = "\\n\\t\\u0020-\\u007E"
KEPT = KEPT_ASCII + (
    "\\u00A5\\u00B0\\u00B7\\u00D7\\u00F7\\u2010-\\u2027\\u2030-\\u205E\\u3000-\\u303F\\u3400-\\u4DBF\\u4E00-\\u9FFF"
    "\\uF900-\\uFAFF\\uFE30-\\uFE4F\\uFF00-\\uFFEF\\u3040-\\u30FF\\u1100-\\u11FF\\u3130-\\u318F\\uA960-\\uA97F\\uAC00-\\uD7AF\\uD7B0-\\uD7FF\\u2160-\\u217F")
#: White space but the line feed.
GAP = WS.replace("\\t-\\r", "\\t\\x0B-\\r")
#: Patterns of advertising lines.
URL_ONLY = f"(?i:(?:[{GAP}]*[【\\[（(《<]?[^】\\]）)》<>{WS}]{{0,12}}[】\\]）)》>]?[{GAP}]*)?(?:https?://|www\\.)[^{WS}]+)"
URL_TAIL_STOP = "，。！？、；：\"'（）【】"
URL_LEAD = f"(?i:(?:https?://|www\\.)[^{WS}]+(?:[{GAP}]+[^{WS}{URL_TAIL_STOP}][^\\n{URL_TAIL_STOP}]{{0,7}})?)"
SITE_BRACKET = "[【\\[（(][^】\\]）)\\n]{0,30}(?:笔趣阁|顶点|追书|搜读|小说阅读网|首发|无弹窗|阅读网址|欢迎访问|手机|请收藏|加入书签|收藏本站|下载txt|推荐票|月票|本书)[^】\\]）)\\n]{0,30}[】\\]）)]?"
SITE_BARE = "(?:本书(?:来自|由)|首发于|首发在|收藏本站|请收藏本站|下载txt)[^\\n]*"
END_MARK = f"={{3,}}[{GAP}]*(?:完|全文完|全书完)[^\\n]*"
#: A whole line, with the line feed before it, that is an advertisement: by its length and one of the patterns.
AD = f"\\n(?:(?:{URL_ONLY}|{URL_LEAD})(?=\\n|\\z)(?<=\\n[^\\n]{{1,100}})|(?:{SITE_BRACKET}|{SITE_BARE})(?=\\n|\\z)(?<=\\n[^\\n]{{1,40}})|{END_MARK})(?=\\n|\\z)"
SENTENCE_END = "。！？!?…：；;:\"'「『（(《—"


#: What a text must hold one of for the substitution of the same place in MARKDOWN to find anything.
MARKS = ["```", "`", "![", "](", "#", ">", "-*+", ("---", "***", "___"), "***", "**", "*", "___", "__", "~~"]


def _where(c: Column, marks: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """change(c) for a text that holds one of the marks, any other as it is. The text is bound as a lambda's variable, so
    that it isn't made once for the test and once more for the change."""

    def one(x: Column) -> Column:
        held = [x.contains(m) for m in marks]
        return F.when(reduce(or_, held), change(x)).otherwise(x)

    return F.get(F.transform(F.array(c), one), F.lit(0))


def newlines(c: Column) -> Column:
    return _where(c, ("\r",), lambda x: F.regexp_replace(x, "\\r\\n?", "\n"))


def zero_width(c: Column) -> Column:
    return _where(c, tuple("\ufeff\u200b\u200c\u200d\u2060\u200e\u200f"), lambda x: F.regexp_replace(x, "[^\\x00-\\x7F](?<=[\\uFEFF\\u200B\\u200C\\u200D\\u2060\\u200E\\u200F])", ""))


def ref_marks(c: Column) -> Column:
    return _where(c, tuple("[【〔"), lambda x: F.regexp_replace(x, f"[\\[【〔][{WS}]*[0-9]+[{WS}]*[\\]】〕]", ""))


def markdown(c: Column) -> Column:
    for (pattern, to), marks in zip(MARKDOWN, MARKS, strict=True):
        c = _where(c, tuple(marks) if marks == "-*+" else (marks,) if isinstance(marks, str) else marks, lambda x, p=pattern, to=to: F.regexp_replace(x, p, to))
    return c


def garbled(c: Column) -> Column:
    return F.regexp_replace(c, f"[^{KEPT_ASCII}](?<![{KEPT.removeprefix(KEPT_ASCII)}])", "")


def lines(c: Column) -> Column:
    """Runs of blanks folded, and both ends of each line trimmed. A run of white space is looked at once, from its start."""
    c = _where(c, ("\t", "\u3000", "  "), lambda x: F.regexp_replace(x, "[\\t\\u3000][\\t \\u3000]*| [\\t \\u3000]+", " "))
    c = F.regexp_replace(c, f"(\\A|\\n)[{GAP}]++", "$1")
    for first in ("[\\t\\x0B-\\r ]", f"[^\\x00-\\x9F](?<=[{WIDE}])"):
        c = F.regexp_replace(c, f"{first}(?=[{GAP}\\n]|\\z)(?<![{GAP}]{{2}})[{GAP}]*+(?=\\n|\\z)", "")
    return c


def drop_ads(c: Column) -> Column:
    """Without the lines that are advertisements; lines should be trimmed."""
    return F.substr(F.regexp_replace(F.concat(F.lit("\n"), c), AD, ""), F.lit(2))


def join_soft(c: Column) -> Column:
    """Lines of a paragraph become one, parted by a space between ASCII letters or digits. A line goes on in the next
    if neither is empty and it doesn't end a sentence, which its last character tells. Empty lines go."""
    c = F.regexp_replace(c, "(?<=[A-Za-z0-9])\\n(?=[A-Za-z0-9])", " ")
    return drop_blank(F.regexp_replace(c, f"(?<=[^{SENTENCE_END}\\n])\\n(?=[^\\n])", ""))


def drop_blank(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, "\\n\\n+", "\n"), F.lit("\n"))


def squeeze_blank(c: Column) -> Column:
    """Of several empty lines one stays."""
    c = F.regexp_replace(F.regexp_replace(c, "\\n{3,}", "\n\n"), "\\A\\n\\n", "\n")
    return F.regexp_replace(c, "\\n\\n\\z", "\n")


def indent(c: Column) -> Column:
    return F.regexp_replace(c, "(\\A|\\n)(?=[^\\n])", "$1\u3000\u3000")


def unify_quotes(c: Column) -> Column:
    """Within a line."""
    return F.regexp_replace(c, "[「『]([^」』\\n]*)[」』]", "“$1”")


def clean_text(c: Column, o: CleanOptions = CleanOptions()) -> Column:
    """The whole of the rules; null gives ''. Every rule is a substitution over the whole text, so the expression needs
    neither an exchange nor an array of lines, and its time is linear in the text."""
    c = zero_width(newlines(F.coalesce(c, F.lit(""))))
    if o.strip_ref_marks:
        c = ref_marks(c)
    if o.strip_markdown:
        c = markdown(c)
    if o.clean_garbled:
        c = garbled(c)
    c = lines(c)
    if o.strip_site:
        c = drop_ads(c)
    if o.join_soft:
        c = join_soft(c)
    c = drop_blank(c) if o.collapse_blank else squeeze_blank(c)
    if o.indent:
        c = indent(c)
    if o.unify_quotes:
        c = unify_quotes(c)
    return F.btrim(c, F.lit("\n"))


def recleaned(c: Column) -> Column:
    """struct of text, cleaned with the defaults, and changed: whether that differs from what was there."""
    bound = F.transform(F.array(clean_text(c)), lambda x: F.struct(x.alias("text"), (x != F.coalesce(c, F.lit(""))).alias("changed")))
    return F.get(bound, F.lit(0))
