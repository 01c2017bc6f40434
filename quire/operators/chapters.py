"""Chapter segmentation: choose a marker rule for each text, cut the text at its markers, fit chapters to a byte size.

A text is cut by one substitution that puts separators round each marker, and a split at these. So a text is never
exploded into lines, and segmentation needs no exchange.
"""

from __future__ import annotations

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS, count_words, trim_ws
from .clean import CleanOptions, clean_text

# fixed values: numerals, units and the words of markers
_NUM = "[0-9\\uFF10-\\uFF19零〇一二三四五六七八九十百千万两]"
_GAP = "[" + WS.replace("\\t-\\r", "\\t\\x0B-\\r") + "]*"  # white space but a line feed
_FRONT = f"(?:^|\\n)[{WS}]*"
_REST = f"{_GAP}([^\\n]*)"


def _numbered(units: str) -> str:
    return f"(?d){_FRONT}(?:#+[{WS}]*)?(第{_GAP}{_NUM}+{_GAP}[{units}]){_REST}"


#: Marker rules, by rank: of rules with as many markers the first one counts. Group 1 is the marker, group 2 the rest of its line.
RULES = {
    "cn_hui": _numbered("回"), "cn_jie": _numbered("节"), "cn_juan": _numbered("卷"), "cn": _numbered("章回节卷"),
    "en": f"(?di){_FRONT}(chapter{_GAP[:-1]}+[0-9ivxlcdm]+){_REST}", "vol": f"(?d){_FRONT}(卷{_GAP}{_NUM}+){_REST}",
}
PREAMBLE, FALLBACK = "引子", "正文"


def rule_of(text: Column) -> Column:
    """The rule with the most markers, at least two; null if none has. Counts are over the whole text."""
    held = {"en": F.lower(text).contains("chapter"), "vol": text.contains("卷")}  # no marker without these
    count = lambda name, p: F.when(held.get(name, text.contains("第")), F.regexp_count(text, F.lit(p))).otherwise(0)
    counts = [F.struct(count(name, p).alias("n"), F.lit(-i).alias("rank"), F.lit(name).alias("rule")) for i, (name, p) in enumerate(RULES.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] >= 2, best["rule"])


def like_title(rest: Column) -> Column:
    return (F.length(rest) > 0) & (F.length(rest) <= 40) & ~F.contains(rest, F.lit("。")) & ~(rest.rlike("[，,、；;]") & (F.length(rest) > 16))


def _heading(marker: Column, rest: Column) -> Column:
    gap = F.when(rest.rlike("^[ :：—-]"), F.lit("")).otherwise(F.lit(" "))
    return F.when(like_title(rest), trim_ws(F.regexp_replace(F.concat(marker, gap, rest), f"[{WS}:：—-]+\\z", ""))).otherwise(trim_ws(marker))


def groups(spark: SparkSession, pattern: str) -> int | None:
    """How many groups a regular expression has; null if it is blank or none at all."""
    if not pattern.strip():
        return None
    try:
        return spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern.strip()).matcher("").groupCount()
    except IllegalArgumentException:
        return None


def split_chapters(
    df: DataFrame, text: str = "text", fallback: Column | None = None, pattern: str | None = None, clean: CleanOptions | None = CleanOptions(), custom: str = "",
) -> DataFrame:
    """df with ``rule`` and ``chapters``, an array of (title, content) in order.

    pattern: null chooses a rule for each text, 'none' doesn't split, 'custom' takes the regular expression ``custom``
    (group 1 the marker, group 2 the rest of its line; ^ and $ are those of lines), a rule's name takes that rule and any
    other name the first one. Text before the first marker becomes a chapter of its own; chapters without content go,
    unless all would; then, and without a rule or with an invalid or blank expression, the whole text is one chapter. An
    empty text has no chapters. Clean None leaves contents as they are, but for white space at the ends.
    """
    body = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x01-\\x03]", ""), "\\r\\n?", "\n")
    df = df.withColumn("__t", body)
    tidy = (lambda c: clean_text(trim_ws(c), clean)) if clean else trim_ws
    marks = lambda n: "\u0001" + ("$1" if n > 0 else "") + "\u0002" + ("$2" if n > 1 else "") + "\u0003"
    marked = F.lit(None).cast("string")
    if pattern is None:
        df = df.withColumn("rule", rule_of(F.col("__t")))
        for name, p in RULES.items():
            marked = F.when(F.col("rule") == name, F.regexp_replace("__t", p, marks(2))).otherwise(marked)
    elif pattern == "none":
        df = df.withColumn("rule", F.lit("none"))
    elif pattern == "custom":
        n = groups(df.sparkSession, custom)
        df = df.withColumn("rule", F.lit(None if n is None else "custom").cast("string"))
        if n is not None:
            marked = F.regexp_replace("__t", f"(?m){custom.strip()}", marks(n))
    else:
        df = df.withColumn("rule", F.lit(pattern))
        marked = F.regexp_replace("__t", RULES.get(pattern, next(iter(RULES.values()))), marks(2))

    def parsed(piece: Column, i: Column) -> Column:
        after = F.substring_index(piece, "\u0002", -1)
        return F.struct(
            (i == 0).alias("before"), F.substring_index(piece, "\u0002", 1).alias("marker"), trim_ws(F.substring_index(after, "\u0003", 1)).alias("rest"),
            F.when(i == 0, piece).otherwise(F.substring_index(after, "\u0003", -1)).alias("content"))

    def chapter(c: Column) -> Column:
        lead = ~c["before"] & (c["rest"] != "") & ~like_title(c["rest"])
        return F.struct(
            F.when(c["before"], F.lit(PREAMBLE)).otherwise(_heading(c["marker"], c["rest"])).alias("title"),
            tidy(F.when(lead, F.concat(c["rest"], F.lit("\n"), c["content"])).otherwise(c["content"])).alias("content"))

    pieces = F.split("__m", "\u0001")
    cut = F.filter(F.transform(F.transform(pieces, parsed), chapter), lambda c: c["content"].rlike(f"[^{WS}]"))
    df = df.withColumn("__m", marked).withColumn("__cut", F.when(F.contains("__m", F.lit("\u0001")), cut))
    first = lambda w: F.substring_index(w, "\n", 1)
    # a text that was to be cut and couldn't be is called FALLBACK, others after their first line
    title = lambda w: F.when(F.col("__m").isNull() & (F.length(first(w)) <= 30), first(w)).otherwise(F.lit(FALLBACK))
    named = title if fallback is None else lambda w: F.coalesce(F.when(fallback != "", fallback), title(w))
    whole = F.filter(F.transform(F.array(tidy(F.col("__t"))), lambda w: F.struct(named(w).alias("title"), w.alias("content"))), lambda c: c["content"] != "")
    some = F.coalesce(F.size("__cut") > 0, F.lit(False))
    rule = F.col("rule") if pattern == "none" else F.when(some, F.col("rule"))
    out = df.withColumn("chapters", F.when(some, F.col("__cut")).otherwise(whole))
    return out.withColumn("rule", rule).drop("__t", "__m", "__cut")


def chapter_rows(df: DataFrame, *keys: str) -> DataFrame:
    """A row for each chapter: keys, pos from 0, title, content, words."""
    rows = df.select(*keys, F.posexplode("chapters").alias("pos", "c"))
    return rows.select(*keys, "pos", "c.title", "c.content", count_words(F.col("c.content")).alias("words"))


def fit_chapters(rows: DataFrame, *keys: str, most: int = 1_900_000) -> DataFrame:
    """Chapters of more than ``most`` UTF-8 bytes in parts, cut between characters; parts carry their number. Cuts lie at
    most three bytes before a multiple's place, and each goes on from the one before, so parts are found by a fold over bytes."""
    size = F.octet_length("content")
    steps = F.sequence(F.lit(1), F.ceil(size / (most - 3)).cast("int") + 1)

    def cuts(raw: Column) -> Column:
        def back(at: Column) -> Column:
            lead = lambda k: F.shiftright(F.conv(F.hex(F.substring(raw, at + 1 - k, F.lit(1))), 16, 10).cast("int"), 6) != 2
            return F.when(at >= size, size).when(lead(0), at).when(lead(1), at - 1).when(lead(2), at - 2).otherwise(at - 3)

        return F.aggregate(steps, F.array(F.lit(0)), lambda a, _: F.when(F.element_at(a, -1) >= size, a).otherwise(F.concat(a, F.array(back(F.element_at(a, -1) + most)))))

    def taken(raw: Column, at: Column) -> Column:
        return F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda s, i: F.decode(F.substring(raw, s + 1, F.get(at, i + 1) - s), "UTF-8"))

    # bytes and cuts are bound as variables, so each is made once for a chapter
    parts = F.transform(F.array(F.encode("content", "UTF-8")), lambda raw: F.flatten(F.transform(F.array(cuts(raw)), lambda at: taken(raw, at))))
    parts = F.when(size <= most, F.array("content")).otherwise(F.flatten(parts))
    out = rows.select(*keys, "pos", "title", F.posexplode(parts).alias("part", "content"), (size > most).alias("__many"))
    title = F.when(F.col("__many"), F.concat("title", F.lit("（"), (F.col("part") + 1).cast("string"), F.lit("）"))).otherwise(F.col("title"))
    return out.select(*keys, "pos", "part", title.alias("title"), "content")


def paragraphs(df: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    found = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), trim_ws), lambda x: x != "")
    return df.select(*keys, F.posexplode(found).alias("pos", "paragraph"))
