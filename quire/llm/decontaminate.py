"""Benchmark decontamination in DataFrame operations: SimHash of item-sized windows, multi-index Hamming blocks, exact
weighted-shingle similarity.

A window of a document has as many words as the item (all of a shorter document). Its similarity with the item is
that of their multisets of word shingles: sum of least counts over sum of largest counts. Windows that could reach
the threshold share most shingles with the item; so a text that holds such a window has one at least of the item's
rarest shingles, however few these may be as long as the rest alone can't reach it (see _rare), and windows are laid
only where enough of the item's shingles lie close enough together (see _starts). Neither loses any. Windows of long
items then go by fingerprint: RADIUS + 1 blocks of bits, so that two fingerprints within RADIUS agree in one block at
least; those of short items, whose fingerprints vary too much, are all compared exactly. A window is held against the
items it was laid for, never against all items, and a shingle that very many texts or items share makes no pairs of
them. Texts are named by 128 bits of their hash, so what many rows share is looked at once, and a row without a doc_id
is like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import apart, finished, small, spread, stored, table

WORDS, PERCENT = 5, 80
#: The columns that name a text.
_TEXT = ("t", "u")
#: A window of similarity 0.8 differs from an item of so many shingles or more in 10 of 64 bits on average and with a
#: deviation of 3, by the angle between two such sums; in more than RADIUS bits once in 10**10 times.
LONG, RADIUS = 40, 31
_WS = " \t\n\x0b\f\r"
_WS_RUN = "[\\x20\\x09-\\x0D]+"


def _shingled(df: DataFrame, length: int) -> DataFrame:
    """df(text, ...) with n, its number of words, and sh, the hashes of its shingles of this length, in order. The
    words are bound once, as a lambda's variable, and the generator keeps their making from being repeated."""
    clean = F.btrim(F.lower(F.coalesce("text", F.lit(""))), F.lit(_WS))
    words = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, _WS_RUN))
    hashes = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - length), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(length)]))
    row = F.transform(F.array(words), lambda w: F.struct(
        F.size(w).alias("n"), F.when(F.size(w) >= length, hashes(w)).otherwise(F.array().cast("array<bigint>")).alias("sh")))
    return df.select("*", F.explode(row).alias("__s")).select("*", "__s.n", "__s.sh").drop("__s")


def _fingerprint(df: DataFrame, *keys: str) -> DataFrame:
    """df(keys, sh): the SimHash of each row's multiset sh."""
    ones = df.select(*keys, F.explode("sh").alias("h")).groupBy(*keys).agg(
        *[F.sum(F.shiftright("h", i).bitwiseAND(F.lit(1).cast("long")) * 2 - 1).alias(f"b{i}") for i in range(64)])
    bits = [F.when(F.col(f"b{i}") > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(64)]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return ones.select(*keys, fp.alias("fp"))


def _blocks() -> Column:
    """The blocks of fp as (number, value) pairs."""
    out, at = [], 0
    for k in range(RADIUS + 1):
        size = 64 // (RADIUS + 1) + (k < 64 % (RADIUS + 1))
        out.append(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << size) - 1).cast("long")).alias("value")))
        at += size
    return F.explode(F.array(*out))


def _starts(percent: int) -> tuple[Column, Column]:
    """The number of hits that a window needs, and the starts to look at.

    hits: the sorted places of the document's shingles that the item has. A window shifted right to its first hit, or
    to the last place where it fits, has lost none of its hits; so windows that start at a hit or at the last place suffice.
    """
    need = F.ceil(percent * (F.col("kd") + F.col("k")) / (100 + percent)).cast("int")
    last = F.greatest(F.lit(0), F.col("n") - F.col("m"))
    at_hits = F.expr("filter(sequence(0, size(hits) - need), i -> hits[i] <= greatest(0, n - m) AND hits[i + need - 1] < hits[i] + kd)")
    inner = F.transform(at_hits, lambda i: F.get("hits", i))
    outer = F.when(F.size(F.filter("hits", lambda p: p >= last)) >= F.col("need"), F.array(last)).otherwise(F.array().cast("array<int>"))
    return need, F.array_distinct(F.concat(inner, outer))


def _common() -> Column:
    """Size of the intersection of the multisets sh and item_sh."""
    plain = (F.size(F.array_distinct("sh")) == F.size("sh")) | (F.size(F.array_distinct("item_sh")) == F.size("item_sh"))
    counted = F.aggregate(F.array_distinct("item_sh"), F.lit(0), lambda a, x: a + F.least(F.size(F.filter("sh", lambda y: y == x)), F.size(F.filter("item_sh", lambda y: y == x))))
    return F.when(plain, F.size(F.array_intersect("sh", "item_sh"))).otherwise(counted)


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, similarity: a row for each document and item
    where some window has a similarity of at least ``percent`` %, with the largest similarity of its windows.

    Words are lower-cased and split at white space. Items of fewer words than a shingle are one shingle, which a
    document must hold exactly. Items or documents that are null, empty or wordless match nothing. Repeated rows, and
    several texts with one id, give one row for each pair of ids; a null doc_id is an id like others. Other columns are
    not read. The items' shingles are broadcast only if they are few; otherwise all joins are shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_named("text"))
    return rows.join(small(contaminated_texts(docs, benchmark, words, percent)), list(_TEXT)).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def _named(text: str) -> list[Column]:
    return [F.xxhash64(text).alias("t"), F.xxhash64(F.lit("second"), text).alias("u")]


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs(text), benchmark(item_id, text) -> t, u (the text's name), item_id, similarity, as contaminated()."""
    return finished(docs.sparkSession, lambda: _contaminated_texts(docs, benchmark, words, percent), "contaminated")


def _contaminated_texts(docs: DataFrame, benchmark: DataFrame, words: int, percent: int) -> DataFrame:
    docs = docs.select("text", *_named("text")).where("text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL").distinct()
    found = []
    sized = stored(_shingled(items, 1).select("item_id", "text", F.col("n").alias("m")).where("m > 0"), "items")
    for length in sorted(r[0] for r in sized.select(F.least("m", F.lit(words)).alias("l")).distinct().collect()):
        found.append(_with_items(docs, sized.where((F.col("m") == length) if length < words else (F.col("m") >= words)), length, percent))
    if not found:
        return docs.select(*_TEXT, F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("similarity")).where(F.lit(False))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.groupBy(*_TEXT, "item_id").agg(F.max("similarity").alias("similarity"))


def _rare(of_item: DataFrame, counts: DataFrame, percent: int) -> DataFrame:
    """of_item(v, k, h, times), counts(h, c) -> h, v: of each item's shingles the rarest in the documents, as many as a
    text can't be without. A window shares at least ``percent`` % of the item's k shingles, each as often as it is there;
    so it has one of any k - that + 1."""
    spare = F.col("k") - F.ceil(percent * F.col("k") / 100)
    earlier = F.sum("times").over(Window.partitionBy("v").orderBy(F.coalesce("c", F.lit(0)), "h").rowsBetween(Window.unboundedPreceding, -1))
    return of_item.join(small(counts), "h", "left").withColumn("earlier", F.coalesce(earlier, F.lit(0))).where(F.col("earlier") <= spare).select("h", "v")


def _with_items(docs: DataFrame, items: DataFrame, length: int, percent: int) -> DataFrame:
    items = items.select("item_id", F.xxhash64("text").alias("v"), "text")
    ids = items.select("item_id", "v")
    items = stored(_shingled(items.dropDuplicates(["v"]), length).select("v", "n", "sh").select("v", F.col("n").alias("m"), F.size("sh").alias("k"), "sh"), "item-shingles")
    of_item = stored(items.select("v", "m", "k", F.explode("sh").alias("h")).groupBy("v", "m", "k", "h").agg(F.count("*").alias("times")), "of-items")
    places = _shingled(docs, length).select(*_TEXT, "n", F.posexplode("sh").alias("pos", "h"))
    # all that any item shares with the texts: a row for each such place, however many items have the shingle
    places = stored(places.join(small(of_item.select("h").distinct()), "h", "left_semi").distinct(), "places")
    rare = _rare(of_item, places.groupBy("h").agg(F.count("*").alias("c")), percent)
    asked = stored(places.join(small(rare), "h").select(*_TEXT, "v").distinct(), "asked")
    hits = asked.join(small(of_item), "v").join(places, [*_TEXT, "h"]).groupBy(*_TEXT, "n", "v", "m", "k").agg(F.sort_array(F.collect_set("pos")).alias("hits"))
    need, starts = _starts(percent)
    hits = hits.withColumn("kd", F.least("k", F.col("n") - (length - 1))).withColumn("need", need).where("size(hits) >= need")
    laid = stored(hits.select(*_TEXT, "v", "m", "k", "kd", F.explode(starts).alias("s")), "laid")
    if laid.isEmpty():
        return laid.select(*_TEXT, F.lit(None).cast("long").alias("item_id"), F.lit(0.0).alias("similarity"))
    again = _shingled(docs.join(small(laid.select(*_TEXT).distinct()), list(_TEXT), "left_semi").dropDuplicates(list(_TEXT)), length)
    windows = laid.select(*_TEXT, "m", "kd", "s").distinct()
    windows = stored(again.select(*_TEXT, "sh").join(windows, list(_TEXT)).select(*_TEXT, "m", "s", F.expr("slice(sh, s + 1, kd)").alias("sh")), "windows")
    pair = [*_TEXT, "m", "s", "v"]
    long = laid.where(F.col("k") >= LONG).select(*pair)
    prints = _fingerprint(windows.join(long.select(*_TEXT, "m", "s").distinct(), [*_TEXT, "m", "s"], "left_semi"), *_TEXT, "m", "s")
    of_items = _fingerprint(items.where(F.col("k") >= LONG), "v").select("v", F.col("fp").alias("item_fp"), _blocks().alias("b")).select("v", "item_fp", "b.*")
    near = long.join(prints, [*_TEXT, "m", "s"]).select("*", _blocks().alias("b")).select(*pair, "fp", "b.*").join(small(of_items), ["v", "block", "value"])
    near = near.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select(*pair).distinct()
    near = stored(near.unionByName(laid.where(F.col("k") < LONG).select(*pair)), "near")
    both = near.join(windows, [*_TEXT, "m", "s"]).join(small(items.select("v", F.col("sh").alias("item_sh")), cells="size(item_sh)"), "v")
    shared = both.select(*_TEXT, "v", _common().alias("c"), (F.size("sh") + F.size("item_sh")).alias("all"))
    found = shared.where(100 * F.col("c") >= percent * (F.col("all") - F.col("c"))).groupBy(*_TEXT, "v").agg(F.max(F.col("c") / (F.col("all") - F.col("c"))).alias("similarity"))
    return found.join(small(ids), "v").select(*_TEXT, "item_id", "similarity")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, whatever their doc_id. Null, empty and wordless texts hold none and stay,
    texts of any length are looked at whole, and columns of any name stay as they are."""
    docs, back = apart(docs, "__t", "__u")
    bad = contaminated_texts(docs, table(spark, sf_dir, "benchmark")).select(*[F.col(c).alias(f"__{c}") for c in _TEXT]).distinct()
    t, u = _named("text")
    return back(docs.join(small(bad), (t == F.col("__t")) & (u == F.col("__u")), "left_anti"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{_WS_RUN}'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '{_WS_RUN}'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT doc_id, len(w) AS n, p, array_to_string(w[p+1:p+5], ' ') AS x FROM (SELECT *, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)),
js AS (SELECT item_id, len(w) AS m, len(w) - 4 AS k, array_to_string(w[p+1:p+5], ' ') AS x FROM (SELECT *, unnest(range(0, len(w) - 4)) AS p FROM i WHERE len(w) >= 5)),
jc AS (SELECT item_id, m, k, x, count(*) AS c FROM js GROUP BY ALL),
hits AS (SELECT doc_id, item_id, n, m, k, p FROM ds JOIN jc USING (x)),
st AS (SELECT DISTINCT doc_id, item_id, n, m, k, greatest(0, least(p, n - m)) AS s FROM hits),
inner_ AS (SELECT st.doc_id, st.item_id, st.s, st.k, least(st.k, st.n - 4) AS kd, x, count(*) AS c FROM st JOIN ds ON ds.doc_id = st.doc_id AND p BETWEEN s AND s + k - 1 GROUP BY ALL),
cm AS (SELECT doc_id, item_id, s, any_value(inner_.k) AS k, any_value(kd) AS kd, sum(least(inner_.c, jc.c)) AS c FROM inner_ JOIN jc USING (item_id, x) GROUP BY doc_id, item_id, s)
SELECT doc_id, item_id, max(c::DOUBLE / (k + kd - c)) AS similarity FROM cm WHERE 100 * c >= {PERCENT} * (k + kd - c) GROUP BY doc_id, item_id
"""
