"""Objects by key: versions, conditional writes, lenient JSON, bodies with a second source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def versioned(objects: DataFrame) -> DataFrame:
    """objects(key, content) with etag, the content's digest."""
    return objects.withColumn("etag", F.md5("content"))


def put_if(objects: DataFrame, writes: DataFrame) -> DataFrame:
    """objects(key, etag), writes(key, seq, expect, force) -> key, seq, ok. A write expects the etag that it has read, or
    with null that there is no object; force asks for no test. All see the objects as they were. Of several that could
    write the same key one does: the last forced one, else the first."""
    rows = writes.join(objects.select("key", "etag"), "key", "left").withColumn("fits", F.col("force") | F.col("expect").eqNullSafe(F.col("etag")))
    order = F.when(F.col("force"), F.col("seq")).otherwise(-F.col("seq"))
    won = rows.where("fits").groupBy("key").agg(F.max_by("seq", F.struct("force", order)).alias("won"))
    return rows.join(won, "key", "left").select("key", "seq", F.coalesce(F.col("seq") == F.col("won"), F.lit(False)).alias("ok"))


def json_body(body: Column, most: int) -> Column:
    """struct of status (200, 413 for too many bytes, 400 for no JSON) and body: a JSON object or array, else {}."""
    text = F.coalesce(body, F.lit(""))
    parsed = F.try_parse_json(text)
    nested = F.schema_of_variant(parsed).rlike("^(OBJECT|ARRAY)")
    status = F.when(F.octet_length(text) > most, 413).when((text != "") & parsed.isNull(), 400).otherwise(200)
    return F.struct(status.alias("status"), F.when(status == 200, F.when(nested, text).otherwise("{}")).alias("body"))


def lenient(raw: Column, schema: str, default: Column) -> Column:
    """What is missing or no JSON of that form counts as the default."""
    return F.coalesce(F.when(F.try_parse_json(raw).isNotNull(), F.from_json(raw, schema)), default)


def fetch(chapters: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """chapters(book_id, pos, key), bodies(book_id, key, text) of two sources -> book_id, pos, text, source (first, second
    or missing): the second source stands in, and a text that neither has is empty."""
    rows = chapters.join(first.select("book_id", "key", F.col("text").alias("a")), ["book_id", "key"], "left").join(second.select("book_id", "key", F.col("text").alias("b")), ["book_id", "key"], "left")
    source = F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("missing")
    return rows.select("book_id", "pos", F.coalesce("a", "b", F.lit("")).alias("text"), source.alias("source"))


def listed(objects: DataFrame, prefix: str, cursor: str = "", size: int = 1000) -> DataFrame:
    """One page of keys in order with truncated, whether more follow, and cursor, where the next page goes on."""
    rows = objects.where(F.col("key").startswith(prefix) & (F.col("key") > cursor)).orderBy("key").limit(size + 1)
    page = rows.agg(F.array_sort(F.collect_list("key")).alias("k"))  # a page and one key
    more = F.size("k") > size
    return page.select(F.explode_outer(F.slice("k", 1, size)).alias("key"), more.alias("truncated"), F.when(more, F.element_at("k", size)).alias("cursor"))
