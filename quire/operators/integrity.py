"""Integrity of objects, chapter tables and index: set differences by anti-joins, rebuilt maps by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import few
from .order import running


def residue(objects: DataFrame, live: DataFrame) -> DataFrame:
    """objects(book_id, key, size) whose book is neither on the shelf nor in the trash."""
    return objects.join(live.select("book_id").distinct(), "book_id", "left_anti")


def orphan_rollup(orphans: DataFrame) -> DataFrame:
    return orphans.groupBy("book_id").agg(F.count("*").alias("objects"), F.sum("size").alias("bytes"))


def chapter_orphans(objects: DataFrame, chapters: DataFrame, registered: DataFrame) -> DataFrame:
    """Bodies that their book's chapter table doesn't name, and whether they are registered as such."""
    loose = objects.join(chapters.select("book_id", "key").distinct(), ["book_id", "key"], "left_anti")
    return loose.join(registered.select("book_id", "key", F.lit(True).alias("r")).distinct(), ["book_id", "key"], "left").select("book_id", "key", F.coalesce("r", F.lit(False)).alias("known"))


def reconcile(content: DataFrame, root: DataFrame, shards: DataFrame | None = None, all_known: bool = True) -> DataFrame:
    """content(id, shard) as the shards hold it, root(id, shard) as the map says -> id, shard, change: what a shard holds
    wins (kept, added or moved), of several shards the lowest.

    A pointer to nothing is dead only where that is known. shards(shard, source) says how each shard was read, as
    load_shards() does: in one that is missing or broken nothing was looked for, so a pointer there is unknown and stays. A
    pointer to no shard at all, or below 0, is dead, if any shard could be read. Where not all shards are known (a part
    was opened, or more lie in the store than the root counts), nothing is dead. Without ``shards`` every one was read.
    """
    held = content.groupBy("id").agg(F.min("shard").alias("held"))
    both = held.join(root.select("id", F.col("shard").alias("mapped")), "id", "full_outer")
    found = F.when(F.col("mapped").isNull(), "added").when(F.col("held") != F.col("mapped"), "moved").otherwise("kept")
    if not all_known:
        dead = F.lit(False)
    elif shards is None:
        dead = F.lit(True)
    else:
        read = F.col("source").isin("primary", "backup")
        health = shards.groupBy(F.col("shard").alias("mapped")).agg(F.bool_or(read).alias("read"))
        any_read = shards.agg(F.coalesce(F.bool_or(read), F.lit(False)).alias("any_read"))
        both = both.join(few(health), "mapped", "left").join(F.broadcast(any_read))  # any_read is one row
        dead = F.col("any_read") & F.coalesce("read", F.lit(True))
    lost = F.when(dead, "dead").otherwise("unknown")
    return both.select("id", F.when(F.col("held").isNotNull(), F.col("held")).when(~dead, F.col("mapped")).alias("shard"), F.when(F.col("held").isNull(), lost).otherwise(found).alias("change"))


def shard_of_rows(books: DataFrame, size: int = 500) -> DataFrame:
    """Even shards in order of id, numbered in ranges of ids."""
    return running(books.select("id"), [F.col("id").asc()], label="shards").select("id", F.floor((F.col("rank") - 1) / size).cast("long").alias("shard"))


def purgeable(asked: DataFrame, chapters: DataFrame, live: DataFrame) -> DataFrame:
    """asked(book_id, key, prefix): what may go for good. Bodies that a table names stay; so do originals and progress of live books."""
    named = chapters.select("book_id", "key").distinct()
    texts = asked.where("prefix = 'text'").join(named, ["book_id", "key"], "left_anti")
    rest = asked.where("prefix <> 'text'").join(live.select("book_id").distinct(), "book_id", "left_anti")
    return texts.unionByName(rest)


def list_page(objects: DataFrame, prefix: str, cursor: str = "", size: int = 1000) -> DataFrame:
    """Keyset paging: keys after the cursor, in order."""
    return objects.where(F.col("key").startswith(prefix) & (F.col("key") > cursor)).orderBy("key").limit(size)
