"""Edits of books, tags and chapter tables as DataFrame transformations; the caller writes the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_title

MAX_TAGS = 10


def add_tags(tags: Column, new: list[str]) -> Column:
    return F.slice(F.array_union(tags, F.array(*map(F.lit, new))), 1, MAX_TAGS)


def remove_tags(tags: Column, old: list[str]) -> Column:
    return F.filter(tags, lambda t: ~t.isin(old))


def merge_tag(tags: Column, old: str, new: str) -> Column:
    """old becomes new, or goes if new is ''; order kept, doubles gone."""
    if old == new:
        raise ValueError("a tag can't be merged into itself")
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: F.when(t == old, new).otherwise(t)), lambda t: t != "")), 1, MAX_TAGS)


def append_chapters(chapters: DataFrame, new: DataFrame) -> DataFrame:
    """chapters(book_id, pos, key), new(book_id, i): keys that no chapter of the book has had. -> book_id, pos, key"""
    used = chapters.groupBy("book_id").agg(F.max(F.expr("try_cast(key AS bigint)")).alias("top"), F.count("*").alias("n"))
    start = F.greatest(F.coalesce("n", F.lit(0)), F.coalesce("top", F.lit(0)))
    return new.join(used, "book_id", "left").select("book_id", (F.coalesce("n", F.lit(0)) + F.col("i")).cast("long").alias("pos"), (start + 1 + F.col("i")).cast("string").alias("key"))


def migrate_progress(progress: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """progress(book_id, ch, ratio) after a book's chapters are replaced: to the first new chapter with the old one's title, else to the start; a place outside the old table stays."""
    first = new.groupBy("book_id", "title").agg((F.min("pos") + 1).alias("to"))
    at = progress.join(old.select("book_id", (F.col("pos") + 1).alias("ch"), "title"), ["book_id", "ch"], "left").join(first, ["book_id", "title"], "left")
    lost = F.col("title").isNotNull() & F.col("to").isNull()
    return at.select("book_id", F.when(lost, 1).otherwise(F.coalesce("to", "ch")).cast("long").alias("ch"), F.when(lost, 0.0).otherwise(F.col("ratio")).alias("ratio"))


def shift_for_insert(ch: Column, at: Column) -> Column:
    return F.when(ch - 1 >= at, ch + 1).otherwise(ch)


def shift_for_delete(ch: Column, at: Column, left: Column) -> Column:
    return F.least(F.when(ch - 1 > at, ch - 1).otherwise(ch), left)


def patch_books(books: DataFrame, patch: DataFrame, now: int) -> DataFrame:
    """patch(id, title, author, star, read_done_op, read_done): a null field keeps the book's; read_done_op is set, clear or keep."""
    p = patch.select("id", *[F.col(c).alias(f"p_{c}") for c in ("title", "author", "star", "read_done_op", "read_done")])
    done = F.when(F.col("p_read_done_op") == "set", F.col("p_read_done")).when(F.col("p_read_done_op") == "clear", F.lit(None)).otherwise(F.col("read_done"))
    return books.join(p, "id").select("id", *[F.coalesce(f"p_{c}", c).alias(c) for c in ("title", "author", "star")], done.alias("read_done"), F.lit(now).cast("long").alias("updated_at"))


def incomplete(chapters: DataFrame, bodies: DataFrame) -> DataFrame:
    """Books that can't be published: the first, middle or last chapter has no body."""
    n = chapters.groupBy("book_id").agg(F.count("*").alias("n"))
    probe = chapters.join(n, "book_id").where((F.col("pos") == 0) | (F.col("pos") == F.floor(F.col("n") / 2)) | (F.col("pos") == F.col("n") - 1))
    return probe.join(bodies, ["book_id", "key"], "left_anti").select("book_id").distinct()


def drop_last(chapters: DataFrame, count: Column) -> DataFrame:
    """Undo an append of ``count`` chapters."""
    n = chapters.groupBy("book_id").agg(F.count("*").alias("n"))
    return chapters.join(n, "book_id").where(F.col("pos") < F.col("n") - count).drop("n")


def duplicate_titles(books: DataFrame, norm: Column) -> DataFrame:
    """Books whose normalised title another book has: an aggregation and a semi-join, never pairs."""
    keyed = books.withColumn("__k", norm)
    twice = keyed.groupBy("__k").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("__k")
    return keyed.join(twice, "__k", "left_semi").drop("__k")


def set_tags(tags: list[str]) -> Column:
    return F.array(*map(F.lit, tags[:MAX_TAGS])).cast("array<string>")


def batch_trim(targets: DataFrame, budget: int = 48, deleting: bool = False, most: int = 18) -> DataFrame:
    """targets(rank, id, shard): the longest prefix whose estimate of requests fits; the rest is deferred. k counts the
    shards of a prefix, n its books. A batch has at most ``most`` books, so only so many go on to the running counts;
    all others are deferred without a cost."""
    first = targets.orderBy("rank").limit(most)
    w = Window.orderBy("rank")
    new = F.when(F.row_number().over(Window.partitionBy("shard").orderBy("rank")) == 1, 1).otherwise(0)
    rows = first.withColumn("new", new).withColumn("k", F.sum("new").over(w)).withColumn("n", F.row_number().over(w))
    cost = (5 + 3 * F.col("k") if deleting else 1 + 3 * F.col("k") + 4 * F.col("n")) + 2 + 3 * F.col("k")
    rows = rows.select("rank", "id", cost.cast("long").alias("cost"), (cost > budget).alias("deferred"))
    rest = targets.join(first.select("rank"), "rank", "left_anti").select("rank", "id", F.lit(None).cast("long").alias("cost"), F.lit(True).alias("deferred"))
    return rows.unionByName(rest)


def merge_trim(targets: DataFrame, shards: int, budget: int = 48) -> DataFrame:
    """targets(rank, id, shard): the longest prefix of a tag merge whose estimate of requests fits; all others wait for
    the next call. A prefix has at most budget / 4 books, so only so many go on to the running counts."""
    first = targets.orderBy("rank").limit(max(0, budget // 4))
    w = Window.orderBy("rank")
    new = F.when(F.row_number().over(Window.partitionBy("shard").orderBy("rank")) == 1, 1).otherwise(0)
    cost = 1 + shards + 4 * F.row_number().over(w) + 2 * F.sum("new").over(w)
    return first.withColumn("new", new).select("rank", "id", cost.cast("long").alias("cost")).where(F.col("cost") <= budget)


def copy_titles(new: DataFrame, taken: DataFrame, most: int = 50) -> DataFrame:
    """new(id, title), taken(title) -> id, title: a title that is taken gets the least free copy number, null if none
    up to ``most`` is free. Of new books with the same title the one with the least id comes first. Titles are
    compared without white space."""
    suffix = lambda k: F.concat(F.lit("（副本"), F.when(k > 1, k.cast("string")).otherwise(F.lit("")), F.lit("）"))
    rows = new.select("id", "title", norm_title(F.col("title")).alias("key"))
    old = taken.select(norm_title(F.col("title")).alias("key")).distinct().withColumn("old", F.lit(1))
    rows = rows.join(old, "key", "left").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    rows = rows.withColumn("r", F.col("r") - F.when(F.col("old").isNull(), 1).otherwise(0))
    wanted = rows.where("r > 0").select("key").distinct().select("key", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("k")).where(F.col("k").between(1, most))  # a sequence to 0 goes down
    used = old.select("key").union(rows.select("key")).select(F.col("key").alias("name"))
    free = wanted.join(used, F.concat("key", suffix(F.col("k"))) == F.col("name"), "left_anti").groupBy("key").agg(F.sort_array(F.collect_list("k")).alias("free"))
    k = F.get("free", F.col("r") - 1)
    return rows.join(free, "key", "left").select("id", F.when(F.col("r") == 0, F.col("title")).when(k.isNotNull(), F.concat("title", suffix(k))).alias("title"))
