"""Catalogue queries: search, facets, orders, pages, counts. Every order ends in the id, so it is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import read_state
from .order import running

#: Column and whether it falls.
ORDERS = {"recent": ("recent", True), "updated": ("updated_at", True), "created": ("created_at", True), "words": ("word_count", True), "title": ("title", False)}


def shelf_entries(books: DataFrame) -> DataFrame:
    """The covering projection of a book: defaults in place, recency and reading state derived."""
    zero = F.lit(0)
    return books.select(
        "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        *[F.coalesce(c, F.lit(False)).alias(c) for c in ("pinned", "finished", "star")], "read_done",
        *[F.coalesce(F.col(c).cast("long"), zero).alias(c) for c in ("chapter_count", "word_count", "created_at", "updated_at")],
        F.greatest(F.coalesce("prog_at", zero), F.coalesce("created_at", zero), zero).cast("long").alias("recent"),
        read_state(F.col("read_done"), F.col("prog_ch"), F.col("prog_ratio"), F.col("prog_at"), F.col("chapter_count")).alias("state"),
        "prog_ch", "prog_ratio", "prog_at")


def search(df: DataFrame, terms: str, columns: tuple[str, ...] = ("title", "author")) -> DataFrame:
    """Rows where each term is in one of the columns or a tag."""
    hay = F.lower(F.concat_ws("\u0001", *columns, F.array_join("tags", "\u0001")))
    for t in terms.lower().split():
        df = df.where(F.contains(hay, F.lit(t)))
    return df


def facets(df: DataFrame, tag: str | None = None, finished: bool | None = None, state: str | None = None, star: bool = False) -> DataFrame:
    if tag is not None:
        df = df.where(F.array_contains("tags", tag))
    if finished is not None:
        df = df.where(F.col("finished") == finished)
    if state is not None:
        df = df.where(F.col("state") == state)
    return df.where("star") if star else df


def order_of(key: str) -> list[Column]:
    """Pinned books first, then by the order; an unknown one counts as 'updated'."""
    column, falls = ORDERS.get(key, ORDERS["updated"])
    return [F.desc("pinned"), F.desc(column) if falls else F.asc(column), F.asc("id")]


#: A rank up to this is given in one task, after a limit in every task; deeper ones in ranges of the order.
AT_ONCE = 10_000


def between(df: DataFrame, order: list[Column], after: int, upto: int, at_once: int = AT_ONCE) -> DataFrame:
    """df's rows of the ranks after ``after`` up to ``upto``, with rank. The order has to be total."""
    if upto <= at_once:
        first = df.orderBy(*order).limit(upto)
        ranked = first.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    else:
        ranked = running(df, order, label="ranks").withColumn("rank", F.col("rank").cast("long"))
    return ranked.where((F.col("rank") > after) & (F.col("rank") <= upto))


def top(df: DataFrame, key: str, n: int, *columns: str) -> DataFrame:
    """The first n rows with their rank."""
    return between(df, order_of(key), 0, n).select("rank", *columns)


def continue_reading(df: DataFrame, n: int = 3) -> DataFrame:
    rows = df.where((F.coalesce("prog_at", F.lit(0)) > 0) & (F.col("state") != "done")).orderBy(F.desc("prog_at"), "id").limit(n)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("prog_at"), "id")).cast("long")).select("rank", "id", "prog_at")


def tag_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def top_tags(df: DataFrame, n: int) -> DataFrame:
    first = tag_counts(df).orderBy(F.desc("n"), "tag").limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "tag")).cast("long"))


def state_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("unread", "reading", "done")], F.count_if("star").alias("star"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("books"), F.sum("word_count").alias("words"))


LAST_PAGE = 10_000


def feed_page(df: DataFrame, page: int, size: int = 100, at_once: int = AT_ONCE) -> DataFrame:
    """One page by the time of the last change, with flags for its neighbours and the newest time of the whole library."""
    page = min(max(page, 1), LAST_PAGE)
    at = F.coalesce(F.when(F.col("updated_at") > 0, F.col("updated_at")), F.col("created_at"))
    rows = df.withColumn("at", at)
    whole = rows.agg(F.count("*").alias("__n"), F.max("at").alias("newest"))
    ranked = between(rows, [F.desc("at"), F.asc("id")], (page - 1) * size, page * size, at_once)
    # one row joins each row of the page
    return ranked.join(F.broadcast(whole)).select("rank", "id", "at", "newest", F.lit(page > 1).alias("has_previous"), (F.col("__n") > page * size).alias("has_next"))


def trash_view(trash: DataFrame, now: int, days: int = 15) -> DataFrame:
    day = 86_400_000
    return trash.select(
        "id", "title", "deleted_at", F.greatest(F.lit(0), days - F.floor((now - F.col("deleted_at")) / day)).cast("long").alias("days_left"),
        (F.lit(now) - F.col("deleted_at") > days * day).alias("expired"))


def in_chinese(c: Column) -> Column:
    """For an order by the collation of Chinese."""
    return F.collate(c, "zh")


def titles_in_chinese(df: DataFrame, n: int) -> DataFrame:
    """The order 'title' by collation; equal titles by id."""
    keys = [F.desc("pinned"), in_chinese(F.col("title")).asc(), F.asc("id")]
    first = df.orderBy(*keys).limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*keys)).cast("long")).select("rank", "id")


def tag_list(df: DataFrame) -> DataFrame:
    """All tags with their numbers, and the number of all tags: the most frequent first, equals by collation. Ranks are
    given in ranges of this order."""
    counts = tag_counts(df)
    total = counts.agg(F.count("*").alias("total"))
    ranked = running(counts.withColumn("__zh", in_chinese(F.col("tag"))), [F.desc("n"), F.asc("__zh"), F.asc("tag")], label="tags").drop("__zh")
    return ranked.join(F.broadcast(total)).withColumn("rank", F.col("rank").cast("long"))  # total is one row


def tag_cloud(df: DataFrame, selected: str | None = None, shown: int = 6, most: int = 12) -> DataFrame:
    """The first tags; a selected one of the first ``most`` that isn't among them is put in front."""
    top = top_tags(df, most)
    keep = (F.col("rank") <= shown) if selected is None else (F.col("rank") <= shown) | (F.col("tag") == selected)
    return top.where(keep).withColumn("place", F.when(F.col("rank") > shown, 0).otherwise(F.col("rank")).cast("long"))


def pages(df: DataFrame, key: str, page: int, size: int = 60, *columns: str, at_once: int = AT_ONCE) -> DataFrame:
    """The first ``page`` pages; no more pages than there are, one at least."""
    n = df.count()
    return between(df, order_of(key), 0, max(1, min(page, -(-n // size))) * size, at_once).select("rank", *columns)


def toc(chapters: DataFrame, places: DataFrame, loaded: int = 0, size: int = 50) -> DataFrame:
    """chapters(book_id, pos, title), places(book_id, cur) -> the rows of each book's table that are shown, up to the
    current one at least, with cur and read."""
    rows = chapters.join(places.select("book_id", F.col("cur").alias("__cur")), "book_id")
    shown = rows.where(F.col("pos") < F.greatest(F.lit(loaded), F.lit(size), F.col("__cur") + 1))
    return shown.select("book_id", "pos", "title", (F.col("pos") == F.col("__cur")).alias("cur"), (F.col("pos") < F.col("__cur")).alias("read"))


def pick(selected: DataFrame, visible: DataFrame, invert: bool = False) -> DataFrame:
    """(id) each: all that is visible is selected too, or with ``invert`` what of it was selected no longer is."""
    both = selected.select("id").distinct().withColumn("s", F.lit(True)).join(visible.select("id").distinct().withColumn("v", F.lit(True)), "id", "full_outer")
    return (both.where("s IS NULL OR v IS NULL") if invert else both).select("id")


def prune(selected: DataFrame, visible: DataFrame) -> DataFrame:
    return selected.join(visible.select("id"), "id", "left_semi")


def sane(snapshot: DataFrame) -> DataFrame:
    """Rows of a stored shelf that can be shown."""
    return snapshot.where("id IS NOT NULL AND title IS NOT NULL AND title <> ''")


def readable(books: DataFrame) -> DataFrame:
    return books.where("status = 'ready'")


def book_view(books: DataFrame) -> DataFrame:
    """A book's record without what only upkeep needs."""
    return books.drop("orphans")


def library(shelf: DataFrame, trash: DataFrame) -> DataFrame:
    """All books of the shelf and the trash, each once: a book in both counts as one of the shelf."""
    every = shelf.withColumn("place", F.lit("shelf")).unionByName(trash.join(shelf.select("id"), "id", "left_anti").withColumn("place", F.lit("trash")), allowMissingColumns=True)
    return every
