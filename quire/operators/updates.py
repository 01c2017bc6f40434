"""A book's chapters replaced or extended, and books published: everything that changes with it, as one result of tables.

Tables as in books.py; besides, orphans(book_id, key, i), bodies that no table names but that are registered in order i,
pending_batch and pending_sig of books, an append that isn't published yet, and shelf(id, pinned, prog_ch, prog_ratio,
prog_at, ...). A request is taken whole or refused with a verdict; tables hold the rows of the books that change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_str
from .books import CHAPTER_MAX, append, clean_tags, orphan_algebra, publish, replaced_chapters, sweep, title_or_number
from .edits import migrate_progress


@dataclass
class Update:
    """verdicts of all requests; of the books that change: their rows, chapter tables, orphans (swept: the body goes now,
    else it stays registered), progress, and what the shelf shows of them."""

    verdicts: DataFrame
    books: DataFrame
    chapters: DataFrame
    orphans: DataFrame
    progress: DataFrame | None = None
    shelf: DataFrame | None = None


def _fields(rows: DataFrame, added: Column, words: Column, now: int) -> list[Column]:
    """A book's fields after an update: what was given, else what it had; a blank title keeps the old one."""
    title = safe_str(F.col("new_title"), 120)
    return [
        "id", F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(F.col("title")).alias("title"),
        F.when(F.col("new_author").isNull(), F.col("author")).otherwise(safe_str(F.col("new_author"), 60)).alias("author"), F.when(F.col("new_note").isNull(), F.col("note")).otherwise(safe_str(F.col("new_note"), 500)).alias("note"),
        F.when(F.col("new_tags").isNull(), F.col("tags")).otherwise(clean_tags(F.col("new_tags"))).alias("tags"), words.cast("long").alias("word_count"),
        (F.coalesce("clean_ver", F.lit(0)) + 1).cast("long").alias("clean_ver"), F.lit(now).cast("long").alias("updated_at"), F.lit("creating").alias("status"), *([added] if added is not None else [])]


def _asked(requests: DataFrame, books: DataFrame, shelf: DataFrame) -> DataFrame:
    """requests(id, titles, new_title, new_author, new_note, new_tags, new_words, ...) beside the books, with why one can't be taken."""
    rows = requests.withColumn("titles", F.slice(F.coalesce("titles", F.array().cast("array<string>")), 1, CHAPTER_MAX))
    rows = rows.join(books.withColumn("known", F.lit(True)), "id", "left").join(shelf.select("id", F.lit(True).alias("shelved")).distinct(), "id", "left")
    return rows.withColumn("why", F.when(F.size("titles") == 0, "no_chapters").when(F.col("shelved").isNull(), "not_on_shelf").when(F.col("known").isNull(), "no_book"))


def replace(requests: DataFrame, books: DataFrame, chapters: DataFrame, orphans: DataFrame, progress: DataFrame, shelf: DataFrame, now: int) -> Update:
    """requests(id, titles, new_title, new_author, new_note, new_tags, new_words), one for a book, null for what stays ->
    the books with a table of the new titles, keys from 1. Of the registered orphans that neither table names the first
    few are swept; the rest, and the old chapters that the new table doesn't name, are registered. Progress goes to the
    chapter of the same title. Verdicts: no_chapters, not_on_shelf, no_book, replaced."""
    rows = _asked(requests, books, shelf)
    done = rows.where("why IS NULL")
    ids = done.select(F.col("id").alias("book_id"))
    old, registered = chapters.join(ids, "book_id", "left_semi"), orphans.join(ids, "book_id", "left_semi")
    new = replaced_chapters(done.select(F.col("id").alias("book_id"), F.posexplode("titles").alias("pos", "title")))
    keys = ["book_id", "key"]
    swept = sweep(registered, old.select(*keys).union(new.select(*keys)))
    left = orphan_algebra(registered, swept, old, new)
    words = F.when(F.col("new_words").isNull(), F.col("word_count")).otherwise(F.greatest(F.lit(0), F.col("new_words")))
    return Update(
        rows.select("id", F.coalesce("why", F.lit("replaced")).alias("verdict")),
        done.select(*_fields(done, None, words, now), F.lit(None).cast("string").alias("pending_batch"), F.lit(None).cast("string").alias("pending_sig")),
        new, swept.where("swept").unionByName(left.withColumn("swept", F.lit(False))),
        migrate_progress(progress.join(ids, "book_id", "left_semi"), old, new))


def extend(requests: DataFrame, books: DataFrame, chapters: DataFrame, orphans: DataFrame, shelf: DataFrame, now: int) -> Update:
    """requests(id, titles, batch, sig, new_title, ..., new_words), one for a book -> the books with more chapters, keys
    and default titles counting on from the largest number ever used. A batch that is pending isn't appended again.
    Verdicts: no_chapters, not_on_shelf, no_book, again, mismatch, too_many, appended."""
    rows = _asked(requests, books, shelf)
    whole = rows.where("why IS NULL")
    keys = append(whole.select(F.col("id").alias("book_id"), "batch", "sig", "titles", F.col("new_words").alias("words")), chapters, orphans, books)
    found = rows.join(keys.select(F.col("book_id").alias("id"), F.col("verdict").alias("how"), "start", F.col("word_count").alias("words")), "id", "left").withColumn("verdict", F.coalesce("why", "how"))
    done = found.where("verdict = 'appended'")
    n = chapters.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("n"))
    more = done.join(n, "id", "left").select(F.col("id").alias("book_id"), F.coalesce("n", F.lit(0)).alias("n"), "start", F.posexplode("titles").alias("i", "t"))
    new = more.select("book_id", (F.col("n") + F.col("i")).cast("long").alias("pos"), (F.col("start") + F.col("i")).cast("string").alias("key"), title_or_number(F.col("t"), F.col("start") + F.col("i")).alias("title"))
    old = chapters.join(done.select(F.col("id").alias("book_id")), "book_id", "left_semi").select("book_id", "pos", "key", "title")
    swept = sweep(orphans.join(whole.select(F.col("id").alias("book_id")), "book_id", "left_semi"), chapters)
    pending = [F.when(F.col("batch") != "", F.col("batch")).otherwise(F.col("pending_batch")).alias("pending_batch"), F.when(F.col("batch") != "", F.col("sig")).otherwise(F.col("pending_sig")).alias("pending_sig")]
    return Update(found.select("id", "verdict"), done.select(*_fields(done, None, F.col("words"), now), *pending), old.unionByName(new), swept)


def publication(asked: DataFrame, books: DataFrame, chapters: DataFrame, bodies: DataFrame, orphans: DataFrame, progress: DataFrame, trash: DataFrame, shelf: DataFrame, now: int) -> Update:
    """asked(id), progress(book_id, ch, ratio, at) -> the books that can be read from now on, their orphans swept or kept,
    and their rows on the shelf: pinned if either says so, and progress as it is now, else as the shelf knew it.
    Verdicts as publish() gives them."""
    verdicts = publish(asked, books, chapters, bodies, trash, shelf)
    done = verdicts.where("verdict = 'ready'").select("id", "chapter_count")
    ids = done.select(F.col("id").alias("book_id"))
    none = F.lit(None).cast("string")
    after = books.drop("chapter_count").join(done, "id").withColumns({
        "word_count": F.greatest(F.coalesce("word_count", F.lit(0)), F.lit(0)).cast("long"), "status": F.lit("ready"), "updated_at": F.lit(now).cast("long"), "pending_batch": none, "pending_sig": none})
    table = chapters.join(ids, "book_id", "left_semi")
    old = shelf.select("id", F.col("pinned").alias("was_pinned"), *[F.col(f"prog_{c}").alias(f"was_{c}") for c in ("ch", "ratio", "at")])
    fresh = progress.where("ch IS NOT NULL").select(F.col("book_id").alias("id"), F.col("ch").alias("now_ch"), F.coalesce("ratio", F.lit(0.0)).alias("now_ratio"), F.coalesce("at", F.lit(0)).alias("now_at"))
    shown = after.join(old, "id", "left").join(fresh, "id", "left")
    pick = lambda c: F.when(F.col("now_ch").isNotNull(), F.col(f"now_{c}")).otherwise(F.col(f"was_{c}")).alias(f"prog_{c}")
    pinned = (F.coalesce("was_pinned", F.lit(False)) | F.coalesce("pinned", F.lit(False))).alias("pinned")
    shown = shown.select("id", "title", "author", "chapter_count", "word_count", "clean_ver", "updated_at", pinned, *map(pick, ("ch", "ratio", "at")))
    return Update(verdicts.select("id", "verdict"), after, table, sweep(orphans.join(ids, "book_id", "left_semi"), table), progress.join(ids, "book_id", "left_semi"), shown)
