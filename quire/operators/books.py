"""The life of books as transformations of tables: create, fill, publish, edit, trash, restore, purge, import.

Tables: books(id, title, author, note, tags, word_count, clean_ver, created_at, updated_at, pinned, status),
chapters(book_id, pos, key, title, words), bodies(book_id, key, text), trash(id, deleted_at, ...), shelf(id, ...).
Every function gives new tables and writes nothing; what was asked for and refused has a verdict that says why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import count_words, norm_title, safe_str, trim_ws
from .edits import add_tags, remove_tags, set_tags

#: Limits of the library.
CHAPTER_MAX, TAG_MAX, BULK_CHAPTERS, CHAPTER_BYTES, BULK_BYTES, BATCH_BOOKS = 20_000, 10, 40, 2_097_152, 16 * 1024 * 1024, 18
PURGE_BATCH, SWEEP_BATCH = 30, 24


def title_or_number(title: Column, number: Column) -> Column:
    safe = safe_str(title, 120)
    return F.when(safe == "", F.concat(F.lit("第"), number.cast("string"), F.lit("章"))).otherwise(safe)


def given_title(title: Column, number: Column) -> Column:
    """The title that an editor gives: the chapter's number if it is blank, else what is safe of it."""
    kept = trim_ws(F.coalesce(title, F.lit("")))
    return F.when(kept == "", F.concat(F.lit("第"), number.cast("string"), F.lit("章"))).otherwise(safe_str(kept, 120))


def version(clean_ver: Column) -> Column:
    """A book's version; null and 0 count as 1."""
    return F.coalesce(F.when(clean_ver != 0, clean_ver), F.lit(1)).cast("long")


def clean_tags(tags: Column) -> Column:
    return F.slice(F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: safe_str(t, 30)), lambda t: t != ""), 1, TAG_MAX)


def create_payload(titles: Column) -> Column:
    """What a request to create a book carries of its chapters: their titles, up to the limit."""
    return F.slice(F.coalesce(titles, F.array().cast("array<string>")), 1, CHAPTER_MAX)


def create(requests: DataFrame, shelf: DataFrame, now: int) -> DataFrame:
    """requests(id, title, author, note, tags, word_count, clean_ver, pinned, titles), shelf(title) -> the books as they
    would be stored, status 'creating', with verdict: no_title, no_chapters, duplicate (of one on the shelf) or created.
    titles become chapters by new_chapters()."""
    taken = shelf.select(norm_title(F.col("title")).alias("__k")).distinct().withColumn("__d", F.lit(True))
    rows = requests.select(
        "id", safe_str(F.col("title"), 120).alias("title"), safe_str(F.col("author"), 60).alias("author"), safe_str(F.col("note"), 500).alias("note"), clean_tags(F.col("tags")).alias("tags"),
        F.greatest(F.lit(0), F.coalesce("word_count", F.lit(0))).cast("long").alias("word_count"), F.coalesce(F.when(F.col("clean_ver") != 0, F.col("clean_ver")), F.lit(1)).cast("long").alias("clean_ver"),
        F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"), F.coalesce("pinned", F.lit(False)).alias("pinned"), F.lit("creating").alias("status"),
        create_payload(F.col("titles")).alias("titles"))
    rows = rows.withColumn("__k", norm_title(F.col("title"))).join(taken, "__k", "left")
    verdict = F.when(F.col("title") == "", "no_title").when(F.size("titles") == 0, "no_chapters").when(F.col("__d"), "duplicate").otherwise("created")
    return rows.withColumn("verdict", verdict).drop("__k", "__d")


def new_chapters(created: DataFrame) -> DataFrame:
    """The chapter table of the books that create() made: keys count from 1."""
    rows = created.where("verdict = 'created'").select(F.col("id").alias("book_id"), F.posexplode("titles").alias("pos", "t"))
    return rows.select("book_id", F.col("pos").cast("long").alias("pos"), (F.col("pos") + 1).cast("string").alias("key"), title_or_number(F.col("t"), F.col("pos") + 1).alias("title"), F.lit(None).cast("long").alias("words"))


def put_bodies(items: DataFrame, books: DataFrame, trash: DataFrame, chapters: DataFrame) -> DataFrame:
    """items(book_id, request, key, size) -> book_id, request, verdict. A request is taken whole or not at all: not for a
    book that is missing, published or in the trash, with more than 40 chapters, a key that the table lacks, a chapter of
    over 2 MB or over 16 MB in all."""
    table = chapters.select("book_id", "key").distinct().withColumn("__in", F.lit(1))
    rows = items.join(table, ["book_id", "key"], "left").groupBy("book_id", "request").agg(
        F.count("*").alias("n"), F.count_if(F.col("__in").isNull()).alias("lost"), F.max("size").alias("most"), F.sum("size").alias("total"))
    rows = rows.join(books.select(F.col("id").alias("book_id"), "status"), "book_id", "left").join(trash.select(F.col("id").alias("book_id")).distinct().withColumn("__t", F.lit(1)), "book_id", "left")
    verdict = (
        F.when(F.col("n") > BULK_CHAPTERS, "too_many").when(F.col("status").isNull(), "no_book").when(F.col("status") == "ready", "published").when(F.col("__t") == 1, "in_trash")
        .when(F.col("lost") > 0, "no_chapter").when((F.col("most") > CHAPTER_BYTES) | (F.col("total") > BULK_BYTES), "too_large").otherwise("stored"))
    return rows.select("book_id", "request", verdict.alias("verdict"))


def sweep(orphans: DataFrame, live: DataFrame, most: int = SWEEP_BATCH) -> DataFrame:
    """orphans(book_id, key, i), live(book_id, key) -> book_id, key, swept: of each book's orphans that no table names the
    first ``most`` go now, the others stay registered."""
    rows = orphans.join(live.select("book_id", "key").distinct(), ["book_id", "key"], "left_anti").groupBy("book_id", "key").agg(F.min("i").alias("i"))
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("i", "key"))
    return rows.select("book_id", "key", (n <= most).alias("swept"))


def orphan_algebra(registered: DataFrame, swept: DataFrame, old: DataFrame, live: DataFrame) -> DataFrame:
    """(book_id, key) each: the orphans after a table is replaced, (registered, not swept, and old keys) - live - swept."""
    keys = ["book_id", "key"]
    every = registered.select(*keys).union(swept.where("NOT swept").select(*keys)).union(old.select(*keys)).distinct()
    return every.join(live.select(*keys).distinct(), keys, "left_anti").join(swept.where("swept").select(*keys), keys, "left_anti")


def replaced_chapters(titles: DataFrame) -> DataFrame:
    """titles(book_id, pos, title): the table that replaces a book's chapters; keys count from 1 again."""
    rows = titles.where(F.col("pos") < CHAPTER_MAX)
    return rows.select("book_id", F.col("pos").cast("long").alias("pos"), (F.col("pos") + 1).cast("string").alias("key"), title_or_number(F.col("title"), F.col("pos") + 1).alias("title"))


def append(requests: DataFrame, chapters: DataFrame, orphans: DataFrame, books: DataFrame) -> DataFrame:
    """requests(book_id, batch, sig, titles, words), books(id, word_count, clean_ver, pending_batch, pending_sig) ->
    book_id, verdict (appended, again, mismatch, too_many), start (the first key), word_count, clean_ver. Keys go on after
    the largest number that the table or the orphans ever had. A batch that is pending is not appended twice: the same
    titles are answered as before, others are refused."""
    number = F.expr("CASE WHEN key RLIKE '^[0-9]+$' THEN try_cast(key AS bigint) END")
    top = chapters.select("book_id", "key").union(orphans.select("book_id", "key")).groupBy("book_id").agg(F.max(number).alias("top"))
    n = chapters.groupBy("book_id").agg(F.count("*").alias("n"))
    rows = requests.join(books.withColumnRenamed("id", "book_id"), "book_id").join(top, "book_id", "left").join(n, "book_id", "left")
    n, again = F.coalesce("n", F.lit(0)), F.coalesce((F.col("batch") != "") & (F.col("batch") == F.col("pending_batch")), F.lit(False))
    verdict = F.when(again, F.when(F.col("sig").eqNullSafe(F.col("pending_sig")), "again").otherwise("mismatch")).when(n + F.size("titles") > CHAPTER_MAX, "too_many").otherwise("appended")
    added = verdict == "appended"
    return rows.select(
        "book_id", verdict.alias("verdict"), F.when(added, F.greatest(n, F.coalesce("top", F.lit(0))) + 1).cast("long").alias("start"),
        F.when(added, F.greatest(F.lit(0), F.coalesce("word_count", F.lit(0)) + F.coalesce("words", F.lit(0)))).otherwise(F.col("word_count")).cast("long").alias("word_count"),
        (F.coalesce("clean_ver", F.lit(0)) + F.when(added, 1).otherwise(0)).cast("long").alias("clean_ver"))


def publish(asked: DataFrame, books: DataFrame, chapters: DataFrame, bodies: DataFrame, trash: DataFrame, shelf: DataFrame) -> DataFrame:
    """asked(id) -> id, verdict, chapter_count: no_book, no_chapters, in_trash, incomplete (the first, middle or last
    chapter has no body), duplicate (first publication, and another book on the shelf has the title) or ready."""
    n = chapters.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("n"))
    probe = chapters.withColumnRenamed("book_id", "id").join(n, "id").where("pos IN (0, n div 2, n - 1)")
    lost = probe.join(bodies.select(F.col("book_id").alias("id"), "key").distinct(), ["id", "key"], "left_anti").select("id").distinct().withColumn("lost", F.lit(True))
    titles = shelf.groupBy(norm_title(F.col("title")).alias("k")).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    rows = asked.select("id").distinct().join(books.select("id", "title"), "id", "left").withColumn("k", norm_title(F.col("title"))).join(n, "id", "left").join(lost, "id", "left")
    rows = rows.join(trash.select("id", F.lit(True).alias("gone")).distinct(), "id", "left").join(shelf.select("id", F.lit(True).alias("old")).distinct(), "id", "left").join(titles, "k", "left")
    verdict = (
        F.when(F.col("title").isNull(), "no_book").when(F.col("n").isNull(), "no_chapters").when(F.col("gone"), "in_trash").when(F.col("lost"), "incomplete")
        .when(F.col("old").isNull() & F.col("lo").isNotNull() & ((F.col("lo") != F.col("id")) | (F.col("hi") != F.col("id"))), "duplicate").otherwise("ready"))
    return rows.select("id", verdict.alias("verdict"), F.when(verdict == "ready", F.col("n")).cast("long").alias("chapter_count"))


def rollback(requests: DataFrame, books: DataFrame) -> DataFrame:
    """requests(id, op, count, words, batch), books(id, status, chapter_count, word_count, pending_batch) -> id, verdict
    (noop, ready), chapter_count, word_count: an unfinished update is taken back; a pending append loses its last chapters."""
    rows = requests.join(books, "id")
    undo = (F.col("op") == "append") & F.col("count").between(1, F.col("chapter_count")) & F.col("pending_batch").isNotNull() & ((F.col("batch") == "") | (F.col("batch") == F.col("pending_batch")))
    going = F.col("status") == "creating"
    undo = going & F.coalesce(undo, F.lit(False))
    return rows.select(
        "id", F.when(going, "ready").otherwise("noop").alias("verdict"), (F.col("chapter_count") - F.when(undo, F.col("count")).otherwise(0)).cast("long").alias("chapter_count"),
        F.when(undo, F.greatest(F.lit(0), F.col("word_count") - F.greatest(F.lit(0), F.col("words")))).otherwise(F.col("word_count")).cast("long").alias("word_count"))


def _words_of(bodies: DataFrame) -> DataFrame:
    return bodies.select("book_id", "key", count_words(F.col("text")).alias("disk"))


def patch_chapters(patches: DataFrame, chapters: DataFrame, bodies: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """patches(book_id, key, new_title, new_text), one for a chapter, null for what stays -> verdicts (book_id, key,
    verdict: no_chapter, nothing, too_large, patched), the chapter tables of the books with a patch that is taken, and their
    (id, word_count, clean_ver). A blank title becomes the chapter's number. A chapter's words before are those it has
    stored, else those of its body."""
    asked = patches.join(chapters.select("book_id", "key", F.lit(True).alias("__in")).distinct(), ["book_id", "key"], "left")
    verdict = (
        F.when(F.col("__in").isNull(), "no_chapter").when(F.col("new_title").isNull() & F.col("new_text").isNull(), "nothing")
        .when(F.octet_length("new_text") > CHAPTER_BYTES, "too_large").otherwise("patched"))
    asked = asked.withColumn("verdict", verdict).drop("__in")
    taken = asked.where("verdict = 'patched'").drop("verdict")
    rows = chapters.join(taken.select("book_id").distinct(), "book_id", "left_semi").join(taken.withColumn("__p", F.lit(True)), ["book_id", "key"], "left").join(_words_of(bodies), ["book_id", "key"], "left")
    title = F.when(F.col("new_title").isNull(), F.col("title")).otherwise(given_title(F.col("new_title"), F.col("pos") + 1))
    new = F.when(F.col("new_text").isNotNull(), count_words(F.col("new_text")))
    rows = rows.withColumn("new", new).withColumn("gain", F.coalesce(F.col("new") - F.coalesce("words", "disk", F.lit(0)), F.lit(0)))
    sums = rows.groupBy(F.col("book_id").alias("id")).agg(F.sum("gain").alias("gain"), F.count("__p").alias("edits"))
    out = books.join(sums, "id").select("id", F.greatest(F.lit(0), F.coalesce("word_count", F.lit(0)) + F.col("gain")).cast("long").alias("word_count"), (version(F.col("clean_ver")) + F.col("edits")).cast("long").alias("clean_ver"))
    return asked.select("book_id", "key", "verdict"), rows.select("book_id", "pos", "key", title.alias("title"), F.coalesce("new", "words").cast("long").alias("words")), out


def insert_chapters(requests: DataFrame, chapters: DataFrame, progress: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """requests(book_id, after, title, text, new_key), one for a book -> verdicts (empty, too_large, no_chapter, too_many,
    inserted), the chapter tables of the books with the new chapter after the one asked for (null or '': at the end), their
    progress, moved by one where it lies behind, and their (id, chapter_count, word_count, clean_ver)."""
    n = chapters.groupBy("book_id").agg(F.count("*").alias("n"))
    asked = requests.withColumn("after", F.when(F.col("after") != "", F.col("after")))
    at = asked.join(n, "book_id", "left").join(chapters.select("book_id", F.col("key").alias("after"), "pos"), ["book_id", "after"], "left")
    n_, text = F.coalesce("n", F.lit(0)), F.coalesce("text", F.lit(""))
    verdict = (
        F.when((trim_ws(F.coalesce("title", F.lit(""))) == "") & (text == ""), "empty").when(F.octet_length(text) > CHAPTER_BYTES, "too_large")
        .when(F.col("after").isNotNull() & F.col("pos").isNull(), "no_chapter").when(n_ >= CHAPTER_MAX, "too_many").otherwise("inserted"))
    at = at.select("book_id", verdict.alias("verdict"), F.when(F.col("after").isNull(), n_).otherwise(F.col("pos") + 1).cast("long").alias("at"), "title", count_words(text).alias("gain"), "new_key", n_.alias("n"))
    done = at.where("verdict = 'inserted'")
    moved = chapters.join(done.select("book_id", "at"), "book_id").select("book_id", (F.col("pos") + F.when(F.col("pos") >= F.col("at"), 1).otherwise(0)).cast("long").alias("pos"), "key", "title", "words")
    new = done.select("book_id", F.col("at").alias("pos"), F.col("new_key").alias("key"), given_title(F.col("title"), F.col("at") + 1).alias("title"), F.col("gain").cast("long").alias("words"))
    shifted = progress.join(done.select("book_id", "at"), "book_id").select("book_id", F.when((F.col("ch") >= 1) & (F.col("ch") - 1 >= F.col("at")), F.col("ch") + 1).otherwise(F.col("ch")).cast("long").alias("ch"))
    rows = books.join(done.select(F.col("book_id").alias("id"), "gain", "n"), "id").select(
        "id", (F.col("n") + 1).cast("long").alias("chapter_count"), (F.coalesce("word_count", F.lit(0)) + F.col("gain")).cast("long").alias("word_count"), (version(F.col("clean_ver")) + 1).alias("clean_ver"))
    return at.select("book_id", "verdict", "at"), moved.unionByName(new), shifted, rows


def delete_chapters(requests: DataFrame, chapters: DataFrame, bodies: DataFrame, progress: DataFrame, books: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """requests(book_id, key), one for a book -> verdicts (no_chapter, last, deleted) with the words lost, the chapter
    tables of the books without it, their progress, moved by one where it lies behind and kept within the table, and
    their (id, chapter_count, word_count, clean_ver)."""
    n = chapters.groupBy("book_id").agg(F.count("*").alias("n"))
    rows = requests.join(chapters, ["book_id", "key"], "left").join(n, "book_id", "left").join(_words_of(bodies), ["book_id", "key"], "left")
    verdict = F.when(F.col("pos").isNull(), "no_chapter").when(F.col("n") <= 1, "last").otherwise("deleted")
    rows = rows.select("book_id", verdict.alias("verdict"), F.col("pos").alias("at"), "n", F.when(verdict == "deleted", F.coalesce("words", "disk", F.lit(0))).otherwise(0).cast("long").alias("lost"))
    done = rows.where("verdict = 'deleted'").select("book_id", "at", "n", "lost")
    left = chapters.join(done.select("book_id", "at"), "book_id").where("pos <> at").select("book_id", (F.col("pos") - F.when(F.col("pos") > F.col("at"), 1).otherwise(0)).cast("long").alias("pos"), "key", "title", "words")
    moved = F.least(F.when(F.col("ch") - 1 > F.col("at"), F.col("ch") - 1).otherwise(F.col("ch")), F.col("n") - 1)
    shifted = progress.join(done, "book_id").select("book_id", F.when(F.col("ch") >= 1, moved).otherwise(F.col("ch")).cast("long").alias("ch"))
    out = books.join(done.select(F.col("book_id").alias("id"), "n", "lost"), "id").select(
        "id", (F.col("n") - 1).cast("long").alias("chapter_count"), F.greatest(F.lit(0), F.coalesce("word_count", F.lit(0)) - F.col("lost")).cast("long").alias("word_count"), (version(F.col("clean_ver")) + 1).alias("clean_ver"))
    return rows.select("book_id", "verdict", "lost"), left, shifted, out


def soft_delete(ids: DataFrame, shelf: DataFrame, books: DataFrame, trash: DataFrame, now: int) -> DataFrame:
    """ids(id) -> id, verdict, deleted_at: books of the shelf, and unpublished ones, go to the trash; one that lies there
    already has a new time only if it was on the shelf again."""
    flag = lambda df, name: df.select("id", F.lit(True).alias(name)).distinct()
    rows = ids.select("id").distinct().join(flag(shelf, "on"), "id", "left").join(flag(books, "known"), "id", "left").join(trash.groupBy("id").agg(F.max("deleted_at").alias("was")), "id", "left")
    verdict = F.when(F.col("on"), "moved").when(F.col("was").isNotNull() & F.col("known"), "unchanged").when(F.col("known"), "moved").otherwise("no_book")
    return rows.select("id", verdict.alias("verdict"), F.when(verdict == "moved", F.lit(now)).when(verdict == "unchanged", F.col("was")).cast("long").alias("deleted_at"))


def restorable() -> Column:
    """Over trash(purge, purging, purge_cursor): nothing of the book has been cleared."""
    return ~F.coalesce("purging", F.lit(False)) & (F.coalesce(F.size("purge"), F.lit(0)) <= 0) & F.col("purge_cursor").isNull()


def trash_list(trash: DataFrame) -> DataFrame:
    """The trash as it is shown, the last deletion first: with the number of bodies left to clear and whether it can come back."""
    return trash.select(
        "id", "title", "author", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "chapter_count", "word_count", "deleted_at",
        F.greatest(F.lit(0), F.coalesce(F.size("purge"), F.lit(0))).cast("long").alias("purge"), F.coalesce("purging", F.lit(False)).alias("purging"), restorable().alias("restorable"))


def newest_deleted(trash: DataFrame, n: int) -> DataFrame:
    first = trash.orderBy(F.desc(F.coalesce("deleted_at", F.lit(0))), "id").limit(n)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.coalesce("deleted_at", F.lit(0))), "id")).cast("long"))


def restore(ids: DataFrame, trash: DataFrame, books: DataFrame) -> DataFrame:
    """ids(id) -> id, verdict: not_in_trash, purging, no_book, unpublished or restored."""
    rows = ids.select("id").distinct().join(trash.select("id", restorable().alias("whole")), "id", "left").join(books.select("id", "status"), "id", "left")
    verdict = F.when(F.col("whole").isNull(), "not_in_trash").when(~F.col("whole"), "purging").when(F.col("status").isNull(), "no_book").when(F.col("status") != "ready", "unpublished").otherwise("restored")
    return rows.select("id", verdict.alias("verdict"))


def purge(keys: DataFrame, most: int = PURGE_BATCH) -> tuple[DataFrame, DataFrame]:
    """keys(book_id, key, i), the bodies of books to clear -> those that go now, the first ``most`` of each book, and
    (book_id, deleted, remaining, done); a book that is done loses its other objects too."""
    n = F.row_number().over(Window.partitionBy("book_id").orderBy("i", "key"))
    rows = keys.withColumn("n", n)
    state = rows.groupBy("book_id").agg(F.count_if(F.col("n") <= most).alias("deleted"), F.count_if(F.col("n") > most).alias("remaining"))
    return rows.where(F.col("n") <= most).select("book_id", "key"), state.withColumn("done", F.col("remaining") == 0)


def sweep_trash(trash: DataFrame, now: int, days: int = 15, most: int = 1) -> DataFrame:
    """Of the books whose time in the trash is over the first few, in order of id; a request clears no more."""
    return trash.where(F.lit(now) - F.coalesce("deleted_at", F.lit(0)) > days * 86_400_000).orderBy("id").limit(most)


def delete_objects(asked: DataFrame, chapters: DataFrame, live: DataFrame, most: int) -> DataFrame:
    """asked(rank, book_id, key, prefix) -> rank, verdict: skipped for what may not go (other prefixes, bodies that a
    table names, originals and progress of live books), else deleted for the first ``most`` and deferred for the rest."""
    named = chapters.select("book_id", "key", F.lit("text").alias("prefix"), F.lit(True).alias("named")).distinct()
    rows = asked.join(named, ["book_id", "key", "prefix"], "left").join(live.select("book_id", F.lit(True).alias("alive")).distinct(), "book_id", "left")
    bad = ~F.col("prefix").isin("text", "raw", "progress") | F.coalesce("named", F.lit(False)) | ((F.col("prefix") != "text") & F.coalesce("alive", F.lit(False)))
    rows = rows.withColumn("bad", bad)
    first = rows.where("NOT bad").orderBy("rank").limit(most).agg(F.max("rank").alias("last"))
    rows = rows.join(F.broadcast(first))  # one row
    return rows.select("rank", F.when(F.col("bad"), "skipped").when(F.col("rank") <= F.col("last"), "deleted").otherwise("deferred").alias("verdict"))


def batch_plan(asked: DataFrame, shards: DataFrame, shelf: DataFrame, deleting: bool = False, budget: int = 48) -> DataFrame:
    """asked(rank, id) -> id, verdict of a batch on books: ids of other forms and repeated ones count once or not, no more
    than 18 are looked at, of these the longest prefix whose estimate of requests fits is worked on: updated where it is
    on the shelf, else skipped; the rest is deferred."""
    ids = asked.where(F.col("id").cast("string").rlike("^[A-Za-z0-9_-]{1,80}$")).groupBy("id").agg(F.min("rank").alias("rank"))
    first = ids.orderBy("rank").limit(BATCH_BOOKS).join(shards.select("id", "shard"), "id", "left").withColumn("on", F.lit(True))
    by_rank = Window.orderBy("rank")  # at most 18 rows
    new = F.when(F.col("shard").isNotNull() & (F.row_number().over(Window.partitionBy("shard").orderBy("rank")) == 1), 1).otherwise(0)
    rows = first.withColumn("new", new).withColumn("k", F.sum("new").over(by_rank)).withColumn("n", F.sum(F.when(F.col("shard").isNotNull(), 1).otherwise(0)).over(by_rank))
    cost = (5 + 3 * F.col("k") if deleting else 1 + 3 * F.col("k") + 4 * F.col("n")) + 2 + 3 * F.col("k")
    broken = F.max(F.col("shard").isNotNull() & (cost > budget)).over(by_rank)  # from the first that doesn't fit on
    rows = rows.withColumn("fits", ~broken).join(shelf.select("id", F.lit(True).alias("shelved")).distinct(), "id", "left")
    verdict = F.when(~F.col("fits"), "deferred").when(F.col("shard").isNull(), "skipped").when(F.col("shelved"), "updated").otherwise("skipped")
    rest = ids.join(first.select("id"), "id", "left_anti").select("id", F.lit("deferred").alias("verdict"))
    return rows.select("id", verdict.alias("verdict")).union(rest)


def import_files(files: DataFrame, shelf: DataFrame) -> DataFrame:
    """files(n, title, chapters) in order n, as split_chapters makes them, shelf(title) -> n, verdict: failed without
    chapters, skipped where the shelf or an imported file before has the title, else imported."""
    taken = shelf.select(norm_title(F.col("title")).alias("k")).distinct().withColumn("taken", F.lit(True))
    rows = files.select("n", norm_title(F.col("title")).alias("k"), (F.size("chapters") > 0).alias("whole")).join(taken, "k", "left")
    first = rows.where("whole AND taken IS NULL").groupBy("k").agg(F.min("n").alias("first"))
    rows = rows.join(first, "k", "left")
    return rows.select("n", F.when(~F.col("whole"), "failed").when(F.col("first") == F.col("n"), "imported").otherwise("skipped").alias("verdict"))


def with_progress(shelf: DataFrame, progress: DataFrame) -> DataFrame:
    """The shelf with each book's fresh progress, kept within its chapters; a book without any keeps what it had."""
    fresh = progress.select("id", F.col("ch").alias("n_ch"), F.col("ratio").alias("n_ratio"), F.col("at").alias("n_at"))
    rows = shelf.join(fresh, "id", "left")
    cap = F.when((F.col("chapter_count") > 0) & (F.col("n_ch") > F.col("chapter_count")), F.col("chapter_count")).otherwise(F.col("n_ch"))
    has = F.col("n_at").isNotNull()
    pick = lambda new, old: F.when(has, new).otherwise(F.col(old)).alias(old)
    return rows.select(*[c for c in shelf.columns if not c.startswith("prog_")], pick(cap, "prog_ch"), pick(F.coalesce("n_ratio", F.lit(0.0)), "prog_ratio"), pick(F.col("n_at"), "prog_at"))


def sync_index(shelf: DataFrame, edited: DataFrame) -> DataFrame:
    """edited(id, title, word_count, chapter_count, ...) after an edit: the shelf's rows of these books made anew, but
    pinned and what is known of progress kept; books that aren't on the shelf stay off it."""
    keep = shelf.select("id", "pinned", *[c for c in shelf.columns if c.startswith("prog_")])
    return edited.select("id", *[c for c in shelf.columns if c in edited.columns and c not in keep.columns]).join(keep, "id")


def patch_fields(books: DataFrame, patch: DataFrame, fields: tuple[str, ...], now: int) -> DataFrame:
    """patch(id, fields): a null field keeps the book's; the time of the change is always new."""
    p = patch.select("id", *[F.col(c).alias(f"p_{c}") for c in fields])
    return books.join(p, "id").select("id", *[F.coalesce(f"p_{c}", c).alias(c) for c in fields], F.lit(now).cast("long").alias("updated_at"))


def batch_actions(plan: DataFrame, shelf: DataFrame, trash: DataFrame, action: str, now: int, tags: tuple[str, ...] = (), finished: bool = False) -> tuple[DataFrame, DataFrame]:
    """plan(id, verdict), shelf(id, tags, finished, updated_at, ...), trash(id, deleted_at, the shelf's columns) -> the shelf
    and the trash after ``action`` (addTags, removeTags, setTags, setFinished, delete) on the books that the plan updates.
    A deleted book leaves the shelf; in the trash it has the shelf's row, or a new time if it was there."""
    given = [t for t in dict.fromkeys(tags)]
    if action not in ("addTags", "removeTags", "setTags", "setFinished", "delete"):
        raise ValueError("no such action")
    if action in ("addTags", "removeTags") and not given:
        raise ValueError("no tags")
    hit = shelf.join(plan.where("verdict = 'updated'").select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    on = F.coalesce("__hit", F.lit(False))
    if action == "delete":
        gone = hit.where(on).drop("__hit").withColumn("deleted_at", F.lit(now).cast("long"))
        again = trash.join(gone.select("id", F.lit(now).cast("long").alias("__now")), "id", "left").withColumn("deleted_at", F.coalesce("__now", "deleted_at")).drop("__now")
        return hit.where(~on).drop("__hit"), again.unionByName(gone.join(trash.select("id"), "id", "left_anti"), allowMissingColumns=True)
    had = F.coalesce("tags", F.array().cast("array<string>"))
    new = {
        "addTags": lambda: add_tags(had, given), "removeTags": lambda: remove_tags(had, given), "setTags": lambda: set_tags(given), "setFinished": lambda: F.col("tags")}[action]()
    out = hit.withColumns({"tags": F.when(on, new).otherwise(F.col("tags")), "updated_at": F.when(on, F.lit(now)).otherwise(F.col("updated_at")).cast("long")})
    if action == "setFinished":
        out = out.withColumn("finished", F.when(on, F.lit(finished)).otherwise(F.col("finished")))
    return out.drop("__hit"), trash
