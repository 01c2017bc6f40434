"""Export: a book as one text in two layouts, and a feed."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import default_title, esc_xml
from ..session import written
from .order import running

#: Chapters of a book that is given as one row, and that a book may have.
MAX_CHAPTERS, CHAPTER_MAX = 40, 20_000
#: About the bytes of a file that holds many books.
FILE_BYTES = 8 << 20


def _ordered(rows: DataFrame, block: Column, sep: str, most: int) -> DataFrame:
    """book_id, n, body of books of up to ``most`` chapters, which are counted before anything is gathered."""
    n = rows.groupBy("book_id").agg(F.count("*").alias("n")).where(F.col("n") <= most)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), sep)
    return rows.join(n, "book_id").groupBy("book_id", "n").agg(body.alias("body"))


def _head(n: Column) -> Column:
    author = F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit("作者："), "author", F.lit("\n"))).otherwise("")
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("未命名"))
    return F.concat(title, F.lit("\n"), author, F.lit("共 "), n.cast("string"), F.lit(" 章 · "), F.coalesce("word_count", F.lit(0)).cast("string"), F.lit(" 字\n\n"))


def _plain_head() -> Column:
    return F.concat("title", F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit("　作者："), "author")).otherwise(""), F.lit("\n\n"))


def export_text(books: DataFrame, rows: DataFrame, most: int = MAX_CHAPTERS) -> DataFrame:
    """books(book_id, title, author, word_count), rows(book_id, pos, title, text) -> book_id, content, of books of up to ``most`` chapters."""
    blocks = _ordered(rows, F.concat(F.lit("\n"), "title", F.lit("\n\n"), F.coalesce("text", F.lit(""))), "", most)
    return books.join(blocks, "book_id").select("book_id", F.concat(_head(F.col("n")), "body", F.lit("\n")).alias("content"))


def export_text_plain(books: DataFrame, rows: DataFrame, most: int = CHAPTER_MAX) -> DataFrame:
    """The second layout, of books of up to ``most`` chapters, as many as a book may have; chapters without a text are
    empty and counted. A book is one row: where its texts are too long for that, take export_parts()."""
    block = F.concat(default_title(F.col("title"), F.col("pos") + 1), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    blocks = _ordered(rows, block, "\n", most).join(rows.groupBy("book_id").agg(F.count_if(F.col("text").isNull()).alias("missing")), "book_id")
    return books.join(blocks, "book_id").select("book_id", F.concat(_plain_head(), "body").alias("content"), "missing")


def export_parts(books: DataFrame, rows: DataFrame, folder: str, plain: bool = False) -> None:
    """Books of any size, but not very many, as text files under ``folder``, in a folder for each book: its files, in order of their names, are
    its text in the layout of export_text() or, if ``plain``, export_text_plain().

    A head or a chapter is a row. Rows are dealt to ranges of book and place and sorted within, so a book may be many
    tasks' work and no task holds more than a row and its sort's buffers. A line feed follows each row, which the
    layouts allow for: it is the one between two chapters and at the end.
    """
    n = rows.groupBy("book_id").agg(F.count("*").alias("__n"))
    chapters = rows.join(n, "book_id").join(books.select("book_id").distinct(), "book_id", "left_semi")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = _blocks(books.join(n, "book_id"), chapters, plain).repartitionByRange(parts, "book_id", "pos").sortWithinPartitions("book_id", "pos")
    ordered.select("book_id", "value").write.partitionBy("book_id").text(folder)


def _blocks(books: DataFrame, rows: DataFrame, plain: bool, *more: str) -> DataFrame:
    """book_id, pos, value: the heads, before all places, and the chapters; both come with __n, a book's number of chapters."""
    text = F.coalesce("text", F.lit(""))
    if plain:
        last = F.when(F.col("pos") + 1 < F.col("__n"), "\n").otherwise("")
        block = F.concat(default_title(F.col("title"), F.col("pos") + 1), F.lit("\n\n"), text, last)
        head = F.expr("left(__h, length(__h) - 1)")
    else:
        block, head = F.concat("title", F.lit("\n\n"), text), F.col("__h")
    heads = books.withColumn("__h", _plain_head() if plain else _head(F.col("__n"))).select("book_id", F.lit(-1).cast("long").alias("pos"), head.alias("value"), *more)
    return heads.unionByName(rows.select("book_id", F.col("pos").cast("long").alias("pos"), block.alias("value"), *more))


def export_library(books: DataFrame, rows: DataFrame, folder: str, plain: bool = False, size: int = FILE_BYTES) -> None:
    """Any number of books of any size as text files of about ``size`` bytes, in the layouts of export_parts(), for which
    a folder and a file for each book would be too many: ``text/part=<number>``, a file each, and ``index``, a table of
    part, book_id, first and bytes, where in a part what it has of a book begins and how long that is.

    Books stand one after the other by book_id. What goes before a book is a running sum of sizes; a chapter's part
    follows from that and from its place in the book, so that a long book may be many parts, and a part one task's work.
    Rows are written once before, so that text and index are made of the same ones.
    """
    spark, at = rows.sparkSession, F.greatest(F.col("pos").cast("long"), F.lit(0))
    weight = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in ("title", "text")), F.lit(4))
    sized = rows.groupBy("book_id").agg(F.count("*").alias("__n"), F.sum(weight).alias("__w"), F.max(at).alias("__last"))
    sized = running(sized.join(books.select("book_id").distinct(), "book_id", "left_semi"), [F.col("book_id")], F.col("__w"), "sizes")
    sized = sized.select("book_id", "__n", "__w", "__last", F.col("before").alias("__before"))
    blocks = _blocks(books.join(sized, "book_id"), rows.join(sized, "book_id"), plain, "__w", "__last", "__before")
    part = F.floor((F.col("__before") + F.floor(at / (F.col("__last") + 1) * F.col("__w"))) / size)
    blocks = written(blocks.select(part.alias("part"), "book_id", "pos", "value"), "blocks")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.repartition(parts, "part").sortWithinPartitions("part", "book_id", "pos").select("part", "value").write.partitionBy("part").text(f"{folder}/text")
    length = F.coalesce(F.octet_length("value"), F.lit(0)) + 1  # with its line feed
    before = Window.partitionBy("part").orderBy("book_id").rowsBetween(Window.unboundedPreceding, -1)
    index = blocks.groupBy("part", "book_id").agg(F.sum(length).alias("bytes"))
    index.select("part", "book_id", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("first"), "bytes").write.parquet(f"{folder}/index")


def read_library(spark: SparkSession, folder: str) -> DataFrame:
    """book_id, part, text of what export_library() has written: a book's texts, in order of the parts, are the book. A task
    holds one file at a time."""
    def cut(files: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        content = b"".join(files.sort_values("path")["content"])
        texts = [content[a:a + n].decode() for a, n in zip(index["first"], index["bytes"])]
        return pd.DataFrame({"book_id": index["book_id"], "part": index["part"], "text": texts})

    index = spark.read.parquet(f"{folder}/index")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/text").select(F.regexp_extract("path", "/part=([0-9]+)/[^/]*$", 1).cast("long").alias("part"), "path", "content")
    schema = f"book_id {index.schema['book_id'].dataType.simpleString()}, part long, text string"
    return files.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(cut, schema)


def feed_entries(page: DataFrame) -> DataFrame:
    """page(rank, id, title, author) -> rank, entry: an Atom entry with its text escaped."""
    entry = F.concat(
        F.lit("<entry><title>"), esc_xml(F.col("title")), F.lit("</title><id>urn:book:"), F.col("id").cast("string"), F.lit("</id><author><name>"), esc_xml(F.col("author")), F.lit("</name></author></entry>"))
    return page.select("rank", entry.alias("entry"))


def feed_document(page: DataFrame, number: int, total: int, newest: int, size: int = 100) -> DataFrame:
    """page(rank, id, title, author, at), one page of a feed -> feed: one Atom document with links to itself, the first
    page and its neighbours. A page has at most ``size`` entries, so they are one row."""
    stamp = lambda ms: F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = F.concat(
        F.lit("<entry><title>"), esc_xml(F.col("title")), F.lit("</title><id>urn:book:"), F.col("id").cast("string"), F.lit("</id><author><name>"), esc_xml(F.col("author")),
        F.lit("</name></author><updated>"), stamp(F.col("at")), F.lit('</updated><link rel="http://opds-spec.org/acquisition" href="/export/'), F.col("id").cast("string"), F.lit('.txt" type="text/plain"/></entry>'))
    links = [("self", number), ("start", 1)] + [("previous", number - 1)] * (number > 1) + [("next", number + 1)] * (number * size < total)
    head = "".join(f'<link rel="{rel}" href="/opds?page={n}"/>' for rel, n in links)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]), "")
    return page.limit(size).agg(F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom">'), F.lit(head), F.lit("<updated>"), stamp(F.lit(newest).cast("long")), F.lit("</updated>"), body, F.lit("</feed>")).alias("feed"))
