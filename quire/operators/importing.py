"""Batch import: raw files to books, chapter tables, bodies and failures, each read and decoded once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import count_words, new_id, safe_str, title_of_file
from ..session import ship, spread, written
from ..sources.encoding import decoded
from .books import clean_tags, import_files
from .chapters import fit_chapters, split_chapters
from .clean import CleanOptions
from .order import running


@dataclass
class Imported:
    """files(n, name, title, encoding, verdict), failures among them; of the books that came in: books, chapters, bodies."""

    files: DataFrame
    books: DataFrame
    chapters: DataFrame
    bodies: DataFrame

    @property
    def failures(self) -> DataFrame:
        return self.files.where("verdict = 'failed'")


def files_in(spark: SparkSession, folder: str) -> DataFrame:
    """name, content of all text files below a folder, of any store that Spark reads. A file is one value, so none may be
    above 2 GB, and a task holds a file at a time."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/", -1)
    return found.where(F.lower(name).rlike("\\.(txt|text)$")).select(name.alias("name"), "content")


def import_books(
    files: DataFrame, shelf: DataFrame, now: int, author: str = "", tags: tuple[str, ...] = (), note: str = "", pattern: str | None = None, clean: CleanOptions | None = CleanOptions(),
) -> Imported:
    """files(name, content), shelf(title) -> what becomes of them, in order of their names (of equal names, of contents).

    A title is the file's name. Files that give no chapters fail; those whose title the shelf or an earlier file has are
    skipped. Chapters too long for one body are cut; keys count from 1. An id is made from the file's place, name and
    content, so that an import that is run again gives the same books. Names and digests alone are ordered; a file is
    decoded, cut and cleaned once, and its chapters are written, and what is derived from them never goes back to the bytes.
    Null content is an empty file; equal files under one name count as one.
    """
    ship(files.sparkSession)
    whole = files.select(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("content", F.lit("").cast("binary")).alias("content"))
    whole = whole.withColumn("digest", F.sha2("content", 256))
    order = running(whole.select("name", "digest").distinct(), [F.col("name").asc(), F.col("digest").asc()], label="files")
    order = order.select("name", "digest", F.col("rank").cast("long").alias("n"))
    once = spread(whole).select("name", "digest", decoded(F.col("content")).alias("x"))
    cut = split_chapters(once.select("name", "digest", "x.encoding", "x.text"), pattern=pattern, clean=clean).select("name", "digest", "encoding", "rule", "chapters")
    cut = written(cut.join(order, ["name", "digest"]).dropDuplicates(["n"]), "import")
    verdicts = import_files(cut.select("n", title_of_file(F.col("name"), F.col("n")).alias("title"), "chapters"), shelf)
    told = cut.select("n", "name", title_of_file(F.col("name"), F.col("n")).alias("title"), "encoding").join(verdicts, "n")
    came = cut.join(verdicts.where("verdict = 'imported'").select("n"), "n", "left_semi").withColumn("book_id", new_id(F.concat_ws("\n", F.col("n").cast("string"), "name", "digest")))
    parts = fit_chapters(came.select("book_id", F.posexplode("chapters").alias("pos", "c")).select("book_id", "pos", "c.title", "c.content"), "book_id")
    # a book's chapters come from one row, so they can be numbered in one place
    placed = parts.withColumn("pos", F.row_number().over(Window.partitionBy("book_id").orderBy("pos", "part")).cast("long") - 1)
    placed = written(placed.select("book_id", "pos", (F.col("pos") + 1).cast("string").alias("key"), safe_str(F.col("title"), 120).alias("title"), F.col("content").alias("text"), count_words(F.col("content")).cast("long").alias("words")), "chapters")
    sums = placed.groupBy(F.col("book_id").alias("id")).agg(F.count("*").alias("chapter_count"), F.sum("words").alias("word_count"))
    stamp = F.lit(now).cast("long")
    kept = clean_tags(F.array(*map(F.lit, tags)).cast("array<string>"))
    books = came.select(F.col("book_id").alias("id"), "n", safe_str(title_of_file(F.col("name"), F.col("n")), 120).alias("title")).join(sums, "id").select(
        "id", "n", "title", safe_str(F.lit(author), 60).alias("author"), safe_str(F.lit(note), 500).alias("note"), kept.alias("tags"), "chapter_count", "word_count", F.lit(1).cast("long").alias("clean_ver"),
        stamp.alias("created_at"), stamp.alias("updated_at"), F.lit(False).alias("pinned"), F.lit("ready").alias("status"))
    return Imported(told, books, placed.select("book_id", "pos", "key", "title", "words"), placed.select("book_id", "key", "text"))
