"""Raw files to tables, exports in parts, listings and streams of writes."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import books as BK
from quire.operators import export as EX
from quire.operators import importing as IM
from quire.operators import progress as PR
from quire.plans import catalogue, structure  # noqa: F401  structure registers its queries
from quire.session import shared_dir
from quire.sources.listing import listing
from quire.streaming.throttle import drain, throttled_stream


def test_import_of_files(spark, tmp_path):
    text = lambda n: "序言在此\n" + "".join(f"第{i}章 名{i}\n内容{i}\n" for i in range(1, n + 1))
    for name, raw in {"b.txt": text(3).encode("gb18030"), "a.TXT": b"\xef\xbb\xbf" + text(2).encode(), "sub/b.text": text(4).encode(), "empty.txt": b" \n", "c.md": b"no", "on shelf.txt": text(2).encode(), "long.txt": ("第1章 一\n" + "长" * 700_000 + "\n第2章 二\n短\n").encode()}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    files = IM.files_in(spark, str(tmp_path))
    got = IM.import_books(files, spark.createDataFrame([("On Shelf ",), ("on shelf",)], "title string"), 9, "某人", ("x", "", "y"))
    verdicts = {(r.name, r.title): r.verdict for r in got.files.collect()}
    assert verdicts[("a.TXT", "a")] == verdicts[("long.txt", "long")] == "imported" and verdicts[("empty.txt", "empty")] == "failed" and verdicts[("on shelf.txt", "on shelf")] == "skipped"
    assert verdicts[("b.text", "b")] == "imported" and verdicts[("b.txt", "b")] == "skipped" and len(verdicts) == 6
    assert [r.name for r in got.failures.collect()] == ["empty.txt"]
    books = {r.title: r for r in got.books.collect()}
    assert set(books) == {"a", "b", "long"} and books["b"].chapter_count == 5 and books["b"].tags == ["x", "y"] and books["b"].author == "某人"
    rows = got.chapters.join(got.bodies, ["book_id", "key"]).orderBy("book_id", "pos").collect()
    of = lambda t: [(r.pos, r.key, r.title) for r in rows if r.book_id == books[t].id]
    assert of("b") == [(0, "1", "引子"), (1, "2", "第1章 名1"), (2, "3", "第2章 名2"), (3, "4", "第3章 名3"), (4, "5", "第4章 名4")]
    assert of("long") == [(0, "1", "第1章 一（1）"), (1, "2", "第1章 一（2）"), (2, "3", "第2章 二")]
    assert books["long"].word_count == sum(r.words for r in rows if r.book_id == books["long"].id)
    again = IM.import_books(files.repartition(3), spark.createDataFrame([("on shelf",)], "title string"), 9)
    assert {r.id for r in again.books.collect()} == {r.id for r in got.books.collect()}
    none = IM.import_books(files.limit(0), spark.createDataFrame([], "title string"), 9)
    assert none.files.count() == none.books.count() == none.bodies.count() == 0


@pytest.mark.parametrize("plain", [False, True])
def test_books_of_any_size_in_parts(spark, tmp_path, plain):
    books = spark.createDataFrame([(1, "Big", "Who", 7), (2, "", None, None), (3, "None", "", 0)], "book_id long, title string, author string, word_count long")
    big = spark.range(20_000).select(F.lit(1).cast("long").alias("book_id"), F.col("id").alias("pos"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("T"), F.col("id").cast("string"))).otherwise("").alias("title"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("x\n"), F.col("id").cast("string"))).alias("text"))
    rows = big.unionByName(spark.createDataFrame([(2, 0, "only", None), (9, 0, "nobody's", "t")], big.schema)).repartition(6)
    folder = str(tmp_path / "out")
    EX.export_parts(books, rows, folder, plain)
    whole = EX.export_text_plain(books, rows) if plain else EX.export_text(books, rows, 20_000)
    want = {r.book_id: r.content for r in whole.collect()}
    got = {i: "".join(open(f, newline="").read() for f in sorted(glob.glob(f"{folder}/book_id={i}/part-*"))) for i in (1, 2)}
    assert got == want and len(glob.glob(f"{folder}/book_id=1/part-*")) > 1 and not os.path.exists(f"{folder}/book_id=9")
    if not plain:
        assert EX.export_text(books, rows).select("book_id").collect() == [(2,)]


@pytest.mark.parametrize("plain", [False, True])
def test_books_of_any_number_in_parts(spark, tmp_path, plain):
    """A book of many parts, many books of one part, books without rows, rows without a book, an odd place and no rows at all."""
    books = spark.createDataFrame([(1, "Big", "Who", 7), (2, "", None, None), (3, "None", "", 0)], "book_id long, title string, author string, word_count long")
    books = books.unionByName(spark.range(100, 400).select(F.col("id").alias("book_id"), F.lit("书").alias("title"), F.lit("甲").alias("author"), F.col("id").alias("word_count")))
    big = spark.range(20_000).select(F.lit(1).cast("long").alias("book_id"), (F.col("id") * 3).alias("pos"), F.when(F.col("id") % 5 != 0, F.concat(F.lit("T"), F.col("id").cast("string"))).otherwise("").alias("title"), F.when(F.col("id") % 7 != 0, F.concat(F.lit("x\r\n\f"), F.col("id").cast("string"))).alias("text"))
    small = spark.range(100, 400).select(F.col("id").alias("book_id"), F.lit(0).cast("long").alias("pos"), F.lit("章").alias("title"), F.lit("文\n\n").alias("text"))
    if plain:
        big = big.withColumn("pos", F.col("pos") / 3).withColumn("pos", F.col("pos").cast("long"))
    rows = big.unionByName(small).unionByName(spark.createDataFrame([(2, 0, "only", None), (9, 0, "nobody's", "t")], big.schema)).repartition(6)
    folder = str(tmp_path / "out")
    EX.export_library(books, rows, folder, plain, 20_000)
    whole = EX.export_text_plain(books, rows) if plain else EX.export_text(books, rows, 20_000)
    want, got, parts = {r.book_id: r.content for r in whole.collect()}, {}, {}
    for r in EX.read_library(spark, folder).orderBy("book_id", "part").collect():
        got[r.book_id] = got.get(r.book_id, "") + r.text
        parts.setdefault(r.part, set()).add(r.book_id)
    assert got == want and set(got) == {1, 2, *range(100, 400)}
    files = glob.glob(f"{folder}/text/part=*/part-*")
    assert len(files) == len(parts) < 40 and sum(1 in x for x in parts.values()) > 5 and max(map(len, parts.values())) > 50 and max(map(os.path.getsize, files)) < 60_000
    EX.export_library(books, rows.limit(0), str(tmp_path / "none"), plain)
    assert EX.read_library(spark, str(tmp_path / "none")).count() == 0


def test_exported_books_share_files(spark, sf):
    """Of the query's books: a file for each would be as many files as books."""
    before = set(glob.glob(f"{shared_dir(spark)}/quire-export-*"))
    books = len(catalogue.QUERIES["export_parts"](spark, sf).collect())
    (folder,) = set(glob.glob(f"{shared_dir(spark)}/quire-export-*")) - before
    assert len(glob.glob(f"{folder}/**/part-*.txt", recursive=True)) < books / 10


def test_listing_reads_the_prefixes_asked_for(spark, tmp_path):
    for p in ("meta", "raw", "text"):
        for i in range(12):
            (tmp_path / p / f"k{i % 3}").mkdir(parents=True, exist_ok=True)
            (tmp_path / p / f"k{i % 3}" / f"{i:02d}").write_text("x" * i)
    df = listing(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 3 and df.count() == 36
    two = df.where("prefix IN ('meta', 'text')")
    assert two.rdd.getNumPartitions() == 2 and two.count() == 24
    page = df.where("prefix = 'raw' AND key > 'k1/04'")
    assert page.rdd.getNumPartitions() == 1 and [r.key for r in page.collect()] == ["k1/07", "k1/10", "k2/02", "k2/05", "k2/08", "k2/11"]
    assert df.where("prefix = 'none'").count() == 0 and df.where("size > 10").count() == 3


def plain_throttle(rows, every):
    out, until, held = [], None, None
    for at, seq, ch in sorted(rows):
        while held is not None and at >= until:
            out.append((until, held))
            until, held = until + every, None
        if until is None or at >= until:
            out.append((at, ch))
            until = at + every
        else:
            held = ch
    return out + ([(until, held)] if held is not None else [])


def test_throttle_in_batch_and_in_a_stream(spark, tmp_path):
    """Places in any order over micro-batches; the last ones are sent when the stream's time has passed them."""
    rng = random.Random(8)
    schema = "book_id long, at long, seq long, ch long, ratio double"
    rows = []
    for book in (1, 2, 3):
        at = 1000
        for _ in range(60):
            at += rng.choice((10, 300, 900, 2500, 5000))
            rows.append((book, at, len(rows), len(rows), 0.5))
    want = sorted((b, t, c) for b in (1, 2, 3) for t, c in plain_throttle([r[1:4] for r in rows if r[0] == b], 1000))
    got = PR.throttled(spark.createDataFrame(rows, schema).repartition(4), 1000)
    assert sorted((r.book_id, r.sent, r.ch) for r in got.collect()) == want
    rng.shuffle(rows)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    for i in range(3):
        spark.createDataFrame(rows[i * 60 : i * 60 + 60], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(9, 10**9, 999, 999, 0.5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = throttled_stream(stream, 1000, "10 minutes").writeStream.format("memory").queryName("throttle").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert sorted((r.book_id, r.sent, r.ch) for r in spark.table("throttle").collect() if r.book_id != 9) == want


def test_a_queue_is_drained_once(spark, tmp_path):
    schema = "device long, book_id long, at long, seq long, ch long"
    for i in range(3):
        rows = [(d, b, 100 * i + b, 10 * i + d, i) for d in (1, 2) for b in range(4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def send(rows):  # book 3 fails until its second place comes, book 2 always
        return rows.withColumn("ok", ~((F.col("book_id") == 3) & (F.col("at") < 100)) & (F.col("book_id") != 2))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = drain(stream, str(tmp_path / "out"), send, str(tmp_path / "state"))
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("batch", "device", "book_id", "at", F.col("ok").cast("boolean")).collect())

    first = run()
    sent = [r[1:4] for r in first if r[4]]
    assert len(sent) == len(set(sent)) and {r[1] for r in sent} == {0, 1, 3} and [r for r in first if r[2] == 2 and r[4]] == []
    assert {r[3] for r in first if r[0] == 2 and r[2] == 2} == {202}
    os.remove(tmp_path / "state" / "commits" / "2")  # the last batch runs again, as after a lost driver
    for f in glob.glob(str(tmp_path / "state" / "commits" / ".2.crc")):
        os.remove(f)
    assert run() == first


def test_batch_actions(spark):
    shelf = spark.createDataFrame([(i, ["a", "b"] if i % 2 else None, False, 0) for i in range(6)], "id long, tags array<string>, finished boolean, updated_at long")
    trash = spark.createDataFrame([(2, None, False, 0, 5), (9, ["z"], True, 0, 6)], "id long, tags array<string>, finished boolean, updated_at long, deleted_at long")
    plan = spark.createDataFrame([(i, "updated" if i < 4 else "deferred") for i in range(6)] + [(77, "skipped")], "id long, verdict string")
    tags = lambda a, t: {r.id: r.tags for r in BK.batch_actions(plan, shelf, trash, a, 8, t)[0].collect()}
    assert tags("addTags", ("b", "c", "c")) == {0: ["b", "c"], 1: ["a", "b", "c"], 2: ["b", "c"], 3: ["a", "b", "c"], 4: None, 5: ["a", "b"]}
    assert tags("removeTags", ("a",))[1] == ["b"] and tags("removeTags", ("a",))[5] == ["a", "b"] and tags("setTags", ())[3] == []
    done = {r.id: (r.finished, r.updated_at) for r in BK.batch_actions(plan, shelf, trash, "setFinished", 8, finished=True)[0].collect()}
    assert done == {i: (True, 8) if i < 4 else (False, 0) for i in range(6)}
    left, gone = BK.batch_actions(plan, shelf, trash, "delete", 8)
    assert sorted(r.id for r in left.collect()) == [4, 5]
    assert {r.id: (r.tags, r.deleted_at) for r in gone.collect()} == {0: (None, 8), 1: (["a", "b"], 8), 2: (None, 8), 3: (["a", "b"], 8), 9: (["z"], 6)}
    with pytest.raises(ValueError):
        BK.batch_actions(plan, shelf, trash, "addTags", 8)
