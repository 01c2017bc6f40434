"""The index of the shelf: a root that maps ids to shards, shards of books with backups, and planners of requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import few, ship
from .order import running

#: Books of a shard, pages of a scan, chapters and bytes of one upload.
SHARD_MAX, SHARD_CAP = 500, 40
META_PAGES, TEXT_PAGES = 3, 12
BATCH_CHAPTERS, BATCH_BYTES, AT_ONCE = 40, 12 * 1024 * 1024, 3


def write_index(books: DataFrame, folder: str) -> None:
    """books(shard, id, ...) as a table in folders by shard, in order of id."""
    books.repartition("shard").sortWithinPartitions("shard", "id").write.partitionBy("shard").parquet(folder)


def open_index(shards: DataFrame, root: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """shards(shard, id, ...): all books, or those in the shards that the root names for some ids. Of a table that
    write_index() has made only these shards' folders are read, unless they are more than can be broadcast; none is
    left out. A pointer to a shard below 0 names none."""
    if ids is None:
        return shards
    wanted = root.where("shard >= 0").join(ids.select("id").distinct(), "id", "left_semi").select("shard").distinct()
    return shards.join(few(wanted), "shard", "left_semi")


def probe_root(root: DataFrame, cap: int = SHARD_CAP) -> DataFrame:
    """shards (one more than the last number), books, and whether there are too many shards."""
    out = root.agg(F.coalesce(F.max("shard") + 1, F.lit(0)).cast("long").alias("shards"), F.count("*").alias("books"))
    return out.withColumn("over", F.col("shards") > cap)


def index_has(ids: DataFrame, root: DataFrame) -> DataFrame:
    return ids.join(root.select("id", F.lit(True).alias("has")).distinct(), "id", "left").select("id", F.coalesce("has", F.lit(False)).alias("has"))


def upsert(root: DataFrame, new: DataFrame, size: int = SHARD_MAX) -> DataFrame:
    """root(id, shard, i), i the place within the shard; new(id, n) in order n -> id, shard after the entries are put in
    one by one: known ids stay where they are, others go to the last shard, and a shard of more than ``size`` gives its
    later half to a new one. So the first split leaves half of size + 1, rounded up, and each further one too; what a
    place goes to follows from its number alone. Only the last shard and the new ids are numbered, in ranges."""
    last = root.agg(F.coalesce(F.max("shard"), F.lit(0)).alias("__last"))
    added = new.join(root.select("id"), "id", "left_anti").groupBy("id").agg(F.min("n").alias("i")).withColumn("late", F.lit(1))
    tail = root.join(F.broadcast(last), F.col("shard") == F.col("__last")).select("id", "i").withColumn("late", F.lit(0)).unionByName(added)
    half = (size + 2) // 2
    tail = running(tail, [F.col(c).asc() for c in ("late", "i", "id")], label="places")
    tail = tail.join(F.broadcast(last)).join(F.broadcast(tail.agg(F.count("*").alias("total")))).withColumn("place", F.col("rank") - 1)
    splits = F.when(F.col("total") <= size, 0).otherwise(1 + F.floor((F.col("total") - size - 1) / half))
    moved = tail.select("id", (F.col("__last") + F.least(F.floor(F.col("place") / half), splits)).cast("long").alias("shard"))
    return root.join(F.broadcast(last), F.col("shard") != F.col("__last")).select("id", F.col("shard").cast("long").alias("shard")).unionByName(moved)


def apply_log(entries: DataFrame, log: DataFrame) -> DataFrame:
    """entries(id, entry), log(n, id, op, entry[, i]), entries as maps from field to value (strings) and op one of upsert (a whole
    entry), patch (the fields that change) and remove -> id, entry, first (the upsert that brought the id in, null for one
    that was there all the time), missed (patches of an id that wasn't there), as after all operations in order n.

    Of an id's log the last upsert or remove counts, and the patches after it, of which each field's last value does. So
    it is maxima, by id and by id and field, and an id of very many operations needs no task of its own. Operations of
    one id have different n, or else an i: of those of one n the lowest i counts. Upserts have an entry.
    """
    order = F.struct("n", -F.col("i")) if "i" in log.columns else F.col("n")
    log = log.withColumn("order", order)
    whole = log.where("op <> 'patch'").groupBy("id").agg(F.max_by(F.struct("op", "entry", "n"), "order").alias("w"), F.max(F.when(F.col("op") == "remove", F.col("n"))).alias("gone"))
    fixed = entries.select("id", F.col("entry").alias("had")).join(whole, "id", "full_outer")
    # an id is there from the first upsert after its last removal on, or always
    came = log.where("op = 'upsert'").join(few(whole.select("id", "gone")), "id").where("n > coalesce(gone, n - 1)").groupBy("id").agg(F.min("n").alias("first"))
    fixed = fixed.join(came, "id", "left")
    base = F.when(F.col("w").isNull(), F.col("had")).when(F.col("w.op") == "upsert", F.col("w.entry"))
    first = F.when(F.col("had").isNull() | F.col("gone").isNotNull(), F.col("first"))
    fixed = fixed.select("id", base.alias("base"), first.alias("first"), F.coalesce("w.n", F.lit(None)).alias("since"))
    patches = log.where("op = 'patch'").select("id", "n", "order", "entry")
    late = patches.join(few(fixed.select("id", "since")), "id", "left").where("since IS NULL OR n > since")
    fields = late.select("id", "order", F.explode("entry").alias("field", "value")).groupBy("id", "field").agg(F.max_by("value", "order").alias("value"))
    changes = fields.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("changes"))
    out = fixed.where("base IS NOT NULL").join(changes, "id", "left").withColumn("changes", F.coalesce("changes", F.create_map().cast("map<string,string>")))
    kept = F.map_filter("base", lambda k, _: ~F.map_contains_key(F.col("changes"), k))
    return out.select("id", F.map_concat(kept, "changes").alias("entry"), "first")


def place_log(root: DataFrame, applied: DataFrame, size: int = SHARD_MAX) -> DataFrame:
    """root(id, shard, i), what apply_log() gives -> id, shard: ids that were there all the time stay where they are,
    removed ones leave their shard, and those that came in are then placed, by the order in which they came."""
    stayed = root.join(applied.where("first IS NULL").select("id"), "id", "left_semi")
    return upsert(stayed, applied.where("first IS NOT NULL").select("id", F.col("first").alias("n")), size)


def load_shards(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """(shard, raw) each, raw a JSON object with books -> shard, source (primary, backup, broken, missing), ids: the
    backup stands in for a shard that is no such object."""
    ids = lambda c: F.transform(F.from_json(c, "books array<struct<id:string>>", {"mode": "PERMISSIVE"})["books"], lambda b: b["id"])
    both = primary.select("shard", F.col("raw").alias("a")).join(backup.select("shard", F.col("raw").alias("b")), "shard", "full_outer").withColumn("x", ids("a")).withColumn("y", ids("b"))
    source = F.when(F.col("x").isNotNull(), "primary").when(F.col("y").isNotNull(), "backup").when(F.col("a").isNull() & F.col("b").isNull(), "missing").otherwise("broken")
    return both.select("shard", source.alias("source"), F.coalesce("x", "y", F.array().cast("array<string>")).alias("ids"))


def rebuild_root(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """(shard, id) each: the map from contents. A shard without rows of its own counts with its backup's; of several
    shards that hold an id the lowest counts."""
    only = backup.join(primary.select("shard").distinct(), "shard", "left_anti")
    return primary.select("shard", "id").union(only.select("shard", "id")).groupBy("id").agg(F.min("shard").cast("long").alias("shard"))


def scan(objects: DataFrame, live: DataFrame, metas: DataFrame, chapters: DataFrame, orphans: DataFrame) -> DataFrame:
    """objects(prefix, book_id, key, size) of the prefixes meta, text, raw and progress -> with class: system (kept),
    live, orphan_book (records of a book that is neither on the shelf nor in the trash, and its texts), residue (what no
    record names), chapter_orphan (a body that its book's table lacks), unverified (a body of a live book without a
    record); and known, whether a chapter_orphan is registered. One pass over all, so nothing is left for a next page."""
    flag = lambda df, name: df.select("book_id", F.lit(True).alias(name)).distinct()
    key = lambda df, name: df.select("book_id", "key", F.lit(True).alias(name)).distinct()
    records = objects.where("prefix = 'meta'").join(live.select("book_id").distinct(), "book_id", "left_anti")
    rows = objects.join(flag(live, "live"), "book_id", "left").join(flag(records, "orphan"), "book_id", "left").join(flag(metas, "meta"), "book_id", "left")
    rows = rows.join(key(chapters, "named"), ["book_id", "key"], "left").join(key(orphans, "listed"), ["book_id", "key"], "left")
    text = F.col("prefix") == "text"
    kind = (
        F.when(text & F.col("live") & F.col("meta").isNull(), "unverified").when(text & F.col("live") & F.col("named").isNull(), "chapter_orphan").when(F.col("live"), "live")
        .when(F.col("orphan"), "orphan_book").otherwise("residue"))
    return rows.select("prefix", "book_id", "key", "size", kind.alias("class"), ((kind == "chapter_orphan") & F.coalesce("listed", F.lit(False))).alias("known"))


def scan_summary(scanned: DataFrame) -> DataFrame:
    return scanned.groupBy("class").agg(F.count("*").alias("objects"), F.sum("size").cast("long").alias("bytes"))


def owner_titles(objects: DataFrame, shelf: DataFrame, trash: DataFrame) -> DataFrame:
    """objects(book_id, ...) with the title of the book, on the shelf or else in the trash; '' where it has none."""
    titles = shelf.select(F.col("id").alias("book_id"), "title", F.lit(0).alias("o")).union(trash.select("id", "title", F.lit(1)))
    first = titles.groupBy("book_id").agg(F.min_by("title", "o").alias("book_title"))
    return objects.join(first, "book_id", "left").withColumn("book_title", F.coalesce("book_title", F.lit("")))


def page_quota(room: Column, going_on: Column) -> list[Column]:
    """meta, side and text: how many pages of each listing fit into what is left of a request's budget; side counts twice."""
    zero = F.lit(0)
    least = lambda *c: F.least(*c)
    meta = least(F.lit(META_PAGES), F.greatest(zero, room))
    text = F.when(room > 0, 1).otherwise(0)
    side = F.when(going_on, 0).otherwise(F.greatest(zero, least(F.floor((room - meta - text) / 2).cast("int"), F.lit(META_PAGES))))
    text = text + F.greatest(zero, least(room - meta - 2 * side - text, TEXT_PAGES - text))
    over = F.greatest(zero, meta + 2 * side + text - room)
    text2 = F.greatest(zero, text - over)
    over = F.greatest(zero, meta + 2 * side + text2 - room)
    side2 = F.greatest(zero, side - F.ceil(over / 2).cast("int"))
    over = F.greatest(zero, meta + 2 * side2 + text2 - room)
    return [F.greatest(zero, meta - over).alias("meta"), side2.alias("side"), text2.alias("text")]


def run_batched(ids: list, page: int, send: Callable[[list], dict | None], failed: Callable[[Exception], bool] | None = None) -> dict:
    """Send ids page by page; what the answer defers is sent again, until a page brings nothing (once more if the answer
    asks for that), too many rounds have passed or failed() ends it. For a driver that works through a remote list."""
    queue, done, again = list(ids), 0, False
    for _ in range(2 * len(ids) + 8):
        if not queue:
            break
        batch, rest = queue[: max(1, page)], queue[max(1, page) :]
        try:
            answer = send(batch) or {}
        except Exception as e:
            if failed and failed(e):
                return {"ok": done, "fail": max(0, len(ids) - done), "aborted": True}
            answer = {}
        deferred = [x for x in answer.get("deferred", []) if x in batch]
        if len(deferred) >= len(batch):
            if not answer.get("retry") or again:
                break
            again = True
        else:
            done += int(answer.get("updated") or 0)
        queue = deferred + rest
    return {"ok": done, "fail": max(0, len(ids) - done)}


def upload_batches(chapters: DataFrame, most: int = BATCH_CHAPTERS, bytes_: int = BATCH_BYTES) -> DataFrame:
    """chapters(book_id, pos, size) -> book_id, pos, batch: runs of consecutive chapters, as many as fit by number (a
    third of the book, two at least) and bytes. A greedy fold over each book's rows in order, which stream by."""
    ship(chapters.sparkSession)
    n = chapters.groupBy("book_id").agg(F.count("*").alias("n"))
    rows = chapters.join(n, "book_id").select("book_id", "pos", "size", F.least(F.lit(most), F.greatest(F.lit(2), F.ceil(F.col("n") / AT_ONCE))).cast("long").alias("most"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, batch, count, total = None, 0, 0, 0
        for b in it:
            out = []
            for k, pos, size, limit in b.itertuples(index=False):
                if k != book:
                    book, batch, count, total = k, 0, 0, 0
                elif count >= limit or total + size > bytes_:
                    batch, count, total = batch + 1, 0, 0
                count, total = count + 1, total + size
                out.append((k, pos, batch))
            yield pd.DataFrame(out, columns=["book_id", "pos", "batch"])

    return rows.repartition("book_id").sortWithinPartitions("book_id", "pos").mapInPandas(run, "book_id long, pos long, batch long")
