"""The index's layout, log and reconciliation, and updates of books, against step-by-step versions and literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import books as BK
from quire.operators import integrity as IN
from quire.operators import layout as LY
from quire.operators import updates as UP
from quire.plans import catalogue, structure  # noqa: F401  registers its queries


def test_all_of_3000_shards_are_opened(spark):
    root = spark.range(6000).select("id", (F.col("id") % 3000).alias("shard"))
    assert LY.open_index(root, root, root.where("id < 3000")).count() == 6000 and LY.open_index(root, root).count() == 6000


def test_only_the_shards_asked_for_are_read(spark, tmp_path):
    books = spark.range(400).select("id", (F.col("id") % 40).cast("int").alias("shard"), F.col("id").cast("string").alias("title"))
    LY.write_index(books, str(tmp_path / "ix"))
    table = spark.read.parquet(str(tmp_path / "ix"))
    got = LY.open_index(table, books.select("id", "shard"), books.where("id IN (3, 47, 399)"))
    assert sorted(r.id for r in got.collect()) == sorted(i for i in range(400) if i % 40 in (3, 7, 39))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(shard" in plan
    stray = books.select("id", F.when(F.col("id") == 3, -1).otherwise(F.col("shard")).alias("shard"))
    assert LY.open_index(table, stray, books.where("id = 3")).count() == 0


def test_reconciliation_keeps_what_it_cannot_know(spark):
    content = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 1)], "id long, shard long")
    root = spark.createDataFrame([(1, 0), (2, 1), (4, 0), (5, 2), (6, 3), (7, 9), (8, -1), (9, None)], "id long, shard long")
    health = spark.createDataFrame([(0, "primary"), (1, "backup"), (2, "broken"), (3, "missing")], "shard long, source string")
    of = lambda df: {r.id: (r.shard, r.change) for r in df.collect()}
    base = {1: (0, "kept"), 2: (0, "moved"), 3: (1, "added")}
    assert of(IN.reconcile(content, root, health)) == base | {4: (None, "dead"), 5: (2, "unknown"), 6: (3, "unknown"), 7: (None, "dead"), 8: (None, "dead"), 9: (None, "dead")}
    assert of(IN.reconcile(content, root, health, all_known=False)) == base | {i: (s, "unknown") for i, s in ((4, 0), (5, 2), (6, 3), (7, 9), (8, -1), (9, None))}
    bad = spark.createDataFrame([(0, "broken")], "shard long, source string")
    assert {c for _, c in of(IN.reconcile(content.limit(0), root, bad)).values()} == {"unknown"}
    assert of(IN.reconcile(content, root))[5] == (None, "dead")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_a_log_is_applied_as_step_by_step(spark, seed):
    rng = random.Random(seed)
    held = {i: {"t": f"t{i}", "u": "old"} for i in range(0, 30, 2)}
    log, entries, came = [], {k: dict(v) for k, v in held.items()}, {}
    for n in range(400):
        i, op = rng.randrange(30), rng.choice(("upsert", "patch", "patch", "remove"))
        entry = {"t": f"n{n}", "u": f"v{n}"} if op == "upsert" else {rng.choice("tuw"): f"p{n}"} if op == "patch" else None
        log.append((n, i, op, entry))
        if op == "upsert":
            if i not in entries:
                came[i] = n
            entries[i] = dict(entry)
        elif op == "patch" and i in entries:
            entries[i] |= entry
        elif op == "remove":
            entries.pop(i, None)
            came.pop(i, None)
    removed = {i for n, i, op, _ in log if op == "remove"}
    rng.shuffle(log)
    had = spark.createDataFrame(list(held.items()), "id long, entry map<string,string>")
    got = LY.apply_log(had, spark.createDataFrame(log, "n long, id long, op string, entry map<string,string>"))
    assert {r.id: r.entry for r in got.collect()} == entries
    assert {r.id: r.first for r in got.collect()} == {i: came.get(i) if i not in held or i in removed else None for i in entries}
    size = 6
    shards = [sorted(held)[k : k + size] for k in range(0, len(held), size)]
    root = [(x, s, k) for s, row in enumerate(shards) for k, x in enumerate(row)]
    stay = [[x for x in row if x in entries and x not in removed] for row in shards]
    while len(stay) > 1 and not stay[-1]:  # a last shard of which nothing is left is no longer known
        stay.pop()
    for x in sorted((i for i in entries if i not in held or i in removed), key=came.get):
        stay[-1].append(x)
        if len(stay[-1]) > size:
            half = -(-len(stay[-1]) // 2)
            stay.append(stay[-1][half:])
            del stay[-2][half:]
    placed = LY.place_log(spark.createDataFrame(root, "id long, shard long, i long"), got, size)
    assert {r.id: r.shard for r in placed.collect()} == {x: s for s, row in enumerate(stay) for x in row}
    assert LY.apply_log(had.limit(0), spark.createDataFrame([], "n long, id long, op string, entry map<string,string>")).count() == 0


def test_of_operations_of_one_n_the_lowest_i_counts(spark):
    log = [(5, 1, "upsert", {"t": "a"}, 7), (5, 1, "remove", None, 8), (5, 2, "remove", None, 3), (5, 2, "upsert", {"t": "b"}, 4), (1, 3, "upsert", {"t": "c"}, 9),
           (6, 3, "patch", {"t": "q"}, 2), (6, 3, "patch", {"t": "p", "u": "r"}, 1), (6, 3, "patch", {"u": "s"}, 5), (1, 3, "upsert", {"t": "d"}, 6), (1, 3, "patch", {"w": "x"}, 0)]
    had = spark.createDataFrame([(2, {"t": "old"})], "id long, entry map<string,string>")
    for rows in (log, log[::-1]):
        got = LY.apply_log(had, spark.createDataFrame(rows, "n long, id long, op string, entry map<string,string>, i long").coalesce(1))
        assert {r.id: (r.entry, r.first) for r in got.collect()} == {1: ({"t": "a"}, None), 3: ({"t": "p", "u": "r"}, 1)}


@pytest.mark.parametrize("name", ["index_log", "index_log_places"])
@pytest.mark.parametrize("backwards", [False, True])
def test_log_of_more_than_a_million_orders(spark, tmp_path, duck, rows_of, name, backwards):
    """Orders 1,000,003 apart have one n. Some orders are of no customer. However Spark gets the rows, the result is the SQL's over rows in order."""
    orders = sorted((j + 1_000_003 * m, j % 97) for j in range(500) for m in range(6))
    for folder, rows in (("sql", orders), ("spark", orders[::-1] if backwards else orders)):
        spark.createDataFrame(rows, "o_orderkey long, o_custkey long").coalesce(1).write.parquet(str(tmp_path / folder / "orders.parquet"))
        spark.range(90).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(str(tmp_path / folder / "customer.parquet"))
    assert rows_of(catalogue.QUERIES[name](spark, str(tmp_path / "spark"))) == duck(catalogue.ORACLES[name], str(tmp_path / "sql"))


def _tables(spark):
    books = spark.createDataFrame([(1, "One", "A", None, ["t"], 100, 0, False, None, None), (2, "Two", "B", "n", [], 50, None, True, "b", "s"), (3, "Three", None, None, None, None, 4, None, None, None)],
                                  "id long, title string, author string, note string, tags array<string>, word_count long, clean_ver long, pinned boolean, pending_batch string, pending_sig string")
    chapters = spark.createDataFrame([(1, 0, "1", "a", 40), (1, 1, "3", "b", None), (1, 2, "n_x", "c", 20), (2, 0, "1", "only", 50)], "book_id long, pos long, key string, title string, words long")
    orphans = spark.createDataFrame([(1, "2", 0), (1, "3", 1), (1, "9", 2), (2, "40", 0)], "book_id long, key string, i long")
    return books, chapters, orphans


ASKED = "id long, titles array<string>, new_title string, new_author string, new_note string, new_tags array<string>, new_words long, batch string, sig string"


def test_replacing_chapters(spark):
    books, chapters, orphans = _tables(spark)
    asked = spark.createDataFrame([(1, ["c", "<", "a"], "<>", "", None, ["x", " "], -5, "", ""), (2, [], None, None, None, None, None, "", ""), (3, ["z"], "T", None, "k", None, 7, "", ""), (4, ["q"], None, None, None, None, None, "", "")], ASKED)
    progress = spark.createDataFrame([(1, 3, 0.5), (3, 1, 0.2), (2, 1, 0.1)], "book_id long, ch long, ratio double")
    got = UP.replace(asked, books, chapters, orphans, progress, books.select("id"), 9)
    assert {r.id: r.verdict for r in got.verdicts.collect()} == {1: "replaced", 2: "no_chapters", 3: "replaced", 4: "not_on_shelf"}
    rows = {r.id: r for r in got.books.collect()}
    assert (rows[1].title, rows[1].author, rows[1].tags, rows[1].word_count, rows[1].clean_ver, rows[1].status) == ("One", "", ["x"], 0, 1, "creating")
    assert (rows[3].title, rows[3].note, rows[3].word_count, rows[3].clean_ver) == ("T", "k", 7, 5)
    assert sorted((r.book_id, r.pos, r.key, r.title) for r in got.chapters.collect()) == [(1, 0, "1", "c"), (1, 1, "2", "第2章"), (1, 2, "3", "a"), (3, 0, "1", "z")]
    # 2 and 3 are live again, 9 goes now, n_x is left behind
    assert sorted((r.book_id, r.key, r.swept) for r in got.orphans.collect()) == [(1, "9", True), (1, "n_x", False)]
    assert sorted((r.book_id, r.ch, r.ratio) for r in got.progress.collect()) == [(1, 1, 0.5), (3, 1, 0.2)]


def test_extending_books(spark):
    books, chapters, orphans = _tables(spark)
    asked = spark.createDataFrame([(1, ["d", ""], None, None, None, None, 5, "b", "s"), (2, ["x"], None, None, None, None, 5, "b", "s"), (3, ["x"], None, None, None, None, None, "", "")], ASKED)
    got = UP.extend(asked, books, chapters, orphans, books.select("id"), 9)
    assert {r.id: r.verdict for r in got.verdicts.collect()} == {1: "appended", 2: "again", 3: "appended"}
    assert sorted((r.book_id, r.pos, r.key, r.title) for r in got.chapters.collect() if r.pos > 2 or r.book_id == 3) == [(1, 3, "10", "d"), (1, 4, "11", "第11章"), (3, 0, "1", "x")]
    rows = {r.id: r for r in got.books.collect()}
    assert (rows[1].word_count, rows[1].clean_ver, rows[1].pending_batch, rows[1].pending_sig) == (105, 1, "b", "s") and rows[3].word_count == 0
    other = UP.extend(asked.withColumn("sig", F.lit("t")), books, chapters, orphans, books.select("id"), 9)
    assert {r.id: r.verdict for r in other.verdicts.collect()}[2] == "mismatch"


def test_publication(spark):
    books, chapters, orphans = _tables(spark)
    bodies = spark.createDataFrame([(1, "1"), (1, "3"), (1, "n_x"), (2, "2")], "book_id long, key string")
    progress = spark.createDataFrame([(1, 2, None, 7)], "book_id long, ch long, ratio double, at long")
    shelf = spark.createDataFrame([(1, "One", True, 1, 0.5, 3)], "id long, title string, pinned boolean, prog_ch long, prog_ratio double, prog_at long")
    none = spark.createDataFrame([], "id long")
    got = UP.publication(books.select("id"), books, chapters, bodies, orphans, progress, none, shelf, 9)
    assert {r.id: r.verdict for r in got.verdicts.collect()} == {1: "ready", 2: "incomplete", 3: "no_chapters"}
    row = got.shelf.first()
    assert (row.id, row.chapter_count, row.pinned, row.prog_ch, row.prog_ratio, row.prog_at) == (1, 3, True, 2, 0.0, 7)
    assert sorted((r.key, r.swept) for r in got.orphans.collect()) == [("2", True), ("9", True)]
    kept = UP.publication(books.select("id"), books, chapters, bodies, orphans, progress.limit(0), none, shelf, 9).shelf.first()
    assert (kept.prog_ch, kept.prog_ratio, kept.prog_at) == (1, 0.5, 3)


def test_edits_with_the_books_row(spark):
    """A patch of nothing changes nothing, null and 0 are version 1, a blank place is the end."""
    books, chapters, _ = _tables(spark)
    bodies = spark.createDataFrame([(1, "3", "one two")], "book_id long, key string, text string")
    patches = [(1, "1", None, None), (1, "3", "  ", "abc d"), (1, "zz", "t", None), (2, "1", None, None)]
    verdicts, table, rows = BK.patch_chapters(spark.createDataFrame(patches, "book_id long, key string, new_title string, new_text string"), chapters, bodies, books)
    assert {(r.book_id, r.key): r.verdict for r in verdicts.collect()} == {(1, "1"): "nothing", (1, "3"): "patched", (1, "zz"): "no_chapter", (2, "1"): "nothing"}
    assert [tuple(r) for r in rows.collect()] == [(1, 98, 2)] and {(r.key, r.title, r.words) for r in table.collect()} == {("1", "a", 40), ("3", "第2章", 4), ("n_x", "c", 20)}
    progress = spark.createDataFrame([(1, 3), (2, 1)], "book_id long, ch long")
    asked = spark.createDataFrame([(1, "1", " <> ", "x y", "n_1"), (2, "", None, "t", "n_2"), (3, "1", "t", None, "n_3")], "book_id long, after string, title string, text string, new_key string")
    verdicts, table, moved, rows = BK.insert_chapters(asked, chapters, progress, books)
    assert {r.book_id: (r.verdict, r["at"]) for r in verdicts.collect()} == {1: ("inserted", 1), 2: ("inserted", 1), 3: ("no_chapter", None)}
    assert sorted((r.book_id, r.pos, r.key, r.title) for r in table.collect()) == [(1, 0, "1", "a"), (1, 1, "n_1", ""), (1, 2, "3", "b"), (1, 3, "n_x", "c"), (2, 0, "1", "only"), (2, 1, "n_2", "第2章")]
    assert sorted(map(tuple, rows.collect())) == [(1, 4, 102, 2), (2, 2, 51, 2)] and sorted(map(tuple, moved.collect())) == [(1, 4), (2, 1)]
    verdicts, table, moved, rows = BK.delete_chapters(spark.createDataFrame([(1, "3"), (2, "1")], "book_id long, key string"), chapters, bodies, progress, books)
    assert {r.book_id: (r.verdict, r.lost) for r in verdicts.collect()} == {1: ("deleted", 6), 2: ("last", 0)}
    assert [tuple(r) for r in rows.collect()] == [(1, 2, 94, 2)] and sorted((r.pos, r.key) for r in table.collect()) == [(0, "1"), (1, "n_x")] and [tuple(r) for r in moved.collect()] == [(1, 2)]
