"""Folds over ranges: equal to plain ones, however a key's rows lie in the ranges."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import progress as PR
from quire.operators.folds import folded


@pytest.fixture
def many_ranges(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", old)


def plain_writes(rows, vers):
    held, out = {}, []
    for book, seq, now, ca, ba, cv in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        v = PR.write_verdict(held.get(book), ca, ba, cv, (vers[book] or 1) if book in vers else None)
        if v == "written":
            held[book] = now
        out.append((book, seq, v))
    return sorted(map(repr, out))


@pytest.mark.parametrize("hot", [0.0, 0.6, 1.0])
def test_writes_of_a_hot_book(many_ranges, hot):
    """A third or all of the writes are of one book; two devices, one of them offline at times, versions null or 0."""
    rng, rows = random.Random(3), []
    for i in range(2500):
        book = 1 if rng.random() < hot else rng.choice((1, 2, 3, 5, 8, None))
        rows.append((book, i, 1000 + i * 10, rng.choice((0, 0, 900 + i * 10, 1000 + i * 9)), rng.choice((None, None, 0, 980 + i * 10)), rng.choice((0, 0, 0, 1, 2))))
    vers = {1: None, 2: 0, 3: 2, 5: 1}
    rng.shuffle(rows)
    events = many_ranges.createDataFrame(rows, "book_id long, seq long, now long, client_at long, base_at long, client_ver long").repartition(7)
    got = PR.progress_writes(events, many_ranges.createDataFrame(list(vers.items()), "book_id long, clean_ver long"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain_writes(rows, vers)


@pytest.mark.parametrize("fails", [0.5, 0.9, 1.0])
def test_attempts_of_one_user(many_ranges, fails):
    rng = random.Random(5)
    rows, at = [], 0
    for i in range(2000):
        at += rng.choice((1, 5, 400, 9000))
        rows.append((7, at, i, rng.random() < fails))
    state, want = PR.Limiter(3, 100, 5000, 3000), []
    for _, t, i, failed in rows:
        want.append((7, i, *state.attempt(t, failed)))
    df = many_ranges.createDataFrame(rows, "user_id long, at long, seq long, failed boolean").repartition(5)
    assert sorted(map(tuple, PR.limiter(df, 3, 100, 5000, 3000).collect())) == want


def test_states_that_never_meet(many_ranges):
    """A running sum: every range depends on all before it, so each round settles one; and tasks see a share of the rows each."""
    df = many_ranges.range(600).select(F.lit("k").alias("k"), F.col("id"), (F.col("id") % 7).alias("v")).repartition(3)
    out = folded(df, "k", ["id"], ["v"], lambda s, v: ((s[0] + v,), (s[0] + v,)), (0,), "total long", ["id"])
    assert [r.total for r in out.orderBy("id").collect()] == [sum(j % 7 for j in range(i + 1)) for i in range(600)]
    sizes = [n for n in out.select(F.spark_partition_id().alias("p")).groupBy("p").count().select("count").toPandas()["count"]]
    assert max(sizes) < 600 and sum(sizes) == 600


def test_no_rows(many_ranges):
    df = many_ranges.createDataFrame([], "user_id long, at long, seq long, failed boolean")
    assert PR.limiter(df).count() == 0


def test_where_a_book_opens(spark):
    """Ties go to the device; no time or no chapter is no place; chapters beyond the book are its last."""
    local = [(1, 3, 0.1, 10), (2, 3, 0.1, 10), (3, 0, 0.2, 10), (4, 5, 0.3, 0), (5, 99, 0.4, 10), (6, None, 0.5, 10), (8, 4, None, 9)]
    server = [(1, 7, 0.9, 10), (2, 7, 0.9, 11), (4, 2, 0.8, 1), (6, 3, 0.7, 10), (7, 6, 0.6, 5), (8, 2, 0.6, 0), (9, 2, 0.1, 1)]
    schema = "book_id long, ch long, ratio double, at long"
    books = spark.createDataFrame([(i, 8) for i in range(1, 9)], "book_id long, n long")
    got = {r.book_id: (r.cur, r.ratio) for r in PR.resume_position(spark.createDataFrame(local, schema), spark.createDataFrame(server, schema), books).collect()}
    assert got == {1: (2, 0.1), 2: (6, 0.9), 3: (0, 0.2), 4: (1, 0.8), 5: (7, 0.4), 6: (0, 0.0), 7: (5, 0.6), 8: (3, 0.0)}
