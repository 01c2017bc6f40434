"""Planners, index splits, progress tests and streams against step-by-step versions."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import books as BK
from quire.operators import layout as LY
from quire.operators import progress as PR
from quire.operators import shelf as SH
from quire.sources import objects as OB
from quire.sources.encoding import CANDIDATES, candidates, score
from quire.streaming import progress as ST
from test_streaming import streamed


@pytest.mark.parametrize("size, old, new", [(500, 3, 0), (20, 20, 1), (20, 15, 90), (5, 0, 40), (4, 4, 33), (20, 47, 3)])
def test_upsert_splits_like_one_by_one(spark, size, old, new):
    shards = [list(range(i, min(i + size, old))) for i in range(0, old, size)] or [[]]
    root = [(x, i, k) for i, s in enumerate(shards) for k, x in enumerate(s)]
    more = [*range(0, min(old, 3)), *range(1000, 1000 + new)]
    for x in more:
        if any(x in s for s in shards):
            continue
        shards[-1].append(x)
        if len(shards[-1]) > size:
            half = -(-len(shards[-1]) // 2)
            shards.append(shards[-1][half:])
            del shards[-2][half:]
    got = LY.upsert(spark.createDataFrame(root, "id long, shard long, i long"), spark.createDataFrame([(x, n) for n, x in enumerate(more)], "id long, n long"), size).collect()
    assert sorted((r.id, r.shard) for r in got) == sorted((x, i) for i, s in enumerate(shards) for x in s)


def test_page_quota_is_the_loops(spark):
    def loops(room, going_on):
        side_most = 0 if going_on else 3
        meta, text, side = min(3, max(0, room)), min(12, 1 if room > 0 else 0), 0
        spare = lambda: room - meta - 2 * side - text
        if side_most:
            side += max(0, min(spare() // 2, side_most - side))
        text += max(0, min(spare(), 12 - text))
        while text > 0 and spare() < 0:
            text -= 1
        while side > 0 and spare() < 0:
            side -= 1
        while meta > 0 and spare() < 0:
            meta -= 1
        return meta, side, text

    df = spark.range(-3, 60).select(F.col("id").cast("int").alias("room"), F.explode(F.array(F.lit(True), F.lit(False))).alias("on"))
    for r in df.select("room", "on", *LY.page_quota(F.col("room"), F.col("on"))).collect():
        assert (r.meta, r.side, r.text) == loops(r.room, r.on), r


def test_batches_go_on_until_nothing_comes():
    sent = []
    assert LY.run_batched(list(range(10)), 4, lambda b: sent.append(b) or {"updated": len(b[:3]), "deferred": b[3:]}) == {"ok": 10, "fail": 0}
    assert sum(map(len, sent)) > 10
    assert LY.run_batched([1, 2, 3], 2, lambda b: {"deferred": b}) == {"ok": 0, "fail": 3}
    rounds = []
    assert LY.run_batched([1, 2], 2, lambda b: rounds.append(1) or {"deferred": b, "retry": True}) == {"ok": 0, "fail": 2} and len(rounds) == 2

    def fails(b):
        raise OSError

    assert LY.run_batched([1, 2, 3], 1, fails, lambda e: True) == {"ok": 0, "fail": 3, "aborted": True}
    assert LY.run_batched([1, 2, 3], 1, fails) == {"ok": 0, "fail": 3} and LY.run_batched([], 5, fails) == {"ok": 0, "fail": 0}


def test_mirror_stream_is_the_batch(spark, tmp_path):
    schema = "book_id long, at long, seq long, ch long, ratio double"
    rng = random.Random(4)
    rows = [(i % 3, i, i, rng.randint(0, 5), rng.choice([0.1, 0.95])) for i in range(90)]
    chapters = spark.createDataFrame([(0, 4), (1, 0), (2, 3)], "book_id long, n long")
    want = sorted(tuple(r) for r in PR.mirror_changes(spark.createDataFrame(rows, schema), chapters).collect())
    assert streamed(spark, rows, schema, lambda s: ST.mirror_stream(s, chapters), "append", tmp_path, "mirror_stream") == want


def test_records_that_stay(spark):
    rows = [(1, None, 100), (2, 2000, 0), (3, 900, 100), (4, None, 950), (5, None, 960), (6, 500, 940), (7, None, None)]
    r = spark.createDataFrame(rows, "ip long, until long, at long")
    assert sorted(x.ip for x in PR.active_records(r, 1000, 100, 2).collect()) == [2, 4, 5]


def test_conditional_writes(spark):
    objects = spark.createDataFrame([("a", "e1"), ("b", "e2")], "key string, etag string")
    writes = [("a", 1, "e0", False), ("a", 2, "e1", False), ("a", 3, "e1", False), ("b", 4, None, False), ("b", 5, "x", True), ("b", 6, "x", True), ("c", 7, None, False), ("c", 8, "e1", False)]
    got = OB.put_if(objects, spark.createDataFrame(writes, "key string, seq long, expect string, force boolean")).where("ok").collect()
    assert sorted(r.seq for r in got) == [2, 6, 7]


def test_pages_of_keys(spark):
    keys = spark.createDataFrame([(f"t/{i:03d}",) for i in range(25)] + [("u/1",)], "key string")
    seen, cursor = [], ""
    while True:
        page = OB.listed(keys, "t/", cursor, 10).collect()
        seen += [r.key for r in page]
        cursor = page[0].cursor
        if not page[0].truncated:
            break
    assert seen == [f"t/{i:03d}" for i in range(25)] and cursor is None
    assert [tuple(r) for r in OB.listed(keys, "none/").collect()] == [(None, False, None)]


def test_encodings_that_are_offered():
    raw = "他们在这里生活，春天来了".encode("gb18030")
    found = candidates(raw)
    assert found[0][0] == "gb18030" and {n for n, _ in found} <= set(CANDIDATES) and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    assert candidates(b"plain") == [(n, 0.0) for n in CANDIDATES] and all(s > -100 for _, s in candidates(bytes(range(128, 256)) * 20)) and score("", frozenset()) == 0.0


def test_views_and_pages(spark):
    books = spark.createDataFrame([(i, i, False) for i in range(25)], "id long, updated_at long, pinned boolean")
    assert SH.pages(books, "updated", 99, 10, "id").count() == 25 and SH.pages(books, "updated", 2, 10, "id").count() == 20 == SH.pages(books.where("id < 20"), "updated", 5, 10, "id").count()
    cloud = spark.createDataFrame([([f"t{i}" for i in range(k)],) for k in range(1, 11)], "tags array<string>")
    assert [r.tag for r in SH.tag_cloud(cloud, "t8").orderBy("place").collect()] == ["t8", "t0", "t1", "t2", "t3", "t4", "t5"]
    assert [r.tag for r in SH.tag_cloud(cloud, "t2", 3).orderBy("place").collect()] == ["t0", "t1", "t2"]


def test_null_and_empty_tables(spark):
    none = spark.createDataFrame([], "id long, shard long, i long")
    assert LY.probe_root(none).first()[:] == (0, 0, False) and LY.upsert(none, spark.createDataFrame([(1, 1)], "id long, n long")).count() == 1
    b = spark.createDataFrame([(1, None, None, None, None, None, None, None, None)], "id long, title string, author string, note string, tags array<string>, word_count long, clean_ver long, pinned boolean, titles array<string>")
    assert BK.create(b, spark.createDataFrame([], "title string"), 1).first().verdict == "no_title"
