"""The streaming forms give what the batch forms give, over several micro-batches."""

from quire.operators import progress as PR
from quire.operators.edits import copy_titles
from quire.streaming import progress as ST


def streamed(spark, rows, schema, make, mode, folder, name):
    """All rows that make(stream) has put out after three micro-batches."""
    for i in range(3):
        part = rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return sorted(tuple(r) for r in spark.table(name).collect())


def test_latest_progress(spark, tmp_path):
    schema = "book_id long, at long, seq long, ch long, ratio double"
    rows = [(i % 4, 100 + i * 7 % 50, i, i, i / 100) for i in range(60)]
    want = sorted(tuple(r) for r in PR.latest(spark.createDataFrame(rows, schema)).collect())
    assert streamed(spark, rows, schema, ST.latest_progress, "complete", tmp_path, "latest_progress") == want


def test_limiter_keeps_its_state(spark, tmp_path):
    schema = "user_id long, at long, seq long, failed boolean"
    rows = [(i % 3, 40 * i, i, i % 7 != 0) for i in range(90)]
    options = {"limit": 3, "lock": 300, "most": 2000, "window": 5000}
    want = sorted(tuple(r) for r in PR.limiter(spark.createDataFrame(rows, schema), **options).collect())
    assert any(r[2] for r in want)
    assert streamed(spark, rows, schema, lambda s: ST.limiter_stream(s, **options), "append", tmp_path, "limiter_stream") == want


def test_limiter_forgets_idle_users(spark, tmp_path):
    """Locks double while a user is remembered; after a long pause the stream has forgotten the strikes, the batch fold hasn't."""
    schema = "user_id long, at long, seq long, failed boolean"
    hour = 3_600_000
    rows = [(1, 1, 0, True), (2, 2, 1, True), (1, 400, 2, True), (3, 10 * hour, 3, True), (3, 10 * hour + 1, 4, True), (2, 10 * hour + 2, 5, True), (1, 20 * hour, 6, True), (2, 20 * hour, 7, False), (3, 20 * hour + 1, 8, True)]
    options = {"limit": 1, "lock": 100, "most": 10**9, "window": 1000}
    got = {r[1]: r[2:] for r in streamed(spark, rows, schema, lambda s: ST.limiter_stream(s, **options), "append", tmp_path, "limiter_forgets")}
    batch = {r.seq: (r.locked, r.until) for r in PR.limiter(spark.createDataFrame(rows, schema), **options).collect()}
    assert batch[6] == (False, 20 * hour + 400) and got[6] == (False, 20 * hour + 100) and len(got) == len(rows)
    assert all(got[i] == batch[i] for i in (0, 1, 2, 3, 4, 7))


def test_copy_titles(spark):
    new = spark.createDataFrame([(1, "甲"), (2, "甲"), (3, "乙"), (4, "丙"), (5, "丙"), (6, "丙（副本）")], "id long, title string")
    taken = spark.createDataFrame([("甲 ",), ("甲（副本2）",)], "title string")
    got = {r.id: r.title for r in copy_titles(new, taken).collect()}
    assert got == {1: "甲（副本）", 2: "甲（副本3）", 3: "乙", 4: "丙", 5: "丙（副本2）", 6: "丙（副本）"}
    assert [r.title for r in copy_titles(new.where("id = 1"), taken, 0).collect()] == [None]
