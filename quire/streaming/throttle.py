"""Writes of progress in streams: one per window and book, with timers; and a queue that is drained once, whatever is replayed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.progress import throttle_step
from ..session import ship

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Throttle(StatefulProcessor):
    """Places wait until the stream's time has passed them, so that their order of arrival doesn't matter."""

    def __init__(self, every: int):
        self.every, self.step = every, throttle_step(every)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, seq long, ch long, ratio double")
        self.window = handle.getValueState("window", "until long, held long, ch long, ratio double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803  Spark's names
        for b in rows:
            for at, seq, ch, ratio in zip(*(b[c].tolist() for c in ("at", "seq", "ch", "ratio"))):
                self.waiting.appendValue((at, seq, ch, ratio))
        yield self._until(key, timerValues.getCurrentWatermarkInMs() or 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803  Spark's names
        yield self._until(key, timerValues.getCurrentWatermarkInMs() or 0)

    def _until(self, key, now: int) -> pd.DataFrame:
        """What is sent before ``now``; the next timer is set for what is left."""
        waiting = sorted(tuple(x) for x in self.waiting.get())
        until, held, ch, ratio = tuple(self.window.get()) if self.window.exists() else (None, 0, None, None)
        out = []
        ready = [x for x in waiting if x[0] < now]
        for at, _, c, r in ready:
            was, before = until, held
            (until, held), (at_once, _) = self.step((until, held), at)
            if before and at >= was:
                out.append((key[0], was, ch, ratio))
            if at_once:
                out.append((key[0], at, c, r))
            ch, ratio = c, r
        if held and until < now:  # no place that is left can come before its end
            out.append((key[0], until, ch, ratio))
            until, held = until + self.every, 0
        left = waiting[len(ready) :]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        due = [x[0] + 1 for x in left[:1]]
        if until is not None and (held or until >= now):
            self.window.update((until, held, ch, ratio))
            due.append(until + 1)
        else:  # whatever comes next is sent at once
            self.window.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if due:
            self.handle.registerTimer(max(min(due), now + 1))
        return pd.DataFrame(out, columns=["book_id", "sent", "ch", "ratio"]).astype({"book_id": "int64", "sent": "int64", "ch": "int64", "ratio": "float64"})


def throttled_stream(stream: DataFrame, every: int = 8000, late: str = "1 minute") -> DataFrame:
    """stream(book_id, at, seq, ch, ratio), at above 0 -> book_id, sent, ch, ratio in append mode: as throttled() gives for
    all of it, in whatever order the places come, as long as none is later than ``late``. A book whose last window is over
    has no state. Needs the RocksDB state store, which this sets."""
    spark = stream.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    timed = stream.select("book_id", "at", "seq", "ch", "ratio", F.timestamp_millis("at").alias("time")).withWatermark("time", late)
    return timed.groupBy("book_id").transformWithStateInPandas(_Throttle(every), "book_id long, sent long, ch long, ratio double", "Append", "EventTime")


def drain(stream: DataFrame, folder: str, send: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """stream(device, book_id, at, seq, ...) -> a query that sends the newest place of each book of a device and keeps what
    failed for the next batch. send(rows) gives the rows with ``ok``. A batch is one folder, written whole, which holds what
    was sent and what failed; a batch that is run again replaces its own folder and takes the same failures of the batch
    before, so each place is there once."""

    def batch(rows: DataFrame, n: int) -> None:
        spark = rows.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch={n - 1}/ok=false")
        if n and at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(str(at)))
        keep = [c for c in rows.columns if c not in ("device", "book_id")]
        newest = rows.groupBy("device", "book_id").agg(F.max_by(F.struct(*keep), F.struct("at", "seq")).alias("x")).select("device", "book_id", "x.*")
        send(newest).write.mode("overwrite").partitionBy("ok").parquet(f"{folder}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
