"""Streaming forms: last progress of each book, and the login limiter with a state for each address."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.progress import LIMIT, LOCK_MS, MOST_MS, WINDOW_MS, Limiter
from ..session import ship


def latest_progress(stream: DataFrame) -> DataFrame:
    """stream(book_id, at, seq, ch, ratio): the last arrival of each book, for update or complete mode."""
    return stream.groupBy("book_id").agg(F.max_by(F.struct("ch", "ratio", "at"), F.struct("at", "seq")).alias("x")).select("book_id", "x.*")


def limiter_stream(stream: DataFrame, limit: int = LIMIT, lock: int = LOCK_MS, most: int = MOST_MS, window: int = WINDOW_MS) -> DataFrame:
    """stream(user_id, at, seq, failed) -> user_id, seq, locked, until, in append mode: the batch limiter's fold, its
    state kept between batches. Attempts are ordered within a batch. A user's state goes with a success, and when the
    stream's time is past the window since the last failure and any lock; attempts later than the window are dropped. The
    stream's time begins at 0, which counts as late, so an attempt at 0 has the time 1."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get if state.exists else (0, 0, 0, 0)
        if max(known[3] + window, known[1]) < state.getCurrentWatermarkMs():  # over, but this batch came before its removal
            known = (0, 0, 0, 0)
        held = Limiter(limit, lock, most, window, known)
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        out = [(key[0], s, *held.attempt(a, f)) for a, s, f in rows[["at", "seq", "failed"]].itertuples(index=False)]
        if any(held.state()):
            state.update(held.state())
            state.setTimeoutTimestamp(int(max(held.at + window, held.until, state.getCurrentWatermarkMs())) + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "seq", "locked", "until"])

    ship(stream.sparkSession)
    timed = stream.withColumn("__time", F.timestamp_millis(F.col("at") + 1)).withWatermark("__time", f"{window} milliseconds")
    return timed.groupBy("user_id").applyInPandasWithState(
        run, "user_id long, seq long, locked boolean, until long", "fail long, until long, strikes long, at long", "append", GroupStateTimeout.EventTimeTimeout)


def mirror_stream(stream: DataFrame, chapters: DataFrame, done_ratio: float = 0.9) -> DataFrame:
    """stream(book_id, at, seq, ch, ratio), chapters(book_id, n) -> the events that change what the shelf shows, in append
    mode: as mirror_changes() in batch, with the place shown last kept as state."""
    rows = stream.join(chapters.select("book_id", "n"), "book_id")

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shown = state.get if state.exists else None
        out = []
        for _, at, seq, ch, ratio, n in pd.concat(list(frames)).sort_values(["at", "seq"])[["book_id", "at", "seq", "ch", "ratio", "n"]].itertuples(index=False):
            ch = n if n > 0 and ch > n else ch
            new = (int(ch), bool(n > 0 and ch >= n and ratio >= done_ratio))
            if shown != new:
                out.append((key[0], at, seq, *new))
                shown = new
        state.update(shown)
        yield pd.DataFrame(out, columns=["book_id", "at", "seq", "ch", "done"])

    ship(stream.sparkSession)
    return rows.groupBy("book_id").applyInPandasWithState(run, "book_id long, at long, seq long, ch long, done boolean", "ch long, done boolean", "append", GroupStateTimeout.NoTimeout)
