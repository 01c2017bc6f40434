"""Reading progress and login failures: latest states, acceptance tests, mirrors, lockouts. Streams use the same folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamp_chapter
from .folds import folded

WINDOW_MS, LOCK_MS, MOST_MS, LIMIT = 15 * 60_000, 10 * 60_000, 60 * 60_000, 5


def latest(events: DataFrame) -> DataFrame:
    """events(book_id, at, seq, ch, ratio): the last arrival of each book. Partial maxima, no window."""
    return events.groupBy("book_id").agg(F.max_by(F.struct("ch", "ratio", "at"), F.struct("at", "seq")).alias("x")).select("book_id", "x.*")


def accepted(events: DataFrame) -> DataFrame:
    """By the staleness test, in order of arrival (seq): an event stays unless an accepted one before it has a later client
    time. What is accepted always has the largest time so far, so the test is one against a running maximum, over ranges
    of arrivals: a book of very many events is many tasks' work."""

    def step(state: tuple, at: int) -> tuple[tuple, tuple]:
        top = state[0]
        return (at if top is None else max(top, at),), (top is None or top <= at,)

    return folded(events, "book_id", ["seq"], ["at"], step, (None,), "ok boolean", events.columns)


def mirror_changes(events: DataFrame, chapters: DataFrame, done_ratio: float = 0.9) -> DataFrame:
    """Events that change what the shelf shows: the chapter (clamped to the book's count), or whether the book is read.
    The mirror equals the event before in both respects; that is a fold whose states meet with the next event, over
    ranges of time."""
    rows = events.join(chapters.select("book_id", F.col("n").alias("cap")), "book_id")
    ch = F.when((F.col("cap") > 0) & (F.col("ch") > F.col("cap")), F.col("cap")).otherwise(F.col("ch"))
    rows = rows.withColumn("mch", ch).withColumn("done", (F.col("cap") > 0) & (F.col("mch") >= F.col("cap")) & (F.col("ratio") >= done_ratio))

    def step(state: tuple, mch: int | None, done: bool | None) -> tuple[tuple, tuple]:
        known, was, was_done = state
        differs = lambda a, b: a is not None and b is not None and a != b
        now = None if done is None else int(done)
        return (1, mch, now), (not known or differs(was, mch) or differs(was_done, now),)

    told = folded(rows, "book_id", ["at", "seq"], ["mch", "done"], step, (0, None, None), "changed boolean", ["book_id", "at", "seq", "mch", "done"])
    return told.where("changed").select("book_id", "at", "seq", F.col("mch").alias("ch"), "done")


def resume_position(local: DataFrame, server: DataFrame, chapters: DataFrame) -> DataFrame:
    """local and server(book_id, ch, ratio, at), chapters(book_id, n) -> book_id, cur, ratio: where a book opens. The
    device's place counts unless the server's is strictly newer; a place without a time or a chapter counts as none, and
    without any the book opens at its start. ch counts from 1 (0 and null as 1), cur from 0, within the book."""
    side = lambda df, p: df.select("book_id", *[F.col(c).alias(p + c) for c in ("ch", "ratio", "at")])
    rows = side(local, "l_").join(side(server, "s_"), "book_id", "full_outer").join(chapters.select("book_id", "n"), "book_id")
    usable = lambda p: (F.coalesce(p + "at", F.lit(0)) != 0) & F.col(p + "ch").isNotNull()
    theirs = usable("s_") & (F.col("s_at") > F.coalesce("l_at", F.lit(0)))
    pick = lambda c, none: F.when(theirs, F.col("s_" + c)).when(usable("l_"), F.col("l_" + c)).otherwise(none)
    ch = pick("ch", 1)
    place = clamp_chapter(F.when(ch == 0, 1).otherwise(ch) - 1, F.col("n"))
    return rows.select("book_id", place.alias("cur"), F.coalesce(pick("ratio", 0.0), F.lit(0.0)).alias("ratio"))


class Limiter:
    """State of one address: failures, lock and strikes. attempt() gives (locked, until)."""

    def __init__(self, limit: int = LIMIT, lock: int = LOCK_MS, most: int = MOST_MS, window: int = WINDOW_MS, state: tuple[int, int, int, int] = (0, 0, 0, 0)):
        self.limit, self.lock, self.most, self.window = limit, lock, most, window
        self.fail, self.until, self.strikes, self.at = state

    def attempt(self, now: int, failed: bool) -> tuple[bool, int]:
        if self.until > now:
            return True, self.until  # neither counted nor written
        if not failed:
            self.fail, self.until, self.strikes, self.at = 0, 0, 0, 0
            return False, 0
        if self.until:
            self.fail, self.until = 0, 0
        if now - self.at > self.window:
            self.fail = 0
        self.fail, self.at = self.fail + 1, now
        if self.fail >= self.limit:
            self.strikes += 1
            self.until, self.fail = now + min(self.lock * 2 ** (self.strikes - 1), self.most), 0
        return False, self.until

    def state(self) -> tuple[int, int, int, int]:
        return self.fail, self.until, self.strikes, self.at


def limiter(attempts: DataFrame, limit: int = LIMIT, lock: int = LOCK_MS, most: int = MOST_MS, window: int = WINDOW_MS) -> DataFrame:
    """attempts(user_id, at, seq, failed) -> user_id, seq, locked, until. An ordered fold for each user, in ranges of
    time: a user with very many attempts is many tasks' work. Strikes beyond the one with the longest lock change
    nothing and aren't counted."""
    enough = next((s for s in range(1, 64) if lock * 2 ** (s - 1) >= most), 64)

    def step(state: tuple, at: int, failed: bool) -> tuple[tuple, tuple]:
        held = Limiter(limit, lock, most, window, state)
        put = held.attempt(at, bool(failed))
        fail, until, strikes, last = held.state()
        return (fail, until, min(strikes, enough), last), put

    return folded(attempts, "user_id", ["at", "seq"], ["at", "failed"], step, (0, 0, 0, 0), "locked boolean, until long", ["user_id", "seq"])


def offline_queue(events: DataFrame) -> DataFrame:
    """events(device, book_id, at, seq, ch, ratio) -> the newest of each book of a device, with times that differ: one
    that isn't later than the one before is put a millisecond after it. A fold over ranges of time."""
    last = events.groupBy("device", "book_id").agg(F.max_by(F.struct("ch", "ratio", "at"), F.struct("at", "seq")).alias("x")).select("device", "book_id", "x.*")

    def step(state: tuple, at: int) -> tuple[tuple, tuple]:
        put = at if state[0] is None else max(at, state[0] + 1)
        return (put,), (put,)

    keep = [c for c in last.columns if c != "at"]
    return folded(last, "device", ["at", "book_id"], ["at"], step, (None,), "sent long", keep).select(*[F.col("sent").alias("at") if c == "at" else F.col(c) for c in last.columns])


def write_verdict(held: int | None, client_at: int | None, base_at: int | None, client_ver: int | None, clean_ver: int | None) -> str:
    """Of one write against the time held: written, stale, occ or cleanVer. clean_ver null: the book has no record."""
    if client_at and held is not None and held > client_at:
        return "stale"
    if base_at is not None and (held or 0) > base_at:
        return "occ"
    if client_ver and clean_ver is not None and clean_ver != client_ver:
        return "cleanVer"
    return "written"


def progress_writes(events: DataFrame, books: DataFrame) -> DataFrame:
    """events(book_id, seq, now, client_at, base_at, client_ver) in order of arrival, books(book_id, clean_ver) -> book_id,
    seq, verdict. client_at 0, base_at null and client_ver 0 ask for no test; a book without a record has no version to
    differ from, one whose version is null or 0 has version 1. The fold runs over ranges of arrivals: a book of very many
    writes is many tasks' work."""
    kept = books.select("book_id", F.coalesce(F.when(F.col("clean_ver") != 0, F.col("clean_ver")), F.lit(1)).cast("long").alias("clean_ver"))
    rows = events.join(kept, "book_id", "left")

    def step(state: tuple, now: int, *asked: int | None) -> tuple[tuple, tuple]:
        verdict = write_verdict(state[0], *asked)
        return ((now,) if verdict == "written" else state), (verdict,)

    return folded(rows, "book_id", ["seq"], ["now", "client_at", "base_at", "client_ver", "clean_ver"], step, (None,), "verdict string", ["book_id", "seq"])


def active_records(records: DataFrame, now: int, window: int = WINDOW_MS, most: int = 5000) -> DataFrame:
    """records(ip, until, at): those that are locked or were active within the window; of the others of these no more
    than ``most``, the latest."""
    live = records.where((F.coalesce("until", F.lit(0)) > now) | (F.coalesce("at", F.lit(0)) > now - window))
    locked = F.coalesce("until", F.lit(0)) > now
    return live.where(locked).unionByName(live.where(~locked).orderBy(F.desc(F.coalesce("at", F.lit(0))), "ip").limit(most))


def client_move(cur: Column, ratio: Column, base_at: Column, ch: Column, server_ratio: Column, server_at: Column, chapters: Column) -> Column:
    """What an open book does with the server's place: ignore (none, or not newer than what it knows; base_at null means
    it knows nothing), stay (as good as the same place) or move. cur counts from 0, ch from 1."""
    place = clamp_chapter(F.coalesce(F.when(ch != 0, ch), F.lit(1)) - 1, chapters)
    near = (place == cur) & (ratio.isNull() | (F.abs(ratio - F.coalesce(server_ratio, F.lit(0.0))) <= 0.02))
    return F.when(server_at.isNull() | (F.coalesce(base_at, F.lit(-1)) >= server_at) | (server_at == 0), "ignore").when(near, "stay").otherwise("move")


def coalesced(events: DataFrame, every: int = 8000) -> DataFrame:
    """events(book_id, at, seq, ch, ratio): the last of each book in each interval, which is what is sent."""
    slot = F.floor(F.col("at") / every)
    return events.groupBy("book_id", slot.alias("slot")).agg(F.max_by(F.struct("at", "seq", "ch", "ratio"), F.struct("at", "seq")).alias("x")).select("book_id", "slot", "x.*")


def throttle_step(every: int):
    """The fold of throttled(): state (end of the window, whether it holds a place); for a place whether it is sent at
    once, and else the time at which its window ends."""

    def step(state: tuple, at: int) -> tuple[tuple, tuple]:
        until, held = state
        if until is not None and held and until <= at < until + every:
            until += every  # the held place was sent, which opened the next window
        elif until is None or at >= until:
            return (at + every, 0), (True, at)
        return (until, 1), (False, until)

    return step


def throttled(events: DataFrame, every: int = 8000) -> DataFrame:
    """events(book_id, at, seq, ch, ratio) -> book_id, sent, ch, ratio: what is sent of each book's places. A place is sent
    at once and opens a window; of those within the window the last is sent at its end, which opens the next one. A fold
    over ranges of time finds the windows, maxima their last places."""
    rows = folded(events, "book_id", ["at", "seq"], ["at"], throttle_step(every), (None, 0), "now boolean, sent long", ["book_id", "at", "seq", "ch", "ratio"])
    held = rows.where("NOT now").groupBy("book_id", "sent").agg(F.max_by(F.struct("ch", "ratio"), F.struct("at", "seq")).alias("x"))
    return rows.where("now").select("book_id", "sent", "ch", "ratio").unionByName(held.select("book_id", "sent", "x.*"))
