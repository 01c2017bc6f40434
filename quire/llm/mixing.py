"""Mixing sources to target weights: weights that change over the training run, and a place in it for every document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.order import running
from .common import BROADCAST_ROWS, finished, merged, small, spread, stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: Times that a document may be taken, rows of a bucket at most.
MOST, BUCKET_ROWS = 3, 1 << 20
#: Passes that fill what whole rounds of a source leave: over documents not taken beyond these, then over any that may be taken again.
PASSES, SPARE = 3, 2
#: Weights are whole numbers of this part.
PART = 1_000_000
#: Above any key.
END = "~~"


def ramp(rank: Column) -> Column:
    """The schedule of op11: by the number of the source, weights about 5, 2 and 1 on average over the run; the heavy
    sources fall by a fifth on either side of that, the others rise by a quarter and by a half."""
    knots = lambda a, b: F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, a), (1.0, b))])
    return F.when(rank % 3 == 1, knots(6.0, 4.0)).when(rank % 3 == 2, knots(1.5, 2.5)).otherwise(knots(0.5, 1.5))


def pieces(knots: Column) -> Column:
    """A schedule's straight pieces: time and weight where each begins, its slope, and the integral of the weight before it and to its end."""
    kind = "array<struct<t:double,w:double,slope:double,before:double,after:double>>"

    def add(held: Column, i: Column) -> Column:
        a, b = F.get(knots, i - 1), F.get(knots, i)
        before = F.coalesce(F.try_element_at(held, F.lit(-1))["after"], F.lit(0.0))
        piece = F.struct(a["t"].alias("t"), a["w"].alias("w"), ((b["w"] - a["w"]) / (b["t"] - a["t"])).alias("slope"), before.alias("before"), (before + (a["w"] + b["w"]) / 2 * (b["t"] - a["t"])).alias("after"))
        return F.concat(held, F.array(piece))

    return F.aggregate(F.sequence(F.lit(1), F.size(knots) - 1), F.array().cast(kind), add)


def when_reached(held: Column, area: Column) -> Column:
    """The time at which the integral of the weight reaches ``area``: within a piece the root of a quadratic."""
    at = F.element_at(F.filter(held, lambda p: p["before"] <= area), -1)
    left = area - at["before"]
    return at["t"] + F.coalesce(F.try_divide(2 * left, at["w"] + F.sqrt(F.greatest(F.lit(0.0), at["w"] * at["w"] + 2 * at["slope"] * left))), F.lit(0.0))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the words of the whole text, 0 of a null one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources(weight, source_size, ...) with target: all sources' words dealt out by weight, at most ``most`` times a
    source's own; what goes beyond that is dealt to the others by weight again, until nothing does. A round is one
    aggregation, and its two sums are all that the driver sees."""
    held = F.col("source_size") * most
    wide = lambda c: c.cast("decimal(38,0)")
    total, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    rest = total
    while True:
        over = wide(F.col("weight")) * wide(F.lit(rest)) > wide(held) * wide(F.lit(weights))
        full, left = sources.agg(F.coalesce(F.sum(F.when(over, held)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if (total - full, left) == (rest, weights):
            break
        rest, weights = total - full, left
    share = F.col("weight").cast("double") * float(rest) / float(weights or 1)
    return sources.withColumn("target", F.when(over, held.cast("double")).otherwise(share))


Join = Callable[..., DataFrame]


def joiner(sources: int) -> Join:
    """join(rows, few, on, how) for tables of at most a row for each source: broadcast if there are few sources, else by sorting."""
    if sources <= BROADCAST_ROWS:
        return lambda rows, few, on, how="inner": rows.join(F.broadcast(few), on, how)
    return lambda rows, few, on, how="inner": merged(rows).join(few, on, how)


def _times(n: int, most: int) -> Column:
    """How often the first ``n`` passes have taken a document, beyond the whole rounds of its source."""
    times = F.lit(0)
    for i in range(n):
        free = times < (F.lit(1) if i < PASSES else most - F.col("rounds"))
        times = times + (free & (F.col("size") > 0) & (F.col("size") <= F.col(f"most{i}")) & (F.col("key") < F.col(f"stop{i}"))).cast("int")
    return times


def _passes(n: int) -> list[str]:
    return ["rank", "rounds", *[f"{x}{i}" for i in range(n) for x in ("most", "stop")]]


def fill(dealt: DataFrame, sources: DataFrame, join: Join, most: int = MOST) -> DataFrame:
    """sources(rank, rounds, room, ...) with what to take beyond the rounds, so that each source's words come near ``room``.

    A pass goes through a source's documents by key, those that are free and no larger than what is left of the room, and
    takes them up to the first that doesn't fit. So all that has to be known of a pass is its room and that document's
    key: mostI and stopI. Sums of buckets of keys, one row each, show in which bucket it is; rows are sorted in that
    bucket alone. At last the key that brings the words nearest to the target, if any does: last.
    """
    state = sources
    for i in range(PASSES + SPARE):
        rows = join(dealt, state.select("room", *_passes(i)), ["rank"])
        free = _times(i, most) < (F.lit(1) if i < PASSES else most - F.col("rounds"))
        left = rows.where((F.col("size") > 0) & (F.col("size") <= F.col("room")) & free).select("rank", "bucket", "key", "size", "room")
        sums = left.groupBy("rank", "bucket").agg(F.sum("size").alias("s"), F.first("room").alias("room"))
        sums = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("rank").orderBy("bucket")))
        cross = sums.where("upto > room AND upto - s <= room").select("rank", "bucket", (F.col("upto") - F.col("s")).alias("before"))
        keys = join(left, cross, ["rank", "bucket"]).groupBy("rank", "key").agg(F.sum("size").alias("s"), F.first("before").alias("before"), F.first("room").alias("room"))
        upto = F.col("before") + F.sum("s").over(Window.partitionBy("rank").orderBy("key"))
        found = keys.withColumn("upto", upto).groupBy("rank").agg(
            F.min(F.when(F.col("upto") > F.col("room"), F.col("key"))).alias("stop"), F.max(F.when(F.col("upto") <= F.col("room"), F.col("upto"))).alias("used"), F.first("before").alias("before"))
        whole = sums.groupBy("rank").agg(F.max("upto").alias("all"))
        used = F.coalesce("used", "before", "all", F.lit(0))
        state = stored(join(join(state, found, ["rank"], "left"), whole, ["rank"], "left").select(
            *state.drop("room").columns, F.col("room").alias(f"most{i}"), F.coalesce("stop", F.lit(END)).alias(f"stop{i}"), (F.col("room") - used).alias("room")), "fill")
    rows = join(dealt, state.select("room", *_passes(PASSES + SPARE)), ["rank"])
    near = rows.where((F.col("size") > 0) & (F.col("size") < 2 * F.col("room")) & (_times(PASSES + SPARE, most) < most - F.col("rounds")))
    near = near.groupBy("rank", "key").agg(F.sum("size").alias("s"), F.first("room").alias("room")).where("s < 2 * room")
    near = near.groupBy("rank").agg(F.min(F.struct(F.abs(F.col("s") - F.col("room")), "key"))["key"].alias("last"))
    return stored(join(state, near, ["rank"], "left"), "fill")


def curriculum(docs: DataFrame, schedule: Callable[[Column], Column] = ramp, most: int = MOST, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, source_size, target, copies, taken, positions: for every
    document how often it is taken, and for each time its place in the run, from 0 to 1.

    Sources are numbered by code point, null last. schedule(number) gives a source's weight over time: an array of
    struct(t, w), t rising from 0 to 1, straight between them. Its integral is the source's weight; ``targets`` says how
    many words that is. A source's documents, by the digest of their doc_id, are taken in as many whole rounds as fit,
    and some of them again. A copy's place is the time at which the words that the source has been asked for so far,
    the integral of its schedule, reach the words of all its copies before it.

    Null texts, texts without words and sources of such texts have size 0 and take nothing; a null source is a source.
    Rows that share doc_id and size are taken equally often. Null doc_ids come last. An empty table gives no rows. A
    source with all rows is dealt to buckets of at most about ``bucket_rows`` rows by digest, so only the rows of one
    doc_id have to be in one task. Rows hold no text here: the texts are read once, for their sizes.
    """
    spark = docs.sparkSession
    rows = stored(sized(docs), "sizes")
    sources = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "sources")
    sources = running(sources, [F.col("source").asc_nulls_last()], label="sources", keep=stored)
    sources = sources.withColumn("pieces", pieces(schedule(F.col("rank")))).withColumn("area", F.element_at("pieces", -1)["after"])
    sources = targets(stored(sources.withColumn("weight", F.round(F.col("area") * PART).cast("long")), "sources"), most)
    count, known = sources.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.count("*")).first()
    join = joiner(known)
    share = max(1, min(bucket_rows, count // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    rounds = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    sources = stored(sources.withColumn("rounds", rounds).withColumn("room", F.floor("target") - F.col("rounds") * F.col("source_size")).withColumn("buckets", F.ceil(F.col("docs") / share)), "targets")

    few = sources.select(F.col("source").alias("of"), "rank", "buckets")
    dealt = join(rows, few, rows["source"].eqNullSafe(few["of"]))
    digest = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("~"))
    place = F.when(F.col("doc_id").isNull(), F.col("buckets") - 1).otherwise(F.shiftright(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * F.col("buckets"), 32))
    dealt = stored(dealt.select("doc_id", "rank", "size", F.concat(digest, F.lit(":"), F.lpad(F.col("size").cast("string"), 19, "0")).alias("key"), place.cast("long").alias("bucket")), "dealt")

    state = fill(dealt, sources, join, most)
    n = PASSES + SPARE
    copies = F.when(F.col("size") > 0, F.col("rounds") + _times(n, most) + F.coalesce(F.col("key") == F.col("last"), F.lit(False)).cast("int")).otherwise(0).cast("long")
    rows = join(dealt, state.select("last", *_passes(n)), ["rank"]).select("doc_id", "rank", "size", "key", "bucket", copies.alias("copies"))
    # what a source gives: all documents that are taken once, by key, then those that are taken twice, and so on
    level = lambda k: F.when(F.col("copies") > k, F.col("size")).otherwise(0)
    sums = rows.groupBy("rank", "bucket").agg(*[F.sum(level(k)).alias(f"s{k}") for k in range(most)])
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(sums.select("*", *[F.coalesce(F.sum(f"s{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in range(most)]), "buckets")
    total = sums.groupBy("rank").agg(*[F.sum(f"s{k}").alias(f"t{k}") for k in range(most)])
    about = stored(join(state.select("rank", "source", "source_size", "target", "pieces", "area"), total, ["rank"]), "about")
    within = Window.partitionBy("rank", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sums.drop(*[f"s{k}" for k in range(most)])
    held = small(offsets)
    rows = rows.join(held, ["rank", "bucket"]) if held is not offsets else merged(rows).join(offsets, ["rank", "bucket"])
    rows = join(rows.select(
        "*", *[(F.sum(level(k)).over(within) + F.col(f"b{k}") - level(k)).alias(f"at{k}") for k in range(most)]), about, ["rank"])
    words = sum((F.col(f"t{k}") for k in range(most)), F.lit(0))
    begins = F.slice(F.array(*[F.col(f"at{k}") + sum((F.col(f"t{j}") for j in range(k)), F.lit(0)) for k in range(most)]), 1, F.col("copies").cast("int"))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.transform(begins, lambda y: F.least(F.lit(1.0), when_reached(F.col("pieces"), y / words * F.col("area")))).alias("positions"))


def training_order(mixed: DataFrame) -> DataFrame:
    """curriculum()'s documents -> doc_id, source, size, copy (from 0), position: a row each time that a document is
    taken, sorted by position in ranges, so that files written from it are read in order of the run."""
    rows = mixed.select("doc_id", "source", "size", F.posexplode("positions").alias("copy", "position"))
    return _ranges(rows, ["position", "doc_id", "size", "copy"])


def _ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    return rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the order of their first place in the run; those never taken come first."""
    docs = spread(table(spark, sf_dir, "documents"))
    first = F.get("positions", F.lit(0))
    out = finished(spark, lambda: curriculum(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", F.round(first, 9).alias("position")), "mix")
    return _ranges(out, ["position", "doc_id", "size"])


def _pass(i: int) -> str:
    """What pass i takes: x{i} has each source's room and the first key that doesn't fit, r{i + 1} all documents and the room left."""
    free = "times < 1" if i < PASSES else f"times < {MOST} - rounds"
    return f"""c{i} AS MATERIALIZED (SELECT rank, key, room, sum(size) OVER (PARTITION BY rank ORDER BY key) AS upto FROM r{i} WHERE {free} AND size > 0 AND size <= room),
 x{i} AS MATERIALIZED (SELECT rank, any_value(room) AS most, coalesce(min(key) FILTER (upto > room), '~~') AS stop, coalesce(max(upto) FILTER (upto <= room), 0) AS used FROM c{i} GROUP BY rank),
 r{i + 1} AS MATERIALIZED (SELECT doc_id, r.rank, rounds, size, key, (room - coalesce(used, 0))::BIGINT AS room, times + (CASE WHEN {free} AND size > 0 AND size <= most AND key < stop THEN 1 ELSE 0 END) AS times FROM r{i} r LEFT JOIN x{i} x ON x.rank = r.rank)"""


#: The targets by the order of the sources' limits in place of rounds; passes over sorted rows in place of buckets.
ORACLE = rf"""WITH sz AS MATERIALIZED (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
 s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sz GROUP BY source),
 s1 AS (SELECT *, [1, 5, 2][rank % 3 + 1] * {PART}::BIGINT AS weight, {MOST} * source_size AS most FROM s0),
 s2 AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
 (sum(weight) OVER (ORDER BY most / weight DESC, rank DESC))::BIGINT AS left_over, row_number() OVER (ORDER BY most / weight, rank) AS k FROM s1),
 lam AS (SELECT rest, left_over, k FROM s2 WHERE weight::HUGEINT * rest <= most::HUGEINT * left_over ORDER BY k LIMIT 1),
 s3 AS (SELECT s2.source, s2.rank, source_size, CASE WHEN s2.k < lam.k THEN most::DOUBLE ELSE weight::DOUBLE * lam.rest::DOUBLE / lam.left_over::DOUBLE END AS target FROM s2, lam),
 src AS MATERIALIZED (SELECT *, CASE WHEN source_size > 0 THEN least({MOST}, floor(target / source_size)) ELSE 0 END::BIGINT AS rounds FROM s3),
 r0 AS MATERIALIZED (SELECT doc_id, rank, rounds, size, coalesce(md5(doc_id::VARCHAR), '~') || ':' || lpad(size::VARCHAR, 19, '0') AS key, (floor(target) - rounds * source_size)::BIGINT AS room, 0 AS times FROM sz JOIN src ON src.source IS NOT DISTINCT FROM sz.source),
 {", ".join(_pass(i) for i in range(PASSES + SPARE))},
 nr AS (SELECT rank, arg_min(key, (abs(s - room), key)) AS last FROM (SELECT rank, key, sum(size) AS s, any_value(room) AS room FROM r{PASSES + SPARE} WHERE times < {MOST} - rounds AND size > 0 AND size < 2 * room GROUP BY ALL) WHERE s < 2 * room GROUP BY rank),
 f AS (SELECT doc_id, r.rank, size, key, CASE WHEN size = 0 THEN 0 ELSE rounds + times + CASE WHEN coalesce(key = last, false) THEN 1 ELSE 0 END END::BIGINT AS copies FROM r{PASSES + SPARE} r LEFT JOIN nr ON nr.rank = r.rank),
 g AS (SELECT f.*, source_size, target, (sum(CASE WHEN copies > 0 THEN size ELSE 0 END) OVER (PARTITION BY f.rank ORDER BY key ROWS UNBOUNDED PRECEDING) - size)::DOUBLE / sum(size * copies) OVER (PARTITION BY f.rank)::DOUBLE * [1.0, 5.0, 2.0][f.rank % 3 + 1]::DOUBLE AS a,
 [0.5, 6.0, 1.5][f.rank % 3 + 1]::DOUBLE AS w0, [1.0, -2.0, 1.0][f.rank % 3 + 1]::DOUBLE AS slope FROM f JOIN src USING (rank))
 SELECT doc_id, size, source_size, target, copies * size AS taken, copies, CASE WHEN copies > 0 THEN round(least(1.0, 2 * a / (w0 + sqrt(greatest(0.0, w0 * w0 + 2 * slope * a)))), 9) END AS position FROM g"""
