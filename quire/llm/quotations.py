"""Chat formatting in DataFrame operations: quoted passages are parsed, linked to the messages they quote and removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, stored, table

#: Turns of a conversation that are ordered together; sums over such chunks give the order over a whole conversation.
CHUNK = 1024
_NULL = -(2**62)
_MARKS = "^((?:>[ \\t]?)*)"


def _norm(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[\\x20\\x09-\\x0D]+", " "))


def _parsed(messages: DataFrame) -> DataFrame:
    """With lines: structs of level (number of > marks) and body, for each line of the text. The generator keeps the
    lines from being made again wherever they are used."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(
        (F.length(F.regexp_extract(x, _MARKS, 1)) - F.length(F.translate(F.regexp_extract(x, _MARKS, 1), ">", ""))).alias("level"),
        F.regexp_replace(x, _MARKS, "").alias("body")))
    return messages.withColumn("lines", F.explode(F.array(lines)))


def _passages(quoting: DataFrame) -> DataFrame:
    """quoting(conv_id, turn, role, text) -> conv_id, turn, row, level, at, body: the runs of lines of one level, each
    cut out of the lines once, so a text of n lines costs n."""
    rows = _parsed(quoting).withColumn("row", F.xxhash64("role", "text"))
    level = lambda i: F.get(F.col("lines"), i)["level"]
    bounds = F.filter(F.sequence(F.lit(0), F.size("lines")), lambda i: (i == 0) | (i == F.size("lines")) | (level(i) != level(i - 1)))
    rows = rows.select("conv_id", "turn", "row", "lines", F.explode(F.array(bounds)).alias("bounds"))
    part = lambda at, end: F.array_join(F.transform(F.slice("lines", at + 1, end - at), lambda x: x["body"]), "\n")
    runs = F.transform(F.filter(F.transform(F.slice("bounds", F.lit(1), F.size("bounds") - 1), lambda x, i: F.struct(x.alias("at"), F.get(F.col("bounds"), i + 1).alias("end"))), lambda r: level(r["at"]) > 0), lambda r: F.struct(
        level(r["at"]).alias("level"), r["at"].alias("at"), part(r["at"], r["end"]).alias("body")))
    return rows.select("conv_id", "turn", "row", F.explode(runs).alias("q")).select("conv_id", "turn", "row", "q.level", "q.at", "q.body").where(_norm(F.col("body")) != "").distinct()


def _own(lines: str = "lines") -> Column:
    kept = F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"])
    return F.regexp_replace(F.array_join(kept, "\n"), "^\\n+|\\n+$", "")


def _parts(text: str) -> list[Column]:
    """paragraphs and lines: hashes, as strings, of those of a text that aren't empty."""
    split = {"paragraphs": F.split(text, "\\n\\s*\\n"), "lines": F.split(text, "\n")}
    return [F.transform(F.filter(F.transform(c, _norm), lambda x: x != ""), lambda x: F.xxhash64(x).cast("string")).alias(k) for k, c in split.items()]


def _key(kind: Column, parts: Column) -> Column:
    return F.md5(F.concat_ws(",", kind, F.array_join(parts, ",")))


def _by_parts(lost: DataFrame, own: DataFrame) -> DataFrame:
    """lost(conv_id, turn, row, level, at, paragraphs, lines), own(conv_id, turn, own) -> conv_id, turn, row, level,
    original. Messages give all runs of as many units as a lost passage of their conversation has, and single units;
    each key keeps its first turn, so no row is made for each pair of a passage and a message."""
    kinds = ("paragraphs", "lines")

    def asked_of(k: str) -> Column:
        one = F.transform(F.array_distinct(k), lambda x: F.struct(F.lit(False).alias("whole"), _key(F.lit(k), F.array(x)).alias("key")))
        return F.concat(F.array(F.struct(F.lit(True).alias("whole"), _key(F.lit(k), F.col(k)).alias("key"))), one)

    def runs_of(k: str) -> Column:
        fits = F.filter(f"n_{k}", lambda n: n <= F.size(k))
        return F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), F.size(k) - n + 1), lambda i: _key(F.lit(k), F.slice(k, i, n)))))

    asked = lost.select("conv_id", "turn", "row", "level", "at", F.explode(F.concat(*map(asked_of, kinds))).alias("k")).select("conv_id", "turn", "row", "level", "at", "k.*")
    sizes = lost.groupBy("conv_id").agg(*[F.array_union(F.collect_set(F.size(k)), F.array(F.lit(1))).alias(f"n_{k}") for k in kinds])
    parts = own.join(small(sizes), "conv_id").select("conv_id", "turn", *[f"n_{k}" for k in kinds], *_parts("own"))
    runs = F.concat(*map(runs_of, kinds))
    first = parts.select("conv_id", "turn", F.explode(F.array_distinct(runs)).alias("key")).groupBy("conv_id", "key").agg(F.min("turn").alias("original"))
    found = asked.join(first, ["conv_id", "key"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original")))
    return found.groupBy("conv_id", "turn", "row", "level", "at").agg(F.coalesce(
        F.min(F.when(F.col("whole"), F.col("original"))), F.max("original")).alias("original")).drop("at")


def _links(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """conv_id, turn, row, level, original of each passage: by its whole, else by its parts."""
    asked = small(passages.select("conv_id").distinct())
    own = stored(_parsed(rows.join(asked, "conv_id", "left_semi")).select("conv_id", "turn", _own().alias("own")), "own")
    units = F.array_distinct(F.transform(F.concat(F.array("own"), F.split("own", "\\n\\s*\\n"), F.split("own", "\n")), _norm))
    originals = own.select("conv_id", "turn", F.explode(units).alias("unit")).where("unit != ''").groupBy("conv_id", F.md5("unit").alias("hash")).agg(F.min("turn").alias("original"))
    links = stored(passages.join(originals, ["conv_id", "hash"], "left").withColumn("original", F.when(F.col("original") < F.col("turn"), F.col("original"))), "whole-links")
    lost = links.where("original IS NULL").drop("hash", "original")
    links = links.where("original IS NOT NULL").select("conv_id", "turn", "row", "level", "original")
    return links if lost.isEmpty() else links.unionByName(_by_parts(lost, own))


def linked(messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, role, text) -> conv_id, turn, role, content, parent_turn, position, reply_position, n_quotes,
    n_linked.

    A quoted passage is a run of lines with the same number of > marks at the start. Normalised (lower case, single
    spaces), it is looked up by hash among the whole texts, paragraphs and lines that messages of the same
    conversation wrote themselves; its original is the first such message, if that is an earlier turn. A passage that
    is none of these is looked up as consecutive paragraphs and as consecutive lines, without empty ones. Where that
    fails too, each of its paragraphs and lines is looked up alone, and the latest of their originals is the
    passage's. Parts of a line are no units, so a passage of these alone isn't linked. parent_turn is
    the latest original of a message's outermost linked quotes, else the turn before, else null. content is the text
    without quoted lines and without empty lines at its ends. position counts the messages of a conversation from 0 in
    the order of turns, then role and text. reply_position counts them in the order of replies: after each turn come the
    turns that reply to it, the earliest first, each with all that follows from it (a turn of several messages replies to
    the latest of their parents). Null and empty texts have empty content. A null conv_id or turn is a value like others and
    comes first. Repeated rows each have a position. Other columns are not read.
    """
    rows = messages.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(_NULL)).alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(_NULL)).alias("turn"),
        F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    passages = _passages(rows.where(F.col("text").rlike("(?m)^>")))
    passages = stored(passages.select("conv_id", "turn", "row", "level", "at", F.md5(_norm(F.col("body"))).alias("hash"), *_parts("body")), "passages")
    quoting = not passages.isEmpty()
    out = rows.withColumn("row", F.xxhash64("role", "text")).withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    if quoting:
        links = stored(_links(rows, passages), "links")
        of_row = links.groupBy("conv_id", "turn", "row").agg(
            F.count("*").alias("n_quotes"), F.count("original").alias("n_linked"),
            F.max(F.when(F.col("original").isNotNull(), F.struct(-F.col("level"), "original"))).alias("best"))
        of_row = small(stored(of_row.select("conv_id", "turn", "row", "n_quotes", "n_linked", F.col("best.original").alias("quoted_turn")), "of-row"))
        out = out.join(of_row, ["conv_id", "turn", "row"], "left")
    else:
        out = out.select("*", *[F.lit(None).cast("long").alias(c) for c in ("n_quotes", "n_linked", "quoted_turn")])
    lines = F.when(F.col("text").rlike("(?m)^>"), F.regexp_replace(F.regexp_replace("text", "(?m)^>[^\\n]*(\\n|\\z)", ""), "^\\n+|\\n+$", "")).otherwise(F.regexp_replace("text", "^\\n+|\\n+$", ""))
    chunks = out.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    by_chunk = Window.partitionBy("conv_id").orderBy("chunk")
    chunks = chunks.select(
        "conv_id", "chunk", F.coalesce(F.sum("n").over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.lag("last").over(by_chunk).alias("last_before"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    earlier = Window.partitionBy("conv_id", "chunk").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("i", F.row_number().over(inside)).withColumn("previous", F.max("turn").over(earlier))
    out = out.join(chunks, ["conv_id", "chunk"]).withColumn("position", (F.col("before") + F.col("i") - 1).cast("long"))
    out = out.withColumn("previous", F.coalesce("previous", "last_before")).withColumn("parent", F.coalesce("quoted_turn", "previous"))
    if not quoting or links.where("original IS NOT NULL").isEmpty():
        out = out.withColumn("moved", F.lit(0).cast("long"))
    else:
        order = stored(out.select("conv_id", "turn", "previous", "parent", "position"), "order")
        out = out.join(small(_reply_starts(order, of_row)), ["conv_id", "turn"], "left")
    value = lambda c: F.when(c != _NULL, c)
    return out.select(
        value(F.col("conv_id")).alias("conv_id"), value(F.col("turn")).alias("turn"), "role", lines.alias("content"),
        value(F.col("parent")).alias("parent_turn"), "position", F.coalesce(F.col("position") + F.col("moved"), "position").alias("reply_position"),
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))


def _next_sibling(segments: DataFrame) -> DataFrame:
    """segments(conv_id, start, up, at) with after: the segment that follows among those of the same one above, by
    falling turn that they reply to, then by their own. Neighbours are found within chunks, then chunks are linked, then
    the turns replied to, so a message with very many replies is no single group."""
    key = ["conv_id", "up"]
    rows = segments.withColumn("chunk", F.floor(F.col("start") / CHUNK))
    inside = F.lead("start").over(Window.partitionBy(*key, "at", "chunk").orderBy("start"))
    chunks = rows.groupBy(*key, "at", "chunk").agg(F.min("start").alias("first"))
    chunks = chunks.select(*key, "at", "chunk", F.lead("first").over(Window.partitionBy(*key, "at").orderBy("chunk")).alias("of_chunk"))
    turns = rows.groupBy(*key, "at").agg(F.min("start").alias("first"))
    turns = turns.select(*key, "at", F.lead("first").over(Window.partitionBy(*key).orderBy(F.desc("at"))).alias("of_turn"))
    rows = rows.withColumn("inside", inside).join(chunks, [*key, "at", "chunk"]).join(turns, [*key, "at"])
    return rows.withColumn("after", F.coalesce("inside", "of_chunk", "of_turn")).drop("chunk", "inside", "of_chunk", "of_turn")


def _reply_starts(out: DataFrame, of_row: DataFrame) -> DataFrame:
    """out(conv_id, turn, previous, parent, position) -> conv_id, turn, moved: by how much the rows of a turn move from
    the order of turns to that of replies, in conversations where a message replies to another than the one before.

    There, a run of turns that each reply to the one before is a segment; it follows as a whole the turn that its first
    message replies to, after the segments that reply to later turns of the same segment. So segments form a tree, which
    is put in order by pointer jumping: each round doubles the distance, and no conversation is gathered anywhere.
    """
    turning = of_row.where("quoted_turn IS NOT NULL").select("conv_id").distinct()
    rows = out.join(small(turning), "conv_id", "left_semi").groupBy("conv_id", "turn").agg(
        F.max("parent").alias("parent"), F.min("previous").alias("previous"), F.min("position").alias("position"), F.count("*").alias("n"))
    rows = stored(rows.withColumn("jump", ~F.col("parent").eqNullSafe(F.col("previous")) | F.col("parent").isNull()), "turns")
    # the start of each turn's segment, a running maximum over chunks
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK)).withColumn("jumped", F.expr("CASE WHEN jump THEN turn END"))
    to_here = Window.partitionBy("conv_id", "chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.groupBy("conv_id", "chunk").agg(F.max("jumped").alias("top")).select("conv_id", "chunk", F.max("top").over(before).alias("earlier"))
    rows = rows.withColumn("here", F.max("jumped").over(to_here)).join(chunks, ["conv_id", "chunk"]).withColumn("start", F.coalesce("here", "earlier"))
    rows = stored(rows.select("conv_id", "turn", "parent", "position", "n", "start"), "in-segments")
    size = rows.groupBy("conv_id", "start").agg(F.sum("n").alias("size"), F.min("position").alias("first"))
    begin = rows.where("turn = start").select("conv_id", "start", F.col("parent").alias("at"))
    above = rows.select("conv_id", F.col("turn").alias("at"), F.col("start").alias("up"))
    segments = stored(begin.join(size, ["conv_id", "start"]).join(above, ["conv_id", "at"], "left"), "segments")
    linked_ = _next_sibling(segments.where("up IS NOT NULL").select("conv_id", "start", "up", "at"))
    # where no sibling follows, what follows is that of the nearest segment above that has one
    after = segments.select("conv_id", "start", "up").join(linked_.select("conv_id", "start", "after"), ["conv_id", "start"], "left")
    after = stored(after.select("conv_id", "start", "after", F.expr("CASE WHEN after IS NULL THEN up END").alias("up")), "after")
    while not after.where("up IS NOT NULL").isEmpty():
        above = after.select("conv_id", F.col("start").alias("up"), F.col("after").alias("their"), F.col("up").alias("further"))
        after = after.join(above, ["conv_id", "up"], "left")
        after = stored(after.select("conv_id", "start", F.coalesce("after", "their").alias("after"), F.expr("CASE WHEN after IS NULL AND their IS NULL THEN further END").alias("up")), "after")
    child = _first_child(linked_)
    chain = after.join(child, ["conv_id", "start"], "left").select("conv_id", "start", F.coalesce("child", "after").alias("next"))
    # the number of rows from each segment to the end, by jumps of doubling length
    chain = stored(chain.join(segments.select("conv_id", "start", "size"), ["conv_id", "start"]).withColumnRenamed("size", "rest"), "chain")
    while not chain.where("next IS NOT NULL").isEmpty():
        ahead = chain.select("conv_id", F.col("start").alias("next"), F.col("rest").alias("more"), F.col("next").alias("further"))
        chain = chain.join(ahead, ["conv_id", "next"], "left")
        chain = stored(chain.select("conv_id", "start", F.col("further").alias("next"), (F.col("rest") + F.coalesce("more", F.lit(0))).alias("rest")), "chain")
    total = segments.groupBy("conv_id").agg(F.sum("size").alias("total"))
    moved = chain.join(total, "conv_id").join(segments.select("conv_id", "start", "first"), ["conv_id", "start"])
    moved = moved.select("conv_id", "start", (F.col("total") - F.col("rest") - F.col("first")).alias("moved"))
    return stored(rows.join(moved, ["conv_id", "start"]).select("conv_id", "turn", "moved"), "moved")


def _first_child(siblings: DataFrame) -> DataFrame:
    """The first of each segment's children, in their order: of the latest turn replied to, the earliest."""
    return siblings.groupBy("conv_id", F.col("up").alias("parent_start")).agg(
        F.min(F.struct((-F.col("at")).alias("at"), "start")).alias("c")).select("conv_id", F.col("parent_start").alias("start"), F.col("c.start").alias("child"))


def conversations(messages: DataFrame, most: int = CHUNK) -> DataFrame:
    """messages as linked() reads them -> conv_id, part, messages (array of role and content): the conversations without
    quotes, in reply order, in parts of at most ``most`` messages, so a conversation of any length is no single row."""
    rows = linked(messages).select("conv_id", "reply_position", F.floor(F.col("reply_position") / most).alias("part"), "role", "content")
    parts = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("reply_position", "role", "content"))).alias("m"))
    return parts.select("conv_id", "part", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def op9_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "conversations"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op9, over conversations whose turns quote: every third one the whole turn before, with what that quotes, every
    fifth one a line of the turn two before, and some something that nobody wrote."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^>", "").alias("own"))
    mark = lambda c: F.regexp_replace(c, "(?m)^", "> ")
    said = lambda n: rows.groupBy("conv_id", (F.col("turn") + n).alias("turn")).agg(F.min("own").alias(f"before{n}"))
    rows = rows.join(said(1), ["conv_id", "turn"], "left").join(said(2), ["conv_id", "turn"], "left")
    quote = F.when((F.col("turn") % 3 == 2) & (F.col("before1") != ""), mark(F.col("before1"))).when((F.col("turn") % 5 == 4) & (F.col("before2") != ""), F.concat(F.lit(">> "), F.substring_index("before2", "\n", 1))).when(F.col("turn") % 7 == 3, "> nobody wrote this")
    return linked(rows.select("conv_id", "turn", "role", F.concat(F.coalesce(F.concat(quote, F.lit("\n")), F.lit("")), "own").alias("text")))


ORACLE = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER () AS id FROM conversations),
l AS (SELECT id, conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM m),
q AS (SELECT *, len(regexp_replace(regexp_extract(line, '^((?:>[ \t]?)*)', 1), '[^>]', '', 'g')) AS level, regexp_replace(line, '^((?:>[ \t]?)*)', '') AS body FROM l),
own AS (SELECT id, conv_id, turn, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (level = 0), ''), '^\n+|\n+$', '', 'g') AS own FROM q GROUP BY ALL),
unit AS (SELECT conv_id, turn, trim(regexp_replace(lower(unnest([own] || regexp_split_to_array(own, '\n\s*\n') || string_split(own, chr(10)))), '[\x20\x09-\x0D]+', ' ', 'g')) AS u FROM own),
org AS (SELECT conv_id, u, min(turn) AS original FROM unit WHERE u <> '' GROUP BY ALL),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY id, level ORDER BY pos) AS g FROM q WHERE level > 0),
pas AS (SELECT id, conv_id, turn, level, g, trim(regexp_replace(lower(string_agg(body, ' ' ORDER BY pos)), '[\x20\x09-\x0D]+', ' ', 'g')) AS u FROM isl GROUP BY id, conv_id, turn, level, g),
lk AS (SELECT pas.*, CASE WHEN original < turn THEN original END AS original FROM pas LEFT JOIN org USING (conv_id, u) WHERE u <> ''),
best AS (SELECT id, count(*) AS n_quotes, count(original) AS n_linked, max(original) FILTER (level = (SELECT min(level) FROM lk k WHERE k.id = lk.id AND k.original IS NOT NULL)) AS quoted FROM lk GROUP BY id),
msg AS (SELECT m.id, m.conv_id, m.turn, role, text, own.own AS content,
  coalesce(quoted, (SELECT max(e.turn) FROM (SELECT DISTINCT conv_id, turn FROM m) e WHERE e.conv_id = m.conv_id AND e.turn < m.turn)) AS parent_turn,
  coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked
  FROM m JOIN own USING (id) LEFT JOIN best USING (id)),
tn AS (SELECT conv_id, turn, max(parent_turn) AS parent FROM msg GROUP BY ALL),
tree AS (SELECT conv_id, turn, [turn] AS path FROM tn WHERE parent IS NULL UNION ALL SELECT tn.conv_id, tn.turn, list_append(path, tn.turn) FROM tree JOIN tn ON tn.conv_id = tree.conv_id AND tn.parent = tree.turn)
SELECT msg.conv_id, msg.turn, role, content, parent_turn,
  row_number() OVER (PARTITION BY msg.conv_id ORDER BY msg.turn, role, text) - 1 AS position,
  row_number() OVER (PARTITION BY msg.conv_id ORDER BY path, role, text) - 1 AS reply_position, n_quotes, n_linked
FROM msg JOIN tree USING (conv_id, turn)
"""


#: The same SQL over conversations that quote.
ORACLE_QUOTED = ORACLE.replace("WITH RECURSIVE m AS", r"""WITH RECURSIVE ow AS (SELECT conv_id, turn, role, regexp_replace(regexp_replace(coalesce(text, ''), '\n>', chr(10), 'g'), '^>', '') AS own FROM conversations),
b1 AS (SELECT conv_id, turn + 1 AS turn, min(own) AS before1 FROM ow GROUP BY ALL), b2 AS (SELECT conv_id, turn + 2 AS turn, min(own) AS before2 FROM ow GROUP BY ALL),
quoted AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 AND before1 <> '' THEN '> ' || replace(before1, chr(10), chr(10) || '> ') || chr(10) WHEN turn % 5 = 4 AND before2 <> '' THEN '>> ' || string_split(before2, chr(10))[1] || chr(10) WHEN turn % 7 = 3 THEN '> nobody wrote this' || chr(10) ELSE '' END || own AS text
 FROM ow LEFT JOIN b1 USING (conv_id, turn) LEFT JOIN b2 USING (conv_id, turn)),
m AS""", 1).replace("AS id FROM conversations)", "AS id FROM quoted)", 1)
