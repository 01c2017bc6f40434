"""Queries of the life of books, of the index, of progress tests and of the smaller functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import books as BK
from ..operators import clean as CL
from ..operators import export as EX
from ..operators import layout as LY
from ..operators import progress as PR
from ..operators import shelf as SH
from ..operators import updates as UP
from ..operators.edits import set_tags
from ..sources import objects as OB
from ..sources.encoding import candidate_pool
from . import carriers as C
from .catalogue import CLEANED, _b, _ch, _e, _shelf, query


def _k() -> Column:
    return F.col("id")


def _str(c: str | Column) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def _state(s, d):
    """Books with a status, a version and what is pending, by their number."""
    b = C.books(s, d).select("id", "title", "author", "word_count", "chapter_count", "created_at")
    return b.withColumns({
        "status": F.when(_k() % 3 == 0, "creating").otherwise("ready"), "clean_ver": _k() % 4 + 1, "pending_batch": F.when(_k() % 6 == 0, F.concat(F.lit("b"), _str(_k()))),
        "pending_sig": F.when(_k() % 6 == 0, F.concat(F.lit("s"), _str(_k() % 12)))})


_STATE = """st AS (SELECT id, title, author, word_count, chapter_count, created_at, CASE WHEN id % 3 = 0 THEN 'creating' ELSE 'ready' END AS status, id % 4 + 1 AS clean_ver,
 CASE WHEN id % 6 = 0 THEN 'b' || id END AS pending_batch, CASE WHEN id % 6 = 0 THEN 's' || (id % 12) END AS pending_sig FROM bk)"""


def _s(sql: str) -> str:
    return f"WITH {C.BOOKS}, {_STATE}, {C.CHAPTERS} {sql}"


def _trash(s, d):
    """Every fifth book lies in the trash; of some part is cleared."""
    b = C.books(s, d).where("id % 5 = 0")
    return b.select("id", "title", "author", "tags", "chapter_count", "word_count", ((_k() % 40) * C.DAY).alias("deleted_at"), F.when(_k() % 15 == 0, F.array(F.lit("1"), F.lit("2"))).alias("purge"), (_k() % 20 == 0).alias("purging"), F.when(_k() % 25 == 0, F.lit("c")).alias("purge_cursor"))


def _bodies(s, d):
    return C.chapters(s, d).where("words % 5 <> 0").select("book_id", "key", F.concat(F.lit("w "), _str("words")).alias("text"))


_BODIES = "bo AS (SELECT book_id, key, 'w ' || words AS text FROM ch WHERE words % 5 <> 0)"


# ---- create, fill, publish

@query("create_books", _b("""SELECT id, t AS title, word_count, len(tags) AS tags, CASE WHEN t = '' THEN 'no_title' WHEN id % 4 = 1 THEN 'no_chapters' WHEN id % 2 = 0 OR replace(t, ' ', '') IN (SELECT replace(replace(title, '#', ''), ' ', '') FROM sh WHERE id % 2 = 0) THEN 'duplicate' ELSE 'created' END AS verdict
 FROM (SELECT id, CASE WHEN id % 7 = 0 THEN '' ELSE trim(left(replace(title, '#', ''), 120)) END AS t, list_slice(tags || tags || tags, 1, 10) AS tags, greatest(word_count - 500, 0) AS word_count FROM (SELECT * REPLACE (replace(title, '#', '') AS title) FROM sh))"""))
def create_books(s, d):
    b = _shelf(s, d).withColumn("title", F.replace("title", F.lit("#"), F.lit("")))
    asked = b.select("id", F.when(_k() % 7 == 0, "<>").otherwise(F.concat(F.lit(" <"), "title", F.lit("/ "))).alias("title"), "author", F.lit(None).cast("string").alias("note"), F.concat("tags", F.array(F.lit("'")), "tags", "tags").alias("tags"),
                     (F.col("word_count") - 500).alias("word_count"), F.lit(0).alias("clean_ver"), F.lit(None).cast("boolean").alias("pinned"), F.when(_k() % 4 != 1, F.array(F.lit("a"), F.lit(""))).alias("titles"))
    return BK.create(asked, b.where("id % 2 = 0"), 5).select("id", "title", "word_count", F.size("tags").alias("tags"), "verdict")


@query("create_chapters", "SELECT p_partkey AS book_id, i AS pos, (i + 1)::VARCHAR AS key, CASE WHEN i % 2 = 0 THEN p_type || i ELSE '第' || (i + 1) || '章' END AS title FROM part, range(4) r(i) WHERE p_partkey % 3 <> 0")
def create_chapters(s, d):
    p = C.table(s, d, "part").select(F.col("p_partkey").alias("id"), "p_type")
    titles = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i % 2 == 0, F.concat("p_type", i.cast("string"))).otherwise("<>"))
    asked = p.select("id", F.concat(F.lit("t"), _str("id")).alias("title"), *[F.lit(None).cast(t).alias(c) for c, t in (("author", "string"), ("note", "string"), ("tags", "array<string>"), ("word_count", "long"), ("clean_ver", "long"), ("pinned", "boolean"))], titles.alias("titles"))
    return BK.new_chapters(BK.create(asked, asked.where("id % 3 = 0").select(F.col("title")), 5)).select("book_id", "pos", "key", "title")


@query("put_bodies", _s("""SELECT book_id, r AS request, CASE WHEN count(*) > 40 THEN 'too_many' WHEN any_value(status) IS NULL THEN 'no_book' WHEN any_value(status) = 'ready' THEN 'published' WHEN book_id % 5 = 0 THEN 'in_trash'
 WHEN sum(CASE WHEN words % 11 = 0 THEN 1 ELSE 0 END) > 0 THEN 'no_chapter' WHEN max(sz) > 2097152 OR sum(sz) > 16777216 THEN 'too_large' ELSE 'stored' END AS verdict
 FROM (SELECT book_id, pos % 2 AS r, words, words * 43000 AS sz, status FROM ch LEFT JOIN (SELECT * FROM st WHERE id % 7 <> 0) s ON s.id = book_id) GROUP BY book_id, r"""))
def put_bodies(s, d):
    ch = C.chapters(s, d)
    items = ch.select("book_id", (F.col("pos") % 2).alias("request"), F.when(F.col("words") % 11 == 0, "x").otherwise(F.col("key")).alias("key"), (F.col("words") * 43000).alias("size"))
    return BK.put_bodies(items, _state(s, d).where("id % 7 <> 0"), _trash(s, d), ch)


@query("replace_chapters", _ch("SELECT book_id, p AS pos, (p + 1)::VARCHAR AS key, CASE WHEN words % 4 = 0 THEN '第' || (p + 1) || '章' ELSE title END AS title FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos DESC) - 1 AS p FROM ch)"))
def replace_chapters(s, d):
    ch = C.chapters(s, d)
    n = ch.groupBy("book_id").agg(F.count("*").alias("n"))
    return BK.replaced_chapters(ch.join(n, "book_id").select("book_id", (F.col("n") - 1 - F.col("pos")).alias("pos"), F.when(F.col("words") % 4 == 0, " ").otherwise(F.col("title")).alias("title")))


@query("orphan_sweep", _ch("SELECT book_id, key, row_number() OVER (PARTITION BY book_id ORDER BY pos, key) <= 3 AS swept FROM ch WHERE words % 3 <> 0"))
def orphan_sweep(s, d):
    ch = C.chapters(s, d)
    return BK.sweep(ch.select("book_id", "key", F.col("pos").alias("i")), ch.where("words % 3 = 0"), 3)


@query("orphan_algebra", _ch("""SELECT book_id, key FROM (SELECT book_id, key FROM ch WHERE words % 2 = 0 UNION SELECT book_id, key FROM ch WHERE words % 5 = 1 UNION SELECT book_id, key FROM ch WHERE words % 7 = 3)
 EXCEPT SELECT book_id, key FROM ch WHERE words % 3 = 0 EXCEPT SELECT book_id, key FROM ch WHERE words % 5 = 0"""))
def orphan_algebra(s, d):
    ch = C.chapters(s, d)
    swept = ch.where("words % 5 < 2").withColumn("swept", F.col("words") % 5 == 0)
    return BK.orphan_algebra(ch.where("words % 2 = 0"), swept, ch.where("words % 7 = 3"), ch.where("words % 3 = 0"))


@query("append_chapters", _s("""SELECT id AS book_id, v AS verdict, CASE WHEN v = 'appended' THEN greatest(n, coalesce(top, 0)) + 1 END::BIGINT AS start, CASE WHEN v = 'appended' THEN greatest(0, word_count + id % 9 - 4) ELSE word_count END AS word_count, clean_ver + CASE WHEN v = 'appended' THEN 1 ELSE 0 END AS clean_ver
 FROM (SELECT st.*, coalesce(n, 0) AS n, greatest(coalesce(n, 0), 500 + id % 3) AS top, CASE WHEN id % 12 = 0 AND pending_batch IS NOT NULL THEN CASE WHEN pending_sig = 's0' THEN 'again' ELSE 'mismatch' END WHEN id % 6 = 0 THEN CASE WHEN pending_sig = 's0' THEN 'again' ELSE 'mismatch' END ELSE 'appended' END AS v
 FROM st LEFT JOIN (SELECT book_id, count(*) AS n FROM ch GROUP BY 1) c ON c.book_id = id)"""))
def append_chapters(s, d):
    b = _state(s, d)
    asked = b.select(F.col("id").alias("book_id"), F.when(_k() % 2 == 0, F.concat(F.lit("b"), _str(_k()))).otherwise("").alias("batch"), F.lit("s0").alias("sig"), F.array(F.lit("x")).alias("titles"), (_k() % 9 - 4).alias("words"))
    orphans = b.select(F.col("id").alias("book_id"), _str(_k() % 3 + 500).alias("key")).union(b.select("id", F.lit("n_99999")))
    return BK.append(asked, C.chapters(s, d), orphans, b.select("id", "word_count", "clean_ver", "pending_batch", "pending_sig"))


@query("publish_books", _s(f""", {_BODIES}, pr AS (SELECT DISTINCT c.book_id FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM ch) c LEFT JOIN bo ON bo.book_id = c.book_id AND bo.key = c.key WHERE pos IN (0, n // 2, n - 1) AND bo.key IS NULL),
 k AS (SELECT replace(title, ' ', '') AS k, min(id) AS lo, max(id) AS hi FROM st WHERE id % 2 = 0 GROUP BY 1)
 SELECT id, v AS verdict, CASE WHEN v = 'ready' THEN n END AS chapter_count FROM (SELECT st.id, n, CASE WHEN st.id % 13 = 0 THEN 'no_book' WHEN n IS NULL THEN 'no_chapters' WHEN st.id % 5 = 0 THEN 'in_trash' WHEN pr.book_id IS NOT NULL THEN 'incomplete'
 WHEN st.id % 2 = 1 AND lo IS NOT NULL THEN 'duplicate' ELSE 'ready' END AS v FROM st LEFT JOIN (SELECT book_id, count(*) AS n FROM ch GROUP BY 1) c ON c.book_id = st.id LEFT JOIN pr ON pr.book_id = st.id LEFT JOIN k ON k = replace(title, ' ', ''))""".replace(" , bo AS", ", bo AS", 1)))
def publish_books(s, d):
    b = _state(s, d)
    return BK.publish(b.select("id"), b.where("id % 13 <> 0"), C.chapters(s, d), _bodies(s, d), _trash(s, d), b.where("id % 2 = 0"))


@query("rollback_books", _s("""SELECT id, CASE WHEN status = 'creating' THEN 'ready' ELSE 'noop' END AS verdict, chapter_count - CASE WHEN u THEN 2 ELSE 0 END AS chapter_count, CASE WHEN u THEN greatest(0, word_count - id % 100 * 10) ELSE word_count END AS word_count
 FROM (SELECT *, status = 'creating' AND id % 4 <> 2 AND chapter_count >= 2 AND pending_batch IS NOT NULL AS u FROM st)"""))
def rollback_books(s, d):
    b = _state(s, d)
    asked = b.select("id", F.when(_k() % 4 == 2, "replace").otherwise("append").alias("op"), F.lit(2).alias("count"), (_k() % 100 * 10).alias("words"), F.when(_k() % 8 == 0, "").otherwise(F.concat(F.lit("b"), _str(_k()))).alias("batch"))
    return BK.rollback(asked, b.select("id", "status", "chapter_count", "word_count", "pending_batch"))


# ---- edits

_PATCH = f"""{_BODIES}, pt AS (SELECT id AS book_id, k.key, CASE WHEN id % 5 = 1 THEN NULL WHEN id % 6 = 0 THEN '  ' WHEN id % 6 = 4 THEN ' <> ' ELSE 'New' END AS nt, CASE WHEN id % 4 = 0 THEN 'a b c' END AS nx FROM st, (VALUES ('2'), ('none'), ('3')) k(key) WHERE id % 2 = 0 AND (k.key <> '3' OR id % 8 = 0)),
 pv AS (SELECT pt.*, CASE WHEN ch.key IS NULL THEN 'no_chapter' WHEN nt IS NULL AND nx IS NULL THEN 'nothing' ELSE 'patched' END AS verdict FROM pt LEFT JOIN ch ON ch.book_id = pt.book_id AND ch.key = pt.key),
 e AS (SELECT ch.*, v.book_id IS NOT NULL AS p, CASE WHEN nt IS NULL THEN title WHEN trim(nt) = '' THEN '第' || (pos + 1) || '章' WHEN nt = ' <> ' THEN '' ELSE nt END AS nt, CASE WHEN nx IS NOT NULL THEN 3 END AS nw FROM ch LEFT JOIN (SELECT * FROM pv WHERE verdict = 'patched') v ON v.book_id = ch.book_id AND v.key = ch.key)"""


def _patched(s, d):
    """Titles, texts or neither, of the second chapter, of one that isn't there and at times of the third; some versions are null or 0."""
    keys = F.explode(F.array(*map(F.lit, ("2", "none", "3")))).alias("key")
    asked = _state(s, d).where("id % 2 = 0").select(
        _k().alias("book_id"), keys, F.when(_k() % 5 == 1, None).when(_k() % 6 == 0, "  ").when(_k() % 6 == 4, " <> ").otherwise("New").alias("new_title"), F.when(_k() % 4 == 0, "a b\nc").alias("new_text"))
    return BK.patch_chapters(asked.where("key <> '3' OR book_id % 8 = 0"), C.chapters(s, d), _bodies(s, d), _odd_versions(s, d))


def _odd_versions(s, d):
    return _state(s, d).withColumn("clean_ver", F.when(_k() % 9 == 0, 0).when(_k() % 9 != 1, F.col("clean_ver")))


_VER = "CASE WHEN id % 9 IN (0, 1) THEN 1 ELSE clean_ver END"


@query("patch_verdicts", _s(f", {_PATCH} SELECT book_id, key, verdict FROM pv".replace(" , bo", ", bo", 1)))
def patch_verdicts(s, d):
    return _patched(s, d)[0]


@query("patch_chapters", _s(f""", {_PATCH} SELECT e.book_id, sum(length(nt))::BIGINT AS titles, sum(coalesce(nw, words))::BIGINT AS words, any_value(greatest(0, word_count + g)) AS word_count, any_value({_VER} + k) AS clean_ver
 FROM e JOIN st ON st.id = e.book_id JOIN (SELECT book_id, sum(coalesce(nw - words, 0))::BIGINT AS g, sum(p::INT)::BIGINT AS k FROM e GROUP BY 1 HAVING bool_or(p)) x ON x.book_id = e.book_id GROUP BY e.book_id""".replace(" , bo", ", bo", 1)))
def patch_chapters(s, d):
    _, table, sums = _patched(s, d)
    table = table.groupBy("book_id").agg(F.sum(F.length("title")).alias("titles"), F.sum("words").alias("words"))
    return table.join(sums.withColumnRenamed("id", "book_id"), "book_id")


_INSERT = """ins AS (SELECT id AS book_id, coalesce(n, 0) AS n, word_count, clean_ver, CASE WHEN id % 9 = 0 THEN 'empty' WHEN id % 3 = 2 OR (id % 3 = 1 AND n IS NULL) THEN 'no_chapter' ELSE 'inserted' END AS verdict, CASE WHEN id % 3 = 0 THEN coalesce(n, 0) WHEN id % 3 = 1 AND n IS NOT NULL THEN 1 END AS a
 FROM st LEFT JOIN (SELECT book_id, count(*) AS n FROM ch GROUP BY 1) c ON c.book_id = id)"""


def _inserted(s, d):
    """After the first chapter, after one that isn't there, or at the end, which null and '' mean."""
    after = F.when(_k() % 3 == 1, "1").when(_k() % 3 == 2, "none").when(_k() % 6 == 0, "")
    asked = _state(s, d).select(_k().alias("book_id"), after.alias("after"), F.when(_k() % 9 == 0, " ").when(_k() % 2 == 0, "").otherwise("In").alias("title"), F.when(_k() % 9 != 0, "some text").alias("text"), F.lit("n_new").alias("new_key"))
    return BK.insert_chapters(asked, C.chapters(s, d), PR.latest(C.events(s, d)).select("book_id", "ch"), _odd_versions(s, d))


@query("insert_verdicts", _s(f", {_INSERT} SELECT book_id, verdict, a AS \"at\" FROM ins".replace(" , ins", ", ins", 1)))
def insert_verdicts(s, d):
    return _inserted(s, d)[0]


@query("insert_chapters", _s(f""", {_INSERT} SELECT ch.book_id, key, pos + CASE WHEN pos >= a THEN 1 ELSE 0 END AS pos, title, words FROM ch JOIN ins ON ins.book_id = ch.book_id AND verdict = 'inserted'
 UNION ALL SELECT book_id, 'n_new', a, CASE WHEN book_id % 2 = 0 THEN '第' || (a + 1) || '章' ELSE 'In' END, 8 FROM ins WHERE verdict = 'inserted'""".replace(" , ins", ", ins", 1)))
def insert_chapters(s, d):
    return _inserted(s, d)[1]


@query("insert_progress", _s(f", {_INSERT}, lp AS (SELECT book_id, ch AS c FROM ev QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY at DESC, seq DESC) = 1) SELECT lp.book_id, c + CASE WHEN c >= 1 AND c - 1 >= a THEN 1 ELSE 0 END AS ch FROM lp JOIN ins ON ins.book_id = lp.book_id AND verdict = 'inserted'".replace(" , ins", ", ins", 1)))
def insert_progress(s, d):
    return _inserted(s, d)[2]


@query("insert_books", _s(f", {_INSERT} SELECT book_id AS id, n + 1 AS chapter_count, word_count + 8 AS word_count, CASE WHEN book_id % 9 IN (0, 1) THEN 1 ELSE clean_ver END + 1 AS clean_ver FROM ins WHERE verdict = 'inserted'".replace(" , ins", ", ins", 1)))
def insert_books(s, d):
    return _inserted(s, d)[3]


def _deleted(s, d):
    asked = _state(s, d).select(_k().alias("book_id"), F.when(_k() % 10 == 0, "none").otherwise("3").alias("key"))
    return BK.delete_chapters(asked, C.chapters(s, d).withColumn("words", F.when(F.col("words") % 2 == 0, F.col("words"))), _bodies(s, d), PR.latest(C.events(s, d)).select("book_id", "ch"), _odd_versions(s, d))


_DELETE = f"""{_BODIES}, cn AS MATERIALIZED (SELECT book_id, count(*) AS n, max(CASE WHEN pos = 2 THEN words END) AS words FROM ch GROUP BY 1),
 del AS MATERIALIZED (SELECT id AS book_id, n, word_count, clean_ver, CASE WHEN id % 10 = 0 OR coalesce(n, 0) < 3 THEN 'no_chapter' ELSE 'deleted' END AS verdict, CASE WHEN words % 2 = 0 THEN words WHEN words % 5 <> 0 THEN length('w' || words) ELSE 0 END AS w FROM st LEFT JOIN cn ON cn.book_id = id)"""


@query("delete_verdicts", _s(f", {_DELETE} SELECT book_id, verdict, CASE WHEN verdict = 'deleted' THEN w ELSE 0 END AS lost FROM del".replace(" , bo", ", bo", 1)))
def delete_verdicts(s, d):
    return _deleted(s, d)[0]


@query("delete_chapters", _s(f", {_DELETE} SELECT ch.book_id, key, pos - CASE WHEN pos > 2 THEN 1 ELSE 0 END AS pos, title, CASE WHEN words % 2 = 0 THEN words END AS words FROM ch JOIN del ON del.book_id = ch.book_id WHERE verdict = 'deleted' AND pos <> 2".replace(" , bo", ", bo", 1)))
def delete_chapters(s, d):
    return _deleted(s, d)[1]


@query("delete_progress", _s(f", {_DELETE}, lp AS (SELECT book_id, ch AS c FROM ev QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY at DESC, seq DESC) = 1) SELECT lp.book_id, CASE WHEN c >= 1 THEN least(CASE WHEN c - 1 > 2 THEN c - 1 ELSE c END, n - 1) ELSE c END AS ch FROM lp JOIN del ON del.book_id = lp.book_id AND verdict = 'deleted'".replace(" , bo", ", bo", 1)))
def delete_progress(s, d):
    return _deleted(s, d)[2]


@query("delete_books", _s(f", {_DELETE} SELECT book_id AS id, n - 1 AS chapter_count, greatest(0, word_count - w) AS word_count, CASE WHEN book_id % 9 IN (0, 1) THEN 1 ELSE clean_ver END + 1 AS clean_ver FROM del WHERE verdict = 'deleted'".replace(" , bo", ", bo", 1)))
def delete_books(s, d):
    return _deleted(s, d)[3]


# ---- replace, append and publish as whole results

def _orphans(s, d):
    """Some of these keys are live again, some are beyond the table."""
    return C.chapters(s, d).where("words % 3 = 0").select("book_id", _str(F.col("pos") + 3).alias("key"), F.col("pos").alias("i"))


_ORPHANS = "orp AS (SELECT book_id, (pos + 3)::VARCHAR AS key, pos AS i FROM ch WHERE words % 3 = 0)"
_LATEST = "lp AS (SELECT book_id, ch AS c, ratio, at FROM ev QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY at DESC, seq DESC) = 1)"


def _requests(s, d):
    """A request for three books of four; some without titles, some of books that aren't known or not on the shelf."""
    titles = F.when(_k() % 10 != 0, F.transform(F.sequence(F.lit(0), (_k() % 40).cast("int")), lambda j: F.when(j % 13 == 12, " ").otherwise(F.concat(F.lit("C"), _str((_k() + j * 7) % 50)))))
    b = _state(s, d).where("id % 4 <> 3")
    return b.select(
        "id", titles.alias("titles"), F.when(_k() % 5 == 0, "<").when(_k() % 5 == 1, F.concat(F.lit("T"), _str(_k()))).alias("new_title"), F.when(_k() % 4 == 0, "A").alias("new_author"), F.lit(None).cast("string").alias("new_note"),
        F.when(_k() % 3 == 0, F.array(F.lit("x"), F.lit(" "))).alias("new_tags"), F.when(_k() % 2 == 0, _k() * 10 - 300).alias("new_words"), F.when(_k() % 2 == 0, F.concat(F.lit("b"), _str(_k()))).otherwise("").alias("batch"), F.lit("s0").alias("sig"))


def _whole(s, d):
    """The books, with what else they have."""
    return _state(s, d).withColumns({"note": F.lit(None).cast("string"), "tags": F.array(F.lit("old")), "pinned": _k() % 10 == 0})


_REQ = f"""{_ORPHANS}, {_LATEST}, rq AS (SELECT *, CASE WHEN id % 10 = 0 THEN 0 ELSE id % 40 + 1 END AS m FROM st WHERE id % 4 <> 3),
 nt AS (SELECT id AS book_id, j, CASE WHEN j % 13 = 12 THEN NULL ELSE 'C' || ((id + j * 7) % 50) END AS t FROM rq, range(40) r(j) WHERE j < m),
 fd AS (SELECT id, CASE WHEN m = 0 THEN 'no_chapters' WHEN id % 6 = 5 THEN 'not_on_shelf' WHEN id % 7 = 0 THEN 'no_book' END AS why, CASE WHEN id % 5 = 1 THEN 'T' || id ELSE title END AS title, CASE WHEN id % 4 = 0 THEN 'A' ELSE author END AS author, CASE WHEN id % 3 = 0 THEN ['x'] ELSE ['old'] END AS tags, clean_ver, word_count, m, pending_batch, pending_sig FROM rq)"""
_REPLACE = f"""{_REQ}, ok AS MATERIALIZED (SELECT * FROM fd WHERE why IS NULL), nw AS MATERIALIZED (SELECT nt.book_id, j AS pos, (j + 1)::VARCHAR AS key, coalesce(t, '第' || (j + 1) || '章') AS title FROM nt JOIN ok ON ok.id = nt.book_id),
 og AS (SELECT orp.* FROM orp JOIN ok ON ok.id = orp.book_id), oc AS MATERIALIZED (SELECT ch.* FROM ch JOIN ok ON ok.id = ch.book_id),
 sw AS (SELECT book_id, key, row_number() OVER (PARTITION BY book_id ORDER BY i, key) <= 24 AS swept FROM og WHERE (book_id, key) NOT IN (SELECT (book_id, key) FROM oc UNION ALL SELECT (book_id, key) FROM nw))"""


def _replaced(s, d):
    b = _whole(s, d)
    return UP.replace(_requests(s, d), b.where("id % 7 <> 0"), C.chapters(s, d), _orphans(s, d), PR.latest(C.events(s, d)).select("book_id", "ch", "ratio"), b.where("id % 6 <> 5"), 5)


@query("replace_verdicts", _s(f", {_REPLACE} SELECT id, coalesce(why, 'replaced') AS verdict FROM fd"))
def replace_verdicts(s, d):
    return _replaced(s, d).verdicts


@query("replace_books", _s(f", {_REPLACE} SELECT id, title, author, tags, CASE WHEN id % 2 = 0 THEN greatest(0, id * 10 - 300) ELSE word_count END AS word_count, clean_ver + 1 AS clean_ver, 5::BIGINT AS updated_at, 'creating' AS status FROM ok"))
def replace_books(s, d):
    return _replaced(s, d).books.select("id", "title", "author", "tags", "word_count", "clean_ver", "updated_at", "status")


@query("replace_table", _s(f", {_REPLACE} SELECT book_id, pos, key, title FROM nw"))
def replace_table(s, d):
    return _replaced(s, d).chapters


@query("replace_orphans", _s(f""", {_REPLACE}, lv AS (SELECT book_id, key FROM og UNION SELECT book_id, key FROM oc) SELECT book_id, key, true AS swept FROM sw WHERE swept
 UNION ALL SELECT book_id, key, false FROM lv WHERE (book_id, key) NOT IN (SELECT (book_id, key) FROM nw) AND (book_id, key) NOT IN (SELECT (book_id, key) FROM sw WHERE swept)"""))
def replace_orphans(s, d):
    return _replaced(s, d).orphans


@query("replace_progress", _s(f""", {_REPLACE}, o AS (SELECT lp.*, oc.title FROM lp JOIN ok ON ok.id = lp.book_id LEFT JOIN oc ON oc.book_id = lp.book_id AND oc.pos = c - 1),
 t AS (SELECT o.*, (SELECT min(pos) + 1 FROM nw WHERE nw.book_id = o.book_id AND nw.title = o.title) AS goes FROM o) SELECT book_id, CASE WHEN title IS NULL THEN c WHEN goes IS NULL THEN 1 ELSE goes END AS ch, CASE WHEN title IS NOT NULL AND goes IS NULL THEN 0 ELSE ratio END AS ratio FROM t"""))
def replace_progress(s, d):
    return _replaced(s, d).progress


_EXTEND = f"""{_REQ}, tp AS (SELECT book_id, max(try_cast(key AS BIGINT)) AS top FROM (SELECT book_id, key FROM ch UNION ALL SELECT book_id, key FROM orp) GROUP BY 1), cn AS (SELECT book_id, count(*) AS n FROM ch GROUP BY 1),
 ap AS MATERIALIZED (SELECT fd.*, coalesce(n, 0) AS n, greatest(coalesce(n, 0), coalesce(top, 0)) + 1 AS start, coalesce(why, CASE WHEN id % 2 = 0 AND coalesce('b' || id = pending_batch, false) THEN CASE WHEN pending_sig = 's0' THEN 'again' ELSE 'mismatch' END ELSE 'appended' END) AS verdict FROM fd LEFT JOIN tp ON tp.book_id = id LEFT JOIN cn ON cn.book_id = id)"""


def _extended(s, d):
    b = _whole(s, d)
    return UP.extend(_requests(s, d), b.where("id % 7 <> 0"), C.chapters(s, d), _orphans(s, d), b.where("id % 6 <> 5"), 5)


@query("extend_verdicts", _s(f", {_EXTEND} SELECT id, verdict FROM ap"))
def extend_verdicts(s, d):
    return _extended(s, d).verdicts


@query("extend_books", _s(f", {_EXTEND} SELECT id, title, author, tags, greatest(0, word_count + CASE WHEN id % 2 = 0 THEN id * 10 - 300 ELSE 0 END) AS word_count, clean_ver + 1 AS clean_ver, 'creating' AS status, CASE WHEN id % 2 = 0 THEN 'b' || id ELSE pending_batch END AS pending_batch FROM ap WHERE verdict = 'appended'"))
def extend_books(s, d):
    return _extended(s, d).books.select("id", "title", "author", "tags", "word_count", "clean_ver", "status", "pending_batch")


@query("extend_table", _s(f", {_EXTEND} SELECT ch.book_id, pos, key, ch.title FROM ch JOIN ap ON ap.id = ch.book_id WHERE verdict = 'appended' UNION ALL SELECT nt.book_id, n + j, (start + j)::VARCHAR, coalesce(t, '第' || (start + j) || '章') FROM nt JOIN ap ON ap.id = nt.book_id WHERE verdict = 'appended'"))
def extend_table(s, d):
    return _extended(s, d).chapters


_PUBLISHED = f"""{_BODIES}, {_ORPHANS}, {_LATEST}, pr AS (SELECT DISTINCT c.book_id FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM ch) c LEFT JOIN bo ON bo.book_id = c.book_id AND bo.key = c.key WHERE pos IN (0, n // 2, n - 1) AND bo.key IS NULL),
 k AS (SELECT replace(title, ' ', '') AS k, min(id) AS lo FROM st WHERE id % 2 = 0 GROUP BY 1), cn AS (SELECT book_id, count(*) AS n FROM ch GROUP BY 1),
 pb AS MATERIALIZED (SELECT st.*, n FROM st JOIN cn ON cn.book_id = id LEFT JOIN k ON k = replace(title, ' ', '') WHERE id % 13 <> 0 AND id % 5 <> 0 AND id NOT IN (SELECT book_id FROM pr) AND NOT (id % 2 = 1 AND lo IS NOT NULL))"""


def _published(s, d):
    b = _whole(s, d)
    shelf = b.where("id % 2 = 0").select("id", "title", (_k() % 6 == 0).alias("pinned"), F.lit(2).cast("long").alias("prog_ch"), F.lit(0.25).alias("prog_ratio"), _k().alias("prog_at"))
    progress = PR.latest(C.events(s, d)).select("book_id", F.when(F.col("book_id") % 3 != 0, F.col("ch")).alias("ch"), "ratio", "at")
    return UP.publication(b.select("id"), b.where("id % 13 <> 0"), C.chapters(s, d), _bodies(s, d), _orphans(s, d), progress, _trash(s, d), shelf, 5)


@query("publish_shelf", _s(f""", {_PUBLISHED} SELECT id, title, author, n AS chapter_count, word_count, clean_ver, 5::BIGINT AS updated_at, (id % 2 = 0 AND id % 6 = 0) OR id % 10 = 0 AS pinned,
 CASE WHEN id % 3 <> 0 AND lp.book_id IS NOT NULL THEN c WHEN id % 2 = 0 THEN 2 END AS prog_ch, CASE WHEN id % 3 <> 0 AND lp.book_id IS NOT NULL THEN ratio WHEN id % 2 = 0 THEN 0.25 END AS prog_ratio, CASE WHEN id % 3 <> 0 AND lp.book_id IS NOT NULL THEN at WHEN id % 2 = 0 THEN id END AS prog_at FROM pb LEFT JOIN lp ON lp.book_id = id""".replace(" , bo", ", bo", 1)))
def publish_shelf(s, d):
    return _published(s, d).shelf


@query("publish_state", _s(f", {_PUBLISHED} SELECT id, n AS chapter_count, word_count, 'ready' AS status, NULL::VARCHAR AS pending_batch FROM pb".replace(" , bo", ", bo", 1)))
def publish_state(s, d):
    return _published(s, d).books.select("id", "chapter_count", "word_count", "status", "pending_batch")


@query("publish_orphans", _s(f", {_PUBLISHED} SELECT orp.book_id, key, row_number() OVER (PARTITION BY orp.book_id ORDER BY i, key) <= 24 AS swept FROM orp JOIN pb ON pb.id = orp.book_id WHERE (orp.book_id, key) NOT IN (SELECT (book_id, key) FROM ch)".replace(" , bo", ", bo", 1)))
def publish_orphans(s, d):
    return _published(s, d).orphans


@query("patch_fields", _b("SELECT id, 'T' || id AS title, CASE WHEN id % 4 = 0 THEN 'note' ELSE 'old' END AS note, CASE WHEN id % 3 = 0 THEN ['one'] ELSE tags END AS tags, 7::BIGINT AS updated_at FROM sh WHERE id % 2 = 0"))
def patch_fields(s, d):
    b = C.books(s, d).withColumn("note", F.lit("old"))
    p = b.where("id % 2 = 0").select("id", F.concat(F.lit("T"), _str(_k())).alias("title"), F.when(_k() % 4 == 0, "note").alias("note"), F.when(_k() % 3 == 0, set_tags(["one"])).alias("tags"))
    return BK.patch_fields(b, p, ("title", "note", "tags"), 7)


@query("batch_set_tags", _b("SELECT id, CASE WHEN id % 2 = 0 THEN ['a', 'b'] ELSE [] END AS tags FROM sh"))
def batch_set_tags(s, d):
    return _shelf(s, d).select("id", F.when(_k() % 2 == 0, set_tags(["a", "b"])).otherwise(set_tags([])).alias("tags"))


@query("batch_plan", """WITH a AS (SELECT p_partkey AS id, p_partkey * 7919 % 10007 AS r FROM part), f AS (SELECT *, row_number() OVER (ORDER BY r) AS n, CASE WHEN id % 9 <> 0 THEN id % 4 END AS sd FROM a QUALIFY n <= 18),
 g AS (SELECT *, sum(CASE WHEN sd IS NOT NULL AND fr = 1 THEN 1 ELSE 0 END) OVER (ORDER BY r) AS k, sum(CASE WHEN sd IS NOT NULL THEN 1 ELSE 0 END) OVER (ORDER BY r) AS m FROM (SELECT *, row_number() OVER (PARTITION BY sd ORDER BY r) AS fr FROM f)),
 h AS (SELECT *, bool_or(sd IS NOT NULL AND 3 + 6 * k + 4 * m > 48) OVER (ORDER BY r) AS late FROM g)
 SELECT a.id, CASE WHEN h.id IS NULL OR late THEN 'deferred' WHEN sd IS NULL THEN 'skipped' WHEN a.id % 5 <> 0 THEN 'updated' ELSE 'skipped' END AS verdict FROM a LEFT JOIN h USING (id)""")
def batch_plan(s, d):
    p = C.table(s, d, "part").select(F.col("p_partkey").alias("id"))
    asked = p.select((_k() * 7919 % 10007).alias("rank"), "id").union(p.select((_k() * 7919 % 10007 + 20_000), "id"))
    return BK.batch_plan(asked, p.where("id % 9 <> 0").select("id", (_k() % 4).alias("shard")), p.where("id % 5 <> 0"))


# ---- trash

@query("soft_delete", _s("""SELECT id, CASE WHEN id % 2 = 0 THEN 'moved' WHEN id % 5 = 0 AND id % 3 <> 0 THEN 'unchanged' WHEN id % 3 <> 0 THEN 'moved' ELSE 'no_book' END AS verdict,
 CASE WHEN id % 2 = 0 THEN 9 WHEN id % 5 = 0 AND id % 3 <> 0 THEN id % 40 * 86400000 WHEN id % 3 <> 0 THEN 9 END::BIGINT AS deleted_at FROM st"""))
def soft_delete(s, d):
    b = _state(s, d)
    return BK.soft_delete(b, b.where("id % 2 = 0"), b.where("id % 3 <> 0"), _trash(s, d), 9)


_REST = "NOT (id % 20 = 0 OR id % 15 = 0 OR id % 25 = 0)"


@query("trash_list", _b(f"SELECT row_number() OVER (ORDER BY deleted_at DESC, id) AS rank, id, title, deleted_at, purge, purging, restorable FROM (SELECT id, title, id % 40 * {C.DAY} AS deleted_at, CASE WHEN id % 15 = 0 THEN 2 ELSE 0 END::BIGINT AS purge, id % 20 = 0 AS purging, {_REST} AS restorable FROM sh WHERE id % 5 = 0) QUALIFY rank <= 100"))
def trash_list(s, d):
    """The first hundred as they are shown."""
    return BK.newest_deleted(BK.trash_list(_trash(s, d)), 100).select("rank", "id", "title", "deleted_at", "purge", "purging", "restorable")


@query("restore_books", _s(f"SELECT id, CASE WHEN id % 5 <> 0 THEN 'not_in_trash' WHEN NOT ({_REST}) THEN 'purging' WHEN id % 7 = 0 THEN 'no_book' WHEN status <> 'ready' THEN 'unpublished' ELSE 'restored' END AS verdict FROM st"))
def restore_books(s, d):
    b = _state(s, d)
    return BK.restore(b, _trash(s, d), b.where("id % 7 <> 0"))


@query("purge_keys", _ch("SELECT book_id, key FROM ch WHERE book_id % 5 = 0 QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY pos, key) <= 10"))
def purge_keys(s, d):
    return BK.purge(C.chapters(s, d).where("book_id % 5 = 0").withColumn("i", F.col("pos")), 10)[0]


@query("purge_state", _ch("SELECT book_id, least(count(*), 10)::BIGINT AS deleted, greatest(count(*) - 10, 0)::BIGINT AS remaining, count(*) <= 10 AS done FROM ch GROUP BY 1"))
def purge_state(s, d):
    return BK.purge(C.chapters(s, d).withColumn("i", F.col("pos")), 10)[1]


@query("trash_sweep", _b(f"SELECT id FROM sh WHERE id % 5 = 0 AND {30 * C.DAY} - id % 40 * {C.DAY} > {15 * C.DAY} ORDER BY id LIMIT 1"))
def trash_sweep(s, d):
    """One book a request."""
    return BK.sweep_trash(_trash(s, d), 30 * C.DAY).select("id")


@query("delete_objects", _ch("""SELECT rank, CASE WHEN b THEN 'skipped' WHEN n <= 500 THEN 'deleted' ELSE 'deferred' END AS verdict FROM (SELECT *, sum(CASE WHEN b THEN 0 ELSE 1 END) OVER (ORDER BY rank) AS n FROM (SELECT book_id * 1000 + pos AS rank,
 CASE words % 4 WHEN 0 THEN words % 3 <> 0 WHEN 1 THEN book_id % 2 <> 0 WHEN 2 THEN book_id % 2 <> 0 ELSE true END AS b FROM ch))"""))
def delete_objects(s, d):
    ch, w = C.chapters(s, d), F.col("words") % 4
    asked = ch.select((F.col("book_id") * 1000 + F.col("pos")).alias("rank"), "book_id", "key", F.when(w == 0, "text").when(w == 1, "raw").when(w == 2, "progress").otherwise("meta").alias("prefix"))
    return BK.delete_objects(asked, ch.where("words % 3 <> 0"), ch.where("book_id % 2 <> 0"), 500)


# ---- import, joins

@query("import_files", "SELECT conv_id AS n, CASE WHEN conv_id % 11 = 0 THEN 'failed' WHEN conv_id % 400 % 2 = 0 THEN 'skipped' WHEN conv_id = min(CASE WHEN conv_id % 11 <> 0 THEN conv_id END) OVER (PARTITION BY conv_id % 400) THEN 'imported' ELSE 'skipped' END AS verdict FROM (SELECT DISTINCT conv_id FROM conversations)")
def import_files(s, d):
    """Raw bytes of each conversation to chapters; titles from file names, every second one on the shelf already."""
    from ..operators.chapters import split_chapters
    from ..sources.encoding import decoded

    name = lambda k: F.concat(F.lit("b"), _str(k % 400))
    raw = C.chaptered(s, d).select("conv_id", F.encode(F.when(F.col("conv_id") % 11 == 0, " \n").otherwise(F.col("text")), "UTF-8").alias("raw"))
    files = raw.select("conv_id", T.title_of_file(F.concat(name(F.col("conv_id")), F.lit(".txt")), F.col("conv_id")).alias("title"), decoded(F.col("raw")).alias("x"))
    cut = split_chapters(files.select("conv_id", "title", F.col("x.text").alias("text")))
    shelf = s.range(0, 400, 2).select(name(F.col("id")).alias("title"))
    return BK.import_files(cut.select(F.col("conv_id").alias("n"), "title", "chapters"), shelf)


@query("shelf_progress", _b("SELECT sh.id, CASE WHEN f.id IS NOT NULL THEN CASE WHEN chapter_count > 0 AND c > chapter_count THEN chapter_count ELSE c END ELSE prog_ch END AS prog_ch, CASE WHEN f.id IS NOT NULL THEN 0.5 ELSE prog_ratio END AS prog_ratio, CASE WHEN f.id IS NOT NULL THEN 11 ELSE prog_at END AS prog_at FROM sh LEFT JOIN (SELECT id, id % 60 AS c FROM sh WHERE id % 3 = 0) f ON f.id = sh.id"))
def shelf_progress(s, d):
    b = _shelf(s, d)
    fresh = b.where("id % 3 = 0").select("id", (_k() % 60).alias("ch"), F.lit(0.5).alias("ratio"), F.lit(11).cast("long").alias("at"))
    return BK.with_progress(b, fresh).select("id", "prog_ch", "prog_ratio", "prog_at")


@query("sync_index", _b("SELECT id, 'T' || id AS title, 5::BIGINT AS word_count, pinned, prog_ch FROM sh WHERE id % 2 = 0 AND id % 3 = 0"))
def sync_index(s, d):
    b = _shelf(s, d)
    edited = b.where("id % 3 = 0").select("id", F.concat(F.lit("T"), _str(_k())).alias("title"), F.lit(5).cast("long").alias("word_count"))
    return BK.sync_index(b.where("id % 2 = 0").select("id", "title", "word_count", "pinned", "prog_ch"), edited).select("id", "title", "word_count", "pinned", "prog_ch")


@query("library", _b("SELECT id, CASE WHEN id % 2 = 0 THEN 'shelf' ELSE 'trash' END AS place FROM sh WHERE id % 2 = 0 OR id % 5 = 0"))
def library(s, d):
    return SH.library(C.books(s, d).where("id % 2 = 0").select("id", "title"), _trash(s, d).select("id", "title", "deleted_at")).select("id", "place")


# ---- index

@query("index_open", "SELECT p_partkey AS id, p_partkey % 30 AS shard FROM part WHERE p_partkey % 30 IN (3, 7)")
def index_open(s, d):
    root = C.table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 30).alias("shard"))
    return LY.open_index(root, root, root.where("id IN (3, 7, 33)"))


@query("index_probe", "SELECT max(p_partkey % 50) + 1 AS shards, count(*) AS books, max(p_partkey % 50) + 1 > 40 AS over FROM part")
def index_probe(s, d):
    return LY.probe_root(C.table(s, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("shard")))


@query("index_has", "SELECT p_partkey AS id, p_partkey % 3 <> 0 AS has FROM part")
def index_has(s, d):
    p = C.table(s, d, "part").select(F.col("p_partkey").alias("id"))
    return LY.index_has(p, p.where("id % 3 <> 0"))


@query("index_upsert", """WITH RECURSIVE r AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS g FROM part WHERE p_partkey % 2 = 0), c AS (SELECT max(g // 20) AS l FROM r),
 t AS (SELECT id, row_number() OVER (ORDER BY late, k) - 1 AS p FROM (SELECT id, 0 AS late, g AS k FROM r, c WHERE g // 20 = l UNION ALL SELECT p_partkey, 1, p_partkey FROM part WHERE p_partkey % 2 = 1)),
 w AS (SELECT 0 AS s, 0::BIGINT AS a, (SELECT count(*) FROM t) AS n UNION ALL SELECT s + 1, a + 11, n FROM w WHERE n - a > 20)
 SELECT id, g // 20 AS shard FROM r, c WHERE g // 20 < l UNION ALL SELECT id, l + (SELECT max(s) FROM w WHERE a <= p) AS shard FROM t, c""")
def index_upsert(s, d):
    """Shards of 20; every second book is new."""
    p = C.table(s, d, "part").select(F.col("p_partkey").alias("id"))
    from ..operators.integrity import shard_of_rows

    root = shard_of_rows(p.where("id % 2 = 0"), 20).withColumn("i", _k())
    return LY.upsert(root, p.select("id", _k().alias("n")), 20)


@query("index_load", """SELECT p_partkey AS shard, CASE WHEN p_partkey % 4 = 0 THEN 'primary' WHEN p_partkey % 3 = 0 THEN 'backup' ELSE 'broken' END AS source, CASE WHEN p_partkey % 4 = 0 THEN ['a' || p_partkey, 'b'] WHEN p_partkey % 3 = 0 THEN ['c'] ELSE [] END AS ids FROM part""")
def index_load(s, d):
    k = F.col("p_partkey")
    p = C.table(s, d, "part")
    good = F.concat(F.lit('{"books":[{"id":"a'), _str(k), F.lit('"},{"id":"b"}]}'))
    first = p.select(k.alias("shard"), F.when(k % 4 == 0, good).when(k % 4 == 1, "{bad").otherwise("[]").alias("raw"))
    return LY.load_shards(first, p.select(k.alias("shard"), F.when(k % 3 == 0, '{"books":[{"id":"c"}]}').alias("raw")))


@query("index_rebuild", "SELECT id, min(shard)::BIGINT AS shard FROM (SELECT p_partkey AS id, p_partkey % 6 AS shard FROM part WHERE p_partkey % 6 < 4 UNION ALL SELECT p_partkey, (p_partkey + 1) % 6 FROM part WHERE (p_partkey + 1) % 6 >= 4) GROUP BY 1")
def index_rebuild(s, d):
    p = C.table(s, d, "part").select(F.col("p_partkey").alias("id"))
    return LY.rebuild_root(p.select((_k() % 6).alias("shard"), "id").where("shard < 4"), p.select(((_k() + 1) % 6).alias("shard"), "id"))


_OBJ = """ob AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'meta' WHEN 1 THEN 'text' WHEN 2 THEN 'raw' ELSE 'progress' END AS prefix, o_custkey AS book_id, o_orderkey::VARCHAR AS key, o_orderkey % 1000 AS size FROM orders),
 od AS (SELECT DISTINCT book_id FROM ob WHERE prefix = 'meta' AND book_id % 7 <> 0), sc AS (SELECT ob.*, CASE WHEN prefix = 'text' AND book_id % 7 = 0 AND book_id % 2 = 0 THEN 'unverified' WHEN prefix = 'text' AND book_id % 7 = 0 AND size % 5 <> 0 THEN 'chapter_orphan' WHEN book_id % 7 = 0 THEN 'live'
 WHEN book_id IN (SELECT book_id FROM od) THEN 'orphan_book' ELSE 'residue' END AS class FROM ob)"""


def _scanned(s, d):
    k = F.col("o_orderkey")
    ob = C.table(s, d, "orders").select(F.when(k % 4 == 0, "meta").when(k % 4 == 1, "text").when(k % 4 == 2, "raw").otherwise("progress").alias("prefix"), F.col("o_custkey").alias("book_id"), _str(k).alias("key"), (k % 1000).alias("size"))
    return LY.scan(ob, ob.where("book_id % 7 = 0"), ob.where("book_id % 2 <> 0"), ob.where("size % 5 = 0"), ob.where("size % 2 = 0"))


@query("object_scan", f"WITH {_OBJ} SELECT key, class, class = 'chapter_orphan' AND size % 2 = 0 AS known FROM sc")
def object_scan(s, d):
    return _scanned(s, d).select("key", "class", "known")


@query("scan_summary", f"WITH {_OBJ} SELECT class, count(*)::BIGINT AS objects, sum(size)::BIGINT AS bytes FROM sc GROUP BY 1")
def scan_summary(s, d):
    return LY.scan_summary(_scanned(s, d))


@query("owner_titles", _b("SELECT o_orderkey AS key, CASE WHEN o_custkey % 2 = 0 THEN title WHEN o_custkey % 3 = 0 THEN 'trash' ELSE '' END AS book_title FROM orders JOIN sh ON sh.id = o_custkey"))
def owner_titles(s, d):
    b = C.books(s, d).select("id", "title")
    ob = C.table(s, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("book_id"))
    return LY.owner_titles(ob.join(b.select(F.col("id").alias("book_id")), "book_id", "left_semi"), b.where("id % 2 = 0"), b.where("id % 3 = 0").withColumn("title", F.lit("trash"))).select("key", "book_title")


@query("upload_batches", f"""WITH RECURSIVE {C.CHAPTERS}, c AS (SELECT book_id, pos, words AS size, least(40, greatest(2, ceil(count(*) OVER (PARTITION BY book_id) / 3.0)))::BIGINT AS most FROM ch),
 f AS (SELECT book_id, pos, 0::BIGINT AS batch, 1::BIGINT AS n, size AS total FROM c WHERE pos = 0 UNION ALL
 SELECT c.book_id, c.pos, f.batch + CASE WHEN f.n >= most OR f.total + size > 120 THEN 1 ELSE 0 END, CASE WHEN f.n >= most OR f.total + size > 120 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= most OR f.total + size > 120 THEN size ELSE f.total + size END FROM f JOIN c ON c.book_id = f.book_id AND c.pos = f.pos + 1)
 SELECT book_id, pos, batch FROM f""")
def upload_batches(s, d):
    """Batches of at most 120 words."""
    return LY.upload_batches(C.chapters(s, d).select("book_id", "pos", F.col("words").alias("size")), bytes_=120)


# ---- objects

@query("versioned_read", "SELECT doc_id, md5(text) AS etag FROM documents")
def versioned_read(s, d):
    return OB.versioned(C.table(s, d, "documents").select("doc_id", F.col("text").alias("content"))).select("doc_id", "etag")


@query("conditional_write", """WITH w AS (SELECT event_id AS seq, user_id AS key, event_id % 13 = 0 AS force, CASE WHEN event_id % 3 = 0 THEN 'e' || user_id WHEN event_id % 3 = 1 THEN 'old' END AS expect, CASE WHEN user_id % 2 = 0 THEN 'e' || user_id END AS etag FROM events),
 f AS (SELECT *, force OR expect IS NOT DISTINCT FROM etag AS fits FROM w) SELECT key, seq, fits AND row_number() OVER (PARTITION BY key, fits ORDER BY force DESC, CASE WHEN force THEN -seq ELSE seq END) = 1 AS ok FROM f""")
def conditional_write(s, d):
    k, u = F.col("event_id"), F.col("user_id")
    e = C.table(s, d, "events")
    etag = F.concat(F.lit("e"), _str(u))
    writes = e.select(u.alias("key"), k.alias("seq"), F.when(k % 3 == 0, etag).when(k % 3 == 1, "old").alias("expect"), (k % 13 == 0).alias("force"))
    return OB.put_if(e.where("user_id % 2 = 0").select(u.alias("key"), etag.alias("etag")).distinct(), writes)


_BODY = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{bad' WHEN 2 THEN '12' WHEN 3 THEN 'null' WHEN 4 THEN '' ELSE '[' || repeat('1,', 60) || '1]' END"""


def _raw_body(k):
    return F.when(k % 6 == 0, F.col("props")).when(k % 6 == 1, "{bad").when(k % 6 == 2, "12").when(k % 6 == 3, "null").when(k % 6 == 4, "").otherwise(F.concat(F.lit("["), F.repeat(F.lit("1,"), F.lit(60)), F.lit("1]")))


@query("json_body", f"SELECT event_id, s AS status, CASE WHEN s = 200 THEN CASE WHEN b <> '' AND json_type(b) IN ('OBJECT', 'ARRAY') THEN b ELSE '{{}}' END END AS body FROM (SELECT event_id, {_BODY} AS b, CASE WHEN event_id % 6 = 5 THEN 413 WHEN event_id % 6 = 1 THEN 400 ELSE 200 END AS s FROM events)")
def json_body(s, d):
    return C.table(s, d, "events").select("event_id", OB.json_body(_raw_body(F.col("event_id")), 100).alias("x")).select("event_id", "x.status", "x.body")


@query("lenient_json", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN (props->>'$.k')::BIGINT ELSE -1 END AS k FROM events")
def lenient_json(s, d):
    e = C.table(s, d, "events")
    raw = F.when(F.col("event_id") % 6 == 0, F.col("props")).when(F.col("event_id") % 6 == 1, "{bad")
    return e.select("event_id", OB.lenient(raw, "k long", F.struct(F.lit(-1).cast("long").alias("k")))["k"].alias("k"))


@query("fetch_chapters", _ch("SELECT book_id, pos, CASE WHEN words % 5 <> 0 THEN 'w ' || words WHEN words % 2 = 0 THEN 'kept' ELSE '' END AS text, CASE WHEN words % 5 <> 0 THEN 'first' WHEN words % 2 = 0 THEN 'second' ELSE 'missing' END AS source FROM ch"))
def fetch_chapters(s, d):
    ch = C.chapters(s, d)
    return OB.fetch(ch, _bodies(s, d), ch.where("words % 2 = 0").select("book_id", "key", F.lit("kept").alias("text")))


@query("list_cursor", "SELECT key, true AS truncated, max(key) OVER () AS cursor FROM (SELECT 'text/' || o_orderkey AS key FROM orders WHERE key > 'text/3' ORDER BY key LIMIT 100)")
def list_cursor(s, d):
    """One page of a hundred keys."""
    return OB.listed(C.table(s, d, "orders").select(F.concat(F.lit("text/"), _str("o_orderkey")).alias("key")), "text/", "text/3", 100)


@query("encoding_candidates")
def encoding_candidates(s, d):
    """What may be offered for the bytes of each turn, with the scores."""
    return C.table(s, d, "conversations").select("conv_id", "turn", F.explode(candidate_pool(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("c")).select("conv_id", "turn", "c.encoding", "c.score")


@query("reclean", f"WITH {C.RAW}, once AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {CLEANED} ELSE text END AS text FROM raw) SELECT doc_id, md5({CLEANED}) AS digest, {CLEANED} <> text AS changed FROM once")
def reclean(s, d):
    """Texts that have been cleaned, and others, are cleaned again."""
    once = C.raw_texts(s, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, CL.clean_text(F.col("text"))).otherwise(F.col("text")).alias("text"))
    return once.select("doc_id", CL.recleaned(F.col("text")).alias("x")).select("doc_id", F.md5("x.text").alias("digest"), "x.changed")


# ---- progress

@query("offline_queue", _e("""SELECT device, book_id, max(a - i) OVER (PARTITION BY device ORDER BY i) + i AS at, ch FROM (SELECT *, row_number() OVER (PARTITION BY device ORDER BY a, book_id) AS i FROM
 (SELECT seq % 5 AS device, book_id, at // 86400000 AS a, ch FROM ev QUALIFY row_number() OVER (PARTITION BY seq % 5, book_id ORDER BY at // 86400000 DESC, seq DESC) = 1))"""))
def offline_queue(s, d):
    """Times are days, so that many are equal."""
    e = C.events(s, d).withColumn("device", F.col("seq") % 5).withColumn("at", F.floor(F.col("at") / C.DAY))
    return PR.offline_queue(e).select("device", "book_id", "at", "ch")


@query("progress_writes", f"""WITH RECURSIVE {C.EVENTS}, w AS (SELECT book_id, seq, seq * 10 AS now, CASE WHEN seq % 3 = 0 THEN seq * 10 - seq % 7 * 4000 ELSE 0 END AS ca, CASE WHEN seq % 5 = 0 THEN greatest(0, seq * 10 - seq % 11 * 3000) END AS ba, CASE WHEN seq % 4 = 0 THEN seq % 3 + 1 ELSE 0 END AS cv,
 CASE WHEN book_id % 13 = 5 THEN NULL WHEN book_id % 8 IN (0, 1) THEN 1 ELSE book_id % 3 + 1 END AS bv, row_number() OVER (PARTITION BY book_id ORDER BY seq) AS r FROM ev),
 x AS (SELECT book_id, seq, r, CASE WHEN ba IS NOT NULL AND 0 > ba THEN 'occ' WHEN cv > 0 AND bv <> cv THEN 'cleanVer' ELSE 'written' END AS verdict,
 CASE WHEN (ba IS NOT NULL AND 0 > ba) OR (cv > 0 AND coalesce(bv <> cv, false)) THEN NULL::BIGINT ELSE now END AS held FROM w WHERE r = 1 UNION ALL SELECT w.book_id, w.seq, w.r, CASE WHEN ca <> 0 AND held > ca THEN 'stale' WHEN ba IS NOT NULL AND coalesce(held, 0) > ba THEN 'occ' WHEN cv > 0 AND bv <> cv THEN 'cleanVer' ELSE 'written' END,
 CASE WHEN (ca <> 0 AND coalesce(held > ca, false)) OR (ba IS NOT NULL AND coalesce(held, 0) > ba) OR (cv > 0 AND coalesce(bv <> cv, false)) THEN held ELSE now END FROM x JOIN w ON w.book_id = x.book_id AND w.r = x.r + 1) SELECT book_id, seq, verdict FROM x""")
def progress_writes(s, d):
    """Some books have no record, some a version that is null or 0."""
    q, k = F.col("seq"), F.col("book_id")
    e = C.events(s, d).select(
        "book_id", "seq", (q * 10).alias("now"), F.when(q % 3 == 0, q * 10 - q % 7 * 4000).otherwise(0).alias("client_at"), F.when(q % 5 == 0, F.greatest(F.lit(0), q * 10 - q % 11 * 3000)).alias("base_at"), F.when(q % 4 == 0, q % 3 + 1).otherwise(0).alias("client_ver"))
    books = e.select("book_id").distinct().where(k % 13 != 5)
    return PR.progress_writes(e, books.select("book_id", F.when(k % 8 == 1, 0).when(k % 8 != 0, k % 3 + 1).alias("clean_ver")))


@query("active_records", "WITH r AS (SELECT c_custkey AS ip, CASE WHEN c_custkey % 4 = 0 THEN c_custkey * 1000 END AS u, c_custkey * 700 AS a FROM customer), l AS (SELECT * FROM r WHERE u > 500000 OR a > 400000) SELECT ip FROM l WHERE u > 500000 UNION ALL (SELECT ip FROM l WHERE NOT coalesce(u > 500000, false) ORDER BY a DESC, ip LIMIT 200)")
def active_records(s, d):
    k = F.col("c_custkey")
    r = C.table(s, d, "customer").select(k.alias("ip"), F.when(k % 4 == 0, k * 1000).alias("until"), (k * 700).alias("at"))
    return PR.active_records(r, 500_000, 100_000, 200).select("ip")


@query("client_move", _b("""SELECT id, CASE WHEN sat IS NULL OR coalesce(base, -1) >= sat OR sat = 0 THEN 'ignore' WHEN p = cur AND (r IS NULL OR abs(r - coalesce(prog_ratio, 0)) <= 0.02) THEN 'stay' ELSE 'move' END AS move FROM (SELECT id, prog_at AS sat, prog_ratio, id % 3 AS cur, CASE WHEN id % 5 <> 0 THEN 0.5 END AS r,
 CASE id % 4 WHEN 0 THEN prog_at WHEN 1 THEN prog_at - 5 END AS base, greatest(0, least(greatest(0, chapter_count - 1), coalesce(nullif(prog_ch, 0), 1) - 1)) AS p FROM sh)"""))
def client_move(s, d):
    base = F.when(_k() % 4 == 0, F.col("prog_at")).when(_k() % 4 == 1, F.col("prog_at") - 5)
    return _shelf(s, d).select("id", PR.client_move(_k() % 3, F.when(_k() % 5 != 0, 0.5), base, F.col("prog_ch"), F.col("prog_ratio"), F.col("prog_at"), F.col("chapter_count")).alias("move"))


@query("coalesced_writes", _e("SELECT book_id, at // 604800000 AS slot, at, seq, ch FROM ev QUALIFY row_number() OVER (PARTITION BY book_id, at // 604800000 ORDER BY at DESC, seq DESC) = 1"))
def coalesced_writes(s, d):
    """Weeks for seconds, as events are hours apart."""
    return PR.coalesced(C.events(s, d), 7 * C.DAY).select("book_id", "slot", "at", "seq", "ch")


# ---- scalars and views

@query("safe_ids", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE p_partkey % 2 = 0 END AS safe FROM part")
def safe_ids(s, d):
    k = F.col("p_partkey")
    c = F.when(k % 3 == 0, F.concat(F.lit("a-B_"), _str(k))).when(k % 3 == 1, F.concat(F.lit("a/"), _str(k))).otherwise(F.repeat(F.lit("x"), F.when(k % 2 == 0, 80).otherwise(81)))
    return C.table(s, d, "part").select(k.alias("id"), T.is_safe_id(c).alias("safe"))


@query("new_ids", "SELECT doc_id, 'n_' || lower(to_base(('0x' || left(sha256(doc_id::VARCHAR), 15))::BIGINT, 36)) AS id FROM documents")
def new_ids(s, d):
    return C.table(s, d, "documents").select("doc_id", T.new_id(_str("doc_id")).alias("id"))


@query("rfc5987", "SELECT doc_id, md5(replace(url_encode(text || ' (a)*!~''é.txt'), '%21', '!')) AS encoded FROM documents")
def rfc5987(s, d):
    return C.table(s, d, "documents").select("doc_id", F.md5(T.rfc5987(F.concat("text", F.lit(" (a)*!~'é.txt")))).alias("encoded"))


@query("b64url", "SELECT doc_id, md5(rtrim(replace(replace(to_base64(encode(text)), '+', '-'), '/', '_'), '=')) AS encoded, true AS back FROM documents")
def b64url(s, d):
    c = C.table(s, d, "documents").select("doc_id", "text", T.b64url(F.encode("text", "UTF-8")).alias("e"))
    return c.select("doc_id", F.md5("e").alias("encoded"), (T.b64url_decode(F.col("e")).cast("string") == F.col("text")).alias("back"))


@query("client_ip", "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '10.0.0.' || c_custkey WHEN 1 THEN '9.9.9.9' ELSE 'unknown' END AS ip FROM customer")
def client_ip(s, d):
    k = F.col("c_custkey")
    return C.table(s, d, "customer").select(k.alias("id"), T.client_ip(F.when(k % 4 == 0, F.concat(F.lit("10.0.0."), _str(k))).when(k % 4 == 1, ""), F.when(k % 4 == 1, "1.2.3.4, 9.9.9.9 ,").when(k % 4 == 2, " , ")).alias("ip"))


@query("progress_badge", _b("SELECT id, CASE WHEN state = 'unread' THEN '' WHEN state = 'done' THEN '✓ 已读完' WHEN least(coalesce(prog_ch, 0), chapter_count) <= 0 THEN '在读' ELSE '读到 ' || least(prog_ch, chapter_count) || '/' || chapter_count || ' 章' END AS badge FROM sh"))
def progress_badge(s, d):
    return _shelf(s, d).select("id", T.progress_badge(F.col("state"), F.col("prog_ch"), F.col("chapter_count")).alias("badge"))


@query("head_percent", _ch("SELECT book_id, pos, greatest(0, least(99, floor(pos::DOUBLE / n * 100 + 0.5)))::BIGINT AS percent FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM ch)"))
def head_percent(s, d):
    ch = C.chapters(s, d)
    return ch.join(ch.groupBy("book_id").agg(F.count("*").alias("n")), "book_id").select("book_id", "pos", T.head_percent(F.col("pos"), F.col("n")).alias("percent"))


@query("clamp_chapter", _e("SELECT seq, greatest(0, least(9, ch - 5)) AS place FROM ev"))
def clamp_chapter(s, d):
    return C.events(s, d).select("seq", T.clamp_chapter(F.col("ch") - 5 + F.lit(0.5), F.lit(10)).alias("place"))


@query("env_number", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_partkey::DOUBLE + CASE WHEN p_partkey = 0 THEN 7 ELSE 0 END ELSE 7 END AS n FROM part")
def env_number(s, d):
    k = F.col("p_partkey")
    return C.table(s, d, "part").select(k.alias("id"), T.env_number(F.when(k % 4 == 0, _str(k)).when(k % 4 == 1, "x").when(k % 4 == 2, "0"), 7).alias("n"))


@query("normal_place", _e("SELECT seq, greatest(0, ch - 20) AS ch, CASE WHEN seq % 5 = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ratio * 3 - 1)) END AS ratio FROM ev"))
def normal_place(s, d):
    return C.events(s, d).select("seq", *T.normal_place(F.col("ch") - 20, F.when(F.col("seq") % 5 != 0, F.col("ratio") * 3 - 1)))


@query("toc_page", _ch("SELECT book_id, pos, title, pos = c AS cur, pos < c AS read FROM (SELECT *, book_id % 37 AS c FROM ch) WHERE pos < greatest(5, c + 1)"))
def toc_page(s, d):
    ch = C.chapters(s, d)
    return SH.toc(ch, ch.select("book_id", (F.col("book_id") % 37).alias("cur")).distinct(), size=5)


@query("create_payload", "SELECT p_partkey AS id, least(p_size * 1000, 20000)::BIGINT AS n FROM part")
def create_payload(s, d):
    return C.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.size(BK.create_payload(F.array_repeat(F.lit("t"), F.col("p_size") * 1000))).cast("long").alias("n"))


@query("tag_list", _b("SELECT tag, count(*)::BIGINT AS n, count(*) OVER () AS total, row_number() OVER (ORDER BY count(*) DESC, tag COLLATE zh, tag) AS rank FROM (SELECT unnest(tags) AS tag FROM sh) GROUP BY tag"))
def tag_list(s, d):
    return SH.tag_list(_shelf(s, d)).select("tag", "n", "total", "rank")


@query("tag_preset", _b("SELECT tag, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, tag) AS rank FROM (SELECT unnest(tags) AS tag FROM sh) GROUP BY tag QUALIFY rank <= 20"))
def tag_preset(s, d):
    return SH.top_tags(_shelf(s, d), 20)


@query("tag_cloud", _b(", t AS (SELECT tag, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, tag) AS rank FROM (SELECT unnest(tags) AS tag FROM sh) GROUP BY tag) SELECT tag, n, CASE WHEN rank > 6 THEN 0 ELSE rank END AS place FROM t WHERE rank <= 6 OR (rank <= 12 AND tag = 'STANDARD')"))
def tag_cloud(s, d):
    return SH.tag_cloud(_shelf(s, d), "STANDARD").select("tag", "n", "place")


@query("shelf_tag", _b("SELECT id FROM sh WHERE list_contains(tags, 'PROMO')"))
def shelf_tag(s, d):
    return SH.facets(_shelf(s, d), tag="PROMO").select("id")


@query("shelf_sort_title_zh", _b("SELECT row_number() OVER (ORDER BY pinned DESC, title COLLATE zh, id) AS rank, id FROM sh QUALIFY rank <= 60"))
def shelf_sort_title_zh(s, d):
    return SH.titles_in_chinese(_shelf(s, d), 60)


@query("shelf_pages", _b("SELECT row_number() OVER (ORDER BY pinned DESC, recent DESC, id) AS rank, id FROM sh QUALIFY rank <= 120"))
def shelf_pages(s, d):
    return SH.pages(_shelf(s, d), "recent", 2, 60, "id")


@query("selection_all", "SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0")
def selection_all(s, d):
    p = C.table(s, d, "part").select(F.col("p_partkey").alias("id"))
    return SH.pick(p.where("id % 2 = 0"), p.where("id % 3 = 0"))


@query("selection_invert", "SELECT p_partkey AS id FROM part WHERE (p_partkey % 2 = 0) <> (p_partkey % 3 = 0)")
def selection_invert(s, d):
    p = C.table(s, d, "part").select(F.col("p_partkey").alias("id"))
    return SH.pick(p.where("id % 2 = 0"), p.where("id % 3 = 0"), invert=True)


@query("selection_prune", _b("SELECT id FROM sh WHERE id % 2 = 0 AND star"))
def selection_prune(s, d):
    b = _shelf(s, d)
    return SH.prune(b.where("id % 2 = 0").select("id"), SH.facets(b, star=True))


@query("snapshot_sane", _s("SELECT id FROM st WHERE id % 3 <> 0 AND id % 4 <> 0"))
def snapshot_sane(s, d):
    b = _state(s, d).select(F.when(_k() % 3 != 0, _k()).alias("id"), F.when(_k() % 4 == 0, "").otherwise(F.col("title")).alias("title"))
    return SH.sane(b).select("id")


@query("readable_books", _s("SELECT id, title, clean_ver, false AS has_orphans FROM st WHERE status = 'ready'"))
def readable_books(s, d):
    """has_orphans: whether what only upkeep needs is still there."""
    view = SH.book_view(SH.readable(_state(s, d).withColumn("orphans", F.array(F.lit("9")))))
    return view.select("id", "title", "clean_ver", F.lit("orphans" in view.columns).alias("has_orphans"))


@query("page_quota", "SELECT p_partkey AS id, least(3, r) AS meta, CASE WHEN r >= 10 THEN 3 ELSE greatest(0, (r - least(3, r) - 1) // 2) END AS side, greatest(CASE WHEN r > 3 THEN 1 ELSE 0 END, least(12, r - least(3, r) - 2 * CASE WHEN r >= 10 THEN 3 ELSE greatest(0, (r - least(3, r) - 1) // 2) END)) AS text FROM (SELECT p_partkey, p_partkey % 48 AS r FROM part)")
def page_quota(s, d):
    return C.table(s, d, "part").select(F.col("p_partkey").alias("id"), *LY.page_quota((F.col("p_partkey") % 48).cast("int"), F.lit(False)))


@query("feed_document", _b("""SELECT '<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><link rel="self" href="/opds?page=2"/><link rel="start" href="/opds?page=1"/><link rel="previous" href="/opds?page=1"/><link rel="next" href="/opds?page=3"/><updated>1970-01-01T00:00:05Z</updated>'
 || string_agg('<entry><title>' || replace(title, '&', '&amp;') || '</title><id>urn:book:' || id || '</id><author><name>' || author || '</name></author><updated>' || strftime(make_timestamp(created_at * 1000), '%Y-%m-%dT%H:%M:%SZ') || '</updated><link rel="http://opds-spec.org/acquisition" href="/export/' || id || '.txt" type="text/plain"/></entry>', '' ORDER BY rank) || '</feed>' AS feed
 FROM (SELECT *, row_number() OVER (ORDER BY pinned DESC, recent DESC, id) AS rank FROM sh QUALIFY rank <= 100)"""))
def feed_document(s, d):
    page = SH.top(_shelf(s, d), "recent", 100, "id", "title", "author", F.col("created_at").alias("at"))
    return EX.feed_document(page, 2, 250, 5000)
