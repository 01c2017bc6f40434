"""All queries of the text library, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chapters as CH
from ..operators import clean as CL
from ..operators import edits as ED
from ..operators import export as EX
from ..operators import integrity as IN
from ..operators import progress as PR
from ..operators import shelf as SH
from ..session import spread
from ..sources.encoding import decoded
from . import carriers as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_WS = r"\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:  # "at" is a keyword there
            ORACLES[name] = re.sub(r"(?<![\w\"'])at(?![\w\"'])", '"at"', sql)
        return f

    return keep


def _shelf(s: SparkSession, d: str) -> DataFrame:
    return SH.shelf_entries(C.books(s, d))


# ---- segmentation

@query("flagship_chapters", f"""SELECT conv_id, CASE WHEN count(*) > 1 THEN 'cn' END AS rule, count(*)::BIGINT AS chapters,
 sum(length(regexp_replace(text, '[{_WS}]+', '', 'g')) + CASE WHEN n = 1 THEN length('第1章' || role) ELSE 0 END)::BIGINT AS words
 FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) GROUP BY conv_id""")
def flagship_chapters(s, d):
    df = CH.split_chapters(C.chaptered(s, d), clean=None)
    words = F.aggregate("chapters", F.lit(0).cast("long"), lambda a, c: a + T.count_words(c["content"]))
    return df.select("conv_id", "rule", F.size("chapters").cast("long").alias("chapters"), words.alias("words"))


@query("detect_rule", "SELECT conv_id, CASE WHEN count(*) > 1 THEN 'cn' END AS rule FROM conversations GROUP BY conv_id")
def detect_rule(s, d):
    return C.chaptered(s, d).select("conv_id", CH.rule_of(F.col("text")).alias("rule"))


@query("chapter_titles", """SELECT conv_id, turn AS pos, CASE WHEN n > 1 THEN '第' || (turn + 1) || '章 ' || role ELSE '第1章 ' || role END AS title
 FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)""")
def chapter_titles(s, d):
    rows = CH.chapter_rows(CH.split_chapters(C.chaptered(s, d), clean=None), "conv_id")
    return rows.select("conv_id", F.col("pos").cast("long").alias("pos"), "title")


@query("title_like", "SELECT doc_id, length(t) > 0 AND length(t) <= 40 AND NOT contains(t, '。') AND NOT (regexp_matches(t, '[，,、；;]') AND length(t) > 16) AS title_like FROM (SELECT doc_id, string_split(text, chr(10))[1] AS t FROM documents)")
def title_like(s, d):
    first = F.substring_index("text", "\n", 1)
    return C.table(s, d, "documents").select("doc_id", CH.like_title(first).alias("title_like"))


@query("split_preamble", """SELECT conv_id, count(*)::BIGINT + 1 AS chapters, '引子' AS first FROM conversations GROUP BY conv_id HAVING count(*) > 1""")
def split_preamble(s, d):
    df = C.chaptered(s, d).withColumn("text", F.concat(F.lit("before it all\n\n"), "text"))
    df = CH.split_chapters(df, clean=None).where("rule IS NOT NULL")
    return df.select("conv_id", F.size("chapters").cast("long").alias("chapters"), F.get("chapters", F.lit(0))["title"].alias("first"))


@query("split_drop_empty", "SELECT conv_id, count(*)::BIGINT AS chapters FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def split_drop_empty(s, d):
    df = C.chaptered(s, d).withColumn("text", F.concat("text", F.lit("第9999章 empty\n \n第10000章 empty too\n")))
    return CH.split_chapters(df, clean=None).where("size(chapters) > 1 OR rule IS NULL").select("conv_id", (F.size("chapters")).cast("long").alias("chapters")).where("chapters > 1")


@query("split_none", f"SELECT doc_id, 'none' AS rule, (CASE WHEN regexp_matches(text, '[^{_WS}]') THEN 1 ELSE 0 END)::BIGINT AS chapters FROM documents")
def split_none(s, d):
    df = CH.split_chapters(C.table(s, d, "documents"), pattern="none", clean=None)
    return df.select("doc_id", "rule", F.size("chapters").cast("long").alias("chapters"))


@query("split_custom", "SELECT conv_id, count(*)::BIGINT AS chapters FROM conversations GROUP BY conv_id")
def split_custom(s, d):
    df = CH.split_chapters(C.chaptered(s, d), pattern="custom", custom="^(第[0-9]+章)[ ]*([^\\n]*)", clean=None)
    return df.select("conv_id", F.size("chapters").cast("long").alias("chapters"))


@query("fit_chapters", "SELECT doc_id, md5(text) AS whole, strlen(text)::BIGINT AS bytes FROM documents")
def fit_chapters(s, d):
    """Parts of at most 1000 bytes; put together again they must be the text."""
    rows = C.table(s, d, "documents").select("doc_id", F.lit(0).alias("pos"), F.lit("t").alias("title"), F.col("text").alias("content"))
    parts = CH.fit_chapters(rows, "doc_id", most=1000)
    back = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]), "").alias("t"), F.max(F.octet_length("content")).alias("most"))
    return back.where("most <= 1000").select("doc_id", F.md5("t").alias("whole"), F.octet_length("t").cast("long").alias("bytes"))


@query("paragraphs", f"""SELECT doc_id, count(*)::BIGINT AS n, sum(length(p))::BIGINT AS chars FROM
 (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS p FROM documents) WHERE p <> '' GROUP BY doc_id""")
def paragraphs(s, d):
    return CH.paragraphs(C.table(s, d, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("paragraph")).cast("long").alias("chars"))


@query("process_book")
def process_book(s, d):
    """Bytes to cleaned chapters with words: decoding, segmentation and cleaning of every document."""
    df = C.raw_texts(s, d).select("doc_id", decoded(F.encode("text", "UTF-8")).alias("x")).select("doc_id", "x.encoding", "x.text")
    df = CH.split_chapters(df)
    return df.select("doc_id", "encoding", "rule", F.size("chapters").alias("chapters"), F.aggregate("chapters", F.lit(0).cast("long"), lambda a, c: a + T.count_words(c["content"])).alias("words"))


@query("detect_encoding", "SELECT conv_id, turn, 'gb18030' AS encoding, 0::BIGINT AS replaced, '的一是在不了有和人这中大为上个国我以要他' || conv_id AS text FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, 'utf-8', 0, '春天来了，他们在这里生活' || conv_id FROM conversations WHERE turn % 2 = 1")
def detect_encoding(s, d):
    gb = F.concat(F.lit("的一是在不了有和人这中大为上个国我以要他".encode("gb18030")), F.encode(F.col("conv_id").cast("string"), "UTF-8"))
    raw = F.when(F.col("turn") % 2 == 0, gb).otherwise(F.encode(F.concat(F.lit("春天来了，他们在这里生活"), F.col("conv_id").cast("string")), "UTF-8"))
    return C.table(s, d, "conversations").select("conv_id", "turn", decoded(raw).alias("r")).select("conv_id", "turn", "r.encoding", "r.replaced", "r.text")


@query("detect_encoding_texts", "SELECT conv_id, turn, 'gb18030' AS encoding, 0::BIGINT AS replaced, '的一是在不了有和人这中大为上个国我以要他' || coalesce(text, '') AS text FROM conversations")
def detect_encoding_texts(s, d):
    """The whole text of each turn, behind frequent characters, as GB 18030."""
    raw = F.udf(lambda x: ("的一是在不了有和人这中大为上个国我以要他" + (x or "")).encode("gb18030"), "binary", useArrow=True)
    return C.table(s, d, "conversations").select("conv_id", "turn", decoded(raw("text")).alias("r")).select("conv_id", "turn", "r.encoding", "r.replaced", "r.text")


# ---- cleaning

_ZW = r"[\x{feff}\x{200b}-\x{200d}\x{2060}\x{200e}\x{200f}]"
_SQL = {
    "newlines": lambda x: f"regexp_replace({x}, '\\r\\n?', chr(10), 'g')",
    "zero_width": lambda x: f"regexp_replace({x}, '{_ZW}', '', 'g')",
    "ref_marks": lambda x: f"regexp_replace({x}, '[\\[【〔][{_WS}]*[0-9]+[{_WS}]*[\\]】〕]', '', 'g')",
}
_SQL["garbled"] = lambda x: f"regexp_replace({x}, '[^" + re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", CL.KEPT).replace(r"\x{D7B0}-\x{D7FF}", r"\x{D7B0}-\x{D7FB}") + "]', '', 'g')"


def _markdown_sql(x: str) -> str:
    for pattern, to in CL.MARKDOWN:
        p = pattern.replace(CL.WS, _WS).replace("(?md)", "(?m)").replace("([-*_])\\1{2,}", "(?:-{3,}|\\*{3,}|_{3,})")
        x = f"regexp_replace({x}, '{p}', '{to.replace('$', chr(92))}', 'g')"
    return x


_SQL["markdown"] = _markdown_sql
_LINES = f"regexp_replace(regexp_replace(l, '[\\t \\x{{3000}}]+', ' ', 'g'), '^[{_WS}]+|[{_WS}]+$', '', 'g')"


#: The advertisements of a line alone, as the SQL tests them.
_URL_ONLY = f"(?i)^(?:[{_WS}]*[【\\[（(《<]?[^】\\]）)》<>{_WS}]{{0,12}}[】\\]）)》>]?[{_WS}]*)?(?:https?://|www\\.)[^{_WS}]+$"
_URL_LEAD = f"(?i)^(?:https?://|www\\.)[^{_WS}]+(?:[{_WS}]+([^{_WS}].*))?$"
_TAIL_STOP = "[，。！？、；：\"''（）【】]"
_BRACKET = "^[【\\[（(][^】\\]）)]{0,30}(?:笔趣阁|顶点|追书|搜读|小说阅读网|首发|无弹窗|阅读网址|欢迎访问|手机|请收藏|加入书签|收藏本站|下载txt|推荐票|月票|本书)[^】\\]）)]{0,30}[】\\]）)]?$"
_BARE = "^(?:本书(?:来自|由)|首发于|首发在|收藏本站|请收藏本站|下载txt)"
_END = f"^={{3,}}[{_WS}]*(?:完|全文完|全书完)"


def _ads_sql(l: str) -> str:
    tail = f"regexp_extract({l}, '{_URL_LEAD}', 1)"
    return (f"({l} <> '' AND ((length({l}) <= 100 AND (regexp_matches({l}, '{_URL_ONLY}') OR (regexp_matches({l}, '{_URL_LEAD}') AND length({tail}) <= 8 AND NOT regexp_matches({tail}, '{_TAIL_STOP}'))))"
            f" OR (length({l}) <= 40 AND (regexp_matches({l}, '{_BRACKET}') OR regexp_matches({l}, '{_BARE}'))) OR regexp_matches({l}, '{_END}')))")


def _digest(c) -> list:
    return ["doc_id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("chars")]


def _sql_digest(body: str, ctes: str = C.RAW) -> str:
    return f"WITH {ctes} SELECT doc_id, md5(t) AS digest, length(t)::BIGINT AS chars FROM (SELECT doc_id, {body} AS t FROM raw)"


for _name, _f in (("newlines", CL.newlines), ("zero_width", CL.zero_width), ("ref_marks", CL.ref_marks), ("markdown", CL.markdown), ("garbled", CL.garbled), ("quotes", CL.unify_quotes)):
    _sql = _sql_digest(_SQL[_name]("text")) if _name in _SQL else _sql_digest("regexp_replace(text, '[「『]([^」』]*)[」』]', '“\\1”', 'g')")
    query(f"clean_{_name}", _sql)(lambda s, d, f=_f: C.raw_texts(s, d).select(*_digest(f(F.col("text")))))

_JOINED = "list_transform(string_split({t}, chr(10)), lambda l: {lines})"


@query("clean_lines", _sql_digest("array_to_string(" + _JOINED.format(t="text", lines=_LINES) + ", chr(10))"))
def clean_lines(s, d):
    return C.raw_texts(s, d).select(*_digest(CL.lines(F.col("text"))))


@query("clean_site", _sql_digest("array_to_string(list_filter(" + _JOINED.format(t="text", lines=_LINES) + f", lambda k: NOT {_ads_sql('k')}), chr(10))"))
def clean_site(s, d):
    return C.raw_texts(s, d).select(*_digest(CL.drop_ads(CL.lines(F.col("text")))))


@query("clean_blank", _sql_digest("regexp_replace(array_to_string(" + _JOINED.format(t="text", lines=_LINES) + ", chr(10)), '\\n{3,}', chr(10) || chr(10), 'g')"))
def clean_blank(s, d):
    return C.raw_texts(s, d).select(*_digest(CL.squeeze_blank(CL.lines(F.col("text")))))


@query("clean_indent", _sql_digest("array_to_string(list_transform(" + _JOINED.format(t="text", lines=_LINES) + ", lambda k: CASE WHEN k <> '' THEN '　　' || k ELSE k END), chr(10))"))
def clean_indent(s, d):
    return C.raw_texts(s, d).select(*_digest(CL.indent(CL.lines(F.col("text")))))


_ALL = "text"
for _n in ("newlines", "zero_width", "ref_marks", "markdown", "garbled"):
    _ALL = _SQL[_n](_ALL)


#: A text cleaned with the defaults, as SQL over a column ``text``.
CLEANED = "array_to_string(list_filter(" + _JOINED.format(t=_ALL, lines=_LINES) + f", lambda k: k <> '' AND NOT {_ads_sql('k')}), chr(10))"


@query("clean_all", _sql_digest(CLEANED))
def clean_all(s, d):
    return C.raw_texts(s, d).select(*_digest(CL.clean_text(F.col("text"))))


#: Line feeds within a paragraph go; twice, as a match takes the character at each side.
_SOFT = "array_to_string(list_filter(" + _JOINED.format(t=_ALL, lines=_LINES) + f", lambda k: NOT {_ads_sql('k')}), chr(10))"
for _p, _to in (("([A-Za-z0-9])\\n([A-Za-z0-9])", "\\1 \\2"), ("([^。！？!?…：；;:\"''「『（(《—\\n])\\n([^\\n])", "\\1\\2")):
    for _ in range(2):
        _SOFT = f"regexp_replace({_SOFT}, '{_p}', '{_to}', 'g')"


@query("clean_join_soft", _sql_digest(f"trim(regexp_replace({_SOFT}, '\\n\\n+', chr(10), 'g'), chr(10))"))
def clean_join_soft(s, d):
    return C.raw_texts(s, d).select(*_digest(CL.clean_text(F.col("text"), CL.CleanOptions(join_soft=True))))


# ---- scalars

@query("word_counts", f"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[{_WS}]+', '', 'g'))::BIGINT AS words FROM documents")
def word_counts(s, d):
    return spread(C.table(s, d, "documents")).select("doc_id", T.count_words(F.col("text")).alias("words"))


@query("norm_title_dups", """WITH n AS (SELECT p_partkey AS id, replace(p_name || p_brand, ' ', '') AS k FROM part) SELECT id FROM n WHERE k IN (SELECT k FROM n GROUP BY k HAVING count(*) > 1)""")
def norm_title_dups(s, d):
    b = C.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"))
    return ED.duplicate_titles(b, T.norm_title(F.col("title"))).select("id")


@query("safe_str", f"""SELECT doc_id, regexp_replace(left(regexp_replace(text, '[\\x00-\\x1F<>"''\\\\/]', '', 'g'), 200), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS safe FROM documents""")
def safe_str(s, d):
    return C.table(s, d, "documents").select("doc_id", T.safe_str(F.col("text")).alias("safe"))


@query("fmt_words", """SELECT doc_id, CASE WHEN n = 0 THEN '0 字' WHEN n >= 100000 THEN floor(n / 10000.0 + 0.5)::BIGINT || ' 万字' WHEN n >= 10000 THEN format('{:.1f}', floor(n / 10000.0 * 10 + 0.5) / 10) || ' 万字' ELSE n || ' 字' END AS label
 FROM (SELECT doc_id, n_chars * (doc_id % 60) AS n FROM documents)""")
def fmt_words(s, d):
    return C.table(s, d, "documents").select("doc_id", T.fmt_words(F.col("n_chars") * (F.col("doc_id") % 60)).alias("label"))


@query("fmt_bytes", """SELECT doc_id, CASE WHEN n >= 1048576 THEN format('{:.1f}', floor(n / 1048576.0 * 10 + 0.5) / 10) || ' MB' WHEN n >= 1024 THEN floor(n / 1024.0 + 0.5)::BIGINT || ' KB' ELSE n || ' B' END AS label
 FROM (SELECT doc_id, n_chars * (doc_id % 600) AS n FROM documents)""")
def fmt_bytes(s, d):
    return C.table(s, d, "documents").select("doc_id", T.fmt_bytes(F.col("n_chars") * (F.col("doc_id") % 600)).alias("label"))


@query("shorten", "SELECT doc_id, CASE WHEN length(text) > 64 THEN left(text, 30) || '…' || right(text, 26) ELSE text END AS short FROM documents")
def shorten(s, d):
    return C.table(s, d, "documents").select("doc_id", T.shorten(F.col("text")).alias("short"))


@query("tag_parse", "SELECT p_partkey AS id, list_filter(list_transform(regexp_split_to_array(replace(p_type, ' ', ' ， ,'), '[,，]'), lambda x: trim(x)), lambda x: x <> '') AS tags FROM part")
def tag_parse(s, d):
    raw = F.regexp_replace("p_type", " ", " ， ,")
    return C.table(s, d, "part").select(F.col("p_partkey").alias("id"), T.parse_tags(raw).alias("tags"))


@query("title_signature", """SELECT p_partkey AS id, '2:' || lower(printf('%x', list_reduce([5381::UBIGINT] || list_transform(string_split(p_name || chr(10) || p_brand || chr(10), ''), lambda c: unicode(c)::UBIGINT), lambda h, x: xor(h * 33, x) & 4294967295))) AS sig FROM part""")
def title_signature(s, d):
    return C.table(s, d, "part").select(F.col("p_partkey").alias("id"), T.titles_signature(F.array("p_name", "p_brand")).alias("sig"))


@query("color_bucket", "SELECT p_partkey AS id, (list_reduce([0::UBIGINT] || list_transform(string_split(p_name, ''), lambda c: unicode(c)::UBIGINT), lambda h, x: (h * 31 + x) & 4294967295) % 8)::BIGINT AS bucket FROM part")
def color_bucket(s, d):
    return C.table(s, d, "part").select(F.col("p_partkey").alias("id"), T.color_bucket(F.col("p_name")).alias("bucket"))


@query("ip_hash", "SELECT c_custkey AS id, left(sha256('brute:' || c_name), 20) AS h FROM customer")
def ip_hash(s, d):
    return C.table(s, d, "customer").select(F.col("c_custkey").alias("id"), T.ip_hash(F.col("c_name")).alias("h"))


@query("file_token", "SELECT doc_id, left(sha256(text), 16) AS token FROM documents")
def file_token(s, d):
    return C.table(s, d, "documents").select("doc_id", T.file_token(F.col("text")).alias("token"))


@query("esc_xml", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS digest FROM pages")
def esc_xml(s, d):
    return C.table(s, d, "pages").select("page_id", F.md5(T.esc_xml(F.col("html"))).alias("digest"))


@query("title_of_file", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '未命名_' || page_id ELSE 'b ' || page_id END AS title FROM pages")
def title_of_file(s, d):
    name = F.when(F.col("page_id") % 5 == 0, F.lit(" .TXT")).otherwise(F.concat(F.lit(" b "), F.col("page_id").cast("string"), F.lit(".text")))
    return C.table(s, d, "pages").select("page_id", T.title_of_file(name, F.col("page_id")).alias("title"))


_COMMON = "的一是在不了有和人这中大为上个国我以要他"


@query("readability", f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '的一是㐀人豈他{chr(0xFFFD)}龥' || left(text, 20) ELSE text END AS x FROM documents)
 SELECT doc_id, round(length(regexp_replace(x, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) / length(x)::DOUBLE * 100 + 0.5 * length(regexp_replace(x, '[^{_COMMON}]', '', 'g')) - 60 * length(regexp_replace(x, '[^\\x{{FFFD}}]', '', 'g'))
 - 10 * length(regexp_replace(x, '[^\\x{{3400}}-\\x{{4DBF}}\\x{{F900}}-\\x{{FAFF}}]', '', 'g')), 6) AS score FROM t""")
def readability(s, d):
    x = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("的一是㐀人豈他\ufffd龥"), F.left("text", F.lit(20)))).otherwise(F.col("text"))
    return C.table(s, d, "documents").select("doc_id", F.round(T.readability(x, _COMMON), 6).alias("score"))


@query("readability_whole", f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '的一是㐀人\uf900他{chr(0xFFFD)}龥' ELSE '' END || text AS x FROM documents)
 SELECT doc_id, CASE WHEN length(x) > 0 THEN round(length(regexp_replace(x, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g')) / length(x)::DOUBLE * 100 + 0.5 * length(regexp_replace(x, '[^{_COMMON}]', '', 'g')) - 60 * length(regexp_replace(x, '[^\\x{{FFFD}}]', '', 'g'))
 - 10 * length(regexp_replace(x, '[^\\x{{3400}}-\\x{{4DBF}}\\x{{F900}}-\\x{{FAFF}}]', '', 'g')), 6) ELSE 0 END AS score FROM t""")
def readability_whole(s, d):
    """As readability, but every text is scored whole, behind the characters of each class where doc_id is even."""
    x = F.concat(F.when(F.col("doc_id") % 2 == 0, "的一是㐀人\uf900他\ufffd龥").otherwise(""), "text")
    return C.table(s, d, "documents").select("doc_id", F.round(T.readability(x, _COMMON), 6).alias("score"))


@query("object_keys", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'raw' ELSE 'meta' END AS prefix, 'b' || o_custkey AS book_id, CASE WHEN o_orderkey % 3 = 0 THEN 'v/' || o_orderkey ELSE '' END AS chapter_key, o_orderkey % 3 <> 2 AS deletable FROM orders""")
def object_keys(s, d):
    o, k = C.table(s, d, "orders"), F.col("o_orderkey")
    book = F.concat(F.lit("b"), F.col("o_custkey").cast("string"))
    key = F.when(k % 3 == 0, F.concat(F.lit("text/"), book, F.lit("/v/"), k.cast("string"), F.lit(".txt"))).when(k % 3 == 1, F.concat(F.lit("raw/"), book, F.lit(".txt"))).otherwise(F.concat(F.lit("meta/"), book, F.lit(".json")))
    return o.select(k.alias("id"), *T.object_parts(key), T.deletable(key).alias("deletable"))


# ---- shelf

def _b(sql: str) -> str:
    return f"WITH {C.BOOKS} {sql}"


@query("shelf_entries", _b("SELECT id, title, author, tags, pinned, finished, star, read_done, chapter_count, word_count, created_at, updated_at, recent, state, prog_ch, prog_ratio, prog_at FROM sh"))
def shelf_entries(s, d):
    return _shelf(s, d)


@query("shelf_search", _b("SELECT id FROM sh WHERE contains(lower(title || chr(1) || author || chr(1) || array_to_string(tags, chr(1))), 'brand') AND contains(lower(title || chr(1) || author || chr(1) || array_to_string(tags, chr(1))), 'st')"))
def shelf_search(s, d):
    return SH.search(_shelf(s, d), "BRAND  st").select("id")


@query("shelf_facets", _b("SELECT id FROM sh WHERE list_contains(tags, author) AND finished AND state = 'unread' AND star"))
def shelf_facets(s, d):
    return SH.facets(_shelf(s, d).where(F.array_contains("tags", F.col("author"))), finished=True, state="unread", star=True).select("id")


for _key, _col in (("recent", "recent DESC"), ("updated", "updated_at DESC"), ("created", "created_at DESC"), ("words", "word_count DESC"), ("title", "title")):
    query(f"shelf_sort_{_key}", _b(f"SELECT row_number() OVER (ORDER BY pinned DESC, {_col}, id) AS rank, id FROM sh QUALIFY rank <= 60"))(
        lambda s, d, k=_key: SH.top(_shelf(s, d), k, 60, "id"))


@query("continue_reading", _b("SELECT row_number() OVER (ORDER BY prog_at DESC, id) AS rank, id, prog_at FROM sh WHERE prog_at > 0 AND state <> 'done' QUALIFY rank <= 3"))
def continue_reading(s, d):
    return SH.continue_reading(_shelf(s, d))


@query("tag_counts", _b("SELECT tag, count(*)::BIGINT AS n FROM (SELECT unnest(tags) AS tag FROM sh) GROUP BY tag"))
def tag_counts(s, d):
    return SH.tag_counts(_shelf(s, d))


@query("tag_top", _b("SELECT tag, count(*)::BIGINT AS n, row_number() OVER (ORDER BY count(*) DESC, tag) AS rank FROM (SELECT unnest(tags) AS tag FROM sh) GROUP BY tag QUALIFY rank <= 12"))
def tag_top(s, d):
    return SH.top_tags(_shelf(s, d), 12)


@query("read_counts", _b("SELECT count(*) FILTER (state = 'unread') AS unread, count(*) FILTER (state = 'reading') AS reading, count(*) FILTER (state = 'done') AS done, count(*) FILTER (star) AS star FROM sh"))
def read_counts(s, d):
    return SH.state_counts(_shelf(s, d))


@query("shelf_totals", _b("SELECT count(*)::BIGINT AS books, sum(word_count)::BIGINT AS words FROM sh"))
def shelf_totals(s, d):
    return SH.totals(_shelf(s, d))


@query("feed_page", _b("SELECT row_number() OVER (ORDER BY at DESC, id) AS rank, id, at, newest, true AS has_previous, n > 200 AS has_next FROM (SELECT id, CASE WHEN updated_at > 0 THEN updated_at ELSE created_at END AS at, max(at) OVER () AS newest, count(*) OVER () AS n FROM sh) QUALIFY rank BETWEEN 101 AND 200"))
def feed_page(s, d):
    return SH.feed_page(_shelf(s, d), 2)


_NOW = 2000 * C.DAY


@query("trash_view", _b(f"SELECT id, title, created_at + {1980 * C.DAY} AS deleted_at, greatest(0, 15 - ({_NOW} - deleted_at) // {C.DAY})::BIGINT AS days_left, {_NOW} - deleted_at > {15 * C.DAY} AS expired FROM sh WHERE id <= 20"))
def trash_view(s, d):
    return SH.trash_view(_shelf(s, d).where("id <= 20").withColumn("deleted_at", F.col("created_at") + 1980 * C.DAY), _NOW)


@query("trash_view_all", _b(f"SELECT id, title, created_at + {1980 * C.DAY} AS deleted_at, greatest(0, 15 - ({_NOW} - deleted_at) // {C.DAY})::BIGINT AS days_left, {_NOW} - deleted_at > {15 * C.DAY} AS expired FROM (SELECT * REPLACE (id % 40 * {C.DAY} AS created_at) FROM sh)"))
def trash_view_all(s, d):
    """As trash_view, with all books in the trash."""
    return SH.trash_view(_shelf(s, d).withColumn("deleted_at", (F.col("id") % 40 + 1980) * C.DAY), _NOW)


# ---- edits

@query("batch_add_tags", _b("SELECT id, list_filter(tags || ['new', tags[1]], lambda t, i: list_position(tags || ['new', tags[1]], t) = i)[1:10] AS tags FROM sh"))
def batch_add_tags(s, d):
    return _shelf(s, d).select("id", ED.add_tags(F.array_union("tags", F.array()), ["new"]).alias("tags"))


@query("batch_remove_tags", _b("SELECT id, list_filter(tags, lambda t: t NOT IN ('STANDARD', 'PROMO', 'BRASS')) AS tags FROM sh"))
def batch_remove_tags(s, d):
    return _shelf(s, d).select("id", ED.remove_tags(F.col("tags"), ["STANDARD", "PROMO", "BRASS"]).alias("tags"))


@query("tag_merge", _b("SELECT id, list_filter(x, lambda t, i: list_position(x, t) = i)[1:10] AS tags FROM (SELECT id, list_transform(tags, lambda t: CASE WHEN t = 'PROMO' THEN 'STANDARD' ELSE t END) AS x FROM sh)"))
def tag_merge(s, d):
    return _shelf(s, d).select("id", ED.merge_tag(F.col("tags"), "PROMO", "STANDARD").alias("tags"))


def _ch(sql: str) -> str:
    return f"WITH {C.CHAPTERS} {sql}"


@query("append_keys", _ch("SELECT book_id, n + i AS pos, (n + i + 1)::VARCHAR AS key FROM (SELECT book_id, count(*) AS n FROM ch GROUP BY 1), range(3) r(i)"))
def append_keys(s, d):
    ch = C.chapters(s, d)
    new = ch.select("book_id").distinct().select("book_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    return ED.append_chapters(ch, new)


@query("insert_shift", _ch("SELECT book_id, pos + 1 AS ch, CASE WHEN pos >= 5 THEN pos + 2 ELSE pos + 1 END AS moved FROM ch"))
def insert_shift(s, d):
    return C.chapters(s, d).select("book_id", (F.col("pos") + 1).alias("ch"), ED.shift_for_insert(F.col("pos") + 1, F.lit(5)).alias("moved"))


@query("delete_shift", _ch("SELECT book_id, pos + 1 AS ch, least(CASE WHEN pos > 5 THEN pos ELSE pos + 1 END, n - 1) AS moved FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM ch)"))
def delete_shift(s, d):
    ch = C.chapters(s, d)
    n = ch.groupBy("book_id").agg(F.count("*").alias("n"))
    return ch.join(n, "book_id").select("book_id", (F.col("pos") + 1).alias("ch"), ED.shift_for_delete(F.col("pos") + 1, F.lit(5), F.col("n") - 1).alias("moved"))


@query("replace_migrate", f"""WITH {C.CHAPTERS}, {C.EVENTS}, pr AS (SELECT book_id, ch, ratio FROM ev QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY at DESC, seq DESC) = 1),
 nw AS (SELECT book_id, title, min(pos) + 1 AS t FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pos DESC) - 1 AS p2 FROM ch) x(book_id, opos, key, title, words, pos) WHERE opos % 3 <> 0 GROUP BY ALL)
 SELECT pr.book_id, CASE WHEN ch.title IS NOT NULL AND t IS NULL THEN 1 ELSE coalesce(t, pr.ch) END AS ch, CASE WHEN ch.title IS NOT NULL AND t IS NULL THEN 0.0 ELSE ratio END AS ratio
 FROM pr LEFT JOIN ch ON ch.book_id = pr.book_id AND ch.pos + 1 = pr.ch LEFT JOIN nw ON nw.book_id = pr.book_id AND nw.title = ch.title""")
def replace_migrate(s, d):
    ch = C.chapters(s, d)
    n = ch.groupBy("book_id").agg(F.count("*").alias("n"))
    new = ch.join(n, "book_id").select("book_id", "title", (F.col("n") - 1 - F.col("pos")).alias("new"), "pos").where("pos % 3 <> 0").select("book_id", "title", F.col("new").alias("pos"))
    return ED.migrate_progress(PR.latest(C.events(s, d)).select("book_id", "ch", "ratio"), ch, new)


@query("patch_merge", _b("SELECT id, 'T' || id AS title, author, CASE WHEN id % 2 = 0 THEN true ELSE star END AS star, CASE id % 3 WHEN 0 THEN false WHEN 1 THEN NULL ELSE read_done END AS read_done, 5::BIGINT AS updated_at FROM sh WHERE id % 4 < 2"))
def patch_merge(s, d):
    b, k = C.books(s, d), F.col("id")
    p = b.where("id % 4 < 2").select("id", F.concat(F.lit("T"), k.cast("string")).alias("title"), F.lit(None).cast("string").alias("author"), F.when(k % 2 == 0, True).alias("star"), F.when(k % 3 == 0, "set").when(k % 3 == 1, "clear").otherwise("keep").alias("read_done_op"), F.lit(False).alias("read_done"))
    return ED.patch_books(b, p, 5)


@query("publish_check", _ch("SELECT DISTINCT book_id FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM ch) WHERE pos IN (0, n // 2, n - 1) AND words % 5 = 0"))
def publish_check(s, d):
    ch = C.chapters(s, d)
    return ED.incomplete(ch, ch.where("words % 5 <> 0").select("book_id", "key"))


@query("rollback", _ch("SELECT book_id, count(*)::BIGINT AS n FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS c FROM ch) WHERE pos < c - 2 GROUP BY book_id"))
def rollback(s, d):
    return ED.drop_last(C.chapters(s, d), F.lit(2)).groupBy("book_id").agg(F.count("*").alias("n"))


@query("soft_delete_restore", _b("SELECT id, CASE WHEN id % 4 = 0 THEN 'shelf' WHEN id % 2 = 0 THEN 'trash' ELSE 'shelf' END AS place FROM sh"))
def soft_delete_restore(s, d):
    """Every second book goes to the trash, every fourth comes back."""
    b = C.books(s, d).select("id")
    trash = b.where("id % 2 = 0")
    shelf = b.join(trash, "id", "left_anti")
    back = trash.where("id % 4 = 0")
    trash = trash.join(back, "id", "left_anti")
    return shelf.unionByName(back).withColumn("place", F.lit("shelf")).unionByName(trash.withColumn("place", F.lit("trash")))


@query("batch_trim", _b("""SELECT rank, id, cost, cost > 48 AS deferred FROM (SELECT *, 1 + 3 * k + 4 * rank + 2 + 3 * k AS cost FROM (SELECT *, sum(f) OVER (ORDER BY rank)::BIGINT AS k FROM
 (SELECT *, CASE WHEN row_number() OVER (PARTITION BY id % 5 ORDER BY rank) = 1 THEN 1 ELSE 0 END AS f FROM (SELECT row_number() OVER (ORDER BY id) AS rank, id FROM sh WHERE id <= 18))))"""))
def batch_trim(s, d):
    w = SH.Window.orderBy("id")
    t = C.books(s, d).where("id <= 18").select("id").withColumn("rank", F.row_number().over(w).cast("long")).withColumn("shard", F.col("id") % 5)
    return ED.batch_trim(t, most=20)


@query("merge_trim", _b("""SELECT rank, id, cost FROM (SELECT rank, id, 1 + 5 + 4 * rank + 2 * sum(f) OVER (ORDER BY rank)::BIGINT AS cost FROM
 (SELECT *, CASE WHEN row_number() OVER (PARTITION BY id % 5 ORDER BY rank) = 1 THEN 1 ELSE 0 END AS f FROM (SELECT row_number() OVER (ORDER BY id) AS rank, id FROM sh WHERE list_contains(tags, 'PROMO')))) WHERE cost <= 48"""))
def merge_trim(s, d):
    t = C.books(s, d).where("array_contains(tags, 'PROMO')").select("id")
    return ED.merge_trim(t.withColumn("rank", F.row_number().over(SH.Window.orderBy("id")).cast("long")).withColumn("shard", F.col("id") % 5), 5)


@query("copy_titles", """WITH b AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS title, replace(p_name || p_brand, ' ', '') AS k FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) - CASE WHEN k IN (SELECT k FROM b WHERE id % 2 = 0) THEN 0 ELSE 1 END AS r FROM b WHERE id % 3 = 0)
SELECT id, CASE WHEN r = 0 THEN title WHEN r = 1 THEN title || '（副本）' WHEN r <= 50 THEN title || '（副本' || r || '）' END AS title FROM n""")
def copy_titles(s, d):
    b = C.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"))
    return ED.copy_titles(b.where("id % 3 = 0"), b.where("id % 2 = 0"))


# ---- integrity

@query("residue", "SELECT o_custkey AS book_id, count(*)::BIGINT AS objects, sum(o_orderkey % 1000)::BIGINT AS bytes FROM orders WHERE o_custkey % 7 = 0 GROUP BY 1")
def residue(s, d):
    obj = C.table(s, d, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 1000).alias("size"))
    live = C.table(s, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("book_id"))
    return IN.orphan_rollup(IN.residue(obj, live))


@query("chapter_orphans", _ch("SELECT book_id, key, words % 2 = 0 AS known FROM ch WHERE words % 4 = 0 OR words % 4 = 1"))
def chapter_orphans(s, d):
    ch = C.chapters(s, d)
    return IN.chapter_orphans(ch, ch.where("words % 4 > 1"), ch.where("words % 2 = 0"))


_MAPS = "ct AS (SELECT p_partkey AS id, p_partkey % 7 AS shard FROM part WHERE p_partkey % 5 <> 0 UNION ALL SELECT p_partkey, p_partkey % 3 FROM part WHERE p_partkey % 5 = 1), rt AS (SELECT p_partkey AS id, p_partkey % 7 AS shard FROM part WHERE p_partkey % 4 <> 0)"


@query("reconcile_map", f"WITH {_MAPS}, h AS (SELECT id, min(shard) AS held FROM ct GROUP BY 1) SELECT coalesce(h.id, rt.id) AS id, held AS shard, CASE WHEN held IS NULL THEN 'dead' WHEN rt.shard IS NULL THEN 'added' WHEN held <> rt.shard THEN 'moved' ELSE 'kept' END AS change FROM h FULL JOIN rt ON rt.id = h.id")
def reconcile_map(s, d):
    p = C.table(s, d, "part").select(F.col("p_partkey").alias("id"))
    ct = p.where("id % 5 <> 0").select("id", (F.col("id") % 7).alias("shard")).union(p.where("id % 5 = 1").select("id", F.col("id") % 3))
    return IN.reconcile(ct, p.where("id % 4 <> 0").select("id", (F.col("id") % 7).alias("shard")))


@query("shard_assign", "SELECT p_partkey AS id, (row_number() OVER (ORDER BY p_partkey) - 1) // 500 AS shard FROM part")
def shard_assign(s, d):
    return IN.shard_of_rows(C.table(s, d, "part").select(F.col("p_partkey").alias("id")))


@query("purge_guard", _ch("SELECT book_id, key, CASE WHEN words % 2 = 0 THEN 'text' ELSE 'raw' END AS prefix FROM ch WHERE CASE WHEN words % 2 = 0 THEN words % 3 = 0 ELSE book_id % 2 = 0 END"))
def purge_guard(s, d):
    ch = C.chapters(s, d)
    asked = ch.select("book_id", "key", F.when(F.col("words") % 2 == 0, "text").otherwise("raw").alias("prefix"))
    return IN.purgeable(asked, ch.where("words % 3 <> 0"), ch.where("book_id % 2 <> 0"))


@query("list_page", "SELECT 'text/' || o_orderkey AS key FROM orders WHERE key > 'text/3' ORDER BY key LIMIT 1000")
def list_page(s, d):
    keys = C.table(s, d, "orders").select(F.concat(F.lit("text/"), F.col("o_orderkey").cast("string")).alias("key"))
    return IN.list_page(keys, "text/", "text/3")


# ---- progress and limiter

def _e(sql: str) -> str:
    return f"WITH {C.EVENTS} {sql}"


@query("progress_latest", _e("SELECT book_id, ch, ratio, at FROM ev QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY at DESC, seq DESC) = 1"))
def progress_latest(s, d):
    return PR.latest(C.events(s, d))


@query("progress_stale", _e("SELECT book_id, seq, coalesce(max(at) OVER (PARTITION BY book_id ORDER BY (seq * 7919) % 10007, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= at, true) AS ok FROM ev"))
def progress_stale(s, d):
    e = C.events(s, d).withColumn("id", F.col("seq")).withColumn("seq", F.col("seq") * 7919 % 10007 * 1_000_000_000 + F.col("seq"))
    return PR.accepted(e).select("book_id", F.col("id").alias("seq"), "ok")


@query("mirror_changes", f"""WITH {C.EVENTS}, c AS (SELECT l_partkey AS book_id, count(*) AS cap FROM lineitem GROUP BY 1),
 m AS (SELECT ev.*, least(ch, cap) AS mch, least(ch, cap) >= cap AND ratio >= 0.9 AS done FROM ev JOIN c USING (book_id)),
 l AS (SELECT *, lag(mch) OVER w AS pm, lag(done) OVER w AS pd FROM m WINDOW w AS (PARTITION BY book_id ORDER BY at, seq))
 SELECT book_id, at, seq, mch AS ch, done FROM l WHERE pm IS NULL OR pm <> mch OR pd <> done""")
def mirror_changes(s, d):
    n = C.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("book_id")).agg(F.count("*").alias("n"))
    return PR.mirror_changes(C.events(s, d), n)


@query("resume_position", _e(f""", sv AS (SELECT * FROM ev WHERE seq % 2 = 1 QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY at DESC, seq DESC) = 1),
 lo AS (SELECT book_id, CASE WHEN book_id % 7 = 3 THEN 0 ELSE ch END AS ch, ratio, CASE WHEN book_id % 5 = 0 THEN (SELECT at FROM sv WHERE sv.book_id = x.book_id) WHEN book_id % 11 = 1 THEN 0 ELSE at END AS at FROM (SELECT * FROM ev WHERE seq % 2 = 0 QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY at DESC, seq DESC) = 1) x),
 bs AS (SELECT user_id AS book_id, count(*) * 3 AS n FROM events GROUP BY 1),
 w AS (SELECT bs.book_id, n, lo.ch AS lc, lo.ratio AS lr, coalesce(lo.at, 0) AS la, sv.ch AS sc, sv.ratio AS sr, coalesce(sv.at, 0) AS sa FROM bs LEFT JOIN lo ON lo.book_id = bs.book_id LEFT JOIN sv ON sv.book_id = bs.book_id WHERE lo.book_id IS NOT NULL OR sv.book_id IS NOT NULL)
 SELECT book_id, greatest(0, least(n - 1, CASE WHEN c = 0 THEN 1 ELSE c END - 1))::BIGINT AS cur, coalesce(r, 0) AS ratio FROM (SELECT book_id, n,
 CASE WHEN sa > la AND sa <> 0 AND sc IS NOT NULL THEN sc WHEN la <> 0 AND lc IS NOT NULL THEN lc ELSE 1 END AS c, CASE WHEN sa > la AND sa <> 0 AND sc IS NOT NULL THEN sr WHEN la <> 0 AND lc IS NOT NULL THEN lr ELSE 0 END AS r FROM w)"""))
def resume_position(s, d):
    """Odd events are the server's; some places of the device have the server's time, some no time, some chapter 0."""
    e, k = C.events(s, d), F.col("book_id")
    side = lambda i: PR.latest(e.where(F.col("seq") % 2 == i)).select("book_id", "ch", "ratio", "at")
    server = side(1)
    local = side(0).join(server.select("book_id", F.col("at").alias("same")), "book_id", "left")
    local = local.select("book_id", F.when(k % 7 == 3, 0).otherwise(F.col("ch")).alias("ch"), "ratio", F.when(k % 5 == 0, F.col("same")).when(k % 11 == 1, 0).otherwise(F.col("at")).alias("at"))
    return PR.resume_position(local, server, e.groupBy("book_id").agg((F.count("*") * 3).alias("n")))


_LIMIT, _LOCK, _MOST, _WINDOW = 3, 2 * C.DAY, 16 * C.DAY, 5 * C.DAY


@query("limiter", f"""WITH RECURSIVE {C.EVENTS}, a AS (SELECT book_id AS u, at, seq, coalesce(event_type = 'error', false) AS f, row_number() OVER (PARTITION BY book_id ORDER BY at, seq) AS r FROM ev),
 x AS (SELECT u, seq, r, false AS locked, CASE WHEN f AND 1 >= {_LIMIT} THEN at + {_LOCK} ELSE 0 END::BIGINT AS until, CASE WHEN f AND 1 < {_LIMIT} THEN 1 ELSE 0 END AS n, CASE WHEN f AND 1 >= {_LIMIT} THEN 1 ELSE 0 END AS strikes, CASE WHEN f THEN at ELSE 0 END AS last FROM a WHERE r = 1
 UNION ALL SELECT u, seq, r, locked, (CASE WHEN locked THEN was WHEN NOT f THEN 0 WHEN k >= {_LIMIT} THEN at + least({_LOCK} * pow(2, strikes), {_MOST}) ELSE 0 END)::BIGINT, CASE WHEN locked THEN n WHEN NOT f OR k >= {_LIMIT} THEN 0 ELSE k END, CASE WHEN locked THEN strikes WHEN NOT f THEN 0 WHEN k >= {_LIMIT} THEN strikes + 1 ELSE strikes END, CASE WHEN locked THEN last WHEN NOT f THEN 0 ELSE at END
 FROM (SELECT a.u, a.seq, a.r, a.at, f, x.until AS was, x.until > a.at AS locked, n, strikes, last, CASE WHEN x.until > 0 OR a.at - last > {_WINDOW} THEN 1 ELSE n + 1 END AS k FROM x JOIN a ON a.u = x.u AND a.r = x.r + 1))
 SELECT u AS user_id, seq, locked, until FROM x""")
def limiter(s, d):
    """Failures are the events of type 'error', all others successes; window and lock are days, as events are hours apart."""
    a = C.events(s, d).select(F.col("book_id").alias("user_id"), "at", "seq", F.col("event_type").eqNullSafe("error").alias("failed"))
    return PR.limiter(a, limit=_LIMIT, lock=_LOCK, most=_MOST, window=_WINDOW)


# ---- export

def _export_inputs(s, d):
    li = C.chapters(s, d)
    b = C.books(s, d).select(F.col("id").alias("book_id"), "title", "author", "word_count")
    return b, li.select("book_id", "pos", "title", F.when(F.col("words") % 5 != 0, F.concat(F.lit("w"), F.col("words").cast("string"))).alias("text"))


_EXPORT = f"WITH {C.CHAPTERS}, {C.BOOKS}, x AS (SELECT book_id, pos, title, CASE WHEN words % 5 <> 0 THEN 'w' || words END AS text FROM ch)"


@query("export_text", _EXPORT + """ SELECT id AS book_id, md5(any_value(bk.title) || chr(10) || '作者：' || any_value(author) || chr(10) || '共 ' || count(*) || ' 章 · ' || any_value(word_count) || ' 字' || chr(10) || chr(10)
 || string_agg(chr(10) || x.title || chr(10) || chr(10) || coalesce(text, ''), '' ORDER BY pos) || chr(10)) AS digest FROM bk JOIN x ON x.book_id = bk.id GROUP BY id HAVING count(*) <= 40""")
def export_text(s, d):
    return EX.export_text(*_export_inputs(s, d)).select("book_id", F.md5("content").alias("digest"))


@query("export_text_plain", _EXPORT + """ SELECT id AS book_id, md5(any_value(bk.title) || '　作者：' || any_value(author) || chr(10) || chr(10)
 || string_agg(x.title || chr(10) || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY pos)) AS digest, count(*) FILTER (text IS NULL) AS missing FROM bk JOIN x ON x.book_id = bk.id GROUP BY id""")
def export_text_plain(s, d):
    return EX.export_text_plain(*_export_inputs(s, d)).select("book_id", F.md5("content").alias("digest"), "missing")


@query("feed_xml", _b("SELECT row_number() OVER (ORDER BY pinned DESC, recent DESC, id) AS rank, '<entry><title>' || replace(title, '&', '&amp;') || '</title><id>urn:book:' || id || '</id><author><name>' || author || '</name></author></entry>' AS entry FROM sh QUALIFY rank <= 100"))
def feed_xml(s, d):
    return EX.feed_entries(SH.top(_shelf(s, d), "recent", 100, "id", "title", "author"))
