"""Books, chapters, progress and raw texts as the test tables carry them, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

DAY = 86_400_000


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapter tables from the lines of orders: book_id, pos, key, title, words."""
    li = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    from pyspark.sql import Window

    w = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_extendedprice")
    return li.withColumn("pos", F.row_number().over(w) - 1).select(
        F.col("l_partkey").alias("book_id"), F.col("pos").cast("long").alias("pos"), (F.col("pos") + 1).cast("string").alias("key"),
        F.concat(F.lit("C"), (F.col("l_orderkey") % 50).cast("string")).alias("title"), F.col("l_quantity").cast("long").alias("words"))


CHAPTERS = """ch AS MATERIALIZED (SELECT l_partkey AS book_id, r - 1 AS pos, r::VARCHAR AS key, 'C' || (l_orderkey % 50) AS title, l_quantity::BIGINT AS words FROM
 (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice) AS r FROM lineitem))"""


def events(spark: SparkSession, d: str) -> DataFrame:
    """Progress events: book_id, at (ms), seq, ch, ratio."""
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("book_id"), F.expr("unix_millis(cast(ts as timestamp))").alias("at"), F.col("event_id").alias("seq"),
        F.floor("value").cast("long").alias("ch"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("ratio"), "event_type")


EVENTS = """ev AS (SELECT user_id AS book_id, epoch_us(ts) // 1000 AS at, event_id AS seq, floor(value)::BIGINT AS ch, (props->>'$.k')::DOUBLE / 100 AS ratio, event_type FROM events)"""


def books(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("chapter_count"), F.sum(F.col("l_quantity").cast("long")).alias("word_count"))
    e = events(spark, d)
    last = e.groupBy(F.col("book_id").alias("id")).agg(F.max_by(F.struct("ch", "ratio", "at"), F.struct("at", "seq")).alias("x"))
    k = F.col("p_partkey")
    b = p.select(
        k.alias("id"), F.concat_ws(" ", "p_name", "p_brand").alias("title"), F.col("p_brand").alias("author"), F.concat(F.array("p_brand"), F.split("p_type", " ")).alias("tags"),
        (F.col("p_size") % 10 == 0).alias("pinned"), (F.col("p_size") % 2 == 0).alias("finished"), (F.col("p_size") % 7 == 0).alias("star"),
        F.when(k % 11 == 0, True).when(k % 11 == 1, False).alias("read_done"), (k * DAY).alias("created_at"), (k * 7919 % 1000 * DAY).alias("updated_at"))
    return b.join(n, "id", "left").join(last, "id", "left").select("*", F.col("x.ch").alias("prog_ch"), F.col("x.ratio").alias("prog_ratio"), F.col("x.at").alias("prog_at")).drop("x")


BOOKS = EVENTS + f""", lst AS (SELECT book_id AS id, ch AS prog_ch, ratio AS prog_ratio, at AS prog_at FROM ev QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY at DESC, seq DESC) = 1),
cnt AS (SELECT l_partkey AS id, count(*) AS chapter_count, sum(l_quantity::BIGINT)::BIGINT AS word_count FROM lineitem GROUP BY 1),
bk AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS title, p_brand AS author, [p_brand] || string_split(p_type, ' ') AS tags, p_size % 10 = 0 AS pinned, p_size % 2 = 0 AS finished,
 p_size % 7 = 0 AS star, CASE p_partkey % 11 WHEN 0 THEN true WHEN 1 THEN false END AS read_done, p_partkey * {DAY} AS created_at, p_partkey * 7919 % 1000 * {DAY} AS updated_at,
 coalesce(chapter_count, 0) AS chapter_count, coalesce(word_count, 0)::BIGINT AS word_count, prog_ch, prog_ratio, prog_at FROM part LEFT JOIN cnt ON cnt.id = p_partkey LEFT JOIN lst ON lst.id = p_partkey),
sh AS (SELECT *, greatest(coalesce(prog_at, 0), created_at, 0) AS recent, CASE WHEN read_done THEN 'done' WHEN NOT read_done THEN CASE WHEN prog_at > 0 THEN 'reading' ELSE 'unread' END
 WHEN NOT coalesce(prog_at > 0, false) THEN 'unread' WHEN prog_ch <= 0 OR chapter_count <= 0 THEN 'reading' WHEN least(prog_ch, chapter_count) >= chapter_count AND coalesce(prog_ratio, 0) >= 0.9 THEN 'done' ELSE 'reading' END AS state FROM bk)"""

#: What is put before a document's text, by doc_id modulo 4, so that each cleaning rule has something to do.
FRONTS = [
    "https://www.example.com 点击看\r\n【笔趣阁】www.x.com\r\n[12]他说「今天好冷」然后走了【3】。\r\n\r\n\r\n",
    "# Head one\n- item **bold** and `code` [link](http://a.b/c) ~~gone~~ ***all*** __un__\n1. kept\n> cite\n***\n",
    "　　全角​缩进\t tab  \n\n\n本书来自某站\n（欢迎访问 本站）\nsoft line\nand more\n",
    "https://a.bc/d 阅读更多内容请点击这里吧\n文中见 https://a.b/c 的链接。\n=== 全文完\n① ² naïve ☃\n",
]


def raw_texts(spark: SparkSession, d: str) -> DataFrame:
    front = F.element_at(F.array(*map(F.lit, FRONTS)), (F.col("doc_id") % 4 + 1).cast("int"))
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.concat(front, "text").alias("text"))


RAW = "raw AS (SELECT doc_id, [" + ", ".join("'" + f.replace("'", "''") + "'" for f in FRONTS) + "][doc_id % 4 + 1] || text AS text FROM documents)"


def chaptered(spark: SparkSession, d: str) -> DataFrame:
    """A raw text of each conversation, a marker line before each turn."""
    c = table(spark, d, "conversations")
    line = F.concat(F.lit("第"), (F.col("turn") + 1).cast("string"), F.lit("章 "), "role", F.lit("\n"), "text", F.lit("\n"))
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda s: s["x"]), "").alias("text"))
