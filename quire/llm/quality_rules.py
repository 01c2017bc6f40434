"""Quality rules: counts within a document, and cross-document frequency of lines for each host."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import apart, batches, each, merged, release, slices, spread, stored, table, texts, tune

#: A line in more than so many distinct documents of one host is boilerplate there.
MAX_DOCS = 20
#: A document is depleted if its lines that aren't boilerplate hold less than this share of its words.
LEAST_LEFT = 0.5
#: What names a row in the pipeline: its doc_id, 0 for null, and a hash of what it holds.
_KEY = ("__id", "__t")
_SPACE = "[\\x20\\x09-\\x0D]+"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())])
_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
_BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.fromiter((often[w] > 1 for w in windows), bool, len(windows)))
    np.add.at(covered, at, 1)
    np.add.at(covered, at + 5, -1)
    return int((np.cumsum(covered) > 0).sum())


def _counts(b: pa.RecordBatch, more: tuple[str, ...] = ()) -> pa.RecordBatch:
    rows, schema = [], pa.schema([*_SCHEMA, *((k, pa.int64()) for k in more)])
    for text in texts(b):
        raw = text.encode()
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
        rows.append((len(words), len(text) - sum(map(raw.count, b" \t\n\x0b\x0c\r")), sum(map(raw.count, b"#*$%&|<>")), len(lines) - len(set(lines)), repeat_words(words)))
    columns = list(zip(*rows))
    return batches({"doc_id": b.column("doc_id"), **dict(zip(_SCHEMA.names[1:], columns)), **{k: b.column(k) for k in more}}, schema)


def base_counts(docs: DataFrame, *more: str) -> DataFrame:
    """docs(doc_id, text) -> n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row, and the longs named in more. Null counts as empty."""
    tune(docs.sparkSession)
    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(each(lambda b: _counts(b, more)), ", ".join([_BASE, *(f"{k} long" for k in more)]))
    return counts.select("*", F.expr(_FAILED).alias("base_failed"))


def hashed_lines(text: str) -> list[tuple[int, bytes, int]]:
    """(place, hash, number of words) of each line with a word. Normalised: lower case, white space at the ends gone and single spaces within."""
    found = ((i, line.split()) for i, line in enumerate(text.lower().encode().split(b"\n")))
    return [(i, xxhash.xxh3_128_digest(b" ".join(w)), len(w)) for i, w in found if w]


def _numbers(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def _lines(docs: DataFrame, *more: str) -> DataFrame:
    """docs(text, host, longs named in more) -> a row for each line with a word: host, more, pos, l1 and l2 (its hash),
    words, t1 and t2 (hash of the text)."""
    columns = [("host", pa.string()), *((k, pa.int64()) for k in more), ("pos", pa.int64()), ("l1", pa.int64()), ("l2", pa.int64()), ("words", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64())]

    def run(it):
        try:
            for b in it:
                text = texts(b)
                t12 = _numbers([xxhash.xxh3_128_digest(x.encode()) for x in text])
                for i, j in slices(list(map(len, text))):
                    found = [hashed_lines(x) for x in text[i:j]]
                    of = np.repeat(np.arange(i, j), list(map(len, found)))
                    if not len(of):
                        continue
                    pos, digests, words = zip(*(x for f in found for x in f))
                    l12 = _numbers(digests)
                    take = pa.array(of)
                    yield batches({
                        "host": b.column("host").take(take), **{k: b.column(k).take(take) for k in more}, "pos": pos, "l1": l12[:, 0], "l2": l12[:, 1], "words": words,
                        "t1": t12[of, 0], "t2": t12[of, 1]}, pa.schema(columns))
        finally:
            release()

    tune(docs.sparkSession)
    return docs.select("text", "host", *more).mapInArrow(run, ", ".join(f"{k} {'string' if k == 'host' else 'long'}" for k, _ in columns))


def boilerplate(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """docs(doc_id, text, host) -> host, l1, l2, first: lines in more than max_docs distinct documents of a host, and
    the least doc_id among these. Documents with the same text count once, or each large group of copies would seem
    boilerplate. Counting is an aggregation in two steps with partial sums, so neither a hot host nor a hot line
    gathers anywhere."""
    once = _lines(docs, "doc_id").groupBy("host", "l1", "l2", "t1", "t2").agg(F.min("doc_id").alias("first"))
    return once.groupBy("host", "l1", "l2").agg(F.count("*").alias("docs"), F.min("first").alias("first")).where(F.col("docs") > max_docs).select("host", "l1", "l2", "first")


def _documents(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("host"), *more)


class Known:
    """The boilerplate on one host or all, as a table of hashes that tasks look lines up in."""

    def __init__(self, rows: list):
        self.first = {(r.host, np.array([r.l1, r.l2], "<i8").tobytes()): r.first for r in rows}

    def removed(self, doc_id: int | None, text: str, host: str) -> list[tuple[int, int]]:
        """(place, words) of the lines that go. The first document that has a boilerplate line keeps it, so no text
        vanishes from the corpus altogether; a null doc_id is first only where no other document has the line."""
        if not self.first:
            return []
        return [(i, n) for i, h, n in hashed_lines(text) if (host, h) in self.first and self.first[host, h] != doc_id]


def _known(docs: DataFrame, max_docs: int) -> tuple[DataFrame, Known | None]:
    """The boilerplate, and a table of it if it has at most BROADCAST_ROWS lines."""
    found = stored(boilerplate(_documents(docs), max_docs), "boilerplate")
    rows = found.limit(common.BROADCAST_ROWS + 1).collect()
    return found, Known(rows) if len(rows) <= common.BROADCAST_ROWS else None


def _judged(shared, least_left: float):
    schema = pa.schema([*_SCHEMA, ("n_removed_words", pa.int64())])

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        gone = [sum(n for _, n in shared.value.removed(d, t, h)) for d, t, h in zip(b.column("doc_id").to_pylist(), texts(b), b.column("host").to_pylist())]
        return pa.RecordBatch.from_arrays([*_counts(b).columns, pa.array(gone, pa.int64())], schema=schema)

    return run


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, n_removed_words.

    source is the host; a null one is a host of its own. Lines in more than max_docs distinct documents of a host are
    removed from all but the first of them; a document with less than least_left of its words in what remains is
    depleted. kept: neither base_failed nor depleted. Null and empty texts have no words and fail. Repeated rows
    count once for a line's frequency; each row is judged by its own text and source, also where rows share a doc_id.
    Other columns are not read. Boilerplate of at most BROADCAST_ROWS lines is sent to the tasks, which then need no
    exchange; more is joined to the lines.
    """
    known, table_ = _known(docs, max_docs)
    if table_ is not None:
        out = _documents(docs).mapInArrow(each(_judged(docs.sparkSession.sparkContext.broadcast(table_), least_left)), _BASE + ", n_removed_words long")
        out = out.withColumn("base_failed", F.expr(_FAILED))
    else:
        keyed = _keyed(docs)
        lost = _removed(keyed, known).groupBy(*_KEY).agg(F.sum("words").alias("n_removed_words"))
        counts = base_counts(keyed.select("doc_id", "text", *_KEY), *_KEY)
        out = counts.join(lost, list(_KEY), "left").withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    return out.select(*_SCHEMA.names, "base_failed", (~F.col("base_failed") & (left >= least_left * F.col("n_words"))).alias("kept"), "n_removed_words")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spread(table(spark, sf_dir, "documents")))


def _keyed(docs: DataFrame) -> DataFrame:
    """With what names a row: its doc_id, 0 for null, and a hash of what it holds."""
    doc_id = F.col("doc_id").cast("long")
    content = F.xxhash64(doc_id.isNull(), F.col("text").isNull(), "text", F.col("source").isNull(), "source")
    return docs.withColumns({"__id": F.coalesce(doc_id, F.lit(0)), "__t": content})


def _removed(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """The key, pos and words of each line that goes, once for all rows with the same key."""
    docs = _documents(keyed, *_KEY).withColumnRenamed("doc_id", "own")
    found = _lines(docs, "own", *_KEY).join(known, ["host", "l1", "l2"]).where("NOT own <=> first")
    return stored(found.select(*_KEY, "pos", "words").distinct(), "removed")


def _without(shared, at: dict[str, int], least_left: float):
    """Rows that stay, without the lines that go; all other columns as they are."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        doc_ids = b.column(at["doc_id"]).cast(pa.int64()).to_pylist()
        hosts = ["" if x is None else f"={x}" for x in b.column(at["source"]).to_pylist()]
        old = b.column(at["text"]).to_pylist()
        counts = _counts(pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), b.column(at["text"])], names=["doc_id", "text"])).to_pydict()
        keep, new = [], []
        for i, (d, t, h) in enumerate(zip(doc_ids, old, hosts)):
            n = counts["n_words"][i]
            if n < 10 or 100 * counts["n_repeat_words"][i] > 20 * n:
                continue
            gone = shared.value.removed(d, t, h)
            if n - sum(w for _, w in gone) >= least_left * n:
                places = {p for p, _ in gone}
                keep.append(i)
                new.append("\n".join(x for p, x in enumerate(t.split("\n")) if p not in places) if places else t)
        out = b.take(pa.array(keep, pa.int64()))
        columns = out.columns
        columns[at["text"]] = pa.array(new, columns[at["text"]].type)
        return pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return run


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, max_docs: int = MAX_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """Rejected documents go; the others lose their boilerplate lines. Each row has its own verdict and removals: rows
    that share a doc_id but differ in text or source are judged apart, and so are those with a null doc_id. Null, empty
    and wordless texts are rejected, texts of any length are judged whole, a null source is a host of its own, an empty
    table stays empty, and columns of any name stay as they are (but n_chars follows the text)."""
    docs, back = apart(docs, "__id", "__t", "__gone")
    known, table_ = _known(docs, max_docs)
    if table_ is not None:
        at = {c: docs.columns.index(c) for c in ("doc_id", "text", "source")}
        out = docs.mapInArrow(each(_without(spark.sparkContext.broadcast(table_), at, least_left)), docs.schema)
        return back(_recounted(out, docs, F.lit(True)))
    keyed = _keyed(docs)
    removed = _removed(keyed, known)
    verdict = quality_verdict(keyed, removed, least_left)
    gone = removed.groupBy(*_KEY).agg(F.collect_set("pos").alias("__gone"))
    kept = verdict.where("kept").select(*_KEY).join(gone, list(_KEY), "left")
    joined = keyed.join(merged(kept), list(_KEY))
    lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__gone", i.cast("long")))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))
    return back(_recounted(joined.withColumn("text", text), docs, F.col("__gone").isNotNull()))


def _recounted(out: DataFrame, docs: DataFrame, changed: Column) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def quality_verdict(keyed: DataFrame, removed: DataFrame, least_left: float = LEAST_LEFT) -> DataFrame:
    """__id, __t, kept, for each distinct row of keyed; rows with the same key have the same text."""
    rows = keyed.select(F.col("__id").alias("doc_id"), "text", "__t")
    counts = base_counts(rows, "__t").withColumnRenamed("doc_id", "__id").groupBy(*_KEY).agg(F.max("n_words").alias("n_words"), F.bool_and("base_failed").alias("base_failed"))
    lost = removed.groupBy(*_KEY).agg(F.sum("words").alias("lost"))
    left = F.col("n_words") - F.coalesce("lost", F.lit(0))
    return stored(counts.join(lost, list(_KEY), "left").select(*_KEY, (~F.col("base_failed") & (left >= least_left * F.col("n_words"))).alias("kept")), "verdict")


ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('=' || source, '') AS host FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{_SPACE}'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, x FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win JOIN twice USING (doc_id, x), range(5) AS r(k) GROUP BY doc_id),
ln AS (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
nl AS (SELECT doc_id, host, trim(regexp_replace(lower(line), '{_SPACE}', ' ', 'g')) AS line FROM ln),
wl AS (SELECT nl.*, len(string_split(nl.line, ' ')) AS words, d.text FROM nl JOIN d USING (doc_id) WHERE line <> ''),
hot AS (SELECT host, line, min(doc_id) AS first FROM wl GROUP BY ALL HAVING count(DISTINCT text) > {MAX_DOCS}),
lost AS (SELECT doc_id, sum(words)::BIGINT AS n FROM wl JOIN hot USING (host, line) WHERE doc_id <> first GROUP BY doc_id),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f AS base_failed,
  NOT f AND n_words - n_removed_words >= {LEAST_LEFT} * n_words AS kept, n_removed_words
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS f FROM b)
"""
