"""Token counts with a cache of counts by content digest."""

from __future__ import annotations

import hashlib
import re

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, each, merged, scratch, slices, small, spread, stored, table, texts, tune
from .memo import MEMO_CHUNKS

LIMIT = 4096
_SPACES = re.compile(" *[^ ]+| +")
_SCHEMA = pa.schema([("digest", pa.binary()), ("tokenizer", pa.string()), ("n_tokens", pa.int64())])
_CACHE = "digest binary, tokenizer string, n_tokens long"
_made: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts of a sentencepiece model. Where no piece goes on after a space, a text's pieces are those of its words
    one by one, so each distinct word (with the spaces before it) is encoded once; any other model gets whole texts."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        cross = any(re.search("[^▁]▁", p) for p in pieces)
        # an identity normalizer keeps every space and puts one in front
        plain = self.model.encode(" a  Åﬁ　b \n", out_type=str) == self.model.encode(" a", out_type=str) + [
            x for w in (" Åﬁ　b", "\n") for x in self.model.encode(w, out_type=str)]
        self.by_word, self.memo = not cross and plain, {}

    def counts(self, rows: list[str]) -> list[int]:
        if not self.by_word:
            return [len(x) for x in self.model.encode(rows, num_threads=1)]
        # the library puts a space before a text; U+2581 in a text is a space to it
        lists = [_SPACES.findall(" " + x.replace("▁", " ")) if x else [] for x in rows]
        new = set().union(*lists) - self.memo.keys()
        if len(self.memo) > MEMO_CHUNKS:
            self.memo, new = {}, set().union(*lists)
        if new:
            new = list(new)
            self.memo.update(zip(new, (len(x) for x in self.model.encode([w[1:] for w in new], num_threads=1))))
            for w in new:
                if len(w) == 1:  # a last space alone: the library gives nothing for an empty text
                    self.memo[w] = 1
        look = self.memo.__getitem__
        return [sum(map(look, x)) for x in lists]


def _count(name: str):
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        path = public_tokenizers.path(name)
        if path not in _made:
            _made[path] = PieceCounter(path)
        rows = texts(b)
        counts = [n for i, j in slices(list(map(len, rows))) for n in _made[path].counts(rows[i:j])]
        return batches({"digest": b.column("digest"), "tokenizer": b.column("tokenizer"), "n_tokens": counts}, _SCHEMA)

    return run


def version(name: str) -> str:
    """The digest of the tokenizer's file and library version: a changed tokenizer finds no old counts."""
    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read() + sentencepiece.__version__.encode()).hexdigest()


def count_tokens(docs: DataFrame, cache: str, name: str = "piece_bpe_32k.model", limit: int = LIMIT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit, by way of the cache, a Parquet folder that this
    call reads, appends to and reads again.

    Content is normalised in one respect only, since anything else could change a count: null counts as empty. Each
    distinct content that the cache lacks for this tokenizer version is encoded once, from the row with the least
    doc_id that has it. Repeated rows give repeated results; other columns are not read. Two calls at the same time
    may append the same count twice; that changes no result, since counts are grouped on reading. A call that is
    lost before its end has appended either all its counts or none.
    """
    spark = docs.sparkSession
    tune(spark)
    key = version(name)
    body = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.unhex(F.sha2(body, 256)).alias("digest"))

    def known() -> DataFrame:
        try:
            return spark.read.schema(_CACHE).parquet(cache).where(F.col("tokenizer") == key)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], _CACHE)

    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    misses = firsts.join(known().select("digest").distinct(), "digest", "left_anti")
    # a warm cache may lack few contents, and then no text is moved but theirs; a cold one lacks all
    misses = merged(misses) if known().isEmpty() else small(stored(misses, "misses"))
    # rows without a doc_id can still be the only ones of their content
    found = rows.join(misses, rows.doc_id.eqNullSafe(misses.doc_id) & (rows.digest == misses.digest), "left_semi")
    encoded = found.select("digest", F.lit(key).alias("tokenizer"), "text").mapInArrow(each(_count(name)), _CACHE).dropDuplicates(["digest"])  # repeated rows
    encoded.write.mode("append").parquet(cache)
    # written before the join, so that the rows of one digest, which may be very many, can be split over tasks
    counts = stored(known().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")
    sizes = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return sizes.join(merged(counts), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a new cache in the shared folder, so that each run's figures stand for encoding the whole table."""
    return count_tokens(spread(table(spark, sf_dir, "documents")), scratch(spark, "token-counts"))
