"""Quality classifier: hashed word and character n-gram vectors, averaged for each document, softmax output."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, each, spread, stored, table, tune
from .shingles import _PLACE, LOWER, buffers, mix, word_hashes, words

#: At most so many labelled documents are learned from: those with the least hash of their doc_id, whole, as long as
#: those before them have fewer bytes than this.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 24 << 20
BUCKETS, WIDTH = 1 << 17, 16
#: Lengths, in bytes, of the n-grams within a word and the border at each of its sides.
GRAMS = (3, 4)
EPOCHS, RATE = 6, 0.4
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


@dataclass
class Model:
    """vectors: one for each bucket; output: a column for each class."""

    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def weights(self) -> np.ndarray:
        """A bucket's part in the difference of the two logits. Since a document's vector is a mean, so is its logit."""
        return self.vectors @ (self.output[:, 1] - self.output[:, 0])

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of all rows (words, pairs of words, n-grams within words), and the row of each."""
    data, offsets = buffers(column)
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    h = word_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    same = row[:-1] == row[1:]
    found = [(h, row), (mix(h[:-1] * _PLACE[1] + h[1:] * _PLACE[2])[same], row[:-1][same])]
    # one border byte before each word and one after the last: n-grams with a border at either end only
    length = ends - starts
    place = np.concatenate([[0], np.cumsum(length + 1)])
    padded = np.zeros(place[-1] + 1, np.uint8)
    padded[np.repeat(place[:-1] + 1 - starts, length) + np.repeat(starts, length) + _ranges(length)] = data[np.repeat(starts, length) + _ranges(length)]
    borders = np.cumsum(padded == 0)
    owner = np.repeat(row, length + 1)
    for n in GRAMS:
        m = len(padded) - n + 1
        if m > 0:
            inner = borders[n - 2 : n - 2 + m] - borders[:m] == 0  # none between the ends
            at = np.flatnonzero(inner)
            at = at[at < len(owner)]
            x = np.zeros(len(at), np.uint64)
            for i in range(n):
                x = x << np.uint64(8) | padded[at + i]
            found.append((mix(x + _PLACE[8 + n]), owner[at]))
    return np.concatenate([(x >> np.uint64(47)).astype(np.int32) for x, _ in found]), np.concatenate([r for _, r in found])


def _ranges(length: np.ndarray) -> np.ndarray:
    return np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)


def train(rows: list[str], labels: list[int], seed: int = 5) -> Model:
    """Stochastic gradient descent, one document at a time, with a falling rate. The order depends on the seed only."""
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32), np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32))
    docs = []
    for i in range(0, len(rows), 200):
        buckets, row = features(pa.array(rows[i : i + 200], pa.string()))
        order = np.argsort(row, kind="stable")
        docs += [(x.astype(np.int32), n.astype(np.int32)) for x, n in (np.unique(x, return_counts=True) for x in np.split(buckets[order], np.searchsorted(row[order], np.arange(1, len(rows[i : i + 200])))))]
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    if share.min() > 0:
        model.bias[:] = np.log(share)
    steps, step = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - step / steps)
            step += 1
            buckets, counts = docs[i]
            if not len(buckets):
                continue
            share_of = (counts / counts.sum()).astype(np.float32)
            v = share_of @ model.vectors[buckets]
            z = v @ model.output + model.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = model.output @ p
            model.output -= rate * np.outer(v, p)
            model.bias -= 0.1 * rate * p
            model.vectors[buckets] -= (rate * len(buckets) ** 0.5) * share_of[:, None] * back
    return model


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """The bounded sample: labelled rows whose crc32(doc_id) mod 3 isn't 1. A doc_id with several labels counts as its
    largest one, one with several texts as the least of these. Texts of any length are taken whole; only the one that
    goes over ``most`` bytes, and none after it, brings the sum above that."""
    kept = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    kept = kept.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    kept = kept.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.where("text IS NOT NULL").join(F.broadcast(kept), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    found = stored(found.withColumn("rank", F.xxhash64("doc_id")), "sample")
    before = Window.orderBy("rank", "doc_id").rowsBetween(Window.unboundedPreceding, -1)  # over at most ``rows`` numbers
    fits = found.select("doc_id", "rank", F.octet_length("text").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < most)
    got = sorted(found.join(F.broadcast(fits.select("doc_id")), "doc_id").select("doc_id", "text", "quality").collect())
    return [r.text for r in got], [int(r.quality > 0) for r in got]


def scored(docs: DataFrame, model: Model) -> DataFrame:
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast((model.weights().astype(np.float32), model.offset()))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        weights, offset = shared.value
        n, z = b.num_rows, np.zeros(b.num_rows)
        size = np.diff(buffers(b.column("text"))[1])
        cut = np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(size) >> 21)) + 1, [n]])
        for i, j in zip(cut[:-1].tolist(), cut[1:].tolist()):  # about 2 MB of text at a time
            if j > i:
                buckets, row = features(b.column("text").slice(i, j - i))
                total = np.bincount(row, weights[buckets], minlength=j - i)
                z[i:j] = total / np.maximum(1, np.bincount(row, minlength=j - i))
        return batches({"doc_id": b.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(z + offset, -500, 500)))}, _SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each(run), "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, held_out, score, predicted.

    The model is learned on the driver from a bounded sample (SAMPLE_ROWS, SAMPLE_BYTES) and is applied to every whole text. Only
    the text goes into a score. A null, empty or wordless text gets the share of label 1 in the sample, as learned.
    Without labels every score is 0.5. Repeated rows give repeated results; other columns are not read.
    """
    text, label = sample(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored(docs, train(text, label)).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
