"""Vector code compression: every vector as a few codebook indexes, all in whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finished, merged, release, small, stored, table
from .vectors import matrix, merged_sums, moved, whole

#: Parts of a vector, entries of each part's codebook (256 fit two hex digits), rounds, factor of the components.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest entry of each row, and its squared distance: |x|^2 - 2 x.c + |c|^2 in 64-bit whole numbers."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def first_books(vectors: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the smallest vec_ids, of equal ids by components: (parts, entries, length of a part)."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    x = np.array([r["v"] for r in rows], np.int64)
    return x.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy()


def train(vectors: DataFrame, width: int, parts: int, entries: int, rounds: int) -> np.ndarray:
    """The codebooks after all rounds. A codebook is broadcast, of ``entries * width`` numbers at most, whatever the table holds."""
    sc = vectors.sparkSession.sparkContext
    books = first_books(vectors, parts, entries)
    size = books.shape[1]
    for _ in range(rounds):
        shared = sc.broadcast(books)

        def assign(b: pa.RecordBatch, shared=shared) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            x = matrix(b.column("v"), width).reshape(b.num_rows, parts, width // parts)
            for p, book in enumerate(shared.value):
                yield x[:, p], nearest(x[:, p], book)[0] + p * size

        sums, counts = merged_sums(vectors.select("v"), assign, parts * size, width // parts)
        books = moved(books.reshape(parts * size, -1), sums, counts).reshape(books.shape)
        shared.unpersist()
    return books


def encoded(vectors: DataFrame, books: np.ndarray, width: int) -> DataFrame:
    """vec_id, label, code, error by given codebooks."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, it):
            x = matrix(b.column("v"), width).reshape(b.num_rows, len(shared.value), -1)
            found = [nearest(x[:, p], book) for p, book in enumerate(shared.value)]
            code = np.stack([at for at, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            n = 2 * len(found)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), pa.array([code[i : i + n] for i in range(0, len(code), n)], pa.string()), pa.array(sum(d for _, d in found))], ["vec_id", "label", "code", "error"])
        release()

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "v").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def usual_width(vectors: DataFrame, parts: int) -> int:
    """The number of components that most vectors have, of those that the parts divide; of as frequent ones the smallest."""
    n = F.size("embedding")
    found = vectors.where((n > 0) & (n % parts == 0)).groupBy(n.alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else parts


def vector_codes(vectors: DataFrame, width: int | None = None, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, label, code, error, label_error, codebooks_sha256.

    Codebooks of whole numbers, one for each part of a vector, start at the smallest vec_ids and move ``rounds`` times
    to the floor of the mean of what is nearest to them. Every round is one pass over a written table: tasks sum what
    they assign, and only these sums are shuffled.

    width: null takes the usual one. Rows without ``width`` components, and rows with a null or non-finite one, are
    dropped; components beyond bound() count as bound(). Repeated rows, and rows of equal or null vec_id, each count; null
    ids come after all others where the first entries are chosen, equal ones by components. With fewer rows than
    ``entries`` there are as many entries as rows. A label of a third of all rows is summed in every task first. A label's sum beyond 64 bits is null. An empty table
    gives no rows. Other columns aren't read.
    """
    if width is None:
        width = usual_width(vectors, parts)
    if width % parts or not 0 < entries <= 256:
        raise ValueError("parts have to divide the width, and an index has two hex digits")
    rows = whole(vectors, width, scale, "label")
    books = train(rows, width, parts, entries, rounds) if not rows.isEmpty() else np.zeros((parts, 0, width // parts), np.int64)
    coded = stored(encoded(rows, books, width), "codes")
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    sums = stored(sums.withColumnRenamed("label", "of_label"), "labels")
    by = coded["label"].eqNullSafe(sums["of_label"])
    held = small(sums)
    joined = coded.join(held, by) if held is not sums else merged(coded).join(sums, by)
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return finished(spark, lambda: vector_codes(vectors).select("vec_id", "code", "error", "label_error", "codebooks_sha256"), "vector-codes")


def _round(i: int) -> str:
    """Assignment by the codebooks b{i}, and the codebooks after it."""
    return f"""a{i} AS MATERIALIZED (SELECT pt.p, vec_id, label, any_value(x) AS x, min((xx - 2 * list_dot_product(x, c) + cc)::BIGINT * 256 + e) AS m FROM pt JOIN b{i} b ON b.p = pt.p GROUP BY ALL),
 s{i} AS (SELECT p, m % 256 AS e, i, floor(sum(x[i]) / count(*)) AS c FROM a{i}, range(1, 17) r(i) GROUP BY ALL),
 b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(n.c, b.c) AS c, list_dot_product(coalesce(n.c, b.c), coalesce(n.c, b.c)) AS cc FROM b{i} b LEFT JOIN (SELECT p, e, list(c ORDER BY i) AS c FROM s{i} GROUP BY ALL) n ON n.p = b.p AND n.e = b.e)"""


#: Distances as sums of products of whole numbers below 2**53, which doubles hold exactly; SQL for tables without repeated vec_ids.
ORACLE = f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, [floor(x::DOUBLE * 1024) for x in embedding] AS v FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
 pt AS MATERIALIZED (SELECT vec_id, label, p, v[p * 16 + 1 : p * 16 + 16] AS x, list_dot_product(v[p * 16 + 1 : p * 16 + 16], v[p * 16 + 1 : p * 16 + 16]) AS xx FROM kept, range(4) r(p)),
 b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c, xx AS cc FROM pt QUALIFY e < 256),
 {", ".join(_round(i) for i in range(ROUNDS + 1))},
 h AS (SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS h FROM b{ROUNDS}, range(1, 17) r(i)),
 o AS (SELECT vec_id, label, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a{ROUNDS} GROUP BY ALL)
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM o, h"""
