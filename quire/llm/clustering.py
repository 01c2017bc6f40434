"""Centroid clustering: exact nearest centroids, most of them screened out by the norms of segments."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finished, release, stored, table
from .vectors import lists, matrix, merged_sums, moved, whole

#: Components of a vector, centroids, rounds, factor of the components, components of a segment, levels of a compressed component on either side of 0.
WIDTH, CENTROIDS, ROUNDS, SCALE, SEGMENT, LEVELS = 64, 16, 3, 64, 8, 7


def roots(squares: np.ndarray) -> np.ndarray:
    """The least whole number whose square is at least as large, for each of them (below 2**62)."""
    r = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    r -= r * r > squares
    r += (r + 1) ** 2 <= squares
    return r + (r * r < squares)


def segment_roots(x: np.ndarray, segment: int) -> np.ndarray:
    """The norms of the segments of each row, rounded up."""
    return roots((x.reshape(len(x), x.shape[1] // segment, segment) ** 2).sum(axis=2))


@dataclass
class Compressed:
    """Vectors as step * code, code of few levels, with the norms of the segments of what is left over, and squared norms."""

    code: np.ndarray
    step: np.ndarray
    left: np.ndarray
    square: np.ndarray


def compressed(x: np.ndarray, segment: int, levels: int = LEVELS) -> Compressed:
    step = np.maximum(1, -(-np.abs(x).max(axis=1, initial=0) // levels))
    code = (x + step[:, None] // 2) // step[:, None]
    return Compressed(code, step, segment_roots(x - step[:, None] * code, segment), (x * x).sum(axis=1))


def least_distances(held: Compressed, centres: np.ndarray, segment: int) -> np.ndarray:
    """A lower bound of each squared distance |x|^2 + |c|^2 - 2 x.c, without x: x.c is step * code.c and the product of c with
    what is left over, which by Cauchy-Schwarz is at most the sum of the products of the segments' norms. The norms are
    rounded up, and code.c stays below 2**53, so that doubles hold it: the bound is one of whole numbers."""
    coarse = held.step[:, None] * (held.code.astype(np.float64) @ centres.T.astype(np.float64)).astype(np.int64)
    return held.square[:, None] + (centres * centres).sum(axis=1) - 2 * (coarse + held.left @ segment_roots(centres, segment).T)


def nearest(x: np.ndarray, held: Compressed, centres: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first nearest centre of each row, its squared distance, and the number of distances that were computed: that
    to the centre of the least bound, and those to all whose bound isn't above it."""
    least = least_distances(held, centres, segment)
    rows = np.arange(len(x))
    first = least.argmin(axis=1)
    known = ((x - centres[first]) ** 2).sum(axis=1)
    left = least <= known[:, None]
    left[rows, first] = False
    d = np.full(least.shape, np.iinfo(np.int64).max)
    d[rows, first] = known
    for c, at in enumerate(left.T):  # rows that a centre is left for
        at = np.flatnonzero(at)
        d[at, c] = ((x[at] - centres[c]) ** 2).sum(axis=1)
    near = d.argmin(axis=1)
    return near, d[rows, near], 1 + left.sum(axis=1)


def first_centres(vectors: DataFrame, centroids: int) -> np.ndarray:
    """The vectors with the smallest digests of 1:vec_id, of equal ones by components, null ids last."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in vectors.select("v", digest.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").select("v").limit(centroids).collect()], np.int64)


def clusters(vectors: DataFrame, width: int = WIDTH, centroids: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, segment: int = SEGMENT) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, cluster, distance, computed (the exact distances that the row needed in the last
    assignment), cluster_inertia, inertia, centroid_sha256.

    Components and centroids are whole numbers. A compressed form of each vector, and the norms of the segments of what it
    leaves out, are made once and are written beside it; every round is one pass over that table, whose tasks sum what they assign, and only these sums are
    shuffled. The centroids are broadcast: ``centroids * width`` numbers, whatever the table holds.

    Rows without ``width`` components, and rows with a null or non-finite one, are dropped; components beyond bound()
    count as bound(). Repeated rows, and rows of equal or null vec_id, each count. With fewer rows than ``centroids``
    there are as many centroids as rows. Of equal distances the smaller number counts. A sum beyond 64 bits is null. An
    empty table gives no rows. Other columns aren't read.
    """
    if width % segment:
        raise ValueError("segments have to divide the width")
    spark = vectors.sparkSession
    sc = spark.sparkContext

    def beside(v: np.ndarray) -> list[pa.Array]:
        held = compressed(v, segment)
        return [lists(held.code, pa.int8()), pa.array(held.step), lists(held.left, pa.int64()), pa.array(held.square)]

    rows = whole(vectors, width, scale, "cast(null as int)", beside, "code array<tinyint>, step long, left array<long>, square long").drop("label")
    centres = first_centres(rows, centroids).reshape(-1, width)

    def found(b: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, ...]:
        x = matrix(b.column("v"), width)
        held = Compressed(matrix(b.column("code"), width), b.column("step").to_numpy(), matrix(b.column("left"), width // segment), b.column("square").to_numpy())
        return x, *nearest(x, held, centres, segment)

    for _ in range(rounds if len(centres) else 0):
        shared = sc.broadcast(centres)

        def assign(b: pa.RecordBatch, shared=shared) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            yield found(b, shared.value)[:2]

        centres = moved(centres, *merged_sums(rows.drop("vec_id"), assign, len(centres), width))
        shared.unpersist()
    shared = sc.broadcast(centres)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, it):
            _, near, d, n = found(b, shared.value)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(d), pa.array(n.astype(np.int32))], ["vec_id", "cluster", "distance", "computed"])
        release()

    placed = stored(rows.mapInArrow(run, "vec_id long, cluster int, distance long, computed int"), "clusters")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # a row for each centroid
    fits = lambda n: n if n < 2**63 else None
    total = fits(sum(int(r["d"]) for r in sums))
    about = [(r["cluster"], fits(int(r["d"])), total, hashlib.sha256(",".join(map(str, centres[r["cluster"]].tolist())).encode()).hexdigest()) for r in sums]
    return placed.join(F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return finished(spark, lambda: clusters(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")


def _round(i: int) -> str:
    """Assignment by the centroids c{i}, and the centroids after it."""
    return f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min((vv - 2 * list_dot_product(v, c) + cc)::BIGINT * 16 + e) AS m FROM kept, c{i} GROUP BY vec_id),
 c{i + 1} AS MATERIALIZED (SELECT b.e, coalesce(n.c, b.c) AS c, list_dot_product(coalesce(n.c, b.c), coalesce(n.c, b.c)) AS cc
 FROM c{i} b LEFT JOIN (SELECT e, list(c ORDER BY i) AS c FROM (SELECT m % 16 AS e, i, floor(sum(v[i]) / count(*)) AS c FROM a{i}, range(1, 65) r(i) GROUP BY ALL) GROUP BY e) n ON n.e = b.e)"""


#: As in vector_codes; SQL for tables without repeated vec_ids.
ORACLE = f"""WITH raw AS (SELECT vec_id, [floor(x::DOUBLE * 64) for x in embedding] AS v FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
 kept AS MATERIALIZED (SELECT *, list_dot_product(v, v) AS vv FROM raw),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS e, v AS c, vv AS cc FROM kept QUALIFY e < 16),
 {", ".join(_round(i) for i in range(ROUNDS + 1))},
 h AS (SELECT e, sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY i)) AS h FROM c{ROUNDS}, range(1, 65) r(i) GROUP BY e)
 SELECT vec_id, e::INT AS cluster, m // 16 AS distance, (sum(m // 16) OVER (PARTITION BY e))::BIGINT AS cluster_inertia, (sum(m // 16) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM a{ROUNDS} JOIN h ON e = m % 16"""
