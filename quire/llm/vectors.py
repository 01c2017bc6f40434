"""Vectors as whole numbers: exact distances, and sums of groups of them, on Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, spread, stored, tune


def bound(width: int) -> int:
    """Components are held within this, on either side of 0, so that a squared distance of two vectors stays below 2**62."""
    return math.isqrt(2**62 // max(1, width)) // 2


def integers(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept (``width`` components, none null or non-finite), and floor(scale * x) of theirs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    fits = pc.equal(pc.list_value_length(column), width).fill_null(False)
    x = pc.list_flatten(column.filter(fits)).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, width)  # null as NaN
    finite = np.isfinite(x).all(axis=1)
    kept = np.flatnonzero(fits.to_numpy(zero_copy_only=False))[finite]
    with np.errstate(over="ignore"):
        return kept, np.clip(np.floor(x[finite] * scale), -bound(width), bound(width)).astype(np.int64)


def whole(vectors: DataFrame, width: int, scale: int, label: str, beside: Callable[[np.ndarray], list[pa.Array]] = lambda v: [], columns: str = "") -> DataFrame:
    """vectors(vec_id, embedding, ...) -> vec_id, label, v, an array of whole numbers, and what beside() makes of all rows
    of a batch (``columns`` names and types it), as a written table, which every round reads."""
    tune(vectors.sparkSession)
    rows = spread(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.expr(label).alias("label"), "embedding")
    kind = rows.schema["label"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, it):
            kept, v = integers(b.column("embedding"), width, scale)
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("label").take(at), lists(v, pa.int32()), *beside(v)], names)
        release()

    schema = f"vec_id long, label {kind}, v array<int>{columns and ', '}{columns}"
    names = [x.split()[0] for x in schema.split(", ")]
    return stored(rows.mapInArrow(run, schema), "vectors")


def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """The rows of a matrix as a column of lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of lists of equal length as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def group_sums(x: np.ndarray, group: np.ndarray, into: np.ndarray, counts: np.ndarray) -> None:
    """Add each row of x to its group's row of ``into``, and 1 to its group's count."""
    if not len(x):
        return
    order = np.argsort(group, kind="stable")
    ordered = group[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    into[ordered[first]] += np.add.reduceat(x[order], first, axis=0)
    counts[ordered[first]] += np.diff(np.append(first, len(x)))


def merged_sums(table: DataFrame, assign, groups: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums and counts of ``groups`` groups over all rows. assign(batch) yields pairs of a matrix (rows by width) and
    the group of each row. Every task sums its own rows and gives a row for each group that it has met; these meet in
    a grouped shuffle. The driver gets no more than ``groups`` rows, whatever the table holds."""
    names = [f"s{i}" for i in range(width)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((groups, width), np.int64), np.zeros(groups, np.int64)
        for b in filter(len, it):
            for x, group in assign(b):
                group_sums(x, group, sums, counts)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met]), *(pa.array(sums[met, i]) for i in range(width))], ["grp", "n", *names])
        release()

    partial = table.mapInArrow(run, "grp long, n long, " + ", ".join(f"{x} long" for x in names))
    out, n = np.zeros((groups, width), np.int64), np.zeros(groups, np.int64)
    for r in partial.groupBy("grp").agg(F.sum("n").alias("n"), *[F.sum(x).alias(x) for x in names]).collect():
        out[r["grp"]], n[r["grp"]] = [r[x] for x in names], r["n"]
    return out, n


def moved(centres: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each centre of a group with rows at the floor of their mean; the others as they are."""
    return np.where(counts[:, None] > 0, sums // np.maximum(1, counts)[:, None], centres)
