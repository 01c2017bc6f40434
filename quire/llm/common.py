"""What the operators of this subpackage share: tables, shared folders, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship, spread

#: Rows of an Arrow batch; documents may be long, so batches stay small.
BATCH_ROWS = 1024
#: A side of at most so many (narrow) rows may be broadcast; larger sides are shuffled.
BROADCAST_ROWS = 100_000
#: The folders written since finished() was entered, if it was: of each thread's own.
_open: ContextVar[list[str] | None] = ContextVar("quire_open", default=None)
#: The C library's call that returns freed memory to the system, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows, unless the session asks for fewer, and let Python workers find this package."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def scratch(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/quire-{label}-{uuid.uuid4().hex}"
    held = _open.get()
    if held is not None:
        held.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def finished(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make()'s result, written in full; the folders that make() wrote on the way, in this thread, are deleted."""
    outer, inner = _open.get(), []
    token = _open.set(inner)
    try:
        out = stored(make(), label)
    finally:
        _open.reset(token)
    *passed, kept = inner
    if outer is not None:
        outer.append(kept)
    for path in passed:
        delete(spark, path)
    return out


def apart(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with any column of these names renamed, and what gives a result its columns, in docs' order and by docs' names."""
    clash = [c for c in docs.columns if c.lower() in names]
    new = {}
    for c in clash:
        free = c + "_"
        while free.lower() in {x.lower() for x in (*docs.columns, *names, *new.values())}:
            free += "_"
        new[c] = free
    columns = docs.columns
    return docs.withColumnsRenamed(new), lambda out: out.withColumnsRenamed({v: k for k, v in new.items()}).select(*columns)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, cells: str = "1") -> DataFrame:
    """df marked for broadcast if it holds at most ``rows`` cells (by default one for each row; else an expression, such
    as the size of an array); else df as it is, for a shuffled join. At most ``rows`` rows are looked at."""
    found = df.limit(rows + 1).selectExpr(f"coalesce(sum({cells}), 0) AS n").first()["n"]
    return F.broadcast(df) if found <= rows else df


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The column as Python strings, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]


def batches(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def release() -> None:
    """Return memory that nothing uses to the system. A Python worker outlives its task, and what it keeps counts against its executor in all later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def each(fn, after: Callable[[], None] = lambda: None) -> object:
    """fn(batch) -> batch, for mapInArrow. At the end of a task come after() and the release of memory."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in it:
                if b.num_rows:
                    yield fn(b)
        finally:
            after()
            release()

    return run


def slices(sizes: list[int], most: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of about ``most`` bytes or characters; a larger row is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def merged(df: DataFrame) -> DataFrame:
    """df for a sort-merge join at any size: one plan for small and large inputs, whose large partitions AQE can split."""
    return df.hint("merge")
