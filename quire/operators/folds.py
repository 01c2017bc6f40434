"""Ordered folds in which one key may have any share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship, written

#: step(state, *values) -> (state, outputs) for one row; a state is a tuple of whole numbers or None.
Step = Callable[..., tuple[tuple, tuple]]


def _runs(it: Iterator[pa.RecordBatch], columns: list[str], step: Step, start: tuple, given: dict) -> Iterator[tuple[Any, Any, tuple, list[tuple]]]:
    """For each batch of sorted rows and each key in it: range, key, the state after, what the step has put out."""
    at, state = None, start
    for b in it:
        ranges, keys = b.column(0).to_pylist(), b.column(1).to_pylist()
        values = list(zip(*(b.column(c).to_pylist() for c in columns))) if columns else [()] * b.num_rows
        i = 0
        while i < len(keys):
            if (ranges[i], keys[i]) != at:
                if at is None or at[0] != ranges[i]:
                    state = given.get((ranges[i], keys[i]), start)
                else:
                    state = start
                at = (ranges[i], keys[i])
            j, out = i, []
            while j < len(keys) and (ranges[j], keys[j]) == at:
                state, put = step(state, *values[j])
                out.append(put)
                j += 1
            yield (*at, state, out)
            i = j


def folded(rows: DataFrame, key: str, order: list[str], values: list[str], step: Step, start: tuple, outputs: str, keep: list[str]) -> DataFrame:
    """A fold over each key's rows in order: ``keep`` columns and the step's outputs (a schema string) for every row.

    Rows are dealt to ranges of (key, order), so that a key with very many rows lies in many ranges, and are written. All
    ranges are folded at once, each as if its first key began there; what comes out at its end is what the next range
    should have begun with. Ranges that began with another state are folded anew until none did: a range whose rows are
    all of one key may pass a change on, any other can't. Two states usually meet after a few rows, so that few rounds are
    needed; where they never meet, each round still settles a range, and the result is that of the plain fold. The driver
    sees a state for each range, as many as there are shuffle partitions. ``order`` has to tell a key's rows apart: a row
    with the same key and order may come before or after. A null key is a key.
    """
    spark = rows.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = list(dict.fromkeys([key, *order, *values, *keep]))
    dealt = rows.select(*plain).repartitionByRange(parts, key, *order).withColumn("__range", F.spark_partition_id())
    dealt = written(dealt, "fold")
    fixed = ["__range", key, *values]
    kind, arrow = dealt.schema[key].dataType.simpleString(), to_arrow_type(dealt.schema[key].dataType)

    def ends(table: DataFrame, given: dict) -> dict[int, tuple]:
        """range -> its first key, its last key, the state after it."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, list] = {}
            for r, k, state, _ in _runs(it, values, step, start, given):
                found.setdefault(r, [k, k, state])[1:] = [k, state]
            yield pa.RecordBatch.from_pylist([{"r": r, "first": a, "last": b, "state": list(s)} for r, (a, b, s) in found.items()], pa.schema([("r", pa.int32()), ("first", arrow), ("last", arrow), ("state", pa.list_(pa.int64()))]))

        sorted_ = table.select(*dict.fromkeys([*fixed, *order])).repartition(parts, "__range").sortWithinPartitions("__range", key, *order).select(*fixed)
        return {r.r: (r.first, r.last, tuple(r.state)) for r in sorted_.mapInArrow(run, f"r int, first {kind}, last {kind}, state array<long>").collect()}

    known = ends(dealt, {})
    given: dict = {}
    while True:
        due, before = {}, None
        for r in sorted(known):
            if before is not None and known[before][1] == known[r][0]:
                due[(r, known[r][0])] = known[before][2]
            before = r
        anew = [r for r in known if due.get((r, known[r][0]), start) != given.get((r, known[r][0]), start) and known[r][0] == known[r][1]]
        given = due
        if not anew:
            break
        known |= ends(dealt.where(F.col("__range").isin(anew)), due)

    names = [x.split()[0] for x in outputs.split(", ")]
    kept = ", ".join(f"{c} {dealt.schema[c].dataType.simpleString()}" for c in keep)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _with_outputs(it, values, step, start, due, keep, names)

    sorted_ = dealt.repartition(parts, "__range").sortWithinPartitions("__range", key, *order).select(*fixed, *[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)])
    return sorted_.mapInArrow(run, f"{kept}, {outputs}").select(*keep, *names)


def _with_outputs(it: Iterator[pa.RecordBatch], values: list[str], step: Step, start: tuple, given: dict, keep: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The last columns, those to keep, of each batch beside what the step puts out for its rows."""
    held: list[pa.RecordBatch] = []

    def watched() -> Iterator[pa.RecordBatch]:
        for b in it:
            held.append(b)
            yield b

    out: list[tuple] = []
    for *_, put in _runs(watched(), values, step, start, given):
        out += put
        if len(out) == held[0].num_rows:
            b = held.pop(0)
            made = [pa.array(c) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([*b.columns[b.num_columns - len(keep) :], *made], [*keep, *names])
            out = []
