"""Keys of a folder tree as a data source: a split for each prefix, which takes filters on prefix and key."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, In, InputPartition
from pyspark.sql.types import StructType

from ..session import ship


def listing(spark: SparkSession, path: str) -> DataFrame:
    """prefix, key, size of all files below path, which holds a folder for each prefix; filters go to the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark)
    spark.dataSource.register(Listing)
    return spark.read.format("listing").option("path", path).load()


@dataclass
class Prefix(InputPartition):
    """The folder of one prefix, and the key after which it is read."""

    name: str
    after: str


class Listing(DataSource):
    """format("listing"), option path: prefix (a folder), key (a path below it) and size of all files, in order of key
    within a prefix. ``prefix = x``, ``prefix IN (...)`` and ``key > x`` are taken by the source: other prefixes aren't
    listed at all, and of a prefix nothing before the cursor is looked at. The path has to be one that every worker sees."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "prefix string, key string, size long"

    def reader(self, schema: StructType) -> ListingReader:
        return ListingReader(self.options["path"])


class ListingReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.only, self.after = root, None, ""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("prefix",):
                self._keep({f.value})
            elif isinstance(f, In) and f.attribute == ("prefix",):
                self._keep(set(f.value))
            elif isinstance(f, GreaterThan) and f.attribute == ("key",):
                self.after = max(self.after, f.value)
            else:
                yield f

    def _keep(self, names: set) -> None:
        self.only = names if self.only is None else self.only & names

    def partitions(self) -> list[Prefix]:
        names = sorted(e.name for e in os.scandir(self.root) if e.is_dir())
        return [Prefix(n, self.after) for n in names if self.only is None or n in self.only]

    def read(self, partition: Prefix) -> Iterator[tuple[str, str, int]]:
        if partition is None:
            return
        for key, size in _below(os.path.join(self.root, partition.name), "", partition.after):
            yield partition.name, key, size


def _below(folder: str, front: str, after: str) -> Iterator[tuple[str, int]]:
    """Files below a folder in order of key; folders whose keys all come before ``after`` aren't opened."""
    held = [(front + e.name + ("/" if e.is_dir() else ""), e) for e in os.scandir(folder)]
    for key, e in sorted(held, key=lambda x: x[0].encode()):
        if e.is_dir():
            if not after or key.encode() > after.encode() or after.startswith(key):
                yield from _below(e.path, key, after)
        elif key.encode() > after.encode():
            yield key, e.stat().st_size
