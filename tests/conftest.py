import glob
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    """rows(sql, folder) over the tables of a folder."""
    import duckdb

    def rows(sql, folder=SF):
        c = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
        r = c.sql(sql)
        order = sorted(r.columns)
        return order, normal(r.project(", ".join(f'"{x}"' for x in order)).fetchall())

    return rows


def normal(rows):
    def one(v):
        if isinstance(v, float):
            return f"{v:.9g}"
        return tuple(map(one, v)) if isinstance(v, list | tuple) else v

    return sorted(repr(tuple(map(one, r))) for r in rows)


@pytest.fixture(scope="session")
def rows_of():
    def rows(df):
        order = sorted(df.columns)
        return order, normal(map(tuple, df.select(*order).collect()))

    return rows
