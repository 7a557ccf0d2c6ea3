from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the sf0.001 tables as views."""
    import duckdb

    connection = duckdb.connect()
    for path in sorted((DATA / "sf0.001").glob("*.parquet")):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def same_rows(df, connection, sql: str) -> None:
    """A Spark result against DuckDB's: columns by name, rows in any order, floats within 1e-9."""
    import math

    rel = connection.sql(sql)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)

    def key(rows, columns):
        out = []
        for r in rows:
            v = [r[list(columns).index(n)] for n in names]
            out.append(tuple(None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 7) if isinstance(x, float) else int(x) if isinstance(x, bool) else x for x in v))
        return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))

    assert key([tuple(r) for r in df.collect()], df.columns) == key(rel.fetchall(), rel.columns)
