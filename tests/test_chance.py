"""Chance levels of large pools."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from spanmill.functions import numeric
from spanmill.operators import resampling


def test_harmonic_numbers_cost_the_same_for_any_pool(spark):
    sizes = [1, 2, 5, 62, 63, 64, 65, 100, 1000, 90_000]
    got = {r.n: r.h for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", numeric.harmonic(F.col("n")).alias("h")).collect()}
    for n in sizes:
        assert got[n] == pytest.approx(math.fsum(1.0 / k for k in range(1, n + 1)), rel=1e-14)
    pools = spark.range(1000).select(F.lit(360_000_000).cast("long").alias("pool_size"))
    level = pools.agg(resampling.chance_level(pools).alias("c"))
    assert "lambda" not in spark._jvm.PythonSQLUtils.explainString(level._jdf.queryExecution(), "simple")
    assert level.first().c == pytest.approx((math.log(3.6e8) + 0.5772156649015329 + 0.5 / 3.6e8) / 3.6e8, rel=1e-13)
