"""Distributed exact percentiles and global ranks against numpy / Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agentrail.operators.stats import exact_percentiles
from agentrail.operators.windows import global_rank


def test_exact_percentiles_match_numpy_with_a_hot_group(spark):
    rng = random.Random(7)
    rows = [("hot", rng.random() * 100) for _ in range(3000)]  # a third of all rows
    rows += [(f"g{i % 5}", rng.random() * 10) for i in range(6000)]
    rows += [("ties", 5.0) for _ in range(50)] + [("one", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in
           exact_percentiles(df, "v", [0.5, 0.95], by=["g"], partitions=7).collect()}
    for g in {r[0] for r in rows}:
        vals = np.array([v for k, v in rows if k == g])
        assert got[g][0] == pytest.approx(np.quantile(vals, 0.5), rel=1e-12, abs=1e-12)
        assert got[g][1] == pytest.approx(np.quantile(vals, 0.95), rel=1e-12, abs=1e-12)


def test_global_rank_is_a_dense_permutation(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 50)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, k long")
    r = global_rank(df, [F.col("k").desc(), F.col("id").asc()], partitions=5).collect()
    expected = sorted(rows, key=lambda x: (-x[1], x[0]))
    got = sorted(r, key=lambda x: x["rank"])
    assert [x["id"] for x in got] == [e[0] for e in expected]
    assert [x["rank"] for x in got] == list(range(1, 2001))


def test_ranks_and_percentiles_hold_with_extra_columns_and_no_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        df = spark.range(300_000).select(
            "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000))).cast("double").alias("v"),
            F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        r = global_rank(df, [F.col("v"), F.col("id")], partitions=16).agg(
            F.countDistinct("rank").alias("n"), F.max("rank").alias("m"), F.min("rank").alias("k")).first()
        assert (r.n, r.m, r.k) == (300_000, 300_000, 1)
        got = exact_percentiles(df, "v", [0.5, 0.95], partitions=16).first()
        vals = np.array([x.v for x in df.select("v").collect()])
        assert (got.p50, got.p95) == (np.quantile(vals, 0.5), np.quantile(vals, 0.95))
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
