"""Poisson counts of large means."""
import math

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing


@pytest.mark.parametrize("mean", [0.2, 599.0, 601.0, 1000.0, 20000.0])
def test_counts_of_any_mean_are_the_inverse_distribution(spark, mean):
    us = [(i + 0.5) / 400 for i in range(400)]
    got = [r["k"] for r in spark.createDataFrame([(i, u, mean) for i, u in enumerate(us)], "i int, u double, mean double").select("i", mixing.poisson_inverse(F.col("u"), F.col("mean")).alias("k")).orderBy("i").collect()]
    total, k, want = 0.0, -1, []
    for u in us:
        while total <= u:
            k += 1
            total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        want.append(k)
    assert got == want


def test_a_small_source_meets_its_weight(spark):
    rows = [(i, "x" * 1000, "a") for i in range(500)] + [(1000 + i, "x" * 10, "b") for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    chars = {r["source"]: r["n"] for r in mixing.mix_sources(df, seed=17).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert abs(chars["b"] / 250125 - 1) < 0.05 and abs(chars["a"] / 250125 - 1) < 0.2
    counts = {r["n"] for r in mixing.mix_sources(df, seed=17).where("source = 'b'").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert len(counts) > 10
