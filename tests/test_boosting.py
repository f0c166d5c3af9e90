"""Boosting over all rows: what leaves hold, and the same trees whether the driver or tasks hold the rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wardline.operators import boosting, ml


def test_leaves_count_all_rows(spark):
    n = 220_000
    rows = spark.range(0, n, 1, 4).select("id", F.array((F.col("id") % 2).cast("double")).alias("x"), ((F.col("id") % 2 == 1) & (F.col("id") % 10 != 1)).cast("int").alias("label"))
    model = boosting.boosted(rows.withColumn("features", array_to_vector("x")), rounds=1, depth=1, rate=0.5)
    ones, mixed = n * 4 // 10, n // 10  # of label 1, and of label 0 in their leaf
    weight = (n - ones) / ones
    left, right = -0.5 * (n / 2 * 0.5) / (n / 2 * 0.25 + 1), 0.5 * (weight * ones * 0.5 - mixed * 0.5) / (weight * ones * 0.25 + mixed * 0.25 + 1)
    assert model.trees.values[0].tolist() == pytest.approx([left, right], rel=1e-9)


def test_tasks_grow_the_trees_that_the_driver_grows(spark, monkeypatch):
    x = F.array(*[F.floor(F.rand(i) * many) / 10 for i, many in enumerate((3, 40, 1000, 1))])
    rows = ml.materialised(spark.range(0, 3000, 1, 3).select("id", x.alias("x")))
    rows = rows.withColumn("label", ((F.col("x")[1] > 2) != (F.col("x")[2] > 60)).cast("int")).withColumn("features", array_to_vector("x"))
    one = boosting.boosted(rows, rounds=4, depth=3)
    calls, written = [], boosting.Dealt.sums
    monkeypatch.setattr(boosting.Dealt, "sums", lambda self, *a: calls.append(sum(map(len, self.parts))) or written(self, *a))
    monkeypatch.setattr(boosting, "HELD_ROWS", 2999)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 300)
    monkeypatch.setattr(boosting, "PIECE_ROWS", 100)
    two = boosting.boosted(rows, rounds=4, depth=3)
    assert len(calls) == 12 and min(calls) >= 3
    assert np.array_equal(one.trees.features, two.trees.features) and np.array_equal(one.trees.thresholds, two.trees.thresholds)
    assert np.allclose(one.trees.values, two.trees.values) and np.ptp(one.trees.values) > 0.1
    p = ml.probabilities(two, rows).agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("label")).cast("int"))).first()[0]
    assert p > 0.9


def test_nothing_to_boost(spark):
    none = spark.createDataFrame([], "label int, x array<double>").withColumn("features", array_to_vector("x"))
    assert boosting.boosted(none, rounds=2, depth=2).trees.values.tolist() == [[0.0] * 4] * 2


def test_sums_of_the_larger_child_are_the_rest():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 5, (3, 500)).astype(np.uint8), rng.integers(0, 2, 500).astype(float)
    held = boosting.Held(x, y, 1.5)
    features, edges, node = np.array([1, 0, 2]), np.array([1, 3, 0]), np.zeros(500, dtype=int)
    for level in range(3):
        got = held.sums(features, edges, level)
        g, h = 0.5 * np.where(y > 0, -1.5, 1), 0.25 * np.where(y > 0, 1.5, 1)
        want = [[[[v[(node == k) & (x[f] == b)].sum() for b in range(5)] for f in range(3)] for k in range(2**level)] for v in (g, h)]
        assert np.allclose(got[..., :5], want) and not got[..., 5:].any()
        if level < 2:
            node = boosting._below(x, node, features[2**level - 1 : 2 ** (level + 1) - 1], edges[2**level - 1 : 2 ** (level + 1) - 1])
