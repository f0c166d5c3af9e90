"""The forest whose trees are tasks: its trees by brute force, its scores, and how few jobs a fit takes."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from wardline.operators import forest, ml


def gini(y, n, weights):
    w = [weights[c] * n[y == c].sum() for c in (0, 1)]
    return sum(w) - sum(v * v for v in w) / sum(w)


def plain_best(x, y, n, weights, least):
    """The highest gain of any split, by trying all."""
    gains = [0.0]
    for f in range(x.shape[1]):
        for edge in np.unique(x[:, f]):
            left = x[:, f] <= edge
            if n[left].sum() >= least and n[~left].sum() >= least:
                gains.append(gini(y, n, weights) - gini(y[left], n[left], weights) - gini(y[~left], n[~left], weights))
    return max(gains)


def test_trees_take_the_best_splits():
    rng = np.random.default_rng(2)
    x, y, n = rng.integers(0, 6, (60, 3)).astype(np.uint8), rng.integers(0, 2, 60).astype(np.int8), rng.integers(0, 4, 60)
    weights = (0.7, 1.6)
    tree = forest.grow(x, y, n, weights, 20, 2, 3, rng)
    pending, seen, own = [(0, np.arange(60)[n > 0])], 0, np.zeros(60)
    while pending:
        node, rows = pending.pop()
        seen += 1
        best = plain_best(x[rows], y[rows], n[rows], weights, 2)
        if not tree.left[node]:
            assert best < 1e-6
            own[rows] = weights[1] * n[rows][y[rows] == 1].sum() / sum(weights[c] * n[rows][y[rows] == c].sum() for c in (0, 1))
            continue
        right = x[rows, tree.feature[node]] > tree.edge[node]
        got = gini(y[rows], n[rows], weights) - gini(y[rows[right]], n[rows[right]], weights) - gini(y[rows[~right]], n[rows[~right]], weights)
        assert abs(got - best) < 1e-6
        pending += [(tree.left[node], rows[~right]), (tree.left[node] + 1, rows[right])]
    assert seen == len(tree.left) and np.allclose(tree.scores(x)[n > 0], own[n > 0], atol=1e-6)
    assert len(forest.grow(x, y, n, weights, 2, 2, 3, rng).left) <= 7
    assert len(forest.grow(x, np.ones(60, np.int8), n, weights, 20, 2, 3, rng).left) == 1


def test_a_deep_forest_takes_few_jobs(spark):
    spread = F.array(*[F.rand(i) for i in range(21)])
    rows = spark.range(0, 3000, 1, 4).select("id", spread.alias("x")).withColumn("label", ((F.col("x")[0] > 0.5) != (F.col("x")[1] > 0.3)).cast("int"))
    data = ml.materialised(rows.select("id", "label", F.lit(1.0).alias("weight"), array_to_vector("x").alias("features")))
    spark.sparkContext.setJobGroup("forest", "forest")
    model = ml.forest(data, trees=60)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("forest")
    spark.sparkContext.setJobGroup("other", "other")
    assert len(jobs) <= 15 and len(model.files) == 60
    assert {name for name, _, _ in ml.importances(model, 2)} == {"f01", "f02"}
    right = ml.probabilities(model, data).agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.97
    again = ml.forest(data, trees=60)
    assert np.array_equal(again.importances, model.importances)


def test_rare_values_keep_a_bin(spark):
    rows = spark.range(0, 1000).select(F.array(F.when(F.col("id") < 3, 0.0).otherwise(1.0), F.col("id").cast("double")).alias("x"))
    few, many = forest._cuts(rows, 2)
    assert few.tolist() == [0.0] and len(many) == forest.BINS - 1


def test_phrases_begin_with_the_listed_letters():
    """First letters by the parser of Python's re, which reads the patterns as Java's does."""
    from re import _constants as C
    from re import _parser

    from wardline.functions import lexicon as lx
    from wardline.functions.features import FIRST

    def first(tokens):
        out = set()
        for op, value in tokens:
            if op is C.AT:
                continue
            if op is C.LITERAL:
                return out | {chr(value)}, False
            if op is C.SUBPATTERN:
                letters, empty = first(value[3])
            elif op is C.BRANCH:
                parts = [first(b) for b in value[1]]
                letters, empty = set().union(*[p[0] for p in parts]), any(p[1] for p in parts)
            else:
                assert op is C.MAX_REPEAT
                letters, empty = first(value[2])
                empty = empty or value[0] == 0
            out |= letters
            if not empty:
                return out, False
        return out, True

    assert {g: "".join(sorted(first(_parser.parse(lx.alternation(g)))[0])) for g in lx.PHRASES} == FIRST


def test_scores_are_of_own_trees(spark, small, monkeypatch):
    from functools import partial

    from wardline.plans import catalogue

    made, fit = [], ml.forest
    monkeypatch.setattr(ml, "forest", lambda data: made.append(partial(fit, trees=3)(data)) or made[-1])
    rows = catalogue.queries()["rf_scores"](spark, small).collect()
    assert isinstance(made[0], forest.Forest) and rows and all(0 <= r["p"] <= 1 for r in rows)
