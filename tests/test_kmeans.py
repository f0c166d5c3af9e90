"""K-Means whose restarts share each pass: its result against MLlib's, how few jobs it takes, and silhouettes."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import StructField, StructType

from wardline.operators import kmeans, ml


def vectors(spark, x):
    return ml.materialised(spark.createDataFrame([(Vectors.dense(r),) for r in x.tolist()], StructType([StructField("scaled", VectorUDT())])).repartition(3))


def test_restarts_share_the_passes_and_find_the_clusters(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "BLOCK", 50)
    rng = np.random.default_rng(4)
    data = vectors(spark, np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 5, 0), (0, 0, 5))]))
    spark.sparkContext.setJobGroup("kmeans", "kmeans")
    model = ml.best_kmeans(data, 4, 20)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("kmeans")
    spark.sparkContext.setJobGroup("other", "other")
    assert len(jobs) <= 60  # 20 runs of MLlib's take over 100
    theirs = min((KMeans(k=4, seed=s, featuresCol="scaled", predictionCol="cluster_id").fit(data) for s in range(5)), key=lambda m: m.summary.trainingCost)
    assert abs(model.cost - theirs.summary.trainingCost) < 1e-6 * model.cost
    assert np.allclose(sorted(map(tuple, model.centres)), sorted(map(tuple, theirs.clusterCenters())))
    want = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster_id").evaluate(model.transform(data))
    assert abs(kmeans.silhouette(kmeans.Blocks.of(data, "scaled"), model) - want) < 1e-9


def test_fewer_vectors_than_clusters(spark):
    model = ml.best_kmeans(vectors(spark, np.array([[0.0, 1.0]] * 30 + [[2.0, 3.0]] * 5)), 4, 3)
    assert sorted(model.centres.tolist()) == [[0.0, 1.0], [2.0, 3.0]] and model.cost == 0
