"""Queries over trained models. Their results are statistical, so they have no SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import rules
from wardline.functions.features import vector_columns, with_features
from wardline.operators import corpus, metrics, ml
from wardline.plans.registry import query, table
from wardline.session import materialised, spread


_vectors: dict[tuple[str, str], DataFrame] = {}


def _data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The training and the test rows as vectors, which are made and written once for each input of an application."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _vectors:
        rows = corpus.stratified_split(corpus.clean(table(spark, sf_dir, "combined_dataset").select("row_id", "text", "label")))
        _vectors[at] = ml.labelled_vectors(rows)
    return _vectors[at].where("part = 'train'"), _vectors[at].where("part = 'test'")


def _scores(test: DataFrame) -> DataFrame:
    return test.select("row_id", "label", F.round("p", 6).alias("p"))


@query()
def lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _data(spark, sf_dir)
    return _scores(ml.probabilities(ml.logistic(train), test))


@query()
def rf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _data(spark, sf_dir)
    return _scores(ml.probabilities(ml.forest(train), test))


@query()
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _data(spark, sf_dir)
    return _scores(ml.probabilities(ml.boosting(train), test))


@query()
def svm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _data(spark, sf_dir)
    return _scores(ml.probabilities(ml.kernel_machine(train), test))


@query()
def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _data(spark, sf_dir)
    models = {"lr": None, "rf": ml.forest(train), "gbt": None, "svm": None}
    with ThreadPoolExecutor(1) as beside:  # the boosting, which is the driver's alone, runs beside the others' tasks
        boosted = beside.submit(ml.boosting, train)
        models |= {"lr": ml.logistic(train), "svm": ml.kernel_machine(train)}
        models["gbt"] = boosted.result()
    scored = {k: materialised(ml.probabilities(m, test).select("p", "label")) for k, m in models.items()}
    aucs = {k: metrics.rank_sums(v, "p", "label").first()["auc"] or 0.0 for k, v in scored.items()}
    best = ml.select_best(aucs)
    return spark.createDataFrame([(k, float(v), k == best) for k, v in aucs.items()], "model string, roc_auc double, selected boolean")


@query()
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _data(spark, sf_dir)
    return spark.createDataFrame(ml.importances(ml.forest(train)), "feature string, importance double, top_quartile boolean")


def _clusters(spark: SparkSession, sf_dir: str) -> tuple[ml.Clusters, DataFrame]:
    train, _ = _data(spark, sf_dir)
    return ml.attack_clusters(train.where("label = 1"))


@query()
def kmeans_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, rows = _clusters(spark, sf_dir)
    return rows.select("row_id", "cluster_id", clusters.cluster_label(F.col("cluster_id")).alias("family"))


@query()
def cluster_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters, _ = _clusters(spark, sf_dir)
    return spark.createDataFrame(clusters.top_features(), "cluster_id int, label string, count long, top_features array<struct<feature:string,value:double>>")


@query()
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml.nearest_members(_clusters(spark, sf_dir)[1], "row_id")


def _flat(rows: DataFrame, *keep: str) -> DataFrame:
    x = vector_to_array("features")
    return rows.select(*keep, *[x[i].alias(n) for i, n in enumerate(vector_columns())])


@query()
def cluster_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.group_deltas(_flat(_clusters(spark, sf_dir)[1], "cluster_id"), "cluster_id", vector_columns())


@query()
def feature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _data(spark, sf_dir)
    pairs = metrics.correlations(_flat(train.unionByName(test)), vector_columns())
    return pairs.orderBy(F.desc(F.abs("r")), "a", "b").limit(10)


@query()
def score_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text to features to model to rules to family and cluster: the test rows by a forest and clusters of the training rows."""
    train, test = _data(spark, sf_dir)
    clusters, _ = ml.attack_clusters(train.where("label = 1"))
    model = ml.forest(train)
    texts = table(spark, sf_dir, "combined_dataset").select("row_id", "text").join(test.select("row_id", F.col("label").alias("true_label"), "features"), "row_id")
    featured = with_features(spread(ml.probabilities(model, texts)))
    out = rules.scored(featured, "p", clusters)
    return out.select("row_id", "true_label", "verdict", "label", "confidence", "cluster_id", "cluster_label", "attack_family", "family_scores", F.size("spans").alias("n_spans"), "rule_boost_applied")


@query()
def silhouette_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _data(spark, sf_dir)
    return spark.createDataFrame(ml.silhouettes(ml.scaled(train.where("label = 1"))), "k int, silhouette double")


@query()
def pca_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = _data(spark, sf_dir)
    return ml.two_components(ml.scaled(train)).select("row_id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
