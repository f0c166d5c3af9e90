"""Training, selection and use of the models on the 21 features, with MLlib."""

from __future__ import annotations

from dataclasses import dataclass
from math import pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.features import vector_columns, with_features
from wardline.operators import forest as forests
from wardline.operators import kmeans, metrics
from wardline.operators.boosting import BoostedModel, boosted
from wardline.operators.forest import Forest
from wardline.operators.kmeans import Blocks, KMeansRun
from wardline.session import materialised, spread

# The families that clusters are named by, in order, with the feature that speaks for each, and the score of
# the family no feature speaks for.
FAMILY_FEATURE = {
    "instruction_override": "f01",
    "role_play_jailbreak": "f02",
    "context_exfiltration": "f03",
    "delimiter_escape": "f04",
    "encoding_obfuscation": "f10",
    "indirect_injection": None,
}
NO_FEATURE_SCORE = 0.001


def labelled_vectors(rows: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """rows with features, the 21 as a vector, and weight, which balances the classes. Cut, as every model reads it."""
    featured = VectorAssembler(inputCols=vector_columns(), outputCol="features").transform(with_features(spread(rows), text))
    slim = materialised(featured.select(*rows.drop(text).columns, "features"))
    counts = slim.groupBy(label).agg(F.count("*").alias("_c"))
    weights = counts.select(label, (F.sum("_c").over(Window.partitionBy()) / (2 * F.col("_c"))).alias("weight"))
    return slim.join(F.broadcast(weights), label)


def logistic(data: DataFrame, label: str = "label", iterations: int = 1000) -> PipelineModel:
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True)
    fit = LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="weight", maxIter=iterations, regParam=1.0 / max(1, data.count()))
    return Pipeline(stages=[scaler, fit]).fit(data)


def forest(data: DataFrame, label: str = "label", trees: int = 300, depth: int = 20, seed: int = 42) -> Forest | PipelineModel:
    """A forest of our own, whose trees are tasks; MLlib's, which moves its histograms, where vectors are too many for that."""
    if own := forests.fit(data, label, trees, depth, 2, seed):
        return own
    return Pipeline(stages=[RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, maxBins=64, seed=seed)]).fit(data)


def boosting(data: DataFrame, label: str = "label", rounds: int = 300, depth: int = 6) -> BoostedModel:
    return boosted(data, label, rounds, depth)


def fourier_features(data: DataFrame, size: int = 256, gamma: float | None = None, seed: int = 42, scaler: StandardScalerModel | None = None) -> DataFrame:
    """data with fourier: random cosine features whose inner products approximate an RBF kernel on features scaled by
    scaler, or as data itself has it."""
    scaler = scaler or _scaler(data)
    rng = np.random.default_rng(seed)
    width = len(vector_columns())
    g = gamma if gamma is not None else 1.0 / width
    w = rng.normal(scale=sqrt(2 * g), size=(size, width))
    b = rng.uniform(0, 2 * pi, size)

    @F.arrow_udf("array<double>")
    def mapped(vectors: pa.Array) -> pa.Array:
        x = vectors.flatten().to_numpy().reshape(-1, width)
        cosines = np.cos(x @ w.T + b) * sqrt(2 / size)
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * size, cosines.ravel())

    return scaler.transform(data).withColumn("fourier", array_to_vector(mapped(vector_to_array("scaled")))).drop("scaled")


def _scaler(data: DataFrame) -> StandardScalerModel:
    return StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(data)


@dataclass
class KernelSvm:
    """The fitted stages of a kernel machine; they score any rows with features."""

    scaler: StandardScalerModel
    machine: LinearSVCModel
    calibration: LogisticRegressionModel | None
    size: int
    seed: int

    def margins(self, mapped: DataFrame) -> DataFrame:
        scored = self.machine.transform(mapped).withColumn("margin", vector_to_array("rawPrediction")[1]).drop("rawPrediction", "prediction")
        return VectorAssembler(inputCols=["margin"], outputCol="m").transform(scored)

    def probabilities(self, data: DataFrame) -> DataFrame:
        """data with p, the probability of label 1."""
        one = self.margins(fourier_features(data, self.size, seed=self.seed, scaler=self.scaler))
        return self.calibration.transform(one).withColumn("p", vector_to_array("probability")[1]).drop("m", "margin", "fourier", "probability", "rawPrediction", "prediction")


def kernel_machine(data: DataFrame, label: str = "label", size: int = 256, seed: int = 42) -> KernelSvm:
    """A linear machine on Fourier features, its margin calibrated by a logistic regression."""
    scaler = _scaler(data)
    mapped = fourier_features(data, size, seed=seed, scaler=scaler)  # cheaper to make again than to write
    machine = LinearSVC(featuresCol="fourier", labelCol=label, weightCol="weight", maxIter=50, regParam=0.001).fit(mapped)
    svm = KernelSvm(scaler, machine, None, size, seed)
    svm.calibration = LogisticRegression(featuresCol="m", labelCol=label, weightCol="weight").fit(svm.margins(mapped))
    return svm


def kernel_svm(data: DataFrame, label: str = "label", size: int = 256, seed: int = 42) -> DataFrame:
    """data with p of the kernel machine fitted on it; kernel_machine scores other rows."""
    return kernel_machine(data, label, size, seed).probabilities(data)


def probabilities(model: PipelineModel | Forest | BoostedModel | KernelSvm, data: DataFrame) -> DataFrame:
    """data with p, the probability of label 1."""
    if not isinstance(model, PipelineModel):
        return model.probabilities(data)
    return model.transform(data).withColumn("p", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction", "scaled")


def select_best(aucs: dict[str, float]) -> str:
    """The model of the highest area under the ROC curve; of equal ones the first."""
    return max(aucs, key=lambda k: aucs[k])


def importances(model: Forest | PipelineModel, top: int = 10) -> list[tuple[str, float, bool]]:
    """(feature, importance, whether in the top quartile) of a forest, highest first."""
    values = model.importances if isinstance(model, Forest) else model.stages[-1].featureImportances.toArray()
    edge = float(np.quantile(values, 0.75))
    order = sorted(range(len(values)), key=lambda i: (-values[i], i))[:top]
    names = vector_columns()
    return [(names[i], float(values[i]), bool(values[i] >= edge)) for i in order]


def best_kmeans(data: DataFrame | Blocks, k: int = 6, restarts: int = 20, column: str = "scaled") -> KMeansRun:
    """Of several runs from different seeds the one with the lowest cost; of equal ones the first. The runs share each pass."""
    return kmeans.best_of(data if isinstance(data, Blocks) else Blocks.of(data, column), k, restarts)


@dataclass
class Clusters:
    """Clusters of attacks as scoring uses them: how features are scaled, the centres, their sizes and labels."""

    means: list[float]
    deviations: list[float]
    centres: list[list[float]]
    counts: list[int]
    labels: dict[int, str]

    def cluster_id(self, features: list[Column]) -> Column:
        """The nearest centre's number; of equally near ones the first."""
        scaled = F.array(*[(f - m) / s if s > 0 else F.lit(0.0) for f, m, s in zip(features, self.means, self.deviations)])
        centres = F.array(*[F.array(*map(F.lit, centre)) for centre in self.centres])
        far = F.transform(centres, lambda c: F.aggregate(F.zip_with(scaled, c, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d))
        return (F.array_position(far, F.array_min(far)) - 1).cast("int")

    def cluster_label(self, cluster_id: Column) -> Column:
        names = F.create_map(*[F.lit(x) for pair in self.labels.items() for x in pair])
        return F.when(cluster_id.isNotNull(), F.coalesce(F.try_element_at(names, cluster_id), F.lit("unknown")))

    def top_features(self, n: int = 5) -> list[tuple[int, str, int, list[tuple[str, float]]]]:
        """(cluster, label, count, the n features in which its centre is farthest from the mean, with their values)."""
        names = vector_columns()
        out = []
        for c, centre in enumerate(self.centres):
            order = sorted(range(len(centre)), key=lambda i: (-abs(centre[i]), i))[:n]
            out.append((c, self.labels.get(c, "unknown"), self.counts[c], [(names[i], round(float(centre[i]), 4)) for i in order]))
        return out


def attack_clusters(attacks: DataFrame, k: int = 6, restarts: int = 20) -> tuple[Clusters, DataFrame]:
    """The clusters of attacks, which have features, and attacks with cluster_id."""
    names = vector_columns()
    x = vector_to_array("features")
    stats = attacks.agg(*[F.avg(x[i]).alias(f"m{i}") for i in range(len(names))], *[F.stddev_pop(x[i]).alias(f"s{i}") for i in range(len(names))]).first()
    ready = scaled(attacks)
    model = best_kmeans(ready, k, restarts)
    centres = [c.tolist() for c in model.clusterCenters()]
    clustered = model.transform(ready)
    sizes = {r["cluster_id"]: r["count"] for r in clustered.groupBy("cluster_id").count().collect()}
    clusters = Clusters([stats[f"m{i}"] for i in range(len(names))], [stats[f"s{i}"] for i in range(len(names))], centres, [sizes.get(c, 0) for c in range(len(centres))], name_clusters(centres))
    return clusters, clustered


def scaled(data: DataFrame) -> DataFrame:
    """data with scaled: features less their mean over their population deviation."""
    names = vector_columns()
    flat = data.withColumns({n: vector_to_array("features")[i] for i, n in enumerate(names)})
    return VectorAssembler(inputCols=names, outputCol="scaled").transform(metrics.standardised(flat, names)).drop(*names)


def silhouettes(data: DataFrame, ks: range = range(2, 10), restarts: int = 10) -> list[tuple[int, float]]:
    """(k, silhouette) of the best of several K-Means runs each."""
    blocks = Blocks.of(data, "scaled")
    return [(k, kmeans.silhouette(blocks, best_kmeans(blocks, k, restarts))) for k in ks]


def name_clusters(centres: list[list[float]]) -> dict[int, str]:
    """One family per cluster, greedily from the highest score of a centre; equal scores in order of cluster and family."""
    at = {n: i for i, n in enumerate(vector_columns())}
    cells = []
    for c, centre in enumerate(centres):
        for f, (family, feature) in enumerate(FAMILY_FEATURE.items()):
            score = max(0.0, centre[at[feature]]) if feature else NO_FEATURE_SCORE
            cells.append((-score, c, f, family))
    named: dict[int, str] = {}
    for _, c, _, family in sorted(cells):
        if c not in named and family not in named.values():
            named[c] = family
    return {c: named.get(c, "unknown") for c in range(len(centres))}


def nearest_members(clustered: DataFrame, key: str, n: int = 2) -> DataFrame:
    """Per cluster the n rows nearest to the mean of its raw features."""
    x = vector_to_array("features")
    names = vector_columns()
    flat = clustered.select(key, "cluster_id", *[x[i].alias(c) for i, c in enumerate(names)])
    means = flat.groupBy("cluster_id").agg(*[F.avg(c).alias(f"m_{c}") for c in names])
    square = sum(((F.col(c) - F.col(f"m_{c}")) ** 2 for c in names), F.lit(0.0))
    w = Window.partitionBy("cluster_id").orderBy("distance", key)
    near = flat.join(F.broadcast(means), "cluster_id").select(key, "cluster_id", F.sqrt(square).alias("distance"))
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def two_components(data: DataFrame) -> DataFrame:
    """data with x and y, its first two principal components on scaled features."""
    model = PCA(k=2, inputCol="scaled", outputCol="pc").fit(data)
    return model.transform(data).withColumns({"x": vector_to_array("pc")[0], "y": vector_to_array("pc")[1]}).drop("pc", "scaled", "features")
