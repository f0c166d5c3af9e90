"""Writing results: CSV, JSON reports, models, fingerprints of artefacts and their check."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.sources.readers import exists, file_digests

BOOKKEEPING = ["template_id"]


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with header, without the columns that only the build needs. White space around values is kept."""
    rows.drop(*BOOKKEEPING).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_report(rows: DataFrame, path: str) -> None:
    """A small result as one JSON file, an object per row."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Rows added to a parquet table."""
    rows.write.mode("append").parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_manifest(spark: SparkSession, artefacts: str, path: str) -> None:
    """The SHA-256 of every file below artefacts."""
    file_digests(spark, artefacts).write.mode("overwrite").json(path)


def changed_artefacts(spark: SparkSession, artefacts: str, manifest: str | None) -> DataFrame:
    """name, expected, actual of files that differ from the manifest; files it lacks, and a missing manifest, pass."""
    actual = file_digests(spark, artefacts).withColumnRenamed("sha256", "actual")
    if manifest is None or not exists(spark, manifest):
        return actual.withColumn("expected", F.lit(None).cast("string")).where("false").select("name", "expected", "actual")
    expected = spark.read.schema("name STRING, sha256 STRING").json(manifest).withColumnRenamed("sha256", "expected")
    return expected.join(actual, "name").where("expected <> actual").select("name", "expected", "actual")
