"""Queries that write with a sink and read with a source, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.plans.registry import query, table
from wardline.session import scratch_path
from wardline.sources import readers, sinks

_SEEN = "text IS NOT NULL AND text <> ''"


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "combined_dataset").where(_SEEN)


@query(f"SELECT row_id, text, label FROM combined_dataset WHERE {_SEEN}")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    sinks.write_csv(_rows(spark, sf_dir).select("row_id", "text", "label", "template_id"), path)
    return readers.read_csv(spark, path, "row_id LONG, text STRING, label INT")


@query(f"SELECT row_id, text, CAST(label AS INT) AS label FROM combined_dataset WHERE {_SEEN} AND label IN (0, 1)")
def csv_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    sinks.write_csv(_rows(spark, sf_dir).select("row_id", "text", F.coalesce(F.when(F.col("label").isin(0, 1), F.col("label").cast("string")), F.lit("none")).alias("label")), path)
    return readers.read_csv(spark, path, "row_id LONG, text STRING, label INT", lenient=True)


@query(f"SELECT row_id, text FROM combined_dataset WHERE {_SEEN} AND label = 0")
def csv_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    sinks.write_csv(_rows(spark, sf_dir).select("row_id", "text", "label"), path)
    return readers.read_csv_where(spark, path, "row_id LONG, text STRING, label INT", "label = 0").select("row_id", "text")


@query("SELECT DISTINCT text, 1 AS label, 'seas_role_play' AS source FROM combined_dataset WHERE source = 'seas_role_play' AND regexp_matches(text, '[^\\s\\x0B\\x1C-\\x1F\\x85\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]')")
def jsonl_role_play(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    rows = table(spark, sf_dir, "combined_dataset").select(F.when(F.col("source") == "seas_role_play", "Role_Play").otherwise(F.col("source")).alias("category"), F.col("text").alias("prompt"))
    rows.write.json(path)
    return readers.read_role_play(spark, path)


@query("SELECT label, count(*) AS n FROM combined_dataset WHERE label IS NOT NULL GROUP BY 1")
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "report")
    sinks.write_report(table(spark, sf_dir, "combined_dataset").where("label is not null").groupBy("label").agg(F.count("*").alias("n")), path)
    return readers.read_jsonl(spark, path, "label INT, n LONG")


@query("SELECT id, verdict FROM classifications UNION ALL SELECT id, verdict FROM classifications WHERE confidence > 0.9")
def appended_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "append")
    rows = table(spark, sf_dir, "classifications").select("id", "verdict", "confidence")
    sinks.append(rows, path)
    sinks.append(rows.where("confidence > 0.9D"), path)
    return readers.read_table(spark, path, ["id", "verdict"])


@query()
def manifest_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that differ from their manifest, before and after one of them is written anew."""
    files, manifest = scratch_path(spark, "artefacts"), scratch_path(spark, "manifest")
    targets = table(spark, sf_dir, "split_targets").coalesce(1)
    for name in ("one", "two"):
        targets.write.json(f"{files}/{name}")
    kept = readers.file_digests(spark, files, "*.json").select("name", "sha256")
    kept.write.json(manifest)
    before = sinks.changed_artefacts(spark, files, manifest).count()
    name = sorted(r["name"] for r in kept.where("name like 'two/%'").collect())[0]
    out = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{files}/{name}")
    stream = out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(out, True)
    stream.write(bytearray(b"changed"))
    stream.close()
    return spark.createDataFrame([(before, sinks.changed_artefacts(spark, files, manifest).count())], "changed int, changed_after int")
