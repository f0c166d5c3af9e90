"""Reading the engine's inputs: CSV, JSON lines, JSON documents, parquet tables, files as bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str, lenient: bool = False) -> DataFrame:
    """A CSV with header and quoted fields that may hold line breaks. lenient skips malformed lines, else they fail."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED" if lenient else "FAILFAST")


def read_corpus_csv(spark: SparkSession, path: str, source: str, lenient: bool = False) -> DataFrame:
    """text, label, source of a labelled CSV."""
    return read_csv(spark, path, "text STRING, label INT", lenient).withColumn("source", F.lit(source))


def read_typed_prompts(rows: DataFrame, source: str) -> DataFrame:
    """text, label, source of rows (prompt, type): whatever isn't benign is an attack."""
    return rows.select(F.col("prompt").alias("text"), (F.col("type") != "benign").cast("int").alias("label"), F.lit(source).alias("source"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per line; a line that is no object is a row of nulls."""
    return spark.read.schema(schema).json(path)


def read_role_play(spark: SparkSession, path: str, category: str = "Role_Play") -> DataFrame:
    """text, label, source of the attacks of one category of a JSON lines file."""
    rows = read_jsonl(spark, path, "category STRING, prompt STRING")
    return rows.where((F.col("category") == category) & F.col("prompt").rlike(r"(?U)\S")).select(F.col("prompt").alias("text"), F.lit(1).alias("label"), F.lit("seas_role_play").alias("source")).dropDuplicates(["text"])


def read_json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file that is one document over many lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A parquet table, of which only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_csv_where(spark: SparkSession, path: str, schema: str, condition: str) -> DataFrame:
    """The rows of a CSV that meet a condition, which the scan checks as it parses."""
    return read_csv(spark, path, schema, lenient=True).where(condition)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, sha256 of each file below path, the name being what follows path, so that equal names in two folders differ."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    root = path.split("://")[-1].lstrip("/").rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("name"), F.sha2("content", 256).alias("sha256"))
