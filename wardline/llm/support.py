"""Shared plumbing of the training-data operators: written tables, skew-safe joins, small helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import ship_package

#: Share of all rows from which one key counts as hot. At most 1 / HOT_SHARE keys can be that large.
HOT_SHARE = 0.001
#: Rows of a hot key that are joined in one piece.
PIECE_ROWS = 10_000

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own_folder:
        _own_folder["dir"] = tempfile.mkdtemp(prefix="wardline-")
        atexit.register(shutil.rmtree, _own_folder["dir"], True)
    return f"file://{_own_folder['dir']}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends."""
    ship_package(spark)
    path = f"{shared_folder(spark)}/wardline-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_delete, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder is the cluster's to clear
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: ends the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digest(*cols: Column) -> list[Column]:
    """128 bits of the columns' values as two longs, h1 and h2."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(7), *cols, F.lit(11)).alias("h2")]


def keyed_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows to a table that has one row per key and the number of rows of that key in column `size`.

    Keys above HOT_SHARE of all rows number at most 1 / HOT_SHARE, so that part of `groups` is broadcast whatever the
    data; its rows never meet in one task. The other keys are small by definition and are shuffled.
    """
    limit = max(10_000, int(total * HOT_SHARE))
    hot, cold = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    hot_keys = F.broadcast(hot.select(*keys))
    hit = rows.join(F.broadcast(hot), keys, "inner")
    return hit.unionByName(rows.join(hot_keys, keys, "left_anti").join(cold, keys, how))


def hot_groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys with more than HOT_SHARE of the rows, and into how many pieces of about PIECE_ROWS their rows are dealt.

    They number at most 1 / HOT_SHARE, whatever the data.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    limit = max(PIECE_ROWS, int(rows.count() * HOT_SHARE))
    return sizes.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / PIECE_ROWS).cast("int").alias("pieces"))


def copies_join(few: DataFrame, many: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """few joined to many, whose rows of hot keys are dealt into pieces, so that no task gets all rows of one key."""
    wide = F.broadcast(hot)
    dealt = many.join(wide, keys, "left").withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[c for c in many.columns if c not in keys]), F.col("pieces")))).drop("pieces")
    each = few.join(wide, keys, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1))).drop("pieces")
    return each.join(dealt.withColumn("piece", F.col("piece").cast("int")), [*keys, "piece"]).drop("piece")


def unit_interval(*cols: Column) -> Column:
    """A reproducible uniform number in (0, 1) made from the columns' values."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
