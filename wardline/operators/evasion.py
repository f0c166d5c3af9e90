"""How often mutated attacks pass where clean ones are blocked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import mutate
from wardline.functions.features import with_features
from wardline.functions.rules import scored


def seed_cycle(spark: SparkSession, n: int) -> DataFrame:
    """i, prompt: n prompts, the seeds over and over."""
    prompts = F.array(*[F.lit(s) for s in mutate.SEEDS])
    return spark.range(n).select(F.col("id").alias("i"), F.element_at(prompts, (F.col("id") % len(mutate.SEEDS) + 1).cast("int")).alias("prompt"))


def mutated(rows: DataFrame, text: str) -> DataFrame:
    """rows times the mutators: kind, evaded."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), f(F.col(text)).alias("evaded")) for kind, f in mutate.MUTATORS.items()])
    return rows.withColumn("_m", F.explode(pairs)).select(*rows.columns, "_m.kind", "_m.evaded")


def blocked_by_rules(rows: DataFrame, text: str, normalise: bool, prior: float = 0.3) -> DataFrame:
    """rows with blocked, the verdict of the rules alone on a fixed prior probability."""
    out = scored(with_features(rows.withColumn("_p", F.lit(prior)), text, normalise), "_p")
    return out.select(*rows.columns, (F.col("verdict") == "BLOCK").alias("blocked"))


def paired_verdicts(rows: DataFrame, text: str, normalise: bool = True) -> DataFrame:
    """rows times the mutators with clean_blocked and evaded_blocked: each text is scored clean and mutated."""
    clean = blocked_by_rules(rows, text, normalise).withColumnRenamed("blocked", "clean_blocked")
    return blocked_by_rules(mutated(clean, text), "evaded", normalise).withColumnRenamed("blocked", "evaded_blocked")


def evasion_rates(pairs: DataFrame) -> DataFrame:
    """Per kind: n, how many clean texts and how many mutated ones are blocked, and the evasion rate, which is below 0
    where mutation gets more texts blocked."""
    c = pairs.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("clean_blocked").alias("clean_blocked"), F.count_if("evaded_blocked").alias("evaded_blocked"))
    return c.withColumn("evasion_rate", F.when(F.col("n") > 0, F.round(1 - F.col("evaded_blocked") / F.greatest("clean_blocked", F.lit(1)), 4)).otherwise(0.0))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """kind, before, after, reduction of the kinds measured before, a rate that is missing after being 0."""
    b, a = before.select("kind", F.col("evasion_rate").alias("before")), after.select("kind", F.col("evasion_rate").alias("after"))
    return b.join(a, "kind", "left").fillna(0.0, ["before", "after"]).withColumn("reduction", F.col("before") - F.col("after"))


def overall(compared: DataFrame) -> DataFrame:
    """before, after: the means over the kinds, and the verdict on them: PASS at half or less, PARTIAL if lower, else FAIL."""
    m = compared.agg(F.coalesce(F.avg("before"), F.lit(0.0)).alias("before"), F.coalesce(F.avg("after"), F.lit(0.0)).alias("after"))
    return m.withColumn("outcome", F.when(F.col("after") <= F.col("before") * 0.5, "PASS").when(F.col("after") < F.col("before"), "PARTIAL").otherwise("FAIL"))
