"""Building and profiling the labelled corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# The blocks of characters above the first one that counts, in the order in which they are tried.
SCRIPTS_ABOVE = 0x400
SCRIPT_BLOCKS = [("Cyrillic", 0x400, 0x4FF), ("Arabic", 0x600, 0x6FF), ("Japanese", 0x3040, 0x30FF), ("CJK", 0x4E00, 0x9FFF), ("Korean", 0xAC00, 0xD7FF), ("Devanagari", 0x900, 0x97F), ("Greek", 0x370, 0x3FF), ("Hebrew", 0x5D0, 0x5FF)]


def stable_order(*cols: str, seed: str = "42") -> Column:
    """A shuffle that any engine reproduces: the MD5 of the values and the seed."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(seed)))


def clean(rows: DataFrame) -> DataFrame:
    """Rows with a valid label and a text that isn't blank."""
    return rows.where(F.col("label").isin(0, 1) & F.col("text").rlike(r"(?U)\S"))


def keyed_text(text: Column) -> Column:
    return F.lower(F.trim(text))


def exact_dedup(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """Of rows with an equal text the first by `order`; aggregates before it shuffles."""
    others = [c for c in rows.columns if c not in ("text", order)]
    best = rows.groupBy(F.col("text")).agg(F.min_by(F.struct(*others), order).alias("_row"), F.min(order).alias(order))
    return best.select(order, "text", *[F.col(f"_row.{c}").alias(c) for c in others])


def duplicate_counts(rows: DataFrame) -> DataFrame:
    """Per source, rows whose text occurs more than once, the first included, and all rows."""
    texts = rows.groupBy("text").agg(F.count("*").alias("n"))
    return texts.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicate_rows"), F.count("*").alias("distinct_texts"))


def label_conflicts(rows: DataFrame) -> DataFrame:
    """Texts, without regard to case and outer blanks, that carry several labels."""
    return rows.groupBy(keyed_text(F.col("text")).alias("text_key")).agg(F.count_distinct("label").alias("labels"), F.count("*").alias("n")).where("labels > 1")


def overlapping(rows: DataFrame, others: DataFrame, keep: bool) -> DataFrame:
    """rows whose text the others have too (keep) or don't (not keep)."""
    keys = others.select(keyed_text(F.col("text")).alias("_k")).distinct()
    return rows.withColumn("_k", keyed_text(F.col("text"))).join(keys, "_k", "left_semi" if keep else "left_anti").drop("_k")


def stratified_split(rows: DataFrame, share: float = 0.19, key: str = "row_id", label: str = "label") -> DataFrame:
    """rows with part: per label, the first round(share * n) rows in stable order are test, the others train.

    The cut is found from counts of two-byte prefixes of the order, so that no label is sorted in one task.
    """
    ordered = rows.withColumn("_h", stable_order(key)).withColumn("_b", F.substring("_h", 1, 4))
    counts = ordered.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    up = Window.partitionBy(label).orderBy("_b")
    cum = counts.withColumn("_cum", F.sum("_n").over(up)).withColumn("_want", F.round(F.sum("_n").over(Window.partitionBy(label)) * share).cast("bigint"))
    cut = cum.where((F.col("_cum") - F.col("_n") < F.col("_want")) & (F.col("_cum") >= F.col("_want"))).select(label, F.col("_b").alias("_cut"), (F.col("_want") - F.col("_cum") + F.col("_n")).alias("_left"))
    joined = ordered.join(F.broadcast(cut), label, "left")
    edge = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    border = joined.where(F.col("_b") == F.col("_cut")).withColumn("part", F.when(edge <= F.col("_left"), "test").otherwise("train"))
    clear = joined.where(F.col("_cut").isNull() | (F.col("_b") != F.col("_cut"))).withColumn("part", F.when(F.col("_b") < F.col("_cut"), "test").otherwise("train"))
    return clear.unionByName(border).drop("_h", "_b", "_cut", "_left")


def group_split(rows: DataFrame, group: str = "template_id", share: float = 0.19) -> DataFrame:
    """rows with part: the first ceil(share * groups) groups in stable order are test, with all their rows."""
    groups = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n")).withColumn("_h", stable_order(group)).withColumn("_b", F.substring("_h", 1, 3))
    buckets = groups.groupBy("_b").agg(F.count("*").alias("_c"))
    want = F.ceil(F.sum("_c").over(Window.partitionBy()) * share)
    before = buckets.withColumn("_before", F.sum("_c").over(Window.orderBy("_b")) - F.col("_c")).withColumn("_want", want).drop("_c")  # at most 4,096 rows
    ranked = groups.join(F.broadcast(before), "_b").withColumn("_rank", F.row_number().over(Window.partitionBy("_b").orderBy("_h", group)) + F.col("_before"))
    parts = ranked.select(group, F.when(F.col("_rank") <= F.col("_want"), "test").otherwise("train").alias("part"))
    return rows.join(parts, group)


def cap_per_group(rows: DataFrame, group: str, n: int, key: str = "row_id") -> DataFrame:
    """At most n rows per group, in stable order; Spark limits each task's part before the shuffle."""
    w = Window.partitionBy(group).orderBy(stable_order(key), key)
    return rows.withColumn("round", F.row_number().over(w)).where(F.col("round") <= n)


def round_robin(rows: DataFrame, group: str, per_group: int, target: int, key: str = "row_id") -> DataFrame:
    """Up to target rows, one of each group per round, groups in stable order."""
    capped = cap_per_group(rows, group, per_group, key)
    return capped.orderBy("round", stable_order(group), group).limit(target)


def length_stats(rows: DataFrame, by: str = "label") -> DataFrame:
    """min, median, mean, max and 95th percentile of the length per group, all exact."""
    n = F.length("text")
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min(n).alias("min_len"), F.expr("percentile(length(text), 0.5)").alias("median_len"), F.avg(n).alias("mean_len"), F.max(n).alias("max_len"), F.expr("percentile(length(text), 0.95)").alias("p95_len"))


def histogram(rows: DataFrame, value: Column, by: str, bins: int = 60) -> DataFrame:
    """Counts of equal-width bins from the least to the greatest value, per group. The range is one small aggregate."""
    lo, hi = rows.agg(F.min(value), F.max(value)).first()
    width = ((hi - lo) / bins) if lo is not None and hi > lo else 1.0
    at = F.least(F.floor((value - F.lit(lo or 0)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return rows.where(value.isNotNull()).groupBy(by, at.alias("bin")).agg(F.count("*").alias("n"))


def script_of(ch: Column) -> Column:
    """The script block of a character above U+0400; null for those up to there."""
    cp = F.ascii(ch)  # the code point of the first character, in Spark
    return F.when(cp > SCRIPTS_ABOVE, F.coalesce(*[F.when(cp.between(lo, hi), name) for name, lo, hi in SCRIPT_BLOCKS], F.lit("other")))


def script_histogram(rows: DataFrame) -> DataFrame:
    """Characters above U+0400 per script. Equal characters are counted before scripts are looked up."""
    chars = rows.select(F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))
    return chars.withColumn("script", script_of(F.col("ch"))).where("script is not null").groupBy("script").agg(F.sum("n").alias("n"))


def imbalance(rows: DataFrame) -> DataFrame:
    """Counts per label, negatives to a positive, and what that calls for: below 2 balanced weights suffice, below 4 they are
    recommended, else (or without positives, where the ratio is null) resampling."""
    c = rows.agg(F.count_if(F.col("label") == 0).alias("negatives"), F.count_if(F.col("label") == 1).alias("positives"))
    ratio = F.when(F.col("positives") > 0, F.col("negatives") / F.col("positives"))
    return c.withColumn("ratio", F.round(ratio, 4)).withColumn("decision", F.when(ratio < 2, "balanced").when(ratio < 4, "weight").otherwise("resample"))


def class_weights(rows: DataFrame) -> DataFrame:
    """n / (2 n_c) per label, and negatives / positives for label 1."""
    c = rows.groupBy("label").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy())
    return c.withColumn("balanced_weight", F.round(whole / (2 * F.col("n")), 6)).withColumn("pos_weight", F.when(F.col("label") == 1, F.round((whole - F.col("n")) / F.col("n"), 6)))
