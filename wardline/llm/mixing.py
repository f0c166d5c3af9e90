"""A mix of sources at target shares.

Method: weighted sampling without replacement by exponential keys (Efraimidis and Spirakis): key = -ln(u) / weight, the
smallest keys first. Within a cell the keys are summed up to the cell's budget; whole passes over a small cell come
before the fraction that is sampled. The running sum runs over bins of the key, and only the bin in which the budget is
met is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.support import cut, keyed_join, unit_interval

#: Bins per unit of ln(key): a bin holds less than a ten-thousandth of its cell's expected rows.
BINS_PER_E = 4096
LEAST_WEIGHT = 0.01


def source_name(source: Column) -> Column:
    """A source without regard to letter case, outer white space and the signs between words."""
    words = F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}\p{M}]+", "_")
    return F.regexp_replace(words, "^_+|_+$", "")


def plan_mix(rows: DataFrame, targets: DataFrame, size_col: str | None = None, total: float | None = None) -> DataFrame:
    """One row per target cell: source, label, target_share, max_repeats, rows, available, budget, epochs, rest, reached_share,
    short, whole (the size of the mix), as planned; mix_report gives what was drawn.

    Sizes are rows unless size_col names one (null or negative sizes count as 0). The mix is as large as the input,
    null sources and labels included, unless `total` says otherwise. A cell without rows reaches nothing; null shares
    and repeats count as 0. Targets named twice are separate cells of equal rows.
    """
    size = F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("double"), F.lit(0.0)), F.lit(0.0)) if size_col else F.lit(1.0)
    own = rows.select(source_name(F.col("source")).alias("cell"), F.col("label").cast("int").alias("label"), size.alias("size"))
    counts = cut(own.groupBy("cell", "label").agg(F.count("*").alias("rows"), F.sum("size").alias("available")), "p3-cells")
    whole = F.lit(float(total if total is not None else counts.agg(F.sum("available")).first()[0] or 0.0))
    t = targets.select("source", F.col("label").cast("int").alias("label"), F.coalesce(F.col("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeats"), F.lit(0)).alias("max_repeats"), source_name(F.col("source")).alias("cell"))
    joined = t.join(counts, ["cell", "label"], "left").fillna({"rows": 0, "available": 0.0})
    budget = F.round(F.col("target_share").cast("decimal(18,9)") * F.round(whole, 3).cast("decimal(28,3)"), 6).cast("decimal(38,6)")
    most = F.col("max_repeats").cast("decimal(12,0)") * F.col("available").cast("decimal(25,6)")
    planned = joined.withColumn("budget", budget.cast("double")).withColumn("short", budget > most).withColumn("epochs", F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")), F.col("max_repeats"))).otherwise(0).cast("int"))
    planned = planned.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.greatest(F.round(F.col("budget"), 0) - F.col("epochs") * F.col("available"), F.lit(0.0))).otherwise(0.0))
    reached = F.least(F.col("epochs") * F.col("available") + F.col("rest"), F.col("max_repeats") * F.col("available"))
    return planned.withColumn("reached_share", F.when(whole > 0, reached / whole).otherwise(0.0)).withColumn("whole", whole).select("cell", "source", "label", "target_share", "max_repeats", "rows", "available", "budget", "epochs", "rest", "reached_share", "short", "whole")


def draw_mix(rows: DataFrame, targets: DataFrame, id_col: str = "row_id", quality_col: str = "quality", size_col: str | None = None, total: float | None = None, seed: int = 17) -> DataFrame:
    """One row per drawn row: row_id, source, label, uses (how often it is in the mix, at least once). See draw."""
    return draw(rows, targets, id_col, quality_col, size_col, total, seed)[1].select("row_id", "source", "label", "uses")


def draw(rows: DataFrame, targets: DataFrame, id_col: str = "row_id", quality_col: str = "quality", size_col: str | None = None, total: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(plan, drawn rows): the plan of plan_mix, and row_id, source, label, target_share, max_repeats, size, uses.

    A row's weight is its quality, at least LEAST_WEIGHT; null, NaN and negative qualities count as that. The draw
    depends on the ids and the seed alone. Sums stop before the budget is exceeded. Rows outside the target cells, and
    rows of cells with budget 0, are not drawn.
    """
    plan = cut(plan_mix(rows, targets, size_col, total), "p3-plan")
    size = F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("double"), F.lit(0.0)), F.lit(0.0)) if size_col else F.lit(1.0)
    q = F.col(f"`{quality_col}`").cast("double")
    weight = F.when(q.isNull() | F.isnan(q) | (q < LEAST_WEIGHT), F.lit(LEAST_WEIGHT)).otherwise(q)
    own = rows.select(F.col(f"`{id_col}`").alias("row_id"), source_name(F.col("source")).alias("cell"), F.col("label").cast("int").alias("label"), size.alias("size"), (-F.log(unit_interval(F.lit(seed), F.col(f"`{id_col}`"))) / weight).alias("key"))
    all_rows = rows.count()
    keyed = keyed_join(own, plan, ["cell", "label"], "rows", all_rows).withColumn("bin", F.floor(F.log("key") * BINS_PER_E))
    sums = keyed.where("rest > 0").groupBy("cell", "label", "rest", "bin").agg(F.sum("size").alias("in_bin"))
    up = Window.partitionBy("cell", "label").orderBy("bin")
    cuts = cut(sums.withColumn("before", F.sum("in_bin").over(up) - F.col("in_bin")).where("before < rest and before + in_bin >= rest").select("cell", "label", F.col("bin").alias("cut_bin"), "before"), "p3-cuts")
    limits = plan.join(cuts, ["cell", "label"], "left")
    judged = keyed_join(own, limits, ["cell", "label"], "rows", all_rows).withColumn("bin", F.floor(F.log("key") * BINS_PER_E))
    border = judged.where("rest > 0 and bin = cut_bin")
    run = F.sum("size").over(Window.partitionBy("cell", "label").orderBy("key", "row_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = border.withColumn("extra", (F.col("before") + run <= F.col("rest")).cast("int"))
    clear = judged.where("rest <= 0 or cut_bin is null or bin <> cut_bin").withColumn("extra", F.when((F.col("rest") > 0) & (F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin"))), 1).otherwise(0))
    both = clear.unionByName(taken)
    return plan, both.withColumn("uses", F.col("epochs") + F.col("extra")).where("uses > 0").select("row_id", "source", "label", "target_share", "max_repeats", "size", "uses")


def mix_report(plan: DataFrame, drawn: DataFrame) -> DataFrame:
    """Per target cell: source, label, target_share, reached_share, rows, epochs, short, all of what was drawn.

    reached_share is the size of the drawn rows, each as often as it is used, over that of the whole mix. A cell is short
    if all its rows are used up and its budget is not met.
    """
    key = ["source", "label", "target_share", "max_repeats"]
    used = drawn.groupBy(*key).agg(F.sum(F.col("uses") * F.col("size")).alias("used"), F.min("uses").alias("least"), F.count("*").alias("drawn"))
    used = used.withColumnsRenamed({k: f"u_{k}" for k in key})
    joined = plan.join(used, [F.col(k).eqNullSafe(F.col(f"u_{k}")) for k in key], "left")
    had = F.coalesce(F.col("used").cast("double"), F.lit(0.0))
    spent = (F.col("rows") == 0) | (F.col("max_repeats") <= 0) | ((F.col("drawn") >= F.col("rows")) & (F.col("least") >= F.col("max_repeats")))
    share = F.when(F.col("whole") > 0, had / F.col("whole")).otherwise(0.0)
    return joined.select("source", "label", "target_share", share.alias("reached_share"), "rows", "epochs", F.coalesce(spent & (F.col("budget") > had), F.lit(False)).alias("short"))
