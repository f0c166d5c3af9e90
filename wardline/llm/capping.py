"""At most so many rows per contributor, the best by quality.

Method: mergeable histograms of quality per contributor give the bin in which its cap is met. Rows in better bins stay,
rows in worse ones go, and only the rows of that one bin are ranked. Where that bin is still large it gets a finer
histogram, over quality and, among equal qualities, over the id, until it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.support import cut, keyed_join

BINS = 1024
#: Rows of one contributor that may be ranked in one task.
RANK_ROWS = 200_000
LEVELS = 12


#: Stands for an infinite score while scores are placed in bins.
FAR = 1.7e308


def _finite(score: Column) -> Column:
    return F.when(F.isnan(score), None).when(score > FAR, FAR).when(score < -FAR, -FAR).otherwise(score)


def _place(rows: DataFrame, span: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their bin (higher is better), and the histogram. span: per key the range of score and id and the count."""
    by_score = F.col("s_lo") < F.col("s_hi")
    width = F.greatest(F.col("s_hi") / BINS - F.col("s_lo") / BINS, F.lit(1e-300))
    score_bin = F.when(F.col("score").isNull(), -1).otherwise(F.greatest(F.least(F.floor(F.col("score") / width - F.col("s_lo") / width), F.lit(BINS)), F.lit(0)))
    step = F.greatest(F.ceil((F.col("i_hi") - F.col("i_lo") + 1) / BINS), F.lit(1))
    id_bin = F.when(F.col("score").isNull() & F.col("s_hi").isNotNull(), -BINS - 2).otherwise(-F.floor((F.col("row_id") - F.col("i_lo")) / step))
    placed = keyed_join(rows, span, ["key"], "size", total).withColumn("bin", F.when(by_score, score_bin).otherwise(id_bin).cast("bigint"))
    placed = cut(placed.select(*rows.columns, "need", "size", "bin"), "p7-placed")
    return placed, placed.groupBy("key", "need", "bin").agg(F.count("*").alias("n"))


def _cutoffs(histogram: DataFrame) -> DataFrame:
    """Per key the bin in which `need` is met, what is still needed of it and its size; keys below their cap have none."""
    down = Window.partitionBy("key").orderBy(F.desc("bin"))
    summed = histogram.withColumn("before", F.sum("n").over(down) - F.col("n"))
    return summed.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need"))).select("key", F.col("bin").alias("cut_bin"), (F.col("need") - F.col("before")).alias("left"), F.col("n").alias("at_cut"))


def _span(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.min("score").alias("s_lo"), F.max("score").alias("s_hi"), F.min("row_id").alias("i_lo"), F.max("row_id").alias("i_hi"), F.max("need").alias("need"), F.count("*").alias("size"))


def cap_contributors(rows: DataFrame, key_col: str, score_col: str, id_col: str = "row_id", max_rows: int | None = None, max_share: float | None = None) -> DataFrame:
    """One row per input row that has a contributor: row_id, key, score, keep.

    The cap is max_rows, or max_share of all rows that have a contributor, or the smaller of both. Rows rank by score
    from high to low, null and NaN last, ties by smaller id. Rows without contributor are not capped and do not come
    out here. Scores come out as given; infinite ones rank as such. Ids are integers; with repeated ids the order among them is arbitrary.
    """
    own = rows.where(F.col(f"`{key_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("row_id"), F.col(f"`{key_col}`").alias("key"), F.col(f"`{score_col}`").cast("double").alias("as_given"))
    own = own.withColumn("score", _finite(F.col("as_given")))
    shown = ["row_id", "key", F.col("as_given").alias("score"), "keep"]
    total = own.count()
    caps = [int(c) for c in (max_rows, None if max_share is None else int(max_share * total)) if c is not None]
    if not caps:
        raise ValueError("give max_rows or max_share")
    cap = max(0, min(caps))
    if cap == 0:
        return own.withColumn("keep", F.lit(False)).select(*shown)
    best = [F.desc_nulls_last("score"), F.asc_nulls_last("row_id")]
    todo, done = own.withColumn("need", F.lit(cap).cast("bigint")), []
    for _ in range(LEVELS):
        span = cut(_span(todo), "p7-span")
        placed, histogram = _place(todo.drop("need"), span, total)
        cuts = cut(span.select("key", "need", "size").join(_cutoffs(histogram), "key", "left"), "p7-cuts")
        judged = keyed_join(placed.drop("need", "size"), cuts, ["key"], "size", total)
        verdict = F.when(F.col("cut_bin").isNull() | (F.col("bin") > F.col("cut_bin")), True).when(F.col("bin") < F.col("cut_bin"), False).when(F.col("left") == F.col("at_cut"), True)
        judged = cut(judged.withColumn("keep", verdict), "p7-judged")
        done.append(judged.where("keep is not null").select(*shown))
        border = judged.where("keep is null").select("row_id", "key", "as_given", "score", F.col("left").alias("need"), "at_cut")
        rank = F.row_number().over(Window.partitionBy("key").orderBy(*best))
        done.append(border.where(F.col("at_cut") <= RANK_ROWS).withColumn("keep", rank <= F.col("need")).select(*shown))
        if not cuts.where((F.col("at_cut") > RANK_ROWS) & (F.col("left") < F.col("at_cut"))).limit(1).count():
            break
        todo = cut(border.where(F.col("at_cut") > RANK_ROWS).drop("at_cut"), "p7-border")
    else:
        done.append(todo.withColumn("keep", F.row_number().over(Window.partitionBy("key").orderBy(*best)) <= F.col("need")).select(*shown))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
