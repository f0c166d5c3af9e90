"""Model metrics and statistics, exact and without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_value(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score the positives and negatives; null and NaN scores and other labels are left out."""
    s = F.col(score).cast("double")
    return rows.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isin(0, 1)).groupBy(s.alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((1 - F.col(label)).cast("bigint")).alias("neg"))


def running(values: DataFrame, order: str, sums: list[str], pieces: int | None = None) -> DataFrame:
    """values with cum_x for each x of sums: the sum over all rows of smaller `order`, its own left out.

    Rows are cut into pieces at quantiles, four for each core but 64 at least; each piece is summed on its own and adds
    the totals of those before it.
    """
    pieces = pieces or max(64, 4 * values.sparkSession.sparkContext.defaultParallelism)
    edges = sorted(set(values.approxQuantile(order, [k / pieces for k in range(1, pieces)], 0.01)))
    piece = F.size(F.filter(F.array(*[F.lit(e) for e in edges]).cast("array<double>"), lambda e: e < F.col(order))) if edges else F.lit(0)
    cut = values.withColumn("_piece", piece)
    totals = cut.groupBy("_piece").agg(*[F.sum(x).alias(f"_t_{x}") for x in sums])
    upto = Window.orderBy("_piece")  # one row per piece
    before = totals.select("_piece", *[(F.sum(f"_t_{x}").over(upto) - F.col(f"_t_{x}")).alias(f"_b_{x}") for x in sums])
    within = Window.partitionBy("_piece").orderBy(order)
    local = cut.withColumns({f"_l_{x}": F.sum(x).over(within) - F.col(x) for x in sums})
    joined = local.join(F.broadcast(before), "_piece")
    return joined.withColumns({f"cum_{x}": F.col(f"_l_{x}") + F.col(f"_b_{x}") for x in sums}).select(*values.columns, *[f"cum_{x}" for x in sums])


def confusion(rows: DataFrame, label: Column, predicted: Column) -> DataFrame:
    """tn, fp, fn, tp."""
    n = lambda y, p: F.count_if((label == y) & (predicted == p))
    return rows.agg(n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp"))


def rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall and f1 of a confusion matrix; a ratio over nothing is 0."""
    over = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 6)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(over(tp + tn, tp + tn + fp + fn).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(2 * tp, 2 * tp + fp + fn).alias("f1"))


def probe_report(rows: DataFrame, by: str, label: str, predicted: Column) -> DataFrame:
    """Per group of probes: total, injections, benign, accuracy, and the recall over injections alone (0 without any)."""
    hit = (predicted == F.col(label)).cast("int")
    recall = F.coalesce(F.avg(F.when(F.col(label) == 1, predicted)), F.lit(0.0))
    return rows.groupBy(by).agg(F.count("*").alias("total"), F.count_if(F.col(label) == 1).alias("injections"), F.count_if(F.col(label) == 0).alias("benign"), F.round(F.avg(hit), 4).alias("accuracy"), F.round(recall, 4).alias("injection_recall"))


def top_by_size(columns: list[str], n: int = 5) -> Column:
    """ARRAY<STRUCT<feature, value>> of the n columns farthest from 0, equal ones in the order given; values in 4 places."""
    each = F.array(*[F.struct((-F.abs(F.col(c).cast("double"))).alias("far"), F.lit(i).alias("at"), F.lit(c).alias("feature"), F.round(F.col(c).cast("double"), 4).alias("value")) for i, c in enumerate(columns)])
    return F.transform(F.slice(F.array_sort(each), 1, n), lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value")))


def rank_sums(rows: DataFrame, score: str, label: str) -> DataFrame:
    """n1, n0, u, auc, tie_term, z: the Mann-Whitney statistic of the positives with average ranks, and its tie-corrected
    normal deviate. The area under the ROC curve is u over n1 n0."""
    v = running(by_value(rows, score, label).withColumn("n", F.col("pos") + F.col("neg")), "score", ["n"])
    average = F.col("cum_n") + (F.col("n") + 1) / 2
    t = v.agg(F.sum(F.col("pos")).alias("n1"), F.sum("neg").alias("n0"), F.sum(F.col("pos") * average).alias("r1"), F.sum(F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("tie_term"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    t = t.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    n = n1 + n0
    spread = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    return t.select("n1", "n0", F.round("u", 1).alias("u"), F.round(F.when(n1 * n0 > 0, F.col("u") / (n1 * n0)), 6).alias("auc"), F.round(F.when(n1 * n0 > 0, (F.col("u") - n1 * n0 / 2) / spread), 4).alias("z"))


def two_sided_p(z: float) -> float:
    """The two-sided probability of a normal deviate."""
    from math import erfc, sqrt

    return erfc(abs(z) / sqrt(2))


def _descending(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score, in falling order: true and false positives at that threshold."""
    v = by_value(rows, score, label).withColumn("key", -F.col("score"))
    r = running(v, "key", ["pos", "neg"])
    return r.withColumns({"tp": F.col("cum_pos") + F.col("pos"), "fp": F.col("cum_neg") + F.col("neg")})


def roc_points(rows: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, tpr, fpr of every distinct score."""
    d = _descending(rows, score, label)
    whole = d.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    j = d.join(F.broadcast(whole))
    return j.select(F.col("score").alias("threshold"), F.round(F.col("tp") / F.col("p"), 6).alias("tpr"), F.round(F.col("fp") / F.col("n"), 6).alias("fpr"))


def average_precision(rows: DataFrame, score: str, label: str) -> DataFrame:
    """Sum over the thresholds of the recall gained times the precision."""
    d = _descending(rows, score, label)
    return d.agg(F.round(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos"), 6).alias("average_precision"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r of every pair of columns, from one aggregate; pairs with a constant column are left out."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    one = rows.agg(*[r(a, b).alias(f"{a}|{b}") for a, b in pairs])
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")) for a, b in pairs])
    return one.select(F.explode(listed).alias("p")).select("p.a", "p.b", F.round("p.r", 6).alias("r")).where("r is not null and not isnan(r)")


def group_deltas(rows: DataFrame, group: str, columns: list[str], top: int = 3) -> DataFrame:
    """Per group the columns whose mean differs most from the overall mean: feature, delta, ranked."""
    means = rows.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns])
    overall = rows.agg(*[F.avg(c).alias(f"all_{c}") for c in columns])
    listed = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(c) - F.col(f"all_{c}"), 6).alias("delta")) for c in columns])
    each = means.join(F.broadcast(overall)).select(group, F.explode(listed).alias("f")).select(group, "f.feature", "f.delta")
    w = Window.partitionBy(group).orderBy(F.desc(F.abs("delta")), "feature")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean over their population deviation; a constant column becomes 0."""
    stats = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    z = {c: F.when(F.col(f"s_{c}") > 0, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0) for c in columns}
    return rows.join(F.broadcast(stats)).withColumns(z).select(*rows.columns)
