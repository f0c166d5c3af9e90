"""Queries over metrics, statistics, evasion and admission control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import mutate
from wardline.operators import admission, errors, evasion, metrics
from wardline.plans.registry import query, table
from wardline.session import spread

_V = "WITH v AS (SELECT row_id, label, quality, quality >= 0.7::DOUBLE AS hit FROM combined_dataset WHERE label IN (0, 1) AND quality IS NOT NULL AND NOT isnan(quality))"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "combined_dataset").where("label in (0, 1) and quality is not null and not isnan(quality)").select("row_id", "label", "quality")


def _confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_scored(spark, sf_dir), F.col("label"), (F.col("quality") >= 0.7).cast("int"))


_MATRIX = _V + ", c AS (SELECT count_if(label = 0 AND NOT hit) AS tn, count_if(label = 0 AND hit) AS fp, count_if(label = 1 AND NOT hit) AS fn, count_if(label = 1 AND hit) AS tp FROM v) "


@query(_MATRIX + "SELECT * FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _confusion(spark, sf_dir)


@query(_MATRIX + "SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rates(_confusion(spark, sf_dir))


_RANKS = _V + """, d AS (SELECT quality, count(*) AS n, sum(label) AS pos FROM v GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY quality) - n + (n + 1) / 2 AS rk FROM d),
t AS (SELECT CAST(sum(pos) AS BIGINT) AS n1, CAST(sum(n - pos) AS BIGINT) AS n0, sum(pos * rk) - sum(pos) * (sum(pos) + 1) / 2 AS u, CAST(sum(CAST(n AS DOUBLE) * n * n - n) AS DOUBLE) AS tie FROM r) """


@query(_RANKS + "SELECT n1, n0, round(u, 1) AS u, round(u / (n1::DOUBLE * n0), 6) AS auc, round((u - n1::DOUBLE * n0 / 2) / sqrt(n1::DOUBLE * n0 / 12 * ((n1 + n0 + 1) - tie / ((n1 + n0)::DOUBLE * (n1 + n0 - 1)))), 4) AS z FROM t")
def mann_whitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rank_sums(_scored(spark, sf_dir), "quality", "label")


@query(_RANKS + "SELECT round(u / (n1::DOUBLE * n0), 6) AS auc FROM t")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rank_sums(_scored(spark, sf_dir), "quality", "label").select("auc")


_CURVE = _V + ", d AS (SELECT quality, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM v GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY quality DESC) AS tp, sum(neg) OVER (ORDER BY quality DESC) AS fp FROM d) "


@query(_CURVE + "SELECT quality AS threshold, round(tp / (SELECT sum(pos) FROM d), 6) AS tpr, round(fp / (SELECT sum(neg) FROM d), 6) AS fpr FROM c")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_points(_scored(spark, sf_dir), "quality", "label")


@query(_CURVE + "SELECT round(sum(pos * tp / (tp + fp)) / sum(pos), 6) AS average_precision FROM c")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(_scored(spark, sf_dir), "quality", "label")


@query(_V + "SELECT row_id, label, quality FROM v WHERE hit AND label = 0 ORDER BY quality DESC, row_id LIMIT 10")
def error_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where("quality >= 0.7D and label = 0").orderBy(F.desc("quality"), "row_id").limit(10)


@query("""
SELECT lower(trim(source)) AS technique, count(*) AS total, count_if(label = 1) AS injections, count_if(label = 0) AS benign, round(avg(CASE WHEN (quality >= 0.5::DOUBLE) = (label = 1) THEN 1 ELSE 0 END), 4) AS accuracy,
 round(coalesce(avg(CASE WHEN label = 1 THEN CASE WHEN quality >= 0.5::DOUBLE THEN 1 ELSE 0 END END), 0), 4) AS injection_recall
FROM combined_dataset WHERE label IN (0, 1) AND quality IS NOT NULL AND NOT isnan(quality) AND source IS NOT NULL AND split IS NOT NULL AND lower(trim(split)) = 'test' GROUP BY 1
""")
def probe_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "combined_dataset").where("label in (0, 1) and quality is not null and not isnan(quality) and source is not null and lower(trim(split)) = 'test'")
    return metrics.probe_report(rows.withColumn("technique", F.lower(F.trim("source"))), "technique", "label", (F.col("quality") >= 0.5).cast("int"))


@query()
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "combined_dataset").where("label in (0, 1) and text is not null and quality is not null and not isnan(quality)").select("row_id", "text", "label", "quality"))
    return errors.error_report(rows, "quality")


_N = "SELECT l_quantity::DOUBLE AS quantity, l_extendedprice::DOUBLE AS price, l_discount::DOUBLE AS discount, l_tax::DOUBLE AS tax, l_returnflag AS flag FROM lineitem"
_NAMES = ["quantity", "price", "discount", "tax"]


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("CAST(l_quantity AS DOUBLE) quantity", "CAST(l_extendedprice AS DOUBLE) price", "CAST(l_discount AS DOUBLE) discount", "CAST(l_tax AS DOUBLE) tax", "l_returnflag flag")


@query(f"WITH n AS ({_N}) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM n" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]))
def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.correlations(_numbers(spark, sf_dir), _NAMES).withColumn("r", F.col("r") + F.lit(0.0))


@query(f"WITH n AS ({_N}), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0 AS r FROM n" for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]) + ") SELECT * FROM p ORDER BY abs(r) DESC, a, b LIMIT 3")
def top_correlated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_correlation(spark, sf_dir).orderBy(F.desc(F.abs("r")), "a", "b").limit(3)


@query(f"WITH n AS ({_N}), p AS (" + " UNION ALL ".join(f"SELECT flag, '{c}' AS feature, round(avg({c}) - (SELECT avg({c}) FROM n), 6) + 0.0 AS delta FROM n GROUP BY 1" for c in _NAMES) + ") SELECT flag, feature, delta, CAST(row_number() OVER (PARTITION BY flag ORDER BY abs(delta) DESC, feature) AS INT) AS rank FROM p QUALIFY row_number() OVER (PARTITION BY flag ORDER BY abs(delta) DESC, feature) <= 3")
def group_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.group_deltas(_numbers(spark, sf_dir), "flag", _NAMES).withColumn("delta", F.col("delta") + F.lit(0.0))


@query(f"WITH n AS ({_N}) SELECT " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM n)) / (SELECT stddev_pop({c}) FROM n), 6) + 0.0 AS {c}" for c in _NAMES) + ", flag FROM n")
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.standardised(_numbers(spark, sf_dir), _NAMES)
    return rows.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in _NAMES})


_HOMOGLYPHS = ("aeopcxiy", "аеорсхіу")
_WIDE = ("".join(map(chr, range(97, 123))), "".join(map(chr, range(0xFF41, 0xFF5B))))


@query(f"""
WITH r AS (SELECT row_id, text FROM combined_dataset WHERE text IS NOT NULL)
SELECT row_id, 'homoglyph' AS kind, translate(text, '{_HOMOGLYPHS[0]}', '{_HOMOGLYPHS[1]}') AS evaded FROM r
UNION ALL SELECT row_id, 'zero_width', regexp_replace(text, '((?:[A-Za-z][^A-Za-z]*){{2}}[A-Za-z])', '\\1' || chr(8203), 'g') FROM r
UNION ALL SELECT row_id, 'fullwidth', translate(text, '{_WIDE[0]}', '{_WIDE[1]}') FROM r
UNION ALL SELECT row_id, 'leetspeak', translate(text, 'aeiostAEIOST', '431057431057') FROM r
""")
def mutators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evasion.mutated(table(spark, sf_dir, "combined_dataset").where("text is not null").select("row_id", "text"), "text").select("row_id", "kind", "evaded")


_TRANSLATE = {k: (f"translate(text, '{a}', '{b}')") for k, (a, b) in {"homoglyph": ("aeopcxiy", "аеорсхіу"), "leetspeak": ("aeiostAEIOST", "431057431057")}.items()}


@query(" UNION ALL ".join(f"SELECT row_id, '{k}' AS kind, md5({e}) AS evaded FROM combined_dataset WHERE text IS NOT NULL" for k, e in _TRANSLATE.items()))
def mutated_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evasion.mutated(table(spark, sf_dir, "combined_dataset").where("text is not null").select("row_id", "text"), "text")
    return rows.where(F.col("kind").isin(*_TRANSLATE)).select("row_id", "kind", F.md5("evaded").alias("evaded"))


def _attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "combined_dataset").where("label = 1 and text is not null").select("row_id", "text"))


@query()
def evasion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evasion.evasion_rates(evasion.paired_verdicts(_attacks(spark, sf_dir), "text"))


def _compared(spark: SparkSession) -> DataFrame:
    rows = evasion.seed_cycle(spark, 300)
    before, after = (evasion.evasion_rates(evasion.paired_verdicts(rows, "prompt", n)) for n in (False, True))
    return evasion.compare(before, after)


@query()
def evasion_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark)


@query()
def evasion_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evasion.overall(_compared(spark))


@query()
def benign_fp_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "combined_dataset").where("label = 0 and text is not null").select("row_id", "text"))
    return evasion.blocked_by_rules(rows, "text", True).agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked"), F.round(F.avg(F.col("blocked").cast("int")), 6).alias("fp_rate"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


_R = "WITH q AS (SELECT event_id AS request_id, user_id AS key, epoch_us(ts) // 1000 AS ms FROM events)"


@query(_R + """, d AS (SELECT key, ms, count(*) OVER (PARTITION BY key ORDER BY ms RANGE BETWEEN 3599999 PRECEDING AND 1 PRECEDING) AS before FROM (SELECT DISTINCT key, ms FROM q))
SELECT q.request_id, q.key, q.ms, before + CAST(row_number() OVER (PARTITION BY q.key, q.ms ORDER BY request_id) > 1 AS INT) AS in_window, before + CAST(row_number() OVER (PARTITION BY q.key, q.ms ORDER BY request_id) > 1 AS INT) < 3 AS allowed FROM q JOIN d ON q.key = d.key AND q.ms = d.ms
""")
def rate_limit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.log_rate_limit(_requests(spark, sf_dir), limit=3, window_ms=3_600_000)


@query("WITH RECURSIVE" + _R[4:] + """,
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, request_id) AS n FROM q),
w AS (SELECT request_id, key, ms, n, true AS allowed, [ms] AS kept FROM o WHERE n = 1
 UNION ALL SELECT o.request_id, o.key, o.ms, o.n, len(list_filter(w.kept, lambda x: x > o.ms - 3600000)) < 3,
  CASE WHEN len(list_filter(w.kept, lambda x: x > o.ms - 3600000)) < 3 THEN list_append(list_filter(w.kept, lambda x: x > o.ms - 3600000), o.ms) ELSE w.kept END
 FROM w JOIN o ON o.key = w.key AND o.n = w.n + 1)
SELECT request_id, key, ms, allowed FROM w
""")
def rate_limit_accepting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.accepting_rate_limit(_requests(spark, sf_dir), limit=3, window_ms=3_600_000)


@query(_R + "SELECT request_id, (SELECT count(*) FROM q o WHERE (o.ms < q.ms OR o.ms = q.ms AND o.request_id < q.request_id) AND o.ms + 600000 > q.ms) AS running FROM q")
def concurrency_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = _requests(spark, sf_dir).select("request_id", F.col("ms").alias("start_ms"), (F.col("ms") + 600_000).alias("end_ms"))
    return admission.concurrency(open_, 10).select("request_id", "running")


_STATUS = "CASE WHEN event_type = 'error' THEN 503 WHEN value > 100 THEN 429 WHEN value > 60 THEN 404 ELSE 200 END"


@query(f"SELECT event_type, CASE {_STATUS} WHEN 503 THEN 'ERROR' WHEN 200 THEN 'INFO' ELSE 'WARNING' END AS level, count(*) AS n FROM events GROUP BY 1, 2")
def latency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", admission.log_level(F.expr(_STATUS)).alias("level")).agg(F.count("*").alias("n"))


@query(f"SELECT status, count(*) AS n FROM (SELECT {_STATUS} AS status FROM events WHERE event_type IN ('click', 'purchase', 'error')) GROUP BY 1")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    guarded = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase", "error"))
    return guarded.groupBy(F.expr(_STATUS).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def route_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "purchase")).groupBy("event_type").agg(F.count("*").alias("n"))
