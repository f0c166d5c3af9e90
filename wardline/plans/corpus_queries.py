"""Queries over the labelled corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import corpus as ops
from wardline.operators import near_dups
from wardline.plans.registry import query, table

_BLANK = "[\\s\\x1C-\\x1F\\x85\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_C = f"WITH c AS (SELECT * FROM combined_dataset WHERE label IN (0, 1) AND regexp_replace(text, '{_BLANK}', '', 'g') <> '')"
_PRIMARY = "lower(trim(source)) = 'primary'"
_SECONDARY = "lower(trim(source)) = 'secondary'"


def _clean(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return ops.clean(table(spark, sf_dir, "combined_dataset").select("row_id", "text", "label", *cols))


@query(_C + "SELECT source, label, count(*) AS n FROM c GROUP BY 1, 2")
def label_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clean(spark, sf_dir, "source").groupBy("source", "label").agg(F.count("*").alias("n"))


@query(_C + "SELECT count(*) AS n, count(DISTINCT text) AS texts, count(DISTINCT template_id) AS templates, round(avg(label), 6) AS attack_share FROM c")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir, "template_id")
    texts = rows.groupBy("text").agg(F.lit(1).alias("one")).agg(F.count("*").alias("texts"))
    rest = rows.agg(F.count("*").alias("n"), F.count_distinct("template_id").alias("templates"), F.round(F.avg("label"), 6).alias("attack_share"))
    return rest.join(F.broadcast(texts)).select("n", "texts", "templates", "attack_share")


@query(_C + "SELECT label, count(*) AS n, min(length(text)) AS min_len, quantile_cont(length(text), 0.5) AS median_len, avg(length(text)) AS mean_len, max(length(text)) AS max_len, quantile_cont(length(text), 0.95) AS p95_len FROM c GROUP BY 1")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.length_stats(_clean(spark, sf_dir)).withColumns({"min_len": F.col("min_len").cast("bigint"), "max_len": F.col("max_len").cast("bigint")})


@query(_C + "SELECT label, quantile_cont(length(text), 0.5) AS median_len, quantile_cont(length(text), 0.75) - quantile_cont(length(text), 0.25) AS iqr FROM c GROUP BY 1")
def length_iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _clean(spark, sf_dir).groupBy("label").agg(F.expr("percentile(length(text), array(0.25, 0.5, 0.75))").alias("q"))
    return q.select("label", F.col("q")[1].alias("median_len"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


@query(_C + ", r AS (SELECT min(length(text)) AS lo, max(length(text)) AS hi FROM c) SELECT label, CAST(least(floor((length(text) - lo) / ((hi - lo) / 60)), 59) AS INT) AS bin, count(*) AS n FROM c, r GROUP BY 1, 2")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.histogram(_clean(spark, sf_dir), F.length("text"), "label")


@query(_C + ", q AS (SELECT quantile_cont(length(text), 0.99) AS q FROM c) SELECT label, count(*) AS n, max(length(text)) AS longest FROM c, q WHERE length(text) <= q GROUP BY 1")
def quantile_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir)
    q = rows.agg(F.expr("percentile(length(text), 0.99)").alias("q"))
    capped = rows.join(F.broadcast(q)).where(F.length("text") <= F.col("q"))
    return capped.groupBy("label").agg(F.count("*").alias("n"), F.max(F.length("text")).cast("bigint").alias("longest"))


@query(_C + "SELECT count_if(label = 0) AS negatives, count_if(label = 1) AS positives, round(negatives / positives, 4) AS ratio, CASE WHEN negatives / positives < 2 THEN 'balanced' WHEN negatives / positives < 4 THEN 'weight' ELSE 'resample' END AS decision FROM c")
def imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.imbalance(_clean(spark, sf_dir))


@query(_C + ", w AS (SELECT label, count(*) AS n FROM c GROUP BY 1) SELECT label, n, round((SELECT sum(n) FROM w) / (2 * n), 6) AS balanced_weight, CASE WHEN label = 1 THEN round(((SELECT sum(n) FROM w) - n) / n, 6) END AS pos_weight FROM w")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.class_weights(_clean(spark, sf_dir))


@query("SELECT min(row_id) AS row_id, text, arg_min(coalesce(source, '-'), row_id) AS source FROM combined_dataset WHERE text IS NOT NULL GROUP BY text")
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "combined_dataset").where("text is not null").select("row_id", "text", F.coalesce("source", F.lit("-")).alias("source"))
    return ops.exact_dedup(rows).select("row_id", "text", "source")


@query(_C + "SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS duplicate_rows, count(*) AS distinct_texts FROM (SELECT count(*) AS n FROM c GROUP BY text)")
def duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.duplicate_counts(_clean(spark, sf_dir))


@query(_C + f"SELECT row_id FROM c WHERE {_SECONDARY} AND lower(trim(text)) IN (SELECT lower(trim(text)) FROM c WHERE {_PRIMARY})")
def cross_overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir, "source")
    return ops.overlapping(rows.where(_SECONDARY), rows.where(_PRIMARY), True).select("row_id")


@query(_C + f"SELECT row_id FROM c WHERE {_SECONDARY} AND lower(trim(text)) NOT IN (SELECT lower(trim(text)) FROM c WHERE {_PRIMARY})")
def cross_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir, "source")
    return ops.overlapping(rows.where(_SECONDARY), rows.where(_PRIMARY), False).select("row_id")


@query(_C + "SELECT lower(trim(text)) AS text_key, count(DISTINCT label) AS labels, count(*) AS n FROM c GROUP BY 1 HAVING count(DISTINCT label) > 1")
def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.label_conflicts(_clean(spark, sf_dir))


@query(_C + f"SELECT 'primary' AS tag, row_id, text FROM c WHERE {_PRIMARY} UNION ALL SELECT 'secondary', row_id, text FROM c WHERE {_SECONDARY}")
def corpus_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir, "source")
    tagged = lambda where, tag: rows.where(where).select(F.lit(tag).alias("tag"), "row_id", "text")
    return tagged(_PRIMARY, "primary").unionByName(tagged(_SECONDARY, "secondary"), allowMissingColumns=True)


_H = "md5(concat_ws('|', CAST({0} AS VARCHAR), '42'))"


@query(_C + f"SELECT row_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_H.format('row_id')}, row_id) <= round(count(*) OVER (PARTITION BY label) * 0.19) THEN 'test' ELSE 'train' END AS part FROM c")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.stratified_split(_clean(spark, sf_dir).select("row_id", "label"))


_GROUPS = f", g AS (SELECT template_id, row_number() OVER (ORDER BY {_H.format('template_id')}, template_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT template_id FROM c WHERE template_id IS NOT NULL))"


@query(_C + _GROUPS + "SELECT row_id, c.template_id, CASE WHEN r <= ceil(n * 0.19) THEN 'test' ELSE 'train' END AS part FROM c JOIN g ON c.template_id = g.template_id")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.group_split(_clean(spark, sf_dir, "template_id").select("row_id", "template_id"))


@query(_C + _GROUPS + ", p AS (SELECT c.template_id, CASE WHEN r <= ceil(n * 0.19) THEN 'test' ELSE 'train' END AS part FROM c JOIN g ON c.template_id = g.template_id) SELECT (SELECT count(*) FROM (SELECT template_id FROM p WHERE part = 'train' INTERSECT SELECT template_id FROM p WHERE part = 'test')) AS shared_templates, (SELECT count(DISTINCT template_id) FROM p WHERE part = 'test') AS test_templates, (SELECT count(*) FROM p WHERE part = 'test') AS test_rows")
def split_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ops.group_split(_clean(spark, sf_dir, "template_id").select("row_id", "template_id"))
    templates = lambda part: parts.where(F.col("part") == part).select("template_id")
    shared = templates("train").intersect(templates("test")).agg(F.count("*").alias("shared_templates"))
    tested = templates("test").groupBy("template_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("test_templates"), F.coalesce(F.sum("n"), F.lit(0)).alias("test_rows"))
    return shared.join(F.broadcast(tested))


_CAPPED = f", k AS (SELECT row_id, template_id, row_number() OVER (PARTITION BY template_id ORDER BY {_H.format('row_id')}, row_id) AS round FROM c WHERE template_id IS NOT NULL QUALIFY round <= 5)"


@query(_C + _CAPPED + "SELECT row_id, template_id, CAST(round AS INT) AS round FROM k")
def template_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cap_per_group(_clean(spark, sf_dir, "template_id").where("template_id is not null"), "template_id", 5).select("row_id", "template_id", "round")


@query(_C + _CAPPED + f"SELECT row_id, template_id, CAST(round AS INT) AS round FROM k ORDER BY k.round, {_H.format('template_id')}, template_id LIMIT 400")
def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _clean(spark, sf_dir, "template_id").where("template_id is not null")
    return ops.round_robin(rows, "template_id", 5, 400).select("row_id", "template_id", "round")


@query(_C + f"SELECT row_id, label FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_H.format('row_id')}, row_id) <= 3")
def class_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.cap_per_group(_clean(spark, sf_dir), "label", 3).select("row_id", "label")


@query("SELECT doc_id FROM documents WHERE length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) >= 3")
def non_ascii_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.length(F.regexp_replace("text", r"[\x00-\x7F]", "")) >= 3).select("doc_id")


@query("""
SELECT CASE WHEN cp <= 1279 THEN 'Cyrillic' WHEN cp BETWEEN 1536 AND 1791 THEN 'Arabic' WHEN cp BETWEEN 12352 AND 12543 THEN 'Japanese' WHEN cp BETWEEN 19968 AND 40959 THEN 'CJK'
 WHEN cp BETWEEN 44032 AND 55295 THEN 'Korean' WHEN cp BETWEEN 2304 AND 2431 THEN 'Devanagari' WHEN cp BETWEEN 1488 AND 1535 THEN 'Hebrew' ELSE 'other' END AS script, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT unicode(ch) AS cp, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1) WHERE cp > 1024 GROUP BY 1
""")
def script_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.script_histogram(table(spark, sf_dir, "documents").select("text"))


@query()
def near_dup_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.leaders(_clean(spark, sf_dir, "source").where("source ilike '%role%play%'"), "row_id", "text")


@query()
def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.similar_pairs(_clean(spark, sf_dir, "source").where("source ilike '%role%play%'"), "row_id", "text")
