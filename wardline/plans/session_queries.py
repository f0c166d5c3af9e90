"""Queries over sessions and their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import schemas
from wardline.operators import sessions as ops
from wardline.plans.registry import query, table

_UUID = "regexp_replace(regexp_replace(lower({0}), '[^0-9a-f]', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
_M = f"WITH m AS (SELECT * REPLACE ({_UUID.format('session_id')} AS session_id, upper(trim(verdict)) AS verdict) FROM classifications QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) = 1)"
_S = f"WITH s AS (SELECT * REPLACE ({_UUID.format('id')} AS id) FROM sessions QUALIFY row_number() OVER (PARTITION BY {_UUID.format('id')} ORDER BY updated_at DESC) = 1)"
_PATCHED = "'1', '5', '9', 'd'"


def _messages(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return ops.clean_messages(table(spark, sf_dir, "classifications"), *columns)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clean_sessions(table(spark, sf_dir, "sessions"))


def _micros(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in cols})


@query(_M + """
SELECT t.*, r.rolling_block_rate, f.top_family FROM
 (SELECT session_id, count(*) AS total, CAST(sum(CASE WHEN verdict = 'BLOCK' THEN 1 ELSE 0 END) AS BIGINT) AS blocked, CAST(sum(CASE WHEN verdict = 'BLOCK' THEN 0 ELSE 1 END) AS BIGINT) AS benign FROM m GROUP BY 1) t
 LEFT JOIN (SELECT session_id, round(avg(CASE WHEN verdict = 'BLOCK' THEN 1 ELSE 0 END), 4) AS rolling_block_rate FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) <= 10) GROUP BY 1) r USING (session_id)
 LEFT JOIN (SELECT session_id, attack_family AS top_family FROM (SELECT session_id, attack_family, count(*) AS n FROM m WHERE verdict = 'BLOCK' AND attack_family IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY n DESC, attack_family) = 1) f USING (session_id)
""")
def trend_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.trend_summary(_messages(spark, sf_dir, "created_at", "verdict", "attack_family"))


@query(_M + "SELECT id, session_id, epoch_us(created_at) AS created_at, verdict, round(avg(CASE WHEN verdict = 'BLOCK' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY created_at, id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 4) AS rolling_block_rate FROM m")
def trend_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ops.trend_points(_messages(spark, sf_dir, "created_at", "verdict").select("id", "session_id", "created_at", "verdict"))
    return _micros(points, "created_at")


@query(_M + "SELECT session_id, attack_family, count(*) AS n FROM m WHERE verdict = 'BLOCK' AND attack_family IS NOT NULL GROUP BY 1, 2")
def family_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.family_breakdown(_messages(spark, sf_dir, "verdict", "attack_family"))


@query(_S + "SELECT id, epoch_us(created_at) AS created_at, preview, last_verdict FROM s ORDER BY s.created_at DESC, id LIMIT 100")
def session_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micros(ops.session_list(_sessions(spark, sf_dir)).select("id", "created_at", "preview", "last_verdict"), "created_at")


@query(_M + ", " + _S[5:] + """
SELECT id, epoch_us(created_at) AS created_at, preview FROM s
UNION ALL SELECT session_id, epoch_us(min(created_at)), substr(arg_min(text, created_at), 1, 80) FROM m WHERE session_id NOT IN (SELECT id FROM s) AND text IS NOT NULL GROUP BY 1
""")
def session_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _sessions(spark, sf_dir)
    first = _messages(spark, sf_dir, "created_at", "text").where("text is not null").groupBy("session_id").agg(F.min("created_at").alias("created_at"), F.min_by("text", "created_at").alias("preview"))
    incoming = first.select(F.col("session_id").alias("id"), "created_at", F.col("created_at").alias("updated_at"), "preview", F.lit(None).cast("string").alias("last_verdict"))
    return _micros(ops.upsert_absent(sessions, incoming).select("id", "created_at", "preview"), "created_at")


@query(_S + f"SELECT id, CASE WHEN substr(id, 1, 1) IN ({_PATCHED}) THEN epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') ELSE epoch_us(updated_at) END AS updated_at, preview, CASE WHEN substr(id, 1, 1) IN ({_PATCHED}) THEN 'BLOCK' ELSE last_verdict END AS last_verdict FROM s")
def session_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _sessions(spark, sf_dir)
    patches = sessions.where(f"substr(id, 1, 1) in ({_PATCHED})").select("id", F.lit(None).cast("string").alias("preview"), F.lit("BLOCK").alias("last_verdict"), F.lit("2026-01-01").cast("timestamp").alias("at"))
    done, _ = ops.patch(sessions, patches)
    return _micros(done.select("id", "updated_at", "preview", "last_verdict"), "updated_at")


@query(_M + ", " + _S[5:] + """, gone AS (SELECT id FROM s WHERE last_verdict IS NULL)
SELECT 'session' AS kind, id FROM s WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'message', id FROM m WHERE session_id NOT IN (SELECT id FROM gone)
""")
def session_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = _sessions(spark, sf_dir)
    kept, messages = ops.delete_cascade(sessions, _messages(spark, sf_dir, "verdict"), sessions.where("last_verdict is null").select("id"))
    return kept.select(F.lit("session").alias("kind"), "id").unionByName(messages.select(F.lit("message").alias("kind"), "id"))


@query(_M + "SELECT id, session_id, epoch_us(created_at) AS created_at, verdict FROM m WHERE text ILIKE '%the%guard%'")
def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micros(ops.search(_messages(spark, sf_dir, "created_at", "verdict", "text"), "the%guard").select("id", "session_id", "created_at", "verdict"), "created_at")


@query(_M + ", f AS (SELECT * FROM m WHERE text ILIKE '%rules%') SELECT id, epoch_us(created_at) AS created_at, (SELECT count(*) FROM f) AS total FROM f ORDER BY f.created_at DESC, id LIMIT 50 OFFSET 20")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micros(ops.page(_messages(spark, sf_dir, "created_at", "text"), "rules", 50, 20).select("id", "created_at", "total"), "created_at")


@query(_M + "SELECT count(*) AS total, count_if(verdict = 'BLOCK') AS blocked, count_if(verdict = 'ALLOW') AS allowed, round(count_if(verdict = 'BLOCK') / count(*), 4) AS block_rate FROM m")
def stats_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _messages(spark, sf_dir, "verdict").agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "BLOCK").alias("blocked"), F.count_if(F.col("verdict") == "ALLOW").alias("allowed"))
    return c.withColumn("block_rate", F.when(F.col("total") > 0, F.round(F.col("blocked") / F.col("total"), 4)))


@query(_M + """
SELECT session_id, id, side, content FROM (
  SELECT session_id, created_at, id, 0 AS side, text AS content FROM m UNION ALL SELECT session_id, created_at, id, 1, reply FROM m)
WHERE content <> '' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC, side DESC) <= 10
""")
def history_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.recent_turns(_messages(spark, sf_dir, "created_at", "text", "reply")).select("session_id", "id", F.when(F.col("role") == "user", 0).otherwise(1).alias("side"), "content")


@query("""
SELECT reject_reason, count(*) AS n FROM (SELECT CASE WHEN text IS NULL THEN 'missing' WHEN octet_length(encode(text)) > 1048576 THEN 'body_too_large' WHEN length(text) < 1 THEN 'too_short' WHEN length(text) > 10000 THEN 'too_long' END AS reject_reason FROM documents)
WHERE reject_reason IS NOT NULL GROUP BY 1
""")
def request_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = schemas.split_accepted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rejected.groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("SELECT id, ingested_at IS NOT NULL AS stored, CAST(json_extract(CASE WHEN json_valid(family_scores) THEN family_scores END, '$.instruction_override') AS DOUBLE) AS instruction_override FROM classifications")
def family_scores_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "classifications")
    whole = F.from_json("family_scores", "map<string,double>", {"mode": "PERMISSIVE"})
    valid = F.col("family_scores").rlike(r"^\s*\{.*\}\s*$")
    return rows.select("id", F.col("ingested_at").isNotNull().alias("stored"), F.when(valid, F.try_element_at(whole, F.lit("instruction_override"))).alias("instruction_override"))


_NAMES = ", ".join(f"'{k}': '{v}'" for k, v in ops.FAMILY_NAMES.items())


@query(_M + f"""
, e AS (SELECT id, attack_family, confidence, CAST(CAST(family_scores AS JSON) AS MAP(VARCHAR, DOUBLE)) AS scores FROM m
 WHERE verdict = 'BLOCK' AND attack_family IS NOT NULL AND confidence IS NOT NULL AND json_valid(family_scores) AND regexp_full_match(family_scores, '\\s*\\{{.*\\}}\\s*')),
t AS (SELECT *, list_sort(list_transform(map_entries(scores), lambda x: {{'v': -x.value, 'k': x.key}}))[:3] AS top, MAP {{{_NAMES}}} AS names FROM e)
SELECT id, 'Blocked as ' || coalesce(names[attack_family], attack_family) || ' with ' || CAST(CAST(round_even(confidence * 100, 0) AS INT) AS VARCHAR) || '% confidence. Top signals: '
 || array_to_string(list_transform(top, lambda x: coalesce(names[x.k], x.k) || ' (' || CAST(CAST(round_even(-x.v * 100, 0) AS INT) AS VARCHAR) || '%)'), ', ') AS reply FROM t
""")
def block_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir, "verdict", "attack_family", "family_scores", "confidence").where("verdict = 'BLOCK' and attack_family is not null and confidence is not null and family_scores rlike '^\\\\s*\\\\{.*\\\\}\\\\s*$'")
    return rows.select("id", ops.explanation(F.col("attack_family"), F.from_json("family_scores", "map<string,double>"), F.col("confidence")).alias("reply"))


@query(_M + """
SELECT reject_reason, count(*) AS n FROM (
  SELECT CASE WHEN length(text) > 200 THEN 'query_too_long' WHEN h % 120 < 1 OR h % 120 > 100 THEN 'bad_limit' WHEN h % 7 - 1 < 0 THEN 'bad_offset' END AS reject_reason
  FROM (SELECT text, length(coalesce(text, '')) + length(coalesce(reply, '')) AS h FROM m))
WHERE reject_reason IS NOT NULL GROUP BY 1
""")
def search_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.length(F.coalesce("text", F.lit(""))) + F.length(F.coalesce("reply", F.lit("")))
    asked = _messages(spark, sf_dir, "text", "reply").select(F.col("text").alias("q"), (h % 120).alias("limit"), (h % 7 - 1).alias("offset"))
    judged = asked.select(schemas.search_reject_reason(F.col("q"), F.col("limit"), F.col("offset")).alias("reject_reason"))
    return judged.where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"))


@query(_M + """
, t AS (SELECT session_id, count(*) AS turns, count_if(content IS NULL) AS missing, count_if(length(content) < 1) AS short, count_if(length(content) > 10000) AS long FROM (SELECT session_id, text AS content FROM m UNION ALL SELECT session_id, reply FROM m) GROUP BY 1)
SELECT session_id, CASE WHEN turns > 20 THEN 'too_many_turns' WHEN missing > 0 THEN 'missing' WHEN short > 0 THEN 'too_short' WHEN long > 0 THEN 'too_long' END AS reject_reason FROM t WHERE turns > 20 OR missing + short + long > 0
""")
def history_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions whose history would not be accepted. The most severe turn's reason counts, in the order of the bounds."""
    both = _messages(spark, sf_dir, "text", "reply").select("session_id", F.explode(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content")))).alias("t"))
    reason = schemas.turn_reject_reason(F.col("t.role"), F.col("t.content"))
    counted = both.groupBy("session_id").agg(F.count("*").alias("turns"), *[F.count_if(reason == r).alias(r) for r in ("missing", "too_short", "too_long")])
    whole = F.when(F.col("turns") > schemas.TURNS_MOST, "too_many_turns").when(F.col("missing") > 0, "missing").when(F.col("too_short") > 0, "too_short").when(F.col("too_long") > 0, "too_long")
    return counted.select("session_id", whole.alias("reject_reason")).where("reject_reason is not null")
