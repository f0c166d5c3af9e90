"""Explicit schemas of the engine's tables and the validation of incoming rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORPUS = "text STRING, label INT, source STRING, template_id BIGINT"
SESSIONS = "id STRING, created_at TIMESTAMP, updated_at TIMESTAMP, preview STRING, last_verdict STRING"
CLASSIFICATIONS = "id STRING, session_id STRING, created_at TIMESTAMP, text STRING, verdict STRING, confidence DOUBLE, attack_family STRING, family_scores STRING, model_version STRING, reply STRING"

# Bounds of accepted requests.
TEXT_MOST, TURNS_MOST, QUERY_MOST, PAGE_MOST, BODY_BYTES, PREVIEW_CHARS, HISTORY_TURNS = 10_000, 20, 200, 100, 1_048_576, 80, 10
VERDICTS = ["ALLOW", "BLOCK"]
ROLES = ["user", "assistant"]


def text_reject_reason(text: Column) -> Column:
    """Why a text is not accepted; null for an accepted one."""
    return F.when(text.isNull(), "missing").when(F.octet_length(text) > BODY_BYTES, "body_too_large").when(F.length(text) < 1, "too_short").when(F.length(text) > TEXT_MOST, "too_long")


def split_accepted(rows: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with reason)."""
    judged = rows.withColumn("reject_reason", text_reject_reason(F.col(f"`{text_col}`")))
    return judged.where("reject_reason is null").drop("reject_reason"), judged.where("reject_reason is not null")


def search_reject_reason(q: Column, limit: Column, offset: Column) -> Column:
    """Why a search is not accepted; null for an accepted one. Without q everything is found."""
    return F.when(F.length(q) > QUERY_MOST, "query_too_long").when(limit.isNull() | (limit < 1) | (limit > PAGE_MOST), "bad_limit").when(offset.isNull() | (offset < 0), "bad_offset")


def verdict_reject_reason(verdict: Column) -> Column:
    """Why a patch's verdict is not accepted; null for an accepted one, and for none."""
    return F.when(verdict.isNotNull() & ~verdict.isin(VERDICTS), "bad_verdict")


def history_reject_reason(turns: Column) -> Column:
    """Why a history, an array of (role, content), is not accepted: too many turns, else its first bad turn's reason."""
    bad = F.filter(F.transform(turns, lambda t: turn_reject_reason(t["role"], t["content"])), lambda r: r.isNotNull())
    return F.when(F.size(turns) > TURNS_MOST, "too_many_turns").otherwise(F.try_element_at(bad, F.lit(1)))


def label_name(label: Column) -> Column:
    """The name of a label of 0 or 1, null for others."""
    return F.when(label == 0, "benign").when(label == 1, "injection")


def error_envelope(code: Column, messages: Column) -> Column:
    """STRUCT<code, message, reference_id> of an error: its messages (an array) joined, and a random reference."""
    return F.struct(code.alias("code"), F.array_join(messages, "; ").alias("message"), F.uuid().alias("reference_id"))


def turn_reject_reason(role: Column, text: Column) -> Column:
    """Why a turn of a history is not accepted; null for an accepted one."""
    return F.when(~F.coalesce(role.isin(ROLES), F.lit(False)), "bad_role").otherwise(text_reject_reason(text))
