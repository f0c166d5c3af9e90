"""The relational store and its queries: sessions, their messages, trends, search, upsert, patch and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.schemas import HISTORY_TURNS, PREVIEW_CHARS
from wardline.session import materialised


def uuid_text(raw: Column) -> Column:
    """A UUID in any of its forms as lower case with hyphens; anything else trimmed and in lower case."""
    bare = F.regexp_replace(F.lower(raw), "[^0-9a-f]", "")
    return F.when(F.length(bare) == 32, F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(F.lower(F.trim(raw)))


def latest_by(rows: DataFrame, key: str, newest: str) -> DataFrame:
    """Of the rows with an equal key the one with the greatest `newest`; aggregates before it shuffles."""
    others = [c for c in rows.columns if c != key]
    # Of rows equally new the one with the greatest content, so that the choice doesn't hang on the order of the rows.
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(F.col(newest), F.xxhash64(*others))).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def clean_messages(classifications: DataFrame, *columns: str) -> DataFrame:
    """One row per message id, with the session id in one form and the verdict in upper case; only the named columns, if any
    are named, are read and shuffled. ingested_at decides, and id and session_id always come out."""
    named = dict.fromkeys(["id", "session_id", *columns]) if columns else classifications.columns
    rows = classifications.select(*dict.fromkeys([*named, "ingested_at"]))
    rows = rows.withColumn("session_id", uuid_text(F.col("session_id")))
    rows = rows.withColumn("verdict", F.upper(F.trim("verdict"))) if "verdict" in rows.columns else rows
    return latest_by(rows, "id", "ingested_at").select(*named)


def clean_sessions(sessions: DataFrame) -> DataFrame:
    """One row per session, the one updated last."""
    return latest_by(sessions.withColumn("id", uuid_text(F.col("id"))), "id", "updated_at")


def _blocked() -> Column:
    return (F.col("verdict") == "BLOCK").cast("int")


def last_rank(order: str = "created_at", tie: str = "id", key: str = "session_id") -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie)))


def trend_summary(messages: DataFrame, last: int = 10) -> DataFrame:
    """Per session: total, blocked, benign, the block rate of its last requests and its most frequent family.

    The last `last` rows come from a ranking that Spark limits before the shuffle, so a session of any size costs its
    last rows only.
    """
    totals = messages.groupBy("session_id").agg(F.count("*").alias("total"), F.coalesce(F.sum(_blocked()), F.lit(0)).alias("blocked"))
    recent = messages.select("session_id", "created_at", "id", "verdict").withColumn("_r", last_rank()).where(F.col("_r") <= last)
    rate = recent.groupBy("session_id").agg(F.round(F.avg(_blocked()), 4).alias("rolling_block_rate"))
    counted = family_breakdown(messages)
    top = counted.groupBy("session_id").agg(F.min_by("attack_family", F.struct(-F.col("n"), F.col("attack_family"))).alias("top_family"))
    return totals.join(rate, "session_id", "left").join(top, "session_id", "left").withColumn("benign", F.col("total") - F.col("blocked"))


def family_breakdown(messages: DataFrame) -> DataFrame:
    """Per session and family the blocked messages."""
    return messages.where("attack_family is not null and verdict = 'BLOCK'").groupBy("session_id", "attack_family").agg(F.count("*").alias("n"))


#: A session with more messages than this, and than HOT_SHARE of all, is worked on in pieces.
HOT_ROWS, HOT_SHARE = 100_000, 0.001


def trend_points(messages: DataFrame, last: int = 10) -> DataFrame:
    """Every message with the block rate over it and the up to nine before it in its session.

    A hot session's messages, of which there are at most 1 / HOT_SHARE, are split into ranges of time; each range gets the
    last messages before it along, so that no session is one task.
    """
    order = ["created_at", "id"]
    rate = F.round(F.avg(_blocked()).over(Window.partitionBy("session_id").orderBy(*order).rowsBetween(-(last - 1), 0)), 4)
    sizes = messages.groupBy("session_id").agg(F.count("*").alias("_n"))
    hot = materialised(sizes.where(F.col("_n") > max(HOT_ROWS, int(messages.count() * HOT_SHARE))).select("session_id"))
    if not hot.limit(1).count():
        return messages.withColumn("rolling_block_rate", rate)
    few = messages.join(F.broadcast(hot), "session_id", "left_anti").withColumn("rolling_block_rate", rate)
    pieces = materialised(messages.join(F.broadcast(hot), "session_id").repartitionByRange("session_id", *order).withColumn("_piece", F.spark_partition_id()))
    back = F.row_number().over(Window.partitionBy("session_id", "_piece").orderBy(*[F.desc(c) for c in order]))
    tails = pieces.withColumn("_back", back).where(F.col("_back") < last).drop("_back")
    tails = materialised(tails.withColumn("_at", F.row_number().over(Window.partitionBy("session_id").orderBy(*order))))  # last - 1 rows a piece
    upto = Window.partitionBy("session_id").orderBy("_piece")
    starts = tails.groupBy("session_id", "_piece").agg(F.count("*").alias("_c")).withColumn("_start", F.sum("_c").over(upto) - F.col("_c"))
    wanted = starts.where(F.col("_start") > 0).select("session_id", "_piece", F.explode(F.sequence(F.greatest(F.col("_start") - last + 2, F.lit(1)), F.col("_start"))).alias("_at"))
    carried = tails.drop("_piece").join(wanted.withColumn("_at", F.col("_at").cast("int")), ["session_id", "_at"]).drop("_at").withColumn("_own", F.lit(False))
    local = Window.partitionBy("session_id", "_piece").orderBy(*order).rowsBetween(-(last - 1), 0)
    many = pieces.withColumn("_own", F.lit(True)).unionByName(carried).withColumn("rolling_block_rate", F.round(F.avg(_blocked()).over(local), 4)).where("_own")
    return few.unionByName(many.select(*few.columns))


def session_list(sessions: DataFrame, limit: int = 100) -> DataFrame:
    """The newest sessions, ties by id."""
    return sessions.orderBy(F.desc("created_at"), "id").limit(limit)


def search(messages: DataFrame, q: str | None) -> DataFrame:
    """Messages whose text contains q without regard to case; % and _ in q are wildcards; an empty q keeps all."""
    return messages.where(F.col("text").ilike(f"%{q}%")) if q else messages


def page(messages: DataFrame, q: str | None, limit: int, offset: int) -> DataFrame:
    """One page of the search, newest first, with the total of the search on each row."""
    found = search(messages, q)
    total = found.count()
    return found.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit).withColumn("total", F.lit(total).cast("bigint"))


def upsert_absent(sessions: DataFrame, incoming: DataFrame) -> DataFrame:
    """sessions and those incoming rows whose id it lacks; an existing row stays as it is. Previews are cut."""
    first = latest_by(incoming, "id", "created_at").withColumn("preview", F.substring("preview", 1, PREVIEW_CHARS))
    return sessions.unionByName(first.join(sessions.select("id"), "id", "left_anti").select(*sessions.columns))


def patch(sessions: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sessions with the patches' non-null values, patches of no session). updated_at becomes the patch's time."""
    p = patches.select("id", F.col("preview").alias("_preview"), F.col("last_verdict").alias("_verdict"), F.col("at").alias("_at"))
    joined = sessions.join(p, "id", "left")
    done = joined.select("id", "created_at", F.coalesce("_at", "updated_at").alias("updated_at"), F.coalesce(F.substring("_preview", 1, PREVIEW_CHARS), "preview").alias("preview"), F.coalesce("_verdict", "last_verdict").alias("last_verdict"))
    return done, patches.join(sessions.select("id"), "id", "left_anti")


def delete_cascade(sessions: DataFrame, messages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions of ids and their messages."""
    return sessions.join(ids, "id", "left_anti"), messages.join(ids.withColumnRenamed("id", "session_id"), "session_id", "left_anti")


def recent_turns(messages: DataFrame, turns: int = HISTORY_TURNS) -> DataFrame:
    """Each session's last turns, a message being a user's turn and a reply an assistant's."""
    both = messages.select("session_id", "created_at", "id", F.posexplode(F.array("text", "reply")).alias("side", "content")).where("content is not null and content <> ''")
    ranked = both.withColumn("_r", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"), F.desc("side"))))
    return ranked.where(F.col("_r") <= turns).withColumn("role", F.when(F.col("side") == 0, "user").otherwise("assistant")).drop("side")


# What the families are called where users read them.
FAMILY_NAMES = {
    "instruction_override": "Instruction Override",
    "role_play_jailbreak": "Role-Play Jailbreak",
    "context_exfiltration": "Context Exfiltration",
    "encoding_obfuscation": "Encoding / Obfuscation",
    "delimiter_escape": "Delimiter Escape",
    "indirect_injection": "Indirect Injection",
}


def family_name(family: Column) -> Column:
    """The name of a family; one without name is called by its own, null unknown."""
    names = F.create_map(*[F.lit(x) for pair in FAMILY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, family), family, F.lit("unknown"))


def percent(share: Column) -> Column:
    """A share as whole percent, halves to even."""
    return F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%"))


def explanation(family: Column, scores: Column, confidence: Column) -> Column:
    """A sentence on a blocked message: the family, the confidence and the three highest scores, ties in order of name."""
    entries = F.slice(F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), 1, 3)
    parts = F.transform(entries, lambda e: F.concat(family_name(e["k"]), F.lit(" ("), percent(-e["v"]), F.lit(")")))
    return F.concat(F.lit("Blocked as "), family_name(family), F.lit(" with "), percent(confidence), F.lit(" confidence. Top signals: "), F.array_join(parts, ", "))
