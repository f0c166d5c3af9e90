"""Conversations rebuilt from message rows.

Method: a stream of messages in order of arrival, with keyed state and an event-time watermark. A key is a bucket of
sessions; its state buffers the messages of the sessions that are open, late ones included, and keeps of each id the copy
that arrived last. When the watermark passes a session's last message by IDLE it is closed: a conversation that is sound
is emitted in order, a broken one as such, and both leave the state. A hot session, one with more than HOT_SHARE of all
messages, is no task of its own: its hours are units that are buffered, closed and emitted like sessions, in buckets of
their own, and put together by their counts. A message that comes when its unit is closed goes to the side output; its
session is judged again as a whole (conversations, dropped_sessions), so that nothing is lost.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardline.llm.support import HOT_SHARE, cut, digest, keyed_join, new_path
from wardline.session import ship_package

#: How late a message may be, and how long a unit stays open after its last message.
LATENESS = "3 days"
IDLE_MS = 60 * 60 * 1000
#: Part of a hot session that is one unit, and the messages from which a session may be hot.
PART = "HOUR"
HOT_ROWS = 10_000
#: Bytes of staged messages in a micro-batch, and the least number of micro-batches of a replay.
BATCH_BYTES = 256 << 20
LEAST_BATCHES = 4
#: Buckets of sessions per partition of the state.
BUCKETS = 4
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MESSAGE_SCHEMA = "id STRING, session_id STRING, created_at TIMESTAMP, text STRING, verdict STRING, confidence DOUBLE, attack_family STRING, family_scores STRING, model_version STRING, reply STRING, ingested_at TIMESTAMP"
_STAGED = "id STRING, session_id STRING, unit STRING, created_at TIMESTAMP, ingested_at TIMESTAMP, event_at TIMESTAMP, bucket INT, tie BIGINT, text STRING, reply STRING, sound BOOLEAN"
_OUT = "kind string, session_id string, first long, n int, text string, reply string, messages long, unsound long"
#: White space, controls, format characters and the letters and marks that have no look.
_UNSEEN = r"[\p{Z}\p{Cc}\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]"


def session_key(raw: Column) -> Column:
    """A session id as lower-case UUID with hyphens; what is no UUID is only trimmed and lower-cased."""
    low = F.lower(F.trim(raw))
    bare = F.regexp_replace(F.regexp_replace(low, "^urn:uuid:", ""), "[^0-9a-f]", "")
    hyphened = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(low.rlike(r"^(urn:uuid:)?[\s{(]*[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}[\s})]*$"), hyphened).otherwise(F.nullif(low, F.lit("")))


def visible(text: Column) -> Column:
    """True for a text with a visible character."""
    return F.coalesce(F.regexp_replace(text, _UNSEEN, "") != "", F.lit(False))


def _units(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One bucket's call. State: unit -> [session, {id: ((arrived, tie), created, text, reply, sound)}, last message's time]."""
    units = pickle.loads(state.get[0]) if state.exists else {}
    mark, idle = state.getCurrentWatermarkMs() * 1000, IDLE_MS * 1000  # microseconds, like all times here
    out: list[tuple] = []
    for b in batches if not state.hasTimedOut else ():
        created, arrived = (b[c].astype("datetime64[us]").astype("int64").tolist() for c in ("created_at", "ingested_at"))
        for m, session, unit, made, came, tie, text, reply, sound in zip(b["id"], b["session_id"], b["unit"], created, arrived, b["tie"], b["text"], b["reply"], b["sound"]):
            own = units.get(unit)
            if own is None:
                if made + idle <= mark:
                    out.append(("late", session, made, 0, None, None, 1, 0))
                    continue
                own = units[unit] = [session, {}, made]
            had = own[1].get(m)
            if had is None or (came, tie) > had[0]:  # the copy that arrived last
                own[1][m] = ((came, tie), made, text, reply, bool(sound))
            own[2] = max(own[2], made)
    for unit in [u for u, own in units.items() if own[2] + idle <= mark]:
        session, messages, _ = units.pop(unit)
        ordered = sorted(messages.items(), key=lambda i: (i[1][1], i[0]))
        first, unsound = ordered[0][1][1], sum(not m[4] for m in messages.values())
        if not unsound:
            out += [("turn", session, first, n, m[2], m[3], 0, 0) for n, (_, m) in enumerate(ordered, 1)]
        out.append(("closed", session, first, 0, None, None, len(messages), unsound))
    if units:
        state.update((pickle.dumps(units, protocol=5),))
        state.setTimeoutTimestamp(max(min(own[2] for own in units.values()) // 1000 + IDLE_MS, state.getCurrentWatermarkMs()) + 1)
    elif state.exists:
        state.remove()
    if out:
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _OUT.split(", ")])


def _shaped(spark: SparkSession, messages_path: str, with_text: bool) -> DataFrame:
    """The messages that have a session, in the stream's form; created_at and ingested_at stand in for each other."""
    raw = spark.read.schema(MESSAGE_SCHEMA).parquet(messages_path).select("id", session_key(F.col("session_id")).alias("session_id"), "created_at", "ingested_at", "text", "reply")
    sound = visible(F.col("text")) & visible(F.col("reply"))
    name = F.coalesce("id", F.concat(F.lit("row:"), *[F.hex(h) for h in digest(F.struct("created_at", "ingested_at", "text", "reply"))]))
    kept = [F.col(c) if with_text else F.lit(None).cast("string").alias(c) for c in ("text", "reply")]
    return raw.where("session_id is not null").select(name.alias("id"), "session_id", F.coalesce("created_at", "ingested_at").alias("created_at"), F.coalesce("ingested_at", "created_at").alias("ingested_at"), F.xxhash64("text", "reply").alias("tie"), *kept, sound.alias("sound"))


def _staged(spark: SparkSession, messages: DataFrame) -> tuple[str, int]:
    """Messages written in order of arrival, one file per micro-batch, older files first; and how many files those are.

    The files' times tell the stream their order. On storage that doesn't keep them, all is one micro-batch.
    """
    path = new_path(spark, "p2-staged")
    counts = messages.groupBy("session_id").agg(F.count("*").alias("n"))
    total = messages.count()
    hot = cut(counts.where(F.col("n") > max(HOT_ROWS, int(total * HOT_SHARE))).select("session_id", F.lit(True).alias("hot")), "p2-hot")  # 1 / HOT_SHARE rows at most
    size = messages.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("reply"), F.lit(0)) + 200)).first()[0] or 0
    files = max(LEAST_BATCHES, -(-size // BATCH_BYTES))
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = messages.where("created_at is not null").join(F.broadcast(hot), "session_id", "left")
    unit = F.when(F.col("hot"), F.concat_ws("|", "session_id", F.date_trunc(PART, "created_at").cast("string"))).otherwise(F.col("session_id"))
    # A message later than LATENESS counts as just so late, so that the stream takes it and the function judges it; one
    # from after its arrival counts as of then, so that a wrong clock doesn't move the watermark.
    event = F.greatest(F.least("created_at", "ingested_at"), F.col("ingested_at") - F.expr(f"INTERVAL {LATENESS}"))
    rows = placed.withColumn("unit", unit).withColumn("event_at", event).withColumn("bucket", F.pmod(F.xxhash64("unit"), F.lit(buckets)).cast("int"))
    rows.select(*[c.split(" ")[0] for c in _STAGED.split(", ")]).repartitionByRange(files, "ingested_at", "id").write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    closing = spark.createDataFrame([("2200-01-01",)], "t string").selectExpr("'' AS id", "'' AS session_id", "'' AS unit", "timestamp(t) AS created_at", "timestamp(t) AS ingested_at", "timestamp(t) AS event_at", "0 AS bucket", "0L AS tie", "cast(null AS string) AS text", "cast(null AS string) AS reply", "true AS sound")
    closing.coalesce(1).write.mode("append").parquet(path)
    named = {p.getName() for p in parts}
    parts += [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("part-") and f.getPath().getName() not in named]
    times = [1_600_000_000_000 + 1000 * i for i in range(len(parts))]
    for p, t in zip(parts, times):
        fs.setTimes(p, t, -1)
    in_order = all(fs.getFileStatus(p).getModificationTime() == t for p, t in zip(parts, times))
    return path, 1 if in_order else len(parts)


def closed_units(spark: SparkSession, staged: str, batch_files: int = 1) -> DataFrame:
    """Runs the stream over the staged messages and gives what it emitted: turns of sound units in order, a row for each
    unit that closed, and the messages that came too late for theirs.

    On a live source the same function runs over micro-batches as they come; here a closing row far in the future, in the
    last file, moves the watermark past every unit. State is kept by RocksDB, outside the executors' heap.
    """
    ship_package(spark)
    out, log = new_path(spark, "p2-units"), new_path(spark, "p2-log")
    stream = spark.readStream.schema(_STAGED).option("maxFilesPerTrigger", batch_files).parquet(staged)
    keyed = stream.withWatermark("event_at", LATENESS).groupBy("bucket")
    units = keyed.applyInPandasWithState(_units, _OUT, "blob binary", "append", GroupStateTimeout.EventTimeTimeout)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)
    try:
        query = units.writeStream.format("parquet").option("checkpointLocation", log).option("path", out).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(_OUT).parquet(out).where("session_id <> ''")


def latest_messages(messages: DataFrame) -> DataFrame:
    """Of each id the copy that arrived last."""
    best = messages.groupBy("id").agg(F.max_by(F.struct("session_id", "created_at", "text", "reply", "sound"), F.struct("ingested_at", "tie")).alias("m"))
    return best.select("id", "m.*")


def numbered(rows: DataFrame, key: str, order: list[str], total: int) -> DataFrame:
    """rows with n, their number from 1 within key in that order.

    Small keys are numbered in a window each. A key with more than HOT_SHARE of all rows is range-partitioned: its rows
    are numbered within partitions, and each partition adds the counts of those before it.
    """
    limit = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = F.broadcast(cut(rows.groupBy(key).agg(F.count("*").alias("size")).where(F.col("size") > limit).select(key), "p2-hot"))
    small = rows.join(hot, key, "left_anti").withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    ranged = cut(rows.join(hot, key).repartitionByRange(key, *order).withColumn("at", F.spark_partition_id()), "p2-ranged")
    before = ranged.groupBy(key, "at").agg(F.count("*").alias("c")).withColumn("before", F.sum("c").over(Window.partitionBy(key).orderBy("at")) - F.col("c")).drop("c")
    local = F.row_number().over(Window.partitionBy(key, "at").orderBy(*order))
    large = ranged.withColumn("local", local).join(before, [key, "at"]).withColumn("n", (F.col("local") + F.col("before")).cast("int")).drop("local", "before", "at")
    return small.unionByName(large)


def rebuilt(spark: SparkSession, messages_path: str, with_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(turns, counts). counts: session_id, messages, unsound, redone of every session with a message; turns: session_id,
    redone, n, text, reply, where those count that are redone as their session is, and whose session has nothing unsound."""
    messages = cut(_shaped(spark, messages_path, with_text), "p2-messages")
    emitted = cut(closed_units(spark, *_staged(spark, messages)), "p2-emitted")
    units = emitted.where("kind = 'closed'").groupBy("session_id", "first").agg(F.sum("messages").alias("messages"), F.sum("unsound").alias("unsound"))
    counts = units.groupBy("session_id").agg(F.sum("messages").alias("messages"), F.sum("unsound").alias("unsound"), F.count("*").alias("units"))
    # A session is judged again from all its messages if one came when its unit was closed, has no time at all, or has
    # copies of other sessions or times.
    moved = messages.groupBy("id").agg(F.min("session_id").alias("s1"), F.max("session_id").alias("s2"), F.min("created_at").alias("c1"), F.max("created_at").alias("c2")).where("s1 <> s2 or c1 <> c2").select("id")
    odd = messages.select("id", "session_id").join(moved, "id", "left_semi").select("session_id")
    again = cut(emitted.where("kind = 'late'").select("session_id").union(messages.where("created_at is null").select("session_id")).union(odd).distinct(), "p2-again")
    whole = latest_messages(messages.join(again, "session_id", "left_semi"))
    recount = whole.groupBy("session_id").agg(F.count("*").alias("messages"), F.count(F.when(~F.col("sound"), 1)).alias("unsound"))
    every = counts.join(again, "session_id", "left_anti").select("session_id", "messages", "unsound", F.lit(False).alias("redone"))
    every = cut(every.unionByName(recount.withColumn("redone", F.lit(True))), "p2-counts")
    # A session that closed more than once, or by the hour, goes on where the unit before it ended.
    parted = counts.where("units > 1").select("session_id")
    offsets = units.join(parted, "session_id", "left_semi").withColumn("before", (F.sum("messages").over(Window.partitionBy("session_id").orderBy("first")) - F.col("messages")).cast("int")).select("session_id", "first", "before")
    turns = emitted.where("kind = 'turn'").join(offsets, ["session_id", "first"], "left")
    turns = turns.select("session_id", F.lit(False).alias("redone"), (F.col("n") + F.coalesce("before", F.lit(0))).alias("n"), "text", "reply")
    redone = numbered(whole, "session_id", ["created_at", "id"], messages.count()).select("session_id", F.lit(True).alias("redone"), "n", "text", "reply")
    return turns.unionByName(redone), every


def session_states(counts: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id, messages, state, redone for every session of either table: ok, empty (in sessions, without message),
    unknown (messages, not in sessions) or broken (a message's text or reply is null or has no visible character)."""
    known = sessions.select(session_key(F.col("id")).alias("session_id")).where("session_id is not null").distinct().withColumn("known", F.lit(True))
    state = F.when(F.col("messages").isNull(), "empty").when(F.col("known").isNull(), "unknown").when(F.col("unsound") > 0, "broken").otherwise("ok")
    return known.join(counts, "session_id", "full").select("session_id", F.coalesce("messages", F.lit(0)).cast("bigint").alias("messages"), state.alias("state"), "redone")


def conversations(spark: SparkSession, messages_path: str, sessions: DataFrame) -> DataFrame:
    """session_id, turn, role, text of the sound sessions: for each message in order of created_at, ties by id, a user
    turn and an assistant turn. Broken, empty and unknown sessions are left out; session_states gives their reasons.

    Messages without session are left out. One without id is a message of its own (equal ones are copies); one without
    created_at stands at the time of its arrival, and first where it has neither. Of the copies of an id the one that
    arrived last counts, in its session and at its time.
    """
    turns, counts = rebuilt(spark, messages_path)
    good = cut(session_states(counts, sessions).where("state = 'ok'").select("session_id", "redone", "messages"), "p2-good")
    ordered = keyed_join(turns, good, ["session_id", "redone"], "messages", good.agg(F.sum("messages")).first()[0] or 0)
    pair = F.array(F.struct((F.col("n") * 2 - 1).alias("turn"), F.lit("user").alias("role"), F.col("text").alias("text")), F.struct((F.col("n") * 2).alias("turn"), F.lit("assistant").alias("role"), F.col("reply").alias("text")))
    return ordered.select("session_id", F.explode(pair).alias("t")).select("session_id", "t.turn", "t.role", "t.text")


def dropped_sessions(spark: SparkSession, messages_path: str, sessions: DataFrame) -> DataFrame:
    """session_id, state of the sessions that are no conversation."""
    _, counts = rebuilt(spark, messages_path, with_text=False)
    return session_states(counts, sessions).where("state <> 'ok'").select("session_id", "state")
