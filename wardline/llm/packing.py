"""Items placed in containers of fixed capacity with little space left.

Method: minimum bin slack. The longest item left opens a container; a subset-sum dynamic programme over the multiset of
the lengths left, one bit per sum, finds the lengths that fill it closest to capacity, and the choice is traced back
with counts and repeated as long as the counts last. Items are packed in windows of bounded size, which run apart.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardline.llm.support import cut

_shipped: set[tuple[str, str]] = set()
#: A place where a word ends and a single blank and a letter follow.
_WORD_START = re.compile(r"[^\W\d_](?= [^\W\d_])")

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the tokenizer's vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WINDOW_ITEMS = 20_000
#: Container kinds that one call packs; more are an error.
MOST_KINDS = 1000
#: Characters of a text that are encoded at a time, cut at a blank: the pattern never joins words, so that counts add up.
PIECE_CHARS = 1 << 20

_encoders: dict = {}


def _encoder(name: str):
    """The encoder of a vocabulary file that was shipped with the job; a worker keeps it."""
    if name not in _encoders:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[name]


def _pieces(text: str) -> Iterator[str]:
    """text in pieces that each begin with a blank before a letter, where the pattern begins a word anyway."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut_at = _WORD_START.search(text, at + PIECE_CHARS)
        if not cut_at:
            break
        yield text[at : cut_at.start() + 1]
        at = cut_at.start() + 1
    yield text[at:]


def count_tokens(texts: DataFrame, path: str = TOKENIZER, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep, item_id unless others are named, and tokens of a table with text; null texts have none.

    Special tokens' strings count as text. path names the vocabulary on the driver, which ships it to the workers.
    """
    spark, name = texts.sparkSession, path.rsplit("/", 1)[-1]
    if (spark.sparkContext.applicationId, path) not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add((spark.sparkContext.applicationId, path))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(name).encode_ordinary
        for b in batches:
            yield b.drop(columns="text").assign(tokens=[sum(len(encode(p)) for p in _pieces(t)) if t else 0 for t in b["text"]])

    own = texts.select(*(keep or [F.col("item_id").cast("long").alias("item_id")]), F.col("text").cast("string").alias("text"))
    return own.mapInPandas(count, StructType([f for f in own.schema.fields if f.name != "text"] + [StructField("tokens", LongType())]))


def fill(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(lengths with counts of one container, how many such containers)] that use up the multiset counts."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    out = []
    while left:
        seed = next(iter(left))
        left[seed] -= 1
        room = capacity - seed
        used = {seed: 1}
        if room > 0:
            mask, reach, steps = (1 << (room + 1)) - 1, 1, []
            for n, c in left.items():
                if n > room or not c:
                    continue
                times, most = 1, min(c, room // n)
                while most > 0:
                    k = min(times, most)
                    steps.append((n, k, reach))
                    reach |= (reach << (n * k)) & mask
                    most -= k
                    times *= 2
                if reach >> room:
                    break
            total = reach.bit_length() - 1
            for n, k, before in reversed(steps):
                if not (before >> total) & 1:
                    used[n] = used.get(n, 0) + k
                    total -= n * k
        left[seed] += 1
        repeats = min(left[n] // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * repeats
            if not left[n]:
                del left[n]
        out.append((used, repeats))
    return out


def _pack(window: pd.DataFrame) -> pd.DataFrame:
    window = window.sort_values(["tokens", "item_id", "piece"], kind="stable").reset_index(drop=True)
    capacity = int(window["capacity"].iloc[0])
    places: dict[int, list[int]] = {}
    for i, n in enumerate(window["tokens"]):
        places.setdefault(int(n), []).append(i)
    bins = [0] * len(window)
    number = 0
    for used, repeats in fill({n: len(p) for n, p in places.items()}, capacity):
        for _ in range(repeats):
            for n, k in used.items():
                for _ in range(k):
                    bins[places[n].pop()] = number
            number += 1
    return window.assign(bin_id=window["window"].astype("int64") * (1 << 32) + pd.Series(bins, dtype="int64"))[["container", "capacity", "bin_id", "item_id", "piece", "tokens"]]


def pack(sizes: DataFrame, containers: DataFrame, window_items: int = WINDOW_ITEMS) -> DataFrame:
    """container, capacity, bin_id, item_id, piece, tokens: every item in a container of each kind.

    An item above the capacity is cut into pieces of the capacity and one rest, numbered from 0; no other is split. An
    item without tokens needs no container: bin_id null. Null sizes count as 0; containers of no capacity get nothing. A
    bin_id is one of its kind and capacity; those below 0 are of containers that one piece fills. Kinds named twice with
    one capacity are one.
    """
    items = cut(sizes.select(F.col("item_id").cast("long"), F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long").alias("tokens")), "p8-sizes")
    windows = -(-items.count() // window_items) or 1
    kinds = containers.select("container", F.col("capacity_tokens").cast("long").alias("capacity")).where("capacity > 0").distinct().orderBy("capacity", "container").limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} kinds of containers")
    listed = F.array(*[F.struct(F.lit(k["container"]).alias("container"), F.lit(k["capacity"]).cast("long").alias("capacity")) for k in kinds]).cast("array<struct<container:string,capacity:bigint>>")
    placed = items.select("item_id", "tokens", F.pmod(F.xxhash64("item_id"), F.lit(windows)).alias("window"), F.explode(listed).alias("k")).select("item_id", "tokens", "window", "k.container", "k.capacity")
    # Pieces of the whole capacity fill a container each, with no choice to make: they are numbered here, beside the windows.
    whole, rest = F.floor(F.col("tokens") / F.col("capacity")), F.col("tokens") % F.col("capacity")
    full = placed.where("tokens >= capacity").select("container", "capacity", "item_id", F.explode(F.sequence(F.lit(0), whole.cast("int") - 1)).alias("piece"), F.col("capacity").alias("tokens"))
    full = full.select("container", "capacity", (-1 - F.monotonically_increasing_id()).alias("bin_id"), "item_id", "piece", "tokens")
    left = placed.where(rest > 0).select("container", "capacity", "window", "item_id", whole.cast("int").alias("piece"), rest.alias("tokens"))
    schema = "container string, capacity long, bin_id long, item_id long, piece int, tokens long"
    packed = left.groupBy("container", "capacity", "window").applyInPandas(_pack, schema)
    none = placed.where("tokens = 0").select("container", "capacity", F.lit(None).cast("long").alias("bin_id"), "item_id", F.lit(0).alias("piece"), "tokens")
    return packed.unionByName(full).unionByName(none)


def packing_report(packed: DataFrame) -> DataFrame:
    """Per container kind: containers used, tokens in them, the share of their capacity that is filled."""
    used = packed.where("bin_id is not null").groupBy("container", "capacity").agg(F.countDistinct("bin_id").alias("bins"), F.sum("tokens").alias("tokens"))
    return used.withColumn("filled", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity")), 6))
