"""The 21 features of a text and the labelled spans of its phrase matches.

Every feature is a Column over two texts: `text` as it came and `decoded` as normalised. with_features gives the same values
for all of them at once, from an Arrow step (batch) that reads a text a few times in all.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from math import log

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from wardline.functions import batch
from wardline.functions import lexicon as lx

WORD = r"[\p{L}\p{N}_]+"
#: Of each phrase group, literals of which every match holds at least one: a text without any is not searched further.
LITERALS = {
    "override": "ignore disregard forget override bypass instructions pretend simulation decode",
    "role_swap": "you pretend play switch now",
    "act_as": "act dan jailbroken dude stan kevin evil chaos abide broken has have without",
    "harmful_role": "rob thief burglar mugger carjacker pickpocket shoplifter criminal murder kill hitman assassin terrorist bomb extremist jihadist hack cracker drug meth arms rapist offender molester predator groomer scammer fraudster artist stab shoot poison blow steal traffick synthesize",
    "exfil": "give tell show reveal share send output print display key secret password credential token confidential data information records details spill prompt instruction code",
    "filter_bypass": "bypass jailbreak restrict limit mode dan safety filter guardrail rule",
    "narrative": "game hypothetically scenario story roleplay world universe rule conversation everything",
}
#: The letters that a group's matches begin with: a place with another one is passed over without a try of every phrase.
FIRST = {"override": "bdfiopsy", "role_swap": "fipsy", "act_as": "abdhwy", "harmful_role": "abhiprs", "exfil": "acdegloprstu", "filter_bypass": "bdfijnrstu", "narrative": "fhilnrtwy"}


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _held(text: Column, pattern: str) -> Column:
    """How many of the text's characters are in matches of the pattern."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")


def lowered(text: Column) -> Column:
    """The text as may_match looks at it. A column of its own, so that it is made once for all literals."""
    return F.translate(F.lower(text), "ſ", "s")


def may_match(low: Column, group: str) -> Column:
    """False for a lowered text that cannot hold a phrase of the group."""
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in LITERALS[group].split()])


def phrase_count(text: Column, group: str, low: Column | None = None) -> Column:
    return F.when(may_match(lowered(text) if low is None else low, group), _count(text, f"(?iU)(?=[{FIRST[group]}])(?:{lx.alternation(group)})")).otherwise(0.0)


def char_count(text: Column, chars: str) -> Column:
    """How many of the text's characters are in the set."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _entropy(text: str | None) -> float:
    n, bits = len(text or ""), 0.0
    for c in Counter(text or "").values():
        bits -= c / n * (log(c / n) / log(2))
    return bits


@F.pandas_udf(DoubleType())
def entropy(texts: pd.Series) -> pd.Series:
    """Shannon entropy of the characters in bits; 0 for an empty text. In an Arrow batch, as expressions would read the text
    once per distinct character."""
    return texts.map(_entropy).astype("float64")


def sentence_count(text: Column) -> Column:
    """Pieces between full stops, exclamation and question marks that aren't blank, at least 1."""
    return F.greatest(F.size(F.filter(F.split(text, "[.!?]+"), lambda s: s.rlike(r"(?U)\S"))), F.lit(1)).cast("double")


def encoding_features(text: Column) -> dict[str, Column]:
    n = F.length(text)
    signs = F.contains(text, F.lit("=")) | F.contains(text, F.lit("+")) | F.contains(text, F.lit("/"))  # every match holds one
    f05 = F.when(signs & text.rlike(lx.BASE64_BLOB), 1.0).otherwise(0.0)
    f06, f07 = char_count(text, lx.LOOKALIKES[0]), char_count(text, lx.INVISIBLE)
    f08 = _share(char_count(text, lx.LEET[0]), n)
    f09 = _share((n - F.length(F.regexp_replace(text, r"[^\x00-\x7F]+", ""))).cast("double"), n)
    return {"f05": f05, "f06": f06, "f07": f07, "f08": f08, "f09": f09, "f10": encoding_score(f05, f06, f07, f08, f09)}


def encoding_score(f05: Column, f06: Column, f07: Column, f08: Column, f09: Column) -> Column:
    return F.least(f05 * 0.30 + F.least(f06 / 10.0, F.lit(1.0)) * 0.25 + F.least(f07 / 5.0, F.lit(1.0)) * 0.20 + f08 * 0.15 + f09 * 0.10, F.lit(1.0))


def structure_parts(decoded: Column) -> dict[str, Column]:
    """The counts that the features of structure share."""
    return {
        "_letters": _held(decoded, r"\p{L}+"),
        "_words": _count(decoded, WORD),
    }


def structure_features(text: Column, decoded: Column, parts: dict[str, Column] | None = None) -> dict[str, Column]:
    """parts: structure_parts, where they are columns already."""
    letters, words = (parts or structure_parts(decoded)).values()
    special = F.length(F.regexp_replace(decoded, r"(?U)[\p{L}\p{N}\s]+", "")).cast("double")
    pieces = F.size(F.filter(F.split(decoded, "[.!?]+"), lambda s: s.rlike(r"(?U)\S")))
    opener = F.lower(F.regexp_extract(decoded, WORD, 0)).isin(lx.IMPERATIVES)
    return {
        "f12": _share(_held(decoded, r"\p{Lu}+"), letters),
        "f13": _share(_held(decoded, WORD), words),
        "f14": sentence_count(decoded),
        "f15": _share(words, pieces),
        "f16": _share(special, F.length(decoded)),
        "f17": char_count(text, "!"),
        "f18": F.when(opener, 1.0).otherwise(0.0),
        "f19": F.length(text).cast("double"),
        "f20": words,
    }


def keyword_features(decoded: Column, low: Column | None = None) -> dict[str, Column]:
    """The phrase counts; low is the lowered text, where that is a column already."""
    return keyword_sums({g: phrase_count(decoded, g, low) for g in lx.PHRASES})


def keyword_sums(c: dict[str, Column]) -> dict[str, Column]:
    return {"f01": c["override"], "f02": c["role_swap"] + c["act_as"] + c["harmful_role"], "f03": c["exfil"], "f04": c["filter_bypass"], "f21": c["narrative"], "hard_hits": c["override"] + c["act_as"] + c["harmful_role"] + c["filter_bypass"]}


def _after(order: int, label: str):
    """One step along a text's gaps and matches: where it ends, and the matches so far."""

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["gap"])
        end = at + F.coalesce(F.length(pair["hit"]), F.lit(0))
        more = F.array(F.struct(at.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(label).alias("label")))
        return F.struct(end.alias("at"), F.when(pair["hit"].isNotNull(), F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    return step


#: The feature that counts a group's phrases: where it is 0 there are no spans to look for.
COUNTED_BY = {"override": "f01", "role_swap": "f02", "act_as": "f02", "harmful_role": "f02", "exfil": "f03", "filter_bypass": "f04", "narrative": "f21"}


def spans(decoded: Column, counted: bool = False) -> Column:
    """ARRAY<STRUCT<start, end, label>>, offsets in characters of the decoded text, by start, then group order.

    counted says that the row has its features: a group whose count is 0 is not searched."""
    found = []
    for order, (group, label) in enumerate(lx.SPAN_LABELS.items()):
        pattern = f"(?iU){lx.alternation(group)}"
        hits = F.regexp_extract_all(decoded, F.lit(pattern), F.lit(0))
        gaps = F.split(decoded, pattern, -1)
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,`order`:int,end:int,label:string>>)").alias("out"))

        pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        none = F.expr("cast(array() as array<struct<start:int,`order`:int,end:int,label:string>>)")
        guard = F.col(COUNTED_BY[group]) > 0 if counted else may_match(lowered(decoded), group)
        found.append(F.when(guard & decoded.rlike(pattern), F.aggregate(pairs, start, _after(order, label), lambda acc: acc["out"])).otherwise(none))
    listed = F.array_sort(F.concat(*found))
    return F.transform(listed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))


@F.arrow_udf(batch.SCHEMA)
def _measured(texts: pa.Array) -> pa.Array:
    return batch.measured(texts, True)


@F.arrow_udf(batch.SCHEMA)
def _measured_as_is(texts: pa.Array) -> pa.Array:
    return batch.measured(texts, False)


def with_features(rows: DataFrame, text_col: str = "text", normalise: bool = True) -> DataFrame:
    """rows with decoded_text, f01 to f21 and hard_hits. Null texts count as empty."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = rows.withColumn("_all", (_measured if normalise else _measured_as_is)(text))
    at = F.col("_all")
    named = keyword_sums({g: at[g] for g in lx.PHRASES}) | {k: at[k] for k in batch.FIELDS if k.startswith("f") and k[1:].isdigit()}
    named["f10"] = encoding_score(*[at[f"f{i:02d}"] for i in range(5, 10)])
    kept = [c for c in rows.columns if c not in named and c != "decoded_text"]
    return out.select(*[F.col(f"`{c}`") for c in kept], at["decoded_text"].alias("decoded_text"), *[named[k].alias(k) for k in sorted(named)])


def vector_columns() -> list[str]:
    """f01 to f21, in the order of the vector."""
    return [f"f{i:02d}" for i in range(1, 22)]


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)
