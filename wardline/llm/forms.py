"""Text forms that several operators compare by.

record_fields  a text as named fields: a structured prompt's fields in name order, else one field without name
record_key     letters and digits only, lower case, fields in order: equal for texts that differ in format alone
record_words   the same as words, one space between them
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Start of a named field: at the text's start, after a line break or semicolon, or at a quoted key in an object.
FIELD_START = r'(?:^[^\p{L}\p{N}]*|[\n\r;]\s*|[,{](?=\s*"))\s*"?([\p{L}_][\p{L}\p{N}_-]*)\s*"?\s*[:=]'
FIRST_FIELD = r'^[^\p{L}\p{N}]*[\p{L}_][\p{L}\p{N}_-]*\s*"?\s*[:=]'
#: Written so that a letter, the commonest sign, is told by one look.
NOT_WORD = r"[\P{L}&&\P{N}&&\P{M}]+"
HAS_WORD = r"[\p{L}\p{N}]"


def is_structured(text: Column) -> Column:
    """True for a text that begins with a named field and has at least two."""
    return text.rlike(FIRST_FIELD) & (F.regexp_count(text, F.lit(FIELD_START)) >= 2)


def raw_fields(text: Column) -> Column:
    """ARRAY<STRUCT<name, value>> of a text as it stands; the name is empty for a text without named fields."""
    marked = F.regexp_replace(text, FIELD_START, "\u0001$1\u0002")
    parts = F.filter(F.split(marked, "\u0001"), lambda p: p.contains("\u0002"))
    named = F.transform(parts, lambda p: F.struct(F.lower(F.substring_index(p, "\u0002", 1)).alias("name"), F.substring_index(p, "\u0002", -1).alias("value")))
    return F.when(is_structured(text), named).otherwise(F.array(F.struct(F.lit("").alias("name"), text.alias("value"))))


def plain_words(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(value), NOT_WORD, " "))


def record_words(text: Column) -> Column:
    """Lower-case words with one space between; a structured prompt's fields, names included, in order."""
    fields = F.array_sort(F.transform(raw_fields(text), lambda f: plain_words(F.concat_ws(" ", f["name"], f["value"]))))
    return F.when(is_structured(text), F.array_join(fields, " ")).otherwise(plain_words(text))


def record_key(text: Column) -> Column:
    """What is left of a text without format: equal for copies that differ in format alone."""
    fields = F.array_sort(F.transform(raw_fields(text), lambda f: F.regexp_replace(F.lower(F.concat(f["name"], F.lit("\u0002"), f["value"])), r"[^\p{L}\p{N}\p{M}\x02]+", "")))
    return F.when(is_structured(text), F.array_join(fields, "\u0001")).otherwise(F.regexp_replace(F.lower(text), NOT_WORD, ""))
