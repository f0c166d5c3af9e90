"""Copies that differ in format only: white space, letter case, punctuation, order of named fields.

Method: dictionary encoding. Each distinct raw field value is canonicalised once and gets an integer; a record becomes
the sorted tuple of its field integers; records are grouped by tuple and label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import forms
from wardline.llm.support import cut, digest, keyed_join


def record_members(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", label_col: str | None = "label") -> DataFrame:
    """One row per input row: row_id, label, first_row_id (the group's smallest id), copies.

    Rows whose label isn't 0 or 1, and texts that are null or hold no letter or digit, take part in no group: they come
    out with their own id and one copy. With label_col None the label doesn't matter. A null id counts as a copy and is
    never the first unless all are null; a repeated id counts once per row. Extra columns are ignored. An empty table
    gives an empty result.
    """
    label = F.col(f"`{label_col}`").cast("int") if label_col else F.lit(0)
    own = rows.select(F.col(f"`{id_col}`").alias("row_id"), F.col(f"`{text_col}`").cast("string").alias("text"), label.alias("label"))
    own = own.withColumn("part", F.coalesce(F.col("label").isin(0, 1) & F.col("text").rlike(forms.HAS_WORD), F.lit(False)))
    encoded = F.transform(forms.raw_fields(F.col("text")), lambda f: F.struct(*digest(f["name"], f["value"]), f["name"].alias("name"), f["value"].alias("value")))
    records = cut(own.where("part").select(F.monotonically_increasing_id().alias("uid"), "row_id", "label", encoded.alias("fields")), "p4-records")
    total = records.count()

    raw = records.select(F.explode("fields").alias("f")).select("f.h1", "f.h2", "f.name", "f.value")
    distinct = raw.groupBy("h1", "h2").agg(F.first("name").alias("name"), F.first("value").alias("value"), F.count("*").alias("uses"))
    canonical = F.concat("name", F.lit("\u0002"), F.regexp_replace(F.lower("value"), forms.NOT_WORD, ""))
    dictionary = cut(distinct.select("h1", "h2", "uses", *[c.alias(n) for c, n in zip(digest(canonical), ("c1", "c2"))]), "p4-values")
    codes = cut(dictionary.groupBy("c1", "c2").agg(F.sum("uses").alias("n")).withColumn("code", F.monotonically_increasing_id()), "p4-codes")
    coded = keyed_join(dictionary, codes, ["c1", "c2"], "n", total).select("h1", "h2", "uses", "code")

    cells = records.select("uid", "row_id", "label", F.explode("fields").alias("f")).select("uid", "row_id", "label", "f.h1", "f.h2")
    coded_cells = keyed_join(cells, coded, ["h1", "h2"], "uses", total)
    tuples = cut(coded_cells.groupBy("uid", "row_id", "label").agg(F.array_sort(F.collect_list("code")).alias("codes")), "p4-tuples")
    groups = tuples.groupBy("codes", "label").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("copies"))
    members = keyed_join(tuples, groups, ["codes", "label"], "copies", total).select("row_id", "label", "first_row_id", "copies")
    rest = own.where(~F.col("part")).select("row_id", "label", F.col("row_id").alias("first_row_id"), F.lit(1).cast("bigint").alias("copies"))
    return members.unionByName(rest)


def repeated_rows(rows: DataFrame) -> DataFrame:
    """first_row_id, row_id of each row that repeats another."""
    return record_members(rows).where("copies > 1 and row_id <> first_row_id").select("first_row_id", "row_id")


def distinct_records(rows: DataFrame) -> DataFrame:
    """Each record once: row_id, label, text of its first row, and copies."""
    first = record_members(rows).where("row_id = first_row_id").select("row_id", "copies")
    return first.join(rows.select("row_id", "label", "text"), "row_id").select("row_id", "label", "text", "copies")
