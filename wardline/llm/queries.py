"""The training-data queries: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import capping, conversations, format_dups, forms, leakage, lookalikes, mixing, overlap, packing, reading, splits
from wardline.llm.support import cut, digest, new_path, table

Query = Callable[[SparkSession, str], DataFrame]


def _entities(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """combined_dataset with its two entities: the template and the record, which copies that differ in format share."""
    rows = table(spark, sf_dir, "combined_dataset").select("template_id", "split", "text", *cols)
    record = F.when(F.col("text").rlike(forms.HAS_WORD), F.concat(*[F.hex(h) for h in digest(forms.record_key(F.col("text")))]))
    return rows.withColumn("record", record).drop("text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = splits.conflicts(_entities(spark, sf_dir), ["template_id", "record"])
    return bad.where("node like 'template_id:%' and size(own_splits) > 1").select(F.substring_index("node", ":", -1).cast("bigint").alias("template_id"))


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entities(spark, sf_dir, "row_id", "label", "source")
    return splits.assign_splits(rows, ["template_id", "record"], table(spark, sf_dir, "split_targets"), store_path=new_path(spark, "p1-store"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.dropped_sessions(spark, f"{sf_dir}/classifications.parquet", table(spark, sf_dir, "sessions")).select("session_id")


def p2_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(spark, f"{sf_dir}/classifications.parquet", table(spark, sf_dir, "sessions"))


def _mix_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "combined_dataset").select("row_id", "source", "label", "quality")
    return mixing.mix_report(*mixing.draw(rows, table(spark, sf_dir, "mix_targets")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix_report(spark, sf_dir).where("short").select("source", "label")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix_report(spark, sf_dir).select("source", "label", "target_share", F.round("reached_share", 6).alias("reached_share"), F.col("rows").alias("cell_rows"), "epochs", "short")


def p3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached where sizes and budgets are tokens of the texts."""
    rows = table(spark, sf_dir, "combined_dataset").select("row_id", "source", "label", "quality", "text")
    sized = cut(packing.count_tokens(rows, keep=["row_id", "source", "label", "quality"]), "p3-tokens")
    report = mixing.mix_report(*mixing.draw(sized, table(spark, sf_dir, "mix_targets"), size_col="tokens"))
    return report.select("source", "label", "target_share", F.round("reached_share", 6).alias("reached_share"), F.col("rows").alias("cell_rows"), "epochs", "short")


def p3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "combined_dataset").select("row_id", "source", "label", "quality")
    return mixing.draw_mix(rows, table(spark, sf_dir, "mix_targets"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.repeated_rows(table(spark, sf_dir, "combined_dataset").select("row_id", "text", "label"))


def p4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_dups.distinct_records(table(spark, sf_dir, "combined_dataset").select("row_id", "text", "label"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "combined_dataset").select(F.col("row_id").alias("id"), "text")
    messages = table(spark, sf_dir, "classifications").select("id", "text")
    return lookalikes.same_look_pairs(rows, messages).select(F.col("left_id").cast("bigint").alias("row_id"), F.col("right_id").alias("classification_id")).distinct()


def p5_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "combined_dataset").select(F.lit("combined_dataset").alias("tab"), F.col("row_id").cast("string").alias("id"), "text")
    messages = table(spark, sf_dir, "classifications").select(F.lit("classifications").alias("tab"), "id", "text")
    return lookalikes.consistent(rows.unionByName(messages)).select("tab", "id", "form")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "combined_dataset").select("row_id", "text", "split", "source")
    pairs = overlap.row_pairs(*overlap.overlaps(rows))
    return pairs.select(F.least("train_id", "eval_id").alias("row_id_a"), F.greatest("train_id", "eval_id").alias("row_id_b")).distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "combined_dataset").select("row_id", "text", "split", "source")
    return overlap.overlap_report(*overlap.overlaps(rows))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "combined_dataset").select("row_id", "template_id", "quality")
    return capping.cap_contributors(rows, "template_id", "quality", max_rows=5).where("not keep").select("row_id")


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "combined_dataset").select("row_id", "template_id", "quality")
    kept = capping.cap_contributors(rows, "template_id", "quality", max_rows=5).where("keep").select("row_id", F.col("key").alias("template_id"))
    return kept.unionByName(rows.where("template_id is null").select("row_id", "template_id"))


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")
    return packing.pack(packing.count_tokens(texts), table(spark, sf_dir, "containers")).withColumnRenamed("item_id", "doc_id")


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_report(p8_packing(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return leakage.leaks(documents, table(spark, sf_dir, "holdout_items").select("item_id", "text")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_levels(spark, sf_dir).where("reading_level = 5").select("doc_id")


def p10_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "doc_type")
    return reading.reading_levels(documents, table(spark, sf_dir, "reading_labels").select("doc_id", "reading_level"))


def llm_queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}
