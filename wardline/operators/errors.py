"""What a model gets wrong: counts, and examples with the features that stand out in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.features import vector_columns, with_features
from wardline.operators.metrics import top_by_size

#: Examples of each kind, characters of their text, and the probability from which a text counts as an attack.
EXAMPLES, TEXT_CHARS, THRESHOLD = 10, 300, 0.5


def error_report(rows: DataFrame, score: str, key: str = "row_id", text: str = "text", label: str = "label", n: int = EXAMPLES) -> DataFrame:
    """kind (false_positive, false_negative), count of its errors, key, text, label, predicted, confidence, top_features.

    The first n errors of each kind by key are examples, with their text cut and the five features of the largest size.
    Features are taken of the examples only. Rows with a null score are not judged.
    """
    predicted = (F.col(score) >= THRESHOLD).cast("int")
    wrong = rows.withColumn("predicted", predicted).where(F.col("predicted") != F.col(label))
    wrong = wrong.withColumn("kind", F.when(F.col("predicted") == 1, "false_positive").otherwise("false_negative"))
    counts = wrong.groupBy("kind").agg(F.count("*").alias("count"))
    examples = [wrong.where(F.col("kind") == k).orderBy(key).limit(n) for k in ("false_positive", "false_negative")]
    featured = with_features(examples[0].unionByName(examples[1]), text)
    named = featured.select("kind", key, F.substring(text, 1, TEXT_CHARS).alias("text"), label, "predicted", F.round(score, 4).alias("confidence"), top_by_size(vector_columns()).alias("top_features"))
    return named.join(F.broadcast(counts), "kind")
