"""Reading level of each document.

Method: a smoothed unigram language model per level, trained on the documents that raters have labelled, and one per
other language and per kind of text that has no level. What the models' words say is joined by how long a class's texts
are and by how frequent the class is. Short notes are written in the words of all levels, so that their words are judged by
the levels' models and only length and frequency tell them from prose. A document gets the class with the highest posterior;
it has a level if that class is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.leakage import words_of
from wardline.llm.support import cut

LEVELS = (1, 2, 3, 4, 5)
#: Bounds of the model: its commonest words, a word's least count, languages besides English that have a model of their own.
VOCABULARY = 50_000
LEAST_COUNT = 3
LANGUAGES = 12
#: The class of all rarer languages.
OTHER_LANGUAGE = "lang:other"
#: Weight of the words' distribution over all classes, in words per class and vocabulary entry.
SMOOTHING = 0.05
#: A text's shape is its length, to a quarter of a doubling, and its sentences, up to a number; the weight of all shapes alike.
LENGTH_STEPS, LENGTHS, SENTENCES, SHAPE_WEIGHT = 4, 120, 6, 0.2
NO_LEVEL = ("transcript", "log", "note")
NUMBER, LATIN, OTHER = "\u0001number", "\u0001latin", "\u0001other"


def language(lang: Column) -> Column:
    """The language of a tag in any of its forms: en, EN, en-EN."""
    return F.nullif(F.lower(F.substring_index(F.regexp_replace(F.trim(lang), "_", "-"), "-", 1)), F.lit(""))


def _kind(word: Column) -> Column:
    """What stands for words outside the vocabulary: numbers, Latin words, others."""
    return F.when(word.rlike("^[0-9]+$"), NUMBER).when(word.rlike("^[a-z0-9]+$"), LATIN).otherwise(OTHER)


@dataclass
class Model:
    classes: list[str]
    words: list[str]
    logs: np.ndarray  # [word, class]
    shapes: np.ndarray  # [shape, class]
    priors: np.ndarray


def _shape(text: Column) -> Column:
    step = F.least(F.floor(F.log2(F.greatest(F.length(text), F.lit(1)).cast("double")) * LENGTH_STEPS), F.lit(LENGTHS - 1))
    return (step * (SENTENCES + 1) + F.least(F.regexp_count(text, F.lit(r"[.?!](\s|$)")), F.lit(SENTENCES))).cast("int")


def train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled documents, all of them; None without any.

    A document's level is the median of its raters' levels, null levels and levels outside 1 to 5 left out. A level is as
    frequent as among the labelled documents, all levels together as English documents of the types that have one. Rare
    languages are one class. Nothing but the model leaves the cluster: VOCABULARY words with a count per class, and
    a count per shape and class.
    """
    rated = labels.where(F.col("reading_level").isin(*LEVELS)).groupBy("doc_id").agg(F.round(F.expr("percentile(reading_level, 0.5)")).cast("int").alias("level"))
    docs = documents.select("doc_id", "text", language(F.col("lang")).alias("lang"), F.lower("doc_type").alias("doc_type")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    foreign = docs.where("lang <> 'en'").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    joined = docs.join(rated, "doc_id", "left").join(F.broadcast(foreign.select("lang", F.lit(True).alias("own"))), "lang", "left")
    named = F.when(F.col("own"), F.concat(F.lit("lang:"), "lang")).otherwise(OTHER_LANGUAGE)
    label = F.when(F.col("level").isNotNull(), F.concat(F.lit("level:"), F.col("level").cast("string"))).when(F.col("doc_type").isin(*NO_LEVEL), F.concat(F.lit("type:"), "doc_type")).when(F.col("lang") != "en", named)
    prose = (F.col("lang") == "en") & ~F.coalesce(F.col("doc_type").isin(*NO_LEVEL), F.lit(False))
    texts = joined.select(label.alias("class"), F.coalesce(prose, F.lit(False)).alias("prose"), "text")
    sizes = texts.groupBy("class", "prose", _shape(F.col("text")).alias("shape")).agg(F.count("*").alias("n")).collect()  # classes times shapes
    classes = sorted({r["class"] for r in sizes if r["class"]})
    if not classes:
        return None
    at = {c: i for i, c in enumerate(classes)}
    shapes, priors = np.zeros((LENGTHS * (SENTENCES + 1), len(classes))), np.zeros(len(classes))
    for r in sizes:
        if r["class"]:
            shapes[r["shape"], at[r["class"]]] += r["n"]
            priors[at[r["class"]]] += r["n"]
    levels = np.array([c.startswith("level:") for c in classes])
    if levels.any():
        priors[levels] *= max(1, sum(r["n"] for r in sizes if r["prose"])) / priors[levels].sum()
        # Levels are judged by words, not by how long their few labelled texts happen to be.
        shapes[:, levels] = shapes[:, levels].sum(1, keepdims=True)
    words = texts.where("class is not null").select("class", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''")
    counts = cut(words.groupBy("class", "word").agg(F.count("*").alias("n")), "p10-counts")
    common = counts.groupBy("word").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST_COUNT).orderBy(F.desc("all"), "word").limit(VOCABULARY).select("word", F.lit(True).alias("in"))
    placed = counts.join(common, "word", "left").select("class", F.when(F.col("in"), F.col("word")).otherwise(_kind(F.col("word"))).alias("word"), "n")
    wide = placed.groupBy("word").agg(*[F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(0)).cast("double").alias(f"c{i}") for i, c in enumerate(classes)])
    rows = wide.toArrow()  # VOCABULARY words and three more
    vocabulary = rows.column("word").to_pylist()
    table = np.stack([rows.column(f"c{i}").to_numpy() for i in range(len(classes))], axis=1)
    missing = [w for w in (NUMBER, LATIN, OTHER) if w not in set(vocabulary)]
    vocabulary, table = vocabulary + missing, np.concatenate([table, np.zeros((len(missing), len(classes)))])
    share = (table.sum(1) + 1) / (table.sum() + len(vocabulary))
    weight = SMOOTHING * len(vocabulary)
    logs = np.log((table + weight * share[:, None]) / (table.sum(0) + weight))
    alike = SHAPE_WEIGHT * shapes.sum(0)
    return Model(classes, vocabulary, logs, np.log((shapes + alike / len(shapes)) / (shapes.sum(0) + alike)), np.log(priors / priors.sum()))


def _score(sent) -> object:
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        classes, at = model.classes, {w: i for i, w in enumerate(model.words)}
        get, number, latin, other = at.get, at[NUMBER], at[LATIN], at[OTHER]
        logs = model.logs.astype(np.float32)
        typed = np.array([c.startswith("type:") for c in classes])
        levels = np.array([c.startswith("level:") for c in classes])
        notes = classes.index("type:note") if "type:note" in classes and levels.any() else None
        for batch in batches:
            best, margins = [], []
            for text, known, shape in zip(batch["text"], batch["doc_type"], batch["shape"]):
                ids = [i if (i := get(w)) is not None else number if w.isdigit() else latin if w.isascii() else other for w in words_of(text)]
                uses = np.bincount(ids, minlength=1)
                seen = np.flatnonzero(uses)
                sums = uses[seen].astype(np.float32) @ logs[seen]
                if notes is not None:
                    sums[notes] = sums[levels].max()
                sums = sums + model.shapes[shape] + model.priors
                if known is not None:  # of a kind that the models need not tell
                    sums = np.where(typed, sums.min(), sums)
                first = int(sums.argmax())
                best.append(classes[first])
                margins.append(float(sums[first] - np.partition(sums, -2)[-2]) if len(sums) > 1 else 0.0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "doc_type": batch["doc_type"], "best": best, "margin": margins})

    return score


def reading_levels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, reading_level, kind, margin, one row per document.

    kind is level:N for English prose, else lang:xx, lang:other, type:xx or blank, and the level is then null. A
    transcript, log or note by its doc_type has no level; where the type is null, the models tell them. The language tag is
    used for training only. Null and blank texts are blank. Texts are read whole. margin is the log of the odds to the next
    class. Without labels no document has a level.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", F.lower("doc_type").alias("doc_type"), "lang")
    model = train(docs, labels)
    has_text = F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    blank = docs.where(~has_text).select("doc_id", F.lit(None).cast("int").alias("reading_level"), F.lit("blank").alias("kind"), F.lit(0.0).alias("margin"))
    if model is None:
        return docs.select("doc_id", F.lit(None).cast("int").alias("reading_level"), F.when(has_text, "unknown").otherwise("blank").alias("kind"), F.lit(0.0).alias("margin"))
    rows = docs.where(has_text).select("doc_id", "text", "doc_type", _shape(F.col("text")).alias("shape"))
    scored = rows.mapInPandas(_score(spark.sparkContext.broadcast(model)), "doc_id long, doc_type string, best string, margin double")
    judged = scored.withColumn("kind", F.when(F.col("doc_type").isin(*NO_LEVEL), F.concat(F.lit("type:"), "doc_type")).otherwise(F.col("best")))
    level = F.when(F.col("kind").startswith("level:"), F.substring_index("kind", ":", -1).cast("int"))
    return judged.select("doc_id", level.alias("reading_level"), "kind", "margin").unionByName(blank)
