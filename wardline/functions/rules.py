"""From a probability and the features to verdict, family and family scores, all in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import lexicon as lx
from wardline.functions.features import spans, total, vector_columns


def narrative_boosts(p: Column, f21: Column) -> Column:
    """True where the narrative boost applies."""
    return (f21 >= lx.NARRATIVE_LEAST) & (p < lx.NARRATIVE_BELOW)


def boosted(p: Column, f21: Column, hard_hits: Column) -> Column:
    """The probability after the narrative boost or, where that doesn't apply, the keyword boost."""
    narrative = F.least(p + F.least(f21 * lx.NARRATIVE_STEP, F.lit(lx.NARRATIVE_MOST)), F.lit(1.0))
    keyword = F.when((hard_hits >= 1) & (p < lx.KEYWORD_TO), F.lit(lx.KEYWORD_TO)).otherwise(p)
    return F.when(narrative_boosts(p, f21), narrative).otherwise(keyword)


def verdict(p: Column) -> Column:
    return F.when(p >= lx.VERDICT_AT, "BLOCK").otherwise("ALLOW")


def raw_family_scores() -> dict[str, Column]:
    """Each family's score of 0 to 10 from the feature columns."""

    def term(feature: str, cap: float | None, weight: float) -> Column:
        f = F.col(feature)
        return (f if cap is None else F.least(f, F.lit(float(cap)))) * weight

    return {family: F.least(F.lit(10.0), total([term(*t) for t in terms])) for family, terms in lx.FAMILY_WEIGHTS.items()}


def softmax(raw: dict[str, Column]) -> dict[str, Column]:
    most = F.greatest(*raw.values())
    powers = {k: F.exp(v - most) for k, v in raw.items()}
    whole = total(list(powers.values()))
    return {k: F.round(v / whole, 4) for k, v in powers.items()}


def top_family(raw: dict[str, Column]) -> Column:
    """The family of the highest score; of equal ones the first."""
    most = F.greatest(*raw.values())
    return F.coalesce(*[F.when(raw[k] == most, k) for k in lx.FAMILIES])


def family(raw: dict[str, Column], labels: Column) -> Column:
    """The first family a span label stands for, else the top score's, else what weak signals suggest."""
    by_span = F.coalesce(*[F.when(F.array_contains(labels, label), fam) for label, fam in lx.LABEL_FAMILY.items()])
    top = top_family(raw)
    weak_encoding = (top == "encoding_obfuscation") & ((F.col("f05") > 0) | (F.col("f10") > 0.5) | (F.col("f06") >= 3) | (F.col("f08") > 0.5))
    by_score = F.when(F.greatest(*raw.values()) >= lx.FAMILY_AT, top).when(weak_encoding, "encoding_obfuscation").when(F.col("f16") > 0.10, "delimiter_escape").otherwise("indirect_injection")
    return F.coalesce(by_span, by_score)


def scored(rows: DataFrame, probability: str, clusters=None) -> DataFrame:
    """rows, which have features, with spans, confidence, rule_boost_applied, verdict, label, attack_family, family_scores;
    with clusters, a fitted model of them, also cluster_id and cluster_label.

    Family, scores and cluster are of blocked rows only; others have a null family and cluster and an empty map."""
    p0 = F.col(f"`{probability}`")
    after = boosted(p0, F.col("f21"), F.col("hard_hits"))
    applied = narrative_boosts(p0, F.col("f21")) | ((F.col("hard_hits") >= 1) & (p0 < lx.KEYWORD_TO))
    out = rows.withColumns({"spans": spans(F.col("decoded_text"), counted=True), "after": after, "rule_boost_applied": applied})
    out = out.withColumns({"verdict": verdict(F.col("after")), "confidence": F.round("after", 4)})
    raw = raw_family_scores()
    block = F.col("verdict") == "BLOCK"
    scores = F.create_map(*[x for k, v in softmax(raw).items() for x in (F.lit(k), v)])
    if clusters is not None:
        out = out.withColumn("cluster_id", F.when(block, clusters.cluster_id([F.col(c) for c in vector_columns()])))
        out = out.withColumn("cluster_label", clusters.cluster_label(F.col("cluster_id")))
    return out.withColumns({"label": block.cast("int"), "attack_family": F.when(block, family(raw, F.col("spans.label"))), "family_scores": F.when(block, scores).otherwise(F.create_map().cast("map<string,double>"))}).drop("after")
