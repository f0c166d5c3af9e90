"""Queries over normalisation, features, rules and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions import features as fx
from wardline.functions import lexicon as lx
from wardline.functions import normalize as nz
from wardline.functions import rules
from wardline.plans.registry import query, table
from wardline.session import spread


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "combined_dataset").select("row_id", "text"))


_LOOK = f"translate(text, {_lit(lx.LOOKALIKES[0] + lx.MARKS[0])}, {_lit(lx.LOOKALIKES[1] + lx.MARKS[1])})"
_CHARS = "CAST(length(text) - length(translate(text, {0}, '')) AS DOUBLE)"


@query(f"SELECT doc_id, md5({_LOOK}) AS folded FROM documents")
def lookalike_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(nz.fold_lookalikes(F.col("text"))).alias("folded"))


@query(f"SELECT doc_id, md5(translate(text, {_lit(lx.INVISIBLE)}, '')) AS stripped FROM documents")
def strip_invisible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(nz.strip_invisible(F.col("text"))).alias("stripped"))


@query(f"SELECT doc_id, md5(translate(text, {_lit(lx.LEET[0])}, {_lit(lx.LEET[1])})) AS plain FROM documents")
def leet_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(nz.fold_leet(F.col("text"))).alias("plain"))


@query()
def base64_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).withColumn("decoded", nz.decode_base64(F.col("text")))
    return rows.select("doc_id", "decoded", (F.col("decoded") != F.col("text")).alias("changed"))


@query()
def nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", nz.nfkc(F.col("text")).alias("composed"))


@query()
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", nz.normalized(F.col("text")).alias("decoded_text"))


@query(f"""
WITH f AS (SELECT doc_id, length(text) AS n, CASE WHEN regexp_matches(text, {_lit(lx.BASE64_BLOB)}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f05, {_CHARS.format(_lit(lx.LOOKALIKES[0]))} AS f06,
 {_CHARS.format(_lit(lx.INVISIBLE))} AS f07, {_CHARS.format(_lit(lx.LEET[0]))} AS leet, CAST(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) AS DOUBLE) AS wide FROM documents WHERE text IS NOT NULL),
g AS (SELECT *, CASE WHEN n > 0 THEN leet / n ELSE 0 END AS f08, CASE WHEN n > 0 THEN wide / n ELSE 0 END AS f09 FROM f)
SELECT doc_id, f05, f06, f07, round(f08, 6) AS f08, round(f09, 6) AS f09, round(least(f05 * 0.30::DOUBLE + least(f06 / 10, 1) * 0.25::DOUBLE + least(f07 / 5, 1) * 0.20::DOUBLE + f08 * 0.15::DOUBLE + f09 * 0.10::DOUBLE, 1), 6) AS f10 FROM g
""")
def feat_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.encoding_features(F.col("text"))
    rounded = {k: F.round(v, 6) if k in ("f08", "f09", "f10") else v for k, v in f.items()}
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", *[v.alias(k) for k, v in rounded.items()])


_SPACE = "\\s\\x0B\\x1C-\\x1F\\x85\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


@query(f"""
WITH f AS (SELECT doc_id, text, length(text) AS n, len(regexp_extract_all(text, '\\p{{L}}')) AS letters, len(regexp_extract_all(text, '\\p{{Lu}}')) AS upper, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS words,
 len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]')) AS word_chars, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '[^{_SPACE}]'))) AS pieces,
 length(regexp_replace(text, '[\\p{{L}}\\p{{N}}{_SPACE}]', '', 'g')) AS special FROM documents WHERE text IS NOT NULL)
SELECT doc_id, round(CASE WHEN letters > 0 THEN upper / letters ELSE 0 END, 6) AS f12, round(CASE WHEN words > 0 THEN word_chars / words ELSE 0 END, 6) AS f13, CAST(greatest(pieces, 1) AS DOUBLE) AS f14,
 round(CASE WHEN pieces > 0 THEN words / pieces ELSE 0 END, 6) AS f15, round(CASE WHEN n > 0 THEN special / n ELSE 0 END, 6) AS f16, {_CHARS.format("'!'")} AS f17,
 CASE WHEN lower(regexp_extract(text, '[\\p{{L}}\\p{{N}}_]+')) IN ({', '.join(map(_lit, lx.IMPERATIVES))}) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS f18, CAST(n AS DOUBLE) AS f19, CAST(words AS DOUBLE) AS f20 FROM f
""")
def feat_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.structure_features(F.col("text"), F.col("text"))
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", *[(F.round(v, 6) if k in ("f12", "f13", "f15", "f16") else v).alias(k) for k, v in f.items()])


@query("""
SELECT doc_id, round(-sum(p * log2(p)), 5) + 0.0 AS f11 FROM (SELECT doc_id, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') WHERE ch <> '' GROUP BY doc_id, ch) GROUP BY doc_id
""")
def feat_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).where("text <> ''").select("doc_id", (F.round(fx.entropy(F.col("text")), 5) + 0.0).alias("f11"))


def _matches(group: str) -> str:
    pattern = lx.alternation(group).replace("\\s+", f"[{_SPACE}]+").replace("\\s*", f"[{_SPACE}]*")
    return f"len(regexp_extract_all(text, {_lit('(?i)' + pattern)}))"


@query(f"""
SELECT row_id, CAST({_matches('override')} AS DOUBLE) AS f01, CAST({_matches('role_swap')} + {_matches('act_as')} + {_matches('harmful_role')} AS DOUBLE) AS f02, CAST({_matches('exfil')} AS DOUBLE) AS f03,
 CAST({_matches('filter_bypass')} AS DOUBLE) AS f04, CAST({_matches('narrative')} AS DOUBLE) AS f21, CAST({_matches('override')} + {_matches('act_as')} + {_matches('harmful_role')} + {_matches('filter_bypass')} AS DOUBLE) AS hard_hits
FROM combined_dataset WHERE text IS NOT NULL
""")
def feat_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).where("text is not null").withColumn("low", fx.lowered(F.col("text")))
    return rows.select("row_id", *[v.alias(k) for k, v in fx.keyword_features(F.col("text"), F.col("low")).items()])


_FOLDED = f"(SELECT row_id, translate(translate({_LOOK}, {_lit(lx.INVISIBLE)}, ''), {_lit(lx.LEET[0])}, {_lit(lx.LEET[1])}) AS text FROM combined_dataset WHERE text IS NOT NULL)"


@query(f"""
SELECT row_id, CAST({_matches('override')} AS DOUBLE) AS f01, CAST({_matches('role_swap')} + {_matches('act_as')} + {_matches('harmful_role')} AS DOUBLE) AS f02, CAST({_matches('exfil')} AS DOUBLE) AS f03,
 CAST({_matches('filter_bypass')} AS DOUBLE) AS f04, CAST({_matches('narrative')} AS DOUBLE) AS f21, CAST(len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+')) AS DOUBLE) AS f20
FROM {_FOLDED}
""")
def feat_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase and word counts of the text as the steps that SQL knows leave it: look-alikes, invisible signs and leet folded."""
    folded = nz.fold_leet(nz.strip_invisible(nz.fold_lookalikes(F.col("text"))))
    rows = _corpus(spark, sf_dir).where("text is not null").select("row_id", folded.alias("text")).withColumn("low", fx.lowered(F.col("text")))
    named = fx.keyword_features(F.col("text"), F.col("low")) | {"f20": fx.structure_features(F.col("text"), F.col("text"))["f20"]}
    return rows.select("row_id", *[named[k].alias(k) for k in ("f01", "f02", "f03", "f04", "f21", "f20")])


@query()
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).where("text is not null").select("row_id", nz.normalized(F.col("text")).alias("decoded_text"))
    return rows.select("row_id", F.explode(fx.spans(F.col("decoded_text"))).alias("s")).select("row_id", "s.start", "s.end", "s.label")


@query()
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.with_features(_corpus(spark, sf_dir))
    return rows.select("row_id", F.array(*fx.vector_columns()).alias("features"))


_STAND = "CAST(((row_id * 37) % 101) AS DOUBLE) / 100"


@query(f"""
WITH f AS (SELECT row_id, {_STAND} AS p, CAST({_matches('narrative')} AS DOUBLE) AS f21, {_matches('override')} + {_matches('act_as')} + {_matches('harmful_role')} + {_matches('filter_bypass')} AS hits FROM combined_dataset WHERE text IS NOT NULL),
b AS (SELECT *, CASE WHEN f21 >= 2 AND p < 0.49::DOUBLE THEN least(p + least(f21 * 0.17::DOUBLE, 0.40::DOUBLE), 1.0) WHEN hits >= 1 AND p < 0.90::DOUBLE THEN 0.90::DOUBLE ELSE p END AS boosted FROM f)
SELECT row_id, round(boosted, 4) AS confidence, CASE WHEN boosted >= 0.60::DOUBLE THEN 'BLOCK' ELSE 'ALLOW' END AS verdict FROM b
""")
def rule_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).where("text is not null").selectExpr("row_id", "text", f"{_STAND} AS p").withColumn("low", fx.lowered(F.col("text")))
    k = fx.keyword_features(F.col("text"), F.col("low"))
    after = rows.select("row_id", rules.boosted(F.col("p"), k["f21"], k["hard_hits"]).alias("b"))
    return after.select("row_id", F.round("b", 4).alias("confidence"), rules.verdict(F.col("b")).alias("verdict"))


@query()
def family_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.with_features(_corpus(spark, sf_dir))
    raw = rules.raw_family_scores()
    return rows.select("row_id", *[v.alias(k) for k, v in rules.softmax(raw).items()], rules.family(raw, fx.spans(F.col("decoded_text"), counted=True)["label"]).alias("family"))


@query()
def score_end_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).selectExpr("row_id", "text", f"{_STAND} AS p")
    out = rules.scored(fx.with_features(rows), "p")
    return out.select("row_id", "verdict", "label", "confidence", "attack_family", "family_scores", F.size("spans").alias("n_spans"), "rule_boost_applied")
