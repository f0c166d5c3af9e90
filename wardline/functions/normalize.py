"""The normalisation chain: base64 runs, NFKC, look-alikes, invisible characters, leet letters.

All steps are Column expressions; only NFKC, which Spark lacks, crosses to Python, in Arrow batches.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wardline.functions import lexicon as lx


def decode_base64(text: Column) -> Column:
    """Runs of base64 that decode to valid and mostly printable UTF-8 are replaced by what they say."""

    def read(run: Column) -> Column:
        bare = F.rtrim(run, F.lit("="))
        said = F.unbase64(F.when(F.length(bare) % 4 != 1, bare)).cast("string")
        hidden = F.regexp_count(said, F.lit(r"[\p{C}\p{Zl}\p{Zp}\p{Zs}&&[^ \t\r\n]]"))
        fine = F.is_valid_utf8(said) & (hidden <= 0.1 * F.length(said) + 1e-9)
        return F.when(fine, said).otherwise(run)

    gaps = F.split(text, lx.BASE64_RUN, -1)
    runs = F.transform(F.regexp_extract_all(text, F.lit(lx.BASE64_RUN), F.lit(0)), read)
    joined = F.array_join(F.zip_with(gaps, runs, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
    return F.when(text.rlike(lx.BASE64_RUN), joined).otherwise(text)


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility composition; ASCII texts pass untouched."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def fold_lookalikes(text: Column) -> Column:
    return F.translate(text, lx.LOOKALIKES[0] + lx.MARKS[0], lx.LOOKALIKES[1] + lx.MARKS[1])


def strip_invisible(text: Column) -> Column:
    return F.translate(text, lx.INVISIBLE, "")


def fold_leet(text: Column) -> Column:
    return F.translate(text, *lx.LEET)


def normalized(text: Column) -> Column:
    """The whole chain, in order. Null stays null."""
    return fold_leet(strip_invisible(fold_lookalikes(nfkc(decode_base64(text)))))
