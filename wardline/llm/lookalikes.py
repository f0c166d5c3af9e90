"""One consistent form for text that looks the same but consists of different characters.

Width, spacing, joining and invisible characters are folded first (fold). Then, by the method of script-aware repair,
letters of another script that look alike are replaced within a token when the token mixes scripts and the result is a
word of the corpus. A token's script is that of its letters that have no twin elsewhere. Beyond the method, a token all
of whose letters have twins counts as mixed when it stands in a text of another script (a lone Cyrillic "a" in an
English text), and a word on which two spellings agree counts as a word of the corpus; otherwise texts that look the
same would stay unequal.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.support import copies_join, cut, digest, hot_groups, keyed_join

# Letters of other scripts and the Latin letters that look the same, in the same order.
CYRILLIC_TWINS = ("асеорхуүіјѕԁһԛԝѵӏАВСЕНІЈКМОРЅТХУҮԌԜҺ", "aceopxyyijsdhqwvlABCEHIJKMOPSTXYYGWh")
GREEK_TWINS = ("οναρϲϳΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿ", "ovapcjABEZHIKMNOPTYXCJ")
ARMENIAN_TWINS = ("օոսհՕՍ", "onuhOU")
CHEROKEE_TWINS = ("ᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᎳᏃ", "ABCEHJKLMPRSTWZ")
PHONETIC_TWINS = ("ɡɑ", "ga")
# Format characters that are seen, and characters without a look that aren't format characters.
SEEN_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
UNSEEN = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x180F), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}

TO_LATIN = {"Cyrillic": dict(zip(*CYRILLIC_TWINS)), "Greek": dict(zip(*GREEK_TWINS)), "Armenian": dict(zip(*ARMENIAN_TWINS)), "Cherokee": dict(zip(*CHEROKEE_TWINS)), "Phonetic": dict(zip(*PHONETIC_TWINS))}
FROM_LATIN = {script: {b: a for a, b in reversed(table.items())} for script, table in TO_LATIN.items()}
TWINS = {"Latin": {b for t in TO_LATIN.values() for b in t.values()}, **{s: set(t) for s, t in TO_LATIN.items()}}
OTHER_SCRIPT = re.compile("[ɡɑͰ-ԯ԰-֏Ꭰ-\u13FFἀ-῿]")
TOKEN = re.compile(r"[^\W\d_]+")
BLANKS = re.compile("[ \t]+")
JVM_TOKEN_GAP = r"[^\p{L}\p{M}]+"


@lru_cache(1)
def _fold_table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        if 0x3400 <= cp < 0xA000 or 0xAC00 <= cp < 0xF900 or 0x20000 <= cp < 0xE0000:
            continue
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if (cat == "Cf" and cp not in SEEN_FORMAT) or cp in UNSEEN:
            out[cp] = None
        elif cat == "Zs":
            out[cp] = " "
        else:
            kind = unicodedata.decomposition(ch).partition(" ")[0]
            joined = kind in ("<compat>", "<initial>", "<medial>", "<final>", "<isolated>") and cat[0] == "L"
            styled = kind == "<font>" and cat[0] in "LN"  # letters and digits of mathematical alphabets
            if kind in ("<wide>", "<narrow>") or joined or styled:
                out[cp] = unicodedata.normalize("NFKC", ch)
    return out


def fold(text: str) -> str:
    """Full-width, joined and composed forms to one, spaces of any width to one blank, unseen characters away."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_fold_table()))
    return BLANKS.sub(" ", text).strip(" ")


def script(ch: str) -> str | None:
    cp = ord(ch)
    if cp < 0x250 or 0x1E00 <= cp < 0x1F00:
        return "Latin" if ch.isalpha() else None
    if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
        return "Greek"
    if 0x400 <= cp < 0x530:
        return "Cyrillic"
    if 0x530 <= cp < 0x590:
        return "Armenian"
    return "Cherokee" if 0x13A0 <= cp < 0x1400 else "Phonetic" if ch in PHONETIC_TWINS[0] else None


def _own(counts: dict[str, int]) -> str | None:
    return max(sorted(counts), key=counts.get) if counts else None


def _scripts(letters: str) -> tuple[set[str], dict[str, int]]:
    """The scripts that occur, and how many letters without twin each has."""
    seen, firm = set(), {}
    for ch in letters:
        if s := script(ch):
            seen.add(s)
            if ch not in TWINS[s]:
                firm[s] = firm.get(s, 0) + 1
    return seen, firm


def into(token: str, target: str) -> str:
    """The token with every twin in the target script."""
    latin = "".join(TO_LATIN.get(script(ch) or "", {}).get(ch, ch) if script(ch) != target else ch for ch in token)
    return latin if target == "Latin" else "".join(FROM_LATIN[target].get(ch, ch) for ch in latin)


def doubtful(text: str) -> dict[str, str]:
    """Tokens of a folded text that may be misspelt with twins, and what they would be."""
    if not OTHER_SCRIPT.search(text):
        return {}
    tokens = set(TOKEN.findall(text))
    parts = {t: _scripts(t) for t in tokens}
    whole: dict[str, int] = {}
    for _, firm in parts.values():
        for s, n in firm.items():
            whole[s] = whole.get(s, 0) + n
    main = _own(whole) or "Latin"
    out = {}
    for t, (seen, firm) in parts.items():
        target = _own(firm) or main
        if seen and (len(seen) > 1 or (not firm and seen != {target})):
            other = into(t, target)
            if other != t and len(_scripts(other)[0]) == 1:
                out[t] = other
    return out


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = [fold(t) for t in b["text"]]
        maybe = [doubtful(t) for t in texts]
        yield pd.DataFrame({"tab": b["tab"], "id": b["id"], "r1": b["r1"], "r2": b["r2"], "form": texts, "tokens": [list(m) for m in maybe], "words": [list(m.values()) for m in maybe]})


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        forms = [TOKEN.sub(lambda m: table.get(m[0], m[0]), t) for t, pairs in zip(b["form"], b["fixes"]) for table in [{p["token"]: p["word"] for p in pairs}]]
        yield pd.DataFrame({"tab": b["tab"], "id": b["id"], "r1": b["r1"], "r2": b["r2"], "form": forms})


def consistent(texts: DataFrame, agreeing_spellings: bool = True) -> DataFrame:
    """tab, id, r1, r2, form of a table (tab STRING, id STRING, text STRING), one row per row.

    form is the text in one consistent form, r1 and r2 a digest of the text as it was. The corpus whose words decide is
    the table itself; letter case doesn't matter there. With agreeing_spellings a word on which two misspellings agree is
    a word too, else it has to stand somewhere as such. A null text has a null form; a text without visible character has an empty one. Line breaks stay.
    Repeated ids are kept apart. Texts are folded whole, however long.
    """
    raw = texts.select("tab", F.col("id").cast("string").alias("id"), "text", *[c.alias(n) for c, n in zip(digest(F.col("text")), ("r1", "r2"))])
    plain_form = F.regexp_replace(F.regexp_replace("text", "[ \t]+", " "), "^ | $", "")
    ascii_ = ~F.col("text").rlike(r"[^\x00-\x7F]")
    plain = raw.where(F.col("text").isNull() | ascii_).select("tab", "id", "r1", "r2", plain_form.alias("form"))
    schema = "tab string, id string, r1 long, r2 long, form string"
    other = cut(raw.where(~ascii_).mapInPandas(_folded, schema + ", tokens array<string>, words array<string>").withColumn("rid", F.monotonically_increasing_id()), "p5-folded")

    doubts = other.where(F.size("tokens") > 0).select("rid", F.explode(F.arrays_zip("tokens", "words")).alias("z")).select("rid", F.col("z.tokens").alias("token"), F.col("z.words").alias("word"))
    uses = cut(doubts.groupBy("token", "word").agg(F.count("*").alias("uses")).withColumn("plain", F.lower("word")), "p5-doubts")
    # Of the corpus only the words that some misspelling may stand for are looked at.
    asked = cut(uses.groupBy("plain").agg(F.count_distinct(F.lower("token")).alias("spellings")), "p5-asked")
    tokens_of = lambda df: df.select(F.explode(F.array_distinct(F.split(F.lower("form"), JVM_TOKEN_GAP))).alias("plain"))
    doubted = F.transform("tokens", lambda t: F.lower(t))
    seen = tokens_of(plain).unionByName(tokens_of(other.where(F.size("tokens") == 0))).unionByName(other.where(F.size("tokens") > 0).select(F.explode(F.array_except(F.split(F.lower("form"), JVM_TOKEN_GAP), doubted)).alias("plain"))).distinct()
    sure = asked.where("spellings > 1").select("plain") if agreeing_spellings else asked.where("false").select("plain")
    words = sure.unionByName(asked.select("plain").join(seen, "plain", "left_semi")).distinct()
    fixes = cut(uses.join(words, "plain", "left_semi").drop("plain"), "p5-fixes")
    per_row = keyed_join(doubts.select("rid", "token"), fixes, ["token"], "uses", other.count()).groupBy("rid").agg(F.collect_list(F.struct("token", "word")).alias("fixes"))
    mended = other.where(F.size("tokens") > 0).drop("tokens", "words").join(per_row, "rid", "left").withColumn("fixes", F.coalesce("fixes", F.array().cast("array<struct<token:string,word:string>>")))
    mended = mended.select("tab", "id", "r1", "r2", "form", "fixes").mapInPandas(_repaired, schema)
    return plain.unionByName(other.where(F.size("tokens") == 0).select(*plain.columns)).unionByName(mended)


def _hashed(forms: DataFrame) -> DataFrame:
    f = [c.alias(n) for c, n in zip(digest(F.col("form")), ("f1", "f2"))]
    return forms.where(F.col("form").rlike(r"[\p{L}\p{N}]")).select("tab", "id", "r1", "r2", *f)


def same_look_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id of the texts of two tables (id, text) that look the same but consist of other characters.

    Texts without letter or digit take part in no pair. Pairs are found between distinct spellings and only then given
    their rows, so that copies of one spelling, however many, cost nothing but the pairs they are in.
    """
    both = left.select(F.lit("a").alias("tab"), F.col("id").cast("string").alias("id"), "text").unionByName(right.select(F.lit("b").alias("tab"), F.col("id").cast("string").alias("id"), "text"))
    keys = cut(_hashed(consistent(both)), "p5-keys")
    a, b = keys.where("tab = 'a'").drop("tab"), keys.where("tab = 'b'").drop("tab").distinct()
    one = a.select("f1", "f2", "r1", "r2").distinct()
    two = b.select("f1", "f2", F.col("r1").alias("s1"), F.col("r2").alias("s2")).distinct()
    spelt = cut(one.join(two, ["f1", "f2"]).where("r1 <> s1 or r2 <> s2"), "p5-spellings")
    hot = cut(hot_groups(keys, ["r1", "r2"]), "p5-hot")
    lefts = copies_join(spelt.select("r1", "r2", "s1", "s2"), a.select(F.col("id").alias("left_id"), "r1", "r2"), ["r1", "r2"], hot)
    rights = b.select(F.col("id").alias("right_id"), "r1", "r2")
    return copies_join(lefts.select("left_id", F.col("s1").alias("r1"), F.col("s2").alias("r2")), rights, ["r1", "r2"], hot).select("left_id", "right_id")
