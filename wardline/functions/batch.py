"""All features of a batch of texts at once, for with_features.

The texts of a batch become one array of code points, on which counts by class of character are array sums. Phrases are
searched for by Arrow's regular expressions, which read a text once whatever the number of phrases, in a copy of one byte a
character: ASCII as it is, other characters as what the patterns can tell of them (word character, white space or neither;
the letters that Java folds to ASCII ones as those). Values are those of the expressions in features and normalize.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from wardline.functions import lexicon as lx

#: Characters that are looked at together, at least.
BLOCK_CHARS = 1 << 20
LETTER, UPPER, NUMBER, SPACE, STOP, LEET, LOOKALIKE, INVISIBLE = (1 << i for i in range(8))
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Circled and squared letters are alphabetic without being letters.
ALPHABETIC = [*range(0x24B6, 0x24EA), *range(0x1F130, 0x1F14A), *range(0x1F150, 0x1F16A), *range(0x1F170, 0x1F18A)]
FOLDED = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k"}

_run = re.compile(lx.BASE64_RUN)
_patterns = {g: f"(?i)(?:{lx.alternation(g)})".replace(r"[s\-]", "[s-]").replace(r"\s", r"[\t-\r ]") for g in lx.PHRASES}


@lru_cache(None)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point its classes, the byte that stands for it, and what look-alikes and leet letters are folded to."""
    of = {c: LETTER for c in ("Ll", "Lt", "Lm", "Lo")} | {"Lu": LETTER | UPPER} | {c: NUMBER for c in ("Nd", "Nl", "No")}
    words = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Mc", "Me", "Pc"}
    categories = list(map(unicodedata.category, map(chr, range(0x110000))))
    kinds = np.array([of.get(c, 0) for c in categories], dtype=np.uint8)
    for bit, codes in ((SPACE, WHITE), (STOP, map(ord, ".!?")), (LEET, map(ord, lx.LEET[0])), (LOOKALIKE, map(ord, lx.LOOKALIKES[0])), (INVISIBLE, map(ord, lx.INVISIBLE))):
        kinds[list(codes)] |= bit
    signs = np.where([c in words for c in categories], ord("_"), 1).astype(np.uint8)
    signs[ALPHABETIC + [0x200C, 0x200D]] = ord("_")
    signs[WHITE] = 32
    signs[:128] = np.arange(128)
    signs[0] = 1
    for code, letter in FOLDED.items():
        signs[code] = ord(letter)
    folds, leet = np.arange(0x110000, dtype=np.uint32), dict(zip(*map(reversed, lx.LEET)))
    for a, b in zip(reversed(lx.LOOKALIKES[0] + lx.MARKS[0]), reversed(lx.LOOKALIKES[1] + lx.MARKS[1])):  # of several the first counts
        folds[ord(a)] = ord(leet.get(b, b))
    for a, b in leet.items():
        folds[ord(a)] = ord(b)
    return kinds, signs, folds


@lru_cache(1 << 16)
def _said(run: str) -> str:
    """What a base64 run says, where that is mostly printable; else the run."""
    bare = run.rstrip("=")
    if len(bare) % 4 == 1:
        return run
    try:
        said = base64.b64decode(bare + "=" * (-len(bare) % 4)).decode()
    except UnicodeDecodeError:
        return run
    hidden = sum(unicodedata.category(c)[0] in "CZ" and c not in " \t\r\n" for c in said)
    return said if hidden <= 0.1 * len(said) + 1e-9 else run


def _spelt(text: str) -> str:
    """The text with base64 read, in compatible composition."""
    text = _run.sub(lambda m: _said(m[0]), text)
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def _decoded(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """normalize.normalized of each text, and their codes and edges."""
    kinds_of, _, folds = _tables()
    codes, edges = _codes(list(map(_spelt, texts)))
    hidden = kinds_of[codes] & INVISIBLE > 0
    if hidden.any():
        edges = edges - np.searchsorted(np.flatnonzero(hidden), edges)
        codes = codes[~hidden]
    codes = folds[codes]
    whole, at = codes.tobytes().decode("utf-32-le"), edges.tolist()
    return [whole[a:b] for a, b in zip(at, at[1:])], codes, edges


def _entropies(codes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Shannon entropy of each text's characters in bits."""
    n, sizes = len(edges) - 1, np.diff(edges)
    row = np.repeat(np.arange(n), sizes)
    plain = codes < 128
    whole = np.maximum(sizes, 1)
    p = np.bincount((row * 128 + codes)[plain], minlength=n * 128).reshape(-1, 128) / whole[:, None]
    bits = (p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1)
    if len(other := np.sort((row[~plain] << 21) | codes[~plain])):
        first = np.flatnonzero(np.concatenate(([True], other[1:] != other[:-1])))
        of = other[first] >> 21
        q = np.diff(np.append(first, len(other))) / whole[of]
        bits += np.bincount(of, weights=q * np.log2(q), minlength=n)
    return 0.0 - bits


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and where each text begins and the last ends."""
    edges = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), edges


def _counted(found: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(found), edges)).astype(np.float64)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.where(whole > 0, part / np.where(whole > 0, whole, 1), 0.0)


def _phrases(copy: pa.StringArray, pattern: str) -> np.ndarray:
    """How many matches of the pattern each text has: each becomes a zero, which no copy holds."""
    out = np.zeros(len(copy))
    rows = np.flatnonzero(pc.match_substring_regex(copy, pattern).to_numpy(zero_copy_only=False))
    if len(rows):
        put = pc.replace_substring_regex(copy.take(pa.array(rows)), pattern, "\0")
        edges = np.frombuffer(put.buffers()[1], dtype=np.int32)[put.offset : put.offset + len(put) + 1]
        out[rows] = _counted(np.frombuffer(put.buffers()[2], dtype=np.uint8)[: edges[-1]] == 0, edges)
    return out


def _block(texts: list[str], normalise: bool) -> dict[str, np.ndarray | list[str]]:
    kinds_of, sign_of, _ = _tables()
    raw, edges = _codes(texts)
    kinds, size = kinds_of[raw], np.diff(edges).astype(np.float64)
    out: dict = {"decoded_text": texts}
    out["f05"] = pc.match_substring_regex(pa.array(texts, pa.large_string()), lx.BASE64_BLOB).to_numpy(zero_copy_only=False).astype(np.float64)
    out["f06"], out["f07"] = _counted(kinds & LOOKALIKE > 0, edges), _counted(kinds & INVISIBLE > 0, edges)
    out["f08"], out["f09"] = _share(_counted(kinds & LEET > 0, edges), size), _share(_counted(raw > 127, edges), size)
    out["f17"], out["f19"] = _counted(raw == ord("!"), edges), size
    if normalise:
        out["decoded_text"], raw, edges = _decoded(texts)
        kinds, size = kinds_of[raw], np.diff(edges).astype(np.float64)
    out["f11"] = _entropies(raw, edges)
    copy = pa.StringArray.from_buffers(len(texts), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(sign_of[raw]))
    for g, pattern in _patterns.items():
        out[g] = _phrases(copy, pattern)
    first = np.zeros(len(raw) + 1, dtype=bool)  # the places where a text begins
    first[edges[:-1]] = True
    first = first[:-1]
    word = (kinds & (LETTER | NUMBER) > 0) | (raw == ord("_"))
    begins = word & (first | ~np.concatenate(([False], word[:-1]))) if len(raw) else word
    words, letters = _counted(begins, edges), _counted(kinds & LETTER > 0, edges)
    out["f12"], out["f13"], out["f20"] = _share(_counted(kinds & UPPER > 0, edges), letters), _share(_counted(word, edges), words), words
    out["f16"] = _share(_counted(kinds & (LETTER | NUMBER | SPACE) == 0, edges), size)
    # Pieces begin with the first character between two stops that isn't white.
    seen = np.flatnonzero(kinds & SPACE == 0)
    stop, row = kinds[seen] & STOP > 0, np.searchsorted(edges, seen, "right") - 1
    begin = ~stop
    begin[1:] &= stop[:-1] | (row[1:] != row[:-1])
    pieces = np.bincount(row[begin], minlength=len(texts)).astype(np.float64)
    out["f14"], out["f15"] = np.maximum(pieces, 1.0), _share(words, pieces)
    at = np.flatnonzero(begins)
    lead = np.searchsorted(at, edges[:-1])
    opener = np.zeros(len(texts))
    longest = max(map(len, lx.IMPERATIVES)) + 1
    for i in np.flatnonzero(words > 0).tolist():
        a, b = int(at[lead[i]]), int(edges[i + 1])
        end = min(a + longest, b)
        run = word[a:end]
        n = len(run) if run.all() else int(run.argmin())
        start = a - int(edges[i])
        opener[i] = out["decoded_text"][i][start : start + n].lower() in lx.IMPERATIVES
    out["f18"] = opener
    return out


def _blocks(texts: list[str]):
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= BLOCK_CHARS:
            yield texts[a : i + 1]
            a, held = i + 1, 0
    if a < len(texts):
        yield texts[a:]


#: What measured gives for each text: the decoded text, the features that are no sums of others, and the phrases by group.
FIELDS = ["decoded_text", *[f"f{i:02d}" for i in (5, 6, 7, 8, 9, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20)], *lx.PHRASES]
SCHEMA = StructType([StructField(n, StringType() if n == "decoded_text" else DoubleType()) for n in FIELDS])


def measured(texts: pa.Array, normalise: bool) -> pa.StructArray:
    """Of each text, none of them null, the FIELDS."""
    blocks = [_block(b, normalise) for b in _blocks(texts.to_pylist())]
    columns = []
    for n in FIELDS:
        if n == "decoded_text":
            columns.append(pa.array([t for b in blocks for t in b[n]], pa.string()))
        else:
            columns.append(pa.array(np.concatenate([b[n] for b in blocks]) if blocks else np.zeros(0), pa.float64()))
    return pa.StructArray.from_arrays(columns, FIELDS)
