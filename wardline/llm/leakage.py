"""Corpus documents that hold passages of held-out items.

Method: a BM25 inverted index of the items, in blocks with their largest impact (block-max WAND). Every passage of every
document is a query; all items above the threshold come back, and an alignment of the item's words with the document's
decides. Impacts are divided by the item's own threshold, so that 1 is the threshold of all: the least BM25 score that
RUN words in a row of the item have when CHANGED of them, the heaviest, are lost.

The items are indexed in shards of bounded size by id, which the workers read from the shared folder; a task goes through
its documents in blocks, each block with one shard after another. Documents never move.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.lookalikes import TOKEN, doubtful, fold
from wardline.llm.support import cut, digest, keyed_join, new_path

RUN = 12
CHANGED = 1
#: The threshold of 1 less what rounding takes off sums that meet it exactly.
ENOUGH = 1 - 1e-9
#: Words of a passage and from one passage's start to the next: any RUN words in a row are within one passage.
PASSAGE, STRIDE = 2 * RUN, RUN
K1, B = 1.2, 0.75
BLOCK = 16
#: Items in one index; more are indexed in further shards.
SHARD_ITEMS = 5_000
#: Words of documents that a task holds at a time where there are several shards.
BLOCK_WORDS = 4_000_000
#: Words between two matching word pairs that still count as one run, and the share of a run's words that must match.
GAP = 2
MATCHED = 0.88

_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_SENTENCE = re.compile(r"(?<=[.?!。？！])\s+")


def words_of(text: str) -> list[str]:
    """Lower-case words of a text without regard to width, look-alikes, punctuation and layout."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    text = fold(text)
    if maybe := doubtful(text):
        text = TOKEN.sub(lambda m: maybe.get(m[0], m[0]), text)
    return _WORD.findall(text.lower())


class Index:
    """Postings of (item, impact) by word, in blocks of BLOCK, with the largest impact of a list and of each block."""

    def __init__(self, items: list[list[str]]):
        self.items = items
        n, average = len(items), sum(map(len, items)) / max(1, len(items)) or 1.0
        df = Counter(w for ws in items for w in set(ws))
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items()}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, ws in enumerate(items):
            norm = K1 * (1 - B + B * len(ws) / average)
            impact = {w: idf[w] * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(ws).items()}
            runs = [sorted({w: impact[w] for w in ws[s : s + RUN]}.values()) for s in range(max(0, len(ws) - RUN + 1))]
            least = min((sum(r[: max(1, len(r) - CHANGED)]) for r in runs), default=0.0)
            if least > 0:
                for w, x in impact.items():
                    postings[w].append((i, x / least))
        self.ids = {w: [i for i, _ in p] for w, p in postings.items()}
        self.impacts = {w: [x for _, x in p] for w, p in postings.items()}
        self.most = {w: max(x) for w, x in self.impacts.items()}
        self.blocks = {w: [max(x[b : b + BLOCK]) for b in range(0, len(x), BLOCK)] for w, x in self.impacts.items()}
        self.lasts = {w: [p[min(b + BLOCK, len(p)) - 1] for b in range(0, len(p), BLOCK)] for w, p in self.ids.items()}
        self.places = [defaultdict(list) for _ in items]
        for i, ws in enumerate(items):
            for j, pair in enumerate(zip(ws, ws[1:])):
                self.places[i][pair].append(j)

    def search(self, query: set[str]) -> list[int]:
        """All items with a score of at least 1, by block-max WAND."""
        lists = [[self.ids[w][0], 0, w] for w in query if w in self.ids]
        out: list[int] = []
        while lists:
            lists.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(lists):
                bound += self.most[c[2]]
                if bound >= ENOUGH:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            bound, block_end = 0.0, 1 << 62
            for c in lists[: pivot + 1]:
                b = bisect_left(self.lasts[c[2]], item)
                if b < len(self.lasts[c[2]]):
                    bound += self.blocks[c[2]][b]
                    block_end = min(block_end, self.lasts[c[2]][b])
            if bound >= ENOUGH:
                target = item + 1 if lists[0][0] == item else item
                if lists[0][0] == item and sum(self.impacts[c[2]][c[1]] for c in lists[: pivot + 1]) >= ENOUGH:
                    out.append(item)
            else:
                after = lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 62
                target = max(item + 1, min(block_end + 1, after)) if block_end < 1 << 62 else item + 1
            still = lists[pivot + 1 :]
            for c in lists[: pivot + 1]:
                if c[0] < target:
                    c[1] = bisect_left(self.ids[c[2]], target, c[1])
                    if c[1] == len(self.ids[c[2]]):
                        continue
                    c[0] = self.ids[c[2]][c[1]]
                still.append(c)
            lists = still
        return out

    def longest_run(self, item: int, words: list[str], share: float = MATCHED) -> int:
        """Words of the item in the longest run that the words repeat, changed words within it included."""
        places = self.places[item]
        pairs = [(i, j) for i, p in enumerate(zip(words, words[1:])) for j in places.get(p, ())]
        chains: list[tuple[int, int, int, int]] = []  # end in the words, end in the item, chain before, words matched
        for i, j in pairs:
            own = (-1, 2)
            for k in range(len(chains) - 1, -1, -1):
                a, b, _, matched = chains[k]
                if i - a > GAP + 2:
                    break
                if 0 < i - a and 0 < j - b <= GAP + 2 and matched + min(2, i - a, j - b) > own[1]:
                    own = (k, matched + min(2, i - a, j - b))
            chains.append((i, j, *own))
        best, done = 0, set()
        for k in sorted(range(len(chains)), key=lambda k: -chains[k][3]):
            if k in done or chains[k][3] <= best * share:
                continue
            hit: set[int] = set()
            while k >= 0:
                done.add(k)
                hit |= {chains[k][1], chains[k][1] + 1}
                k = chains[k][2]
            at = sorted(hit)
            for x in range(len(at)):
                for y in range(len(at) - 1, x, -1):
                    span = at[y] - at[x] + 1
                    if span <= best:
                        break
                    if y - x + 1 >= share * span:
                        best = span
                        break
        return best


def _worth_asking(most: np.ndarray) -> list[int]:
    """Starts of the passages that can hold a run: bounds on all items at once, before any list is opened.

    most holds each word's largest impact, 0 for words of no item. The impacts of a passage must add up to the
    threshold, and somewhere in it RUN words, one added word among them, must but for CHANGED be words of some item.
    """
    n = len(most)
    starts = np.arange(0, max(1, n - STRIDE), STRIDE)
    ends = np.minimum(starts + PASSAGE, n)
    summed = np.concatenate(([0.0], np.cumsum(most)))
    known = np.concatenate(([0], np.cumsum(most > 0)))
    at = np.arange(n)
    dense = np.concatenate(([0], np.cumsum(known[np.minimum(at + RUN + 1, n)] - known[at] >= RUN - CHANGED)))
    return starts[(summed[ends] - summed[starts] >= ENOUGH) & (dense[ends] > dense[starts])].tolist()


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each item's words, those of its first sentence and those after it (null where it is all)."""
    for b in batches:
        parts = [_SENTENCE.split(t.strip(), maxsplit=1) for t in b["text"]]
        yield pd.DataFrame({"item_id": b["item_id"], "whole": [" ".join(words_of(t)) for t in b["text"]], "head": [" ".join(words_of(p[0])) for p in parts], "rest": [" ".join(words_of(p[1])) if len(p) > 1 else None for p in parts]})


def _written_items(items: DataFrame) -> tuple[str, list[int]]:
    """A folder with the items' words in shards by id, without the first sentence where several items begin with it, and
    the shards' numbers. Which sentences are shared is found over all items."""
    spark = items.sparkSession
    parsed = cut(items.mapInPandas(_parsed, "item_id long, whole string, head string, rest string").withColumns(dict(zip(("h1", "h2"), digest(F.col("head"))))), "p9-parsed")
    n = parsed.count()
    heads = cut(parsed.groupBy("h1", "h2").agg(F.count("*").alias("uses")), "p9-heads")
    known = keyed_join(parsed, heads, ["h1", "h2"], "uses", n)
    words = F.when((F.col("uses") > 1) & F.col("rest").isNotNull(), F.col("rest")).otherwise(F.col("whole"))
    shards = -(-n // SHARD_ITEMS) or 1
    path = new_path(spark, "p9-items")
    known.select("item_id", words.alias("words"), F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int").alias("shard")).write.partitionBy("shard").parquet(path)
    filled = sorted(r["shard"] for r in spark.read.parquet(path).select("shard").distinct().collect()) if n else []  # one row per SHARD_ITEMS items
    return path, filled


_kept: dict[tuple[str, int], tuple[Index, list]] = {}


def _index(path: str, shard: int) -> tuple[Index, list]:
    """A shard's index and its items' ids, built from the shared folder; a worker keeps the last one."""
    if (path, shard) not in _kept:
        import pyarrow.dataset as ds
        from pyarrow import fs

        _kept.clear()
        system, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        data = ds.dataset(f"{root}/shard={shard}", filesystem=system, format="parquet").to_table(columns=["item_id", "words"])
        rows = sorted(zip(data.column("item_id").to_pylist(), data.column("words").to_pylist()))
        _kept[path, shard] = Index([w.split(" ") if w else [] for _, w in rows]), [i for i, _ in rows]
    return _kept[path, shard]


def _leaks(path: str, shards: list[int]):
    def block(docs: list[tuple[object, list[str]]]) -> Iterator[pd.DataFrame]:
        for shard in sorted(shards, key=lambda s: (path, s) not in _kept):
            index, item_ids = _index(path, shard)
            most = index.most.get
            found: list[tuple[object, object, int]] = []
            for doc, words in docs:
                best: dict[int, int] = {}
                for s in _worth_asking(np.array([most(w, 0.0) for w in words])):
                    for item in index.search(set(words[s : s + PASSAGE])):
                        if best.get(item, 0) < RUN:
                            best[item] = max(best.get(item, 0), index.longest_run(item, words[max(0, s - RUN) : s + PASSAGE + RUN]))
                found += [(doc, item_ids[i], n) for i, n in best.items() if n >= RUN]
            if found:
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "run_words"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs: list[tuple[object, list[str]]] = []
        held = 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                words = words_of(text)
                if len(words) >= RUN - CHANGED:
                    docs.append((doc, words))
                    held += len(words)
            if held >= (BLOCK_WORDS if len(shards) > 1 else 1):
                yield from block(docs)
                docs, held = [], 0
        if docs:
            yield from block(docs)

    return scan


def leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, run_words: every item of which a document repeats RUN words in a row, and how many it repeats at least.

    Letter case, punctuation, spacing, layout, width and look-alike letters don't matter, nor a changed, dropped or added
    word here and there. The first sentence of an item counts only if no other item begins with it. Null and blank
    texts leak nothing; items of fewer than RUN words cannot leak. Repeated documents come out each, repeated items too.
    """
    docs = documents.select(F.col(f"`{doc_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null and text rlike '[\\\\p{L}\\\\p{N}]'")
    held = items.select(F.col(f"`{item_col}`").cast("bigint").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    path, shards = _written_items(held)
    return docs.mapInPandas(_leaks(path, shards), "doc_id long, item_id long, run_words int")
