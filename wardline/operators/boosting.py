"""Gradient boosting of trees with second-order steps, as the models need it and MLlib lacks it.

Trees grow level by level from histograms over all rows. Tasks bin the vectors, a byte per feature, and write them in blocks.
Up to HELD_ROWS rows the driver holds these bytes and sums up, in threads; of more rows it only gets sums, which tasks make
over the blocks. Scoring is distributed, in Arrow batches.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import forest
from wardline.operators.forest import binned
from wardline.session import file_system, scratch_path

#: Rows whose bins the driver holds at most, and rows of a block.
HELD_ROWS, BLOCK_ROWS = 4_000_000, 250_000
#: Rows that are summed up at a time, the driver's threads, and tasks of a step at most, each of which sends its sums.
PIECE_ROWS, THREADS, PARTS = 1 << 17, 4, 64
#: Bins per feature, the penalty on leaf values, and the least sum of second derivatives in a leaf.
BINS, L2, LEAST_WEIGHT = 256, 1.0, 1.0


@dataclass
class Trees:
    """Complete binary trees of one depth: the feature and threshold of each inner node, the value of each leaf."""

    base: float
    features: np.ndarray  # [tree, inner node]
    thresholds: np.ndarray
    values: np.ndarray  # [tree, leaf]
    gains: np.ndarray  # [feature]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = int(np.log2(self.values.shape[1]))
        for features, thresholds, values in zip(self.features, self.thresholds, self.values):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, features[node]] > thresholds[node])
            out += values[node - (len(values) - 1)]
        return out


def _gradients(margin: np.ndarray, y: np.ndarray, positive_weight: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives, as floats of half the length, as they are held for all rows; sums are in full."""
    g, h = np.empty((2, len(y)), dtype=np.float32)
    for s in range(0, len(y), PIECE_ROWS):
        piece = slice(s, s + PIECE_ROWS)
        p, weight = 1 / (1 + np.exp(-margin[piece])), np.where(y[piece] > 0, positive_weight, 1.0)
        g[piece], h[piece] = weight * (p - y[piece]), weight * p * (1 - p)
    return g, h


def _below(x: np.ndarray, node: np.ndarray, features: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The children, within the next level, that rows go to from their nodes within a level."""
    return 2 * node + (x[features[node], np.arange(x.shape[1])] > edges[node])


def _sums(x: np.ndarray, live: list[int], rows: np.ndarray | None, node: np.ndarray, g: np.ndarray, h: np.ndarray, k: int, threads: int = 1) -> np.ndarray:
    """[g or h, node, feature, bin] over the rows (None: all), which have these nodes, g and h; all features but the live
    ones have one bin."""
    out = np.zeros((2, k, len(x), BINS))
    base = node.astype(np.int64) * BINS

    def add(f: int) -> None:
        own = np.zeros((2, k * BINS))
        for s in range(0, len(g), PIECE_ROWS):
            piece = slice(s, s + PIECE_ROWS)
            at = base[piece] + (x[f, piece] if rows is None else x[f].take(rows[piece]))
            for sums, v in zip(own, (g, h)):
                sums += np.bincount(at, weights=v[piece], minlength=k * BINS)
        out[:, :, f] = own.reshape(2, k, BINS)

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(add, live))
    for f in set(range(len(x))) - set(live):
        out[:, :, f, 0] = out[:, :, live[0]].sum(2)
    return out


def _live(x: np.ndarray) -> list[int]:
    return [f for f in range(len(x)) if x[f].any()] or [0]


class Held:
    """Rows whose bins [feature, row] the driver holds, while trees grow."""

    def __init__(self, x: np.ndarray, y: np.ndarray, positive_weight: float):
        self.x, self.y, self.positive_weight, self.live = x, y, positive_weight, _live(x)
        self.margin = np.zeros(len(y))

    def _descend(self, features: np.ndarray, edges: np.ndarray) -> None:
        def step(s: int) -> None:
            piece = slice(s, s + PIECE_ROWS)
            self.node[piece] = _below(self.x[:, piece], self.node[piece].astype(np.int64), features, edges)

        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(step, range(0, len(self.y), PIECE_ROWS)))

    def sums(self, features: np.ndarray, edges: np.ndarray, level: int) -> np.ndarray:
        """_sums of all rows by the nodes of a level of the tree that has these inner nodes above it."""
        if level == 0:
            self.g, self.h = _gradients(self.margin, self.y, self.positive_weight)
            self.node = np.zeros(len(self.y), dtype=np.int32)
            self.last = _sums(self.x, self.live, None, self.node, self.g, self.h, 1, THREADS)
            return self.last
        k, above = 2**level, slice(2 ** (level - 1) - 1, 2**level - 1)
        self._descend(features[above], edges[above])
        # Of two children the one of fewer rows is summed up; the other has the rest.
        many = np.bincount(self.node, minlength=k).reshape(-1, 2)
        less = 2 * np.arange(k // 2) + (many[:, 1] < many[:, 0])
        fewer = np.zeros(k, dtype=bool)
        fewer[less] = True
        rows = np.flatnonzero(fewer[self.node])
        own = _sums(self.x, self.live, rows, self.node[rows] >> 1, self.g[rows], self.h[rows], k // 2, THREADS)
        out = np.empty((2, k, *own.shape[2:]))
        out[:, less], out[:, less ^ 1] = own, self.last - own
        self.last = out
        return out

    def end(self, features: np.ndarray, edges: np.ndarray, values: np.ndarray) -> None:
        """Adds the leaves' values of the tree, of which all levels but the last were asked for."""
        self._descend(features[len(features) // 2 :], edges[len(edges) // 2 :])
        self.margin += values[self.node]


def _read(name: str) -> dict[str, np.ndarray]:
    system, path = file_system(name)
    with system.open_input_stream(path) as f, np.load(io.BytesIO(f.read())) as z:
        return dict(z)


def _write(name: str, **arrays: np.ndarray) -> str:
    out = io.BytesIO()
    np.savez(out, **arrays)
    system, path = file_system(name)
    system.create_dir(path.rpartition("/")[0])
    with system.open_output_stream(path) as f:
        f.write(out.getvalue())
    return name


class Dealt:
    """Rows that tasks hold, a block at a time, while trees grow. Their margins are kept beside the blocks."""

    def __init__(self, spark: SparkSession, folder: str, blocks: list[str], positive_weight: float):
        self.spark, self.folder, self.positive_weight = spark, folder, positive_weight
        n = max(1, min(PARTS, len(blocks), spark.sparkContext.defaultParallelism))
        self.parts = [[(b, None) for b in blocks[i::n]] for i in range(n)]
        self.tree = None  # the last tree, until the margins have it

    def sums(self, features: np.ndarray, edges: np.ndarray, level: int) -> np.ndarray:
        parts, folder, positive_weight, tree = self.parts, self.folder, self.positive_weight, self.tree if level == 0 else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (i for batch in batches for i in batch.column(0).to_pylist()):
                names, out = [], 0.0
                for block, kept in parts[part]:
                    held = _read(block)
                    x, y = held["x"], held["y"]
                    margin = _read(kept)["margin"] if kept else np.zeros(len(y))
                    if tree:
                        node = np.zeros(len(y), dtype=np.int64)
                        for at in range((len(tree[2])).bit_length() - 1):
                            above = slice(2**at - 1, 2 ** (at + 1) - 1)
                            node = _below(x, node, tree[0][above], tree[1][above])
                        margin += tree[2][node]
                        kept = _write(f"{folder}/margin-{uuid.uuid4().hex}", margin=margin)  # a repeated task writes a file of its own
                    names.append(kept)
                    node = np.zeros(len(y), dtype=np.int64)
                    for at in range(level):
                        above = slice(2**at - 1, 2 ** (at + 1) - 1)
                        node = _below(x, node, features[above], edges[above])
                    out = out + _sums(x, _live(x), None, node, *_gradients(margin, y, positive_weight), 2**level)
                yield pa.RecordBatch.from_pydict({"part": [part], "margins": pa.array([names], pa.list_(pa.string())), "sums": pa.array([out.tobytes()], pa.binary())})

        found = self.spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, "part long, margins array<string>, sums binary").collect()  # at most PARTS rows
        found.sort(key=lambda r: r["part"])
        if tree:
            old = [kept for part in parts for _, kept in part if kept]
            self.parts = [[(b, kept) for (b, _), kept in zip(part, r["margins"])] for part, r in zip(parts, found)]
            for name in old:
                system, path = file_system(name)
                system.delete_file(path)
        return sum(np.frombuffer(r["sums"]) for r in found).reshape(2, 2**level, -1, BINS)

    def end(self, features: np.ndarray, edges: np.ndarray, values: np.ndarray) -> None:
        self.tree = features.copy(), edges.copy(), values


def grow(rows: Held | Dealt, cuts: list[np.ndarray], rounds: int, depth: int, rate: float) -> Trees:
    """Trees under the logistic loss, for rows that are binned by these cuts. A node that gains nothing sends all left."""
    inner, leaves, width = 2**depth - 1, 2**depth, len(cuts)
    features, thresholds = np.zeros((rounds, inner), dtype=np.int64), np.full((rounds, inner), np.inf)
    values, gains = np.zeros((rounds, leaves)), np.zeros(width)
    score = lambda g, h: g * g / (h + L2)
    for t in range(rounds):
        edges = np.full(inner, BINS)
        for level in range(depth):
            k, first = 2**level, 2**level - 1
            left_g, left_h = rows.sums(features[t], edges, level).cumsum(3)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            right_g, right_h = all_g - left_g, all_h - left_h
            gain = score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h)
            gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = -np.inf
            gain = gain.reshape(k, -1)
            most = gain.max(1)
            real = most > 1e-9
            best = (gain >= (most - 1e-9 * np.abs(np.where(real, most, 0)))[:, None]).argmax(1)  # the first of equal ones, however they were summed up
            feature, edge = np.where(real, best // BINS, 0), np.where(real, best % BINS, BINS)
            features[t, first : first + k], edges[first : first + k] = feature, edge
            thresholds[t, first : first + k] = [cuts[f][e] if e < len(cuts[f]) else np.inf for f, e in zip(feature, edge)]
            np.add.at(gains, feature[real], most[real])
            if level == depth - 1:
                at = np.arange(k), feature, np.minimum(edge, BINS - 1)
                sum_g, sum_h = (np.stack([left[at], all_[:, 0, 0] - left[at]], axis=1).ravel() for left, all_ in ((left_g, all_g), (left_h, all_h)))
                values[t] = -rate * sum_g / (sum_h + L2)
        rows.end(features[t], edges, values[t])
    return Trees(0.0, features, thresholds, values, gains / max(gains.sum(), 1e-300))


def fit(x: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float, positive_weight: float = 1.0) -> Trees:
    """Trees for labels of 0 and 1, positives weighted, of rows that are held as they are."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    return grow(Held(np.ascontiguousarray(binned(x, cuts).T), y, positive_weight), cuts, rounds, depth, rate)


@dataclass
class BoostedModel:
    trees: Trees

    def probabilities(self, data: DataFrame) -> DataFrame:
        """data with p, the probability of label 1."""
        sent = data.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                yield pd.Series(1 / (1 + np.exp(-sent.value.margins(np.stack(b.to_numpy())))) if len(b) else [], dtype="float64")

        return data.withColumn("p", score(vector_to_array("features")))


def _blocks(folder: str, cuts: list[np.ndarray]):
    """Writes rows in blocks, and gives the files' names, in order, with their numbers of rows and of positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, n, count = [], [], 0, 0
        task = TaskContext.get().partitionId()

        def block() -> pa.RecordBatch:
            own = np.concatenate(y)
            name = f"{folder}/block-{task:08}-{count:08}-{uuid.uuid4().hex}"  # a repeated task writes a file of its own
            _write(name, x=np.ascontiguousarray(np.concatenate(x).T), y=own)
            return pa.RecordBatch.from_pydict({"file": [name], "rows": [n], "positives": [int((own > 0).sum())]})

        for b in batches:
            if b.num_rows:
                x.append(binned(b.column("x").flatten().to_numpy().reshape(-1, len(cuts)), cuts))
                y.append(b.column("y").to_numpy().astype(np.int8))
                n += b.num_rows
            if n >= BLOCK_ROWS:
                yield block()
                x, y, n, count = [], [], 0, count + 1
        if n:
            yield block()

    return run


def boosted(data: DataFrame, label: str = "label", rounds: int = 300, depth: int = 6, rate: float = 0.1) -> BoostedModel:
    """A model fitted on all of data's features and labels of 0 and 1; positives weigh as much as there are negatives to one of them."""
    spark = data.sparkSession
    vectors = data.select(vector_to_array("features").alias("x"), F.col(label).cast("int").alias("y"))
    if not (one := vectors.first()):
        return BoostedModel(grow(Held(np.zeros((1, 0), dtype=np.uint8), np.zeros(0), 1.0), [np.zeros(0)], rounds, depth, rate))
    cuts = forest._cuts(vectors, len(one["x"]), BINS)
    folder = scratch_path(spark, "boosting")
    found = sorted(map(tuple, vectors.mapInArrow(_blocks(folder, cuts), "file string, rows long, positives long").collect()))  # one row per block
    total, positives = sum(n for _, n, _ in found), sum(p for _, _, p in found)
    weight = (total - positives) / max(positives, 1)
    if total > HELD_ROWS:
        return BoostedModel(grow(Dealt(spark, folder, [f for f, _, _ in found], weight), cuts, rounds, depth, rate))
    x, y = np.empty((len(cuts), total), dtype=np.uint8), np.empty(total, dtype=np.int8)
    at = 0
    for name, n, _ in found:
        block = _read(name)
        x[:, at : at + n], y[at : at + n] = block["x"], block["y"]
        at += n
    return BoostedModel(grow(Held(x, y, weight), cuts, rounds, depth, rate))
