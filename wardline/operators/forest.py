"""Random forests on feature vectors, a tree to a task.

The vectors are binned and counted once: equal ones of a label are one row with a count, written to the shared folder. A
task reads them all, as one byte per feature, and grows its trees alone, level by level over all open nodes, so that no
histograms move. Every row takes part: a tree's bootstrap draws each row a Poisson number of times, equal rows together.
Trees stay in the shared folder, where scoring reads them one after another for a block of rows.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import file_system, scratch_path

#: Bins per feature, a power of two of at most 256, and rows that a task scores at a time.
BINS, BLOCK_ROWS = 64, 200_000
#: Distinct binned vectors that a worker may hold; fits on more are left to MLlib.
HELD_ROWS = 4_000_000
SHIFT, LOW = BINS.bit_length() - 1, (1 << 32) - 1
#: Draws that are summed in doubles at most, two counts of as many bits each.
HALF_BITS = 26
HALF = (1 << HALF_BITS) - 1


@dataclass
class Tree:
    """Nodes in order of level: feature and bin (vectors beyond it go right), the left child (the right is next; 0: a leaf)
    and the weighted share of label 1."""

    feature: np.ndarray
    edge: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gains: np.ndarray  # [feature], of a sum of 1 or 0

    def scores(self, x: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(x), dtype=np.int32), np.arange(len(x))
        while len(rows := rows[self.left[node[rows]] > 0]):
            at = node[rows]
            node[rows] = self.left[at] + (x[rows, self.feature[at]] > self.edge[at])
        return self.value[node]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)


def _share(ones: np.ndarray, all_: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    one = weights[1] * ones
    return (one / (one + weights[0] * (all_ - ones))).astype(np.float32)


def _purity(ones: np.ndarray, all_: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """Weight less the weight times Gini impurity, for counts of label 1 and of all."""
    a, b = weights[0] * (all_ - ones), weights[1] * ones
    return (a * a + b * b) / (a + b)


def grow(x: np.ndarray, y: np.ndarray, drawn: np.ndarray, weights: tuple[float, float], depth: int, least: int, subset: int, rng: np.random.Generator) -> Tree:
    """A tree by Gini gains over binned vectors with labels of 0 and 1, each drawn so many times. A node looks at subset
    features of its own; a split leaves least draws on either side."""
    rows = np.flatnonzero(drawn)
    width = x.shape[1]
    flat, times = x[rows].ravel(), drawn[rows].astype(np.int64)
    packed = times | ((times * y[rows]) << 32)  # draws and those of label 1 in one number, so that one sum has both
    halves = (times | ((times * y[rows]) << HALF_BITS)).astype(float)  # as packed, for sums of up to HALF draws in doubles
    every, ones = int(times.sum()), int((times * y[rows]).sum())
    at, node = np.arange(len(rows)), np.zeros(len(rows), dtype=np.int64)
    total = np.array([every | (ones << 32)])
    parts = {"feature": [np.zeros(1, np.int8)], "edge": [np.zeros(1, np.uint8)], "left": [np.zeros(1, np.int32)], "value": [_share(np.array([ones]), np.array([every]), weights) if every else np.zeros(1, np.float32)]}
    first, end, gains = 0, 1, np.zeros(width)  # first: the number of the level's first node
    open_ = np.array([0]) if 0 < ones < every and every >= 2 * least else np.array([], dtype=np.int64)  # within the level
    for _ in range(depth):
        if not len(open_):
            break
        k = len(open_)
        chosen = np.argpartition(rng.random((k, width), dtype=np.float32), subset - 1, axis=1)[:, :subset] if subset < width else np.tile(np.arange(width), (k, 1))
        before = np.concatenate(([0], np.cumsum(total)[:-1]))
        all_, one = total & LOW, total >> 32
        best, feature, edge, taken = np.full(k, -np.inf), np.zeros(k, np.int8), np.zeros(k, np.uint8), np.zeros(k, np.int64)
        tabled = every <= HALF and k << SHIFT <= len(at)  # few nodes for their rows: sums by cell, no sorting
        slot, base, drawn_at = node << SHIFT, at * width, halves[at] if tabled else None
        for f in chosen.T:
            cells = slot + flat[base + f[node]]
            if tabled:
                sums = np.bincount(cells, weights=drawn_at, minlength=k << SHIFT).astype(np.int64).reshape(k, -1).cumsum(1)
                n, p = sums & HALF, sums >> HALF_BITS
                fine = (n >= least) & (all_[:, None] - n >= least)
                with np.errstate(invalid="ignore", divide="ignore"):
                    gain = np.where(fine, _purity(p, n, weights) + _purity(one[:, None] - p, all_[:, None] - n, weights), -np.inf)
                top = gain.argmax(1)
                most = gain[np.arange(k), top]
                which = np.flatnonzero(most > best)
                top = top[which]
                best[which], feature[which], edge[which], taken[which] = most[which], f[which], top, n[which, top] | (p[which, top] << 32)
                continue
            key = (cells << 32) | at
            key.sort()
            cell = key >> 32
            sums = np.cumsum(packed[key & LOW])
            ends = np.flatnonzero(cell[1:] != cell[:-1])
            ends = ends[cell[ends] >> SHIFT == cell[ends + 1] >> SHIFT]
            of = cell[ends] >> SHIFT
            left = sums[ends] - before[of]
            fine = ((left & LOW) >= least) & (all_[of] - (left & LOW) >= least)
            ends, of, left = ends[fine], of[fine], left[fine]
            if not len(of):
                continue
            n, p = left & LOW, left >> 32
            gain = _purity(p, n, weights) + _purity(one[of] - p, all_[of] - n, weights)
            starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            most, which = np.maximum.reduceat(gain, starts), of[starts]
            top = np.flatnonzero(gain == np.repeat(most, np.diff(np.append(starts, len(of)))))[::-1]
            place = np.zeros(k, dtype=np.int64)
            place[of[top]] = top  # of equal ones the first
            which = which[most > best[which]]
            p = place[which]
            best[which], feature[which], edge[which], taken[which] = gain[p], f[which], cell[ends[p]] & (BINS - 1), left[p]
        gain = best - _purity(one, all_, weights)
        split = gain > 1e-9 * every
        if not split.any():
            break
        np.add.at(gains, feature[split], gain[split])
        parents = np.flatnonzero(split)
        children = np.full(k, -1)
        children[parents] = 2 * np.arange(len(parents))
        for name, values in (("feature", feature[parents]), ("edge", edge[parents]), ("left", (end + children[parents]).astype(np.int32))):
            parts[name][-1][open_[parents]] = values
        pair = np.stack([taken[parents], total[parents] - taken[parents]], axis=1).ravel()
        all_, one = pair & LOW, pair >> 32
        for name, kind in (("feature", np.int8), ("edge", np.uint8), ("left", np.int32)):
            parts[name].append(np.zeros(len(pair), kind))
        parts["value"].append(_share(one, all_, weights))
        first, end = end, end + len(pair)
        going = children[node] >= 0
        at, node = at[going], node[going]
        child = children[node] + (flat[at * width + feature[node]] > edge[node])
        open_ = np.flatnonzero((one > 0) & (one < all_) & (all_ >= 2 * least))
        number = np.full(len(pair), -1)
        number[open_] = np.arange(len(open_))
        node, total = number[child], pair[open_]
        at, node = at[node >= 0], node[node >= 0]
    return Tree(*[np.concatenate(parts[n]) for n in ("feature", "edge", "left", "value")], gains / max(gains.sum(), 1e-300))


_held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _vectors(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The binned vectors, their labels and counts; a worker keeps the last ones."""
    if path not in _held:
        import pyarrow.dataset as ds
        from pyarrow import fs

        _held.clear()
        system, root = file_system(path)
        names = sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
        x, y, n = [], [], []
        for batch in ds.dataset(names, filesystem=system, format="parquet").to_batches(columns=["x", "y", "n"]):
            if batch.num_rows:
                x.append(np.frombuffer(b"".join(batch.column("x").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1))
                y.append(batch.column("y").to_numpy(zero_copy_only=False).astype(np.int8))
                n.append(batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64))
        _held[path] = np.concatenate(x), np.concatenate(y), np.concatenate(n)
    return _held[path]


def _grown(path: str, weights: tuple[float, float], depth: int, least: int, subset: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["id"].tolist():
                x, y, n = _vectors(path)
                rng = np.random.default_rng([seed, t])
                tree = grow(x, y, rng.poisson(n), weights, depth, least, subset, rng)
                system, root = file_system(path)
                name = f"{root}/_tree-{t}-{uuid.uuid4().hex}"  # a repeated task writes a file of its own
                with system.open_output_stream(name) as f:
                    out = io.BytesIO()
                    np.savez(out, feature=tree.feature, edge=tree.edge, left=tree.left, value=tree.value)
                    f.write(out.getvalue())
                yield pd.DataFrame({"tree": [t], "file": [name], "gains": [tree.gains.tolist()]})

    return run


@dataclass
class Forest:
    """Trees in the shared folder."""

    path: str
    files: list[str]
    cuts: list[np.ndarray]
    importances: np.ndarray

    def probabilities(self, data: DataFrame) -> DataFrame:
        """data with p, the probability of label 1: the mean over the trees."""
        path, files, cuts = self.path, self.files, self.cuts

        def scored(blocks: list[np.ndarray]) -> Iterator[pd.Series]:
            x = np.concatenate(blocks)
            out = np.zeros(len(x))
            system, _ = file_system(path)
            for name in files if len(x) else []:
                with system.open_input_stream(name) as f, np.load(io.BytesIO(f.read())) as z:
                    out += Tree(z["feature"], z["edge"], z["left"], z["value"], np.zeros(0)).scores(x)
            out /= max(1, len(files))
            for b in np.split(out, np.cumsum([len(b) for b in blocks])[:-1]):
                yield pd.Series(b)

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            blocks: list[np.ndarray] = []
            for b in batches:
                blocks.append(binned(np.stack(b.to_numpy()), cuts) if len(b) else np.zeros((0, len(cuts)), np.uint8))
                if sum(map(len, blocks)) >= BLOCK_ROWS:
                    yield from scored(blocks)
                    blocks = []
            if blocks:
                yield from scored(blocks)

        return data.withColumn("p", score(vector_to_array("features")))


def _cuts(vectors: DataFrame, width: int, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the values between bins: all of a few, quantiles of many, over all rows."""

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = [np.zeros(0)] * width
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, width)
            for f in range(width):
                if seen[f] is not None:
                    s = np.unique(np.concatenate((seen[f], x[:, f])))
                    seen[f] = s if len(s) <= bins else None
        yield pa.RecordBatch.from_pydict({"f": pa.array(range(width), pa.int32()), "values": pa.array([None if s is None else s.tolist() for s in seen], pa.list_(pa.float64()))})

    few: list[set | None] = [set() for _ in range(width)]
    for r in vectors.select("x").mapInArrow(kinds, "f int, values array<double>").collect():  # at most so many values a feature and task
        few[r["f"]] = None if r["values"] is None or few[r["f"]] is None else few[r["f"]] | set(r["values"])
    many = [f for f in range(width) if few[f] is None or len(few[f]) > bins]
    shares = [i / bins for i in range(1, bins)]
    found = vectors.agg(*[F.percentile_approx(F.col("x")[f], shares, 20_000).alias(str(f)) for f in many]).first() if many else {}
    return [np.unique(found[str(f)]) if f in many else np.array(sorted(few[f]))[:-1] for f in range(width)]


def fit(data: DataFrame, label: str, trees: int, depth: int, least: int, seed: int) -> Forest | None:
    """A forest on data's features, label and weight, of which each label has one; None where a worker cannot hold the
    distinct vectors, or there are none."""
    spark = data.sparkSession
    classes = {r[label]: r for r in data.groupBy(label).agg(F.first("weight").alias("w"), F.first(vector_to_array("features")).alias("x")).collect()}
    if not classes:
        return None
    weights = tuple(float(classes[c]["w"]) if c in classes else 1.0 for c in (0, 1))
    width = len(next(iter(classes.values()))["x"])
    vectors = data.select(F.col(label).cast("int").alias("y"), vector_to_array("features").alias("x"))
    cuts = _cuts(vectors, width)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(binned(b.column("x").flatten().to_numpy().reshape(-1, width), cuts))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    path = scratch_path(spark, "forest")
    vectors.mapInArrow(coded, "y int, x binary").groupBy("x", "y").agg(F.count("*").alias("n")).write.parquet(path)
    if spark.read.parquet(path).count() > HELD_ROWS:
        return None
    parts = min(trees, 8 * spark.sparkContext.defaultParallelism)
    numbers = spark.range(0, trees, 1, parts)
    grown = numbers.mapInPandas(_grown(path, weights, depth, least, int(np.ceil(np.sqrt(width))), seed), "tree long, file string, gains array<double>").collect()  # one row per tree
    grown.sort(key=lambda r: r["tree"])
    gains = np.sum([r["gains"] for r in grown], axis=0)
    return Forest(path, [r["file"] for r in grown], cuts, gains / max(gains.sum(), 1e-300))
