"""K-Means of several restarts at once.

The vectors are written once as blocks of bytes. Each step is one pass over them for all restarts together: the first
centres are drawn by k-means++ (a row's chance is its squared distance, over all rows), then Lloyd's steps move them. Tasks
send sums only, and there is a bounded number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import scratch_path

#: Vectors of a block; steps at most, and how far a centre may move in the last one, as MLlib has it.
BLOCK = 8192
STEPS, STILL = 20, 1e-4


@dataclass
class Blocks:
    """Vectors of a column in the shared folder, in blocks that have numbers."""

    frame: DataFrame
    width: int
    column: str

    @classmethod
    def of(cls, data: DataFrame, column: str) -> Blocks:
        first = data.select(vector_to_array(column).alias("x")).first()
        if first is None:
            raise ValueError("no vectors to cluster")
        width = len(first["x"])

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, number = TaskContext.get().partitionId(), 0
            for b in batches:
                x = b.column(0).flatten().to_numpy().reshape(-1, width)
                for i in range(0, len(x), BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([(part << 32) | number]), pa.array([x[i : i + BLOCK].tobytes()], pa.binary())], names=["id", "x"])
                    number += 1

        spark = data.sparkSession
        path = scratch_path(spark, "blocks")
        data.select(vector_to_array(column).alias("x")).mapInArrow(packed, "id long, x binary").write.parquet(path)
        return cls(spark.read.parquet(path).coalesce(4 * spark.sparkContext.defaultParallelism), width, column)

    def total(self, step: Callable[[int, np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
        """The sums over all blocks of what step gives for a block's number and vectors."""
        out: list[np.ndarray] = []
        for own in self.each(lambda sums, i, x: [a + b for a, b in zip(sums, step(i, x))] if sums else step(i, x)):
            out = [a + b for a, b in zip(out, own)] if out else own
        return out

    def each(self, step: Callable[[list[np.ndarray], int, np.ndarray], list[np.ndarray]]) -> list[list[np.ndarray]]:
        """Of each task what is left of its blocks, folded by step from an empty list."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for b in batches:
                for i, x in zip(b.column("id").to_pylist(), b.column("x")):
                    held = step(held, i, np.frombuffer(x.as_buffer(), dtype=np.float64).reshape(-1, width))
            if held:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([[a.astype(np.float64).tobytes() for a in held]], pa.list_(pa.binary())), "shapes": pa.array([[list(a.shape) for a in held]], pa.list_(pa.list_(pa.int64())))})

        rows = self.frame.mapInArrow(run, "sums array<binary>, shapes array<array<long>>").collect()  # one row per task
        return [[np.frombuffer(s, dtype=np.float64).reshape(shape) for s, shape in zip(r["sums"], r["shapes"])] for r in rows]


@dataclass
class KMeansRun:
    """A clustering: its centres, the column it reads, and the sum of squared distances to the nearest centre."""

    centres: np.ndarray
    column: str
    cost: float

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 (as MLlib's models have it)
        return list(self.centres)

    def transform(self, data: DataFrame) -> DataFrame:
        """data with cluster_id, the number of the nearest centre; of equally near ones the first."""
        centres = self.centres

        @F.arrow_udf("int")
        def nearest(vectors: pa.Array) -> pa.Array:
            x = vectors.flatten().to_numpy().reshape(-1, centres.shape[1])
            far = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
            return pa.array(far.argmin(axis=1).astype(np.int32))

        return data.withColumn("cluster_id", nearest(vector_to_array(self.column)))


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances [centre, row]; those that are nothing but rounding are 0."""
    own, theirs = (x * x).sum(axis=1)[None], (centres * centres).sum(axis=1)[:, None]
    far = own + theirs - 2 * (centres @ x.T)
    far[far < 1e-12 * (own + theirs)] = 0
    return far


def _first(blocks: Blocks, k: int, restarts: int) -> list[np.ndarray]:
    """Of each restart its first centres, k where there are as many distinct vectors."""
    centres = [np.zeros((0, blocks.width)) for _ in range(restarts)]
    for turn in range(k):

        def drawn(held: list[np.ndarray], i: int, x: np.ndarray) -> list[np.ndarray]:
            best, rows = held or [np.full(restarts, np.inf), np.zeros((restarts, x.shape[1]))]
            far = _far(x, np.concatenate(centres)) if turn else None
            at = np.cumsum([0, *map(len, centres)])
            for r in range(restarts):
                chance = far[at[r] : at[r + 1]].min(axis=0) if turn else np.ones(len(x))
                with np.errstate(divide="ignore"):
                    keys = np.random.default_rng([r, turn, i]).exponential(size=len(x)) / chance  # the least is a draw by chance
                j = int(keys.argmin())
                if keys[j] < best[r]:
                    best[r], rows[r] = keys[j], x[j]
            return [best, rows]

        found = blocks.each(drawn)
        for r in range(restarts):
            best, rows = min(found, key=lambda f: f[0][r])
            if best[r] < np.inf:
                centres[r] = np.concatenate((centres[r], rows[r : r + 1]))
    return centres


def _nearest(x: np.ndarray, centres: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(restart, least distances, number of the nearest centre) of each restart."""
    far, at = _far(x, np.concatenate(centres)), np.cumsum([0, *map(len, centres)])
    for r in range(len(centres)):
        least, number = far[at[r]], np.zeros(len(x), dtype=np.intp)
        for c, own in enumerate(far[at[r] + 1 : at[r + 1]], 1):
            np.copyto(number, c, where=own < least)
            least = np.minimum(least, own)
        yield r, least, number


def _of(number: np.ndarray, k: int) -> np.ndarray:
    """1 at [cluster, row] where the row is of the cluster."""
    return (number[None] == np.arange(k)[:, None]).astype(np.float64)


def best_of(blocks: Blocks, k: int, restarts: int) -> KMeansRun:
    """Of several runs from different seeds the one with the lowest cost; of equal ones the first."""
    done, moving = {}, dict(enumerate(_first(blocks, k, restarts)))
    for _ in range(STEPS):
        runs, centres = list(moving), list(moving.values())

        def sums(_: int, x: np.ndarray) -> list[np.ndarray]:
            rows = np.column_stack((x, np.ones(len(x))))
            return [_of(number, len(centres[r])) @ rows for r, _, number in _nearest(x, centres)]

        for r, old, s in zip(runs, centres, blocks.total(sums)):
            some = s[:, -1] > 0
            new = np.where(some[:, None], s[:, :-1] / np.maximum(s[:, -1:], 1), old)
            moving[r] = new
            if (((new - old) ** 2).sum(axis=1) <= STILL**2).all():
                done[r] = moving.pop(r)
        if not moving:
            break
    done |= moving
    centres = [done[r] for r in range(restarts)]
    costs = blocks.total(lambda _, x: [np.array([least.sum() for _, least, _ in _nearest(x, centres)])])[0]
    return KMeansRun(centres[int(costs.argmin())], blocks.column, float(costs.min()))


def silhouette(blocks: Blocks, model: KMeansRun) -> float:
    """The mean silhouette by squared distances, as MLlib's evaluator has it: from each cluster's count, sum and squares."""
    centres = [model.centres]

    def parts(_: int, x: np.ndarray) -> list[np.ndarray]:
        _, _, number = next(_nearest(x, centres))
        return [_of(number, len(model.centres)) @ np.column_stack((x, (x * x).sum(axis=1), np.ones(len(x))))]

    whole = blocks.total(parts)[0]
    sums, squares, counts = whole[:, :-2], whole[:, -2], whole[:, -1]
    if (counts > 0).sum() < 2:
        raise ValueError("a silhouette takes two clusters at least")

    def scores(_: int, x: np.ndarray) -> list[np.ndarray]:
        _, _, number = next(_nearest(x, centres))
        n, rows = np.maximum(counts, 1), np.arange(len(x))
        mean = (x * x).sum(axis=1)[:, None] + squares / n - 2 * (x @ (sums / n[:, None]).T)
        mean[:, counts == 0] = np.inf
        size = counts[number]
        own = mean[rows, number] * size / np.maximum(size - 1, 1)
        mean[rows, number] = np.inf
        other = mean.min(axis=1)
        most = np.maximum(own, other)
        return [np.array([np.where((size > 1) & (most > 0), (other - own) / np.where(most > 0, most, 1), 0.0).sum()])]

    return float(blocks.total(scores)[0][0] / counts.sum())
