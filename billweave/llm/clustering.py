"""Centroid clustering in whole numbers: a vantage-point tree over the centroids, built anew and broadcast in every round.

Each node of the tree has a vantage centroid and splits the other centroids of its part at the median of their distances to it: an inside and
an outside child, each with the distance at which it begins or ends. A vector opens nodes in the order of the least distance that
the triangle inequality leaves for their part, and stops when none is left within the distance of the best centroid found.
The radius is inclusive and a little wide, so that rounding never hides a centroid; what decides are exact integer distances, and
ties go to the smaller number.

Only the centroids and, per round, one sum of vectors per centroid reach the driver: both are bounded by `MOST_BYTES`.
"""

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.llm.shared import discard, write_table

LIMIT = 1 << 24  # components beyond are brought to it, so that distances are exact in 64 bits
LEAF = 2  # centroids of a part that is not split further
SLICE = 4096  # vectors searched at a time
MOST_BYTES = 64 << 20  # centroids that one tree, and so one broadcast, may hold
WIDER = 1e-9  # share by which the pruning radius exceeds the best distance; sqrt and differences err by less
NONE = np.iinfo(np.int64).max
RESULT = "vec_id {id}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


class VantageTree:
    """Exact nearest centroid of whole-number vectors."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.vantage, self.children, self.edges, self.leaves = [], [], [], []
        self._grow(np.arange(len(centroids)))

    def _grow(self, part: np.ndarray) -> int:
        node = len(self.vantage)
        # the centroid farthest from the first one of its part sees the rest at the most different distances
        at = int(np.argmax(_squares(self.centroids[part], self.centroids[part[0]])))
        self.vantage.append(int(part[at]))
        rest = np.delete(part, at)
        self.children.append(()), self.edges.append(()), self.leaves.append(())
        if len(rest) <= LEAF:
            self.leaves[node] = tuple(int(c) for c in rest)
            return node
        away = np.sqrt(_squares(self.centroids[rest], self.centroids[part[at]]).astype(np.float64))
        order = np.argsort(away, kind="stable")
        half = len(rest) // 2
        self.edges[node] = (float(away[order[half - 1]]), float(away[order[half]]))
        self.children[node] = (self._grow(rest[order[:half]]), self._grow(rest[order[half:]]))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row."""
        parts = [self._search(vectors[k : k + SLICE]) for k in range(0, len(vectors), SLICE)]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = len(vectors)
        best, number = np.full(count, NONE), np.full(count, len(self.centroids))
        least = np.full((count, len(self.vantage)), np.inf)  # of each open node, how near its part may be
        least[:, 0] = 0.0
        while True:
            node = least.argmin(axis=1)
            radius = np.sqrt(best.astype(np.float64)) * (1 + WIDER) + WIDER
            reached = least[np.arange(count), node] <= radius
            if not reached.any():
                return number, best
            for opened in np.unique(node[reached]).tolist():
                rows = np.flatnonzero(reached & (node == opened))
                bound = least[rows, opened]
                least[rows, opened] = np.inf
                squared = _squares(vectors[rows], self.centroids[self.vantage[opened]])
                _improve(best, number, rows, squared, self.vantage[opened])
                for centroid in self.leaves[opened]:
                    _improve(best, number, rows, _squares(vectors[rows], self.centroids[centroid]), centroid)
                if self.children[opened]:
                    away = np.sqrt(squared.astype(np.float64))
                    (inside, outside), (ends, begins) = self.children[opened], self.edges[opened]
                    least[rows, inside] = np.maximum(bound, away - ends)
                    least[rows, outside] = np.maximum(bound, begins - away)


def _squares(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    apart = vectors - centroid
    return np.einsum("ij,ij->i", apart, apart)


def _improve(best: np.ndarray, number: np.ndarray, rows: np.ndarray, squared: np.ndarray, centroid: int) -> None:
    better = (squared < best[rows]) | ((squared == best[rows]) & (centroid < number[rows]))
    best[rows[better]], number[rows[better]] = squared[better], centroid


def whole_units(vec: str, scale: int) -> Column:
    """floor(scale * x) of every component as double, brought to `LIMIT`."""
    near = lambda x: F.least(F.greatest(x * float(scale), F.lit(float(-LIMIT))), F.lit(float(LIMIT)))
    return F.transform(F.col(vec).cast("array<double>"), lambda x: F.floor(near(x)).cast("int"))


def finite(vec: str) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    sound = F.forall(F.col(vec).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound, F.lit(False))


def rows_of(column: pa.ListArray, dim: int) -> np.ndarray:
    """The vectors of an Arrow column as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(held, dim: int):
    """(cluster, n, sums) of a task's vectors."""

    def sums(batches):
        tree = held.value
        total, count = np.zeros((len(tree.centroids), dim), np.int64), np.zeros(len(tree.centroids), np.int64)
        for batch in batches:
            vectors = rows_of(batch.column("units"), dim)
            number, _ = tree.nearest(vectors)
            count += np.bincount(number, minlength=len(count))
            order = np.argsort(number, kind="stable")
            found, starts = np.unique(number[order], return_index=True)
            if len(found):
                total[found] += np.add.reduceat(vectors[order], starts)
        found = np.flatnonzero(count)
        listed = pa.array([total[k].tolist() for k in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(count[found], pa.int64()), listed], names=["cluster", "n", "sums"])

    return sums


def _assigned(held, dim: int):
    def assign(batches):
        for batch in batches:
            number, squared = held.value.nearest(rows_of(batch.column("units"), dim))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(squared, pa.int64())], names=["vec_id", "cluster", "distance"]
            )

    return assign


def moved(vectors: DataFrame, centroids: list[tuple[int, ...]], dim: int) -> list[tuple[int, ...]]:
    """The centroids after one round: floor(sum / count) of the vectors nearest to each; those without vectors stay."""
    held = vectors.sparkSession.sparkContext.broadcast(VantageTree(np.array(centroids, np.int64)))
    parts = vectors.select("units").mapInArrow(_sums(held, dim), "cluster int, n long, sums array<long>")
    whole = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)]
    after = list(centroids)
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *whole).collect():  # a row per centroid
        after[row["cluster"]] = tuple(int(row[f"s{j}"]) // row["n"] for j in range(dim))
    held.unpersist()
    return after


def clusters(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id: str = "vec_id", vec: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of `dim` finite components.

    Components become floor(scale * x); values beyond 2^24 are brought to it. Centroids 0, 1, ... start as the `k` vectors with the
    smallest sha256 of "seed:id" (all, if fewer; a null id counts as an empty text; ties by the components). Each round moves every
    centroid that has vectors to the floor of their mean; the vectors are assigned once more after the last round. Vectors that are
    null, of another length or hold nulls or non-finite components have no row. Repeated rows count as often as they
    are there. Other columns are left out, whatever their names. No vectors, no rows. An inertia beyond 64 bits is null.
    """
    if k * dim * 8 > MOST_BYTES:
        raise ValueError(f"{k} centroids of {dim} components exceed {MOST_BYTES} bytes, the most that is broadcast")
    spark = vectors.sparkSession
    chosen = vectors.select(F.col(id).alias("vec_id"), F.col(vec).alias("_vec")).filter(finite("_vec") & (F.size("_vec") == dim))
    units, place = write_table(chosen.select("vec_id", whole_units("_vec", scale).alias("units")))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = units.select("units", drawn.alias("drawn")).orderBy("drawn", "units").limit(k).collect()
    if not first:
        return spark.createDataFrame([], RESULT.format(id=dict(units.dtypes)["vec_id"]))
    centroids = [tuple(row["units"]) for row in first]
    centroids = reduce(lambda held, _: moved(units, held, dim), range(rounds), centroids)
    held = spark.sparkContext.broadcast(VantageTree(np.array(centroids, np.int64)))
    assigned = units.mapInArrow(_assigned(held, dim), f"vec_id {dict(units.dtypes)['vec_id']}, cluster int, distance long")
    assigned, _ = write_table(assigned)
    discard(spark, place)
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = lambda x: x if x < 1 << 63 else None
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(c, told(s), told(sum(sums.values())), digest(centroids[c])) for c, s in sums.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
