"""Exact top-k inner products: impact-ordered postings, read score at a time, until a proof.

Vectors are whole numbers. They are packed into blocks, each with an index of its own: per component the vectors are ordered by value and cut into
segments of equal quantised value. For a query, what a segment adds to a score above the worst value of its component is its impact:
|query component| * step * level, counted from the low end for positive and from the high end for negative query components. Segments of all
components are read by descending impact and added up.

After each portion of postings a vector's score lies between two bounds: what was added, and that plus the quantisation error plus, for
every component not yet met, the impact at which reading stands (or the highest of the component, if lower). A vector whose upper bound is below the
k-th best score known is proven out. Reading stops when all but a few are out; those are scored exactly from their values.

Query blocks meet the vector blocks of a lane and carry their k-th best score from block to block, so later blocks prove more
with less reading; a block whose highest possible score is too low is not read at all. Each lane gives its best k of a query.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from billweave.llm.clustering import finite, whole_units
from billweave.llm.shared import discard, shuffle_width, write_table

LEVELS = 32  # segments of a component in a block
BLOCK, QUERY_BLOCK = 8192, 512  # vectors and queries of a block at most
BLOCK_VALUES = 1 << 20  # components of a block at most, so that long vectors make smaller blocks
LANE_BLOCKS = 64  # vector blocks that one lane holds at most
PORTIONS = 12  # a query's postings of a block are read in so many portions
FEW = 64  # vectors that are scored at once rather than read on for
HELD = 32  # query blocks whose best scores a task holds at a time
BLOCKED = "block long, count int, dim int, ids binary, known binary, nodes binary, units binary"
FOUND = "block long, place int, query_id long, vec_id long, score long"


def packed(most: int):
    """Batches of (vec_id, node, units) as numbered blocks of at most `most` vectors, shorter vectors filled with 0."""

    def pack(batches):
        held: list[tuple] = []
        wide, number = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for vec_id, node, unit in zip(batch.column("vec_id").to_pylist(), batch.column("node").to_pylist(), batch.column("units")):
                values = unit.values.to_numpy(zero_copy_only=False).astype(np.int32)
                if held and (len(held) == most or max(wide, len(values)) * (len(held) + 1) > BLOCK_VALUES):
                    yield _block(number, held, wide)
                    held, wide, number = [], 0, number + 1
                held.append((vec_id, node, values))
                wide = max(wide, len(values))
        if held:
            yield _block(number, held, wide)

    return pack


def _block(number: int, held: list[tuple], dim: int) -> pa.RecordBatch:
    values = np.zeros((len(held), dim), np.int32)
    for row, (_, _, unit) in zip(values, held):
        row[: len(unit)] = unit
    ids = np.array([0 if i is None else i for i, _, _ in held], np.int64)
    known = np.array([i is not None for i, _, _ in held], bool)
    nodes = np.array([n for _, n, _ in held], np.int64)
    numbers = [pa.array([number], pa.int64()), pa.array([len(held)], pa.int32()), pa.array([dim], pa.int32())]
    binaries = [pa.array([x.tobytes()], pa.binary()) for x in (ids, known, nodes, values)]
    return pa.RecordBatch.from_arrays(numbers + binaries, names=["block", "count", "dim", "ids", "known", "nodes", "units"])


def _unpacked(row: dict, mark: str = "") -> tuple:
    """(ids, known, nodes, values) of a block."""
    values = np.frombuffer(row[f"{mark}units"], np.int32).reshape(row[f"{mark}count"], row[f"{mark}dim"]).astype(np.int64)
    kinds = (("ids", np.int64), ("known", bool), ("nodes", np.int64))
    return *(np.frombuffer(row[f"{mark}{name}"], kind) for name, kind in kinds), values


class ImpactIndex:
    """The impact-ordered postings of one block of vectors."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, nodes: np.ndarray, values: np.ndarray):
        self.ids, self.known, self.nodes, self.values = ids, known, nodes, values
        self.count, self.dim = values.shape
        if not self.dim:
            return
        self.low, high = values.min(axis=0), values.max(axis=0)
        self.step = (high - self.low) // LEVELS + 1
        self.high = self.low + self.step * LEVELS - 1  # the top of the highest level; high itself may be lower
        level = (values - self.low) // self.step
        self.postings = np.argsort(level, axis=0, kind="stable").T.astype(np.int32).copy()
        edges = np.arange(LEVELS + 1)
        self.starts = np.stack([np.searchsorted(np.sort(level[:, d]), edges) for d in range(self.dim)])

    def top(self, query: np.ndarray, k: int, own: int = 0, worst: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) that hold the best `k` of this block for one query, as far as they reach `worst`; the row `own` does not count."""
        query = self._fitted(query)
        alive = self._alive(query, k + 1, worst)
        alive = alive[(self.nodes[alive] != own) | (own == 0)]
        scores = self.values[alive] @ query
        order = np.lexsort((self.ids[alive], ~self.known[alive], -scores))[:k]
        if worst is not None:
            order = order[scores[order] >= worst]
        return alive[order], scores[order]

    def _fitted(self, query: np.ndarray) -> np.ndarray:
        """The query in the block's length: components that its vectors lack add nothing."""
        fitted = np.zeros(self.dim, np.int64)
        fitted[: min(self.dim, len(query))] = query[: self.dim]
        return fitted

    def _alive(self, query: np.ndarray, k: int, worst: int | None) -> np.ndarray:
        """Places of all vectors that may be among the best `k` and reach `worst`."""
        everyone = np.arange(self.count)
        used = np.flatnonzero(query)
        if self.count <= max(k, FEW) or not len(used):
            return everyone
        weight = np.abs(query[used]).astype(np.float64) * self.step[used]
        up = query[used] > 0
        base = float(np.where(up, query[used] * self.low[used], query[used] * self.high[used]).sum())
        error = float((np.abs(query[used]) * (self.step[used] - 1)).sum())
        impact = weight[:, None] * np.arange(LEVELS)
        highest = impact[:, -1]
        slack = 1.0 + 1e-9 * (abs(base) + error + float(highest.sum()))  # what sums of doubles may be off by, and more
        if worst is not None and base + error + highest.sum() + slack < worst:
            return everyone[:0]
        # segments by descending impact; level 0 adds nothing and is never read
        order = np.argsort(-impact[:, 1:], axis=None, kind="stable")
        which, level = np.unravel_index(order, (len(used), LEVELS - 1))
        level = level + 1
        place = np.where(up[which], level, LEVELS - 1 - level)
        starts, ends = self.starts[used[which], place], self.starts[used[which], place + 1]
        worth = impact[which, level]
        upto = np.cumsum(ends - starts)
        added, met = np.zeros(self.count), np.zeros(self.count, np.int64)
        done = 0
        for portion in range(1, PORTIONS + 1):
            until = int(np.searchsorted(upto, upto[-1] * portion / PORTIONS)) + 1
            until = len(order) if portion == PORTIONS else min(until, len(order))
            if until <= done:
                continue
            taken = range(done, until)
            postings = np.concatenate([self.postings[used[which[s]], starts[s] : ends[s]] for s in taken])
            gains = np.repeat(worth[done:until], ends[done:until] - starts[done:until])
            added += np.bincount(postings, gains, self.count)
            met += np.bincount(postings, minlength=self.count)
            done = until
            next_impact = float(worth[done]) if done < len(order) else 0.0
            open_sum = float(np.minimum(next_impact, highest).sum())
            upper = base + added + error + open_sum - met * next_impact + slack
            best = np.argpartition(-added, k - 1)[:k]
            known = int((self.values[best] @ query).min())
            alive = np.flatnonzero(upper >= (known if worst is None else max(known, worst)))
            if len(alive) <= FEW:
                break
        return alive


def _search(k: int):
    """Pairs of a query block and a vector block to the best `k` that a task finds for every query."""

    def told(block: int, queries: tuple, best: list) -> pa.RecordBatch:
        ids = queries[0].tolist()
        rows = [(block, place, ids[place], vec_id, score) for place, held in enumerate(best) for score, _, vec_id in held]
        columns = zip(*rows) if rows else [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["block", "place", "query_id", "vec_id", "score"])

    def search(batches):
        asked: dict[int, tuple] = {}
        number, index = None, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                if row["block"] != number:
                    number, index = row["block"], ImpactIndex(*_unpacked(row))
                block = row["q_block"]
                if block not in asked:
                    if len(asked) == HELD:
                        first = next(iter(asked))
                        yield told(first, *asked.pop(first))
                    queries = _unpacked(row, "q_")
                    asked[block] = (queries, [[] for _ in queries[0]])
                (_, _, owns, values), best = asked[block]
                for place, (own, query) in enumerate(zip(owns.tolist(), values)):
                    held = best[place]
                    places, scores = index.top(query, k, own, held[-1][0] if len(held) == k else None)
                    if len(places):
                        known, ids = index.known[places].tolist(), index.ids[places].tolist()
                        new = [(s, not there, i if there else None) for s, there, i in zip(scores.tolist(), known, ids)]
                        best[place] = sorted(held + new, key=lambda x: (-x[0], x[1], x[2] or 0))[:k]
        for block, held in asked.items():
            yield told(block, *held)

    return search


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the `k` vectors with the highest inner product for every row whose id is divisible by `every`.

    Components become floor(scale * x), brought to 2^24 where they are larger; scores are exact as long as they fit 64 bits. All rows but
    the query's own are candidates; ties go to the smaller id, rows without id last. Fewer candidates give fewer rows. Vectors that are null or hold
    nulls or non-finite components take no part. Of vectors of different lengths, the components that one lacks count as 0. Repeated rows
    are rows of their own, as queries and as candidates. Other columns are left out. An empty table gives an empty one.

    Of equal vectors only the `k` + 1 smallest ids are indexed: no other can be among the best of any query.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).cast("bigint").alias("vec_id"), F.col(vec).alias("_vec")).filter(finite("_vec"))
    rows, place = write_table(rows.select("vec_id", whole_units("_vec", scale).alias("units")))
    smallest = Window.partitionBy("units").orderBy(F.col("vec_id").asc_nulls_last())
    indexed = rows.withColumn("nth", F.row_number().over(smallest)).filter(F.col("nth") <= k + 1)
    # the first of equal rows stands for the query's own row; 0 is none
    again = F.lag("vec_id").over(smallest).eqNullSafe(F.col("vec_id"))
    node = F.xxhash64("vec_id", "units")
    indexed = indexed.select("vec_id", "units", F.when(~again, node).otherwise(F.lit(0)).alias("node"))
    blocks, block_place = write_table(indexed.mapInArrow(packed(BLOCK), BLOCKED))
    queries = rows.filter(F.col("vec_id") % every == 0).withColumn("node", node)
    asked, asked_place = write_table(queries.mapInArrow(packed(QUERY_BLOCK), BLOCKED))
    discard(spark, place)
    # a lane is a share of the vector blocks; every query block goes to every lane
    count = blocks.count()
    lanes = max(1, min(count, shuffle_width(spark)), -(-count // LANE_BLOCKS))
    placed = blocks.withColumn("lane", F.pmod(F.xxhash64("block"), F.lit(lanes)))
    asked = asked.select(*(F.col(c).alias(f"q_{c}") for c in blocks.columns))
    asked = asked.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    found, _ = write_table(asked.join(placed, "lane").mapInArrow(_search(k), FOUND))
    discard(spark, block_place)
    discard(spark, asked_place)
    ranked = Window.partitionBy("block", "place").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
