"""Connected components of a link table, in rounds of stars until one task can hold what is left."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.shared import discard, write_table

HELD = 500_000  # nodes that a task holds at a time


class Forest:
    """Union-find over the links of one task; the smaller end is always the root."""

    def __init__(self):
        self.up = {}

    def root(self, node):
        path = []
        while (above := self.up.get(node, node)) != node:
            path.append(node)
            node = above
        for seen in path:
            self.up[seen] = node
        return node

    def link(self, a, b) -> None:
        self.up.setdefault(a, a)
        self.up.setdefault(b, b)
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple]:
        """(node, root) of every node that is not its own root."""
        return [(node, root) for node in list(self.up) if (root := self.root(node)) != node]


def _reduced(edges: DataFrame) -> DataFrame:
    """Links (high, low) of each task as stars: no more of them than nodes."""
    schema = edges.schema

    def reduce(batches):
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch["high"], batch["low"]):
                forest.link(a, b)
            if len(forest.up) > HELD:  # bound the memory of a task; what is cut off is joined in later rounds
                yield pd.DataFrame(forest.stars(), columns=["high", "low"])
                forest = Forest()
        yield pd.DataFrame(forest.stars(), columns=["high", "low"])

    return edges.mapInPandas(reduce, schema)


def _mark(edges: DataFrame) -> tuple:
    """Number and checksum of the links."""
    total = F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), total).first())


def _stars(edges: DataFrame) -> DataFrame:
    """A large-star step, then a small-star step; minima combine before the shuffle, and the joins are
    inner joins that Spark can split at a hot node."""
    both = edges.select(F.col("high").alias("u"), F.col("low").alias("v")).unionByName(
        edges.select(F.col("low").alias("u"), F.col("high").alias("v"))
    )
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("high"), F.col("m").alias("low"))
    large = large.filter("high != low").distinct()
    least = large.groupBy("high").agg(F.min("low").alias("m"))
    moved = large.join(least, "high").select(F.col("low").alias("high"), F.col("m").alias("low"))
    return moved.filter("high != low").unionByName(least.select("high", F.col("m").alias("low"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; the root is the smallest node reachable.

    Any orderable node type. Loops and repeated links do no harm; links with a null end are ignored; an
    empty table gives an empty one. Each round is written to the shared folder, so a lost executor costs
    one round at most. Links too few to have more than `HELD` nodes are followed to the end in one task; more of them take rounds.
    """
    spark = edges.sparkSession
    links = edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low"))
    links = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("high") != F.col("low")))
    current, path = write_table(_reduced(links))
    mark = _mark(current)
    while mark[0]:
        few = 2 * mark[0] <= HELD
        following, new_path = write_table(_reduced(current.coalesce(1)) if few else _stars(current))
        new_mark = mark if few else _mark(following)
        discard(spark, path)
        current, path = following, new_path
        if new_mark == mark:
            break
        mark = new_mark
    roots = current.select(F.col("high").alias("node"), F.col("low").alias("root"))
    return roots.unionByName(current.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
