"""Embedding near-duplicates: iterative quantization, multi-index Hamming tables, exact rerank.

Vectors are centered, projected on their principal directions and rotated so that their signs lose least: iterative
quantization alternates between the nearest signs and the best rotation. Each bit is cut at its median, so codes are
balanced. Codes are split into chunks, and every chunk of every rotation is a table: two vectors are compared when they
share a chunk. Compared vectors are reranked with the original values in double precision.

Rotations are learnt from `SAMPLE` vectors at most; all vectors are indexed. The chunk width starts from the size of the largest label, and
width and number of tables follow from measurement: pairs at the threshold, of the sample and made ones, must meet in some table to a share
of `FOUND`, in every label that the sample shows well.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.components import Forest, components
from billweave.llm.shared import small_batches, written

SAMPLE = 4_000
TURNS = 30
ROTATIONS = 16  # learnt at most
PAIRS = 2_000  # pairs at the threshold that a measurement takes of a kind
MEASURED = 40  # vectors of a label in the sample from which on it is measured by itself
FOUND = 0.999
BLOCK = 1_500  # vectors that one task multiplies with as many
NOTHING = pd.DataFrame({"node": [], "links": [], "root": []}, dtype="int64")


def rotations(vectors: np.ndarray, count: int, seed: int = 1):
    """(mean, [projection], [cut]) of `count` rotations learnt by iterative quantization."""
    mean = vectors.mean(axis=0)
    centered = vectors - mean
    _, _, axes = np.linalg.svd(centered, full_matrices=False)
    dim = vectors.shape[1]
    axes = axes if len(axes) == dim else np.eye(dim)
    projected = centered @ axes.T
    chance = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        rotation, _ = np.linalg.qr(chance.standard_normal((dim, dim)))
        for _ in range(TURNS):
            signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(projected.T @ signs)
            rotation = left @ right
        whole = axes.T @ rotation
        out.append((whole, np.median(centered @ whole, axis=0)))
    return mean, [w for w, _ in out], [c for _, c in out]


def _near_pairs(vectors: np.ndarray, threshold: float, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at the threshold: those of the sample that are nearest to it from above, and made ones, each vector with one at
    the threshold in a random direction."""
    chance = np.random.default_rng(seed)
    left, right, gap = [], [], []
    for k in range(0, len(vectors), 500):
        cosine = np.triu(vectors[k : k + 500] @ vectors.T, k + 1)
        i, j = np.nonzero(cosine >= threshold)
        near = np.argsort(cosine[i, j], kind="stable")[:PAIRS]
        left.append(i[near] + k), right.append(j[near]), gap.append(cosine[i, j][near])
    order = np.argsort(np.concatenate(gap), kind="stable")[:PAIRS]
    x, y = vectors[np.concatenate(left)[order]], vectors[np.concatenate(right)[order]]
    if vectors.shape[1] > 1:
        base = vectors[chance.integers(0, len(vectors), PAIRS)]
        aside = chance.standard_normal(base.shape)
        aside -= (aside * base).sum(axis=1, keepdims=True) * base
        aside /= np.linalg.norm(aside, axis=1, keepdims=True)
        x, y = np.concatenate((x, base)), np.concatenate((y, threshold * base + math.sqrt(1 - threshold**2) * aside))
    return x, y


def plan(vectors: np.ndarray, labels: np.ndarray, learnt, largest: int, threshold: float) -> tuple[int, int, int]:
    """(chunk width, chunks per rotation, rotations) by which pairs at the threshold meet, measured on the sample for every label that
    has `MEASURED` vectors there, and for all together.

    The width starts from the size of the largest label and shrinks until the learnt rotations bring `FOUND` of the pairs
    together; then no more rotations are used than that takes. Vectors that are all alike end in one bucket a label: width 0.
    """
    mean, projections, cuts = learnt
    dim = vectors.shape[1]
    groups = [vectors] + [vectors[labels == label] for label in np.unique(labels) if (labels == label).sum() >= MEASURED]
    agree = []  # per group: rotation, pair, bit
    for group in groups:
        x, y = _near_pairs(group, threshold)
        agree.append([((x - mean) @ w >= c) == ((y - mean) @ w >= c) for w, c in zip(projections, cuts)])
    width = max(1, min(dim, 24, math.ceil(math.log2(max(2, largest)))))
    while True:
        chunks = dim // width
        met = [np.logical_or.accumulate([a[:, : chunks * width].reshape(-1, chunks, width).all(axis=2).any(axis=1) for a in each]) for each in agree]
        shares = np.min([m.mean(axis=1) if m.shape[1] else np.ones(len(m)) for m in met], axis=0)
        enough = np.flatnonzero(shares >= FOUND)
        if len(enough) or width == 1:
            break
        width -= 1
    count = int(enough[0]) + 1 if len(enough) else len(projections)
    codes = _codes(vectors, (mean, projections[:count], cuts[:count]), width, chunks)
    compared = sum(float((np.unique(column, return_counts=True)[1].astype(float) ** 2).sum()) for column in codes.T)
    if compared >= len(vectors) ** 2:
        return 0, 1, 1  # buckets of all tables together are more than a label as one bucket, whose blocks meet once
    return width, chunks, count


def _codes(vectors: np.ndarray, learnt, width: int, chunks: int) -> np.ndarray:
    """Chunk values, one row per vector and one column per table."""
    mean, projections, cuts = learnt
    if not width:
        return np.zeros((len(vectors), 1), np.int32)
    powers = 1 << np.arange(width, dtype=np.int64)
    tables = []
    for projection, cut in zip(projections, cuts):
        bits = ((vectors - mean) @ projection >= cut).astype(np.int64)
        for k in range(chunks):
            tables.append(bits[:, k * width : (k + 1) * width] @ powers)
    return np.stack(tables, axis=1).astype(np.int32)


def _unit(rows) -> np.ndarray:
    vectors = np.stack([np.asarray(v, np.float64) for v in rows])
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _compare(left: pd.DataFrame, right: pd.DataFrame | None, table: int, threshold: float) -> pd.DataFrame:
    """Links between two blocks of a bucket, or within one: how many each vector has in this table that no earlier table has, and
    enough of them, marked, to connect what the block connects."""
    other = left if right is None else right
    codes, other_codes = (np.stack([np.frombuffer(c, np.int32) for c in f["codes"]]) for f in (left, other))
    near = _unit(left["vec"]) @ _unit(other["vec"]).T >= threshold
    if right is None:
        near &= np.triu(np.ones(near.shape, bool), 1)
    i, j = np.nonzero(near)
    if table:
        fresh = ~(codes[i, :table] == other_codes[j, :table]).any(axis=1)
        i, j = i[fresh], j[fresh]
    a, b = left["node"].to_numpy()[i], other["node"].to_numpy()[j]
    if not len(a):
        return NOTHING
    copies_a, copies_b = left["copies"].to_numpy()[i], other["copies"].to_numpy()[j]
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    links = np.bincount(at, np.concatenate((copies_b, copies_a))).astype(np.int64)
    forest = Forest()
    for x, y in zip(a.tolist(), b.tolist()):
        forest.link(x, y)
    return pd.DataFrame({"node": nodes, "links": links, "root": [forest.root(x) for x in nodes.tolist()]})


def linked(vectors: DataFrame, threshold: float = 0.93, id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors`.

    Vectors of one label are linked when their cosine in double precision is `threshold` or more. A vector that is null,
    empty, zero or holds nulls or non-finite components, or has no label, is linked with nothing. Equal vectors of a label, however
    many, are compared as one; each of them has the others as links. Repeated rows are rows of their own. Vectors of
    different lengths are never linked. A row without id has no id to give: a component of such rows has a null id. An empty
    table gives an empty one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).alias("vec_id"), F.col(vec).cast("array<double>").alias("vec"), F.col(label).alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    vec0 = F.transform("vec", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))  # -0.0 is 0.0
    node = F.when(sound, F.xxhash64(F.col("label").cast("string"), vec0)).alias("node")
    rows = written(rows.select("vec_id", "label", "vec", node))
    distinct = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")
    )
    distinct = written(distinct.withColumn("dim", F.size("vec")))
    empty = spark.createDataFrame([], "node long, links long, root long")
    found = empty
    for (dim,) in distinct.select("dim").distinct().collect():  # vectors of one table have one length, as a rule
        found = found.unionByName(_tables(distinct.filter(F.col("dim") == dim), dim, threshold))
    found = written(found)
    roots = components(found, "node", "root")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = distinct.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "root").join(counts, "node", "left")
    labels = labels.select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    result = rows.select("vec_id", "node").join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )


def _tables(distinct: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(node, links, root) of the compared blocks of all tables."""
    spark = distinct.sparkSession
    largest = distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    sample = distinct.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vec", F.col("label").cast("string").alias("label")).toPandas()
    unit = _unit(sample["vec"])
    learnt = rotations(unit, ROTATIONS)
    width, chunks, count = plan(unit, sample["label"].to_numpy(str), learnt, largest, threshold)
    held = spark.sparkContext.broadcast((learnt[0], learnt[1][:count], learnt[2][:count]))

    def code(batches):
        for frame in batches:
            if len(frame):
                table = _codes(_unit(frame["vec"]), held.value, width, chunks)
                frame["codes"] = [row.tobytes() for row in table]
                frame["keys"] = list(table)
                yield frame

    small_batches(spark)
    coded = distinct.select("node", "label", "vec", "copies").mapInPandas(
        code, f"node long, label {dict(distinct.dtypes)['label']}, vec array<double>, copies long, codes binary, keys array<int>"
    )
    coded = written(coded)
    keyed = coded.select("node", "label", F.posexplode("keys").alias("table", "key"))
    bucket = ["label", "table", "key"]
    sizes = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK)
    own = F.pmod(F.xxhash64("node", "table"), F.col("blocks")).cast("int")
    placed = keyed.join(sizes, bucket).withColumn("blocks", blocks).withColumn("own", own)
    # every block meets every other one and itself: a bucket of n vectors sends n / BLOCK copies of each
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1), lambda o: F.struct(F.least("own", o).alias("low"), F.greatest("own", o).alias("high")))
    sent = placed.withColumn("pair", F.explode(meets)).select("node", *bucket, "own", "pair.low", "pair.high")
    full = sent.join(coded.select("node", "vec", "copies", "codes"), "node")
    # a task takes many small buckets; a large bucket has blocks of its own
    lanes = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = full.withColumn("lane", F.pmod(F.xxhash64(*bucket, "low", "high"), F.lit(lanes)))

    def one_lane(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, table, _, low, high), group in frame.groupby([*bucket, "low", "high"], sort=False):
            if low == high:
                out.append(_compare(group, None, table, threshold))
            else:
                out.append(_compare(group[group["own"] == low], group[group["own"] == high], table, threshold))
        return pd.concat(out) if out else NOTHING

    return full.groupBy("lane").applyInPandas(one_lane, "node long, links long, root long")
