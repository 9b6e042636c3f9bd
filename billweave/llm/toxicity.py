"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its lower-cased words, of their first `STEM` letters, of pairs of adjacent words
and of pairs with one word between, each hashed to one of 2^`BITS` coordinates. A coordinate takes part once `INCLUDED`
learning rows have it. FTRL-proximal gives every coordinate a learning rate of its own and an L1 penalty, so most weights
are zero; the rest are few, 2^`BITS` at most, and every task can hold them.

Learning is distributed: `SHARDS` groups of labelled rows run FTRL apart, their states are averaged per coordinate, and
the next pass starts from the average.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.blocks import pack, pack_keys, unpack, unpack_keys
from billweave.llm.shared import Memo, discard, held_alone, small_batches, text_of, write_table, written

BITS = 22
STEM = 4
SHARDS = 4
PASSES = 3
INCLUDED = 20
SLICES = 16  # of the vector of counts, each summed in a task of its own
MOST_LABELLED = 40_000  # rows that learning reads at most; those with the smallest hash of the id
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1.0, 0.0
WORD = re.compile(r"\w+")
MIXERS = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)))

STATE = "shard int, coordinate int, z float, n float"  # single precision between passes: half the shuffle


@held_alone
def _memo() -> Memo:
    return Memo(lambda word: xxhash.xxh3_64_intdigest(word.encode()), 200_000)


def coordinates(text: str, bits: int = BITS) -> np.ndarray:
    """The distinct feature coordinates of a text, ascending; none for a text without words."""
    words = WORD.findall(text.lower())
    n = len(words)
    memo, shift = _memo(), np.uint64(64 - bits)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    stems = np.fromiter(map(memo.__getitem__, [word[:STEM] for word in words]), np.uint64, n)
    pair, skip, stem = MIXERS
    with np.errstate(over="ignore"):
        parts = [h, stems * stem, (h[:-1] * pair ^ h[1:]) * pair, (h[:-2] * skip ^ h[2:]) * skip]
    return np.unique(np.concatenate(parts) >> shift).astype(np.int32)


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights of accumulated z and n."""
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def _shard_learner(held, bits: int):
    """The function that runs one pass over the rows of a shard, from the broadcast state."""

    def one_shard(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        size = (1 << bits) + 1  # the last coordinate is the bias
        z, n = np.zeros(size), np.zeros(size)
        z[held.value[0]], n[held.value[0]] = held.value[1], held.value[2]
        frame = frame.sort_values(["id", "label"], kind="stable")
        for packed, label in zip(frame["features"], frame["label"]):
            i = np.append(unpack_keys(packed).astype(np.int32), size - 1)
            w = _weights(z[i], n[i])
            g = _sigmoid(w.sum()) - label
            root = np.sqrt(n[i] + g * g)
            z[i] += g - (root - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
        touched = np.flatnonzero(n)
        return pd.DataFrame(
            {"shard": key[0], "coordinate": touched, "z": z[touched].astype(np.float32), "n": n[touched].astype(np.float32)}
        )

    return one_shard


def _featurized(rows: DataFrame, bits: int) -> DataFrame:
    """Texts as packed coordinates."""

    def pack(batches):
        for frame in batches:
            _memo().turn()
            frame["features"] = [coordinates(text, bits).tobytes() for text in frame.pop("text")]
            yield frame

    return rows.mapInPandas(pack, "id long, label int, shard int, features binary")


def _included(rows: DataFrame, bits: int, least: int) -> np.ndarray:
    """Coordinates that `least` rows have. A task sends its counts as packed slices: most coordinates occur, so a row for each is far more."""

    def count(batches):
        seen = np.zeros(1 << bits, np.int64)
        for frame in batches:
            for packed in frame["features"]:
                seen[np.frombuffer(packed, np.int32)] += 1
        yield pd.DataFrame({"slice": range(SLICES), "counts": [pack(part) for part in seen.reshape(SLICES, -1)]})

    def common(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpack(packed).astype(np.int64) for packed in frame["counts"])
        return pd.DataFrame({"coordinate": np.flatnonzero(total >= least) + key[0] * len(total)}, dtype="int32")

    # the rows are bounded: few tasks count more of them at once and send fewer slices
    counts = rows.select("features").coalesce(SHARDS).mapInPandas(count, "slice int, counts binary")
    hit = counts.groupBy("slice").applyInPandas(common, "coordinate int")
    return hit.toPandas()["coordinate"].sort_values().to_numpy(np.int32)


def _kept_features(rows: DataFrame, included: np.ndarray) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(included)

    def keep(batches):
        for frame in batches:
            cut = [np.intersect1d(np.frombuffer(f, np.int32), held.value, assume_unique=True) for f in frame["features"]]
            frame["features"] = [c.tobytes() for c in cut]
            yield frame

    return rows.mapInPandas(keep, rows.schema)


def _packed_features(rows: DataFrame) -> DataFrame:
    """The features by their distances: every pass shuffles them."""

    def squeeze(batches):
        for frame in batches:
            frame["features"] = [pack_keys(np.frombuffer(f, np.int32).astype(np.uint64)) for f in frame["features"]]
            yield frame

    return rows.mapInPandas(squeeze, rows.schema)


def learn(docs: DataFrame, labels: DataFrame, bits: int = BITS, passes: int = PASSES, most: int = MOST_LABELLED, least: int = INCLUDED):
    """Sparse weights (coordinates, values) from `docs` (id, text) and `labels` (id, label 0 or 1), one per id.

    Rows with a null id, text or label teach nothing; of rows with one id, one teaches. No rows give no weights. The
    ids are the `most` with the smallest hash at most, so reruns learn the same, and their labels, some bytes each, are
    broadcast. The driver receives the averaged state of the included coordinates, 2^bits rows at most.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.col("id").cast("string"))
    chosen = labels.filter("id IS NOT NULL AND label IN (0, 1)").orderBy(order, "id").limit(most)
    rows = docs.filter("id IS NOT NULL AND text IS NOT NULL").join(F.broadcast(chosen), "id")
    shard = F.pmod(order, F.lit(SHARDS)).cast("int").alias("shard")
    small_batches(spark)
    whole, path = write_table(_featurized(rows.select("id", "text", "label", shard), bits))
    kept = _kept_features(whole, _included(whole, bits, least))
    sample = written(_packed_features(kept.groupBy("id", "label", "shard").agg(F.min("features").alias("features"))))
    discard(spark, path)
    state = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
    for _ in range(passes):
        learner = _shard_learner(spark.sparkContext.broadcast(state), bits)
        parts = sample.groupBy("shard").applyInPandas(learner, STATE)
        # a column per shard, so that the shards are always added in one order
        each = [F.coalesce(F.sum(F.when(F.col("shard") == s, F.col(v))), F.lit(0.0)).alias(f"{v}{s}") for v in "zn" for s in range(SHARDS)]

        def mean(name: str):
            return (sum((F.col(f"{name}{s}") for s in range(1, SHARDS)), F.col(f"{name}0")) / SHARDS).alias(name)

        means = parts.groupBy("coordinate").agg(*each).select("coordinate", mean("z"), mean("n"))
        rows = means.orderBy("coordinate").toPandas()
        state = tuple(rows[c].to_numpy() for c in ("coordinate", "z", "n"))
    weights = _weights(state[1], state[2])
    kept = np.flatnonzero(weights)
    return state[0][kept], weights[kept]


def with_score(docs: DataFrame, weights, text: str = "text", score: str = "score", bits: int = BITS) -> DataFrame:
    """`docs` with the column `score`, 0 to 1, of each whole text; null and empty texts get the bias alone."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros((1 << bits) + 1, np.float32)  # once a task
        dense[held.value[0]] = held.value[1]
        for texts in batches:
            _memo().turn()
            sums = [dense[coordinates(value, bits)].sum(dtype=np.float64) for value in texts]
            yield pd.Series(_sigmoid(np.array(sums, float) + float(dense[-1])))

    small_batches(docs.sparkSession)
    return docs.withColumn(score, scored(text_of(text)))


def toxicity(docs: DataFrame, labels: DataFrame, holds_out: int = 5) -> DataFrame:
    """Score of every row of `docs` (doc_id, text) with weights learnt from `labels` (doc_id, toxic).

    Labels are learnt only from rows whose crc32 of the id as text is not divisible by `holds_out`. `docs` keeps all its
    columns and rows and gets `held_out` (false for a null id), `score` and `predicted`; columns of these names are replaced.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % holds_out == 0, F.lit(False))
    known = labels.filter(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    weights = learn(texts, known.select(F.col("doc_id").cast("bigint").alias("id"), F.col("label").cast("int").alias("label")))
    scored = with_score(docs, weights).withColumn("held_out", held_out)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
