"""Near-duplicate texts: one-permutation MinHash with optimal densification, banded buckets, hubs, then the possible pairs of the rest.

One hash per shingle serves all bins: its high bits name the bin, and the smallest hash of a bin is the signature there. An
empty bin borrows from the first filled bin of a hashed sequence of its own, so two texts borrow alike. Rows of
bins form bands, and equal bands are a bucket. Each bucket's hub, found over all its sets, is compared with the others;
then those sets of a bucket that are not yet in one component, by outlines: bitmaps that bound what two sets can share. Only pairs that
the bound allows are confirmed. So any two sets of a bucket are compared, connected or proven too different.
Candidates are confirmed on the full shingle sets, and confirmed links are followed to components.

With 42 bands of 6 bins a pair of similarity 0.8 meets in 11 bands on average and in none with a chance of 3 in a million.
"""


import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.components import components
from billweave.llm.shared import NAMELESS, Memo, held_alone, known_id, small_batches, text_of, written

BINS_LOG, BANDS, ROWS = 8, 42, 6
HUB_ROUNDS = 2  # rounds of one center per bucket before all pairs of the rest
HOT = 2000  # sets of a bucket that one task compares with each other
OUTLINE = 1 << 12  # bits of the bitmap of a set
BINS = 1 << BINS_LOG
A, B, C = map(np.uint64, (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
S27, S31 = np.uint64(27), np.uint64(31)


@held_alone
def _memo() -> Memo:
    return Memo(xxhash.xxh3_64_intdigest)


def mixed(x: np.ndarray) -> np.ndarray:
    """A mixing of 64-bit numbers that maps no two to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> S27)) * B
        x = (x ^ (x >> S31)) * C
    return x ^ (x >> S31)


def shingles(text: str, width: int = 2) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes; with fewer words, all words as one.

    A-Z count as a-z; words are separated by the ASCII space characters.
    """
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_memo().__getitem__, words), np.uint64, n)
    span = min(n, width)
    with np.errstate(over="ignore"):
        x = h[: n - span + 1]
        for k in range(1, span):
            x = mixed(x * A + h[k : n - span + 1 + k])
    return np.unique(mixed(x + np.uint64(span)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """One value per bin, for a set that is not empty."""
    bins = (hashes >> np.uint64(64 - BINS_LOG)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    values, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    values[bins[first]], filled[bins[first]] = hashes[first], True
    if len(first) == 1:
        return np.full(BINS, hashes[0])
    empty, attempt, out = np.flatnonzero(~filled), 0, values.copy()
    while len(empty):
        attempt += 1
        with np.errstate(over="ignore"):
            asked = (mixed(empty.astype(np.uint64) * A + np.uint64(attempt)) >> np.uint64(64 - BINS_LOG)).astype(np.int64)
        found = filled[asked]
        out[empty[found]] = values[asked[found]]
        empty = empty[~found]
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = values[: BANDS * ROWS].reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            keys = mixed(keys * A + rows[:, k])
    return keys


def _sketched(docs: DataFrame, text: str, width: int, id: str, keep: list[str]) -> DataFrame:
    """(row, key, mark, packed, n, node, bands) of every row, written once; `packed` is the compressed text. `node` stands for a shingle set: 64 bits of
    its digest, null for an empty set; `mark` tells repeated rows apart."""

    @F.arrow_udf("n long, node long, bands binary, packed binary")
    def sketch(texts: pa.Array) -> pa.Array:
        _memo().turn()
        sizes, nodes, bands, packed = [], [], [], []
        squeeze = zstandard.ZstdCompressor(level=6).compress
        for value in texts.to_pylist():
            x = shingles(value, width)
            sizes.append(len(x))
            nodes.append(xxhash.xxh3_64_intdigest(x.tobytes()) - (1 << 63) if len(x) else None)
            bands.append(band_keys(signature(x)).tobytes() if len(x) else None)
            packed.append(squeeze(value.encode()))
        columns = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(bands, pa.binary())]
        columns.append(pa.array(packed, pa.binary()))
        return pa.StructArray.from_arrays(columns, ["n", "node", "bands", "packed"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*keep).alias("row"), known_id(id, text).alias("key"), text_of(text).alias("text"))
    rows = rows.withColumn("s", sketch("text")).withColumn("mark", F.monotonically_increasing_id())
    return written(rows.select("row", "key", "mark", "s.packed", "s.n", "s.node", "s.bands"))


def buckets(sets: DataFrame) -> DataFrame:
    """(key, node, copies, n, root) of sets (node, bands, copies, n), for every band key that several sets have; each set is a root."""

    def spread(batches):
        for frame in batches:
            keys = np.frombuffer(b"".join(frame["bands"]), np.int64)
            yield pd.DataFrame({"key": keys, "node": np.repeat(frame["node"].to_numpy(np.int64), BANDS)})

    sets.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    keyed = sets.select("node", "bands").mapInPandas(spread, "key long, node long")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    placed = keyed.join(shared, "key").join(sets.select("node", "copies", "n"), "node")
    return written(placed.select("key", "node", "copies", "n", F.col("node").alias("root")))


def unsettled(rest: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of buckets that hold more than one root, by the roots (node, root) found so far."""
    placed = rest.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    return written(placed.join(several.select("key"), "key").select("key", "node", "copies", "n", "root"))


def hubs_of(rest: DataFrame) -> DataFrame:
    """(key, hub) of each bucket, over all its rows: the set that meets most others over all its buckets, then the one with
    most copies. What near copies were made from is in more full buckets than any of them."""
    sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    weights = rest.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("weight"))
    best = F.max(F.struct("weight", "copies", "node", "n", "root"))
    return written(rest.join(weights, "node").groupBy("key").agg(best.alias("hub")))


def _fit(m: str, n: str, percent: int):
    """Smaller sets cannot be similar enough."""
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def hub_pairs(rest: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each bucket's hub and its rows of other roots."""
    met = rest.join(hubs, "key").filter((F.col("root") != F.col("hub.root")) & _fit("n", "hub.n", percent))
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def outlines(full: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, outline) of the sets `nodes`: a bitmap of the hashes of the shingles."""

    def draw(batches):
        open_text = zstandard.ZstdDecompressor().decompress
        for frame in batches:
            _memo().turn()
            drawn = []
            for packed in frame["packed"]:
                bits = np.zeros(OUTLINE, np.uint8)
                bits[(shingles(open_text(packed).decode(), width) % np.uint64(OUTLINE)).astype(np.int64)] = 1
                drawn.append(np.packbits(bits).tobytes())
            yield pd.DataFrame({"node": frame["node"], "outline": drawn})

    small_batches(full.sparkSession)
    texts = full.select("node", "packed").join(nodes.hint("merge"), "node", "left_semi").groupBy("node").agg(F.min("packed").alias("packed"))
    return texts.mapInPandas(draw, "node long, outline binary")


def _possible(x: pd.DataFrame, y: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Pairs (a, b) of rows of `x` and `y` with different roots that may be similar enough: a bit that one outline lacks is a shingle that
    its set lacks, so what two sets share is bounded. No pair that is similar enough is left out.

    Rows of the commonest root of `y` are only compared with rows of other roots: a component that fills a bucket costs nothing by itself.
    """
    left, right = (np.stack([np.frombuffer(o, np.uint64) for o in f["outline"]]) for f in (x, y))
    (n, m), (r, q) = ((x[c].to_numpy(), y[c].to_numpy()) for c in ("n", "root"))
    bits, others = (np.bitwise_count(o).sum(axis=1, dtype=np.int64) for o in (left, right))
    roots, sizes = np.unique(q, return_counts=True)
    commonest = q == roots[sizes.argmax()]
    rare = np.flatnonzero(~commonest)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i in range(len(x)):
        # a row of that root meets the rest of y, any other row meets all of it
        part = rare if r[i] == roots[sizes.argmax()] else slice(None)
        both = np.bitwise_count(left[i] & right[part]).sum(axis=1, dtype=np.int64)
        common = np.minimum(n[i] - (bits[i] - both), m[part] - (others[part] - both))
        hit = np.flatnonzero((100 * common >= percent * (n[i] + m[part] - common)) & (q[part] != r[i]))
        hit = rare[hit] if part is rare else hit
        found.append((np.full(len(hit), i), hit))
    i, j = (np.concatenate(f) for f in zip(*found))
    a, b = x["node"].to_numpy()[i], y["node"].to_numpy()[j]
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def rest_pairs(rest: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different roots of each bucket that may be similar enough. Large buckets are cut into blocks that meet in pairs; a
    task holds one pair of blocks at a time, and only possible pairs leave it."""
    sizes = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("blocks"))
    placed = rest.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("low"), F.greatest("own", o).alias("high")))
    sent = placed.withColumn("pair", F.explode(meets)).select("key", "pair.low", "pair.high", "own", "node", "n", "root")
    on = ["key", "low", "high"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        own = group["own"] == group["low"]
        x, y = (group, group) if group["low"].iat[0] == group["high"].iat[0] else (group[own], group[~own])
        apart = len(x) and len(y) and group["root"].nunique() > 1
        return _possible(x, y, percent) if apart else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    def run(batches):
        held = None
        for frame in batches:
            frame = frame if held is None else pd.concat((held, frame), ignore_index=True)
            names = frame[on].to_numpy()
            cuts = np.append(np.flatnonzero((np.diff(names, axis=0) != 0).any(axis=1)) + 1, len(frame))
            begin = 0
            for end in cuts[:-1]:
                if end - begin > 1:
                    yield compare(frame.iloc[begin:end])
                begin = end
            held = frame.iloc[begin:]
        if held is not None and len(held) > 1:
            yield compare(held)

    rest.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    rows = sent.join(drawn, "node").repartition(*on).sortWithinPartitions(*on)
    return rows.mapInPandas(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of (a, b, left, right) whose full sets are similar enough."""

    def confirm(batches):
        for frame in batches:
            _memo().turn()
            held: dict[int, np.ndarray] = {}
            open_text = zstandard.ZstdDecompressor().decompress
            good = []
            for a, b, left, right in zip(frame["a"], frame["b"], frame["left"], frame["right"]):
                for node, packed in ((a, left), (b, right)):
                    if node not in held:
                        held[node] = shingles(open_text(packed).decode(), width)
                x, y = held[a], held[b]
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield frame.loc[np.array(good, bool), ["a", "b"]]

    return pairs.mapInPandas(confirm, "a long, b long")


def _links(full: DataFrame, asked: DataFrame, width: int, percent: int) -> DataFrame:
    """The written candidates (a, b) that are links. Joins of texts are never broadcast, at any size of the input."""
    nodes = asked.select(F.explode(F.array("a", "b")).alias("node")).distinct().hint("merge")
    texts = full.select("node", "packed").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("packed").alias("packed"))
    texts = written(texts)
    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("left")).hint("merge")
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("right")).hint("merge")
    small_batches(full.sparkSession)
    return _confirmed(asked.join(left, "a").join(right, "b"), width, percent)


def _connected(full: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, root) of the sets that have links.

    In each of the first rounds every bucket's hub is compared with all others of the bucket, and leaves it. What that
    connects needs no more comparing. Then what is still apart in a bucket is compared by outlines, and possible pairs in full.
    """
    rest = buckets(sets)
    roots = sets.select("node", F.col("node").alias("root")).limit(0)
    done = None
    for turn in range(HUB_ROUNDS + 1):
        if turn:
            rest = unsettled(rest, roots)
        if rest.isEmpty():
            break
        if turn < HUB_ROUNDS:
            hubs = hubs_of(rest)
            pairs = hub_pairs(rest, hubs, percent)
            rest = rest.join(hubs.select("key", "hub.node"), ["key", "node"], "left_anti")
        else:
            pairs = rest_pairs(rest, written(outlines(full, rest.select("node").distinct(), width)), percent)
        asked = written(pairs.join(done, ["a", "b"], "left_anti") if done is not None else pairs)
        done = done.unionByName(asked) if done is not None else asked
        found = _links(full, asked, width, percent)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found), "a", "b")
    return roots


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text", keep=None) -> DataFrame:
    """(row, key, mark, n, component, chosen) of every row of `docs`: `row` holds its columns, or those of `keep`, `component` the smallest id
    reachable over links, and `chosen` is true for one row of each component.

    Texts are linked when the intersection of their shingle sets is at least `percent` of the union. Null and empty
    texts are linked with nothing. A null id counts as larger than any other. Equal sets, however many, are one node. Of
    repeated rows one is chosen. An empty table gives an empty one.
    """
    rows = _sketched(docs, text, width, id, keep or docs.columns)
    full = rows.filter("node IS NOT NULL")
    each = full.groupBy("node").agg(F.min("bands").alias("bands"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"))
    roots = _connected(full, written(each), width, percent)
    best = full.groupBy("node").agg(F.min(F.struct("key", "mark")).alias("best"))
    best = best.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labels = best.groupBy("root").agg(F.min("best").alias("label"))
    labels = best.select("node", "root").join(labels, "root").select("node", "label")
    joined = rows.select("row", "key", "mark", "n", "node").join(labels, "node", "left")
    own = F.struct("key", "mark")
    label = F.coalesce("label", own)
    return joined.select(
        "row", "key", "mark", "n", label.getField("key").alias("component"), (label == own).alias("chosen")
    )


def components_of(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; `kept` where the id is the component's. The component of rows
    that all lack an id is null."""
    found = near_duplicates(docs, width, percent, keep=["doc_id"])
    component = F.when(F.col("component") < NAMELESS, F.col("component"))
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component."""
    return near_duplicates(docs, width, percent).filter("chosen").select("row.*")
