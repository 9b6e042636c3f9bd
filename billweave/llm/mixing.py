"""Mixing sources to target weights by entropy balancing.

Every source has a target number of words. Among all document rates between 0 and `MOST` that reach the targets, the
ones closest to 1 in relative entropy are exp(dual * size), cut at `MOST`: the dual has one number per source
and is convex, and Newton steps solve it. The steps work on counts of equal (source, size), which give the same
sums as the documents. Rates become whole copies by carrying the rounding error from the larger documents to the smaller ones.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billweave.llm.shared import discard, known_id, text_of, write_table, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
ROUNDS = 60
CLOSE = 1e-6
GROUP = 20_000  # documents whose rounding error is carried in one task


def sizes(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size in words, key); the key is the id, or a number made from the text where it is null."""
    whole = text_of(text)
    words = F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    return docs.select(
        F.col(id).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), known_id(id, text).alias("key")
    )


def numbered_sources(totals: DataFrame) -> DataFrame:
    """The sources with their place by code point, null last, from 0. Ranges are sorted apart and offset by
    the counts of the ranges before them, so no task holds all sources."""
    ordered = totals.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    marked = written(ordered.withColumn("at", F.monotonically_increasing_id()))
    # the id holds the range above 33 bits and the place within the range below
    per_range = marked.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    offsets = per_range.select("range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = marked.withColumn("range", F.shiftright("at", 33)).join(offsets, "range")
    return placed.select(*totals.columns, (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place"))


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): sources weigh `weights` in turn and divide `share` of all words by weight.

    A target stops at `most` times its source, and the excess goes to the others by weight until none is above.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = written(numbered_sources(totals).withColumn("weight", weight))
    limit = F.col("source_size") * most
    total = rows.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    level, full = 0.0, -1
    while True:  # ends when no further source is full
        open_rows = F.col("weight") * level < limit
        filled, weight_left, count = rows.agg(
            F.sum(F.when(~open_rows, limit).otherwise(0.0)),
            F.sum(F.when(open_rows, F.col("weight")).otherwise(0.0)),
            F.sum(F.when(~open_rows, 1).otherwise(0)),
        ).first()
        if not weight_left or count == full:
            break
        level, full = (total * share - filled) / weight_left, count
    return rows.select("source", "source_size", F.least(limit, F.col("weight") * level).cast("double").alias("target"))


def _rate(dual: str = "dual"):
    return F.least(F.lit(MOST), F.exp(F.least(F.lit(50.0), F.col(dual) * F.col("x"))))


def duals(counted: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, dual, scale) for goals (source, source_size, target) and counts (source, size, n).

    Newton steps on the logarithm of the reached words, kept inside a bracket that only shrinks, all sources at once. Sizes count
    in units of the source's mean size. Each round is a shuffle of one row per source and a table of the same size.
    """
    spark = counted.sparkSession
    means = counted.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"))
    base = goals.join(means, goals["source"].eqNullSafe(means["source"])).select(
        goals["source"], "source_size", "target", "scale",
        F.lit(-1e4).alias("low"), F.lit(1e4).alias("high"), F.lit(0.0).alias("dual"), F.lit(False).alias("done"),
    )
    state, path = write_table(base.filter("source_size > 0"))
    for _ in range(ROUNDS):
        s = state.withColumnRenamed("source", "s")
        rows = counted.join(s, counted["source"].eqNullSafe(s["s"])).withColumn("x", F.col("size") / F.col("scale"))
        reached = F.col("size") * F.col("n") * _rate()
        slope = F.when(_rate() < MOST, reached * F.col("x")).otherwise(0.0)
        keys = ["s", "source_size", "target", "scale", "low", "high", "dual", "done"]
        sums = rows.groupBy(*keys).agg(F.sum(reached).alias("words"), F.sum(slope).alias("slope"))
        under = F.col("words") < F.col("target")
        low, high = F.when(under, F.col("dual")).otherwise(F.col("low")), F.when(under, F.col("high")).otherwise(F.col("dual"))
        step = F.col("dual") - F.log(F.col("words") / F.col("target")) * F.col("words") / F.col("slope")
        inside = (F.col("slope") > 0) & (F.col("words") > 0) & (step > low) & (step < high)
        done = F.abs(F.col("words") - F.col("target")) <= CLOSE * F.col("target")
        moved = F.when(done, F.col("dual")).when(inside, step).otherwise((low + high) / 2)
        following = sums.select(
            F.col("s").alias("source"), "source_size", "target", "scale",
            low.alias("low"), high.alias("high"), moved.alias("dual"), done.alias("done"),
        )
        new_state, new_path = write_table(following)
        discard(spark, path)
        state, path = new_state, new_path
        if state.filter("NOT done").limit(1).count() == 0:
            break
    return state.select("source", "dual", "scale")


def _carry(frame: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for the rates of one group, the largest documents first; the error never exceeds half the last size."""
    frame = frame.sort_values(["size", "key"], ascending=[False, True], kind="stable")
    copies, error = np.zeros(len(frame), np.int64), 0.0
    for k, (size, rate) in enumerate(zip(frame["size"].to_numpy(), frame["rate"].to_numpy())):
        if size:
            wanted = rate * size + error
            copies[k] = min(int(MOST), max(0, round(wanted / size)))
            error = wanted - copies[k] * size
        else:
            copies[k] = 1
    return frame.assign(copies=copies)[["doc_id", "source", "size", "key", "source_size", "target", "copies"]]


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, **columns: str) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, copies, taken) of every row of `docs`.

    Null texts have size 0 and are copied once, which takes no words; a source without words has target 0. Null
    sources are a source of their own; repeated rows are rows of their own; an empty table gives an empty one. Reruns give
    the same result. A source is rounded in groups by the hash of the key, so one source may hold all rows.
    """
    rows = written(sizes(docs, **columns))
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    goals = written(targets(per_source.select("source", "source_size"), weights, share))
    counted = written(rows.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    solved = duals(counted, goals)
    sized = per_source.select(F.col("source").alias("p"), F.ceil(F.col("n_docs") / GROUP).alias("groups"))
    d = solved.withColumnRenamed("source", "d")
    plan = goals.join(sized, goals["source"].eqNullSafe(sized["p"]), "left")
    plan = plan.join(d, F.col("source").eqNullSafe(d["d"]), "left").select(
        F.col("source").alias("s"), "source_size", "target", "groups",
        F.round(F.coalesce("dual", F.lit(0.0)), 9).alias("dual"), F.coalesce("scale", F.lit(1.0)).alias("scale"),
    )
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["s"])).withColumn("x", F.col("size") / F.col("scale"))
    full = F.col("target") >= MOST * F.col("source_size")
    rated = joined.withColumn("rate", F.when(full, F.lit(MOST)).otherwise(_rate()))
    group = F.pmod(F.xxhash64("key"), F.col("groups")).alias("group")
    narrow = rated.select("doc_id", "source", "size", "key", "source_size", "target", "rate", group)
    schema = narrow.select("doc_id", "source", "size", "key", "source_size", "target").schema.add("copies", "long")
    copied = narrow.groupBy("source", "group").applyInPandas(_carry, schema)
    return copied.withColumn("taken", F.col("size") * F.col("copies"))
