"""Ordered computations that stay distributed when one key holds a large share of the rows.

A plain window sends all rows of a key to one task. Here the table is cut into ranges of (keys, order) with about as many rows each; the
limits are quantiles of a sample over all these columns, so neither a far-off value, nor a constant column, nor a key that
holds all rows makes a range large. Windows run per (range, key). Only a key that a limit cuts through needs anything from other ranges, and
there are at most two such keys a range: what they bring along comes from a table of at most two rows a range.

`order` should tell the rows of a key apart: rows that are equal in keys and order stay in one range.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE = "_range"
SAMPLED = 32  # sampled rows of a range


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join that treats null keys as equal and keeps the left side's keys."""
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_right_{key}")
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(renamed[f"_right_{key}"])
    return left.join(renamed, condition, how).drop(*[f"_right_{key}" for key in keys])


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def _key(keys: Sequence[str]) -> Column:
    """The keys as one value; structs compare field by field, nulls are equal and come first."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.lit(0)


def _at(keys: Sequence[str], order: Sequence[str | Column]) -> Column:
    """Where a row stands: its keys, then its order columns."""
    return F.struct(_key(keys).alias("key"), *[c.alias(f"o{i}") for i, c in enumerate(_columns(order))])


def limits(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], ranges: int) -> Column:
    """A scalar subquery: the ranges - 1 places that cut the table into ranges of about as many rows each.

    The sample is the rows with the smallest hashes of their place: its size depends on `ranges` alone, and a repeated run draws the same.
    """
    drawn = df.select(_at(keys, order).alias("_at")).orderBy(F.xxhash64("_at"), "_at").limit(ranges * SAMPLED)
    in_order = drawn.agg(F.sort_array(F.collect_list("_at")).alias("_all"))
    cuts = F.sequence(F.lit(1), F.lit(ranges - 1)) if ranges > 1 else F.array().cast("array<int>")
    picked = F.transform(cuts, lambda i: F.try_element_at("_all", (i * F.size("_all") / ranges).cast("int") + 1))
    return in_order.select(picked.alias("_limits")).scalar()


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], ranges: int | None = None) -> DataFrame:
    """`df` with its range (the number of limits at or before a row), and whether a limit cuts through the row's key there (`_cut`).

    As many ranges as shuffle partitions, unless told otherwise: that number follows the size of the cluster's jobs.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_limits", limits(df, keys, order, ranges)).withColumn("_at", _at(keys, order))
    # binary search in one expression: with a column a step, a filter pushed below the steps repeats each step twice, 2^steps times in all
    steps = [F.lit(1 << bit) for bit in reversed(range((ranges - 1).bit_length()))]

    def step(at: Column, width: Column) -> Column:
        return F.when(F.try_element_at("_limits", at + width) <= F.col("_at"), at + width).otherwise(at)

    found = F.coalesce(F.aggregate(F.array(*steps), F.lit(0), step), F.lit(0)) if steps else F.lit(0)
    placed = placed.withColumn(RANGE, found)
    key = F.col("_at.key")
    lower = F.try_element_at("_limits", F.nullif(F.col(RANGE), F.lit(0))).getField("key")
    upper = F.try_element_at("_limits", F.col(RANGE) + 1).getField("key")
    return placed.withColumn("_cut", F.coalesce((key == lower) | (key == upper), F.lit(False))).drop("_limits", "_at")


def of_cut_keys(placed: DataFrame, keys: Sequence[str], **facts: Column) -> DataFrame:
    """Aggregates per range of the keys that a limit cuts through: at most two keys a range.

    All other rows fall into one more group, without range. A filter instead would be pushed below the search for the range and repeat it.
    """
    where = [F.when(F.col("_cut"), F.col(c)).alias(c) for c in (RANGE, *keys)]
    return placed.groupBy(*where).agg(*[fact.alias(name) for name, fact in facts.items()])


def _with_cut_keys(rows: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join facts of the cut keys: at most two rows a range, so their table may be sent to all tasks."""
    return null_safe_join(rows, F.broadcast(facts), [RANGE, *keys], "left")


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    number: str = "row_number",
    total: str | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Row number within the keys by ascending `order`, and optionally the number of rows of the key.

    Without keys it numbers the whole table, still without a one-partition window over its rows.
    """
    keys = list(keys)
    placed = in_ranges(df, keys, order, ranges)
    by_key = Window.partitionBy(*keys)
    sizes = of_cut_keys(placed, keys, _size=F.count(F.lit(1)))
    earlier = by_key.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    facts = sizes.select(
        RANGE, *keys, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"), F.sum("_size").over(by_key).alias("_total")
    )
    within = Window.partitionBy(RANGE, *keys)
    rows = placed.withColumn("_within", F.row_number().over(within.orderBy(*_columns(order))))
    if total is not None:
        rows = rows.withColumn("_here", F.count(F.lit(1)).over(within))
    joined = _with_cut_keys(rows, facts, keys).withColumn(number, F.col("_within") + F.coalesce("_offset", F.lit(0)))
    if total is not None:
        joined = joined.withColumn(total, F.coalesce("_total", "_here"))
    return joined.drop(RANGE, "_cut", "_within", "_here", "_offset", "_total")


def lagged(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: dict[str, str], ranges: int | None = None
) -> DataFrame:
    """Previous row's values within the keys: `columns` maps source column to new name."""
    keys = list(keys)
    packed = F.struct(*[F.col(c).alias(new) for c, new in columns.items()])
    placed = in_ranges(df, keys, order, ranges)
    tails = of_cut_keys(placed, keys, _tail=F.max_by(packed, F.struct(*order)))
    facts = tails.select(RANGE, *keys, F.lag("_tail").over(Window.partitionBy(*keys).orderBy(RANGE)).alias("_before"))
    within = Window.partitionBy(RANGE, *keys).orderBy(*order)
    joined = _with_cut_keys(placed.withColumn("_near", F.lag(packed).over(within)), facts, keys)
    return joined.withColumn("_previous", F.coalesce("_near", "_before")).select(
        *df.columns, *[F.col(f"_previous.{new}").alias(new) for new in columns.values()]
    )


def carried(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str, ranges: int | None = None
) -> DataFrame:
    """The last non-null value of `column` at or before each row of the key."""
    keys = list(keys)
    placed = in_ranges(df, keys, order, ranges)
    known = F.when(F.col(column).isNotNull(), F.struct(*order))
    tails = of_cut_keys(placed, keys, _tail=F.max_by(column, known))
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    facts = tails.select(RANGE, *keys, F.last("_tail", ignorenulls=True).over(earlier).alias("_before"))
    upto = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _with_cut_keys(placed.withColumn("_near", F.last(column, ignorenulls=True).over(upto)), facts, keys)
    return joined.withColumn(name, F.coalesce("_near", "_before")).drop(RANGE, "_cut", "_near", "_before")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by `order`, as an aggregate that combines before the shuffle."""
    row = F.min_by(F.struct(*df.columns), F.struct(*order))
    picked = df.groupBy(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]).agg(row.alias("_row"))
    return picked.select("_row.*")


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    percents: Sequence[int],
    bin_width: int = 4096,
) -> DataFrame:
    """Count, sum, min, max and interpolated percentiles of a non-negative whole number per key.

    Percentile p is returned times 100 as a whole number (`p50_x100`), so that no precision is lost
    before the caller's own rounding. Equal values are counted before they are shuffled. Ranks are
    located among bins of `bin_width` values first and inside the hit bins second, so one task sees
    at most `bin_width` distinct values, however many rows the key has.
    """
    keys = list(keys)
    counted = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    counted = counted.withColumn("_bin", F.expr(f"`{value}` div {bin_width}"))
    bins = counted.groupBy(*keys, "_bin").agg(
        F.sum("_n").alias("_bin_n"),
        F.sum(F.col(value).cast("decimal(28,0)") * F.col("_n")).alias("_bin_sum"),
        F.min(value).alias("_bin_min"),
        F.max(value).alias("_bin_max"),
    )
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = bins.select(
        *keys,
        "_bin",
        F.sum("_bin_n").over(upto).alias("_bin_end"),
        "_bin_n",
        F.sum("_bin_n").over(by_key).alias("_total"),
        F.sum("_bin_sum").over(by_key).alias("_sum"),
        F.min("_bin_min").over(by_key).alias("_min"),
        F.max("_bin_max").over(by_key).alias("_max"),
    )

    def low(p):
        return F.expr(f"((_total - 1) * {p}) div 100")

    def high(p):
        return F.expr(f"((_total - 1) * {p} + 99) div 100")

    wanted = F.array_distinct(F.array(*[f(p) for p in percents for f in (low, high)]))
    hits = F.filter(wanted, lambda r: (r >= F.col("_bin_end") - F.col("_bin_n")) & (r < F.col("_bin_end")))
    hit_bins = placed.withColumn("_ranks", hits).filter(F.size("_ranks") > 0)
    values = null_safe_join(counted.select(*keys, "_bin", value, "_n"), hit_bins, [*keys, "_bin"])
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_end", F.col("_bin_end") - F.col("_bin_n") + F.sum("_n").over(inside))
    covered = F.filter(
        "_ranks", lambda r: (r >= F.col("_end") - F.col("_n")) & (r < F.col("_end"))
    )
    picked = values.withColumn("_rank", F.explode(covered))
    aggregates = [
        F.max("_total").alias("n"),
        F.max("_sum").cast("bigint").alias("total"),
        F.max("_min").alias("smallest"),
        F.max("_max").alias("largest"),
    ]
    for p in percents:
        aggregates.append(F.max(F.when(F.col("_rank") == low(p), F.col(value))).alias(f"_low_{p}"))
        aggregates.append(F.max(F.when(F.col("_rank") == high(p), F.col(value))).alias(f"_high_{p}"))
    summary = picked.groupBy(*keys).agg(*aggregates)
    fractions = [
        (
            F.col(f"_low_{p}") * 100
            + (F.col(f"_high_{p}") - F.col(f"_low_{p}")) * (((F.col("n") - 1) * p) % 100)
        ).alias(f"p{p}_x100")
        for p in percents
    ]
    return summary.select(*keys, "n", "total", "smallest", "largest", *fractions)

