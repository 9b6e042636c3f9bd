from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

import pytest

from billweave.operators import ordered
from tests.conftest import rows_of


def skewed(spark, n=3000):
    """Two of three rows have the same key; some keys are null."""
    key = F.when(F.col("id") % 3 != 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 5))
    return spark.range(n).select("id", key.alias("key"), (F.col("id") * 7919 % 1000).alias("v"))


def shaped(spark, shape, n=3000):
    """Tables whose order columns or keys are hard to cut into even ranges."""
    df = skewed(spark, n).withColumn("same", F.lit(1)).withColumn("far", F.when(F.col("id") == 5, 10**15).otherwise(F.col("id")))
    if shape == "one key":
        return df.withColumn("key", F.lit("all"))
    if shape == "no rows":
        return df.limit(0)
    return df.withColumn("key", F.lit(None).cast("string")) if shape == "null key" else df


SHAPES = ["skewed", "one key", "null key", "no rows"]
ORDERS = [["id"], ["far", "id"], ["same", "id"]]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("order", ORDERS, ids=["plain", "far-off value", "constant first"])
@pytest.mark.parametrize("ranges", [1, 16])
def test_numbered_equals_a_plain_window(spark, shape, order, ranges):
    df = shaped(spark, shape)
    got = ordered.numbered(df, ["key"], order, "rn", "n", ranges)
    by_key = Window.partitionBy("key")
    want = df.withColumn("rn", F.row_number().over(by_key.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(by_key))
    assert got.columns == want.columns
    assert rows_of(got, "id", "key", "rn", "n") == rows_of(want, "id", "key", "rn", "n")


@pytest.mark.parametrize("shape", ["one key", "null key"])
@pytest.mark.parametrize("order", ORDERS, ids=["plain", "far-off value", "constant first"])
def test_ranges_are_even(spark, shape, order):
    sizes = [r["count"] for r in ordered.in_ranges(shaped(spark, shape, 20_000), ["key"], order, 16).groupBy("_range").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16


def test_a_run_of_a_key_is_cut_in_ranges_that_follow_the_order(spark):
    placed = ordered.in_ranges(skewed(spark), ["key"], ["id"], 16)
    spans = placed.groupBy("key", "_range").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    following = F.lead("low").over(Window.partitionBy("key").orderBy("_range"))
    assert spans.withColumn("next", following).filter("next <= high").count() == 0
    assert placed.filter("_cut").select("_range", "key").distinct().count() <= 2 * 16


def test_numbered_without_keys_numbers_the_table(spark):
    got = ordered.numbered(skewed(spark), [], ["id"], "rn")
    assert rows_of(got, "id", "rn") == sorted([(i, i + 1) for i in range(3000)], key=repr)


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("ranges", [1, 16])
def test_lagged_and_carried_equal_plain_windows(spark, shape, ranges):
    df = shaped(spark, shape).withColumn("maybe", F.when(F.col("v") % 11 == 0, F.col("v")))
    order = Window.partitionBy("key").orderBy("id")
    got = ordered.lagged(df, ["key"], ["id"], {"v": "prev", "maybe": "prev_maybe"}, ranges)
    want = df.withColumn("prev", F.lag("v").over(order)).withColumn("prev_maybe", F.lag("maybe").over(order))
    assert rows_of(got, "id", "prev", "prev_maybe") == rows_of(want, "id", "prev", "prev_maybe")
    got = ordered.carried(df, ["key"], ["id"], "maybe", "last", ranges)
    want = df.withColumn(
        "last", F.last("maybe", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    assert rows_of(got, "id", "last") == rows_of(want, "id", "last")


def test_exact_percentiles_equal_the_built_in_ones(spark):
    df = skewed(spark).withColumn("v", F.col("v") * 137)
    got = ordered.exact_percentiles(df, ["key"], "v", [50, 95, 99], bin_width=512)
    want = df.groupBy("key").agg(
        F.count("v").alias("n"), F.sum("v").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.percentile("v", [0.5, 0.95, 0.99]).alias("p"),
    )
    left = {r["key"]: r for r in got.collect()}
    for r in want.collect():
        row = left.pop(r["key"])
        assert (row["n"], row["total"], row["smallest"], row["largest"]) == (r["n"], r["total"], r["lo"], r["hi"])
        for p, value in zip((50, 95, 99), r["p"]):
            assert abs(row[f"p{p}_x100"] / 100 - value) < 1e-6
    assert not left


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 20_000)), min_size=1, max_size=60))
def test_percentiles_of_any_small_table(spark, rows):
    df = spark.createDataFrame(rows, "key string, v bigint")
    got = {r["key"]: r for r in ordered.exact_percentiles(df, ["key"], "v", [50, 99], bin_width=256).collect()}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key)
        for p in (50, 99):
            low, rest = divmod((len(values) - 1) * p, 100)
            high = low + (rest > 0)
            assert got[key][f"p{p}_x100"] == values[low] * 100 + (values[high] - values[low]) * rest


def test_keep_first_keeps_one_whole_row_per_key(spark):
    df = skewed(spark)
    got = ordered.keep_first(df, ["key"], [F.col("v"), F.col("id")])
    order = Window.partitionBy("key").orderBy("v", "id")
    want = df.withColumn("rn", F.row_number().over(order)).filter("rn = 1")
    assert rows_of(got, "id", "key", "v") == rows_of(want, "id", "key", "v")


def test_the_plan_of_a_range_search_stays_small(spark):
    """A filter below the search, as a join on the range brings, must not repeat its steps."""
    df = spark.range(100).select("id", (F.col("id") % 7).alias("key"))
    placed = ordered.in_ranges(df, ["key"], ["id"], 200)
    cut = ordered.of_cut_keys(placed, ["key"], n=F.count(F.lit(1))).select("key", F.col("_range").alias("later"))
    reached = placed.join(cut.withColumnRenamed("key", "other"), (F.col("key") == F.col("other")) & (F.col("later") > F.col("_range")))
    assert len(reached._jdf.queryExecution().optimizedPlan().toString()) < 100_000
