"""Writing extracts and numbered batch files."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.operators import ordered


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A CSV extract with a header, one file per task."""
    df.write.mode(mode).option("header", True).csv(path)


def assign_batches(df: DataFrame, order: Sequence[str | Column], batch_size: int = 1000, name: str = "batch") -> DataFrame:
    """Batch numbers from 1: rows 1..n in order are batch 1, the next n are batch 2, and so on."""
    size = max(1, batch_size)
    rows = ordered.numbered(df, [], order, number="_position")
    return rows.withColumn(name, F.expr(f"cast((_position - 1) div {size} + 1 as bigint)")).drop("_position")


def batch_file_name(base: str, batch: Column, day: str) -> Column:
    digits = batch.cast("string")
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)  # lpad alone cuts longer numbers
    return F.concat(F.lit(f"{base}_batch"), padded, F.lit(f"_{day}.csv"))


def write_batches(df: DataFrame, path: str, order: Sequence[str | Column], batch_size: int = 1000) -> None:
    """One folder per batch, one CSV file in each; batches are written in parallel."""
    batched = assign_batches(df, order, batch_size)
    (
        batched.repartition("batch")
        .sortWithinPartitions("batch", *order)
        .write.mode("errorifexists")
        .partitionBy("batch")
        .option("header", True)
        .csv(path)
    )


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "errorifexists") -> None:
    """Parquet partitioned by columns, such as (task_table, run_on_month) or (invoice_month).

    Month filters then skip whole folders. Rows are not shuffled: each task writes its own files.
    """
    df.write.mode(mode).partitionBy(*by).parquet(path)
