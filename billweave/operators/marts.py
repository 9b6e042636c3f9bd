"""Marts kept as tables: partial results per month that merge, of which only changed months are written again.

A mart's table is partitioned by month. New or corrected history rows touch some months; those are computed again from history, read with filters
on the bare date so that other months are skipped, and replace their folders. Reports merge the partials and never read history.
"""

from collections.abc import Callable, Sequence
from datetime import date, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.functions import dates
from billweave.operators.history import STATES

PERIOD = "period"


class PeriodMart:
    """A table of partial results by period: months ("MM") or weeks ("WEEK") of the column `day`.

    `build` makes the partials of history rows; it groups by the column `period` and whatever else the mart keeps.
    """

    def __init__(self, spark: SparkSession, path: str, day: str, build: Callable[[DataFrame], DataFrame], unit: str = "MM"):
        if unit not in ("MM", "WEEK"):
            raise ValueError(f"a period is a month (MM) or a week (WEEK), not {unit!r}")
        self.spark, self.path, self.day, self.build, self.unit = spark, path, day, build, unit

    def periods(self, rows: DataFrame) -> list[date]:
        """The periods that rows fall in: a value per month or week, however many rows there are."""
        found = rows.select(F.trunc(self.day, self.unit).alias(PERIOD)).filter(f"{PERIOD} IS NOT NULL").distinct()
        return sorted(r[0] for r in found.collect())

    def _within(self, start: date) -> Column:
        end = dates.months_before(start, -1) if self.unit == "MM" else start + timedelta(days=7)
        return (F.col(self.day) >= F.lit(start)) & (F.col(self.day) < F.lit(end))

    def refresh(self, history: DataFrame, periods: Sequence[date] | None = None) -> None:
        """Compute periods again from `history` and replace them; None means all that history has. Rows without day are in no period."""
        rows = history.filter(F.col(self.day).isNotNull())
        if periods is not None:
            if not periods:
                return
            rows = rows.filter(reduce(or_, map(self._within, periods)))
        built = self.build(rows.withColumn(PERIOD, F.trunc(self.day, self.unit)))
        built.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD).parquet(self.path)

    def table(self) -> DataFrame:
        """The partials; filters on the period skip the folders of others."""
        return self.spark.read.parquet(self.path)


def state_partials(task: Sequence[str], order: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """Builds a row per task and period from status changes (status_clean, run_on, error_message): what `merged_states` needs of them."""

    def build(changes: DataFrame) -> DataFrame:
        position, status = F.struct(*order), F.col("status_clean")
        failed = F.when(status == "error", position)
        return changes.groupBy(PERIOD, *task).agg(
            F.max(F.struct(*order, status)).alias("latest"),
            *[F.bool_or(status == s).alias(f"ever_{s}") for s in STATES],
            F.min("run_on").alias("first_run_on"),
            F.max(failed).alias("failed_at"),
            F.max_by(F.col("error_message"), failed).alias("last_error_message"),
        )

    return build


def merged_states(partials: DataFrame, task: Sequence[str]) -> DataFrame:
    """The task states of all periods together, as `history.task_states` gives them from all changes."""
    return partials.groupBy(*task).agg(
        F.max("latest").getField("status_clean").alias("current_status"),
        *[F.bool_or(f"ever_{s}").alias(f"ever_{s}") for s in STATES],
        dates.month_of(F.min("first_run_on")).alias("run_on_month"),
        F.max_by("last_error_message", "failed_at").alias("last_error_message"),
    )
