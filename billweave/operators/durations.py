"""Task run times: the duration report, its alerts and its summaries."""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billweave.constants import INVOICE_METHODS
from billweave.functions import dates, text
from billweave.functions.numbers import percent, rounded_ratio
from billweave.operators import ordered

GROUP = ["task_table", "invoice_date", "method"]
CRITICAL_SECONDS = 24 * 3600
WARNING_SECONDS = 30 * 60


def task_durations(
    tasks: DataFrame,
    start: date | None = None,
    end: date | None = None,
    methods: Sequence[str] = tuple(INVOICE_METHODS),
    critical_seconds: int = CRITICAL_SECONDS,
    warning_seconds: int = WARNING_SECONDS,
) -> DataFrame:
    """Run times per (task table, invoice date, method) of finished tasks, with two alert flags.

    Critical: the group's total run time exceeds `critical_seconds`. Warning: one task exceeds
    `warning_seconds`. The message names the critical one first. Percentiles are exact.
    """
    finished = tasks.filter(
        (F.col("status") == "finished")
        & F.col("method").isin(list(methods))
        & F.col("run_duration").isNotNull()
        & F.col("invoice_date").isNotNull()
        & dates.within(F.col("invoice_date"), start, end)
    ).select(*GROUP, "run_duration")
    stats = ordered.exact_percentiles(finished, GROUP, "run_duration", [50, 95, 99])
    total, largest, n = F.col("total"), F.col("largest"), F.col("n")
    is_critical = total > critical_seconds * 1000
    is_warning = largest > warning_seconds * 1000
    hours = rounded_ratio(total, 3_600_000)
    max_sec = rounded_ratio(largest, 1000)
    return stats.select(
        *GROUP,
        n.alias("total_tasks"),
        F.col("smallest").alias("min_runtime_ms"),
        largest.alias("max_runtime_ms"),
        rounded_ratio(total, n).alias("avg_runtime_ms"),
        total.alias("total_runtime_ms"),
        rounded_ratio(F.col("smallest"), 1000).alias("min_runtime_sec"),
        max_sec.alias("max_runtime_sec"),
        rounded_ratio(total, n * 1000).alias("avg_runtime_sec"),
        rounded_ratio(total, 1000).alias("total_runtime_sec"),
        rounded_ratio(total, 60_000).alias("total_runtime_min"),
        hours.alias("total_runtime_hours"),
        *[rounded_ratio(F.col(f"p{p}_x100"), 100_000).alias(f"p{p}_runtime_sec") for p in (50, 95, 99)],
        is_critical.alias("alert_24hr_exceeded"),
        is_warning.alias("alert_30min_task_exceeded"),
        F.when(
            is_critical,
            _message(f"ALERT: Total runtime exceeds {text.span_label(critical_seconds)}", hours, "h"),
        )
        .when(
            is_warning,
            _message(f"WARNING: Individual task exceeds {text.span_label(warning_seconds)}", max_sec, "s"),
        )
        .alias("alert_message"),
    )


def _message(label: str, number: Column, unit: str) -> Column:
    return F.concat(F.lit(f"{label} ("), _two_digits(number), F.lit(f"{unit})"))


def _two_digits(number: Column) -> Column:
    return number.cast("decimal(28,2)").cast("string")


def alert_details(
    durations: DataFrame, critical_seconds: int = CRITICAL_SECONDS, warning_seconds: int = WARNING_SECONDS
) -> DataFrame:
    """One row per alert; a group that is critical is not listed again as a warning."""
    critical = F.col("alert_24hr_exceeded")
    hours, longest = F.col("total_runtime_hours"), F.col("max_runtime_sec")
    hour_label = text.span_label(critical_seconds).replace(" hours", "h")
    task_label = text.span_label(warning_seconds).replace(" minutes", "min")
    return durations.filter(critical | F.col("alert_30min_task_exceeded")).select(
        F.when(critical, "CRITICAL").otherwise("WARNING").alias("severity"),
        F.col("invoice_date").alias("date"),
        F.col("task_table").alias("table"),
        "method",
        F.when(critical, hours).alias("runtime_hours"),
        F.when(~critical, longest).alias("max_runtime_sec"),
        "total_tasks",
        F.when(
            critical,
            F.concat(F.lit("Total runtime "), _two_digits(hours), F.lit(f"h exceeds {hour_label} threshold")),
        )
        .otherwise(
            F.concat(F.lit("Individual task "), _two_digits(longest), F.lit(f"s exceeds {task_label} threshold"))
        )
        .alias("message"),
    )


def sorted_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(
        F.col("date").desc_nulls_last(), F.col("severity").desc(), F.col("table"), F.col("method")
    )


def alert_summary(durations: DataFrame) -> DataFrame:
    """One row: alert counts, longest total run time and the span of affected dates."""
    critical = F.col("alert_24hr_exceeded")
    warning_only = F.col("alert_30min_task_exceeded") & ~critical
    affected = F.when(F.col("alert_message").isNotNull(), F.col("invoice_date"))
    return durations.agg(
        F.count_if(critical | warning_only).alias("total_alerts"),
        F.count_if(critical).alias("critical_alerts"),
        F.count_if(warning_only).alias("warning_alerts"),
        F.coalesce(F.max("total_runtime_hours"), F.lit(0.0)).alias("max_runtime_hours"),
        F.count_distinct(affected).alias("affected_date_count"),
        F.max(affected).alias("latest_affected_date"),
    )


def affected_dates(durations: DataFrame) -> DataFrame:
    return durations.filter(F.col("alert_message").isNotNull()).select("invoice_date").distinct()


def filter_alerts(durations: DataFrame, kind: str = "all") -> DataFrame:
    """`all`, `any` alert, `critical` ones, or `warning` ones that are not critical."""
    critical = F.col("alert_24hr_exceeded")
    conditions = {
        "all": F.lit(True),
        "any": F.col("alert_message").isNotNull(),
        "critical": critical,
        "warning": F.col("alert_30min_task_exceeded") & ~critical,
    }
    if kind not in conditions:
        raise ValueError(f"unknown alert filter {kind!r}, expected one of {sorted(conditions)}")
    return durations.filter(conditions[kind])


def performance_summary(durations: DataFrame) -> DataFrame:
    """One row: totals, task-weighted mean, highest p95, slowest table and days covered."""
    hours = F.col("total_runtime_hours").cast("decimal(18,2)")
    weighted = F.sum(F.col("avg_runtime_sec").cast("decimal(18,2)") * F.col("total_tasks"))
    tasks = F.sum("total_tasks")
    slowest = F.max_by(
        "task_table",
        F.struct("total_runtime_hours", F.col("invoice_date"), F.col("method"), F.col("task_table")),
    )
    return durations.agg(
        F.coalesce(tasks, F.lit(0)).alias("total_tasks"),
        F.coalesce(F.sum(hours).cast("double"), F.lit(0.0)).alias("total_runtime_hours"),
        F.coalesce(rounded_ratio(weighted * 100, tasks * 100), F.lit(0.0)).alias("avg_runtime_sec"),
        F.coalesce(F.max("p95_runtime_sec"), F.lit(0.0)).alias("p95_runtime_sec"),
        F.coalesce(slowest, F.lit("N/A")).alias("slowest_task_table"),
        F.coalesce(F.date_diff(F.max("invoice_date"), F.min("invoice_date")) + 1, F.lit(0)).alias(
            "date_range_days"
        ),
    )


def _hours() -> Column:
    return F.sum(F.col("total_runtime_hours").cast("decimal(18,2)"))


def _mean_of(column: str) -> Column:
    """Mean of the groups' values, unweighted, exact to two digits."""
    cents = F.sum((F.col(column).cast("decimal(18,2)") * 100).cast("bigint"))
    return rounded_ratio(cents, F.count(column) * 100)


def daily_trend(durations: DataFrame) -> DataFrame:
    """Run time and tasks per (invoice date, method); the mean is a mean of group means."""
    return durations.groupBy("invoice_date", "method").agg(
        _hours().cast("double").alias("total_runtime_hours"),
        F.sum("total_tasks").alias("total_tasks"),
        _mean_of("avg_runtime_sec").alias("avg_runtime_sec"),
    )


def method_comparison(durations: DataFrame) -> DataFrame:
    """Methods against each other, with throughput; no run time at all gives throughput 0."""
    centihours = (_hours() * 100).cast("bigint")
    return durations.groupBy("method").agg(
        F.sum("total_tasks").alias("total_tasks"),
        _hours().cast("double").alias("total_runtime_hours"),
        _mean_of("avg_runtime_sec").alias("avg_runtime_sec"),
        _mean_of("p95_runtime_sec").alias("p95_runtime_sec"),
        F.coalesce(rounded_ratio(F.sum("total_tasks") * 100, centihours), F.lit(0.0)).alias("tasks_per_hour"),
    )


def table_comparison(durations: DataFrame) -> DataFrame:
    """Task tables against each other; tasks per day divides by the days of the whole report."""
    per_table = durations.groupBy("task_table").agg(
        F.sum("total_tasks").alias("total_tasks"),
        _hours().cast("double").alias("total_runtime_hours"),
        _mean_of("avg_runtime_sec").alias("avg_runtime_sec"),
        F.collect_set("invoice_date").alias("_dates"),
    )
    # a row per table with its dates: a window over so few rows spares computing the report again
    days = F.size(F.array_distinct(F.flatten(F.collect_list("_dates").over(Window.partitionBy()))))
    return per_table.withColumn("avg_tasks_per_day", rounded_ratio(F.col("total_tasks"), days)).drop("_dates")


def overall_performance(tasks: DataFrame, invoice_date: date, methods: Sequence[str]) -> DataFrame:
    """One row for one invoice date: counts by status, queue and completion times, rates."""
    day = tasks.filter(F.col("method").isin(list(methods)) & (F.col("invoice_date") == F.lit(invoice_date)))
    finished = F.col("status") == "finished"
    last = F.max(F.when(finished, F.col("updated_dt")))
    first = F.min("created_dt")
    done = F.when(finished, F.col("run_duration"))
    return day.agg(
        F.count(F.lit(1)).alias("total_tasks"),
        F.count_if(finished).alias("completed_tasks"),
        F.count_if(F.col("status") == "new").alias("new_tasks"),
        F.count_if(F.col("status") == "error").alias("error_tasks"),
        first.alias("first_task_queued"),
        last.alias("last_task_completed"),
        rounded_ratio(dates.micros_between(first, last), dates.MICROS_PER_HOUR).alias("total_runtime_hours"),
        percent(F.count_if(finished), F.count(F.lit(1))).alias("completion_rate_percent"),
        rounded_ratio(F.sum(done), F.count(done) * 1000).alias("avg_task_runtime_seconds"),
    )


def task_distribution(tasks: DataFrame, invoice_date: date, methods: Sequence[str]) -> DataFrame:
    """Counts and completion per (task table, method) for one invoice date, from one scan."""
    day = tasks.filter(F.col("method").isin(list(methods)) & (F.col("invoice_date") == F.lit(invoice_date)))
    finished = F.col("status") == "finished"
    done = F.when(finished, F.col("run_duration"))
    return day.groupBy("task_table", "method").agg(
        F.count(F.lit(1)).alias("task_count"),
        F.count_if(finished).alias("completed_count"),
        F.count_if(F.col("status") == "new").alias("new_count"),
        F.count_if(F.col("status") == "error").alias("error_count"),
        percent(F.count_if(finished), F.count(F.lit(1))).alias("completion_rate"),
        rounded_ratio(F.sum(done), F.count(done) * 1000).alias("avg_runtime_seconds"),
    )


def available_dates(tasks: DataFrame, methods: Sequence[str] = tuple(INVOICE_METHODS), top: int = 20) -> DataFrame:
    """The latest (invoice date, method, table) combinations that have finished tasks."""
    return (
        tasks.filter(
            (F.col("status") == "finished")
            & F.col("method").isin(list(methods))
            & F.col("run_duration").isNotNull()
            & F.col("invoice_date").isNotNull()
        )
        .select("invoice_date", "method", F.col("task_table").alias("source_table"))
        .distinct()
        .orderBy(F.col("invoice_date").desc(), "method", "source_table")
        .limit(top)
    )
