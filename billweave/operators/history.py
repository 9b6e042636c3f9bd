"""Task status history: what a task ever was, what it is now, and month-over-month totals."""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billweave.functions import dates, labels
from billweave.functions.numbers import change_percent, percent

STATES = ["new", "error", "reviewed", "finished"]
COUNTS = [
    "tasks_total",
    "finished_tasks_total",
    "errored_tasks_total",
    "reviewed_tasks_total",
    "new_tasks_current",
    "errored_tasks_current",
    "reviewed_tasks_current",
    "finished_tasks_current",
    "errored_tasks_resolved",
    "errored_tasks_unresolved",
]


def task_states(changes: DataFrame, task: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per task from its status changes: ever in a status, current status, last error.

    `changes` has status_clean, run_on and error_message. Everything is an aggregate that combines
    before the shuffle, so a task with very many changes costs no more than one with few.
    """
    position = F.struct(*order)
    status = F.col("status_clean")
    ever = [F.bool_or(status == s).alias(f"ever_{s}") for s in STATES]
    failed = F.when(status == "error", position)
    return changes.groupBy(*task).agg(
        F.max_by(status, position).alias("current_status"),
        *ever,
        dates.month_of(F.min("run_on")).alias("run_on_month"),
        F.max_by(F.when(status == "error", F.col("error_message")), failed).alias("last_error_message"),
    )


def status_totals(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ever-counts, current counts and resolved errors per key; an error is resolved when it is not current."""
    now = F.col("current_status")
    counts = {
        "tasks_total": F.count(F.lit(1)),
        "finished_tasks_total": F.count_if("ever_finished"),
        "errored_tasks_total": F.count_if("ever_error"),
        "reviewed_tasks_total": F.count_if("ever_reviewed"),
        "new_tasks_current": F.count_if(now == "new"),
        "errored_tasks_current": F.count_if(now == "error"),
        "reviewed_tasks_current": F.count_if(now == "reviewed"),
        "finished_tasks_current": F.count_if(now == "finished"),
        "errored_tasks_resolved": F.count_if(F.col("ever_error") & (now != "error")),
        "errored_tasks_unresolved": F.count_if(F.col("ever_error") & (now == "error")),
    }
    totals = states.groupBy(*keys).agg(*[c.alias(name) for name, c in counts.items()])
    return totals.select(
        "*",
        (F.col("new_tasks_current") == 0).alias("is_data_collection_complete"),
        (F.col("new_tasks_current") + F.col("errored_tasks_current") == 0).alias("is_data_validation_complete"),
    )


def current_totals(tasks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Totals of tasks that carry one status each (no history)."""
    status = F.col("status")
    return tasks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks_total"),
        F.count_if(status == "finished").alias("finished_tasks_total"),
        F.count_if(status == "error").alias("errored_tasks_total"),
        F.count_if(status == "reviewed").alias("reviewed_tasks_total"),
        F.count_if(status == "new").alias("new_tasks_current"),
        F.count_if(status == "error").alias("errored_tasks_current"),
    )


def with_previous_month(monthly: DataFrame, month: date) -> DataFrame:
    """Rows of a month with the totals of the previous month that has any; none gives 0.

    The window runs over month totals: one row per month.
    """
    measures = {
        "tasks_total": "prev_tasks_total",
        "finished_tasks_total": "prev_finished_total",
        "errored_tasks_total": "prev_errored_total",
        "reviewed_tasks_total": "prev_reviewed_total",
    }
    totals = monthly.groupBy("run_on_month").agg(*[F.sum(m).alias(m) for m in measures])
    by_month = Window.orderBy("run_on_month")
    previous = totals.select(
        "run_on_month", *[F.coalesce(F.lag(m).over(by_month), F.lit(0)).alias(name) for m, name in measures.items()]
    )
    return monthly.filter(F.col("run_on_month") == F.lit(month)).join(previous, "run_on_month", "left")


def month_change(rows: DataFrame) -> DataFrame:
    """Month totals against the previous month's, in percent."""
    pairs = {"tasks": "tasks_total", "finished": "finished_tasks_total", "errored": "errored_tasks_total",
             "reviewed": "reviewed_tasks_total"}
    previous = {"tasks": "prev_tasks_total", "finished": "prev_finished_total", "errored": "prev_errored_total",
                "reviewed": "prev_reviewed_total"}
    totals = rows.groupBy("run_on_month").agg(
        *[F.sum(c).alias(f"{name}_total") for name, c in pairs.items()],
        *[F.max(c).alias(f"{name}_previous") for name, c in previous.items()],
    )
    changes = [
        change_percent(F.col(f"{name}_total"), F.col(f"{name}_previous")).alias(f"{name}_change_percent")
        for name in pairs
    ]
    return totals.select("*", *changes)


def breakdown(monthly: DataFrame, key: str, only: Column | None = None) -> DataFrame:
    """Counts and rates per key. Error rate 0/0 is null, resolution rate 0/0 is 0."""
    rows = monthly if only is None else monthly.filter(only)
    sums = rows.groupBy(key).agg(*[F.sum(c).alias(c) for c in COUNTS])
    errors, resolved = F.col("errored_tasks_total"), F.col("errored_tasks_resolved")
    return sums.select(
        "*",
        percent(errors, F.col("tasks_total")).alias("error_rate"),
        F.coalesce(percent(resolved, errors), F.lit(0.0)).alias("resolution_rate"),
    )


def top_by_current_errors(rows: DataFrame, key: str, top: int = 10) -> DataFrame:
    current = F.col("errored_tasks_current")
    return rows.filter(current > 0).orderBy(current.desc(), F.col("tasks_total").desc(), key).limit(top)


def needing_validation(monthly: DataFrame) -> DataFrame:
    """Vendors with new or failed tasks, their regions as sorted text."""
    new, failed = F.col("new_tasks_current"), F.col("errored_tasks_current")
    return (
        monthly.filter((new > 0) | (failed > 0))
        .groupBy("vendor")
        .agg(
            F.sum(new).alias("new_tasks"),
            F.sum(failed).alias("error_tasks"),
            F.sum(new + failed).alias("total_incomplete"),
            F.array_join(F.array_sort(F.collect_set("partner_region")), ", ").alias("regions"),
        )
    )


def completeness(monthly: DataFrame) -> DataFrame:
    """Whether collection and validation are complete in all rows."""
    return monthly.agg(
        F.bool_and("is_data_collection_complete").alias("data_collection_complete"),
        F.bool_and("is_data_validation_complete").alias("data_validation_complete"),
    )


def method_completeness(monthly: DataFrame, stages: dict[str, str]) -> DataFrame:
    """Per stage (methods whose name contains a text): complete when it has rows, none new and none failed."""
    flags = []
    for stage, needle in stages.items():
        hit = F.lower("method").contains(needle.lower())
        waiting = F.sum(F.when(hit, F.col("new_tasks_current") + F.col("errored_tasks_current")))
        flags.append(((F.count_if(hit) > 0) & (F.coalesce(waiting, F.lit(0)) == 0)).alias(f"{stage}_complete"))
    return monthly.agg(*flags)


def error_totals(monthly: DataFrame, month: date) -> DataFrame:
    rows = monthly.filter(F.col("run_on_month") == F.lit(month))
    return rows.agg(
        *[F.sum(c).alias(c) for c in ("errored_tasks_unresolved", "errored_tasks_resolved", "errored_tasks_total")]
    )


def error_categories(
    states: DataFrame, rules: Sequence[tuple[str, str]], default: str, keys: Sequence[str]
) -> DataFrame:
    """Errors per key and category of the task's last error message."""
    category = labels.first_match(F.col("last_error_message"), rules, default)
    failed = states.filter("ever_error").withColumn("error_category", category)
    resolved = F.col("current_status") != "error"
    return failed.groupBy(*keys, "error_category").agg(
        F.count(F.lit(1)).alias("errors_total"),
        F.count_if(resolved).alias("errors_resolved"),
        F.count_if(~resolved).alias("errors_unresolved"),
    )


def category_metrics(categories: DataFrame) -> DataFrame:
    sums = categories.groupBy("error_category").agg(
        *[F.sum(c).alias(c) for c in ("errors_total", "errors_resolved", "errors_unresolved")],
        F.count_distinct("vendor").alias("vendor_count"),
    )
    return sums.withColumn("resolution_rate", percent(F.col("errors_resolved"), F.col("errors_total")))


def category_vendors(categories: DataFrame, category: str) -> DataFrame:
    sums = (
        categories.filter(F.col("error_category") == category)
        .groupBy("vendor")
        .agg(*[F.sum(c).alias(c) for c in ("errors_total", "errors_resolved", "errors_unresolved")])
    )
    return sums.withColumn("resolution_rate", percent(F.col("errors_resolved"), F.col("errors_total")))


def frequent_errors(
    tasks: DataFrame, rules: Sequence[tuple[str, str]], default: str, day: str = "run_on", top: int = 100
) -> DataFrame:
    """The latest and most frequent errors per day, message and category: a top-k report."""
    category = labels.first_match(F.col("error_message"), rules, default)
    counts = (
        tasks.filter(F.col("error_message").isNotNull())
        .groupBy(F.col(day).alias("run_on"), "error_message", category.alias("error_category"), "status")
        .agg(F.count(F.lit(1)).alias("occurrence_count"))
    )
    order = [F.col("run_on").desc(), F.col("occurrence_count").desc(), F.col("error_message"), F.col("status")]
    return counts.orderBy(*order).limit(top)


def month_counts(tasks: DataFrame, month: date, keys: Sequence[str]) -> DataFrame:
    """Tasks of a month per key combination."""
    rows = tasks.filter(dates.in_month(F.col("run_on"), month))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("task_count"))


def status_pivot(counts: DataFrame, index: str, statuses: Sequence[str]) -> DataFrame:
    """Counts per index with one column per status, missing combinations 0."""
    columns = [F.sum(F.when(F.col("status") == s, F.col("task_count")).otherwise(0)).alias(s) for s in statuses]
    return counts.groupBy(index).agg(*columns)
