"""Month arithmetic. "Now" is always the caller's `as_of`, never the clock."""

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000


def month_start(day: date) -> date:
    return day.replace(day=1)


def months_before(day: date, months: int) -> date:
    """First day of the month `months` before the month of `day` (negative goes forward)."""
    index = day.year * 12 + (day.month - 1) - months
    return date(index // 12, index % 12 + 1, 1)


def month_of(column: Column) -> Column:
    """First day of the month, as a date."""
    return F.trunc(column, "MM")


def in_month(column: Column, month: date) -> Column:
    """Whether a date or timestamp falls in a month, written on the bare column so that it is pushed down."""
    return between_months(column, month, month)


def between_months(column: Column, first: date, last: date) -> Column:
    """Whether a date or timestamp falls in the months first..last, both included."""
    return (column >= F.lit(month_start(first))) & (column < F.lit(months_before(last, -1)))


def from_month(column: Column, first: date, last: date | None = None) -> Column:
    """Whether a date or timestamp falls in the months from `first` on, up to `last` if it is given."""
    return column >= F.lit(month_start(first)) if last is None else between_months(column, first, last)


def within(column: Column, start: date | None, end: date | None) -> Column:
    """Whether a date falls in an inclusive range; a missing end is open."""
    condition = F.lit(True)
    if start is not None:
        condition = condition & (column >= F.lit(start))
    if end is not None:
        condition = condition & (column <= F.lit(end))
    return condition


def micros_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def month_name(column: Column) -> Column:
    return F.date_format(column, "MMMM yyyy")


def month_calendar(spark: SparkSession, first: date, last: date) -> DataFrame:
    """Every month from first to last: `month` and its short label."""
    months = F.sequence(F.lit(month_start(first)), F.lit(month_start(last)), F.expr("interval 1 month"))
    return (
        spark.range(1)
        .select(F.explode(months).alias("month"))
        .withColumn("label", F.date_format("month", "MMM yyyy"))
    )


def default_range(as_of: date, days: int = 30) -> tuple[date, date]:
    """The default reporting range: the last `days` days."""
    return date.fromordinal(as_of.toordinal() - days), as_of
