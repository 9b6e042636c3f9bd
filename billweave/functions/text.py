"""Display text as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_label(seconds: float) -> str:
    """A threshold in its largest whole unit, for alert messages."""
    for unit, size in (("hour", 3600), ("minute", 60)):
        if seconds >= size and seconds % size == 0:
            count = int(seconds // size)
            # an hour or less reads better in the smaller unit
            if unit == "hour" and count < 2:
                continue
            return f"{count} {unit}s"
    return f"{seconds:g} seconds"


def runtime_text(seconds: Column) -> Column:
    """30.5s, 2.0m or 1.5h, by size."""
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds))
        .when(seconds < 3600, F.format_string("%.1fm", seconds / 60))
        .otherwise(F.format_string("%.1fh", seconds / 3600))
    )


def eta_text(open_count: Column, hourly_count: Column) -> Column:
    """Time to finish the open tasks at the last hour's pace."""
    minutes = F.floor(F.try_divide(open_count.cast("bigint") * 60, hourly_count.cast("bigint"))).cast("bigint")
    hours = F.floor(minutes / 60).cast("bigint")
    rest = minutes % 60
    return (
        F.when(hourly_count <= 0, "N/A")
        .when(minutes == 0, "< 1 min")
        .when(hours == 0, F.concat(rest.cast("string"), F.lit(" min")))
        .when(rest == 0, F.concat(hours.cast("string"), F.lit(" hr")))
        .otherwise(F.concat(hours.cast("string"), F.lit(" hr "), rest.cast("string"), F.lit(" min")))
    )


def age_text(seconds: Column) -> Column:
    """How long ago, in the largest unit that is not zero; null seconds were never refreshed."""
    whole = F.floor(seconds).cast("bigint")
    unit = (
        F.when(whole >= 86400, F.concat(F.floor(whole / 86400).cast("string"), F.lit(" days ago")))
        .when(whole >= 3600, F.concat(F.floor(whole / 3600).cast("string"), F.lit(" hours ago")))
        .when(whole >= 60, F.concat(F.floor(whole / 60).cast("string"), F.lit(" minutes ago")))
        .otherwise(F.concat(whole.cast("string"), F.lit(" seconds ago")))
    )
    return F.when(whole.isNull(), "Never refreshed").otherwise(unit)


def ticket_text(message: Column, limit: int | None = None) -> Column:
    """An error message for a ticket table: trimmed, braces escaped, and with a limit clipped to it with dots."""
    trimmed = F.trim(message)
    clipped = trimmed if limit is None else F.when(
        F.length(trimmed) > limit, F.concat(F.substring(trimmed, 1, limit - 3), F.lit("..."))
    ).otherwise(trimmed)
    escaped = F.replace(F.replace(clipped, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    return F.when(clipped.contains("{") & clipped.contains("}"), escaped).otherwise(clipped)


def list_safe_message(message: Column, limit: int | None = None) -> Column:
    """A message without the column separator, and with a limit its first characters."""
    shown = message if limit is None else F.left(message, F.lit(limit))
    return F.replace(shown, F.lit("|"), F.lit("-"))
