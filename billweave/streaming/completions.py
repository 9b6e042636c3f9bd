"""Task completions as a stream: the backlog's pace without polling the task tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_completions(tasks: DataFrame, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Finished tasks per task table and hour, for streaming or batch input.

    Updates later than `late` behind the newest one are ignored by a stream. With `slide`, windows of
    one hour start that often, so the latest closed window is the last hour.
    """
    hour = F.window("updated_dt", "1 hour", slide) if slide else F.window("updated_dt", "1 hour")
    finished = tasks.filter(F.col("status") == "finished")
    return (
        finished.withWatermark("updated_dt", late)
        .groupBy(hour.alias("_hour"), "task_table")
        .agg(F.count(F.lit(1)).alias("hourly_completed"))
        .select(
            F.col("_hour.start").alias("window_start"),
            F.col("_hour.end").alias("window_end"),
            F.col("task_table").alias("table_name"),
            "hourly_completed",
        )
    )


def write_completions(tasks: DataFrame, path: str, checkpoint: str, late: str = "10 minutes"):
    """Append closed hours to a Parquet folder; returns the running query.

    `checkpoint` must be on storage all executors share: it lets the stream resume where it stopped.
    """
    return (
        hourly_completions(tasks, late)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
