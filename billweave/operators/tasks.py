"""Task status tables, latest completions, open backlog and vendor digests."""

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.constants import BACKLOG_PLACEHOLDERS, METHOD_CATEGORIES, STATUS_ORDER, TASK_TYPES
from billweave.functions import dates, labels, text
from billweave.functions.numbers import money, percent, rounded_ratio

# Characters of a message that the task list and a ticket show; the functions themselves keep whole texts.
MESSAGE_LIMIT, TICKET_LIMIT = 300, 500


def with_category(tasks: DataFrame) -> DataFrame:
    """Label billing tasks with their category, so that one scan serves all categories."""
    category = F.lit(None).cast("string")
    for name, methods in METHOD_CATEGORIES.items():
        category = F.when(F.col("method").isin(methods), name).otherwise(category)
    return tasks.withColumn("category", category)


def status_table(
    tasks: DataFrame, index: str, status: str = "status_clean", statuses: Sequence[str] = tuple(STATUS_ORDER)
) -> DataFrame:
    """Tasks per index value and status, with a total over all rows, listed statuses or not.

    Conditional counts instead of a pivot: the columns are known, so one aggregate is enough.
    """
    counts = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    rows = tasks.filter(F.col(index).isNotNull() & F.col(status).isNotNull())
    return rows.groupBy(index).agg(*counts, F.count(F.lit(1)).alias("total"))


def status_share(
    tasks: DataFrame, status: str = "status_clean", statuses: Sequence[str] = tuple(STATUS_ORDER)
) -> DataFrame:
    """One row per listed status: count, share of all tasks; mean run time of finished tasks in seconds."""
    columns = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    done = F.when(F.col("status") == "finished", F.col("run_duration"))
    totals = tasks.agg(
        F.count(F.lit(1)).alias("_all"),
        rounded_ratio(F.sum(done), F.count(done)).alias("_mean"),
        *columns,
    )
    long = totals.unpivot(["_all", "_mean"], list(statuses), "status", "task_count")
    return long.select(
        "status",
        "task_count",
        F.coalesce(percent(F.col("task_count"), F.col("_all")), F.lit(0.0)).alias("share_percent"),
        F.when(F.col("status") == "finished", F.col("_mean")).alias("avg_run_duration"),
    )


def method_counts(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("method").agg(F.count(F.lit(1)).alias("task_count"))


def latest_finished(tasks: DataFrame, top: int = 20) -> DataFrame:
    """The last finished task of each task table; ties go to the higher id.

    An aggregate, not a window: only one candidate per table and task is shuffled.
    """
    position = F.struct("updated_dt", "id")
    row = F.struct("method", "updated_dt", F.coalesce("service", F.lit("unknown")).alias("task_runner"))
    latest = (
        tasks.filter(F.col("status") == "finished").groupBy("task_table").agg(F.max_by(row, position).alias("_row"))
    )
    kind = F.lit(None).cast("string")
    for table, name in TASK_TYPES.items():
        kind = F.when(F.col("task_table") == table, name).otherwise(kind)
    return (
        latest.select(F.col("task_table").alias("table_name"), kind.alias("task_type"), "_row.*")
        .orderBy(F.col("updated_dt").desc(), "table_name")
        .limit(top)
    )


def open_backlog(
    tasks: DataFrame, tables: Sequence[str], as_of: datetime, missing: Sequence[str] = (), open_end: bool = False
) -> DataFrame:
    """Open tasks per (table, method) and the table's completions in the hour before `as_of`, or from then on with no end.

    Every listed table appears: without open tasks it gets a zero row, and a table in `missing`
    (it does not exist) gets a placeholder row.
    """
    scope = tasks.filter(F.col("task_table").isin(list(tables)))
    recent = F.col("updated_dt") >= F.lit(as_of - timedelta(hours=1))
    if not open_end:
        recent = recent & (F.col("updated_dt") <= F.lit(as_of))
    counts = scope.groupBy("task_table", F.coalesce("method", F.lit("unknown")).alias("method")).agg(
        F.count_if(F.col("status") == "new").alias("open_count"),
        F.count_if((F.col("status") == "finished") & recent).alias("_hourly"),
    )
    # (table, method) counts are few: the rest works on them, not on the tasks
    hourly = counts.groupBy("task_table").agg(
        F.sum("_hourly").alias("hourly_completed"), F.sum("open_count").alias("_open")
    )
    spark = tasks.sparkSession
    listed = spark.createDataFrame([(t, t in set(missing)) for t in tables], "task_table string, _missing boolean")
    open_rows = counts.filter(F.col("open_count") > 0).select("task_table", "method", "open_count")
    placeholder = F.when(F.col("_missing"), "table_not_found").otherwise("no_data")
    return (
        listed.join(hourly, "task_table", "left")
        .join(open_rows, "task_table", "left")
        .select(
            F.col("task_table").alias("table_name"),
            F.coalesce("method", placeholder).alias("method"),
            F.coalesce("open_count", F.lit(0)).cast("bigint").alias("open_count"),
            F.coalesce("hourly_completed", F.lit(0)).cast("bigint").alias("hourly_completed"),
        )
    )


def backlog_summary(backlog: DataFrame) -> DataFrame:
    """One row per table: open total, methods as text, pace and time to finish."""
    special = F.lit(None).cast("string")
    for method, label in BACKLOG_PLACEHOLDERS.items():
        special = F.when(F.col("method") == method, label).otherwise(special)
    entry = F.when(
        (F.col("open_count") > 0) & special.isNull(),
        F.concat(F.col("method"), F.lit(" ("), F.col("open_count").cast("string"), F.lit(")")),
    )
    grouped = backlog.withColumn("_special", special).groupBy("table_name").agg(
        F.sum("open_count").alias("total_count"),
        F.max("hourly_completed").alias("hourly_completed"),
        F.array_join(F.array_sort(F.collect_list(entry)), "; ").alias("_methods"),
        F.max("_special").alias("_special"),
    )
    return grouped.select(
        "table_name",
        "total_count",
        F.coalesce("_special", F.nullif(F.col("_methods"), F.lit("")), F.lit("No open tasks")).alias(
            "method_breakdown"
        ),
        "hourly_completed",
        text.eta_text(F.col("total_count"), F.col("hourly_completed")).alias("eta"),
    )


def daily_counts(tasks: DataFrame, as_of: date, days: int = 60, methods: Sequence[str] | None = None) -> DataFrame:
    """Tasks per day and status in the last `days` days up to `as_of` (the day `days` before it is out)."""
    first, end = (date.fromordinal(as_of.toordinal() + k) for k in (1 - days, 1))
    rows = tasks.filter((F.col("run_on") >= F.lit(first)) & (F.col("run_on") < F.lit(end)))
    if methods is not None:
        rows = rows.filter(F.col("method").isin(list(methods)))
    return rows.groupBy(F.to_date("run_on").alias("running_day"), "status").agg(
        F.count(F.lit(1)).alias("task_count")
    )


def arrears_details(
    tasks: DataFrame,
    subscriptions: DataFrame,
    partners: DataFrame,
    products: DataFrame,
    business_units: DataFrame,
    run_on: date,
    vendor: str | None = None,
    methods: Sequence[str] | None = None,
) -> DataFrame:
    """Arrears tasks of one day with subscription, partner, product and region; missing dims stay null.

    A vendor is only known after the joins; the day and method filters are applied to the tasks first.
    """
    rows = tasks.filter((F.col("run_on") >= F.lit(run_on)) & (F.col("run_on") < F.lit(_next_day(run_on))))
    if methods is not None:
        rows = rows.filter(F.col("method").isin(list(methods)))
    subs = subscriptions.select(
        F.col("id").alias("_sub"), "original_subscription_id", F.col("partner_id").alias("_partner"),
        F.col("product_id").alias("_product"),
    )
    owners = partners.select(
        F.col("id").alias("_pid"), F.col("name").alias("_pname"), F.col("business_unit_guid").alias("_bu")
    )
    items = products.select(F.col("id").alias("_prod"), F.col("name").alias("product_info"), "vendor")
    units = business_units.select(F.col("uuid").alias("_uuid"), F.col("unique_code").alias("partner_region"))
    joined = (
        rows.join(subs, rows["subscription_id"] == F.col("_sub"), "left")
        .join(owners, F.col("_partner") == F.col("_pid"), "left")
        .join(items, F.col("_product") == F.col("_prod"), "left")
        .join(units, F.col("_bu") == F.col("_uuid"), "left")
    )
    if vendor is not None:
        joined = joined.filter(F.col("vendor") == vendor)
    return joined.select(
        text.list_safe_message(F.col("error_message"), MESSAGE_LIMIT).alias("error_message"),
        F.concat(F.col("_partner").cast("string"), F.lit(" - "), F.col("_pname")).alias("partner_info"),
        "product_info",
        "subscription_id",
        "original_subscription_id",
        "method",
        "status",
        "partner_region",
        "vendor",
        F.to_date("run_on").alias("run_on"),
    )


def _next_day(day: date) -> date:
    return date.fromordinal(day.toordinal() + 1)


def vendor_digest(details: DataFrame, statuses: Sequence[str] = ("error",)) -> DataFrame:
    """What a vendor ticket reports per (run date, method, vendor): rows, impacted partners, regions.

    `new_tasks` guards the ticket: it should wait while tasks of the group are still new.
    """
    hit = F.col("status").isin(list(statuses))
    return (
        details.groupBy("run_on", "method", "vendor")
        .agg(
            F.count_if(hit).alias("task_count"),
            F.count_distinct(F.when(hit, F.col("partner_info"))).alias("partners_impacted"),
            F.count_distinct(F.when(hit, F.col("subscription_id"))).alias("subscriptions_impacted"),
            F.array_join(F.array_sort(F.collect_set(F.when(hit, F.col("partner_region")))), ", ").alias("regions"),
            F.count_if(F.col("status") == "new").alias("new_tasks"),
        )
        .filter(F.col("task_count") > 0)
        .withColumn("ready", F.col("new_tasks") == 0)
        .withColumn(
            "summary",
            F.concat(F.lit("Arrears Error - "), F.col("vendor"), F.lit(" - "), F.col("run_on").cast("string")),
        )
    )


def ticket_rows(details: DataFrame, statuses: Sequence[str] = ("error",)) -> DataFrame:
    """The per-task rows of a vendor ticket, with messages fit for a ticket table."""
    return details.filter(F.col("status").isin(list(statuses))).withColumn(
        "error_message", text.ticket_text(F.col("error_message"), TICKET_LIMIT)
    )


def vendor_status(tasks: DataFrame, usage: DataFrame) -> DataFrame:
    """Task statuses, distinct subscriptions and usage change per vendor; a vendor without usage gets zeros.

    `usage` has one row per subscription with `usd_current` and `usd_prior`.
    """
    statuses = status_table(tasks, "vendor")
    subscriptions = tasks.groupBy("vendor").agg(F.count_distinct("subscription_id").alias("subscriptions"))
    revenue = usage.groupBy("vendor").agg(
        F.round(F.sum("usd_current"), 2).alias("_current"), F.round(F.sum("usd_prior"), 2).alias("_prior")
    )
    zero = F.lit(0).cast("decimal(18,2)")
    current, prior = F.coalesce("_current", zero), F.coalesce("_prior", zero)
    change = F.when(prior != 0, (current - prior).cast("double") / prior.cast("double") * 100)
    return (
        statuses.join(subscriptions, "vendor", "left")
        .join(revenue, "vendor", "left")
        .select(
            *statuses.columns,
            "subscriptions",
            money(current).alias("current_month_usd"),
            money(prior).alias("prior_month_usd"),
            F.coalesce(F.round(change, 4), F.lit(0.0)).alias("revenue_change_percent"),
            money(current - prior).alias("revenue_difference_usd"),
        )
    )


def subscription_tasks(tasks: DataFrame, subscriptions: DataFrame, companies: DataFrame) -> DataFrame:
    """Arrears tasks of every subscription, with company text and the table they came from."""
    subs = subscriptions.select(F.col("id").alias("subscription_id"), "original_subscription_id", "company_id")
    names = companies.select(F.col("id").alias("company_id"), F.col("name").alias("_name"))
    return (
        tasks.join(subs, "subscription_id")
        .join(names, "company_id")
        .select(
            "subscription_id",
            "original_subscription_id",
            F.concat(F.col("company_id").cast("string"), F.lit(" "), F.col("_name")).alias("company_info"),
            "run_on",
            "method",
            "service",
            labels.arrears_status(F.col("status")).alias("status"),
            "error_message",
            F.split_part(F.col("source_relation"), F.lit("."), F.lit(3)).alias("table_source"),
        )
    )


def configurations_by_day(configurations: DataFrame, days: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """Usage configurations grouped by billing day of month."""
    return configurations.filter(F.col("billing_day_of_month").isin(list(days))).select(
        "billing_day_of_month", F.trim("name").alias("name"), "task_runner"
    )
