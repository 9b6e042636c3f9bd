"""Task telemetry and duration alerting on the shared test tables."""

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.constants import DURATION_TABLES
from billweave.functions import dates, labels, text
from billweave.operators import durations, history, marts, tasks
from billweave.plans.sample import (
    CRITICAL_SECONDS,
    ERROR_RULES,
    EVENT_METHODS,
    EVENTS_AS_OF,
    EVENTS_DAY,
    WARNING_SECONDS,
    Sample,
    dec,
)
from billweave.sources import tables
from billweave.sources.scratch import scratch_folder

JANUARY = (date(2024, 1, 1), date(2024, 1, 31))
REVIEW_DAY = date(2024, 1, 15)


def _tasks_between(spark: SparkSession, root: str, first: date, last: date) -> DataFrame:
    """Tasks of a date range, filtered on the bare timestamp so that the scan skips the rest."""
    after = date.fromordinal(last.toordinal() + 1)
    rows = Sample(spark, root).tasks()
    return rows.filter((F.col("run_on") >= F.lit(first)) & (F.col("run_on") < F.lit(after)))


def _durations(spark: SparkSession, root: str) -> DataFrame:
    return durations.task_durations(
        _tasks_between(spark, root, *JANUARY), *JANUARY, EVENT_METHODS, CRITICAL_SECONDS, WARNING_SECONDS
    )


def task_duration_alerts(spark, root):
    return _durations(spark, root)


def alert_details(spark, root):
    return durations.alert_details(_durations(spark, root), CRITICAL_SECONDS, WARNING_SECONDS)


def latest_alerts(spark, root):
    """The first 25 alerts of the sorted list."""
    alerts = durations.alert_details(_durations(spark, root), CRITICAL_SECONDS, WARNING_SECONDS)
    return durations.sorted_alerts(alerts).limit(25).select("date", "severity", "table", "method")


def tasks_by_parameters(spark, root):
    """Tasks per shard by SQL with named parameters, over a table of the catalog under a checked schema name."""
    Sample(spark, root).tasks().createOrReplaceGlobalTempView("billweave_tasks")
    name = tables.schema_prefix(spark.conf.get("spark.sql.globalTempDatabase", "global_temp")) + "billweave_tasks"
    statement = f"SELECT task_table, count(*) AS task_count FROM {name} WHERE method = :method AND run_on >= :since GROUP BY task_table"
    return tables.run_sql(spark, statement, method="view", since=REVIEW_DAY)


def alert_summary(spark, root):
    return durations.alert_summary(_durations(spark, root))


def warning_only_groups(spark, root):
    kept = durations.filter_alerts(_durations(spark, root), "warning")
    return kept.select(*durations.GROUP, "max_runtime_sec", "alert_message").withColumn(
        "max_runtime_text", text.runtime_text(F.col("max_runtime_sec"))
    )


def performance_summary(spark, root):
    return durations.performance_summary(_durations(spark, root))


def overall_performance(spark, root):
    return durations.overall_performance(_tasks_between(spark, root, REVIEW_DAY, REVIEW_DAY), REVIEW_DAY, EVENT_METHODS)


def task_distribution(spark, root):
    return durations.task_distribution(_tasks_between(spark, root, REVIEW_DAY, REVIEW_DAY), REVIEW_DAY, EVENT_METHODS)


def duration_trends(spark, root):
    return durations.daily_trend(_durations(spark, root))


def method_comparison(spark, root):
    return durations.method_comparison(_durations(spark, root))


def table_comparison(spark, root):
    return durations.table_comparison(_durations(spark, root))


def available_dates(spark, root):
    return durations.available_dates(Sample(spark, root).tasks(), EVENT_METHODS)


def status_table(spark, root):
    rows = Sample(spark, root).tasks().withColumn("status_clean", labels.arrears_status(F.col("raw_status")))
    return tasks.status_table(rows, "method")


def status_share(spark, root):
    rows = Sample(spark, root).tasks().withColumn("status_clean", labels.clean_status(F.col("status")))
    return tasks.status_share(rows)


def method_counts(spark, root):
    return tasks.method_counts(Sample(spark, root).tasks())


def latest_finished(spark, root):
    return tasks.latest_finished(Sample(spark, root).tasks())


def _backlog(spark, root, open_end=False):
    listed = [*DURATION_TABLES, "widget_task"]
    return tasks.open_backlog(Sample(spark, root).tasks(), listed, EVENTS_AS_OF, missing=["widget_task"], open_end=open_end)


def open_backlog(spark, root):
    return _backlog(spark, root)


def open_backlog_eta(spark, root):
    return tasks.backlog_summary(_backlog(spark, root, open_end=True))


def data_freshness(spark, root):
    return tables.table_freshness({"cc": Sample(spark, root).task_shards()}, DURATION_TABLES)


def sharded_invoice_tasks(spark, root):
    """Tasks of all shards with the invoice date of their payload."""
    rows = tables.invoice_tasks(Sample(spark, root).task_shards(), DURATION_TABLES)
    return rows.select("id", "task_table", "service", "method", "invoice_date", "partner_id", "error_message", "guid", "run_duration")


def sharded_billing_tasks(spark, root):
    """Billing tasks of the month up to the review day, with parsed payloads."""
    shards = Sample(spark, root).task_shards()
    rows = tables.billing_tasks(shards, DURATION_TABLES, EVENTS_DAY, ["view", "error", "signup"], until=REVIEW_DAY)
    return rows.select("id", "task_table", "method", "status_clean", "partner_id_parsed", "company_id_parsed", "run_on_month")


def sharded_arrears_tasks(spark, root):
    """Arrears tasks of the month up to the review day, with their subscription and product."""
    rows = tables.arrears_tasks(Sample(spark, root).task_shards(), EVENTS_DAY, until=REVIEW_DAY)
    return rows.select(
        "id", "task_table", "status_clean", "subscription_id", "original_subscription_id", "product_id", "product_name", "vendor",
        "error_message",
    )


def sharded_backlog(spark, root):
    """Open tasks of the shards that exist; one that does not gets a placeholder."""
    shards = Sample(spark, root).task_shards()
    found, missing = tables.existing(shards, [*DURATION_TABLES, "widget_task"])
    rows = tables.union_shards(shards, found).withColumn("status", labels.arrears_status(labels.clean_status(F.col("status"))))
    return tasks.open_backlog(rows, [*found, *missing], EVENTS_AS_OF, missing)


def daily_task_counts(spark, root):
    return tasks.daily_counts(Sample(spark, root).tasks(), EVENTS_DAY, 20, ["view", "click", "error"])


def _histories(spark, root):
    """Each (user, product) pair is one task whose events are its status changes."""
    sample = Sample(spark, root)
    reviewed = F.when(F.col("method") == "click", "reviewed").otherwise(F.col("status"))
    changes = sample.tasks().withColumn("status_clean", reviewed)
    owners = sample.accounts().select(F.col("company_id").alias("subscription_id"), F.col("region").alias("partner_region"))
    products = sample.product().select(F.col("id").alias("product_id"), "vendor")
    states = history.task_states(changes, ["subscription_id", "product_id"], ["updated_dt", "id"])
    return states.join(owners, "subscription_id").join(products, "product_id")


def task_states(spark, root):
    return _histories(spark, root).select(
        "subscription_id", "product_id", "partner_region", "vendor", "run_on_month", "current_status",
        "ever_error", "ever_finished", "ever_reviewed", "last_error_message",
    )


def region_breakdown(spark, root):
    monthly = history.status_totals(_histories(spark, root), ["run_on_month", "partner_region", "vendor"])
    return history.breakdown(monthly, "partner_region")


def vendor_breakdown(spark, root):
    monthly = history.status_totals(_histories(spark, root), ["run_on_month", "partner_region", "vendor"])
    return history.breakdown(monthly, "vendor")


def top_error_vendors(spark, root):
    monthly = history.status_totals(_histories(spark, root), ["run_on_month", "partner_region", "vendor"])
    return history.top_by_current_errors(history.breakdown(monthly, "vendor"), "vendor")


def vendors_needing_validation(spark, root):
    monthly = history.status_totals(_histories(spark, root), ["run_on_month", "partner_region", "vendor"])
    return history.needing_validation(monthly)


def error_totals(spark, root):
    monthly = history.status_totals(_histories(spark, root), ["run_on_month", "partner_region", "vendor"])
    return history.error_totals(monthly, date(2024, 1, 1))


def completeness(spark, root):
    monthly = history.status_totals(_histories(spark, root), ["run_on_month", "partner_region", "vendor"])
    return history.completeness(monthly)


def _categorised(spark, root):
    return history.error_categories(
        _histories(spark, root), ERROR_RULES, "Other", ["run_on_month", "vendor"]
    )


def error_categories(spark, root):
    return _categorised(spark, root)


def error_category_metrics(spark, root):
    return history.category_metrics(_categorised(spark, root))


def category_vendors(spark, root):
    return history.category_vendors(_categorised(spark, root), "Pricing")


def arrears_error_top100(spark, root):
    rows = Sample(spark, root).tasks().withColumn("day", F.to_date("run_on"))
    return history.frequent_errors(rows, ERROR_RULES, "Other", day="day", top=100)


def monthly_method_status(spark, root):
    """Billing tasks of a month by method and status: one invoice is one billing task."""
    return history.month_counts(_billing(spark, root), date(2000, 6, 1), ["method", "status"])


def monthly_run_status(spark, root):
    rows = _billing(spark, root).withColumn("run_day", F.to_date("run_on"))
    return history.month_counts(rows, date(2000, 6, 1), ["run_day", "status"])


def method_status_pivot(spark, root):
    counts = history.month_counts(_billing(spark, root), date(2000, 6, 1), ["method", "status"])
    return history.status_pivot(counts, "method", ["new", "error", "finished"])


def _billing(spark, root):
    invoices = Sample(spark, root).invoice()
    status = (
        F.when(F.col("status") == "Paid", "finished").when(F.col("status") == "Unpaid", "new").otherwise("error")
    )
    return invoices.select(
        F.col("id"),
        F.concat(F.lit("create-"), F.lower("priority")).alias("method"),
        status.alias("status"),
        F.col("order_ts").alias("run_on"),
        F.col("invoice_date").alias("run_on_month"),
        F.col("region").alias("partner_region"),
    )


def _monthly(spark, root):
    """Month totals from a mart of months: history is read once, the totals as often as needed."""

    def totals(rows):
        return history.current_totals(rows, [marts.PERIOD, "partner_region", "method"])

    mart = marts.PeriodMart(spark, scratch_folder(spark), "run_on", totals)
    mart.refresh(_billing(spark, root))
    return mart.table().withColumnRenamed(marts.PERIOD, "run_on_month")


def merged_task_states(spark, root):
    """Task states from weekly partials; the last two weeks come in by a refresh of theirs alone."""
    reviewed = F.when(F.col("method") == "click", "reviewed").otherwise(F.col("status"))
    changes = Sample(spark, root).tasks().withColumn("status_clean", reviewed)
    task = ["subscription_id", "product_id"]
    mart = marts.PeriodMart(spark, scratch_folder(spark), "run_on", marts.state_partials(task, ["updated_dt", "id"]), "WEEK")
    mart.refresh(changes.filter(F.col("run_on") < F.lit(REVIEW_DAY)))
    late = changes.filter(F.col("run_on") >= F.lit(REVIEW_DAY))
    mart.refresh(changes, mart.periods(late))
    return marts.merged_states(mart.table(), task).select(
        *task, "run_on_month", "current_status", "ever_error", "ever_finished", "ever_reviewed", "last_error_message"
    )


def task_status_lag(spark, root):
    return history.with_previous_month(_monthly(spark, root), date(2000, 6, 1))


def task_status_change(spark, root):
    return history.month_change(history.with_previous_month(_monthly(spark, root), date(2000, 6, 1)))


def method_completeness(spark, root):
    monthly = _monthly(spark, root)
    return history.method_completeness(monthly, {"medium": "MEDIUM", "urgent": "urgent", "absent": "Tax"})


def _arrears_details(spark, root, **filters):
    sample = Sample(spark, root)
    subscriptions = sample.company().select(
        F.col("id"), F.col("id").alias("original_subscription_id"), "partner_id", F.col("id").alias("product_id")
    )
    return tasks.arrears_details(
        sample.tasks(), subscriptions, sample.partner(), sample.product(), sample.business_unit(),
        REVIEW_DAY, **filters,
    )


def arrears_task_details(spark, root):
    return _arrears_details(spark, root, vendor="Brand#4", methods=["error", "signup", "view"])


def vendor_digest(spark, root):
    return tasks.vendor_digest(_arrears_details(spark, root))


def ticket_rows(spark, root):
    return tasks.ticket_rows(_arrears_details(spark, root))


def vendor_usage_status(spark, root):
    sample = Sample(spark, root)
    vendors = sample.product().select(F.col("id").alias("product_id"), "vendor")
    rows = sample.tasks().withColumnRenamed("status", "status_clean").join(vendors, "product_id")
    lines = sample.line().filter(dates.between_months(F.col("ship_ts"), date(2000, 5, 1), date(2000, 6, 1)))
    amount = F.col("total").cast("decimal(18,2)")
    # amounts by product first: the vendor join then runs on products, not on lines
    usage = (
        lines.groupBy("product_id")
        .agg(
            F.sum(F.when(F.col("invoice_date") == F.lit(date(2000, 6, 1)), amount)).alias("usd_current"),
            F.sum(F.when(F.col("invoice_date") == F.lit(date(2000, 5, 1)), amount)).alias("usd_prior"),
        )
        .join(vendors, "product_id")
    )
    return tasks.vendor_status(rows, usage)


def subscription_arrears_tasks(spark, root):
    sample = Sample(spark, root)
    rows = sample.tasks().withColumn("status", F.col("raw_status")).withColumn(
        "source_relation", F.concat(F.lit("warehouse.cc."), F.col("task_table"))
    )
    subscriptions = sample.company().select(
        "id", F.col("id").alias("original_subscription_id"), F.col("id").alias("company_id")
    )
    return tasks.subscription_tasks(rows, subscriptions, sample.company())


def billing_day_groups(spark, root):
    configurations = Sample(spark, root).product().select(
        F.concat(F.lit(" "), F.col("name"), F.lit(" ")).alias("name"),
        F.concat(F.lit("runner-"), F.col("vendor")).alias("task_runner"),
        F.col("size").alias("billing_day_of_month"),
    )
    return tasks.configurations_by_day(configurations)


def category_share(spark, root):
    """Task categories as one labelled scan."""
    names = {"purchase": "createPartnerInvoice", "view": "sendInvoiceForPartner"}
    method = F.col("method")
    for event, billing in names.items():
        method = F.when(F.col("method") == event, billing).otherwise(method)
    rows = tasks.with_category(Sample(spark, root).tasks().withColumn("method", method))
    return rows.groupBy("category", "status").agg(F.count(F.lit(1)).alias("task_count"))
