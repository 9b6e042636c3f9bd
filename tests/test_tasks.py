from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from billweave.functions import dates, labels, numbers, text
from billweave.operators import durations, history, tasks
from billweave.sources import tables
from tests.conftest import rows_of

ALERTS = """invoice_date string, task_table string, method string, total_runtime_hours double, max_runtime_sec long,
    total_tasks long, alert_24hr_exceeded boolean, alert_30min_task_exceeded boolean, alert_message string"""
PERFORMANCE = """invoice_date string, task_table string, method string, total_tasks long, total_runtime_hours double,
    avg_runtime_sec double, p95_runtime_sec double"""


class Memory:
    """Tables held in memory."""

    def __init__(self, frames):
        self.frames = frames

    def table(self, name):
        return self.frames[name]

    def exists(self, name):
        return name in self.frames


def test_alert_summary_golden_values(frame):
    df = frame(
        [
            ("2024-01-01", "billing_task", "createPartnerInvoice", 25.5, 1000, 100, True, False, "ALERT"),
            ("2024-01-02", "mca_task", "createCompanyInvoice", 5.0, 2000, 50, False, True, "WARNING"),
        ],
        ALERTS,
    )
    row = durations.alert_summary(df).first()
    assert (row["total_alerts"], row["critical_alerts"], row["warning_alerts"]) == (2, 1, 1)
    assert (row["max_runtime_hours"], row["affected_date_count"]) == (25.5, 2)
    assert rows_of(durations.affected_dates(df)) == [("2024-01-01",), ("2024-01-02",)]
    details = durations.sorted_alerts(durations.alert_details(df)).collect()
    assert [r["severity"] for r in details] == ["WARNING", "CRITICAL"]
    assert details[1]["message"] == "Total runtime 25.50h exceeds 24h threshold"
    assert details[0]["message"] == "Individual task 2000.00s exceeds 30min threshold"
    kinds = {k: durations.filter_alerts(df, k).count() for k in ("all", "any", "critical", "warning")}
    assert kinds == {"all": 2, "any": 2, "critical": 1, "warning": 1}
    with pytest.raises(ValueError):
        durations.filter_alerts(df, "other")


def test_empty_summaries(frame):
    row = durations.alert_summary(frame([], ALERTS)).first()
    assert (row["total_alerts"], row["max_runtime_hours"], row["latest_affected_date"]) == (0, 0.0, None)
    row = durations.performance_summary(frame([], PERFORMANCE)).first()
    assert (row["total_tasks"], row["total_runtime_hours"], row["slowest_task_table"], row["date_range_days"]) == (0, 0.0, "N/A", 0)


def test_performance_summary_golden_values(frame):
    df = frame(
        [
            ("2024-01-01", "billing_task", "a", 100, 10.0, 30.0, 120.0),
            ("2024-01-02", "mca_task", "b", 50, 6.0, 45.0, 180.0),
        ],
        PERFORMANCE,
    )
    assert tuple(durations.performance_summary(df).first()) == (150, 16.0, 35.0, 180.0, "billing_task", 2)


def test_runtime_text_golden_values(spark):
    values = spark.createDataFrame([(30.5,), (120.0,), (90.0,), (3600.0,), (5400.0,)], "s double")
    assert [r[0] for r in values.select(text.runtime_text(F.col("s"))).collect()] == ["30.5s", "2.0m", "1.5m", "1.0h", "1.5h"]


def test_default_range_is_thirty_days():
    start, end = dates.default_range(date(2024, 3, 1))
    assert (end - start).days == 30 and end == date(2024, 3, 1)


SHARD = "id long, method string, payload string, status string, created_dt timestamp, updated_dt timestamp, run_duration long"


def shards(frame):
    payload = '{"invoiceDate": {"value": "2024-05-01"}, "partnerId": "7"}'
    first = frame(
        [
            (1, "createPartnerInvoice", payload, "finished", "2024-05-01T00:00:00", "2024-05-01T10:00:00", 86_400_000),
            (2, "createPartnerInvoice", payload, "finished", "2024-05-01T01:00:00", "2024-05-01T12:00:00", 1),
            (3, "createPartnerInvoice", "not json", "finished", "2024-05-01T01:00:00", "2024-05-01T12:00:00", 5),
            (4, "createPartnerInvoice", payload, "error", "2024-05-01T01:00:00", "2024-05-01T12:00:00", 5),
            (5, "createPartnerInvoice", payload, "finished", "2024-05-01T01:00:00", "2024-05-01T12:00:00", None),
        ],
        SHARD,
    ).withColumn("guid", F.lit("g"))
    second = frame(
        [
            (1, "createCompanyInvoice", payload, "finished", "2024-05-01T01:00:00", "2024-05-01T12:00:00", 1_800_000),
            (2, "other", payload, "finished", "2024-05-01T01:00:00", "2024-05-01T12:00:00", 9_000_000),
        ],
        SHARD,
    )
    third = frame(
        [(1, "createCompanyInvoice", payload, "finished", "2024-05-01T01:00:00", "2024-05-01T12:00:00", 1_800_001)], SHARD
    ).withColumn("partner_id", F.lit(3))
    return Memory({"billing_task": first, "mca_task": second, "mca_task_2": third})


def test_durations_over_shards_with_default_thresholds(frame):
    rows = tables.invoice_tasks(shards(frame), ["billing_task", "mca_task", "mca_task_2"])
    result = {r["task_table"]: r for r in durations.task_durations(rows, date(2024, 5, 1), date(2024, 5, 1)).collect()}
    # more than 24 hours in total outranks the single long task; bad JSON, errors and null run times drop out
    top = result["billing_task"]
    assert top["total_tasks"] == 2 and top["alert_24hr_exceeded"] and top["alert_30min_task_exceeded"]
    assert top["alert_message"] == "ALERT: Total runtime exceeds 24 hours (24.00h)"
    # exactly at a threshold is no alert
    assert result["mca_task"]["alert_message"] is None and not result["mca_task"]["alert_30min_task_exceeded"]
    assert result["mca_task_2"]["alert_message"] == "WARNING: Individual task exceeds 30 minutes (1800.00s)"


def test_union_fills_missing_columns_and_adding_a_shard_never_lowers_counts(frame):
    source = shards(frame)
    both = tables.union_shards(source, ["billing_task", "mca_task_2"])
    assert rows_of(both.filter("guid is not null").select("task_table").distinct()) == [("billing_task",)]
    assert rows_of(both.filter("partner_id is not null").select("task_table")) == [("mca_task_2",)]
    one = tasks.method_counts(tables.union_shards(source, ["billing_task"]))
    more = {r[0]: r[1] for r in tasks.method_counts(both).collect()}
    assert all(more[r["method"]] >= r["task_count"] for r in one.collect())


def test_billing_and_arrears_scans(frame):
    billing = frame(
        [
            (1, "createPartnerInvoice", '{"partnerId": "7", "companyId": ""}', " Finished", "2024-05-02T00:00:00"),
            (2, "createPartnerInvoice", "{bad", "new", "2024-05-02T00:00:00"),
            (3, "createPartnerInvoice", "{}", "new", "2024-04-30T00:00:00"),
        ],
        "id long, method string, payload string, status string, run_on timestamp",
    )
    got = tables.billing_tasks(Memory({"billing_task": billing}), ["billing_task"], date(2024, 5, 20))
    assert rows_of(got, "id", "status_clean", "partner_id_parsed", "company_id_parsed") == [
        (1, "finished", "7", None), (2, "new", None, None),
    ]
    arrears = frame(
        [(1, 10, 5, "waiting", "createArrearsBillsForSubscription", "2024-05-02T00:00:00"),
         (2, 10, 5, "error", "createArrearsBillsForSubscription", "2024-05-02T00:00:00"),
         (3, 99, 5, "error", "createArrearsBillsForSubscription", "2024-05-02T00:00:00")],
        "id long, subscription_id long, product_id long, status string, method string, run_on timestamp",
    )
    source = Memory({
        "arrears_task": arrears, "arrears_task_2": arrears.limit(0),
        "subscription": frame([(10, 4)], "id long, original_subscription_id long"),
        "product": frame([(5, "P", "V")], "id long, name string, vendor string"),
    })
    got = tables.arrears_tasks(source, date(2024, 5, 1))
    assert rows_of(got, "id", "status_clean", "original_subscription_id", "vendor") == [(1, "new", 4, "V"), (2, "error", 4, "V")]


def test_overall_performance_uses_elapsed_time_not_hour_boundaries(frame):
    df = frame(
        [("a", date(2024, 5, 1).isoformat(), "finished", "2024-05-01T00:59:00", "2024-05-01T01:01:00", 1000),
         ("a", "2024-05-01", "new", "2024-05-01T01:00:00", None, None)],
        "method string, invoice_date date, status string, created_dt timestamp, updated_dt timestamp, run_duration long",
    )
    row = durations.overall_performance(df, date(2024, 5, 1), ["a"]).first()
    assert (row["total_runtime_hours"], row["completion_rate_percent"], row["avg_task_runtime_seconds"]) == (0.03, 50.0, 1.0)
    none = durations.overall_performance(df, date(2024, 5, 2), ["a"]).first()
    assert (none["total_tasks"], none["completion_rate_percent"]) == (0, None)


def test_status_table_total_counts_unlisted_statuses(frame):
    df = frame([("m", "new"), ("m", "strange"), ("n", "finished"), (None, "new")], "method string, status_clean string")
    assert rows_of(tasks.status_table(df, "method"), "method", "new", "finished", "total") == [("m", 1, 0, 2), ("n", 0, 1, 1)]


def test_backlog_lists_every_table_and_estimates_time(frame):
    df = frame(
        [(1, "billing_task", "a", "new", None), (2, "billing_task", None, "new", None),
         (3, "billing_task", "a", "finished", "2024-05-01T11:30:00"), (4, "mca_task", "a", "finished", "2024-05-01T09:00:00")],
        "id long, task_table string, method string, status string, updated_dt timestamp",
    )
    backlog = tasks.open_backlog(df, ["billing_task", "mca_task", "gone"], datetime(2024, 5, 1, 12), missing=["gone"])
    assert rows_of(tasks.backlog_summary(backlog)) == [
        ("billing_task", 2, "a (1); unknown (1)", 1, "2 hr"),
        ("gone", 0, "Table not found in database", 0, "N/A"),
        ("mca_task", 0, "No open tasks", 0, "N/A"),
    ]
    pairs = df.sparkSession.createDataFrame([(0, 5), (1, 100), (5, 10), (61, 60), (3, 1)], "o long, h long")
    assert [r[0] for r in pairs.select(text.eta_text(F.col("o"), F.col("h"))).collect()] == [
        "< 1 min", "< 1 min", "30 min", "1 hr 1 min", "3 hr",
    ]


def test_latest_finished_breaks_ties_by_id(frame):
    df = frame(
        [(1, "billing_task", None, "a", "finished", "2024-05-01T00:00:00"),
         (2, "billing_task", None, "b", "finished", "2024-05-01T00:00:00"),
         (3, "billing_task", "s", "c", "new", "2024-05-02T00:00:00")],
        "id long, task_table string, service string, method string, status string, updated_dt timestamp",
    )
    assert rows_of(tasks.latest_finished(df), "table_name", "task_type", "method", "task_runner") == [
        ("billing_task", "Billing", "b", "unknown")
    ]


def test_history_rates_and_previous_month(frame):
    monthly = frame(
        [("2024-03-01", "EU", "v", 4, 1), ("2024-05-01", "EU", "v", 10, 0), ("2024-05-01", "US", "v", 0, 0)],
        "run_on_month date, partner_region string, vendor string, tasks_total long, errored_tasks_total long",
    )
    for c in history.COUNTS:
        if c not in monthly.columns:
            monthly = monthly.withColumn(c, F.lit(0).cast("bigint"))
    # March is the previous month with totals, although April is missing
    lag = history.with_previous_month(monthly, date(2024, 5, 1))
    assert rows_of(lag, "partner_region", "prev_tasks_total") == [("EU", 4), ("US", 4)]
    first = history.with_previous_month(monthly, date(2024, 3, 1))
    assert rows_of(first, "prev_tasks_total") == [(0,)]
    rates = history.breakdown(monthly.filter("run_on_month = '2024-05-01'"), "partner_region")
    assert rows_of(rates, "partner_region", "error_rate", "resolution_rate") == [("EU", 0.0, 0.0), ("US", None, 0.0)]
    change = monthly.sparkSession.createDataFrame([(5, 0), (0, 0), (5, 4), (3, 4)], "c long, p long")
    got = [r[0] for r in change.select(numbers.change_percent(F.col("c"), F.col("p"))).collect()]
    assert got == [100.0, 0.0, 25.0, -25.0]


def test_task_states_separate_ever_from_now(frame):
    df = frame(
        [(1, 1, "error", "2024-01-01T00:00:00", "boom timeout"), (1, 2, "finished", "2024-01-02T00:00:00", None),
         (2, 3, "finished", "2024-01-01T00:00:00", None), (2, 4, "error", "2024-01-03T00:00:00", "x")],
        "task long, id long, status_clean string, run_on timestamp, error_message string",
    )
    states = history.task_states(df, ["task"], ["run_on", "id"]).withColumn("vendor", F.lit("v"))
    totals = history.status_totals(states, ["vendor"]).first()
    assert (totals["errored_tasks_total"], totals["errored_tasks_resolved"], totals["errored_tasks_unresolved"]) == (2, 1, 1)
    cats = history.error_categories(states, [("timeout", "Net"), ("boom", "Never")], "Other", ["vendor"])
    assert rows_of(cats) == [("v", "Net", 1, 1, 0), ("v", "Other", 1, 0, 1)]


def test_label_rules(frame):
    flags = frame(
        [(True, True), (False, True), (False, False), (True, False), (None, True), (None, False)], "sent boolean, ok boolean"
    )
    got = [r[0] for r in flags.select(labels.release_status(F.col("sent"), F.col("ok"))).collect()]
    assert got == ["Released", "Held - Approved", "Held - Needs Review"] + ["Unknown Status"] * 3
    owners = frame([(None, 1), (2, 1), (None, None)], "p long, c long")
    assert [r[0] for r in owners.select(labels.audience(F.col("p"), F.col("c"))).collect()] == [
        "Company Invoice", "Partner Invoice", "Unknown",
    ]
    status = frame([("waiting",), ("rap_running",), ("usage_running",), ("error",)], "s string")
    assert [r[0] for r in status.select(labels.arrears_status(F.col("s"))).collect()] == ["new", "new", "new", "error"]


def test_text_helpers(spark):
    one = spark.range(1)
    long = "x" * 600
    got = one.select(
        text.ticket_text(F.lit(f"  {long}"), 500).alias("clipped"), text.ticket_text(F.lit(" a {b} ")).alias("escaped"),
        text.ticket_text(F.lit("only {")).alias("kept"), text.list_safe_message(F.lit("a|b")).alias("safe"),
        text.age_text(F.lit(7300)).alias("age"), text.age_text(F.lit(None).cast("int")).alias("never"),
        numbers.money_text(F.lit(1234.5), F.lit("EUR")).alias("money"),
        numbers.money_text(F.lit(-1.0), F.lit("XXX")).alias("plain"),
    ).first()
    assert len(got["clipped"]) == 500 and got["clipped"].endswith("...")
    assert (got["escaped"], got["kept"], got["safe"]) == ("a \\{b\\}", "only {", "a-b")
    assert (got["age"], got["never"], got["money"], got["plain"]) == ("2 hours ago", "Never refreshed", "€1,234.50", "-1.00")
    assert (text.span_label(86400), text.span_label(1800), text.span_label(150)) == ("24 hours", "30 minutes", "150 seconds")


def test_rounded_ratio_is_exact(spark):
    df = spark.createDataFrame([(1005, 1000), (-1005, 1000), (1, 3), (5, 0)], "a long, b long")
    assert [r[0] for r in df.select(numbers.rounded_ratio(F.col("a"), F.col("b"))).collect()] == [1.01, -1.01, 0.33, None]


def test_tasks_after_as_of_do_not_count(spark):
    rows = [(k, "billing_task", "m", "finished", datetime(2024, 1, 1, 22 + k // 2, 30 * (k % 2))) for k in range(4)]
    done = spark.createDataFrame(rows, "id long, task_table string, method string, status string, updated_dt timestamp")
    backlog = tasks.open_backlog(done, ["billing_task"], datetime(2024, 1, 1, 23, 0))
    assert backlog.first()["hourly_completed"] == 3
    runs = done.withColumn("run_on", F.col("updated_dt") + F.expr("make_dt_interval(0, cast(id as int))"))
    assert rows_of(tasks.daily_counts(runs, date(2024, 1, 1)), "task_count") == [(2,)]


def test_backlog_with_an_open_end_counts_all_completions_since(spark):
    rows = [(k, "billing_task", "m", "finished", datetime(2024, 1, 1, 22 + k // 2, 30 * (k % 2))) for k in range(-1, 4)]
    done = spark.createDataFrame(rows, "id long, task_table string, method string, status string, updated_dt timestamp")
    backlog = tasks.open_backlog(done, ["billing_task"], datetime(2024, 1, 1, 23, 0), open_end=True)
    assert backlog.first()["hourly_completed"] == 4
