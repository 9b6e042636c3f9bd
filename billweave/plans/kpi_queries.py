"""Monthly billing KPIs and revenue in USD on the shared test tables."""

from datetime import date

from pyspark.sql import functions as F

from billweave.functions import dates
from billweave.functions.numbers import money, usd
from billweave.operators import kpi, revenue
from billweave.plans.sample import ORDERS_AS_OF, Sample

MONTH = ORDERS_AS_OF
LATE_JUNE = date(2000, 6, 20)


def _recent_invoices(spark, root):
    """Invoices of the month and the two before, filtered on the bare order date."""
    rows = Sample(spark, root).invoice()
    return rows.filter(dates.between_months(F.col("order_ts"), dates.months_before(MONTH, 2), MONTH))


def invoice_month_mart(spark, root):
    mart = kpi.invoice_months(Sample(spark, root).invoice())
    return mart.select(
        *[money(F.col(c)).alias(c) if c.startswith("balance") else F.col(c) for c in mart.columns]
    )


def invoice_count_kpi(spark, root):
    return kpi.invoice_count_kpi(kpi.invoice_months(_recent_invoices(spark, root)), MONTH)


def balance_by_region(spark, root):
    return kpi.balance_by_region(kpi.invoice_months(_recent_invoices(spark, root)), MONTH)


def health_pivot(spark, root):
    healthy = F.col("approved") & F.coalesce("is_email_sent", F.lit(False))
    mart = kpi.health_months(kpi.non_void(_recent_invoices(spark, root)), ["region"], "invoice_date", healthy)
    return kpi.health_pivot(mart, "Invoice Health", "invoice_date", MONTH)


def ledger_health_pivot(spark, root):
    postings = Sample(spark, root).ledger().withColumn("transaction_date", F.col("ship_ts"))
    entities = kpi.ledger_entities(postings, "company_id", dates.months_before(MONTH, 2), MONTH)
    mart = kpi.health_months(entities, [], "transaction_month", F.col("credit") >= F.col("debit"))
    return kpi.health_pivot(mart, "Ledger Health", "transaction_month", MONTH)


def invoice_counts_two_months(spark, root):
    return kpi.two_month_counts(_recent_invoices(spark, root), MONTH)


def release_status(spark, root):
    return kpi.release_by_region(_recent_invoices(spark, root), MONTH)


def _release_details(spark, root):
    sample = Sample(spark, root)
    invoices = _recent_invoices(spark, root).drop("currency_code", "partner_name", "company_name")
    return kpi.release_details(invoices, sample.currency(), sample.partner(), sample.company(), MONTH)


def release_details(spark, root):
    return _release_details(spark, root).withColumn("balance", money(F.col("balance")))


def release_crosstab(spark, root):
    return kpi.release_crosstab(_release_details(spark, root))


def balance_by_bu(spark, root):
    rows = kpi.balances(_recent_invoices(spark, root), MONTH)
    return rows.select(
        "id", "currency_code", "status", "is_email_sent", "approved", "business_unit_code",
        money(F.col("balance")).alias("balance"), money(F.col("balance_usd")).alias("balance_usd"),
    )


def balance_split(spark, root):
    return kpi.balance_split(kpi.balances(_recent_invoices(spark, root), MONTH))


def _credits(spark, root):
    sample = Sample(spark, root)
    rows = sample.ledger().filter(
        (F.col("type") == "SERVICE_CREDIT")
        & dates.between_months(F.col("ship_ts"), dates.months_before(MONTH, 2), MONTH)
    )
    amounts = rows.join(sample.accounts().select("company_id", "currency_code"), "company_id").join(
        sample.product().select(F.col("id").alias("product_id"), "vendor"), "product_id"
    )
    return amounts.select(
        "vendor",
        dates.month_of(F.col("transaction_date")).alias("transaction_month"),
        usd(F.col("credit"), F.col("currency_code")).alias("service_credit_usd"),
    )


def top5_vendor_credits(spark, root):
    mart = kpi.vendor_months(_credits(spark, root), "transaction_month", "service_credit_usd")
    return kpi.top_vendors(mart, "transaction_month", "service_credit_usd", MONTH)


def top5_manual_arrears(spark, root):
    sample = Sample(spark, root)
    lines = sample.owned_line().filter(
        (F.col("row_type") == "arrears")
        & dates.between_months(F.col("ship_ts"), dates.months_before(MONTH, 2), MONTH)
    )
    amounts = lines.join(sample.product().select(F.col("id").alias("product_id"), "vendor"), "product_id").select(
        "vendor",
        F.col("invoice_date").alias("provision_start_month"),
        usd(F.col("cost_total"), F.col("currency_code")).alias("manual_arrears_usd"),
    )
    mart = kpi.vendor_months(amounts, "provision_start_month", "manual_arrears_usd")
    return kpi.top_vendors(mart, "provision_start_month", "manual_arrears_usd", MONTH)


def _line_months(spark, root):
    recent = dates.between_months(F.col("ship_ts"), dates.months_before(MONTH, 6), MONTH)
    return kpi.line_months(Sample(spark, root).owned_line().filter(recent))


def invoice_line_details(spark, root):
    return kpi.line_details(_line_months(spark, root), MONTH)


def line_count_pivot(spark, root):
    return kpi.line_count_pivot(_line_months(spark, root), MONTH, ["Monthly", "Annual", "No Term"])


def month_list(spark, root):
    """Selectable months with their invoice counts; months without invoices count 0."""
    counts = Sample(spark, root).raw("orders").groupBy(dates.month_of(F.col("o_orderdate")).alias("month")).agg(
        F.count(F.lit(1)).alias("invoices")
    )
    calendar = dates.month_calendar(spark, date(1994, 6, 1), date(2002, 3, 1))
    return calendar.join(counts, "month", "left").fillna(0, ["invoices"])


def fx_line_detail(spark, root):
    sample = Sample(spark, root)
    since = F.add_months(F.lit(LATE_JUNE), -1)
    lines = sample.owned_line().filter(F.col("ship_ts") >= since).drop("segment", "region", "currency_id")
    rows = revenue.line_usd_details(
        lines, sample.partner(), sample.business_unit(), sample.product(), LATE_JUNE, open_end=True
    )
    return rows.select(
        "id", "invoice_id", "partner_id", "company_id", "row_type", "term", "currency_code", "business_unit",
        "vendor", "invoice_month",
        *[money(F.col(c)).alias(c) for c in ("total", "cost_total", "billing_fee", "usd_total", "usd_cost_total")],
        F.col("exchange_rate_multiple").cast("double").alias("exchange_rate_multiple"),
    )


def _line_totals(spark, root):
    sample = Sample(spark, root)
    recent = dates.between_months(F.col("ship_ts"), dates.months_before(MONTH, 1), MONTH)
    return revenue.line_usd_totals(
        sample.owned_line().filter(recent), sample.partner(), sample.business_unit(), sample.product(), MONTH
    )


def fx_line_aggregate(spark, root):
    return _line_totals(spark, root).select(
        "row_type_term", "month_name", "invoice_month", "business_unit", "vendor", "record_count",
        money(F.col("usd_total")).alias("usd_total"), money(F.col("usd_cost_total")).alias("usd_cost_total"),
    )


def row_type_month_pivot(spark, root):
    return revenue.row_type_pivot(_line_totals(spark, root), MONTH)


def _usage_inputs(spark, root, months):
    sample = Sample(spark, root)
    owners = sample.raw("orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("company_id")
    )
    accounts = sample.accounts().select("company_id", "partner_id", "currency_id")
    items = (
        sample.completed_line_item()
        .filter(F.col("provision_ts") >= F.lit(dates.months_before(MONTH, months)))
        .join(owners, "order_id")
        .join(accounts, "company_id")
        .drop("partner_id")
    )
    subscriptions = sample.subscription().join(accounts, "company_id")
    return sample, items, subscriptions


def usage_variance_6m(spark, root):
    sample, items, subscriptions = _usage_inputs(spark, root, 6)
    assignments = sample.product().filter("size <= 28").select(
        F.col("id").alias("product_id"), F.col("id").alias("arrears_product_usage_configuration_id")
    )
    configurations = sample.product().select("id", F.col("size").alias("billing_day_of_month"))
    rows = revenue.usage_variance(
        items, subscriptions, sample.partner(), sample.product(), sample.business_unit(), sample.currency(),
        assignments, configurations, MONTH, open_end=True,
    )
    amounts = [c for c in rows.columns if c.startswith("usd_")] + ["prior_vs_current_revenue_difference"]
    rates = ["percentage_change", "percentage_change_5_months", "avg_6_month_percentage_variance"]
    return rows.select(
        *[c for c in rows.columns if c not in amounts + rates + ["current_month_quantity"]],
        *[money(F.col(c)).alias(c) for c in amounts],
        *[F.round(c, 3).alias(c) for c in rates],
        F.col("current_month_quantity").cast("bigint").alias("current_month_quantity"),
    )


def arrears_variance(spark, root):
    sample, items, subscriptions = _usage_inputs(spark, root, 1)
    return revenue.arrears_variance(
        items, subscriptions, sample.partner(), sample.product(), sample.business_unit(), sample.currency(), MONTH, open_end=True
    )
