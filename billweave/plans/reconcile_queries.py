"""Invoice reconciliation on the shared test tables."""

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.functions import dates
from billweave.functions.numbers import money
from billweave.operators import reconcile, reconciliation
from billweave.plans.sample import ORDERS_AS_OF, Sample

MONTH = ORDERS_AS_OF
VERSION = ["product_id", "supplier_id", "total", "quantity"]


def _month_inputs(spark, root):
    """Costs and invoices of the month, filtered on the bare dates."""
    sample = Sample(spark, root)
    in_month = dates.in_month(F.col("ship_ts"), MONTH)
    invoices = sample.invoice().filter(dates.in_month(F.col("order_ts"), MONTH))
    return sample, sample.open_rows().filter(in_month), sample.ledger().filter(in_month), invoices


def missing_partner_invoices(spark, root):
    sample, rows, postings, invoices = _month_inputs(spark, root)
    result = reconcile.missing_partner_invoices(
        sample.partner_accounts(),
        rows.withColumnRenamed("company_id", "partner_id"),
        postings.withColumnRenamed("company_id", "partner_id"),
        invoices.withColumn("partner_id", F.col("owner_company_id")),
        MONTH,
    )
    return result.withColumn("cost", money(F.col("cost"), 4))


def missing_company_invoices(spark, root):
    sample, rows, postings, invoices = _month_inputs(spark, root)
    result = reconcile.missing_company_invoices(
        sample.company(), sample.partner(), rows, postings, invoices, MONTH
    )
    return result.withColumn("cost", money(F.col("cost"), 4))


def billable_items(spark, root):
    sample = Sample(spark, root)
    return reconcile.billable_items(sample.subscription(), sample.completed_line_item(), MONTH, VERSION)


def item_flags(spark, root):
    sample = Sample(spark, root)
    in_month = sample.line().filter(dates.in_month(F.col("ship_ts"), MONTH))
    transactions = in_month.filter(F.col("return_flag") != "R").select(
        F.concat(F.lit("G-"), F.col("completed_line_item_id").cast("string")).alias("completed_line_item_id"),
        "start_period",
    )
    lines = in_month.withColumnRenamed("id", "line_item_id")
    rows = reconcile.item_flags(
        sample.subscription(), sample.completed_line_item(), transactions, lines, MONTH, VERSION,
        url_base="https://billing.example/subscriptions/",
    )
    return rows.withColumn("invoice_row_total", money(F.col("invoice_row_total")))


def _owned_by_company(spark, root):
    """Anniversary lines with the customer as the invoiced partner."""
    sample = Sample(spark, root)
    owners = sample.raw("orders").select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("partner_id")
    )
    lines = reconcile.anniversary(sample.line(), sample.product()).join(owners, "invoice_id")
    return sample, lines.withColumnRenamed("id", "line_id")


def _reconciled(spark, root):
    """Invoices, anniversary lines, subscriptions and transactions with the customer as the invoiced partner."""
    sample, lines = _owned_by_company(spark, root)
    invoices = sample.raw("orders").select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("partner_id"),
        F.col("o_orderdate").alias("invoice_date"), F.col("o_orderstatus").alias("order_status"),
    )
    subscriptions = reconcile.anniversary(sample.subscription(), sample.product()).withColumnRenamed(
        "company_id", "partner_id"
    )
    transactions = lines.filter(F.col("return_flag") != "R").select(
        "partner_id", "completed_line_item_id", "invoice_date", F.col("line_id").alias("transaction_id"), "product_id", "quantity"
    )
    return invoices, lines, subscriptions, transactions


def invoice_reconciliation(spark, root):
    return reconciliation.reconcile_invoices(*_reconciled(spark, root))


def missing_subscription_rows(spark, root):
    """Subscriptions due in a month of their partner's invoices that none of them holds."""
    invoices, lines, subscriptions, _ = _reconciled(spark, root)
    rows = reconciliation.missing_subscriptions(invoices, lines, subscriptions)
    return rows.select("partner_id", F.col("id").alias("subscription_id"), "completed_line_id", "billing_cycle_start", "quantity")


def missing_transaction_rows(spark, root):
    """Transactions of a month of their partner's invoices that none of them holds."""
    invoices, lines, _, transactions = _reconciled(spark, root)
    return reconciliation.missing_transactions(invoices, lines, transactions)


def missing_lines(spark, root):
    """Lines that none of their partner's valid invoices holds."""
    invoices, lines, _, _ = _reconciled(spark, root)
    valid = invoices.filter(F.col("order_status") != "P")
    rows = reconciliation.missing_lines(valid, lines)
    return rows.select(F.col("line_id").alias("id"), "invoice_id", "partner_id", "product_id", "start_period")


def matched_lines(spark, root):
    sample = Sample(spark, root)
    invoices = sample.raw("orders").filter(F.col("o_orderstatus") != "P").select(
        F.col("o_orderkey").alias("invoice_id")
    )
    return reconcile.match_flag(sample.line(), invoices, "invoice_id").select("id", "invoice_id", "is_matched")


def first_lines(spark, root):
    """The first line of every item: keys that occur more than once give one row."""
    rows = Sample(spark, root).line().select("completed_line_item_id", "id", "invoice_id", "product_id")
    return reconcile.first_matching_row(rows, "completed_line_item_id", [F.col("id")])


def _transactions(spark, root):
    return Sample(spark, root).owned_line().filter(F.col("return_flag") != "R").select(
        "partner_id", "invoice_date", F.col("completed_line_item_id").alias("transaction_id")
    )


def transaction_stats(spark, root):
    return reconcile.transaction_stats(_transactions(spark, root), ["partner_id"])


def transaction_months(spark, root):
    return reconcile.month_distribution(_transactions(spark, root), ["partner_id"])


def _bundle(spark, root):
    """The bundle of all invoices of the month."""
    sample = Sample(spark, root)
    accounts = sample.accounts().select("company_id", "partner_id")
    owned = sample.owned_line().withColumn("created_dt", F.col("ship_ts"))
    tables = {
        "product": sample.product(),
        "csv_invoice_row_archive": owned,
        "subscription": sample.subscription().join(accounts, "company_id"),
        "order_manager_transaction": owned.filter(F.col("return_flag") != "R").select(
            F.concat(F.lit("G-"), F.col("completed_line_item_id").cast("string")).alias("completed_line_item_id"),
            F.concat(F.lit("PR-"), F.col("product_id").cast("string")).alias("product_uuid"),
            F.concat(F.lit("PG-"), F.col("partner_id").cast("string")).alias("partner_id"),
            F.col("ship_ts").alias("order_date"),
        ),
        "completed_line_item": sample.completed_line_item().select(
            "id", "guid", "product_id", F.col("order_id").alias("completed_order_id"),
            F.col("provision_ts").alias("created_dt"),
        ),
        "completed_order": sample.raw("orders").select(
            F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("company_id")
        ).join(accounts, "company_id"),
        "partner": sample.partner(),
    }
    invoices = sample.invoice().filter(dates.in_month(F.col("order_ts"), MONTH))
    return reconcile.invoice_bundle(tables, invoices, date(1999, 1, 1))


def invoice_bundle_rows(spark, root):
    """The rows of every frame of the bundle, by the invoice they belong to (if any) and their own key."""
    parts = []
    for name, frame in _bundle(spark, root).items():
        key = "id" if "id" in frame.columns else "completed_line_item_id"
        owner = F.col("invoice_id") if "invoice_id" in frame.columns else F.lit(None)
        parts.append(frame.select(F.lit(name).alias("frame"), owner.cast("bigint").alias("invoice_id"), F.col(key).cast("string").alias("row_key")))
    return reduce(DataFrame.unionByName, parts)


def invoice_bundle(spark, root):
    """Rows per frame of the bundle."""
    frames = _bundle(spark, root)
    counts = [
        frame.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("frame"), "row_count")
        for name, frame in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)
