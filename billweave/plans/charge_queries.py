"""Duplicate and missing charges, and bill-on-behalf, on the shared test tables."""

from datetime import date

from pyspark.sql import functions as F

from billweave.functions import dates
from billweave.functions.numbers import money, usd
from billweave.operators import bob, charges, exports, extracts, reconcile
from billweave.plans.sample import ORDERS_AS_OF, Sample
from billweave.sources import sinks

MONTH = ORDERS_AS_OF
HISTORY_END = date(2001, 8, 1)
CUTOVER = date(1999, 12, 1)


def _money_columns(df, *names, digits=2):
    return df.select(*[money(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


def _duplicates(spark, root):
    """Duplicates by the six keys. Seats are counted in packs of 25 and amounts in 50,000s: no two test lines are equal in more."""
    sample = Sample(spark, root)
    lines = sample.line().filter(F.col("ship_ts") >= F.lit(CUTOVER)).select(
        "*",
        F.when(F.col("line_status") == "F", "Partner Invoice").otherwise("Company Invoice").alias("invoice_type"),
        F.col("row_type").alias("transaction_type"),
        F.floor(F.col("quantity") / 25).alias("seats"),
        F.floor(F.col("total") / 50000).alias("line_item_total"),
    )
    products = sample.product().select(F.col("id").alias("product_id"), "anniversary_billing")
    keys = ["seats" if k == "quantity" else k for k in charges.DUPLICATE_KEYS]
    return charges.duplicate_lines(charges.charged_lines(lines, products, CUTOVER), ["id"], keys)


def duplicate_lines(spark, root):
    transactions = (
        Sample(spark, root)
        .line()
        .filter((F.col("return_flag") != "R") & (F.col("ship_ts") >= F.lit(CUTOVER)))
        .select(
            "completed_line_item_id", F.col("row_type").alias("transaction_type"), "invoice_date", "start_period",
            F.col("total").alias("order_total"),
        )
    )
    result = charges.with_orders(_duplicates(spark, root), transactions).select(
        "id", "invoice_id", "line_number", "invoice_type", "transaction_type", "invoice_date", "product_id", "supplier_id",
        "seats", "total", "line_row_number", "line_duplicate_count", "order_count", "order_total",
    )
    return _money_columns(result, "total", "order_total")


def _owned_duplicates(spark, root):
    sample = Sample(spark, root)
    owners = sample.raw("orders").select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("company_id")
    )
    return (
        _duplicates(spark, root)
        .drop("invoice_type")
        .join(owners, "invoice_id")
        .join(sample.accounts(), "company_id")
        .join(sample.product().select(F.col("id").alias("product_id"), F.col("name").alias("product_name")), "product_id")
    )


def duplicate_headline(spark, root):
    rows = _owned_duplicates(spark, root).select(
        F.col("id").alias("line_id"), "partner_id", "company_id", "product_id",
        usd(F.col("cost_total"), F.col("currency_code")).alias("credit_usd"),
    )
    return _money_columns(charges.duplicate_headline(rows), "credit_usd")


def duplicate_ledger_upload(spark, root):
    rows = _owned_duplicates(spark, root).withColumn(
        "invoice_type", F.when(F.col("segment") == "BUILDING", "Company Invoice").otherwise("Partner Invoice")
    )
    upload = exports.ledger_upload(
        rows, "invoice_type", "Partner Invoice", "Company Invoice", "cost_total", "cost_total", "duplicate_billing",
        MONTH, "Duplicated line items", partner_id="partner_id", company_id="company_id", subscription_id="invoice_id",
        company_name="company_name", product_name="product_name", quantity="quantity", start_period="start_period",
        end_period="end_period",
    )
    return _money_columns(upload, "Credit", "Debit")


def _versions(spark, root):
    return charges.modifications(Sample(spark, root).subscription())


def subscription_changes(spark, root):
    rows = _versions(spark, root).select(
        "id", "original_subscription_id", "prior_id", "prior_quantity", "prior_term", "quantity_changed",
        "term_changed", "price_changed", "product_changed", "quantity_delta", "price_delta",
    )
    return _money_columns(rows, "price_delta")


def _months(spark, root, since=None):
    carry = ["term", "billing_cycle_start", "commitment_term_end_date", "quantity", "price", "product_id",
             "company_id", "completed_line_id", "start_date"]
    return charges.active_months(_versions(spark, root), HISTORY_END, carry, since)


def active_months(spark, root):
    return _months(spark, root).select(
        "original_subscription_id", "transaction_month", "first_id_in_month", "latest_id_in_month", "status",
        "quantity_changes", "price_changes", "product_changes", "term_changes", "modifications", "quantity_delta",
        money(F.col("price_delta")).alias("price_delta"), "is_new", "is_cancelled",
    )


def _projection(spark, root):
    sample = Sample(spark, root)
    due = (
        reconcile.anniversary(charges.due_renewals(_months(spark, root, CUTOVER), CUTOVER), sample.product())
        .withColumnRenamed("price", "unit_price")
        .join(
            sample.accounts().select("company_id", "company_name", "partner_id", "partner_name", "segment", "currency_code"),
            "company_id",
        )
        .withColumn("is_direct_company", F.col("segment") == "BUILDING")
        .withColumn("partner_buy_rate", (F.col("unit_price") * F.lit("0.9").cast("decimal(4,2)")).cast("decimal(18,4)"))
        .join(
            sample.product().select(
                F.col("id").alias("product_id"), F.col("name").alias("product_name"), "vendor", F.col("uuid").alias("product_uuid")
            ),
            "product_id",
        )
    )
    owners = sample.raw("orders").select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("original_subscription_id"),
        (F.col("o_orderstatus") == "P").alias("is_bill_on_behalf"),
    )
    lines = sample.line().filter(F.col("ship_ts") >= F.lit(CUTOVER)).join(owners, "invoice_id")
    full, prorate, manual = F.col("return_flag") == "A", F.col("return_flag") == "N", F.col("is_voided")
    orders = (
        lines.filter(F.col("line_status") == "O")
        .groupBy("original_subscription_id", F.col("invoice_date").alias("transaction_month"))
        .agg(
            F.bool_or(full).alias("order_full_term"),
            F.bool_or(prorate).alias("order_prorate"),
            F.bool_or(full & manual).alias("manual_full_term"),
            F.bool_or(prorate & manual).alias("manual_prorate"),
        )
    )
    posted = (
        sample.ledger()
        .filter((F.col("ship_ts") >= F.lit(CUTOVER)) & (F.col("type") == "CHECK_ISSUED"))
        .groupBy(
            F.col("company_id").alias("original_subscription_id"),
            dates.month_of(F.col("transaction_date")).alias("transaction_month"),
        )
        .agg(F.count(F.lit(1)).alias("charge_count"), F.sum("debit").alias("debit"))
    )
    return charges.projection(due, charges.month_charges(lines), orders, posted)


PROJECTION_MONEY = [
    "full_term_total", "full_term_customer_total", "prorate_total", "prorate_customer_total", "debit", "missed_revenue",
    "missed_revenue_usd", "net_missed_revenue", "net_missed_revenue_usd",
]
SUMMARY_AMOUNTS = ["missed_revenue", "missed_revenue_usd", "service_charges_posted", "service_charges_posted_usd"]


def renewal_projection(spark, root):
    rows = _projection(spark, root).select(
        "original_subscription_id", "transaction_month", "latest_id_in_month", "partner_id", "company_id", "product_id",
        "term", "quantity", "line_status", "prorate_status", "ledger_status", "order_full_term", "order_prorate",
        "manual_full_term", "manual_prorate", "full_term_count", "prorate_count", "charge_count", *PROJECTION_MONEY,
    )
    return _money_columns(rows, *PROJECTION_MONEY)


def missing_subscriptions(spark, root):
    rows = charges.missing_charges(_projection(spark, root)).select(
        "state", "original_subscription_id", "transaction_month", "partner_id", "company_id", "product_id",
        "missed_revenue", "net_missed_revenue",
    )
    return _money_columns(rows, "missed_revenue", "net_missed_revenue")


def faceted_missing(spark, root):
    month = charges.by_line_status(_projection(spark, root), "Missing", MONTH)
    rows = extracts.facets(
        month, {"term": ["Monthly", "All"], "segment": ["BUILDING", "MACHINERY", "HOUSEHOLD"], "partner_name": "All"},
        "Revenue Impact", "missed_revenue",
    )
    return _money_columns(
        rows.select("original_subscription_id", "company_name", "segment", "term", "missed_revenue"), "missed_revenue"
    )


def missing_month_summary(spark, root):
    return _money_columns(
        charges.missing_summary(_projection(spark, root)), *SUMMARY_AMOUNTS
    )


def missing_summary_of_month(spark, root):
    return _money_columns(
        charges.summary_for(charges.missing_summary(_projection(spark, root)), MONTH),
        *SUMMARY_AMOUNTS,
    )


def partner_hierarchy_totals(spark, root):
    rows = charges.by_line_status(_projection(spark, root), "Missing", MONTH)
    totals = charges.hierarchy_totals(
        rows, ["partner_name", "company_name", "product_name"], "missed_revenue", "original_subscription_id"
    )
    return _money_columns(totals, "total_amount", "partner_name_total", "company_name_total")


def _product_terms(spark, root):
    return charges.product_terms(charges.by_line_status(_projection(spark, root), "Missing", MONTH))


def top_products_by_term(spark, root):
    return _money_columns(charges.top_products(_product_terms(spark, root)), "revenue_impact")


def product_term_pivot(spark, root):
    pivot = charges.product_term_pivot(_product_terms(spark, root), ["Monthly", "Annual"])
    return _money_columns(pivot, *[c for c in pivot.columns if c.startswith("revenue")])


def ledger_upload(spark, root):
    rows = charges.by_line_status(_projection(spark, root), "Missing", MONTH).withColumn(
        "impacted_audience",
        F.when(F.col("segment") == "BUILDING", "Bill on Behalf").when(F.col("segment") != "MACHINERY", "Partner"),
    )
    upload = exports.ledger_upload(
        rows, "impacted_audience", "Partner", "Bill on Behalf", "net_missed_revenue", "net_missed_revenue",
        "missed_billing", MONTH, "Missing subscription charges", partner_id="partner_id", company_id="company_id",
        subscription_id="latest_id_in_month", company_name="company_name", product_name="product_name",
        quantity="quantity", start_period="transaction_month", end_period="commitment_term_end_date",
    )
    return _money_columns(upload, "Credit", "Debit")


def order_upload(spark, root):
    none = F.lit(None).cast("string")
    rows = charges.missing_charges(_projection(spark, root)).select(
        "company_name",
        F.col("start_date").alias("successor_subscription_start_date"),
        F.col("transaction_month").alias("estimated_billing_start_period"),
        F.add_months("transaction_month", 1).alias("estimated_billing_end_period"),
        F.lit("seat").alias("product_unit_of_measure"),
        F.lit("FLAT").alias("successor_rate_plan_type"),
        F.lit("RECURRING").alias("charge_type"),
        F.col("unit_price").alias("actual_retail_price"),
        "partner_buy_rate",
        (F.col("unit_price") * F.lit("0.8").cast("decimal(4,2)")).alias("wholesale_buy_rate"),
        none.alias("completed_order_purchase_order_number"),
        none.alias("currency_guid"),
        F.concat(F.lit("G-"), F.col("completed_line_id").cast("string")).alias("completed_line_item_guid"),
        F.concat(F.lit("S-"), F.col("latest_id_in_month").cast("string")).alias("subscription_guid"),
        F.concat(F.lit("O-"), F.col("original_subscription_id").cast("string")).alias("original_subscription_guid"),
        "product_uuid",
        F.col("vendor").alias("product_vendor_uuid"),
        "product_name",
        none.alias("completed_line_item_sku"),
        F.col("term").alias("successor_term"),
        F.lit(False).alias("is_flat_rate"),
        F.col("quantity").alias("current_subscription_quantity"),
        F.concat(F.lit("PG-"), F.col("partner_id").cast("string")).alias("partner_guid"),
        F.concat(F.lit("C-"), F.col("company_id").cast("string")).alias("company_guid"),
        "transaction_month",
        F.col("commitment_term_end_date").alias("successor_commitment_term_end_date"),
    )
    upload = exports.order_upload(rows, [F.col("transaction_month")], offered_by="Marketplace")
    return _money_columns(
        upload, "price", "total", "cost", "costTotal", "platformCost", "platformCostTotal", "quantity", digits=4
    )


def batch_assignment(spark, root):
    invoices = Sample(spark, root).raw("orders").select(F.col("o_orderkey").alias("id"))
    batched = sinks.assign_batches(invoices, ["id"], 700)
    return batched.withColumn("file_name", sinks.batch_file_name("invoices", F.col("batch"), "2000-06-01"))


def _bob(spark, root, since=None, until=None):
    """Assessment, partner invoices and settlements, of all months or from one on, up to another if given: the bare dates are filtered,
    so scans skip the rest. Payments may be posted in any month."""
    sample = Sample(spark, root)

    def within(column):
        return F.lit(True) if since is None else dates.from_month(F.col(column), since, until)

    company = F.when(F.col("line_number") != 7, F.col("company_id"))
    lines = sample.owned_line().filter(within("ship_ts")).select(
        "invoice_date", "partner_id", company.alias("company_id"), "cost_total", "billing_fee"
    )
    invoices = sample.invoice().filter((F.col("status") != "Void") & within("order_ts"))
    customers = invoices.select(
        "invoice_date",
        F.col("owner_partner_id").alias("partner_id"),
        F.col("owner_company_id").alias("company_id"),
        F.col("id").alias("bob_invoice_id"),
        F.col("status").alias("bob_invoice_status"),
        (F.col("total") + F.col("sales_tax")).alias("total_with_tax"),
        F.col("sales_tax").alias("tax"),
    )
    postings = sample.ledger().join(
        sample.accounts().select("company_id", "partner_id", "currency_code"), "company_id"
    )
    partner_invoices = invoices.select(
        "invoice_date", F.col("owner_partner_id").alias("partner_id"), "id", "status", "balance", "currency_code"
    )
    settlements = postings.filter((F.col("type") == "CHECK_ISSUED") & within("ship_ts"))
    return bob.assessment(lines, customers, postings, partner_invoices), partner_invoices, settlements


BOB_MONEY = [
    "partner_invoice_partner_total", "partner_billing_fee", "partner_surcharge_total", "bob_customer_total_with_tax",
    "partner_net_after_customer_total", "partner_net_after_billing_fee_and_taxes", "bob_tax_withholding",
    "bob_payment_credit", "expected_partner_bob_ledger_payment",
]
SUMMARY_MONEY = [
    "bob_payment_partner_ledger_total", "partner_net_after_billing_fee_and_taxes", "bob_payment_failed_posting_total",
    "invoice_balance", "invoice_balance_usd", "ledger_debit", "ledger_debit_usd",
]


def bob_assessment(spark, root):
    return _money_columns(_bob(spark, root)[0], *BOB_MONEY)


def _bob_summary(spark, root, *months):
    return bob.summary(*_bob(spark, root, *months))


YEAR_TO_DATE = (date(2000, 1, 1), MONTH)


def bob_summary(spark, root):
    return _money_columns(_bob_summary(spark, root), *SUMMARY_MONEY)


def bob_headline(spark, root):
    rows = bob.headline(_bob_summary(spark, root, *YEAR_TO_DATE), *YEAR_TO_DATE)
    return _money_columns(
        rows, "bob_payment_partner_ledger_total", "partner_net_after_billing_fee_and_taxes", "ledger_debit"
    )


def bob_headline_partner(spark, root):
    rows = bob.headline(_bob_summary(spark, root, *YEAR_TO_DATE), *YEAR_TO_DATE, partner_id=3)
    return _money_columns(
        rows, "bob_payment_partner_ledger_total", "partner_net_after_billing_fee_and_taxes", "ledger_debit"
    )


def bob_failed_postings(spark, root):
    return _money_columns(bob.failed_postings(_bob(spark, root, *YEAR_TO_DATE)[0], MONTH), *BOB_MONEY)


def bob_duplicate_settlements(spark, root):
    return _money_columns(bob.duplicate_settlements(_bob_summary(spark, root, YEAR_TO_DATE[0]), MONTH, open_end=True), *SUMMARY_MONEY)
