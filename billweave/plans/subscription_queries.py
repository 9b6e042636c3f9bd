"""Subscription drill-down and extracts on the shared test tables."""

from datetime import date

from pyspark.sql import functions as F

from billweave.functions import dates, labels, numbers
from billweave.functions.numbers import money
from billweave.operators import charges, extracts, ordered, subscriptions
from billweave.sources import sinks
from billweave.sources.scratch import scratch_folder
from billweave.plans.sample import EVENT_METHODS, EVENTS_DAY, ORDERS_AS_OF, Sample

MONTH = ORDERS_AS_OF
HISTORY_END = date(2001, 8, 1)


def _last_items(sample, *columns):
    """Chosen columns of the completed line items, the last version of each id."""
    version = F.struct("product_id", "supplier_id", "total", "quantity")
    last = sample.completed_line_item().groupBy("id").agg(F.max_by(F.struct(*columns), version).alias("_row"))
    return last.select("id", "_row.*").withColumnRenamed("supplier_id", "rate_plan_id")


def _items(sample):
    return (
        _last_items(sample, "product_id", "supplier_id", "type", "term_in_months", "quantity", "total", "gross_revenue")
        .withColumn("partner_buy_rate", F.round(F.col("gross_revenue") / F.col("quantity"), 4))
        .withColumn("actual_retail_price", F.round(F.col("total") / F.col("quantity"), 4))
        .withColumn("approving_user_id", F.col("rate_plan_id") % 40)
    )


def _users(sample):
    return sample.raw("nation").select(
        F.col("n_nationkey").cast("bigint").alias("id"),
        F.lit("User").alias("first_name"),
        F.col("n_name").alias("last_name"),
        F.concat(F.lower("n_name"), F.lit("@billing.example")).alias("email"),
    )


def _subscription_lines(spark, root):
    sample = Sample(spark, root)
    plans = sample.raw("supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_nationkey").cast("bigint").alias("user_id"),
        F.date_add(F.lit(date(2000, 4, 1)), F.col("s_suppkey").cast("int")).alias("start_date"),
        F.when(F.col("s_acctbal") < 0, F.lit(date(2001, 1, 1))).alias("end_date"),
    )
    orders = sample.raw("orders")
    invoices = orders.select(F.col("o_orderkey").alias("id"))
    owners = (
        orders.select(
            F.col("o_orderkey").alias("invoice_id"),
            F.col("o_custkey").alias("company_id"),
            (F.col("o_orderstatus") == "P").alias("bill_on_behalf_indicator"),
        )
        .join(sample.accounts(), "company_id")
        .select("invoice_id", "partner_name", "company_name", "bill_on_behalf_indicator")
    )
    return subscriptions.invoice_subscriptions(
        sample.line(), sample.subscription(), _last_items(sample, "supplier_id", "type", "term_in_months"), invoices, plans, _users(sample), owners
    )


def subscription_lines(spark, root):
    rows = _subscription_lines(spark, root)
    flagged = subscriptions.recent_change_flag(rows.withColumn("status", F.lower("sub_status")), MONTH).drop("status")
    return flagged.select(
        *[money(F.col(c)).alias(c) if c in ("partner_total", "customer_total", "partner_profit") else F.col(c)
          for c in flagged.columns]
    )


def _chains(sample):
    """Version details, latest instructions and the plain versions."""
    tasks = sample.raw("events").select(
        F.col("event_id").alias("id"),
        F.expr("event_id div 2").alias("subscription_id"),
        F.when(F.col("event_type").isin("view", "click"), "ScheduledInstruction").otherwise("Other").alias("type"),
        F.col("event_type").alias("status"),
        F.concat(F.lit('{"coTermDate":"'), labels.json_text(F.col("props"), "k"), F.lit('"}')).alias("additional_params"),
    )
    terms = sample.product().select("id", F.col("size").alias("term_in_months"))
    chain = sample.subscription().withColumn("commitment_term_id", F.col("product_id"))
    details = subscriptions.version_details(chain, _items(sample), sample.product(), terms, _users(sample))
    return details, subscriptions.latest_instructions(tasks), chain


def related_subscriptions(spark, root):
    """Every version of every subscription with all co-term dates at or before it."""
    details, latest, versions = _chains(Sample(spark, root))
    rows = subscriptions.related_subscriptions(details, latest, versions=versions)
    return rows.select(
        "id", "original_subscription_id", "status", "quantity", "product_name", "modified_by", "term_in_months", "co_term_date"
    )


def co_term_dates(spark, root):
    """The first version of each subscription with each co-term date."""
    _, latest, versions = _chains(Sample(spark, root))
    return subscriptions.valid_from(versions, latest)


def sorted_subscription_lines(spark, root):
    """The first 40 lines in the order of the page: arrears, active, newest, highest."""
    rows = subscriptions.sorted_subscriptions(_subscription_lines(spark, root), MONTH).limit(40)
    return rows.select("id", "has_arrears", "start_date", "end_date", money(F.col("partner_total")).alias("partner_total"))


def chosen_invoice_lines(spark, root):
    """Lines of an invoice named by its number."""
    sample = Sample(spark, root)
    invoices, _ = subscriptions.choose_lines(sample.invoice(), sample.subscription(), invoice_id="INV-7")
    lines = sample.line().join(invoices.select(F.col("id").alias("invoice_id"), "alternate_id"), "invoice_id")
    return lines.select("alternate_id", "id", "product_id", "quantity")


def csv_extract(spark, root):
    """The invoices of a month, written as a CSV extract and read back."""
    folder = scratch_folder(spark)
    chosen = extracts.invoices(Sample(spark, root).invoice(), MONTH).select("id", "alternate_id", "invoice_date", "status", "total")
    sinks.write_csv(chosen, folder)
    rows = spark.read.option("header", True).schema(chosen.schema).csv(folder)
    return rows.withColumn("total", money(F.col("total")))


def related_records(spark, root):
    details, latest, versions = _chains(Sample(spark, root))
    rows = subscriptions.with_latest_co_term(details, latest, versions)
    return rows.select(
        "id", "original_subscription_id", "status", "quantity", "start_date", "end_date", "commitment_term_end_date",
        "commitment_term_in_months", "product_name", "modified_by", "modified_by_email", "type", "term_in_months",
        "co_term_date",
        money(F.col("partner_buy_rate"), 4).alias("partner_buy_rate"),
        money(F.col("actual_retail_price"), 4).alias("actual_retail_price"),
        money(F.col("gross_revenue"), 4).alias("gross_revenue"),
        money(F.col("monthly_revenue")).alias("monthly_revenue"),
    )


def _metrics(spark, root):
    sample = Sample(spark, root)
    return subscriptions.metrics(sample.subscription(), _items(sample), MONTH)


def subscription_metrics(spark, root):
    return _metrics(spark, root).select(
        "id", "status", "original_subscription_id", "quantity", "start_date", "end_date", "days_active", "term_in_months",
        money(F.col("gross_revenue"), 4).alias("gross_revenue"), money(F.col("monthly_revenue")).alias("monthly_revenue"),
    )


def subscription_tiles(spark, root):
    exact = _metrics(spark, root).withColumn("monthly_revenue", F.round("monthly_revenue", 4))
    tiles = subscriptions.tiles(exact)
    return tiles.select(
        "total_subscriptions", "active_subscriptions", money(F.col("total_monthly_revenue")).alias("total_monthly_revenue"),
        F.round(F.col("average_revenue").cast("double"), 2).alias("average_revenue"), "churn_rate",
        numbers.money_text(F.col("total_monthly_revenue")).alias("total_text"),
    )


def revenue_variance_mom(spark, root):
    sample = Sample(spark, root)
    monthly = subscriptions.monthly_revenue(sample.line(), sample.subscription())
    rows = subscriptions.revenue_variance(monthly)
    amounts = ["total_revenue", "prev_revenue"]
    units = ["revenue_to_quantity_ratio", "prev_revenue_to_quantity_ratio"]
    ratios = ["revenue_variance_pct", "quantity_variance_pct", "revenue_to_quantity_ratio_variance_pct"]
    return rows.select(
        "subscription_id", "invoice_month", "total_quantity", "prev_quantity",
        *[money(F.col(c)).alias(c) for c in amounts], *[money(F.col(c), 3).alias(c) for c in units],
        *[F.round(c, 3).alias(c) for c in ratios],
    )


def _spans(spark, root, since=None, until=HISTORY_END):
    sample = Sample(spark, root)
    versions = charges.modifications(sample.subscription())
    spans = charges.active_spans(versions, until, ["company_id", "product_id"], since)
    return spans.join(sample.accounts().select("company_id", "partner_id"), "company_id").join(
        sample.product().select(F.col("id").alias("product_id"), "vendor"), "product_id"
    )


def _priced(summary):
    return summary.withColumn("total_price_change", money(F.col("total_price_change")))


def overview_history(spark, root):
    return _priced(subscriptions.overview_of_spans(_spans(spark, root)))


def overview_by_vendor(spark, root):
    return _priced(subscriptions.overview_of_spans(_spans(spark, root), ["vendor"]))


def _recent_spans(spark, root):
    return _spans(spark, root, dates.months_before(MONTH, 5), MONTH)


def overview_trend(spark, root):
    return _priced(subscriptions.trend(subscriptions.overview_of_spans(_recent_spans(spark, root)), MONTH))


def overview_vendor_trend(spark, root):
    """A vendor's months, and null where it has none but others have; one sweep gives both."""
    of_vendor = F.when(F.col("vendor") == "Brand#4", "it").otherwise("others")
    summary = subscriptions.overview_of_spans(_recent_spans(spark, root).withColumn("_whose", of_vendor), ["_whose"])
    measures = [c for c in summary.columns if c not in ("transaction_month", "_whose")]
    its = summary.groupBy("transaction_month").agg(*[F.max(F.when(F.col("_whose") == "it", F.col(c))).alias(c) for c in measures])
    return _priced(subscriptions.trend(its, MONTH))


def overview_unpivot(spark, root):
    summary = subscriptions.overview_of_spans(_recent_spans(spark, root))
    return subscriptions.long_form(subscriptions.trend(summary, MONTH))


def extract_invoice_rows(spark, root):
    sample = Sample(spark, root)
    invoices = sample.invoice().filter(dates.in_month(F.col("order_ts"), MONTH))
    rows = extracts.invoice_rows(sample.line(), sample.product(), invoices, MONTH, business_unit="ASIA")
    return rows.select(
        "id", "invoice_id", "product_id", "row_type", "term", "quantity", "start_period", "business_unit", "vendor",
        money(F.col("total")).alias("total"), money(F.col("cost_total"), 4).alias("cost_total"),
    )


def extract_invoices(spark, root):
    invoices = Sample(spark, root).invoice().filter(dates.in_month(F.col("order_ts"), MONTH))
    rows = extracts.invoices(invoices, MONTH, business_unit=None)
    return rows.select(
        "id", "alternate_id", "invoice_date", "due_date", "status", "is_email_sent", "approved", "partner_id",
        "company_id", "business_unit_code", money(F.col("total")).alias("total"),
        money(F.col("sales_tax")).alias("sales_tax"),
    )


def extract_tasks(spark, root):
    rows = extracts.task_extract(Sample(spark, root).tasks(), EVENTS_DAY, EVENT_METHODS, status="error")
    return rows.select(
        "id", "task_table", "service", "method", "status", "run_duration", "error_message", "run_on_month",
        labels.json_text(F.col("payload"), "k").alias("payload_key"), "partner_id_parsed",
    )


def extract_arrears_tasks(spark, root):
    sample = Sample(spark, root)
    products = sample.product().select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), "vendor"
    )
    rows = extracts.date_range(sample.tasks(), "run_on", date(2024, 1, 10), date(2024, 1, 20))
    return extracts.arrears_extract(rows.join(products, "product_id"), status="new", vendor="Brand#4").select(
        "id", "subscription_id", "product_id", "status", "run_duration", "product_name", "vendor"
    )


def invoice_report(spark, root):
    sample = Sample(spark, root)
    invoices = sample.invoice().drop("partner_name", "currency_code")
    rows = extracts.invoice_report(invoices, sample.partner(), sample.currency(), "EUROPE", date(2000, 1, 1))
    return rows.withColumns({"balance": money(F.col("balance")), "vat_tax_amount": money(F.col("vat_tax_amount"))})


def credit_memo_report(spark, root):
    sample = Sample(spark, root)
    postings = sample.ledger().withColumn("credit_memo_id", F.col("invoice_id"))
    memos = sample.invoice().filter(F.col("status") == "Paid").select(
        "id", "alternate_id", F.col("total").alias("credit_sum"), F.col("invoice_date").alias("created_date"),
        F.col("due_date").alias("send_date"), F.col("region").alias("business_unit_unique_code"),
        F.col("owner_partner_id").alias("partner_id"),
    )
    taxes = sample.line().filter(F.col("billing_fee") > 0).select(
        F.col("id").alias("ledger_entry_id"), F.col("total").alias("amount_excluding_tax"),
        F.col("billing_fee").alias("tax_amount"), F.lit("0.05").cast("decimal(18,4)").alias("rate"),
    )
    rows = extracts.credit_memo_report(
        postings, memos, taxes, sample.partner(), sample.product(), "EUROPE", date(2000, 1, 1)
    )
    amounts = ["credit_memo_total", "credit_total", "amount_excluding_tax", "tax_amount", "tax_rate"]
    return rows.withColumns({c: money(F.col(c), 4) for c in amounts})


def distinct_vendors(spark, root):
    return extracts.distinct_values(Sample(spark, root).product(), "vendor")


def distinct_business_units(spark, root):
    return extracts.distinct_values(Sample(spark, root).business_unit(), "unique_code")


def task_vendors(spark, root):
    sample = Sample(spark, root)
    vendors = sample.product().select("id", "vendor")
    owners = sample.company().select("id").join(vendors, "id")
    return extracts.vendors_with_tasks(sample.tasks(), owners)
