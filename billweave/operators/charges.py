"""Duplicate and missing charges: duplicate lines, renewals, the billing projection and its reports."""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billweave.functions import dates
from billweave.functions.numbers import usd
from billweave.operators import ordered

DUPLICATE_KEYS = [
    "invoice_id", "completed_line_item_id", "invoice_type", "transaction_type", "quantity", "line_item_total",
]
DUPLICATE_TYPES = ["subscription", "prorate"]
CUTOVER = date(2024, 12, 1)


def charged_lines(lines: DataFrame, products: DataFrame, since: date = CUTOVER) -> DataFrame:
    """The lines that are searched for duplicates: subscription and prorate charges of products that bill on their anniversary,
    invoiced since the cutover. products: product_id, anniversary_billing."""
    kept = lines.filter((F.col("invoice_date") >= F.lit(since)) & F.col("transaction_type").isin(*DUPLICATE_TYPES))
    return kept.join(products.filter("anniversary_billing").select("product_id"), "product_id", "left_semi")


def duplicate_lines(lines: DataFrame, order: Sequence[str | Column], keys: Sequence[str] = tuple(DUPLICATE_KEYS)) -> DataFrame:
    """Lines that repeat an earlier one in all keys, numbered from 2, with the number of copies.

    `order` tells copies apart; a line copied very often is spread over tasks along it.
    """
    rows = ordered.numbered(lines, keys, order, "line_row_number", "line_duplicate_count")
    return rows.filter(F.col("line_row_number") > 1)


def with_orders(duplicates: DataFrame, transactions: DataFrame) -> DataFrame:
    """Add the order transaction of each duplicate: same item, type, invoice date and start."""
    keys = ["completed_line_item_id", "transaction_type", "invoice_date", "start_period"]
    found = transactions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("order_total").alias("order_total")
    )
    return duplicates.join(found, keys, "left")


def duplicate_headline(duplicates: DataFrame) -> DataFrame:
    return duplicates.agg(
        F.count_distinct("line_id").alias("duplicate_lines"),
        F.count_distinct("partner_id").alias("partners"),
        F.count_distinct("company_id").alias("companies"),
        F.count_distinct("product_id").alias("products"),
        F.sum("credit_usd").alias("credit_usd"),
    )


def modifications(versions: DataFrame) -> DataFrame:
    """Each subscription version against the one before it in the same chain (by id)."""
    previous = {
        "id": "prior_id", "quantity": "prior_quantity", "term": "prior_term", "price": "prior_price",
        "product_id": "prior_product_id", "completed_line_id": "prior_completed_line_id",
    }
    rows = ordered.lagged(versions, ["original_subscription_id"], ["id"], previous)
    has_prior = F.col("prior_id").isNotNull()

    def changed(now: str, before: str) -> Column:
        return has_prior & ~F.col(now).eqNullSafe(F.col(before))

    return rows.select(
        "*",
        changed("quantity", "prior_quantity").alias("quantity_changed"),
        changed("term", "prior_term").alias("term_changed"),
        changed("price", "prior_price").alias("price_changed"),
        changed("product_id", "prior_product_id").alias("product_changed"),
        F.when(has_prior, F.col("quantity") - F.col("prior_quantity")).alias("quantity_delta"),
        F.when(has_prior, F.col("price") - F.col("prior_price")).alias("price_delta"),
    )


CHANGES = ("quantity_changes", "price_changes", "product_changes", "term_changes", "modifications", "quantity_delta", "price_delta")


def active_spans(
    versions: DataFrame, as_of: date, carry: Sequence[str] = (), since: date | None = None
) -> DataFrame:
    """One row per subscription chain and month in which versions start: the months `shown`..`last` until the next such month.

    The versions of a chain are reduced to one row per start month first: the latest version, its `carry` columns, and how many and what
    changes started. A chain ends with the end date of its last version, else with `as_of`. `since` keeps the months from there on.

    `versions` is the result of `modifications`.
    """
    kept = ["id", "status", "end_date", *carry]
    starts = versions.groupBy(
        "original_subscription_id", dates.month_of(F.col("start_date")).alias("first")
    ).agg(
        F.max_by(F.struct(*kept), "id").alias("_version"),
        F.min("id").alias("first_id"),
        F.count_if("quantity_changed").alias("quantity_changes"),
        F.count_if("price_changed").alias("price_changes"),
        F.count_if("product_changed").alias("product_changes"),
        F.count_if("term_changed").alias("term_changes"),
        F.count_if(F.col("prior_id").isNotNull()).alias("modifications"),
        F.sum(F.coalesce("quantity_delta", F.lit(0))).alias("quantity_delta"),
        F.sum(F.coalesce("price_delta", F.lit(0).cast("decimal(18,4)"))).alias("price_delta"),
        F.min_by("prior_id", "id").isNull().alias("is_new"),
    )
    following = F.lead("first").over(Window.partitionBy("original_subscription_id").orderBy("first"))
    ends = dates.month_of(F.col("end_date"))
    until = F.lit(dates.month_start(as_of))
    last = F.least(F.coalesce(F.add_months("_next", -1), F.greatest(ends, F.when(ends.isNotNull(), F.col("first"))), until), until)
    shown = F.col("first") if since is None else F.greatest(F.col("first"), F.lit(dates.month_start(since)))
    return (
        starts.withColumn("_next", following)
        .select("*", *[F.col(f"_version.{c}").alias(c) for c in kept])
        .withColumn("last", last)
        .withColumn("shown", shown)
        .filter(F.col("shown") <= F.col("last"))
        .withColumn("cancelled_in", F.when(F.col("_next").isNull() & ends.between(F.col("shown"), F.col("last")), ends))
        .drop("_version", "_next")
    )


def active_months(
    versions: DataFrame, as_of: date, carry: Sequence[str] = (), since: date | None = None
) -> DataFrame:
    """One row per subscription chain and month it is active, with the version that counts then.

    A month without a change keeps the last version before it. Months before `since` are never generated. For sums over all
    subscriptions, `subscriptions.overview_of_spans` needs no rows per month.
    """
    spans = active_spans(versions, as_of, carry, since)
    exploded = spans.withColumn("transaction_month", F.explode(F.sequence("shown", "last", F.expr("interval 1 month"))))
    first = F.col("transaction_month") == F.col("first")

    def here(column: str) -> Column:
        kind = "decimal(28,4)" if column == "price_delta" else "bigint"
        return F.when(first, F.col(column)).otherwise(F.lit(0)).cast(kind).alias(column)

    return exploded.select(
        "original_subscription_id",
        "transaction_month",
        F.when(first, F.col("first_id")).otherwise(F.col("id")).alias("first_id_in_month"),
        F.col("id").alias("latest_id_in_month"),
        "status",
        "end_date",
        *carry,
        *[here(c) for c in CHANGES],
        (first & F.col("is_new")).alias("is_new"),
        F.coalesce(F.col("transaction_month") == F.col("cancelled_in"), F.lit(False)).alias("is_cancelled"),
    )


def renewal_month(term: Column, cycle_start: Column, commitment_end: Column, month: Column) -> Column:
    """The month in which a full-term charge is expected, for a subscription active in `month`.

    Monthly terms renew every month. Others renew in the month of their commitment end, or of their
    cycle start when there is none: that month if the day is the first, else the next one. The year is
    the year of `month`, also when a mid-December date moves to January.
    """
    base = F.coalesce(commitment_end, cycle_start)
    number = F.when(F.day(base) == 1, F.month(base)).otherwise(F.month(base) % 12 + 1)
    yearly = F.make_date(F.year(month), number, F.lit(1))
    return F.when(F.lower(term) == "monthly", dates.month_of(month)).otherwise(yearly)


def due_renewals(months: DataFrame, since: date = CUTOVER) -> DataFrame:
    """Active months in which a full-term charge is expected."""
    renewal = renewal_month(
        F.col("term"), F.col("billing_cycle_start"), F.col("commitment_term_end_date"), F.col("transaction_month")
    )
    return (
        months.filter(F.col("transaction_month") >= F.lit(since))
        .withColumn("estimated_billing_renewal_date", renewal)
        .filter(F.col("estimated_billing_renewal_date") == F.col("transaction_month"))
    )


def month_charges(lines: DataFrame) -> DataFrame:
    """Full-term and prorate charges per (original subscription, invoice month), at the partner's cost and the customer's total;
    bill-on-behalf lines are out."""
    full, prorate = F.col("row_type") == "subscription", F.col("row_type") == "prorate"
    return (
        lines.filter(~F.col("is_bill_on_behalf"))
        .groupBy("original_subscription_id", F.col("invoice_date").alias("transaction_month"))
        .agg(
            F.count_if(full).alias("full_term_count"),
            F.sum(F.when(full, F.col("cost_total"))).alias("full_term_total"),
            F.sum(F.when(full, F.col("total"))).alias("full_term_customer_total"),
            F.count_if(prorate).alias("prorate_count"),
            F.sum(F.when(prorate, F.col("cost_total"))).alias("prorate_total"),
            F.sum(F.when(prorate, F.col("total"))).alias("prorate_customer_total"),
        )
    )


def projection(due: DataFrame, charges: DataFrame, orders: DataFrame, service_charges: DataFrame) -> DataFrame:
    """Expected renewals against what was charged, ordered and posted in the same month.

    orders: original_subscription_id, transaction_month, order_full_term, order_prorate,
    manual_full_term, manual_prorate. service_charges: original_subscription_id, transaction_month,
    charge_count, debit. Where the full-term charge is missing, missed revenue is the quantity times the price its audience pays: the retail
    price (`unit_price`) of a direct company (`is_direct_company`), else the partner's buy rate (`partner_buy_rate`). Amounts are
    in the subscription's currency (`currency_code`), and once more in USD.
    """
    keys = ["original_subscription_id", "transaction_month"]
    joined = due.join(charges, keys, "left").join(orders, keys, "left").join(service_charges, keys, "left")
    matched = F.coalesce("full_term_count", F.lit(0)) > 0
    prorated = F.coalesce("prorate_count", F.lit(0)) > 0
    posted = F.coalesce("charge_count", F.lit(0)) > 0
    zero = F.lit(0).cast("decimal(18,4)")
    price = F.when(F.col("is_direct_company"), F.col("unit_price")).otherwise(F.col("partner_buy_rate")).cast("decimal(18,4)")
    missed = F.when(matched, zero).otherwise(price * F.col("quantity").cast("decimal(12,0)"))
    net = missed - F.coalesce("prorate_total", zero)
    code = F.col("currency_code")
    flags = [
        F.coalesce(c, F.lit(False)).alias(c)
        for c in ("order_full_term", "order_prorate", "manual_full_term", "manual_prorate")
    ]
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("full_term_count", "prorate_count", "charge_count")]
    totals = ("full_term_total", "full_term_customer_total", "prorate_total", "prorate_customer_total", "debit")
    amounts = [F.coalesce(c, zero).alias(c) for c in totals]
    added = {
        "full_term_count", "prorate_count", "order_full_term", "order_prorate", "manual_full_term", "manual_prorate",
        "charge_count", *totals,
    }
    return joined.select(
        *[c for c in joined.columns if c not in added],
        *counts,
        *amounts,
        *flags,
        F.when(matched, "Matched").otherwise("Missing").alias("line_status"),
        F.when(prorated, "Matched Prorate").otherwise("No Prorates").alias("prorate_status"),
        F.when(posted, "Service Charges").otherwise("No Service Charges").alias("ledger_status"),
        missed.alias("missed_revenue"),
        usd(missed, code).alias("missed_revenue_usd"),
        net.alias("net_missed_revenue"),
        usd(net, code).alias("net_missed_revenue_usd"),
        usd(F.coalesce("debit", zero), code).alias("debit_usd"),
    )


def named_state() -> Column:
    """The name of a projection row's missing-charge state; null when it is none of the named ones.

    A missing charge without service charges and without manual orders is named by two facts: whether the orders hold its full term, and
    whether they hold prorates, which the invoice must then hold too.
    """
    settled = (
        (F.col("line_status") == "Missing")
        & (F.col("ledger_status") == "No Service Charges")
        & ~F.col("manual_full_term")
        & ~F.col("manual_prorate")
        & ((F.col("prorate_status") == "Matched Prorate") == F.col("order_prorate"))
    )
    where = F.when(F.col("order_full_term"), "Missing on invoice, matched in orders").otherwise("Missing in orders")
    prorates = F.when(F.col("order_prorate"), "with prorates").otherwise("no prorates")
    return F.when(settled, F.concat_ws(", ", where, prorates, F.lit("no service charges")))


def missing_charges(rows: DataFrame, month: date | None = None, state: str | None = None) -> DataFrame:
    """Projection rows in a named missing state, for one month or all, for one state or all."""
    named = rows.withColumn("state", named_state()).filter(F.col("state").isNotNull())
    if month is not None:
        named = named.filter(F.col("transaction_month") == F.lit(month))
    return named if state is None else named.filter(F.col("state") == state)


def by_line_status(rows: DataFrame, status: str, month: date) -> DataFrame:
    """Projection rows of a month by line status only (Missing or Matched)."""
    return rows.filter((F.col("line_status") == status) & (F.col("transaction_month") == F.lit(month)))


def missing_summary(rows: DataFrame) -> DataFrame:
    """Missing full-term charges per month."""
    return (
        rows.filter(F.col("line_status") == "Missing")
        .groupBy("transaction_month")
        .agg(
            F.count_distinct("product_id").alias("product_count"),
            F.count_distinct("partner_id").alias("missing_partner_count"),
            F.count_distinct("company_id").alias("missing_company_count"),
            F.count_distinct("original_subscription_id").alias("missing_subscription_count"),
            F.sum("missed_revenue").alias("missed_revenue"),
            F.sum("missed_revenue_usd").alias("missed_revenue_usd"),
            F.sum("charge_count").alias("service_charges_posted_count"),
            F.sum("debit").alias("service_charges_posted"),
            F.sum("debit_usd").alias("service_charges_posted_usd"),
        )
    )


def summary_for(summary: DataFrame, month: date) -> DataFrame:
    """The summary of one month; zeros when the month has none."""
    # an aggregate without keys gives a row in any case
    rows = summary.filter(F.col("transaction_month") == F.lit(month))
    sums = [F.coalesce(F.max(c), F.lit(0).cast(t)).alias(c) for c, t in summary.dtypes if c != "transaction_month"]
    return rows.agg(*sums).select(F.lit(month).alias("transaction_month"), "*")


def hierarchy_totals(rows: DataFrame, levels: Sequence[str], amount: str, counted: str) -> DataFrame:
    """Totals per lowest level, with the totals of each level above on every row.

    The windows run over the totals of the lowest level and share one shuffle by the top one; `rows` is computed once.
    """
    totals = rows.groupBy(*levels).agg(F.sum(amount).alias("total_amount"), F.count(counted).alias("row_count"))
    above = [
        F.sum("total_amount").over(Window.partitionBy(*levels[:depth])).alias(f"{levels[depth - 1]}_total")
        for depth in range(len(levels) - 1, 0, -1)
    ]
    return totals.select("*", *above)


def product_terms(rows: DataFrame) -> DataFrame:
    """Missed revenue and distinct subscriptions per product and term."""
    return rows.groupBy("product_name", "term").agg(
        F.sum("missed_revenue").alias("revenue_impact"),
        F.count_distinct("original_subscription_id").alias("subscription_count"),
    )


def top_products(summary: DataFrame, top: int = 10) -> DataFrame:
    """The terms of the `top` products with the highest missed revenue."""
    leaders = (
        summary.groupBy("product_name")
        .agg(F.sum("revenue_impact").alias("_total"))
        .orderBy(F.col("_total").desc(), "product_name")
        .limit(top)
        .select("product_name")
    )
    return summary.join(leaders, "product_name", "left_semi")


def product_term_pivot(summary: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Products by term with totals."""
    columns = []
    for measure in ("revenue_impact", "subscription_count"):
        for term in terms:
            hit = F.when(F.col("term") == term, F.col(measure)).otherwise(F.lit(0))
            columns.append(F.sum(hit).alias(f"{measure}_{term.lower()}"))
        columns.append(F.sum(measure).alias(f"{measure}_total"))
    return summary.groupBy("product_name").agg(*columns)
