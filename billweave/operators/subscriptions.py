"""Subscription drill-down: invoice lines, related versions, metrics, revenue variance, overview."""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billweave.functions import dates, labels
from billweave.functions.numbers import percent, relative_change
from billweave.operators import charges, ordered

OVERVIEW = [
    "partner_count", "company_count", "active_subscription_count", "cancelled_subscription_count",
    "net_new_subscription_count", "total_product_changes", "total_renewals", "total_modifications",
    "total_quantity_change", "total_partner_buy_rate_changes",
]


def full_name() -> Column:
    return F.concat(F.col("first_name"), F.lit(" "), F.col("last_name"))


def choose_lines(
    invoices: DataFrame, subscriptions: DataFrame, invoice_id: int | str | None = None, subscription_id: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Invoices and subscriptions narrowed by an invoice number (text), invoice id or subscription id."""
    if invoice_id is None and subscription_id is None:
        raise ValueError("invoice_id or subscription_id is needed")
    if invoice_id is not None:
        if isinstance(invoice_id, bool) or not isinstance(invoice_id, (int, str)):
            raise ValueError("invoice_id must be a text or a whole number")
        column = "alternate_id" if isinstance(invoice_id, str) else "id"
        invoices = invoices.filter(F.col(column) == invoice_id)
    if subscription_id is not None:
        if isinstance(subscription_id, bool) or not isinstance(subscription_id, int):
            raise ValueError("subscription_id must be a whole number")
        subscriptions = subscriptions.filter(F.col("id") == subscription_id)
    return invoices, subscriptions


def invoice_subscriptions(
    lines: DataFrame,
    subscriptions: DataFrame,
    items: DataFrame,
    invoices: DataFrame,
    rate_plans: DataFrame,
    users: DataFrame,
    owners: DataFrame | None = None,
) -> DataFrame:
    """Subscriptions billed on invoices: arrears lines summed, one-off lines as they are.

    Amounts are rounded per line before they are summed. A subscription can occur in both branches. `owners` brings what `lines` lack of
    invoice_id, partner_name, company_name and bill_on_behalf_indicator.

    The lines find their items and subscriptions first, as narrow rows; the two branches are then one table, so invoices, names and rate
    plans are joined once, to the lines of a subscription alone, and one aggregate sums arrears and drops copies of one-off lines.
    """
    plans = rate_plans.join(users.withColumnRenamed("id", "_user"), F.col("user_id") == F.col("_user")).select(
        F.col("id").alias("rate_plan_id"),
        F.col("start_date").alias("rate_plan_start_date"),
        F.col("end_date").alias("rate_plan_end_date"),
        full_name().alias("rate_plan_creator"),
    )
    item_columns = items.select(
        F.col("id").alias("completed_line_item_id"), "term_in_months",
        F.col("type").alias("completed_line_item_type"), "rate_plan_id",
    )
    subs = subscriptions.select(
        F.col("id").alias("_sub"), F.col("status").alias("sub_status"), "start_date", "end_date",
        "completed_line_id",
    )
    of_owner = ["partner_name", "company_name", "bill_on_behalf_indicator"]
    billed = (
        lines.filter(~F.col("is_voided"))
        .select(
            "completed_line_item_id", "arrears_subscription_id", "invoice_id", "invoice_date", "product_id", "row_type", "quantity",
            F.round("cost_total", 2).alias("partner_total"),
            F.round("total", 2).alias("customer_total"),
            *([] if owners is not None else of_owner),
        )
        .join(item_columns, "completed_line_item_id")
    )
    arrears = billed.join(subs, F.col("arrears_subscription_id") == F.col("_sub")).withColumn("has_arrears", F.lit(True))
    one_off = billed.join(subs, F.col("completed_line_item_id") == F.col("completed_line_id")).withColumn("has_arrears", F.lit(False))
    both = (
        arrears.unionByName(one_off)
        .drop("completed_line_item_id", "arrears_subscription_id", "completed_line_id")
        # not a semi join, which would be pushed below the union and the joins, to all lines
        .join(invoices.select(F.col("id").alias("invoice_id")).distinct(), "invoice_id")
    )
    if owners is not None:
        both = both.join(owners.select("invoice_id", *of_owner), "invoice_id")
    group = [
        "_sub", "sub_status", "invoice_date", "start_date", "end_date", "partner_name", "company_name", "product_id",
        "row_type", "term_in_months", "bill_on_behalf_indicator", "completed_line_item_type", "rate_plan_id",
        "rate_plan_start_date", "rate_plan_end_date", "rate_plan_creator",
    ]
    amounts = ["quantity", "partner_total", "customer_total"]
    own = [F.when(~F.col("has_arrears"), F.col(c)).alias(f"_{c}") for c in amounts]
    rows = (
        both.join(plans, "rate_plan_id")
        .groupBy(*group, "has_arrears", *own)
        .agg(*[F.sum(c).alias(c) for c in amounts])
        .select(
            *group, *[F.when(F.col("has_arrears"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in amounts], "has_arrears"
        )
    )
    profit = F.round(F.col("customer_total") - F.col("partner_total"), 2)
    margin = F.round(F.try_divide(profit.cast("double"), F.col("customer_total").cast("double")), 2) * 100
    return rows.withColumnRenamed("_sub", "id").withColumn("partner_profit", profit).withColumn("partner_margin", margin)


def sorted_subscriptions(rows: DataFrame, as_of: date) -> DataFrame:
    """Arrears first, then active before ended, newest start, highest amount."""
    ended = F.when(F.col("end_date").isNull() | (F.col("end_date") > F.lit(as_of)), 0).otherwise(1)
    return rows.orderBy(
        F.col("has_arrears").desc(), ended, F.col("start_date").desc_nulls_first(),
        F.col("partner_total").desc_nulls_first(), "id",
    )


def recent_change_flag(rows: DataFrame, as_of: date) -> DataFrame:
    """`error` rows, and rows whose rate plan starts last month or later."""
    flag = F.when(F.col("status") == "error", "error").when(
        F.col("rate_plan_start_date") >= F.lit(dates.months_before(as_of, 1)), "recent change"
    )
    return rows.withColumn("highlight", flag)


def latest_instructions(provision_tasks: DataFrame, kind: str = "ScheduledInstruction") -> DataFrame:
    """The latest scheduled instruction of each subscription, with its payload fields."""
    latest = (
        provision_tasks.filter(F.col("type") == kind)
        .groupBy("subscription_id")
        .agg(F.max_by(F.struct("id", "status", "additional_params"), "id").alias("_task"))
    )
    payload = F.col("_task.additional_params")
    return latest.select(
        "subscription_id",
        F.col("_task.id").alias("provision_task"),
        F.col("_task.status").alias("task_status"),
        labels.json_text(payload, "commitmentTerm").alias("commitment_term"),
        labels.json_text(payload, "billingTerm").alias("billing_term"),
        labels.json_text(payload, "coTermDate").alias("co_term_date"),
    )


def version_details(
    subscriptions: DataFrame, items: DataFrame, products: DataFrame, terms: DataFrame, users: DataFrame
) -> DataFrame:
    """Every subscription version with its item's prices, product, term and editor; missing ones stay null."""
    prices = items.select(
        F.col("id").alias("completed_line_id"), "type", "partner_buy_rate", "actual_retail_price", "gross_revenue",
        "term_in_months", "approving_user_id",
    )
    goods = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    lengths = terms.select(
        F.col("id").alias("commitment_term_id"), F.col("term_in_months").alias("commitment_term_in_months")
    )
    editors = users.select(
        F.col("id").alias("approving_user_id"), full_name().alias("modified_by"),
        F.col("email").alias("modified_by_email"),
    )
    monthly = F.try_divide(F.col("gross_revenue").cast("decimal(18,4)"), F.col("term_in_months"))
    return (
        subscriptions.join(prices, "completed_line_id", "left")
        .join(goods, "product_id", "left")
        .join(lengths, "commitment_term_id", "left")
        .join(editors, "approving_user_id", "left")
        .withColumn("monthly_revenue", monthly)
    )


def valid_from(versions: DataFrame, instructions: DataFrame) -> DataFrame:
    """(original_subscription_id, co_term_date, valid_from): the first version of each chain that has a co-term date."""
    dated = versions.join(instructions.select(F.col("subscription_id").alias("id"), "co_term_date"), "id")
    return dated.groupBy("original_subscription_id", "co_term_date").agg(F.min("id").alias("valid_from"))


def co_terms(versions: DataFrame, instructions: DataFrame, ranges: int | None = None) -> DataFrame:
    """(id, co_term_date): every version with each co-term date that it or an earlier version of its chain has, each date once.

    An inequality join by ranges: the versions are cut into ranges of (chain, id), so a chain of very many versions is spread over tasks, and
    a date goes to the ranges of its chain from its first version on. The join is by chain and range; only the range of the first
    version has anything to compare.
    """
    chain = "original_subscription_id"
    placed = ordered.in_ranges(versions.select("id", chain), [chain], ["id"], ranges)
    spread = ordered.of_cut_keys(placed, [chain], n=F.count(F.lit(1))).select(chain, ordered.RANGE)
    dated = placed.join(instructions.select(F.col("subscription_id").alias("id"), "co_term_date"), "id")
    dates_of = dated.groupBy(chain, "co_term_date").agg(F.min("id").alias("valid_from"), F.min(ordered.RANGE).alias("_first"))
    later = spread.withColumnRenamed(ordered.RANGE, "_later").withColumnRenamed(chain, "_chain")
    reached = dates_of.join(F.broadcast(later), (F.col(chain) == F.col("_chain")) & (F.col("_later") > F.col("_first")))
    sent = dates_of.select("*", F.col("_first").alias(ordered.RANGE)).unionByName(reached.select(*dates_of.columns, F.col("_later").alias(ordered.RANGE)))
    sent = sent.select(chain, ordered.RANGE, "co_term_date", "valid_from")
    pairs = placed.select("id", chain, ordered.RANGE).join(sent, [chain, ordered.RANGE])
    return pairs.filter(F.col("id") >= F.col("valid_from")).select("id", "co_term_date")


def related_subscriptions(
    details: DataFrame, instructions: DataFrame, original_subscription_id: int | None = None, versions: DataFrame | None = None
) -> DataFrame:
    """All versions of one subscription, or of all, each with the co-term dates of it and of earlier versions.

    A version with several dates at or before it gives several rows, one a date; one without gives a row without date. `versions` may be the
    plain table that `details` was made of (id, original_subscription_id), so that the chains are found without making the details.
    """
    chain = F.lit(True) if original_subscription_id is None else F.col("original_subscription_id") == original_subscription_id
    pairs = co_terms((details if versions is None else versions).filter(chain), instructions)
    return details.filter(chain).join(pairs, "id", "left")


def with_latest_co_term(details: DataFrame, instructions: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """All versions of all subscriptions, each with the latest co-term date at or before it; `versions` as above."""
    plain = (details if versions is None else versions).select("id", "original_subscription_id")
    dated = plain.join(
        instructions.select(F.col("subscription_id").alias("id"), F.col("co_term_date").alias("_own")), "id", "left"
    )
    latest = ordered.carried(dated, ["original_subscription_id"], ["id"], "_own", "co_term_date")
    return details.join(latest.select("id", "co_term_date"), "id", "left")


def metrics(subscriptions: DataFrame, items: DataFrame, as_of: date) -> DataFrame:
    """Days active and monthly revenue of every subscription."""
    prices = items.select(F.col("id").alias("completed_line_id"), "gross_revenue", "term_in_months")
    monthly = F.try_divide(F.col("gross_revenue").cast("decimal(18,4)"), F.col("term_in_months"))
    return (
        subscriptions.join(prices, "completed_line_id", "left")
        .distinct()
        .withColumn("days_active", F.date_diff(F.lit(as_of), "start_date"))
        .withColumn("monthly_revenue", monthly)
    )


def tiles(rows: DataFrame) -> DataFrame:
    """Headline numbers: counts, active, revenue sum and mean, share cancelled."""
    cancelled = F.count_if(F.col("status") == "Cancelled")
    return rows.agg(
        F.count(F.lit(1)).alias("total_subscriptions"),
        F.count_if(F.col("status") == "Active").alias("active_subscriptions"),
        F.sum("monthly_revenue").alias("total_monthly_revenue"),
        F.avg("monthly_revenue").alias("average_revenue"),
        F.coalesce(percent(cancelled, F.count(F.lit(1)), 1), F.lit(0.0)).alias("churn_rate"),
    )


def monthly_revenue(lines: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Revenue and quantity per subscription and invoice month, without void lines.

    A line counts for the subscription it bills in arrears and for the one its item belongs to, once
    if both are the same.
    """
    rows = lines.filter(~F.col("is_voided"))
    amounts = ["invoice_date", "total", "quantity"]
    direct = rows.filter(F.col("arrears_subscription_id").isNotNull()).select(
        F.col("arrears_subscription_id").alias("subscription_id"), *amounts
    )
    owners = subscriptions.select(
        F.col("id").alias("subscription_id"), F.col("completed_line_id").alias("completed_line_item_id")
    )
    linked = (
        rows.join(owners, "completed_line_item_id")
        .filter(~F.col("arrears_subscription_id").eqNullSafe(F.col("subscription_id")))
        .select("subscription_id", *amounts)
    )
    return (
        direct.unionByName(linked)
        .groupBy("subscription_id", F.col("invoice_date").alias("invoice_month"))
        .agg(F.sum("total").alias("total_revenue"), F.sum("quantity").alias("total_quantity"))
    )


def revenue_variance(monthly: DataFrame, months: int = 6) -> DataFrame:
    """Change of revenue, quantity and revenue per unit over the latest months of every subscription.

    The windows run over months of one subscription, so a partition holds one row per month.
    """
    by_subscription = Window.partitionBy("subscription_id")
    latest = monthly.withColumn(
        "_n", F.row_number().over(by_subscription.orderBy(F.col("invoice_month").desc()))
    ).filter(F.col("_n") <= months)
    in_order = by_subscription.orderBy("invoice_month")
    revenue, quantity = F.col("total_revenue"), F.col("total_quantity")
    unit = F.try_divide(revenue, quantity)
    with_unit = latest.withColumn("revenue_to_quantity_ratio", unit)
    previous = {
        "total_revenue": "prev_revenue",
        "total_quantity": "prev_quantity",
        "revenue_to_quantity_ratio": "prev_revenue_to_quantity_ratio",
    }
    lagged = with_unit.select("*", *[F.lag(c).over(in_order).alias(name) for c, name in previous.items()])
    names = ["revenue_variance_pct", "quantity_variance_pct", "revenue_to_quantity_ratio_variance_pct"]
    changes = [
        (relative_change(F.col(c), F.col(p)) * 100).alias(name) for (c, p), name in zip(previous.items(), names)
    ]
    return lagged.drop("_n").select("*", *changes)


def overview(months: DataFrame, keys: Sequence[str] = ("transaction_month",)) -> DataFrame:
    """Monthly subscription summary, overall or by further keys such as the vendor."""
    return months.groupBy(*keys).agg(
        F.count_distinct("partner_id").alias("partner_count"),
        F.count_distinct("company_id").alias("company_count"),
        F.count_if(~F.col("is_cancelled")).alias("active_subscription_count"),
        F.count_if("is_cancelled").alias("cancelled_subscription_count"),
        (F.count_if("is_new") - F.count_if("is_cancelled")).alias("net_new_subscription_count"),
        F.sum("product_changes").alias("total_product_changes"),
        F.sum("term_changes").alias("total_renewals"),
        F.sum("modifications").alias("total_modifications"),
        F.sum("quantity_delta").alias("total_quantity_change"),
        F.sum("price_changes").alias("total_partner_buy_rate_changes"),
        F.sum("price_delta").alias("total_price_change"),
    )


def overview_of_spans(spans: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The same summary per month (and keys) from active spans, by a sweep line: no row per subscription and month is made.

    A span adds one where it is first shown and takes it away after its last month; running sums over the months give what is active. Partners
    and companies are counted the same way, from the months in which their number of spans leaves zero or comes back to it.
    spans: `charges.active_spans` with partner_id, company_id and the keys.
    """
    keys, month = list(keys), "transaction_month"
    after = F.add_months("last", 1)
    starts_here = F.col("shown") == F.col("first")
    points = {
        "_cancelled": F.lit(0), "_new": F.col("is_new").cast("int"), **{c: F.col(c) for c in charges.CHANGES},
    }
    none = {name: F.lit(0) for name in points}

    def event(when: Column, spans_more: int, values: dict[str, Column]) -> Column:
        amounts = [v.cast("decimal(28,4)").alias(name) for name, v in values.items()]
        return F.struct(when.alias(month), F.lit(spans_more).cast("bigint").alias("_spans"), *amounts)

    begin = event(F.col("shown"), 1, {name: F.when(starts_here, v).otherwise(F.lit(0)) for name, v in points.items()})
    cancel = event(F.col("cancelled_in"), 0, {**none, "_cancelled": F.lit(1)})
    events = spans.select(*keys, F.explode(F.array(begin, event(after, -1, none), cancel)).alias("_event")).filter(f"_event.{month} IS NOT NULL")
    measures = ["_spans", *points]
    sums = events.select(*keys, "_event.*").groupBy(*keys, month).agg(*[F.sum(m).alias(m) for m in measures])

    def entities(column: str, name: str) -> DataFrame:
        ends = F.array(F.struct(F.col("shown").alias(month), F.lit(1).alias("_d")), F.struct(after.alias(month), F.lit(-1).alias("_d")))
        steps = spans.filter(F.col(column).isNotNull()).select(*keys, column, F.explode(ends).alias("_step"))
        steps = steps.select(*keys, column, "_step.*").groupBy(*keys, column, month).agg(F.sum("_d").alias("_d"))
        here = F.sum("_d").over(Window.partitionBy(*keys, column).orderBy(month))  # a row per month and entity at most
        change = F.when(here == F.col("_d"), F.signum("_d")).when(here == 0, F.lit(-1)).otherwise(F.lit(0))
        changes = steps.select(*keys, month, change.cast("bigint").alias("_change"))
        return changes.groupBy(*keys, month).agg(F.sum("_change").alias(name))

    parts = [sums, entities("partner_id", "_partners"), entities("company_id", "_companies")]
    united = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    measures += ["_partners", "_companies"]
    per_month = united.groupBy(*keys, month).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])
    # from here on there is a row per month and key at most
    in_order = Window.partitionBy(*keys).orderBy(month)
    upto = F.coalesce(F.add_months(F.lead(month).over(in_order), -1), F.col(month))
    running = per_month.select(
        *keys, month, *points, *[F.sum(m).over(in_order).alias(m) for m in ("_spans", "_partners", "_companies")], upto.alias("_upto")
    )
    every = running.filter("_spans > 0").withColumn("_month", F.explode(F.sequence(month, "_upto", F.expr("interval 1 month"))))

    def point(name: str) -> Column:
        return F.when(F.col("_month") == F.col(month), F.col(name)).otherwise(F.lit(0)).cast("decimal(28,4)")

    def whole(value: Column, name: str) -> Column:
        return value.cast("bigint").alias(name)

    return every.select(
        F.col("_month").alias(month),
        *keys,
        whole(F.col("_partners"), "partner_count"),
        whole(F.col("_companies"), "company_count"),
        whole(F.col("_spans") - point("_cancelled"), "active_subscription_count"),
        whole(point("_cancelled"), "cancelled_subscription_count"),
        whole(point("_new") - point("_cancelled"), "net_new_subscription_count"),
        whole(point("product_changes"), "total_product_changes"),
        whole(point("term_changes"), "total_renewals"),
        whole(point("modifications"), "total_modifications"),
        whole(point("quantity_delta"), "total_quantity_change"),
        whole(point("price_changes"), "total_partner_buy_rate_changes"),
        point("price_delta").alias("total_price_change"),
    )


def trend(summary: DataFrame, month: date, last: int = 6, months: DataFrame | None = None) -> DataFrame:
    """The summary of the last months.

    With `months` (the active months of all subscriptions), every month that has any subscription is
    listed; one without a summary row, such as a vendor's month without subscriptions, is null.
    """
    in_range = F.col("transaction_month").between(
        F.lit(dates.months_before(month, last - 1)), F.lit(dates.month_start(month))
    )
    recent = summary.filter(in_range)
    if months is None:
        return recent
    calendar = months.filter(in_range).select("transaction_month").distinct()
    return calendar.join(recent, "transaction_month", "left")


def long_form(summary: DataFrame, measures: Sequence[str] = tuple(OVERVIEW)) -> DataFrame:
    """One row per month and metric."""
    wide = summary.select("transaction_month", *[F.col(m).cast("bigint").alias(m) for m in measures])
    return wide.unpivot("transaction_month", list(measures), "metric", "count")
