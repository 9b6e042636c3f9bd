"""Revenue in one currency: line details and aggregates, usage variance over months."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.functions import dates
from billweave.functions.numbers import money, relative_change, usd, usd_rate

MONTH_NAMES = ["current_month", "prior_month"] + [
    f"{word}_months_prior" for word in ("two", "three", "four", "five", "six")
]


def line_usd_details(
    lines: DataFrame, partners: DataFrame, units: DataFrame, products: DataFrame, as_of: date, open_end: bool = False
) -> DataFrame:
    """Non-void lines from one month before `as_of` up to it, or with no end, with business unit, vendor and USD amounts."""
    invoiced = F.col("invoice_date") >= F.add_months(F.lit(as_of), -1)
    if not open_end:
        invoiced = invoiced & (F.col("invoice_date") <= F.lit(as_of))
    rows = lines.filter(invoiced & ~F.col("is_voided"))
    owners = partners.select(F.col("id").alias("partner_id"), F.col("business_unit_guid").alias("_unit"))
    codes = units.select(F.col("uuid").alias("_unit"), F.col("unique_code").alias("business_unit"))
    vendors = products.select(F.col("id").alias("product_id"), "vendor")
    rate = usd_rate(F.col("currency_code"))
    return (
        rows.join(owners, "partner_id")
        .join(codes, "_unit")
        .join(vendors, "product_id")
        .drop("_unit")
        .select(
            "*",
            rate.alias("exchange_rate_multiple"),
            (rate * F.col("total")).alias("usd_total"),
            (rate * F.col("cost_total")).alias("usd_cost_total"),
            dates.month_of(F.col("invoice_date")).alias("invoice_month"),
        )
    )


def line_usd_totals(
    lines: DataFrame, partners: DataFrame, units: DataFrame, products: DataFrame, month: date
) -> DataFrame:
    """Lines of a month and the one before per type, term, month, business unit and vendor.

    Lines are summed per (partner, product, currency, type, term, month) before the dimensions are
    joined: a currency's rate is constant, so the sums can be converted afterwards.
    """
    rows = lines.filter(
        dates.between_months(F.col("invoice_date"), dates.months_before(month, 1), month) & ~F.col("is_voided")
    )
    invoice_month = dates.month_of(F.col("invoice_date")).alias("invoice_month")
    sums = rows.groupBy("partner_id", "product_id", "currency_code", "row_type", "term", invoice_month).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("total").alias("_total"), F.sum("cost_total").alias("_cost")
    )
    owners = partners.select(F.col("id").alias("partner_id"), F.col("business_unit_guid").alias("_unit"))
    codes = units.select(F.col("uuid").alias("_unit"), F.col("unique_code").alias("business_unit"))
    vendors = products.select(F.col("id").alias("product_id"), "vendor")
    joined = sums.join(owners, "partner_id").join(codes, "_unit").join(vendors, "product_id")
    label = F.concat(F.coalesce("term", F.lit("No Term")), F.lit(" - "), F.col("row_type"))
    currency = F.col("currency_code")
    totals = joined.groupBy(label.alias("row_type_term"), "invoice_month", "business_unit", "vendor").agg(
        F.sum("_n").alias("record_count"),
        F.sum(usd(F.col("_total").cast("decimal(24,4)"), currency)).alias("usd_total"),
        F.sum(usd(F.col("_cost").cast("decimal(24,4)"), currency)).alias("usd_cost_total"),
    )
    return totals.withColumn("month_name", dates.month_name(F.col("invoice_month")))


def row_type_pivot(totals: DataFrame, month: date) -> DataFrame:
    """Records and USD totals per row type and term, current month next to the previous one."""
    now, before = dates.month_start(month), dates.months_before(month, 1)

    def at(day: date, column: str) -> Column:
        return F.sum(F.when(F.col("invoice_month") == F.lit(day), F.col(column)))

    return totals.groupBy("row_type_term").agg(
        F.coalesce(at(now, "record_count"), F.lit(0)).alias("records"),
        F.coalesce(at(before, "record_count"), F.lit(0)).alias("records_prior"),
        money(at(now, "usd_total")).alias("customer_usd"),
        money(at(before, "usd_total")).alias("customer_usd_prior"),
        money(at(now, "usd_cost_total")).alias("partner_usd"),
        money(at(before, "usd_cost_total")).alias("partner_usd_prior"),
    )


def usage_variance(
    items: DataFrame,
    subscriptions: DataFrame,
    partners: DataFrame,
    products: DataFrame,
    units: DataFrame,
    currencies: DataFrame,
    assignments: DataFrame,
    configurations: DataFrame,
    as_of: date,
    open_end: bool = False,
) -> DataFrame:
    """Usage revenue of seven months per arrears subscription, in USD, with changes in percent.

    With `open_end`, subscriptions whose items all start after the month of `as_of` are listed too, their months without revenue.
    Items are summed per (subscription, currency, type) first; everything else the result shows
    depends on the subscription, so the joins run on one row per subscription. Months without revenue
    make a change null, and any null change makes the six-month mean null.
    """
    amount, start = F.col("gross_revenue"), F.col("provision_start")
    zero = F.lit(0).cast("decimal(18,4)")
    rows = items.filter(
        ~F.col("voided")
        & F.col("arrears_subscription_id").isNotNull()
        & dates.from_month(start, dates.months_before(as_of, 6), None if open_end else as_of)
    )

    def month_sum(back: int, value: Column) -> Column:
        hit = dates.month_of(start) == F.lit(dates.months_before(as_of, back))
        return F.round(F.sum(F.when(hit, value).otherwise(F.lit(0))), 2)

    sums = rows.groupBy("arrears_subscription_id", "currency_id", "type").agg(
        *[month_sum(back, F.coalesce(amount, zero)).alias(name) for back, name in enumerate(MONTH_NAMES)],
        month_sum(0, F.col("quantity")).alias("current_month_quantity"),
    )
    subs = subscriptions.select(
        F.col("id").alias("arrears_subscription_id"), "original_subscription_id", "partner_id", "product_id",
        F.col("status").alias("sub_status"), F.col("start_date").alias("sub_start_date"),
        F.col("end_date").alias("sub_end_date"),
    )
    owners = partners.select(
        F.col("id").alias("partner_id"), F.col("name").alias("partner_name"), F.col("business_unit_guid").alias("_unit")
    )
    codes = units.select(F.col("uuid").alias("_unit"), F.col("unique_code").alias("business_unit"))
    goods = products.select(F.col("id").alias("product_id"), F.col("name").alias("subscription_product_name"), "vendor")
    money_codes = currencies.select(F.col("id").alias("currency_id"), F.col("api_code").alias("_code"))
    assigned = assignments.join(
        configurations.select(F.col("id").alias("_conf"), F.col("billing_day_of_month").alias("billing_task_run_day")),
        F.col("arrears_product_usage_configuration_id") == F.col("_conf"),
        "left",
    ).select("product_id", "billing_task_run_day")
    joined = (
        sums.join(subs, "arrears_subscription_id")
        .join(owners, "partner_id")
        .join(codes, "_unit")
        .join(goods, "product_id")
        .join(money_codes, "currency_id")
        .join(assigned, "product_id", "left")
    )
    now, prior = F.col("current_month"), F.col("prior_month")
    steps = [relative_change(F.col(a), F.col(b)) for a, b in zip(MONTH_NAMES, MONTH_NAMES[1:])]
    mean = sum(steps[1:], steps[0]) / F.lit(6.0) * F.lit(100.0)
    code = F.col("_code")
    return joined.select(
        "partner_id", "partner_name", "vendor", "product_id", "subscription_product_name", "sub_status",
        "sub_start_date", "sub_end_date", "arrears_subscription_id", "original_subscription_id", "business_unit",
        "type", "billing_task_run_day",
        *[usd(F.col(name), code).alias(f"usd_{name}_revenue") for name in MONTH_NAMES],
        usd(now - prior, code).alias("prior_vs_current_revenue_difference"),
        (relative_change(now, prior) * 100).alias("percentage_change"),
        (relative_change(now, F.col("five_months_prior")) * 100).alias("percentage_change_5_months"),
        "current_month_quantity",
        mean.alias("avg_6_month_percentage_variance"),
    )


def arrears_variance(
    items: DataFrame, subscriptions: DataFrame, partners: DataFrame, products: DataFrame, units: DataFrame,
    currencies: DataFrame, as_of: date, open_end: bool = False,
) -> DataFrame:
    """This month's and last month's usage revenue per vendor and business unit, in USD.

    Amounts are rounded per (vendor, unit, currency, provision day) before they are converted and summed. With `open_end`, vendors and
    units whose items all start after the month of `as_of` are listed too, with zeros.
    """
    amount, start = F.col("gross_revenue"), F.col("provision_start")
    now, before = dates.month_start(as_of), dates.months_before(as_of, 1)
    rows = items.filter(
        ~F.col("voided") & F.col("arrears_subscription_id").isNotNull() & dates.from_month(start, before, None if open_end else now)
    )
    # sums per subscription first, so the dimension joins see fewer rows; rounding comes after the joins
    per_subscription = rows.groupBy("arrears_subscription_id", "currency_id", "provision_start").agg(
        F.sum(amount).alias("_amount")
    )
    subs = subscriptions.select(F.col("id").alias("arrears_subscription_id"), "partner_id", "product_id")
    owners = partners.select(F.col("id").alias("partner_id"), F.col("business_unit_guid").alias("_unit"))
    codes = units.select(F.col("uuid").alias("_unit"), F.col("name").alias("business_unit"))
    goods = products.select(F.col("id").alias("product_id"), "vendor")
    money_codes = currencies.select(F.col("id").alias("currency_id"), F.col("api_code").alias("_code"))
    joined = (
        per_subscription.join(subs, "arrears_subscription_id")
        .join(owners, "partner_id")
        .join(codes, "_unit")
        .join(goods, "product_id")
        .join(money_codes, "currency_id")
    )
    zero = F.lit(0).cast("decimal(18,4)")

    def month_sum(day: date) -> Column:
        return F.round(F.sum(F.when(dates.month_of(start) == F.lit(day), F.col("_amount")).otherwise(zero)), 2)

    inner = joined.groupBy("vendor", "business_unit", "_code", "provision_start").agg(
        month_sum(before).alias("_prior"), month_sum(now).alias("_current")
    )
    code = F.col("_code")

    def total(value: Column) -> Column:
        return money(F.sum(usd(value.cast("decimal(24,2)"), code)))

    return inner.groupBy("vendor", "business_unit").agg(
        total(F.col("_prior")).alias("usd_prior_month_revenue"),
        total(F.col("_current")).alias("usd_current_month_gross_revenue"),
        total(F.col("_current") - F.col("_prior")).alias("usd_gross_revenue_difference"),
    )
