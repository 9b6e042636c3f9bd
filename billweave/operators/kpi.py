"""Monthly billing KPIs: counts, balances, health, releases, credits and line counts."""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billweave.constants import RELEASE_STATUSES
from billweave.functions import dates, labels
from billweave.functions.numbers import money, usd


def with_prior_months(monthly: DataFrame, keys: Sequence[str], month: str, measures: Sequence[str]) -> DataFrame:
    """Each measure for the month, one and two months before, and the change to the month before.

    Each row is also counted for the two months that follow it, so the prior values come from one
    aggregate instead of two self-joins. Months are matched by date: a missing month is null, not the
    last one present. Only (key, month) combinations that exist are kept.
    """
    shifted = monthly.withColumn("_shift", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn(
        "_month", F.add_months(month, F.col("_shift"))
    )

    def at(shift: int, measure: str) -> Column:
        return F.max(F.when(F.col("_shift") == shift, F.col(measure)))

    aggregates = [F.bool_or(F.col("_shift") == 0).alias("_present")]
    for m in measures:
        aggregates += [
            at(0, m).alias(f"{m}_current_month"),
            at(1, m).alias(f"{m}_1_month_prior"),
            at(2, m).alias(f"{m}_2_months_prior"),
        ]
    wide = shifted.groupBy(*keys, F.col("_month").alias(month)).agg(*aggregates).filter("_present")
    changes = [
        (F.coalesce(F.col(f"{m}_current_month"), F.lit(0)) - F.coalesce(F.col(f"{m}_1_month_prior"), F.lit(0))).alias(
            f"{m}_diff_current_month"
        )
        for m in measures
    ]
    return wide.drop("_present").select("*", *changes)


def invoice_months(invoices: DataFrame) -> DataFrame:
    """Non-void invoices per region, audience and month, with prior months."""
    rows = non_void(invoices)
    kind = labels.audience(F.col("partner_id"), F.col("company_id")).alias("invoice_type")
    monthly = rows.groupBy("region", kind, "invoice_date").agg(
        F.count(F.lit(1)).alias("invoice_count"),
        F.sum(usd(F.col("balance"), F.col("currency_code"))).alias("balance_usd"),
    )
    return with_prior_months(monthly, ["region", "invoice_type"], "invoice_date", ["invoice_count", "balance_usd"])


def non_void(invoices: DataFrame) -> DataFrame:
    return invoices.filter(F.col("status") != "Void")


def recent_months(df: DataFrame, column: str, month: date, months: int = 2) -> DataFrame:
    """Rows of a month and the `months` before it."""
    return df.filter(F.col(column).between(F.lit(dates.months_before(month, months)), F.lit(dates.month_start(month))))


def _three_months(measure: str) -> list[Column]:
    return [
        F.sum(f"{measure}_2_months_prior").alias("month_2"),
        F.sum(f"{measure}_1_month_prior").alias("month_1"),
        F.sum(f"{measure}_current_month").alias("month_0"),
        F.sum(f"{measure}_diff_current_month").alias("variance"),
    ]


def invoice_count_kpi(mart: DataFrame, month: date) -> DataFrame:
    rows = mart.filter(F.col("invoice_date") == F.lit(dates.month_start(month)))
    return rows.agg(*_three_months("invoice_count")).select(F.lit("Invoice Count").alias("metric"), "*")


def balance_by_region(mart: DataFrame, month: date) -> DataFrame:
    rows = mart.filter(F.col("invoice_date") == F.lit(dates.month_start(month)))
    sums = rows.groupBy("region").agg(*_three_months("balance_usd"))
    return sums.select("region", *[money(F.col(c)).alias(c) for c in ("month_2", "month_1", "month_0", "variance")])


def health_months(rows: DataFrame, keys: Sequence[str], month: str, healthy: Column) -> DataFrame:
    """Healthy and total counts per key and month; what is healthy is the caller's predicate."""
    return rows.groupBy(*keys, month).agg(F.count_if(healthy).alias("healthy"), F.count(F.lit(1)).alias("total"))


def health_pivot(mart: DataFrame, metric: str, column: str, month: date) -> DataFrame:
    """Healthy share of a month and the two before, and the change to the month before."""
    m0, m1, m2 = dates.month_start(month), dates.months_before(month, 1), dates.months_before(month, 2)
    rows = mart.filter(F.col(column).between(F.lit(m2), F.lit(m0)))

    def share(day: date) -> Column:
        here = F.col(column) == F.lit(day)
        healthy = F.sum(F.when(here, F.col("healthy")))
        return F.try_divide(healthy.cast("double"), F.sum(F.when(here, F.col("total"))).cast("double"))

    shares = rows.agg(share(m2).alias("month_2"), share(m1).alias("month_1"), share(m0).alias("month_0"))
    return shares.select(
        F.lit(metric).alias("metric"),
        *[F.round(c, 4).alias(c) for c in ("month_2", "month_1", "month_0")],
        F.round(F.col("month_0") - F.col("month_1"), 4).alias("variance"),
    )


def ledger_entities(postings: DataFrame, entity: str, first: date, last: date) -> DataFrame:
    """Credit and debit per entity and month."""
    rows = postings.filter(dates.between_months(F.col("transaction_date"), first, last))
    return rows.groupBy(
        entity, dates.month_of(F.col("transaction_date")).alias("transaction_month")
    ).agg(F.sum("credit").alias("credit"), F.sum("debit").alias("debit"))


def release_by_region(invoices: DataFrame, month: date) -> DataFrame:
    rows = non_void(invoices).filter(F.col("invoice_date") == F.lit(dates.month_start(month)))
    status = labels.release_status(F.col("is_email_sent"), F.col("approved"))
    return rows.groupBy("region", status.alias("release_status")).agg(F.count(F.lit(1)).alias("value"))


def two_month_counts(invoices: DataFrame, month: date) -> DataFrame:
    """Invoice counts of a month and the one before, by audience, in one row."""
    now, before = dates.month_start(month), dates.months_before(month, 1)
    rows = recent_months(non_void(invoices), "invoice_date", month, 1)
    kind = labels.invoice_kind(F.col("partner_id"), F.col("company_id"))

    def counted(day: date, audience: str | None) -> Column:
        hit = F.col("invoice_date") == F.lit(day)
        return F.count_if(hit if audience is None else hit & (kind == audience))

    return rows.agg(
        *[
            counted(day, audience).alias(f"{prefix}{audience or 'total'}_invoice_count")
            for prefix, day in (("", now), ("prev_", before))
            for audience in ("company", "partner", None)
        ]
    )


def release_details(
    invoices: DataFrame, currencies: DataFrame, partners: DataFrame, companies: DataFrame, month: date
) -> DataFrame:
    """Invoices of a month with audience, owner and release status.

    The owner of a company invoice is the company's partner; `partners` is joined in both roles.
    """
    rows = invoices.filter(F.col("invoice_date") == F.lit(dates.month_start(month))).alias("i")
    cu = currencies.select(F.col("id").alias("_cu"), F.col("api_code").alias("currency_code")).alias("cu")
    direct = partners.select("id", "name").alias("p")
    via = partners.select("id", "name").alias("p2")
    owned = companies.select("id", "partner_id").alias("c")
    joined = (
        rows.join(cu, F.col("i.currency_id") == F.col("cu._cu"))
        .join(direct, F.col("i.partner_id") == F.col("p.id"), "left")
        .join(owned, F.col("i.company_id") == F.col("c.id"), "left")
        .join(via, F.col("c.partner_id") == F.col("p2.id"), "left")
    )
    company_only = F.col("i.partner_id").isNull() & F.col("i.company_id").isNotNull()
    return joined.select(
        "i.id",
        "i.status",
        "i.is_email_sent",
        "i.approved",
        "i.balance",
        "cu.currency_code",
        "i.business_unit_code",
        labels.audience(F.col("i.partner_id"), F.col("i.company_id")).alias("invoice_audience"),
        F.when(company_only, F.col("p2.name")).otherwise(F.col("p.name")).alias("partner_name"),
        F.when(company_only, F.col("p2.id")).otherwise(F.col("p.id")).alias("partner_id"),
        labels.release_status(F.col("i.is_email_sent"), F.col("i.approved")).alias("release_status"),
    )


def release_crosstab(details: DataFrame, statuses: Sequence[str] = tuple(RELEASE_STATUSES)) -> DataFrame:
    """Invoices and distinct partners per business unit and release status, with a total row.

    Rows are first counted per (unit, status, partner); the rollup and its distinct counts then work
    on that small result.
    """
    status = labels.release_status_with_void(F.col("status"), F.col("release_status"))
    counted = (
        details.filter(F.col("business_unit_code").isNotNull())
        .groupBy("business_unit_code", status.alias("_status"), "partner_id")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    aggregates = []
    for s in [*statuses, "Unknown Status"]:
        hit = F.col("_status") == s
        name = s.lower().replace(" - ", "_").replace(" ", "_")
        aggregates.append(F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).alias(name))
        aggregates.append(F.count_distinct(F.when(hit, F.col("partner_id"))).alias(f"{name}_partners"))
    rolled = counted.rollup("business_unit_code").agg(
        F.grouping("business_unit_code").alias("_is_total"), *aggregates, F.sum("_n").alias("total")
    )
    label = F.when(F.col("_is_total") == 1, "Total").otherwise(F.col("business_unit_code"))
    return rolled.withColumn("business_unit_code", label).drop("_is_total")


def balances(invoices: DataFrame, invoice_date: date) -> DataFrame:
    """Balances in USD of the non-void invoices of one date."""
    rows = non_void(invoices).filter(F.col("invoice_date") == F.lit(invoice_date))
    return rows.select(
        "id",
        "balance",
        "currency_code",
        "status",
        "is_email_sent",
        "approved",
        "business_unit_code",
        usd(F.col("balance"), F.col("currency_code")).alias("balance_usd"),
    )


def balance_split(rows: DataFrame) -> DataFrame:
    """Balance per business unit and in total, split by both flags; invoices with an unset flag are left out."""
    sent, approved, amount = F.col("is_email_sent"), F.col("approved"), F.col("balance_usd")
    known = rows.filter(sent.isNotNull() & approved.isNotNull())
    zero = F.lit(0).cast("decimal(38,8)")

    def part(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, amount)), zero)

    rolled = known.rollup("business_unit_code").agg(
        F.grouping("business_unit_code").alias("_is_total"),
        money(F.sum(amount)).alias("balance_usd"),
        money(part(sent)).alias("email_sent_usd"),
        money(part(~sent)).alias("not_email_sent_usd"),
        money(part(approved)).alias("approved_usd"),
        money(part(~approved)).alias("not_approved_usd"),
    )
    label = F.when(F.col("_is_total") == 1, "Total").otherwise(F.col("business_unit_code"))
    return rolled.withColumn("business_unit_code", label).drop("_is_total")


def vendor_months(amounts: DataFrame, month: str, measure: str) -> DataFrame:
    """Amounts per vendor and month with prior months and the vendor's rank in the month."""
    monthly = amounts.groupBy("vendor", month).agg(F.sum(measure).alias(measure))
    wide = with_prior_months(monthly, ["vendor"], month, [measure])
    ranking = Window.partitionBy(month).orderBy(F.col(f"{measure}_current_month").desc_nulls_last())
    return wide.withColumn("current_month_rank", F.rank().over(ranking).cast("bigint"))


def top_vendors(mart: DataFrame, column: str, measure: str, month: date, top: int = 5) -> DataFrame:
    """The vendors ranked up to `top` in a month, with their three months."""
    rows = mart.filter((F.col(column) == F.lit(dates.month_start(month))) & (F.col("current_month_rank") <= top))
    return rows.select(
        "vendor",
        money(F.col(f"{measure}_2_months_prior")).alias("month_2"),
        money(F.col(f"{measure}_1_month_prior")).alias("month_1"),
        money(F.col(f"{measure}_current_month")).alias("month_0"),
        money(F.col(f"{measure}_diff_current_month")).alias("variance"),
        "current_month_rank",
    )


def line_months(lines: DataFrame) -> DataFrame:
    """Invoice lines per region, charge type, term type and month."""
    return lines.groupBy(
        "region", F.col("row_type").alias("line_type"), F.coalesce("term", F.lit("No Term")).alias("term_type"),
        F.col("invoice_date").alias("invoice_month"),
    ).agg(
        F.count(F.lit(1)).alias("line_item_count"),
        F.sum(usd(F.col("total"), F.col("currency_code"))).alias("total_usd"),
    )


def line_details(mart: DataFrame, month: date) -> DataFrame:
    rows = mart.filter(F.col("invoice_month") == F.lit(dates.month_start(month)))
    return rows.withColumn("total_usd", money(F.col("total_usd")))


def line_count_pivot(mart: DataFrame, month: date, terms: Sequence[str]) -> DataFrame:
    """Line counts of a month and the six before, by term type."""
    rows = recent_months(mart, "invoice_month", month, 6)
    columns = [F.sum(F.when(F.col("term_type") == t, F.col("line_item_count")).otherwise(0)) for t in terms]
    names = [t.lower().replace(" ", "_") for t in terms]
    return rows.groupBy("invoice_month").agg(*[c.alias(n) for c, n in zip(columns, names)])


