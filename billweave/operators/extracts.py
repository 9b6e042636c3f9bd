"""Filtered extracts. A filter that is None (or "All") keeps everything."""

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.functions import dates, labels
from billweave.sources.tables import run_within


def only(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with the value; None and "All" keep all rows."""
    return df if value is None or value == "All" else df.filter(F.col(column) == value)


def only_in(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """Rows with one of the values; no values, or "All" among them, keep all rows."""
    chosen = [v for v in values or [] if v != "All"]
    return df.filter(F.col(column).isin(chosen)) if chosen else df


def facets(
    df: DataFrame, chosen: Mapping[str, object], impact: str = "All", amount: str = "missed_revenue_usd"
) -> DataFrame:
    """Several filters at once: single values, lists, and whether the amount is zero."""

    def apply(rows: DataFrame, facet: tuple[str, object]) -> DataFrame:
        column, value = facet
        return only_in(rows, column, value) if isinstance(value, (list, tuple)) else only(rows, column, value)

    rows = reduce(apply, chosen.items(), df)
    conditions = {"No Revenue Impact": F.col(amount) == 0, "Revenue Impact": F.col(amount) != 0}
    if impact == "All":
        return rows
    if impact not in conditions:
        raise ValueError(f"unknown revenue filter {impact!r}, expected one of {['All', *conditions]}")
    return rows.filter(conditions[impact])


def date_range(df: DataFrame, column: str, start: date | None, end: date | None) -> DataFrame:
    return df.filter(dates.within(F.to_date(column), start, end))


def invoice_rows(
    lines: DataFrame,
    products: DataFrame,
    invoices: DataFrame,
    month: date,
    business_unit: str | None = None,
    vendor: str | None = None,
) -> DataFrame:
    """Non-void lines of the invoices of a month, with vendor and business unit."""
    chosen = only(invoices.filter(F.col("invoice_date") == F.lit(dates.month_start(month))), "business_unit_code", business_unit)
    units = chosen.select(F.col("id").alias("invoice_id"), F.col("business_unit_code").alias("business_unit"))
    vendors = only(products.select(F.col("id").alias("product_id"), "vendor"), "vendor", vendor)
    return lines.filter(~F.col("is_voided")).join(units, "invoice_id").join(vendors, "product_id")


def invoices(rows: DataFrame, month: date, business_unit: str | None = None) -> DataFrame:
    return only(rows.filter(F.col("invoice_date") == F.lit(dates.month_start(month))), "business_unit_code", business_unit)


def arrears_extract(tasks: DataFrame, status: str | None = None, vendor: str | None = None) -> DataFrame:
    return only(only(tasks, "status", status), "vendor", vendor)


def task_extract(
    tasks: DataFrame,
    since: date,
    methods: Sequence[str],
    status: str | None = None,
    method: str | None = None,
    until: date | None = None,
) -> DataFrame:
    """Billing tasks from the month of `since` to the day `until`, with ids parsed from the payload."""
    wanted = [method] if method else list(methods)
    rows = tasks.filter(F.col("method").isin(wanted) & run_within(since, until))
    return only(rows, "status", status).select(
        "*",
        labels.json_text(F.col("payload"), "partnerId").alias("partner_id_parsed"),
        labels.json_text(F.col("payload"), "companyId").alias("company_id_parsed"),
        dates.month_of(F.col("run_on")).alias("run_on_month"),
    )


def invoice_report(
    rows: DataFrame, partners: DataFrame, currencies: DataFrame, business_unit: str | None = None, since: date | None = None
) -> DataFrame:
    """Non-void partner invoices with registration and tax numbers. Both filters apply or none does."""
    kept = rows.filter(F.col("status") != "Void")
    if business_unit and since:
        kept = kept.filter((F.col("business_unit_code") == business_unit) & (F.col("invoice_date") >= F.lit(since)))
    owners = partners.select(
        F.col("id").alias("partner_id"), F.col("name").alias("partner_name"), "registration_number",
        F.col("tax_id").alias("vat_id"),
    )
    codes = currencies.select(F.col("id").alias("currency_id"), F.col("iso_code").alias("currency_code"))
    return (
        kept.select(
            "alternate_id", "balance", "status", "due_date", F.col("sales_tax").alias("vat_tax_amount"),
            "business_unit_code", "partner_id", "currency_id", "invoice_date",
        )
        .join(owners, "partner_id")
        .join(codes, "currency_id")
        .drop("currency_id")
    )


def credit_memo_report(
    postings: DataFrame,
    memos: DataFrame,
    taxes: DataFrame,
    partners: DataFrame,
    products: DataFrame,
    business_unit: str | None = None,
    since: date | None = None,
) -> DataFrame:
    """Ledger postings with their credit memo, tax, partner and product, each of which may be missing."""
    rows = postings
    if business_unit and since:
        rows = rows.filter(F.col("transaction_date") >= F.lit(since))
    memo = memos.select(
        F.col("id").alias("credit_memo_id"), F.col("alternate_id").alias("_memo"),
        F.col("credit_sum").alias("credit_memo_total"), F.col("created_date").alias("credit_memo_created_dt"),
        F.col("send_date").alias("credit_memo_send_dt"), "business_unit_unique_code", "partner_id",
    )
    tax = taxes.select(
        F.col("ledger_entry_id").alias("id"), "amount_excluding_tax", "tax_amount", F.col("rate").alias("tax_rate")
    )
    owners = partners.select(
        F.col("id").alias("partner_id"), F.col("name").alias("partner_name"), "registration_number",
        F.col("tax_id").alias("vat_id"),
    )
    goods = products.select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), F.col("vendor").alias("product_vendor")
    )
    joined = rows.join(memo, "credit_memo_id", "left")
    if business_unit and since:
        joined = joined.filter(F.col("business_unit_unique_code") == business_unit)
    return (
        joined.join(tax, "id", "left")
        .join(owners, "partner_id", "left")
        .join(goods, "product_id", "left")
        .select(
            F.col("_memo").alias("credit_memo_id"), "credit_memo_total", "credit_memo_created_dt",
            "credit_memo_send_dt", "business_unit_unique_code", "partner_id", "partner_name", "registration_number",
            "vat_id", F.col("credit").alias("credit_total"), "amount_excluding_tax", "tax_amount", "tax_rate",
            "product_name", "product_vendor", "description", "transaction_date",
        )
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values of a filter list, without null."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def vendors_with_tasks(tasks: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Vendors of the subscriptions that have arrears tasks, last first."""
    owners = subscriptions.select(F.col("id").alias("subscription_id"), "vendor")
    found = tasks.select("subscription_id").distinct().join(owners, "subscription_id").select("vendor")
    return found.filter(F.col("vendor").isNotNull()).distinct().orderBy(F.col("vendor").desc())


