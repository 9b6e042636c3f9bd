"""Reconciliation: who should have been invoiced, what an invoice misses, which items should bill."""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.functions import dates, labels

HISTORY_START = date(2024, 1, 1)


def entity_costs(
    entity: str, open_rows: DataFrame, postings: DataFrame, invoices: DataFrame, month: date
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Row cost and ledger cost per entity in a month, and the entities that have a non-void invoice."""
    day = F.lit(dates.month_start(month))
    row_cost = (
        open_rows.filter((F.col("invoice_date") == day) & F.col(entity).isNotNull())
        .groupBy(entity)
        .agg(F.sum("cost_total").alias("_row_cost"))
    )
    ledger_cost = (
        postings.filter(dates.in_month(F.col("transaction_date"), month) & F.col(entity).isNotNull())
        .groupBy(entity)
        .agg((F.sum("credit") - F.sum("debit")).alias("_ledger_cost"))
    )
    invoiced = (
        invoices.filter((F.col("status") != "Void") & (F.col("invoice_date") == day) & F.col(entity).isNotNull())
        .select(entity)
        .distinct()
    )
    return row_cost, ledger_cost, invoiced


def _uninvoiced(
    entities: DataFrame, entity: str, open_rows: DataFrame, postings: DataFrame, invoices: DataFrame, month: date
) -> DataFrame:
    """Entities with a cost that is not zero and no invoice. A row cost of 0 hides the ledger cost."""
    row_cost, ledger_cost, invoiced = entity_costs(entity, open_rows, postings, invoices, month)
    cost = F.coalesce("_row_cost", "_ledger_cost", F.lit(0))
    return (
        entities.join(row_cost, entity, "left")
        .join(ledger_cost, entity, "left")
        .filter(cost != 0)
        .join(invoiced, entity, "left_anti")
        .withColumn("cost", cost)
        .withColumn("invoice_date", F.lit(dates.month_start(month)))
        .drop("_row_cost", "_ledger_cost")
    )


def missing_partner_invoices(
    partners: DataFrame, open_rows: DataFrame, postings: DataFrame, invoices: DataFrame, month: date
) -> DataFrame:
    """Partners with costs in a month and no invoice, without deleted, test, root and house accounts."""
    eligible = partners.filter(
        ~F.col("deleted")
        & ~F.col("test_partner")
        & ~F.col("is_root_partner")
        & F.col("auto_invoice_enabled")
        & ~F.col("is_house_account")
    ).select(
        F.col("id").alias("partner_id"), F.col("name").alias("partner_name"), "payment_day", "is_invoice_dirty",
        "currency_id",
    )
    return _uninvoiced(eligible, "partner_id", open_rows, postings, invoices, month)


def missing_company_invoices(
    companies: DataFrame,
    partners: DataFrame,
    open_rows: DataFrame,
    postings: DataFrame,
    invoices: DataFrame,
    month: date,
) -> DataFrame:
    """Bill-on-behalf companies with costs in a month and no invoice; an unknown telco flag counts as no."""
    eligible = companies.filter(
        (F.col("status") != "Deleted")
        & F.col("bill_on_behalf_of_enabled")
        & ~F.coalesce("is_telco", F.lit(False))
    ).select(
        F.col("id").alias("company_id"), F.col("name").alias("company_name"), "partner_id", "payment_day",
        "is_invoice_dirty", "currency_id",
    )
    owners = partners.select(F.col("id").alias("partner_id"), F.col("name").alias("partner_name"))
    return _uninvoiced(eligible, "company_id", open_rows, postings, invoices, month).join(owners, "partner_id")


def anniversary(rows: DataFrame, products: DataFrame, key: str = "product_id", product_key: str = "id") -> DataFrame:
    """Rows of products that bill on their anniversary."""
    kept = products.filter("anniversary_billing").select(F.col(product_key).alias(key))
    return rows.join(kept, key, "left_semi")


def invoice_bundle(tables: dict[str, DataFrame], invoices: DataFrame, since: date = HISTORY_START) -> dict[str, DataFrame]:
    """Everything an invoice check looks at, for all given invoices at once.

    `invoices` holds the headers to check: one, a month of them or all. The first four frames carry
    `invoice_id`; the partner-wide ones are limited to the partners of the invoices.
    """
    products = tables["product"]
    lines = anniversary(tables["csv_invoice_row_archive"], products)
    subscriptions = anniversary(tables["subscription"], products)
    transactions = tables["order_manager_transaction"].join(
        products.select(F.col("uuid").alias("product_uuid"), "anniversary_billing"), "product_uuid"
    )
    items = anniversary(tables["completed_line_item"], products)
    chosen = invoices.select(F.col("id").alias("invoice_id"))
    owners = invoices.filter(F.col("partner_id").isNotNull()).select("partner_id").distinct()
    on_invoice = lines.join(chosen, "invoice_id", "left_semi")
    links = on_invoice.select("invoice_id", F.col("completed_line_item_id").alias("_item"))
    item_keys = items.select(F.col("id").alias("_item"), F.col("guid").alias("completed_line_item_id"))
    all_item_keys = tables["completed_line_item"].select(
        F.col("id").alias("_item"), F.col("guid").alias("completed_line_item_id")
    )
    partner_guids = (
        tables["partner"].join(owners, F.col("id") == F.col("partner_id"), "left_semi").select(F.col("guid").alias("partner_id"))
    )
    orders = tables["completed_order"].join(owners, "partner_id", "left_semi").select(
        F.col("id").alias("completed_order_id")
    )
    return {
        "invoice": invoices,
        "invoice_line_items": on_invoice,
        "subscriptions": subscriptions.join(
            links, F.col("completed_line_id") == F.col("_item")
        ).drop("_item"),
        "transactions": transactions.join(all_item_keys, "completed_line_item_id").join(links, "_item").drop("_item"),
        "completed_line_items": items.join(links, F.col("id") == F.col("_item")).drop("_item"),
        "partner_line_items": lines.filter(F.col("created_dt") >= F.lit(since)).join(owners, "partner_id", "left_semi"),
        "partner_subscriptions": subscriptions.filter(F.col("created_dt") >= F.lit(since)).join(
            owners, "partner_id", "left_semi"
        ),
        "partner_transactions": transactions.filter(
            F.col("anniversary_billing") & (F.col("order_date") >= F.lit(since))
        ).join(partner_guids, "partner_id", "left_semi"),
        "partner_completed_line_items": items.filter(F.col("created_dt") >= F.lit(since)).join(
            orders, "completed_order_id", "left_semi"
        ),
    }


def billable_items(
    subscriptions: DataFrame, items: DataFrame, month: date, version: Sequence[str] = ("id",)
) -> DataFrame:
    """Items that may bill in a month: monthly term, linked from a valid subscription.

    Valid: active, quantity above zero, commitment not ended before the month. An item id that occurs
    more than once counts as its last version. Keys may be text or numbers.
    """
    linked = (
        subscriptions.filter(subscription_is_valid(month))
        .select(F.col("completed_line_id").try_cast("bigint").alias("item_id"))
        .filter(F.col("item_id").isNotNull())
        .distinct()
    )
    return last_versions(items, version).filter(F.col("term_in_months") == 1).join(linked, "item_id", "left_semi").select("item_id")


def subscription_is_valid(month: date) -> Column:
    ends = F.col("commitment_term_end_date").try_cast("date")
    return (
        (F.lower("status") == "active")
        & (F.col("quantity").try_cast("decimal(18,4)") > 0)
        & (ends >= F.lit(dates.month_start(month)))
    )


def last_versions(items: DataFrame, version: Sequence[str]) -> DataFrame:
    """One row per numeric item id, the last by `version`; ids that are not numbers drop out."""
    keyed = items.withColumn("item_id", F.col("id").try_cast("bigint")).filter(F.col("item_id").isNotNull())
    row = F.struct("guid", F.col("term_in_months").try_cast("int").alias("term_in_months"))
    return keyed.groupBy("item_id").agg(F.max_by(row, F.struct(*version)).alias("_row")).select("item_id", "_row.*")


def item_flags(
    subscriptions: DataFrame,
    items: DataFrame,
    transactions: DataFrame,
    invoice_lines: DataFrame,
    month: date,
    version: Sequence[str] = ("id",),
    url_base: str = "",
) -> DataFrame:
    """Per potentially billable item: is it on an invoice, should it bill, is there a transaction.

    `invoice_lines` are the lines of the invoices under review. Transactions are linked through the
    item's guid. The subscription shown is the newest one linked to the item, and decides whether the
    item should bill.
    """
    candidates = last_versions(items, version).join(
        billable_items(subscriptions, items, month, version), "item_id", "left_semi"
    )
    newest = subscriptions.groupBy(F.col("completed_line_id").try_cast("bigint").alias("item_id")).agg(
        F.max_by(
            F.struct(
                F.col("id").alias("subscription_id"),
                "original_subscription_id",
                F.col("status").alias("sub_status"),
                F.col("quantity").alias("sub_quantity"),
                F.col("commitment_term_end_date").alias("sub_commitment_end"),
                subscription_is_valid(month).alias("_valid"),
            ),
            "id",
        ).alias("_sub")
    )
    first_line = invoice_lines.groupBy(F.col("completed_line_item_id").try_cast("bigint").alias("item_id")).agg(
        F.max_by(
            F.struct(
                F.col("line_item_id").alias("invoice_row_id"),
                F.col("total").alias("invoice_row_total"),
                F.col("start_period").alias("invoice_row_start_period"),
                F.col("end_period").alias("invoice_row_end_period"),
            ),
            "line_item_id",
        ).alias("_line")
    )
    in_period = (
        transactions.filter(dates.in_month(F.col("start_period").try_cast("date"), month))
        .select(F.col("completed_line_item_id").alias("guid"))
        .distinct()
        .withColumn("_has_transaction", F.lit(True))
    )
    joined = (
        candidates.join(newest, "item_id").join(first_line, "item_id", "left").join(in_period, "guid", "left")
    )
    return joined.select(
        F.col("_line").isNotNull().alias("cli_in_invoice"),
        (F.coalesce("_sub._valid", F.lit(False)) & (F.col("term_in_months") == 1)).alias("cli_should_be_billable"),
        F.coalesce("_has_transaction", F.lit(False)).alias("has_transaction_for_period"),
        F.col("item_id").alias("cli_id"),
        "_sub.subscription_id",
        labels.entity_url(url_base, F.col("_sub.subscription_id")).alias("subscription_url"),
        "_sub.original_subscription_id",
        labels.entity_url(url_base, F.col("_sub.original_subscription_id")).alias("original_subscription_url"),
        "_line.invoice_row_id",
        "_sub.sub_status",
        "_sub.sub_quantity",
        F.col("term_in_months").alias("cli_term_in_months"),
        "_sub.sub_commitment_end",
        "_line.invoice_row_total",
        "_line.invoice_row_start_period",
        "_line.invoice_row_end_period",
    )


def match_flag(rows: DataFrame, other: DataFrame, column: str, flag: str = "is_matched") -> DataFrame:
    """Flag rows whose key also occurs in the other frame; keys are compared as text."""
    keys = other.select(F.col(column).cast("string").alias("_key")).filter("_key is not null").distinct()
    joined = rows.join(keys, rows[column].cast("string") == F.col("_key"), "left")
    return joined.withColumn(flag, F.col("_key").isNotNull()).drop("_key")


def not_on(rows: DataFrame, other: DataFrame, column: str) -> DataFrame:
    """Rows whose key does not occur in the other frame; keys are compared as text."""
    keys = other.select(F.col(column).cast("string").alias("_key")).filter("_key is not null").distinct()
    return rows.join(keys, rows[column].cast("string") == F.col("_key"), "left_anti")


def transaction_stats(transactions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct transaction ids and repeats per key."""
    ids = transactions.groupBy(*keys, "transaction_id").agg(F.count(F.lit(1)).alias("_rows"))
    return ids.groupBy(*keys).agg(
        F.sum("_rows").alias("total_transactions"),
        F.count("transaction_id").alias("distinct_transaction_ids"),
        (F.sum("_rows") - F.count("transaction_id")).alias("duplicate_transactions"),
    )


def month_distribution(transactions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return transactions.groupBy(
        *keys, F.year("invoice_date").alias("year"), F.month("invoice_date").alias("month")
    ).agg(F.count(F.lit(1)).alias("transaction_count"))


def first_matching_row(rows: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each numeric key; keys that are not numbers drop out."""
    keyed = rows.withColumn("_key", F.col(key).try_cast("decimal(38,0)")).filter("_key is not null")
    picked = keyed.groupBy("_key").agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return picked.select("_row.*")
