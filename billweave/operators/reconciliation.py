"""What an invoice has and what it misses: counts per invoice, and the missing subscriptions, transactions and lines as rows.

No row is ever paired with all invoices or all rows of its partner. Facts of all kinds are united and added up per key once; what is
missing is a pattern of bits of a key, and headers, lines and details meet by keys only.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from billweave.functions import dates

# What is known about a key of a partner (and month), one bit each.
ON_INVOICE, OF_KIND, DUE = 1, 2, 4


def _text_key(column: str, otherwise: str) -> Column:
    """A key as text; rows without one get a key of their own that matches nothing, so they never gather in one task."""
    return F.coalesce(F.col(column).cast("string"), F.concat(F.lit("none of "), F.col(otherwise).cast("string")))


def _headers(invoices: DataFrame) -> DataFrame:
    return invoices.select("invoice_id", "partner_id", dates.month_of(F.col("invoice_date")).alias("invoice_month"))


def missing_rows(
    invoices: DataFrame, lines: DataFrame, rows: DataFrame, key: str, line_key: str, due: Column, month: Column | None = None, keyless: bool = False
) -> DataFrame:
    """The rows of a kind that are `due` but whose key is on none of the given invoices of their partner and `month`.

    invoices: invoice_id, partner_id, invoice_date; lines: invoice_id and `line_key`; rows: partner_id, `key` and details. Without `month` a
    partner's invoices of all months count. Where no invoice of the partner (and month) holds any row of the kind, there is no basis to compare
    and nothing is reported. Rows without key are left out, or with `keyless` always missing. Given one invoice, this is what that
    invoice misses. Rows whose `due` is unknown are not due. Repeated rows are reported as often as they are there.
    """
    by = ["_partner", "_month"]
    at = F.lit("").alias("_month") if month is None else month.cast("string").alias("_month")
    headers = _headers(invoices).filter("partner_id IS NOT NULL")
    header_at = F.lit("").alias("_month") if month is None else F.col("invoice_month").cast("string").alias("_month")
    rows = rows.select("*", F.col("partner_id").cast("string").alias("_partner"), at, F.col(key).cast("string").alias("_key"))
    is_due = F.coalesce(due, F.lit(False))
    on_invoice = (
        lines.select("invoice_id", F.col(line_key).cast("string").alias("_key"))
        .join(headers, "invoice_id")
        .select(F.col("partner_id").cast("string").alias("_partner"), header_at, "_key", F.lit(ON_INVOICE).alias("_bits"))
    )
    of_kind = rows.select(*by, "_key", F.when(is_due, F.lit(OF_KIND | DUE)).otherwise(F.lit(OF_KIND)).alias("_bits"))
    facts = on_invoice.unionByName(of_kind).filter("_key IS NOT NULL").groupBy(*by, "_key").agg(F.bit_or("_bits").alias("_bits"))
    # a line shows a kind when its key has a row of it anywhere: with another partner or in another month too
    anywhere = F.bit_or("_bits").over(Window.partitionBy("_key"))
    facts = facts.withColumn("_shows", (F.col("_bits").bitwiseAND(ON_INVOICE) > 0) & (anywhere.bitwiseAND(OF_KIND) > 0))
    basis = facts.filter("_shows").select(*by).distinct()
    # asking for keys that show nothing says nothing new, but lets both readers of the facts share one shuffle
    missing = facts.filter((F.col("_bits").bitwiseAND(ON_INVOICE | DUE) == DUE) & ~F.col("_shows")).select(*by, "_key")
    found = rows.filter(is_due).join(missing, [*by, "_key"], "left_semi")
    if keyless:
        found = found.unionByName(rows.filter(is_due & F.col("_key").isNull()))
    return found.join(basis, by, "left_semi").drop("_partner", "_month", "_key")


def missing_subscriptions(invoices: DataFrame, lines: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Active subscriptions whose billing cycle starts in a month and whose item is on no invoice of their partner in that month."""
    return missing_rows(
        invoices, lines, subscriptions, "completed_line_id", "completed_line_item_id",
        due=F.lower("status") == "active", month=dates.month_of(F.col("billing_cycle_start")),
    )


def missing_transactions(invoices: DataFrame, lines: DataFrame, transactions: DataFrame) -> DataFrame:
    """Transactions of a month whose item is on no invoice of their partner in that month; those without item are on none."""
    return missing_rows(
        invoices, lines, transactions, "completed_line_item_id", "completed_line_item_id",
        due=F.lit(True), month=dates.month_of(F.col("invoice_date")), keyless=True,
    )


def missing_lines(invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """A partner's lines that are on none of its given invoices, if these have any lines."""
    return missing_rows(invoices, lines, lines, "line_id", "line_id", due=F.lit(True))


def _item_facts(subscriptions: DataFrame, transactions: DataFrame) -> DataFrame:
    """(_item, _at, subs, rows, due, here): what an item has anywhere (_at is empty) and with one partner in one month (_at names them)."""
    cycle, active = dates.month_of(F.col("billing_cycle_start")), F.coalesce(F.lower("status") == "active", F.lit(False))
    no, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    place = F.concat_ws("|", F.col("_owner").cast("string"), F.col("_month").cast("string"))
    subs = subscriptions.select(
        F.col("completed_line_id").cast("string").alias("_item"), F.col("partner_id").alias("_owner"), cycle.alias("_month"),
        one.alias("subs"), no.alias("rows"), active.cast("bigint").alias("due"),
    )
    moves = transactions.select(
        F.col("completed_line_item_id").cast("string").alias("_item"), F.col("partner_id").alias("_owner"),
        dates.month_of(F.col("invoice_date")).alias("_month"), no.alias("subs"), one.alias("rows"), no.alias("due"),
    )
    facts = subs.unionByName(moves).filter("_item IS NOT NULL").groupBy("_item", "_owner", "_month").agg(
        F.sum("subs").alias("subs"), F.sum("rows").alias("rows"), F.max("due").alias("due")
    )
    anywhere = F.struct(F.lit("").alias("_at"), "subs", "rows", no.alias("due"), no.alias("here"))
    there = F.struct(place.alias("_at"), no.alias("subs"), no.alias("rows"), "due", F.col("rows").alias("here"))
    known = F.col("_owner").isNotNull() & F.col("_month").isNotNull()
    both = facts.select("_item", F.explode(F.when(known, F.array(anywhere, there)).otherwise(F.array(anywhere))).alias("_fact"))
    kinds = ("subs", "rows", "due", "here")
    return both.select("_item", "_fact.*").groupBy("_item", "_at").agg(*(F.sum(k).alias(k) for k in kinds))


def reconcile_invoices(invoices: DataFrame, lines: DataFrame, subscriptions: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row per invoice: its counts, billing period and how much of the partner's activity it misses.

    invoices: invoice_id, partner_id, invoice_date. lines: line_id (of one item each), invoice_id, partner_id,
    completed_line_item_id, start_period, end_period. subscriptions: partner_id, completed_line_id,
    status, billing_cycle_start. transactions: partner_id, completed_line_item_id, invoice_date; a
    transaction is on an invoice when its item is.

    What is missing is counted as the partner's total minus the part found on the invoice. Every line asks twice what is known about its
    item: anywhere, and with the invoice's partner in its month.
    """
    headers = _headers(invoices).withColumn("_partner", _text_key("partner_id", "invoice_id"))
    place = F.concat(F.col("partner_id").cast("string"), F.lit("|"), F.col("invoice_month").cast("string"))
    per_item = lines.groupBy("invoice_id", "completed_line_item_id").agg(
        F.count(F.lit(1)).alias("_lines"), F.count_distinct("line_id").alias("_ids"),
        F.min("start_period").alias("_start"), F.max("end_period").alias("_end"),
    )
    asking = per_item.withColumn("_item", _text_key("completed_line_item_id", "invoice_id")).join(
        headers.select("invoice_id", place.alias("_place")), "invoice_id"
    )
    asking = asking.withColumn("_at", F.explode(F.array(F.lit(""), F.col("_place"))))
    once = F.col("_at") == ""
    per_invoice = (
        asking.join(_item_facts(subscriptions, transactions), ["_item", "_at"], "left")
        .groupBy("invoice_id")
        .agg(
            F.sum(F.when(once, F.col("_lines"))).alias("line_count"),
            F.sum(F.when(once, F.col("_ids"))).alias("_invoice_line_ids"),
            F.min("_start").alias("billing_period_start"),
            F.max("_end").alias("billing_period_end"),
            F.sum(F.col("_lines") * F.col("subs")).alias("subscription_count"),
            F.sum(F.col("_lines") * F.col("rows")).alias("transaction_count"),
            F.sum("due").alias("_due_found"),
            F.sum("here").alias("_tx_in_month_found"),
        )
    )
    active = F.lower("status") == "active"
    owner, cycle = F.col("partner_id").cast("string").alias("_partner"), dates.month_of(F.col("billing_cycle_start")).alias("invoice_month")
    due_totals = subscriptions.filter(active).groupBy(owner, cycle).agg(F.count_distinct("completed_line_id").alias("_due"))
    tx_totals = transactions.groupBy(owner, dates.month_of(F.col("invoice_date")).alias("invoice_month")).agg(F.count(F.lit(1)).alias("_tx_in_month"))
    partner_lines = lines.groupBy(owner).agg(F.count_distinct("line_id").alias("_partner_line_ids"))
    partner_subs = subscriptions.groupBy(owner).agg(
        F.count(F.lit(1)).alias("partner_subscriptions"), F.count_if(active).alias("active_subscriptions")
    )
    # a partner's total of a month counts for the month and for the partner as a whole, which has no month
    month = F.col("invoice_month").cast("string")
    whens = F.when(month.isNotNull(), F.array(F.lit(""), month)).otherwise(F.array(F.lit("")))
    tx_months = tx_totals.select("_partner", F.explode(whens).alias("_when"), "_tx_in_month").groupBy("_partner", "_when").agg(
        F.sum("_tx_in_month").alias("_tx")
    )
    due_months = due_totals.select("_partner", month.alias("_when"), "_due")
    totals = (
        headers.select("invoice_id", "_partner", F.explode(F.array(month, F.lit(""))).alias("_when"))
        .join(tx_months, ["_partner", "_when"], "left")
        .join(due_months, ["_partner", "_when"], "left")
        .groupBy("invoice_id")
        .agg(
            F.sum(F.when(F.col("_when") != "", F.col("_tx"))).alias("_tx_in_month"),
            F.sum(F.when(F.col("_when") == "", F.col("_tx"))).alias("partner_transactions"),
            F.sum("_due").alias("_due"),
        )
    )
    joined = (
        headers.join(per_invoice, "invoice_id", "left")
        .join(totals, "invoice_id", "left")
        .join(partner_lines, "_partner", "left")
        .join(partner_subs, "_partner", "left")
    )

    def n(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0)).cast("bigint")

    def missing(total: str, part: str, present: str) -> Column:
        # nothing of the kind on the invoice: there is no basis to compare, so nothing is reported
        return F.when(n(present) > 0, n(total) - n(part)).otherwise(F.lit(0)).cast("bigint")

    counts: Sequence[str] = ("line_count", "subscription_count", "transaction_count")
    return joined.select(
        "invoice_id",
        "partner_id",
        "invoice_month",
        *(n(c).alias(c) for c in counts),
        "billing_period_start",
        "billing_period_end",
        n("_partner_line_ids").alias("partner_line_items"),
        n("partner_subscriptions").alias("partner_subscriptions"),
        n("active_subscriptions").alias("active_subscriptions"),
        n("partner_transactions").alias("partner_transactions"),
        n("_due").alias("should_be_in_invoice"),
        missing("_due", "_due_found", "subscription_count").alias("missing_subscriptions"),
        missing("_tx_in_month", "_tx_in_month_found", "transaction_count").alias("missing_transactions"),
        missing("_partner_line_ids", "_invoice_line_ids", "line_count").alias("missing_line_items"),
    )
