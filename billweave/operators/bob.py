"""Bill-on-behalf assessment: partner invoice, customer invoice, payment postings and settlements."""

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from billweave.functions import dates
from billweave.functions.numbers import usd

COMPANY_MONTH = ["invoice_date", "partner_id", "company_id"]
PARTNER_MONTH = ["invoice_date", "partner_id"]
ZERO = "decimal(18,4)"
SHARES = 16  # into which the settlements of a partner-month are cut


def _zero() -> Column:
    return F.lit(0).cast(ZERO)


def assessment(lines: DataFrame, bob_invoices: DataFrame, postings: DataFrame, partner_invoices: DataFrame) -> DataFrame:
    """Partner charges per company and month against the company's own invoice and its payments.

    lines: the partner invoice lines; a line without company is a surcharge of the partner's invoice.
    bob_invoices: company invoices with bob_invoice_id, bob_invoice_status, total_with_tax, tax.
    postings: ledger entries with type, company_id, partner_id, invoice_id, id, credit, transaction_date.
    partner_invoices: invoice_date, partner_id, id, status; the newest of a partner and month is shown.

    The net is the customer total before tax minus the partner total and the billing fee. A posting
    failed when a paid customer invoice has no payment posted.
    """
    has_company = F.col("company_id").isNotNull()
    sums = lines.groupBy(*COMPANY_MONTH).agg(
        F.sum("cost_total").alias("partner_invoice_partner_total"), F.sum("billing_fee").alias("partner_billing_fee")
    )
    # a partner-month has one row of surcharges beside a row per company: the window runs over sums, and lines are read once
    surcharge = F.sum(F.when(~has_company, F.col("partner_invoice_partner_total"))).over(Window.partitionBy(*PARTNER_MONTH))
    charges = sums.withColumn("partner_surcharge_total", surcharge).filter(has_company)
    customers = bob_invoices.groupBy(*COMPANY_MONTH).agg(
        F.max("bob_invoice_id").alias("bob_invoice_id"),
        F.max_by("bob_invoice_status", "bob_invoice_id").alias("bob_invoice_status"),
        F.sum("total_with_tax").alias("bob_customer_total_with_tax"),
        F.sum("tax").alias("bob_tax_withholding"),
    )
    own = partner_invoices.groupBy(*PARTNER_MONTH).agg(
        F.max("id").alias("partner_invoice_id"), F.max_by("status", "id").alias("partner_invoice_status")
    )
    payments = (
        postings.filter(F.col("type") == "BOB_CUSTOMER_PAYMENT")
        .groupBy(F.col("invoice_id").cast("string").alias("_paid"))
        .agg(
            F.min("id").alias("bob_payment_id"),
            F.min("transaction_date").alias("bob_payment_posting_date"),
            F.sum("credit").alias("bob_payment_credit"),
            F.min_by("description", "id").alias("bob_payment_description"),
            (F.count(F.lit(1)) - 1).alias("bob_payment_duplicate_count"),
        )
    )
    joined = (
        charges.join(own, PARTNER_MONTH, "left")
        .join(customers, COMPANY_MONTH, "left")
        # companies without an invoice of their own get keys of their own, so they do not gather in one task
        .withColumn("_paid", F.coalesce(F.col("bob_invoice_id").cast("string"), F.concat_ws(" ", F.lit("none"), *COMPANY_MONTH)))
        .join(payments, "_paid", "left")
    )
    partner_total, fee = F.col("partner_invoice_partner_total"), F.col("partner_billing_fee")
    customer_total, tax = F.col("bob_customer_total_with_tax"), F.col("bob_tax_withholding")
    net = customer_total - tax - partner_total - fee
    is_paid = F.col("bob_invoice_status") == "Paid"
    return joined.select(
        *COMPANY_MONTH,
        "partner_invoice_id",
        "partner_invoice_status",
        F.when(F.col("bob_invoice_id").isNotNull(), "Company Invoice").otherwise("Non-BOB").alias("invoice_type"),
        "bob_invoice_id",
        "bob_invoice_status",
        "partner_invoice_partner_total",
        "partner_billing_fee",
        F.coalesce("partner_surcharge_total", _zero()).alias("partner_surcharge_total"),
        "bob_customer_total_with_tax",
        (customer_total - partner_total).alias("partner_net_after_customer_total"),
        net.alias("partner_net_after_billing_fee_and_taxes"),
        "bob_tax_withholding",
        "bob_payment_posting_date",
        "bob_payment_credit",
        "bob_payment_id",
        "bob_payment_description",
        F.coalesce("bob_payment_duplicate_count", F.lit(0)).cast("bigint").alias("bob_payment_duplicate_count"),
        F.when(is_paid, net).alias("expected_partner_bob_ledger_payment"),
        F.coalesce(is_paid & F.col("bob_payment_id").isNull(), F.lit(False)).alias("partner_bob_failed_posting"),
    )


def summary(rows: DataFrame, partner_invoices: DataFrame, postings: DataFrame) -> DataFrame:
    """Assessment per partner and month with the partner's settlements; one row per settlement posting.

    Settlements are CHECK_ISSUED postings of the month; more than one per partner and month are
    flagged as duplicates. Counts come from aggregates joined back, not from a window over postings.
    """
    failed, paid = F.col("partner_bob_failed_posting"), F.col("bob_invoice_status") == "Paid"
    expected = F.col("expected_partner_bob_ledger_payment")
    totals = rows.groupBy(*PARTNER_MONTH).agg(
        F.count(F.lit(1)).alias("company_count"),
        F.count_if(F.col("bob_invoice_id").isNotNull()).alias("bob_company_count"),
        F.count_if(paid).alias("bob_invoice_paid_count"),
        F.coalesce(F.sum("bob_payment_credit"), _zero()).alias("bob_payment_partner_ledger_total"),
        F.coalesce(F.sum("partner_net_after_billing_fee_and_taxes"), _zero()).alias(
            "partner_net_after_billing_fee_and_taxes"
        ),
        F.count_if(failed).alias("bob_payment_failed_posting_count"),
        F.coalesce(F.sum(F.when(failed, expected)), _zero()).alias("bob_payment_failed_posting_total"),
        F.count_if(F.col("bob_payment_duplicate_count") > 0).alias("bob_with_duplicate_payment_posting"),
    )
    balances = partner_invoices.groupBy(*PARTNER_MONTH).agg(
        F.sum("balance").alias("invoice_balance"),
        F.sum(usd(F.col("balance"), F.col("currency_code"))).alias("invoice_balance_usd"),
    )
    settlements = postings.filter(F.col("type") == "CHECK_ISSUED").withColumn(
        "invoice_date", dates.month_of(F.col("transaction_date"))
    )
    counts = settlements.groupBy(*PARTNER_MONTH).agg(
        (F.count(F.lit(1)) > 1).alias("ledger_duplicate_present")
    )
    details = settlements.select(
        *PARTNER_MONTH,
        F.col("id").alias("ledger_id"),
        F.col("transaction_date").alias("ledger_transaction_date"),
        F.col("description").alias("ledger_description"),
        F.col("debit").alias("ledger_debit"),
        usd(F.col("debit"), F.col("currency_code")).alias("ledger_debit_usd"),
    )
    per_partner = totals.join(balances, PARTNER_MONTH, "left").join(counts, PARTNER_MONTH, "left")
    settled = F.col("ledger_duplicate_present").isNotNull()
    # one join, with the postings of a partner-month in shares: many of them do not gather in one task, and the assessment is made once
    shares = F.when(settled, F.sequence(F.lit(0), F.lit(SHARES - 1))).otherwise(F.array(F.lit(0)))
    spread = per_partner.withColumn("_share", F.explode(shares))
    placed = details.withColumn("_share", F.pmod(F.xxhash64("ledger_id"), F.lit(SHARES)).cast("int")).withColumn("_found", F.lit(True))
    joined = spread.join(placed, [*PARTNER_MONTH, "_share"], "left").filter(F.col("_found").isNotNull() | ~settled)
    return joined.withColumn("ledger_duplicate_present", F.coalesce("ledger_duplicate_present", F.lit(False))).drop("_share", "_found")


def in_range(rows: DataFrame, start: date | None, end: date | None, partner_id: int | None = None) -> DataFrame:
    kept = rows.filter(dates.within(F.col("invoice_date"), start, end))
    return kept if partner_id is None else kept.filter(F.col("partner_id") == partner_id)


def headline(summary_rows: DataFrame, start: date, end: date, partner_id: int | None = None) -> DataFrame:
    """Sums over the summary rows of a date range, for all partners or one.

    A partner-month has a row per settlement, so what belongs to the partner-month is taken once, and settlements are added up.
    """
    once = [
        "company_count", "bob_company_count", "bob_invoice_paid_count", "bob_payment_partner_ledger_total",
        "bob_payment_failed_posting_count", "partner_net_after_billing_fee_and_taxes",
        "bob_with_duplicate_payment_posting",
    ]
    per_month = in_range(summary_rows, start, end, partner_id).groupBy(*PARTNER_MONTH).agg(
        *[F.max(c).alias(c) for c in once],
        F.sum("ledger_debit").alias("ledger_debit"),
        F.count_if("ledger_duplicate_present").alias("settlement_duplicate_count"),
    )
    return per_month.agg(*[F.sum(c).alias(c) for c in (*once, "ledger_debit", "settlement_duplicate_count")])


def failed_postings(rows: DataFrame, as_of: date) -> DataFrame:
    """Failed payment postings from the start of the year up to `as_of`."""
    return rows.filter(F.col("partner_bob_failed_posting") & dates.within(F.col("invoice_date"), as_of.replace(month=1, day=1), as_of))


def duplicate_settlements(summary_rows: DataFrame, as_of: date, open_end: bool = False) -> DataFrame:
    """Settlements of partner-months with more than one of them, from the start of the year up to `as_of`, or with no end."""
    year = dates.within(F.col("invoice_date"), as_of.replace(month=1, day=1), None if open_end else as_of)
    return summary_rows.filter(F.col("ledger_duplicate_present") & year)
