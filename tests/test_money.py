import random
from datetime import date, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from billweave.functions import numbers
from billweave.operators import bob, charges, exports, extracts, kpi, reconcile, revenue, subscriptions
from tests.conftest import rows_of

JUNE = date(2024, 6, 1)


def test_unknown_currency_counts_as_one(frame):
    df = frame([("EUR", 10), ("VND", 1_000_000), ("XYZ", 10), (None, 10)], "c string, a decimal(18,2)")
    got = [r[0] for r in df.select(numbers.usd(F.col("a"), F.col("c"))).collect()]
    assert got == [Decimal("10.7"), Decimal("43"), Decimal("10"), Decimal("10")]


def test_prior_months_are_matched_by_date(frame):
    df = frame(
        [("EU", "2024-03-01", 3), ("EU", "2024-06-01", 6), ("EU", "2024-05-01", 5)], "region string, m date, n long"
    )
    got = kpi.with_prior_months(df, ["region"], "m", ["n"])
    assert rows_of(got.filter("m = '2024-06-01'"), "n_current_month", "n_1_month_prior", "n_2_months_prior", "n_diff_current_month") == [(6, 5, None, 1)]
    assert rows_of(got.filter("m = '2024-05-01'"), "n_1_month_prior", "n_2_months_prior") == [(None, 3)]
    assert got.count() == 3  # April and July have no row of their own


def invoices(frame):
    rows = [
        (1, "2024-06-01", 1, None, 1, "Paid", True, True, 10),
        (2, "2024-06-01", None, 11, 1, "Void", True, True, 20),
        (3, "2024-06-01", 2, 11, 9, "Paid", False, False, 30),
        (4, "2024-06-01", None, None, 1, "Paid", None, True, 40),
    ]
    ddl = """id long, invoice_date date, partner_id long, company_id long, currency_id long, status string,
        is_email_sent boolean, approved boolean, balance decimal(18,2)"""
    return frame(rows, ddl).withColumn("business_unit_code", F.lit("EU"))


def test_release_details_and_crosstab(frame):
    currencies = frame([(1, "EUR"), (9, "XYZ")], "id long, api_code string")
    partners = frame([(1, "P1"), (2, "P2")], "id long, name string")
    companies = frame([(11, 2)], "id long, partner_id long")
    details = kpi.release_details(invoices(frame), currencies, partners, companies, JUNE)
    assert rows_of(details, "id", "invoice_audience", "partner_name", "release_status") == [
        (1, "Partner Invoice", "P1", "Released"),
        (2, "Company Invoice", "P2", "Released"),
        (3, "Partner Invoice", "P2", "Held - Needs Review"),
        (4, "Unknown", None, "Unknown Status"),
    ]
    table = kpi.release_crosstab(details)
    assert rows_of(table, "business_unit_code", "released", "void", "unknown_status", "held_needs_review_partners", "total") == [
        ("EU", 1, 1, 1, 1, 4), ("Total", 1, 1, 1, 1, 4),
    ]
    rows = kpi.balances(invoices(frame).withColumn("currency_code", F.lit("EUR")), JUNE)
    split = kpi.balance_split(rows).filter("business_unit_code = 'Total'")
    assert rows_of(split, "balance_usd", "email_sent_usd", "not_approved_usd") == [(42.8, 10.7, 32.1)]


def test_two_month_counts_have_a_partner_and_a_company_side(frame):
    row = kpi.two_month_counts(invoices(frame), JUNE).first()
    assert (row["company_invoice_count"], row["partner_invoice_count"], row["total_invoice_count"]) == (0, 2, 3)


def test_missing_partner_invoices(frame):
    flags = "deleted boolean, test_partner boolean, is_root_partner boolean, is_house_account boolean, auto_invoice_enabled boolean"
    no = (False, False, False, False, True)
    partners = frame(
        [(i, f"P{i}", *(no if i < 8 else tuple(j == i - 8 for j in range(4)) + (i != 12,))) for i in range(1, 13)],
        f"id long, name string, {flags}",
    ).select("*", F.lit(1).alias("payment_day"), F.lit(False).alias("is_invoice_dirty"), F.lit(1).alias("currency_id"))
    open_rows = frame(
        [(1, 100, "2024-06-01"), (2, 0, "2024-06-01"), (4, 5, "2024-06-01"), (5, 5, "2024-06-01"), (None, 7, "2024-06-01"),
         (7, 9, "2024-05-01"), *[(i, 1, "2024-06-01") for i in range(8, 13)]],
        "partner_id long, cost_total decimal(18,2), invoice_date date",
    )
    ledger = frame(
        [(2, 50, 0, "2024-06-10"), (3, 10, 30, "2024-06-30"), (6, 5, 5, "2024-06-02"), (7, 5, 0, "2024-07-01")],
        "partner_id long, credit decimal(18,2), debit decimal(18,2), transaction_date date",
    )
    invoiced = frame(
        [(4, "Paid", "2024-06-01"), (5, "Void", "2024-06-01"), (None, "Paid", "2024-06-01"), (1, "Paid", "2024-05-01")],
        "partner_id long, status string, invoice_date date",
    )
    got = reconcile.missing_partner_invoices(partners, open_rows, ledger, invoiced, JUNE)
    # 2: a row cost of 0 hides the ledger; 4 is invoiced; 5's invoice is void; 6 nets to 0; 7 is another month; 8.. excluded
    assert [(r[0], int(r[1])) for r in rows_of(got, "partner_id", "cost")] == [(1, 100), (3, -20), (5, 5)]


SUBS = """id long, original_subscription_id long, completed_line_id string, status string, quantity string,
    commitment_term_end_date date"""


def test_billable_items_and_flags(frame):
    subs = frame(
        [(1, 1, "10", "Active", "2", "2024-06-01"), (2, 1, "11", "active", "0", "2025-01-01"), (3, 1, "12", "ACTIVE", "1", "2024-05-31"),
         (4, 1, "13", "Active", "1", "2025-01-01"), (5, 1, "x", "Active", "1", "2025-01-01"), (6, 1, "14", "Cancelled", "1", "2025-01-01"),
         (7, 1, "15", "Active", "1", None), (8, 9, "10", "Cancelled", "3", "2025-01-01")],
        SUBS,
    )
    items = frame(
        [("10", "g10", "12", 1), ("10", "g10", "1", 2), ("11", "g11", "1", 1), ("12", "g12", "1", 1), ("13", "g13", "12", 1),
         ("14", "g14", "1", 1), ("15", "g15", "1", 1), ("bad", "g", "1", 1)],
        "id string, guid string, term_in_months string, version int",
    )
    assert rows_of(reconcile.billable_items(subs, items, JUNE, ["version"])) == [(10,)]
    transactions = frame([("g10", "2024-06-15"), ("10", "2024-06-15"), ("g10", "2024-07-01")], "completed_line_item_id string, start_period date")
    lines = frame([(5, "10", 9.5, "2024-06-01", "2024-06-30")], "line_item_id long, completed_line_item_id string, total double, start_period date, end_period date")
    row = reconcile.item_flags(subs, items, transactions, lines, JUNE, ["version"], "u/").first()
    # the newest linked subscription is cancelled, so the item should not bill although an older one passed
    assert (row["cli_in_invoice"], row["cli_should_be_billable"], row["has_transaction_for_period"]) == (True, False, True)
    assert (row["subscription_url"], row["invoice_row_id"]) == ("u/8", 5)
    # transactions carry guids: a plain item id does not match
    only_ids = reconcile.item_flags(subs, items, transactions.filter("completed_line_item_id = '10'"), lines, JUNE, ["version"])
    assert not only_ids.first()["has_transaction_for_period"]


def test_keys_match_as_text(frame):
    left = frame([(1,), (2,), (None,)], "k long")
    right = frame([("1",), ("x",)], "k string")
    assert rows_of(reconcile.match_flag(left, right, "k")) == [(1, True), (2, False), (None, False)]
    assert rows_of(reconcile.not_on(left, right, "k")) == [(2,), (None,)]
    first = reconcile.first_matching_row(frame([("7", 2), ("7", 1), ("a", 3)], "k string, n int"), "k", [F.col("n")])
    assert rows_of(first) == [("7", 1)]


def test_duplicates_count_copies(frame):
    ddl = "invoice_id long, item long, quantity int, amount decimal(18,2), line_id long"
    rows = [(1, 1, 1, 5, 1), (1, 1, 1, 5, 2), (1, 1, 1, 5, 3), (1, 1, 2, 5, 4), (2, 1, 1, 5, 5), (2, 2, 1, 5, 6), (2, 2, 1, 5, 7)]
    df = frame(rows, ddl)
    keys = ["invoice_id", "item", "quantity", "amount"]
    got = charges.duplicate_lines(df, ["line_id"], keys)
    assert rows_of(got, "line_id", "line_row_number", "line_duplicate_count") == [(2, 2, 3), (3, 3, 3), (7, 2, 2)]
    assert got.count() == df.count() - df.select(*keys).distinct().count()


@pytest.mark.parametrize(
    "term, start, end, month, expected",
    [
        ("Monthly", "2022-07-15", None, "2024-03-01", "2024-03-01"),
        ("Annual", "2022-07-01", None, "2024-03-01", "2024-07-01"),
        ("Annual", "2022-07-15", None, "2024-03-01", "2024-08-01"),
        ("Annual", "2022-07-15", "2025-02-01", "2024-03-01", "2024-02-01"),
        ("Annual", "2022-07-15", "2025-06-17", "2024-03-01", "2024-07-01"),
        ("Annual", "2022-07-15", "2023-12-20", "2024-03-01", "2024-01-01"),
    ],
)
def test_renewal_months(frame, term, start, end, month, expected):
    df = frame([(term, start, end, month)], "t string, s date, e date, m date")
    got = df.select(charges.renewal_month(F.col("t"), F.col("s"), F.col("e"), F.col("m"))).first()[0]
    assert got == date.fromisoformat(expected)


def test_active_months_carry_forward_and_end(frame):
    versions = frame(
        [(1, 7, 1, "A", "Monthly", 5, "2024-01-10", None), (2, 7, 3, "A", "Annual", 5, "2024-03-05", "2024-05-20"),
         (3, 8, 1, "A", "Monthly", 5, "2024-04-01", None)],
        "id long, original_subscription_id long, quantity int, status string, term string, price decimal(18,2), start_date date, end_date date",
    ).select("*", F.lit(1).alias("product_id"), F.lit(1).alias("completed_line_id"))
    changed = charges.modifications(versions)
    assert rows_of(changed.filter("prior_id is not null"), "id", "quantity_delta", "term_changed", "price_changed") == [(2, 2, True, False)]
    months = charges.active_months(changed, JUNE, ["quantity"])
    assert rows_of(months, "original_subscription_id", "transaction_month", "latest_id_in_month", "is_cancelled", "modifications") == [
        (7, date(2024, 1, 1), 1, False, 0), (7, date(2024, 2, 1), 1, False, 0), (7, date(2024, 3, 1), 2, False, 1),
        (7, date(2024, 4, 1), 2, False, 0), (7, date(2024, 5, 1), 2, True, 0),
        (8, date(2024, 4, 1), 3, False, 0), (8, date(2024, 5, 1), 3, False, 0), (8, date(2024, 6, 1), 3, False, 0),
    ]
    late = charges.active_months(changed, JUNE, ["quantity"], since=date(2024, 5, 15))
    assert rows_of(late) == rows_of(months.filter("transaction_month >= '2024-05-01'"))


def test_projection_states_and_summary(frame):
    due = frame([(1, "2024-06-01", 2, 10), (2, "2024-06-01", 1, 10), (3, "2024-06-01", 1, 10)],
                "original_subscription_id long, transaction_month date, quantity int, unit_price decimal(18,2)")
    due = due.select("*", *[F.col("original_subscription_id").alias(c) for c in ("product_id", "partner_id", "company_id")]).select(
        "*", (F.col("original_subscription_id") == 3).alias("is_direct_company"), (F.col("unit_price") - 1).alias("partner_buy_rate"),
        F.lit("EUR").alias("currency_code"),
    )
    lines = frame([(1, "2024-06-01", "prorate", 4, 5, False), (2, "2024-06-01", "subscription", 9, 11, False),
                   (3, "2024-06-01", "subscription", 9, 11, True)],
                  """original_subscription_id long, invoice_date date, row_type string, cost_total decimal(18,2), total decimal(18,2),
                  is_bill_on_behalf boolean""")
    orders = frame([(1, "2024-06-01", True, True, False, False)],
                   """original_subscription_id long, transaction_month date, order_full_term boolean, order_prorate boolean,
                   manual_full_term boolean, manual_prorate boolean""")
    posted = frame([(3, "2024-06-01", 1, 5)], "original_subscription_id long, transaction_month date, charge_count long, debit decimal(18,2)")
    rows = charges.projection(due, charges.month_charges(lines), orders, posted)
    assert rows_of(rows, "original_subscription_id", "line_status", "prorate_status", "ledger_status") == [
        (1, "Missing", "Matched Prorate", "No Service Charges"), (2, "Matched", "No Prorates", "No Service Charges"),
        (3, "Missing", "No Prorates", "Service Charges"),
    ]
    named = charges.missing_charges(rows)
    assert rows_of(named, "original_subscription_id", "state") == [(1, "Missing on invoice, matched in orders, with prorates, no service charges")]
    summary = charges.missing_summary(rows)
    # the partner of 1 pays its buy rate, 3 is a direct company and pays the retail price
    assert [int(v) for v in summary.select("missing_subscription_count", "missed_revenue", "service_charges_posted").first()] == [2, 28, 5]
    assert [float(v) for v in summary.select("missed_revenue_usd", "service_charges_posted_usd").first()] == [29.96, 5.35]
    totals = rows_of(rows, "original_subscription_id", "full_term_customer_total", "prorate_customer_total", "net_missed_revenue")
    assert [[float(v) for v in r] for r in totals] == [[1, 0, 5, 14], [2, 11, 0, 0], [3, 0, 0, 10]]
    empty = charges.summary_for(summary, date(2024, 1, 1)).first()
    assert empty["missing_partner_count"] == 0 and empty["missed_revenue"] == 0


def test_hierarchy_totals(frame):
    df = frame([("p", "c", "x", 1), ("p", "c", "y", 2), ("p", "d", "x", 4), (None, "e", "x", 8)], "p string, c string, i string, a long")
    got = charges.hierarchy_totals(df, ["p", "c", "i"], "a", "i")
    assert rows_of(got, "p", "c", "i", "total_amount", "c_total", "p_total") == [
        ("p", "c", "x", 1, 3, 7), ("p", "c", "y", 2, 3, 7), ("p", "d", "x", 4, 4, 7), (None, "e", "x", 8, 8, 8)
    ]


LEDGER = "kind string, partner long, company long, cost decimal(18,4), quantity int, name string"


def test_ledger_upload_signs(frame):
    df = frame(
        [("Partner", 1, 2, "10.005", 3, "C"), ("Bill on Behalf", 1, 2, "-4", None, None), ("Partner", 1, 2, 0, 1, "C"),
         ("Partner", 1, 2, None, 1, "C"), ("Else", 1, 2, 9, 1, "C")],
        LEDGER,
    )

    def upload(method):
        return exports.ledger_upload(
            df, "kind", "Partner", "Bill on Behalf", "cost", "cost", method, date(2024, 6, 20), "Adj", partner_id="partner",
            company_id="company", company_name="name", quantity="quantity",
        )

    missed = rows_of(upload("missed_billing"), "Partner ID", "Company ID", "Type", "Credit", "Debit", "Transaction Date", "Description")
    assert missed == [
        (1, 2, "SERVICE_CHARGE", None, Decimal("10.01"), "2024-06-01", "Adj for Company: C and Product: N/A at a quantity of 3"),
        (None, 2, "SERVICE_CREDIT", Decimal("4.00"), None, "2024-06-01", "Adj for Company: N/A and Product: N/A at a quantity of N/A"),
    ]
    assert rows_of(upload("duplicate_billing"), "Type", "Credit", "Debit") == [
        ("SERVICE_CHARGE", None, Decimal("4.00")), ("SERVICE_CREDIT", Decimal("10.01"), None),
    ]
    assert len(upload("missed_billing").columns) == 17
    with pytest.raises(ValueError):
        upload("other")


def test_order_upload_validates_and_keeps_the_first(frame):
    columns = exports.ORDER_UPLOAD_INPUT
    values = {c: "x" for c in columns} | {
        "actual_retail_price": "1.23456", "current_subscription_quantity": "3", "partner_buy_rate": "bad", "wholesale_buy_rate": "1",
        "successor_subscription_start_date": "2024-01-05", "estimated_billing_start_period": "2024-06-01",
        "estimated_billing_end_period": "2024-06-30", "transaction_month": "2024-06-01", "successor_commitment_term_end_date": "2025-01-01",
    }
    rows = [tuple((values | {"transaction_month": m})[c] for c in columns) for m in ("2024-07-01", "2024-06-01")]
    df = frame(rows, ", ".join(f"{c} string" for c in columns))
    upload = exports.order_upload(df, [F.col("transaction_month")], "Market")
    assert len(upload.columns) == 37
    row = upload.collect()
    assert len(row) == 1 and row[0]["invoiceDate"] == "2024-06-01"
    assert (row[0]["price"], row[0]["total"], row[0]["cost"]) == (Decimal("1.2346"), Decimal("3.7037"), None)
    with pytest.raises(ValueError, match="currency_guid"):
        exports.order_upload(df.drop("currency_guid"), [F.col("transaction_month")])


def test_bob_failed_and_duplicate_postings(frame):
    lines = frame(
        [("2024-06-01", 1, 10, 50, 1), ("2024-06-01", 1, 11, 50, 1), ("2024-06-01", 1, 12, 20, 0), ("2024-06-01", 1, None, 7, 0)],
        "invoice_date date, partner_id long, company_id long, cost_total decimal(18,2), billing_fee decimal(18,2)",
    )
    customers = frame(
        [("2024-06-01", 1, 10, 100, "Paid", 110, 10), ("2024-06-01", 1, 11, 101, "Paid", 90, 5)],
        """invoice_date date, partner_id long, company_id long, bob_invoice_id long, bob_invoice_status string,
        total_with_tax decimal(18,2), tax decimal(18,2)""",
    )
    postings = frame(
        [(1, "BOB_CUSTOMER_PAYMENT", 1, 100, 40, 0, "2024-06-09"), (2, "BOB_CUSTOMER_PAYMENT", 1, 100, 40, 0, "2024-06-08"),
         (3, "CHECK_ISSUED", 1, None, 0, 30, "2024-06-10"), (4, "CHECK_ISSUED", 1, None, 0, 30, "2024-06-11"),
         (5, "OTHER", 1, 101, 1, 0, "2024-06-11")],
        "id long, type string, partner_id long, invoice_id long, credit decimal(18,2), debit decimal(18,2), transaction_date date",
    ).select("*", F.lit("d").alias("description"), F.lit("EUR").alias("currency_code"))
    own = frame([("2024-06-01", 1, 7, "Paid"), ("2024-06-01", 1, 9, "Unpaid"), ("2024-05-01", 1, 99, "Paid")],
                "invoice_date date, partner_id long, id long, status string")
    rows = bob.assessment(lines, customers, postings, own)
    assert rows_of(rows.select("partner_invoice_id", "partner_invoice_status").distinct()) == [(9, "Unpaid")]
    got = rows_of(rows, "company_id", "invoice_type", "bob_payment_duplicate_count", "partner_bob_failed_posting")
    assert got == [(10, "Company Invoice", 1, False), (11, "Company Invoice", 0, True), (12, "Non-BOB", 0, False)]
    net = rows.filter("company_id = 10").first()
    assert (net["partner_net_after_customer_total"], net["partner_net_after_billing_fee_and_taxes"], net["partner_surcharge_total"]) == (60, 49, 7)
    invoices_ = frame([("2024-06-01", 1, 127, "EUR")], "invoice_date date, partner_id long, balance decimal(18,2), currency_code string")
    summary = bob.summary(rows, invoices_, postings)
    assert rows_of(summary, "ledger_id", "ledger_duplicate_present", "company_count", "bob_company_count") == [(3, True, 3, 2), (4, True, 3, 2)]
    headline = bob.headline(summary, date(2024, 1, 1), date(2024, 12, 31), partner_id=1).first()
    assert (headline["settlement_duplicate_count"], int(headline["ledger_debit"])) == (2, 60)
    assert bob.failed_postings(rows, date(2024, 8, 1)).count() == 1
    assert bob.failed_postings(rows, date(2025, 1, 1)).count() == 0
    assert bob.failed_postings(rows, date(2024, 5, 31)).count() == 0 == bob.duplicate_settlements(summary, date(2024, 5, 31)).count()
    assert bob.duplicate_settlements(summary, date(2024, 8, 1)).count() == 2


def test_choose_lines_dispatches_on_type(frame):
    inv, subs = frame([(1, "A")], "id long, alternate_id string"), frame([(5,)], "id long")
    for value, n in ((1, 1), ("A", 1), ("B", 0)):
        assert subscriptions.choose_lines(inv, subs, invoice_id=value)[0].count() == n
    assert subscriptions.choose_lines(inv, subs, subscription_id=6)[1].count() == 0
    for bad in ({}, {"invoice_id": 1.5}, {"subscription_id": "5"}):
        with pytest.raises(ValueError):
            subscriptions.choose_lines(inv, subs, **bad)


def test_related_subscriptions_pairs_and_carry(frame):
    details = frame([(1, 7), (2, 7), (3, 7), (4, 8)], "id long, original_subscription_id long")
    tasks = frame(
        [(1, 1, "ScheduledInstruction", '{"coTermDate": "a"}'), (2, 1, "ScheduledInstruction", '{"coTermDate": "b"}'),
         (3, 2, "ScheduledInstruction", '{"coTermDate": "c"}'), (4, 3, "Other", '{"coTermDate": "z"}'), (5, 4, "ScheduledInstruction", "bad")],
        "id long, subscription_id long, type string, additional_params string",
    ).withColumn("status", F.lit("done"))
    latest = subscriptions.latest_instructions(tasks)
    pairs = subscriptions.related_subscriptions(details, latest, 7)
    assert rows_of(pairs, "id", "co_term_date") == [(1, "b"), (2, "b"), (2, "c"), (3, "b"), (3, "c")]
    carried = subscriptions.with_latest_co_term(details, latest)
    assert rows_of(carried, "id", "co_term_date") == [(1, "b"), (2, "c"), (3, "c"), (4, None)]


def test_revenue_variance_skips_void_lines_in_both_branches(frame):
    lines = frame(
        [(1, 100, "2024-04-01", 10, 2, False), (1, None, "2024-05-01", 0, 2, False), (1, None, "2024-06-01", 30, 3, False),
         (None, 100, "2024-06-01", 30, 3, False), (1, None, "2024-06-01", 500, 1, True), (None, 100, "2024-06-01", 500, 1, True)],
        """arrears_subscription_id long, completed_line_item_id long, invoice_date date, total decimal(18,2), quantity long,
        is_voided boolean""",
    )
    subs = frame([(1, 100)], "id long, completed_line_id long")
    monthly = subscriptions.monthly_revenue(lines, subs)
    assert [(str(r[0]), int(r[1])) for r in rows_of(monthly, "invoice_month", "total_revenue")] == [
        ("2024-04-01", 10), ("2024-05-01", 0), ("2024-06-01", 60)
    ]
    got = subscriptions.revenue_variance(monthly)
    assert rows_of(got, "invoice_month", "revenue_variance_pct", "quantity_variance_pct") == [
        (date(2024, 4, 1), None, None), (date(2024, 5, 1), -100.0, 0.0), (date(2024, 6, 1), None, 200.0),
    ]
    assert subscriptions.revenue_variance(monthly, months=2).count() == 2


def test_recent_change_flag_and_sort(frame):
    df = frame(
        [(1, "error", None, True, None, "2024-01-01", 5), (2, "ok", "2024-05-01", False, "2024-07-01", "2024-02-01", 6),
         (3, "ok", "2024-04-30", False, "2024-05-01", "2024-03-01", 7)],
        """id long, status string, rate_plan_start_date date, has_arrears boolean, end_date date, start_date date,
        partner_total decimal(18,2)""",
    )
    assert rows_of(subscriptions.recent_change_flag(df, date(2024, 6, 15)), "id", "highlight") == [(1, "error"), (2, "recent change"), (3, None)]
    assert [r["id"] for r in subscriptions.sorted_subscriptions(df, date(2024, 6, 15)).collect()] == [1, 2, 3]


def test_filters_keep_all_on_none(frame):
    df = frame([("a", 0), ("b", 1)], "k string, missed_revenue_usd long")
    assert extracts.only(df, "k", None).count() == extracts.only(df, "k", "All").count() == 2
    assert extracts.only_in(df, "k", []).count() == 2 and extracts.only_in(df, "k", ["a"]).count() == 1
    assert rows_of(extracts.facets(df, {"k": "All"}, "No Revenue Impact"), "k") == [("a",)]
    assert rows_of(extracts.facets(df, {"k": ["b"]}, "Revenue Impact"), "k") == [("b",)]
    with pytest.raises(ValueError):
        extracts.facets(df, {}, "other")


def test_co_terms_of_long_chains_equal_all_pairs(spark):
    """A chain that holds most versions is cut into many ranges; every date still reaches all later versions."""
    chain = F.when(F.col("id") % 5 == 0, F.col("id") % 7).otherwise(F.lit(99))
    versions = spark.range(600).select("id", chain.alias("original_subscription_id"))
    instructions = versions.filter("id % 11 = 0").select(
        F.col("id").alias("subscription_id"), F.when(F.col("id") % 3 != 0, (F.col("id") % 8).cast("string")).alias("co_term_date")
    )
    rows = {r["id"]: r["original_subscription_id"] for r in versions.collect()}
    dates_of = [(rows[r["subscription_id"]], r["subscription_id"], r["co_term_date"]) for r in instructions.collect()]
    want = sorted({(i, d) for i, c in rows.items() for o, first, d in dates_of if o == c and i >= first}, key=repr)
    for ranges in (1, 6, 50):
        assert rows_of(subscriptions.co_terms(versions, instructions, ranges)) == want
    starts = {}
    for o, first, d in dates_of:
        starts[o, d] = min(first, starts.get((o, d), first))
    assert rows_of(subscriptions.valid_from(versions, instructions)) == sorted(((o, d, f) for (o, d), f in starts.items()), key=repr)


def test_duplicates_are_searched_among_anniversary_charges_since_the_cutover(frame):
    lines = frame(
        [(1, 7, "subscription", "2024-12-01"), (2, 7, "prorate", "2025-01-01"), (3, 7, "arrears", "2025-01-01"),
         (4, 8, "subscription", "2025-01-01"), (5, 7, "subscription", "2024-11-01"), (6, None, "subscription", "2025-01-01")],
        "line_id long, product_id long, transaction_type string, invoice_date date",
    )
    products = frame([(7, True), (8, False)], "product_id long, anniversary_billing boolean")
    assert rows_of(charges.charged_lines(lines, products), "line_id") == [(1,), (2,)]


def test_nothing_after_as_of_counts(spark, frame):
    """Rows dated after the moment asked for are in no result."""
    lines = frame(
        [(1, 1, 5, 10, 8, "2024-06-01", False, "USD"), (2, 1, 5, 10, 8, "2024-07-01", False, "USD")],
        """id long, partner_id long, product_id long, total decimal(12,2), cost_total decimal(12,2), invoice_date date, is_voided boolean,
        currency_code string""",
    )
    partners = spark.createDataFrame([(1, "u", "p")], "id long, business_unit_guid string, name string")
    units = spark.createDataFrame([("u", "U", "U")], "uuid string, unique_code string, name string")
    products = spark.createDataFrame([(5, "v", "n")], "id long, vendor string, name string")
    assert rows_of(revenue.line_usd_details(lines, partners, units, products, date(2024, 6, 20)), "id") == [(1,)]
    items = frame(
        [(1, 1, "t", 10, 1, "2024-06-30", False), (2, 1, "t", 10, 1, "2024-07-01", False)],
        """arrears_subscription_id long, currency_id long, type string, gross_revenue decimal(18,4), quantity long, provision_start date,
        voided boolean""",
    )
    subs = frame([(1, 1, 1, 5, "Active", None, None), (2, 2, 1, 5, "Active", None, None)],
                 "id long, original_subscription_id long, partner_id long, product_id long, status string, start_date date, end_date date")
    currencies = spark.createDataFrame([(1, "USD")], "id long, api_code string")
    none = spark.createDataFrame([], "product_id long, arrears_product_usage_configuration_id long")
    conf = spark.createDataFrame([], "id long, billing_day_of_month int")
    usage = revenue.usage_variance(items, subs, partners, products, units, currencies, none, conf, date(2024, 6, 20))
    assert rows_of(usage, "arrears_subscription_id") == [(1,)]
    variance = revenue.arrears_variance(items, subs, partners, products, units, currencies, date(2024, 6, 20)).collect()
    assert [r["usd_current_month_gross_revenue"] for r in variance] == [10.0]


def test_sweep_equals_the_months_of_every_subscription(spark):
    """Sums by a sweep line against one row per subscription and month, with hot partners, gaps and cancellations."""
    chance = random.Random(3)
    start = date(2023, 1, 1)
    rows = []
    for k in range(160):
        day = start + timedelta(days=chance.randrange(500))
        end = day + timedelta(days=chance.randrange(1, 300)) if chance.random() < 0.4 else None
        rows.append((k, chance.randrange(45), chance.choice([1, 1, 1, 2, 3, None]), chance.randrange(9), "Active", chance.randrange(9), "Monthly",
                     Decimal(chance.randrange(50)), day, end, k % 3))
    versions = spark.createDataFrame(
        rows,
        """id long, original_subscription_id long, partner_id long, company_id long, status string, quantity long, term string,
        price decimal(18,2), start_date date, end_date date, product_id long""",
    ).withColumn("completed_line_id", F.col("id"))
    changed = charges.modifications(versions)
    for as_of, since in ((date(2024, 8, 1), None), (date(2024, 1, 1), date(2023, 9, 1)), (date(2022, 1, 1), None)):
        carry = ["partner_id", "company_id", "product_id"]
        months = charges.active_months(changed, as_of, carry, since)
        spans = charges.active_spans(changed, as_of, carry, since)
        for keys in ([], ["product_id"]):
            want = subscriptions.overview(months, ["transaction_month", *keys])
            got = subscriptions.overview_of_spans(spans, keys)
            assert rows_of(got, *want.columns) == rows_of(want)
    assert want.count() == 0 < subscriptions.overview(charges.active_months(changed, date(2024, 8, 1), carry)).count()


def test_line_details_with_an_open_end(spark, frame):
    lines = frame(
        [(k, 1, 5, 10, 8, day, False, "USD") for k, day in enumerate(("2024-05-19", "2024-05-20", "2024-06-20", "2024-07-01"))],
        """id long, partner_id long, product_id long, total decimal(12,2), cost_total decimal(12,2), invoice_date date, is_voided boolean,
        currency_code string""",
    )
    partners = spark.createDataFrame([(1, "u")], "id long, business_unit_guid string")
    units = spark.createDataFrame([("u", "U")], "uuid string, unique_code string")
    products = spark.createDataFrame([(5, "v")], "id long, vendor string")
    rows = revenue.line_usd_details(lines, partners, units, products, date(2024, 6, 20), open_end=True)
    assert rows_of(rows, "id") == [(1,), (2,), (3,)]


def usage_inputs(spark, frame):
    items = frame(
        [(1, 1, "t", 10, 1, "2024-06-30", False), (2, 1, "t", 10, 1, "2024-07-01", False), (3, 1, "t", 10, 1, "2023-11-30", False)],
        """arrears_subscription_id long, currency_id long, type string, gross_revenue decimal(18,4), quantity long, provision_start date,
        voided boolean""",
    )
    subs = frame([(k, k, k, 5, "Active", None, None) for k in (1, 2, 3)],
                 "id long, original_subscription_id long, partner_id long, product_id long, status string, start_date date, end_date date")
    partners = spark.createDataFrame([(k, f"u{k}", "p") for k in (1, 2, 3)], "id long, business_unit_guid string, name string")
    units = spark.createDataFrame([(f"u{k}", f"U{k}", f"U{k}") for k in (1, 2, 3)], "uuid string, unique_code string, name string")
    products = spark.createDataFrame([(5, "v", "n")], "id long, vendor string, name string")
    return items, subs, partners, products, units, spark.createDataFrame([(1, "USD")], "id long, api_code string")


def test_usage_variance_with_an_open_end(spark, frame):
    """A subscription used after the month only is listed, with months without revenue."""
    none = spark.createDataFrame([], "product_id long, arrears_product_usage_configuration_id long")
    conf = spark.createDataFrame([], "id long, billing_day_of_month int")
    usage = revenue.usage_variance(*usage_inputs(spark, frame), none, conf, date(2024, 6, 20), open_end=True)
    assert rows_of(usage, "arrears_subscription_id", "usd_current_month_revenue") == [(1, 10), (2, 0)]


def test_arrears_variance_with_an_open_end(spark, frame):
    variance = revenue.arrears_variance(*usage_inputs(spark, frame), date(2024, 6, 20), open_end=True)
    assert rows_of(variance, "business_unit", "usd_current_month_gross_revenue") == [("U1", 10.0), ("U2", 0.0)]


def test_duplicate_settlements_with_an_open_end(frame):
    rows = frame(
        [(1, "2023-12-01", True), (2, "2024-01-01", True), (3, "2024-05-01", False), (4, "2024-09-01", True)],
        "id long, invoice_date date, ledger_duplicate_present boolean",
    )
    assert rows_of(bob.duplicate_settlements(rows, date(2024, 6, 1), open_end=True), "id") == [(2,), (4,)]


def scans(df, column):
    """How many times the plan reads the input table with this column."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(1 for line in plan.splitlines() if ("LogicalRDD" in line or "LocalRelation" in line) and f"{column}#" in line)


def test_settlements_of_a_partner_month_are_listed_from_one_assessment(frame):
    """Many settlements in one month, one in another, none in a third, and rows without keys."""
    rows = frame(
        [("2024-01-01", 1, 10, "Paid", 5, 4, 5, False, 0), ("2024-02-01", 1, None, None, None, None, None, False, 0),
         ("2024-01-01", 2, None, None, None, None, None, False, 0), (None, None, None, None, None, None, None, False, 0)],
        """invoice_date date, partner_id long, bob_invoice_id long, bob_invoice_status string, bob_payment_credit decimal(18,4),
        partner_net_after_billing_fee_and_taxes decimal(18,4), expected_partner_bob_ledger_payment decimal(18,4),
        partner_bob_failed_posting boolean, bob_payment_duplicate_count long""",
    )
    invoices = frame([("2024-01-01", 1, 7, "USD")], "invoice_date date, partner_id long, balance decimal(18,4), currency_code string")
    postings = frame(
        [(k, 1, "CHECK_ISSUED", "2024-01-09", "d", k, "USD") for k in range(40)] + [(50, 1, "CHECK_ISSUED", "2024-02-09", "d", 1, "USD"),
         (None, 1, "CHECK_ISSUED", "2024-02-09", "d", 1, "USD"), (51, 2, "OTHER", "2024-01-09", "d", 1, "USD"),
         (52, 1, "CHECK_ISSUED", "2024-03-09", "d", 1, "USD"), (53, None, "CHECK_ISSUED", None, "d", 1, "USD")],
        "id long, partner_id long, type string, transaction_date date, description string, debit decimal(18,4), currency_code string",
    )
    got = bob.summary(rows, invoices, postings)
    january, february = date(2024, 1, 1), date(2024, 2, 1)
    want = [(january, 1, k, True) for k in range(40)] + [(february, 1, 50, True), (february, 1, None, True), (january, 2, None, False)]
    assert rows_of(got, "invoice_date", "partner_id", "ledger_id", "ledger_duplicate_present") == sorted(
        [*want, (None, None, None, False)], key=repr
    )
    assert scans(got, "bob_payment_credit") == 1


def test_subscription_lines_join_names_and_plans_once(spark, frame):
    """Arrears lines are summed, copies of one-off lines are dropped, void lines and lines of unknown invoices too."""
    lines = frame(
        [(1, None, 5, 2, "1.004", 3, False), (1, None, 5, 2, "1.004", 3, False), (9, 100, 5, 2, "1.004", 3, False), (9, 100, 5, 2, "1.004", 3, False),
         (1, 100, 6, 4, 1, 3, False), (1, 100, 7, 8, 1, 3, False), (1, 100, 5, 16, 1, 3, True), (2, None, 5, 32, 1, 3, False)],
        """completed_line_item_id long, arrears_subscription_id long, invoice_id long, quantity long, cost_total decimal(18,4),
        total decimal(18,4), is_voided boolean""",
    ).selectExpr("*", "date'2024-01-01' invoice_date", "7L product_id", "'x' row_type")
    subs = spark.createDataFrame([(100, 1), (200, 9)], "id long, completed_line_id long").selectExpr(
        "*", "'Active' status", "date'2023-01-01' start_date", "cast(null as date) end_date")
    items = spark.createDataFrame([(1, 1, "t", 3), (9, 1, "t", 3), (2, 1, "t", 3)], "id long, term_in_months int, type string, rate_plan_id long")
    plans = frame([(3, 4, "2024-01-01", None)], "id long, user_id long, start_date date, end_date date")
    users = spark.createDataFrame([(4, "A", "B")], "id long, first_name string, last_name string")
    owners = spark.createDataFrame([(5, "P", "C", False), (6, "P", "C", False)],
                                   "invoice_id long, partner_name string, company_name string, bill_on_behalf_indicator boolean")
    invoices = spark.createDataFrame([(5,), (5,), (6,)], "id long")
    want = [(100, False, 2, 1), (100, False, 4, 1), (100, True, 8, 3), (200, False, 2, 1)]
    for got in (
        subscriptions.invoice_subscriptions(lines, subs, items, invoices, plans, users, owners),
        subscriptions.invoice_subscriptions(lines.join(owners, "invoice_id"), subs, items, invoices, plans, users),
    ):
        assert rows_of(got, "id", "has_arrears", "quantity", F.col("partner_total").cast("int")) == want
        assert scans(got, "user_id") == 1
