"""Statements for the subscription drill-down and extracts."""

from oracle.charge_statements import _MONTHS
from oracle.views import count, money, percent, ratio, statement

_ITEMS = """
items AS (
    SELECT id, x.product_id AS product_id, x.supplier_id AS rate_plan_id, x.type AS type, x.term_in_months AS term_in_months,
        x.quantity AS quantity, x.total AS total, x.gross_revenue AS gross_revenue
    FROM (SELECT id, arg_max(c, (product_id, supplier_id, total, quantity)) AS x FROM cli c GROUP BY id)
)"""

_LINES = (
    _ITEMS
    + """,
plans AS (
    SELECT s_suppkey AS rp, DATE '2000-04-01' + CAST(s_suppkey AS INTEGER) AS rs,
        CASE WHEN s_acctbal < 0 THEN DATE '2001-01-01' END AS re, 'User ' || n_name AS rc
    FROM supplier JOIN nation ON n_nationkey = s_nationkey
),
billed AS (
    SELECT l.*, i.term_in_months, i.type, rp, rs, re, rc, round(l.cost_total, 2) AS pt, l.total AS ct, order_status = 'P' AS bob
    FROM owned_line l JOIN items i ON i.id = l.completed_line_item_id JOIN plans ON rp = i.rate_plan_id WHERE NOT is_voided
),
uni AS (
    SELECT s.id, s.status AS sub_status, b.invoice_date, s.start_date, s.end_date, partner_name, company_name, b.product_id, row_type,
        term_in_months, bob AS bill_on_behalf_indicator, b.type AS completed_line_item_type, rp AS rate_plan_id,
        rs AS rate_plan_start_date, re AS rate_plan_end_date, rc AS rate_plan_creator, CAST(sum(b.quantity) AS BIGINT) AS quantity,
        sum(pt) AS partner_total, sum(ct) AS customer_total, true AS has_arrears
    FROM billed b JOIN subscription s ON s.id = b.arrears_subscription_id GROUP BY ALL
    UNION ALL
    SELECT DISTINCT s.id, s.status, b.invoice_date, s.start_date, s.end_date, partner_name, company_name, b.product_id, row_type,
        term_in_months, bob, b.type, rp, rs, re, rc, b.quantity, pt, ct, false
    FROM billed b JOIN subscription s ON s.completed_line_id = b.completed_line_item_id
)"""
)

_METRICS = (
    _ITEMS
    + """,
met AS (
    SELECT s.*, DATE '2000-06-01' - s.start_date AS days_active, i.term_in_months, i.gross_revenue,
        i.gross_revenue * 10000 AS gross_units
    FROM subscription s LEFT JOIN items i ON i.id = s.completed_line_id
)"""
)

_OWN = (
    _MONTHS
    + """,
om AS (SELECT months.*, a.partner_id, p.vendor FROM months JOIN accounts a ON a.company_id = months.company_id
    JOIN product p ON p.id = months.product_id)"""
)


def _overview(source: str, *keys: str) -> str:
    return f"""SELECT {', '.join(keys)}, count(DISTINCT partner_id) AS partner_count, count(DISTINCT company_id) AS company_count,
        {count('NOT is_cancelled')} AS active_subscription_count, {count('is_cancelled')} AS cancelled_subscription_count,
        {count('is_new')} - {count('is_cancelled')} AS net_new_subscription_count,
        CAST(sum(product_changes) AS BIGINT) AS total_product_changes, CAST(sum(term_changes) AS BIGINT) AS total_renewals,
        CAST(sum(modifications) AS BIGINT) AS total_modifications, CAST(sum(quantity_delta) AS BIGINT) AS total_quantity_change,
        CAST(sum(price_changes) AS BIGINT) AS total_partner_buy_rate_changes, {money('sum(price_delta)')} AS total_price_change
    FROM {source} GROUP BY {', '.join(keys)}"""


def _own(body: str) -> str:
    return statement(body, "subscription", "accounts", "product", extra=_OWN)


def _trend(where: str) -> str:
    return f"""SELECT c.transaction_month, s.* EXCLUDE (transaction_month)
        FROM (SELECT DISTINCT transaction_month FROM om
            WHERE transaction_month <= DATE '2000-06-01' AND transaction_month > DATE '1999-12-01') c
        LEFT JOIN ({_overview(f'(SELECT * FROM om WHERE {where})', 'transaction_month')}) s
            ON s.transaction_month = c.transaction_month"""


_VARIANCE = """
pairs AS (
    SELECT DISTINCT s.id AS subscription_id, l.id AS line_id, l.invoice_date AS invoice_month, l.total, l.quantity,
        l.line_number, l.return_flag, l.cost_total, l.billing_fee, l.line_status
    FROM line l JOIN subscription s ON s.id = l.invoice_id
        AND (l.arrears_subscription_id = s.id OR l.completed_line_item_id = s.completed_line_id)
    WHERE NOT is_voided
),
ms AS (SELECT subscription_id, invoice_month, sum(total) AS r, CAST(sum(quantity) AS BIGINT) AS q FROM pairs GROUP BY ALL),
mr AS (SELECT *, row_number() OVER (PARTITION BY subscription_id ORDER BY invoice_month DESC) AS n FROM ms),
lg AS (
    SELECT *, lag(r) OVER w AS pr, lag(q) OVER w AS pq FROM mr WHERE n <= 6
    WINDOW w AS (PARTITION BY subscription_id ORDER BY invoice_month)
)"""


def _pct(a: str, b: str) -> str:
    # adding zero turns a negative zero, which only one engine produces, into zero
    return f"round(({a} - {b}) / nullif({b}, 0) * 100, 3) + 0.0"


_D = "CAST({} AS DOUBLE)"

_CO_TERMS = """
told AS (
    SELECT event_id // 2 AS sid, arg_max(json_extract_string(props, '$.k'), event_id) AS co_term_date FROM events
    WHERE event_type IN ('view', 'click') GROUP BY ALL
),
coterm AS (
    SELECT s.original_subscription_id AS o, co_term_date, min(s.id) AS first FROM told JOIN subscription s ON s.id = sid GROUP BY ALL
)"""

STATEMENTS = {
    "subscription_lines": statement(
        f"""SELECT * REPLACE ({money('partner_total')} AS partner_total, {money('customer_total')} AS customer_total),
            {money('customer_total - partner_total')} AS partner_profit,
            round(CAST(customer_total - partner_total AS DOUBLE) / nullif(CAST(customer_total AS DOUBLE), 0), 2) * 100 AS partner_margin,
            CASE WHEN rate_plan_start_date >= DATE '2000-05-01' THEN 'recent change' END AS highlight FROM uni""",
        "owned_line", "subscription", "cli",
        extra=_LINES,
    ),
    "sorted_subscription_lines": statement(
        f"""SELECT id, has_arrears, start_date, end_date, {money('partner_total')} AS partner_total FROM uni
        ORDER BY has_arrears DESC, CASE WHEN end_date IS NULL OR end_date > DATE '2000-06-01' THEN 0 ELSE 1 END,
            start_date DESC NULLS FIRST, partner_total DESC NULLS FIRST, id LIMIT 40""",
        "owned_line", "subscription", "cli",
        extra=_LINES,
    ),
    "chosen_invoice_lines": statement(
        "SELECT 'INV-7' AS alternate_id, id, product_id, quantity FROM line JOIN orders ON o_orderkey = invoice_id WHERE invoice_id = 7", "line"
    ),
    "csv_extract": statement(
        """SELECT id, alternate_id, invoice_date, status, CAST(total AS DOUBLE) AS total FROM invoice
        WHERE invoice_date = DATE '2000-06-01'""",
        "invoice",
    ),
    "related_records": statement(
        f"""SELECT s.id, s.original_subscription_id, s.status, s.quantity, s.start_date, s.end_date, s.commitment_term_end_date,
            p.size AS commitment_term_in_months, p.name AS product_name, 'User ' || n_name AS modified_by,
            lower(n_name) || '@billing.example' AS modified_by_email, i.type, i.term_in_months,
            last_value(own IGNORE NULLS) OVER (PARTITION BY s.original_subscription_id ORDER BY s.id) AS co_term_date,
            {ratio('i.gross_revenue * 10000', 'i.quantity * 10000', 4)} AS partner_buy_rate,
            {ratio('i.total * 10000', 'i.quantity * 10000', 4)} AS actual_retail_price,
            CAST(i.gross_revenue AS DOUBLE) AS gross_revenue,
            {ratio('i.gross_revenue * 10000', 'i.term_in_months * 10000')} AS monthly_revenue
        FROM subscription s LEFT JOIN items i ON i.id = s.completed_line_id LEFT JOIN product p ON p.id = s.product_id
            LEFT JOIN nation ON n_nationkey = i.rate_plan_id % 40
            LEFT JOIN (SELECT event_id // 2 AS sid, arg_max(json_extract_string(props, '$.k'), event_id) AS own FROM events
                WHERE event_type IN ('view', 'click') GROUP BY ALL) e ON e.sid = s.id""",
        "subscription", "cli", "product",
        extra=_ITEMS,
    ),
    "related_subscriptions": statement(
        """SELECT s.id, s.original_subscription_id, s.status, s.quantity, p.name AS product_name, 'User ' || n_name AS modified_by,
            i.term_in_months, co_term_date
        FROM subscription s LEFT JOIN items i ON i.id = s.completed_line_id LEFT JOIN product p ON p.id = s.product_id
            LEFT JOIN nation ON n_nationkey = i.rate_plan_id % 40
            LEFT JOIN coterm ct ON ct.o = s.original_subscription_id AND s.id >= ct.first""",
        "subscription", "cli", "product",
        extra=_ITEMS + "," + _CO_TERMS,
    ),
    "co_term_dates": statement(
        "SELECT o AS original_subscription_id, co_term_date, first AS valid_from FROM coterm", "subscription", extra=_CO_TERMS
    ),
    "subscription_metrics": statement(
        f"""SELECT id, status, original_subscription_id, quantity, start_date, end_date, CAST(days_active AS INTEGER) AS days_active,
            term_in_months, CAST(gross_revenue AS DOUBLE) AS gross_revenue,
            {ratio('gross_units', 'term_in_months * 10000')} AS monthly_revenue FROM met""",
        "subscription", "cli",
        extra=_METRICS,
    ),
    "subscription_tiles": statement(
        f"""SELECT count(*) AS total_subscriptions, {count("status = 'Active'")} AS active_subscriptions,
            {money('sum(m)')} AS total_monthly_revenue,
            round(CAST(sum(m) AS DOUBLE) / count(m), 2) AS average_revenue,
            {percent(count("status = 'Cancelled'"), 'count(*)', 1)} AS churn_rate,
            '$' || format('{{:,.2f}}', CAST(round(sum(m), 2) AS DOUBLE)) AS total_text
        FROM (SELECT *, CAST({ratio('gross_units', 'term_in_months * 10000', 4)} AS DECIMAL(18,4)) AS m FROM met)""",
        "subscription", "cli",
        extra=_METRICS,
    ),
    "revenue_variance_mom": statement(
        f"""SELECT subscription_id, invoice_month, q AS total_quantity, pq AS prev_quantity, {money('r')} AS total_revenue,
            {money('pr')} AS prev_revenue, {ratio('r * 100', 'q * 100', 3)} AS revenue_to_quantity_ratio,
            {ratio('pr * 100', 'pq * 100', 3)} AS prev_revenue_to_quantity_ratio,
            {_pct(_D.format('r'), _D.format('pr'))} AS revenue_variance_pct,
            {_pct(_D.format('q'), _D.format('pq'))} AS quantity_variance_pct,
            {_pct(f"{_D.format('r')} / q", f"({_D.format('pr')} / pq)")} AS revenue_to_quantity_ratio_variance_pct
        FROM lg""",
        "line", "subscription",
        extra=_VARIANCE,
    ),
    "overview_history": _own(_overview("om", "transaction_month")),
    "overview_by_vendor": _own(_overview("om", "transaction_month", "vendor")),
    "overview_trend": _own(_trend("true")),
    "overview_vendor_trend": _own(_trend("vendor = 'Brand#4'")),
    "overview_unpivot": _own(
        f"""SELECT transaction_month, metric, "count" FROM (UNPIVOT ({_trend('true')})
        ON partner_count, company_count, active_subscription_count, cancelled_subscription_count, net_new_subscription_count,
            total_product_changes, total_renewals, total_modifications, total_quantity_change, total_partner_buy_rate_changes
        INTO NAME metric VALUE "count")"""
    ),
    "extract_invoice_rows": statement(
        """SELECT l.id, l.invoice_id, l.product_id, l.row_type, l.term, l.quantity, l.start_period, i.region AS business_unit, p.vendor,
            CAST(l.total AS DOUBLE) AS total, CAST(l.cost_total AS DOUBLE) AS cost_total
        FROM line l JOIN invoice i ON i.id = l.invoice_id JOIN product p ON p.id = l.product_id
        WHERE i.invoice_date = DATE '2000-06-01' AND i.region = 'ASIA' AND NOT is_voided""",
        "line", "invoice", "product",
    ),
    "extract_invoices": statement(
        """SELECT id, alternate_id, invoice_date, due_date, status, is_email_sent, approved, partner_id, company_id,
            business_unit_code, CAST(total AS DOUBLE) AS total, CAST(sales_tax AS DOUBLE) AS sales_tax
        FROM invoice WHERE invoice_date = DATE '2000-06-01'""",
        "invoice",
    ),
    "extract_tasks": statement(
        """SELECT id, task_table, service, method, status, run_duration, error_message,
            CAST(date_trunc('month', run_on) AS DATE) AS run_on_month, CAST(product_id AS VARCHAR) AS payload_key,
            NULL::VARCHAR AS partner_id_parsed FROM tasks WHERE status = 'error' AND run_on >= DATE '2024-01-01'""",
        "tasks",
    ),
    "extract_arrears_tasks": statement(
        """SELECT t.id, subscription_id, product_id, status, run_duration, p.name AS product_name, vendor
        FROM tasks t JOIN product p ON p.id = product_id
        WHERE CAST(run_on AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND status = 'new' AND vendor = 'Brand#4'""",
        "tasks", "product",
    ),
    "invoice_report": statement(
        """SELECT alternate_id, CAST(balance AS DOUBLE) AS balance, status, due_date, CAST(sales_tax AS DOUBLE) AS vat_tax_amount,
            business_unit_code, partner_id, invoice_date, partner_name, 'R' || partner_id AS registration_number,
            'T' || partner_id AS vat_id, currency_code
        FROM invoice WHERE status <> 'Void' AND partner_id IS NOT NULL AND region = 'EUROPE' AND invoice_date >= DATE '2000-01-01'""",
        "invoice",
    ),
    "credit_memo_report": statement(
        f"""SELECT m.alternate_id AS credit_memo_id, {money('m.total', 4)} AS credit_memo_total, m.invoice_date AS credit_memo_created_dt,
            m.due_date AS credit_memo_send_dt, m.region AS business_unit_unique_code, m.owner_partner_id AS partner_id, m.partner_name,
            'R' || m.owner_partner_id AS registration_number, 'T' || m.owner_partner_id AS vat_id,
            {money('l.credit', 4)} AS credit_total, {money('t.total', 4)} AS amount_excluding_tax,
            {money('t.billing_fee', 4)} AS tax_amount, CASE WHEN t.id IS NOT NULL THEN 0.05::DOUBLE END AS tax_rate,
            p.name AS product_name, p.vendor AS product_vendor, l.description, l.transaction_date
        FROM ledger l JOIN invoice m ON m.id = l.invoice_id AND m.status = 'Paid' LEFT JOIN product p ON p.id = l.product_id
            LEFT JOIN (SELECT * FROM line WHERE billing_fee > 0) t ON t.id = l.id
        WHERE m.region = 'EUROPE' AND l.transaction_date >= DATE '2000-01-01'""",
        "ledger", "invoice", "product", "line",
    ),
    "distinct_vendors": "SELECT DISTINCT p_brand AS vendor FROM part WHERE p_brand IS NOT NULL",
    "distinct_business_units": "SELECT DISTINCT r_name AS unique_code FROM region",
    "task_vendors": "SELECT DISTINCT p_brand AS vendor FROM events JOIN customer ON c_custkey = user_id JOIN part ON p_partkey = c_custkey",
}
