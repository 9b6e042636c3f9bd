"""Statements for monthly KPIs and revenue in USD."""

from oracle.views import count, money, statement

_USD = "CAST({} AS DECIMAL(18,4)) * rate"

_MART = f"""
monthly AS (
    SELECT region, CASE WHEN partner_id IS NULL AND company_id IS NOT NULL THEN 'Company Invoice'
            WHEN partner_id IS NOT NULL THEN 'Partner Invoice' ELSE 'Unknown' END AS invoice_type,
        invoice_date, count(*) AS n, sum({_USD.format('balance')}) AS b
    FROM invoice WHERE status <> 'Void' GROUP BY ALL
),
mart AS (
    SELECT m0.region, m0.invoice_type, m0.invoice_date,
        m0.n AS n0, m1.n AS n1, m2.n AS n2, m0.n - coalesce(m1.n, 0) AS nd,
        m0.b AS b0, m1.b AS b1, m2.b AS b2, m0.b - coalesce(m1.b, 0) AS bd
    FROM monthly m0
    LEFT JOIN monthly m1 ON m1.region = m0.region AND m1.invoice_type = m0.invoice_type
        AND m1.invoice_date = CAST(m0.invoice_date - INTERVAL 1 MONTH AS DATE)
    LEFT JOIN monthly m2 ON m2.region = m0.region AND m2.invoice_type = m0.invoice_type
        AND m2.invoice_date = CAST(m0.invoice_date - INTERVAL 2 MONTH AS DATE)
)"""


def _mart(body: str) -> str:
    return statement(body, "invoice", extra=_MART)


def _three_health(source: str) -> str:
    def share(month: str) -> str:
        return (
            f"CAST(sum(healthy) FILTER (WHERE m = DATE '{month}') AS DOUBLE) / nullif(sum(total) FILTER (WHERE m = DATE '{month}'), 0)"
        )

    return f"""SELECT round(a, 4) AS month_2, round(b, 4) AS month_1, round(c, 4) AS month_0, round(c - b, 4) AS variance
        FROM (SELECT {share('2000-04-01')} AS a, {share('2000-05-01')} AS b, {share('2000-06-01')} AS c FROM {source})"""


_RELEASE = """
rel AS (
    SELECT i.id, i.status, i.is_email_sent, i.approved, i.balance, i.currency_code, i.business_unit_code,
        CASE WHEN i.partner_id IS NULL AND i.company_id IS NOT NULL THEN 'Company Invoice'
            WHEN i.partner_id IS NOT NULL THEN 'Partner Invoice' ELSE 'Unknown' END AS invoice_audience,
        i.owner_partner_id AS partner_id, i.partner_name,
        CASE WHEN i.is_email_sent AND i.approved THEN 'Released' WHEN NOT i.is_email_sent AND i.approved THEN 'Held - Approved'
            WHEN NOT i.is_email_sent AND NOT i.approved THEN 'Held - Needs Review' ELSE 'Unknown Status' END AS release_status
    FROM invoice i WHERE invoice_date = DATE '2000-06-01'
)"""


def _crosstab() -> str:
    columns = []
    for label in ("Released", "Held - Approved", "Held - Needs Review", "Void", "Unknown Status"):
        name = label.lower().replace(" - ", "_").replace(" ", "_")
        columns.append(f"count(*) FILTER (WHERE s = '{label}') AS {name}")
        columns.append(f"count(DISTINCT partner_id) FILTER (WHERE s = '{label}') AS {name}_partners")
    return f"""SELECT coalesce(business_unit_code, 'Total') AS business_unit_code, {', '.join(columns)}, count(*) AS total
        FROM (SELECT *, CASE WHEN status = 'Void' THEN 'Void' ELSE release_status END AS s FROM rel)
        GROUP BY ROLLUP (business_unit_code)"""


def _top5(rows: str, month_column: str, *views: str) -> str:
    body = f"""SELECT m0.vendor, {money('m2.v')} AS month_2, {money('m1.v')} AS month_1, {money('m0.v')} AS month_0,
            {money('m0.v - coalesce(m1.v, 0)')} AS variance, rk AS current_month_rank
        FROM (SELECT *, rank() OVER (PARTITION BY m ORDER BY v DESC) AS rk FROM vm) m0
        LEFT JOIN vm m1 ON m1.vendor = m0.vendor AND m1.m = DATE '2000-05-01'
        LEFT JOIN vm m2 ON m2.vendor = m0.vendor AND m2.m = DATE '2000-04-01'
        WHERE m0.m = DATE '2000-06-01' AND rk <= 5"""
    return statement(body, *views, extra=f"vm AS (SELECT vendor, {month_column} AS m, sum(v) AS v FROM ({rows}) GROUP BY ALL)")


_LINES = f"""
lm AS (
    SELECT region, row_type AS line_type, coalesce(term, 'No Term') AS term_type, invoice_date AS invoice_month,
        count(*) AS line_item_count, sum({_USD.format('total')}) AS total_usd
    FROM owned_line GROUP BY ALL
)"""

_TOTALS = f"""
lt AS (
    SELECT coalesce(term, 'No Term') || ' - ' || row_type AS row_type_term, invoice_date AS invoice_month,
        region AS business_unit, vendor, count(*) AS record_count, sum({_USD.format('total')}) AS usd_total,
        sum(CAST(cost_total AS DECIMAL(18,4)) * rate) AS usd_cost_total
    FROM owned_line JOIN product ON product.id = product_id
    WHERE NOT is_voided AND invoice_date BETWEEN DATE '2000-05-01' AND DATE '2000-06-01' GROUP BY ALL
)"""

_MONTHS = ["current_month", "prior_month"] + [f"{w}_months_prior" for w in ("two", "three", "four", "five", "six")]
_DATES = ["2000-06-01", "2000-05-01", "2000-04-01", "2000-03-01", "2000-02-01", "2000-01-01", "1999-12-01"]


def _usage() -> str:
    sums = ", ".join(
        f"round(sum(CASE WHEN date_trunc('month', provision_start) = DATE '{d}' THEN gross_revenue ELSE 0 END), 2) AS {m}"
        for m, d in zip(_MONTHS, _DATES)
    )

    def change(a: str, b: str) -> str:
        return f"(CAST({a} - {b} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"

    steps = " + ".join(change(a, b) for a, b in zip(_MONTHS, _MONTHS[1:]))
    usd = ", ".join(f"{money(f'{m} * rate')} AS usd_{m}_revenue" for m in _MONTHS)
    body = f"""SELECT partner_id, partner_name, vendor, u.product_id, subscription_product_name, sub_status, sub_start_date,
        sub_end_date, arrears_subscription_id, original_subscription_id, region AS business_unit, type,
        CASE WHEN size <= 28 THEN size END AS billing_task_run_day, {usd},
        {money('(current_month - prior_month) * rate')} AS prior_vs_current_revenue_difference,
        round({change('current_month', 'prior_month')} * 100, 3) + 0.0 AS percentage_change,
        round({change('current_month', 'five_months_prior')} * 100, 3) + 0.0 AS percentage_change_5_months,
        round(({steps}) / 6 * 100, 3) + 0.0 AS avg_6_month_percentage_variance, current_month_quantity
    FROM u"""
    extra = f"""u AS (
        SELECT a.partner_id, a.partner_name, p.vendor, p.id AS product_id, p.name AS subscription_product_name, p.size,
            s.status AS sub_status, s.start_date AS sub_start_date, s.end_date AS sub_end_date,
            c.arrears_subscription_id, s.original_subscription_id, a.region, a.rate, c.type, {sums},
            CAST(sum(CASE WHEN date_trunc('month', provision_start) = DATE '2000-06-01' THEN c.quantity ELSE 0 END) AS BIGINT)
                AS current_month_quantity
        FROM cli c JOIN subscription s ON s.id = c.arrears_subscription_id JOIN accounts a ON a.company_id = s.company_id
            JOIN product p ON p.id = s.product_id
        WHERE NOT voided AND provision_start >= DATE '1999-12-01' GROUP BY ALL
    )"""
    # grouping by ALL also groups by the account's rate and region, which depend on the subscription
    return statement(body, "cli", "subscription", "accounts", "product", extra=extra)


STATEMENTS = {
    "invoice_month_mart": _mart(
        f"""SELECT region, invoice_type, invoice_date, n0 AS invoice_count_current_month, n1 AS invoice_count_1_month_prior,
            n2 AS invoice_count_2_months_prior, nd AS invoice_count_diff_current_month,
            {money('b0')} AS balance_usd_current_month, {money('b1')} AS balance_usd_1_month_prior,
            {money('b2')} AS balance_usd_2_months_prior, {money('bd')} AS balance_usd_diff_current_month FROM mart"""
    ),
    "invoice_count_kpi": _mart(
        """SELECT 'Invoice Count' AS metric, CAST(sum(n2) AS BIGINT) AS month_2, CAST(sum(n1) AS BIGINT) AS month_1,
            CAST(sum(n0) AS BIGINT) AS month_0, CAST(sum(nd) AS BIGINT) AS variance
        FROM mart WHERE invoice_date = DATE '2000-06-01'"""
    ),
    "balance_by_region": _mart(
        f"""SELECT region, {money('sum(b2)')} AS month_2, {money('sum(b1)')} AS month_1, {money('sum(b0)')} AS month_0,
            {money('sum(bd)')} AS variance FROM mart WHERE invoice_date = DATE '2000-06-01' GROUP BY region"""
    ),
    "health_pivot": statement(
        f"SELECT 'Invoice Health' AS metric, * FROM ({_three_health('h')})",
        "invoice",
        extra=f"""h AS (SELECT invoice_date AS m, {count('approved AND coalesce(is_email_sent, false)')} AS healthy,
            count(*) AS total FROM invoice WHERE status <> 'Void' GROUP BY ALL)""",
    ),
    "ledger_health_pivot": statement(
        f"SELECT 'Ledger Health' AS metric, * FROM ({_three_health('h')})",
        "ledger",
        extra=f"""e AS (SELECT company_id, CAST(date_trunc('month', transaction_date) AS DATE) AS m, sum(credit) AS c,
                sum(debit) AS d FROM ledger GROUP BY ALL),
            h AS (SELECT m, {count('c >= d')} AS healthy, count(*) AS total FROM e GROUP BY m)""",
    ),
    "invoice_counts_two_months": statement(
        "SELECT "
        + ", ".join(
            f"{count(f'''invoice_date = DATE '{d}' AND {c}''')} AS {p}{k}_invoice_count"
            for p, d in (("", "2000-06-01"), ("prev_", "2000-05-01"))
            for k, c in (
                ("company", "company_id IS NOT NULL AND partner_id IS NULL"),
                ("partner", "partner_id IS NOT NULL"),
                ("total", "true"),
            )
        )
        + " FROM invoice WHERE status <> 'Void'",
        "invoice",
    ),
    "release_status": statement(
        """SELECT business_unit_code AS region, release_status, count(*) AS value FROM rel
        WHERE status <> 'Void' GROUP BY ALL""",
        "invoice",
        extra=_RELEASE,
    ),
    "release_details": statement(
        "SELECT * REPLACE (CAST(balance AS DOUBLE) AS balance) FROM rel", "invoice", extra=_RELEASE
    ),
    "release_crosstab": statement(_crosstab(), "invoice", extra=_RELEASE),
    "balance_by_bu": statement(
        f"""SELECT id, currency_code, status, is_email_sent, approved, business_unit_code,
            CAST(balance AS DOUBLE) AS balance, {money('balance * rate')} AS balance_usd
        FROM invoice WHERE status <> 'Void' AND invoice_date = DATE '2000-06-01'""",
        "invoice",
    ),
    "balance_split": statement(
        f"""SELECT coalesce(business_unit_code, 'Total') AS business_unit_code, {money('sum(b)')} AS balance_usd,
            {money('coalesce(sum(b) FILTER (WHERE is_email_sent), 0)')} AS email_sent_usd,
            {money('coalesce(sum(b) FILTER (WHERE NOT is_email_sent), 0)')} AS not_email_sent_usd,
            {money('coalesce(sum(b) FILTER (WHERE approved), 0)')} AS approved_usd,
            {money('coalesce(sum(b) FILTER (WHERE NOT approved), 0)')} AS not_approved_usd
        FROM (SELECT *, balance * rate AS b FROM invoice WHERE status <> 'Void' AND invoice_date = DATE '2000-06-01'
            AND is_email_sent IS NOT NULL AND approved IS NOT NULL)
        GROUP BY ROLLUP (business_unit_code)""",
        "invoice",
    ),
    "top5_vendor_credits": _top5(
        f"""SELECT vendor, CAST(date_trunc('month', transaction_date) AS DATE) AS tm, {_USD.format('credit')} AS v
        FROM ledger JOIN product ON product.id = product_id JOIN accounts USING (company_id) WHERE type = 'SERVICE_CREDIT'""",
        "tm", "ledger", "product", "accounts",
    ),
    "top5_manual_arrears": _top5(
        f"""SELECT vendor, invoice_date, {_USD.format('cost_total')} AS v
        FROM owned_line JOIN product ON product.id = product_id WHERE row_type = 'arrears'""",
        "invoice_date", "owned_line", "product",
    ),
    "invoice_line_details": statement(
        f"SELECT * REPLACE ({money('total_usd')} AS total_usd) FROM lm WHERE invoice_month = DATE '2000-06-01'",
        "owned_line",
        extra=_LINES,
    ),
    "line_count_pivot": statement(
        """SELECT invoice_month, CAST(sum(CASE WHEN term_type = 'Monthly' THEN line_item_count ELSE 0 END) AS BIGINT) AS monthly,
            CAST(sum(CASE WHEN term_type = 'Annual' THEN line_item_count ELSE 0 END) AS BIGINT) AS annual,
            CAST(sum(CASE WHEN term_type = 'No Term' THEN line_item_count ELSE 0 END) AS BIGINT) AS no_term
        FROM lm WHERE invoice_month BETWEEN DATE '1999-12-01' AND DATE '2000-06-01' GROUP BY invoice_month""",
        "owned_line",
        extra=_LINES,
    ),
    "month_list": """SELECT CAST(m AS DATE) AS month, strftime(m, '%b %Y') AS label, count(o_orderkey) AS invoices
        FROM (SELECT unnest(generate_series(TIMESTAMP '1994-06-01', TIMESTAMP '2002-03-01', INTERVAL 1 MONTH)) AS m)
            LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY m""",
    "fx_line_detail": statement(
        f"""SELECT owned_line.id, invoice_id, partner_id, company_id, row_type, term, currency_code, region AS business_unit,
            vendor, invoice_date AS invoice_month, CAST(total AS DOUBLE) AS total, {money('cost_total')} AS cost_total,
            {money('billing_fee')} AS billing_fee, {money('total * rate')} AS usd_total,
            {money('cost_total * rate')} AS usd_cost_total, CAST(rate AS DOUBLE) AS exchange_rate_multiple
        FROM owned_line JOIN product ON product.id = product_id
        WHERE invoice_date >= DATE '2000-05-20' AND start_period >= DATE '2000-05-20' AND NOT is_voided""",
        "owned_line", "product",
    ),
    "fx_line_aggregate": statement(
        f"""SELECT row_type_term, strftime(invoice_month, '%B %Y') AS month_name, invoice_month, business_unit, vendor,
            record_count, {money('usd_total')} AS usd_total, {money('usd_cost_total')} AS usd_cost_total FROM lt""",
        "owned_line", "product",
        extra=_TOTALS,
    ),
    "row_type_month_pivot": statement(
        "SELECT row_type_term, "
        + ", ".join(
            expression
            for suffix, d in (("", "2000-06-01"), ("_prior", "2000-05-01"))
            for expression in (
                f"CAST(coalesce(sum(record_count) FILTER (WHERE invoice_month = DATE '{d}'), 0) AS BIGINT) AS records{suffix}",
                f"{money(f'''sum(usd_total) FILTER (WHERE invoice_month = DATE '{d}')''')} AS customer_usd{suffix}",
                f"{money(f'''sum(usd_cost_total) FILTER (WHERE invoice_month = DATE '{d}')''')} AS partner_usd{suffix}",
            )
        )
        + " FROM lt GROUP BY row_type_term",
        "owned_line", "product",
        extra=_TOTALS,
    ),
    "usage_variance_6m": _usage(),
    "arrears_variance": statement(
        f"""SELECT vendor, region AS business_unit, {money('sum(p * rate)')} AS usd_prior_month_revenue,
            {money('sum(c * rate)')} AS usd_current_month_gross_revenue, {money('sum((c - p) * rate)')} AS usd_gross_revenue_difference
        FROM (
            SELECT p.vendor, a.region, a.currency_code, a.rate, c.provision_start,
                round(sum(CASE WHEN date_trunc('month', provision_start) = DATE '2000-05-01' THEN gross_revenue ELSE 0 END), 2) AS p,
                round(sum(CASE WHEN date_trunc('month', provision_start) = DATE '2000-06-01' THEN gross_revenue ELSE 0 END), 2) AS c
            FROM cli c JOIN subscription s ON s.id = c.arrears_subscription_id JOIN accounts a ON a.company_id = s.company_id
                JOIN product p ON p.id = s.product_id
            WHERE NOT voided AND provision_start >= DATE '2000-05-01' GROUP BY ALL
        ) GROUP BY ALL""",
        "cli", "subscription", "accounts", "product",
    ),
}
