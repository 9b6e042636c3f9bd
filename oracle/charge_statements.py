"""Statements for duplicate and missing charges and bill-on-behalf."""

from oracle.views import money, statement

_DUP = """
dup AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (copies ORDER BY id) AS line_row_number, count(*) OVER copies AS line_duplicate_count
        FROM (
            SELECT line.*, CASE WHEN line_status = 'F' THEN 'Partner Invoice' ELSE 'Company Invoice' END AS invoice_type,
                quantity // 25 AS seats
            FROM line JOIN part ON p_partkey = product_id
            WHERE p_size <= 40 AND invoice_date >= DATE '1999-12-01' AND row_type IN ('subscription', 'prorate'))
        WINDOW copies AS (PARTITION BY invoice_id, completed_line_item_id, invoice_type, row_type, seats, floor(total / 50000)))
    WHERE line_row_number > 1
),
owned_dup AS (
    SELECT d.*, a.* EXCLUDE (rate), a.rate, p.name AS product_name
    FROM dup d JOIN orders ON o_orderkey = invoice_id JOIN accounts a ON a.company_id = o_custkey JOIN product p ON p.id = d.product_id
)"""

_VERSIONS = """
ver AS (
    SELECT *, quantity - prior_quantity AS quantity_delta, price - prior_price AS price_delta,
        prior_id IS NOT NULL AND quantity IS DISTINCT FROM prior_quantity AS quantity_changed,
        prior_id IS NOT NULL AND term IS DISTINCT FROM prior_term AS term_changed,
        prior_id IS NOT NULL AND price IS DISTINCT FROM prior_price AS price_changed,
        prior_id IS NOT NULL AND product_id IS DISTINCT FROM prior_product AS product_changed
    FROM (
        SELECT *, lag(id) OVER w AS prior_id, lag(quantity) OVER w AS prior_quantity, lag(term) OVER w AS prior_term,
            lag(price) OVER w AS prior_price, lag(product_id) OVER w AS prior_product
        FROM subscription WINDOW w AS (PARTITION BY original_subscription_id ORDER BY id)
    )
)"""

# Months are found here by asking for each month which version started last, not by intervals.
_MONTHS = (
    _VERSIONS
    + """,
st AS (
    SELECT original_subscription_id AS o, CAST(date_trunc('month', start_date) AS DATE) AS m, arg_max(ver, id) AS v, min(id) AS first_id,
        count(*) FILTER (WHERE quantity_changed) AS qc, count(*) FILTER (WHERE price_changed) AS pc,
        count(*) FILTER (WHERE product_changed) AS dc, count(*) FILTER (WHERE term_changed) AS tc,
        count(prior_id) AS mc, CAST(sum(coalesce(quantity_delta, 0)) AS BIGINT) AS qd, sum(coalesce(price_delta, 0)) AS pd, bool_or(prior_id IS NULL) AS isnew
    FROM ver GROUP BY ALL
),
ends AS (
    SELECT o, min(m) AS first_m, arg_max(v, m).end_date AS last_end, max(m) AS last_m FROM st GROUP BY o
),
cal AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH)) AS DATE) AS tm),
am AS (
    SELECT e.o AS original_subscription_id, tm AS transaction_month, s.v AS v, s.m = tm AS starts, s.first_id, s.qc, s.pc, s.dc, s.tc,
        s.mc, s.qd, s.pd, s.isnew, s.m = e.last_m AND coalesce(tm = date_trunc('month', s.v.end_date), false) AS is_cancelled
    FROM ends e JOIN cal ON tm >= first_m
        AND tm <= CASE WHEN last_end IS NULL THEN DATE '2001-08-01'
            ELSE greatest(CAST(date_trunc('month', last_end) AS DATE), last_m) END
    ASOF JOIN st s ON s.o = e.o AND cal.tm >= s.m
),
months AS (
    SELECT original_subscription_id, transaction_month, CASE WHEN starts THEN first_id ELSE v.id END AS first_id_in_month,
        v.id AS latest_id_in_month, v.status AS status, CASE WHEN starts THEN qc ELSE 0 END AS quantity_changes,
        CASE WHEN starts THEN pc ELSE 0 END AS price_changes, CASE WHEN starts THEN dc ELSE 0 END AS product_changes,
        CASE WHEN starts THEN tc ELSE 0 END AS term_changes, CASE WHEN starts THEN mc ELSE 0 END AS modifications,
        CASE WHEN starts THEN qd ELSE 0 END AS quantity_delta, CASE WHEN starts THEN pd ELSE 0 END AS price_delta, starts AND isnew AS is_new, is_cancelled,
        v.term AS term, v.billing_cycle_start AS cycle, v.commitment_term_end_date AS commit_end, v.quantity AS quantity,
        v.price AS unit_price, v.product_id AS product_id, v.company_id AS company_id,
        v.completed_line_id AS completed_line_id, v.start_date AS start_date
    FROM am
)"""
)

_PROJECTION = (
    _MONTHS
    + """,
ow AS (SELECT line.*, o_custkey AS o, o_orderstatus = 'P' AS bob FROM line JOIN orders ON o_orderkey = invoice_id),
due AS (
    SELECT months.*, p.name AS product_name, p.vendor, p.uuid AS product_uuid, a.company_name, a.partner_id, a.partner_name, a.segment,
        a.rate, CAST(CASE WHEN a.segment = 'BUILDING' THEN unit_price ELSE unit_price * 0.9 END AS DECIMAL(18,4)) AS paid_price
    FROM months JOIN product p ON p.id = months.product_id JOIN accounts a ON a.company_id = months.company_id
    WHERE p.anniversary_billing AND transaction_month >= DATE '1999-12-01'
        AND (lower(term) = 'monthly' OR month(transaction_month) =
            CASE WHEN day(coalesce(commit_end, cycle)) = 1 THEN month(coalesce(commit_end, cycle))
                ELSE month(coalesce(commit_end, cycle) + INTERVAL 1 MONTH) END)
),
ch AS (
    SELECT o, invoice_date AS m, count(*) FILTER (WHERE row_type = 'subscription') AS fc,
        sum(cost_total) FILTER (WHERE row_type = 'subscription') AS ft, count(*) FILTER (WHERE row_type = 'prorate') AS pc,
        sum(cost_total) FILTER (WHERE row_type = 'prorate') AS pt,
        sum(total) FILTER (WHERE row_type = 'subscription') AS fct, sum(total) FILTER (WHERE row_type = 'prorate') AS pct
    FROM ow WHERE NOT bob GROUP BY ALL
),
om AS (
    SELECT o, invoice_date AS m, bool_or(return_flag = 'A') AS a, bool_or(return_flag = 'N') AS b,
        bool_or(return_flag = 'A' AND is_voided) AS c, bool_or(return_flag = 'N' AND is_voided) AS d
    FROM ow WHERE line_status = 'O' GROUP BY ALL
),
sv AS (
    SELECT company_id AS o, CAST(date_trunc('month', transaction_date) AS DATE) AS m, count(*) AS n, sum(debit) AS s
    FROM ledger WHERE type = 'CHECK_ISSUED' GROUP BY ALL
),
proj AS (
    SELECT due.*, coalesce(fc, 0) AS full_term_count, coalesce(pc, 0) AS prorate_count, coalesce(sv.n, 0) AS charge_count,
        coalesce(CAST(ft AS DECIMAL(28,4)), 0) AS full_term_total, coalesce(CAST(pt AS DECIMAL(28,4)), 0) AS prorate_total,
        coalesce(sv.s, 0) AS debit, coalesce(om.a, false) AS order_full_term, coalesce(om.b, false) AS order_prorate,
        coalesce(om.c, false) AS manual_full_term, coalesce(om.d, false) AS manual_prorate,
        CASE WHEN coalesce(fc, 0) > 0 THEN 'Matched' ELSE 'Missing' END AS line_status,
        CASE WHEN coalesce(pc, 0) > 0 THEN 'Matched Prorate' ELSE 'No Prorates' END AS prorate_status,
        CASE WHEN coalesce(sv.n, 0) > 0 THEN 'Service Charges' ELSE 'No Service Charges' END AS ledger_status,
        coalesce(fct, 0) AS full_term_customer_total, coalesce(pct, 0) AS prorate_customer_total,
        CAST(CASE WHEN coalesce(fc, 0) > 0 THEN 0 ELSE paid_price * CAST(due.quantity AS DECIMAL(9,0)) END AS DECIMAL(28,4)) AS missed_revenue,
        missed_revenue - coalesce(CAST(pt AS DECIMAL(28,4)), 0) AS net_missed_revenue,
        CAST(missed_revenue AS DECIMAL(20,4)) * rate AS missed_revenue_usd,
        CAST(net_missed_revenue AS DECIMAL(20,4)) * rate AS net_missed_revenue_usd, coalesce(sv.s, 0) * rate AS debit_usd
    FROM due LEFT JOIN ch ON ch.o = original_subscription_id AND ch.m = transaction_month
        LEFT JOIN om ON om.o = original_subscription_id AND om.m = transaction_month
        LEFT JOIN sv ON sv.o = original_subscription_id AND sv.m = transaction_month
),
named AS (
    SELECT *, CASE WHEN order_full_term THEN 'Missing on invoice, matched in orders, ' ELSE 'Missing in orders, ' END
        || CASE WHEN order_prorate THEN 'with prorates, ' ELSE 'no prorates, ' END || 'no service charges' AS state
    FROM proj WHERE line_status = 'Missing' AND ledger_status = 'No Service Charges'
        AND (prorate_status = 'Matched Prorate') = order_prorate AND NOT manual_full_term AND NOT manual_prorate
),
miss AS (SELECT * FROM proj WHERE line_status = 'Missing' AND transaction_month = DATE '2000-06-01')"""
)

_P = ("subscription", "line", "product", "accounts", "ledger")


def _proj(body: str) -> str:
    return statement(body, *_P, extra=_PROJECTION)


_SUMMARY = f"""SELECT transaction_month, count(DISTINCT product_id) AS product_count,
    count(DISTINCT partner_id) AS missing_partner_count, count(DISTINCT company_id) AS missing_company_count,
    count(DISTINCT original_subscription_id) AS missing_subscription_count, {money('sum(missed_revenue)')} AS missed_revenue,
    {money('sum(missed_revenue_usd)')} AS missed_revenue_usd, CAST(sum(charge_count) AS BIGINT) AS service_charges_posted_count,
    {money('sum(debit)')} AS service_charges_posted, {money('sum(debit_usd)')} AS service_charges_posted_usd
    FROM proj WHERE line_status = 'Missing' GROUP BY transaction_month"""


def _upload(source: str, amount: str, charged: str, credited: str, kind: str, columns: str, label: str) -> str:
    return f"""SELECT CASE WHEN {kind} = 'P' THEN partner_id END AS "Partner ID", company_id AS "Company ID", {columns},
        CASE WHEN {charged} THEN 'SERVICE_CHARGE' ELSE 'SERVICE_CREDIT' END AS "Type", '2000-06-01' AS "Transaction Date",
        CASE WHEN {credited} THEN {money(f'abs({amount})')} END AS "Credit",
        CASE WHEN {charged} THEN {money(f'abs({amount})')} END AS "Debit",
        '{label} for Company: ' || company_name || ' and Product: ' || product_name || ' at a quantity of ' || quantity AS "Description",
        NULL::VARCHAR AS "Partner UUID", NULL::VARCHAR AS "Vendor ID", NULL::VARCHAR AS "Company UUID",
        false AS "Tax Excluded", NULL::VARCHAR AS "Subscription UUID", NULL::VARCHAR AS "Vendor UUID",
        NULL::VARCHAR AS "Product ID"
    FROM {source} WHERE {kind} IS NOT NULL AND {amount} <> 0"""


_BOB = """
bl AS (SELECT invoice_date, partner_id, CASE WHEN line_number <> 7 THEN company_id END AS company_id, cost_total, billing_fee
    FROM owned_line),
chg AS (SELECT invoice_date, partner_id, company_id, sum(cost_total) AS t, sum(billing_fee) AS f FROM bl
    WHERE company_id IS NOT NULL GROUP BY ALL),
sur AS (SELECT invoice_date, partner_id, sum(cost_total) AS s FROM bl WHERE company_id IS NULL GROUP BY ALL),
cus AS (SELECT invoice_date, owner_partner_id AS partner_id, owner_company_id AS company_id, max(id) AS bob_invoice_id,
    arg_max(status, id) AS st, sum(total + sales_tax) AS ct, sum(sales_tax) AS tax
    FROM invoice WHERE status <> 'Void' GROUP BY ALL),
pay AS (SELECT invoice_id AS bob_invoice_id, min(id) AS pid, min(transaction_date) AS pd, sum(credit) AS pc,
    arg_min(description, id) AS pdesc, count(*) - 1 AS dups FROM ledger WHERE type = 'BOB_CUSTOMER_PAYMENT' GROUP BY ALL),
ass AS (
    SELECT chg.*, bob_invoice_id, st, ct, tax, coalesce(s, 0) AS s, pid, pd, pc, pdesc, coalesce(dups, 0) AS dups,
        CAST(ct AS DECIMAL(28,4)) - tax - t - f AS net, coalesce(st = 'Paid' AND pid IS NULL, false) AS failed,
        own_id, own_status
    FROM chg LEFT JOIN sur USING (invoice_date, partner_id)
        LEFT JOIN (SELECT invoice_date, owner_partner_id AS partner_id, max(id) AS own_id, arg_max(status, id) AS own_status
            FROM invoice WHERE status <> 'Void' GROUP BY ALL) USING (invoice_date, partner_id) LEFT JOIN cus USING (invoice_date, partner_id, company_id)
        LEFT JOIN pay USING (bob_invoice_id)
),
tot AS (
    SELECT invoice_date, partner_id, count(*) AS company_count, count(bob_invoice_id) AS bob_company_count,
        count(*) FILTER (WHERE st = 'Paid') AS bob_invoice_paid_count, coalesce(sum(pc), 0) AS lt, coalesce(sum(net), 0) AS nt,
        count(*) FILTER (WHERE failed) AS fc, coalesce(sum(net) FILTER (WHERE failed), 0) AS ft,
        count(*) FILTER (WHERE dups > 0) AS dp
    FROM ass GROUP BY ALL
),
bal AS (SELECT invoice_date, owner_partner_id AS partner_id, sum(balance) AS b, sum(balance * rate) AS bu
    FROM invoice WHERE status <> 'Void' GROUP BY ALL),
sett AS (SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS invoice_date, a.partner_id, l.id, transaction_date,
    description, debit, debit * rate AS du,
    count(*) OVER (PARTITION BY date_trunc('month', transaction_date), a.partner_id) > 1 AS dup
    FROM ledger l JOIN accounts a ON a.company_id = l.company_id WHERE type = 'CHECK_ISSUED'),
summ AS (
    SELECT tot.*, b, bu, sett.id AS ledger_id, transaction_date, description, debit, du, coalesce(dup, false) AS dup
    FROM tot LEFT JOIN bal USING (invoice_date, partner_id) LEFT JOIN sett USING (invoice_date, partner_id)
)"""


def _bob(body: str) -> str:
    return statement(body, "owned_line", "invoice", "ledger", "accounts", extra=_BOB)


_ASSESSMENT = f"""SELECT invoice_date, partner_id, company_id, own_id AS partner_invoice_id, own_status AS partner_invoice_status,
    CASE WHEN bob_invoice_id IS NULL THEN 'Non-BOB' ELSE 'Company Invoice' END AS invoice_type, bob_invoice_id,
    st AS bob_invoice_status, {money('t')} AS partner_invoice_partner_total, {money('f')} AS partner_billing_fee,
    {money('s')} AS partner_surcharge_total, {money('ct')} AS bob_customer_total_with_tax,
    {money('CAST(ct AS DECIMAL(28,4)) - t')} AS partner_net_after_customer_total,
    {money('net')} AS partner_net_after_billing_fee_and_taxes, {money('tax')} AS bob_tax_withholding,
    pd AS bob_payment_posting_date, {money('pc')} AS bob_payment_credit, pid AS bob_payment_id,
    pdesc AS bob_payment_description, dups AS bob_payment_duplicate_count,
    CASE WHEN st = 'Paid' THEN {money('net')} END AS expected_partner_bob_ledger_payment, failed AS partner_bob_failed_posting
    FROM ass"""

_BOB_SUMMARY = f"""SELECT invoice_date, partner_id, company_count, bob_company_count, bob_invoice_paid_count,
    {money('lt')} AS bob_payment_partner_ledger_total, {money('nt')} AS partner_net_after_billing_fee_and_taxes,
    fc AS bob_payment_failed_posting_count, {money('ft')} AS bob_payment_failed_posting_total,
    dp AS bob_with_duplicate_payment_posting, {money('b')} AS invoice_balance, {money('bu')} AS invoice_balance_usd,
    dup AS ledger_duplicate_present, ledger_id, transaction_date AS ledger_transaction_date,
    description AS ledger_description, {money('debit')} AS ledger_debit, {money('du')} AS ledger_debit_usd FROM summ"""


def _headline(extra: str = "") -> str:
    once = "SELECT DISTINCT invoice_date, partner_id, company_count, bob_company_count, bob_invoice_paid_count, lt, fc, nt, dp FROM summ"
    window = f"invoice_date BETWEEN DATE '2000-01-01' AND DATE '2000-06-01' {extra}"
    return f"""SELECT CAST(sum(company_count) AS BIGINT) AS company_count, CAST(sum(bob_company_count) AS BIGINT) AS bob_company_count,
        CAST(sum(bob_invoice_paid_count) AS BIGINT) AS bob_invoice_paid_count, {money('sum(lt)')} AS bob_payment_partner_ledger_total,
        CAST(sum(fc) AS BIGINT) AS bob_payment_failed_posting_count, {money('sum(nt)')} AS partner_net_after_billing_fee_and_taxes,
        CAST(sum(dp) AS BIGINT) AS bob_with_duplicate_payment_posting,
        (SELECT {money('sum(debit)')} FROM summ WHERE {window}) AS ledger_debit,
        (SELECT count(*) FROM summ WHERE dup AND {window}) AS settlement_duplicate_count
    FROM ({once}) WHERE {window}"""


STATEMENTS = {
    "duplicate_lines": statement(
        f"""SELECT d.id, d.invoice_id, d.line_number, d.invoice_type, d.row_type AS transaction_type, d.invoice_date, d.product_id,
            d.supplier_id, d.seats, {money('d.total')} AS total, line_row_number, line_duplicate_count, t.n AS order_count, {money('t.s')} AS order_total
        FROM dup d LEFT JOIN (SELECT completed_line_item_id AS c, row_type AS r, start_period AS p, count(*) AS n, sum(total) AS s
            FROM line WHERE return_flag <> 'R' GROUP BY ALL) t
            ON t.c = d.completed_line_item_id AND t.r = d.row_type AND t.p = d.start_period""",
        "line", "accounts", "product",
        extra=_DUP,
    ),
    "duplicate_headline": statement(
        f"""SELECT count(DISTINCT id) AS duplicate_lines, count(DISTINCT partner_id) AS partners,
            count(DISTINCT company_id) AS companies, count(DISTINCT product_id) AS products,
            {money('sum(cost_total * rate)')} AS credit_usd FROM owned_dup""",
        "line", "accounts", "product",
        extra=_DUP,
    ),
    "duplicate_ledger_upload": statement(
        _upload(
            "owned_dup", "cost_total", "cost_total < 0", "cost_total > 0",
            "CASE WHEN segment = 'BUILDING' THEN 'C' ELSE 'P' END",
            'invoice_id AS "Subscription ID", start_period AS "Billing Period Start", end_period AS "Billing Period End"',
            "Duplicated line items",
        ),
        "line", "accounts", "product",
        extra=_DUP,
    ),
    "subscription_changes": statement(
        f"""SELECT id, original_subscription_id, prior_id, prior_quantity, prior_term, quantity_changed, term_changed,
            price_changed, product_changed, quantity_delta, {money('price_delta')} AS price_delta FROM ver""",
        "subscription",
        extra=_VERSIONS,
    ),
    "active_months": statement(
        f"""SELECT original_subscription_id, transaction_month, first_id_in_month, latest_id_in_month, status, quantity_changes,
            price_changes, product_changes, term_changes, modifications, quantity_delta, {money('price_delta')} AS price_delta,
            is_new, is_cancelled FROM months""",
        "subscription",
        extra=_MONTHS,
    ),
    "renewal_projection": _proj(
        "SELECT original_subscription_id, transaction_month, latest_id_in_month, partner_id, company_id, product_id, term, "
        "quantity, line_status, prorate_status, ledger_status, order_full_term, order_prorate, manual_full_term, "
        "manual_prorate, full_term_count, prorate_count, charge_count, "
        + ", ".join(
            f"{money(c)} AS {c}"
            for c in (
                "full_term_total", "full_term_customer_total", "prorate_total", "prorate_customer_total", "debit", "missed_revenue",
                "missed_revenue_usd", "net_missed_revenue", "net_missed_revenue_usd",
            )
        )
        + " FROM proj"
    ),
    "missing_subscriptions": _proj(
        f"""SELECT state, original_subscription_id, transaction_month, partner_id, company_id, product_id,
            {money('missed_revenue')} AS missed_revenue, {money('net_missed_revenue')} AS net_missed_revenue FROM named"""
    ),
    "faceted_missing": _proj(
        f"""SELECT original_subscription_id, company_name, segment, term, {money('missed_revenue')} AS missed_revenue FROM miss
        WHERE term = 'Monthly' AND segment IN ('BUILDING','MACHINERY','HOUSEHOLD') AND missed_revenue <> 0"""
    ),
    "missing_month_summary": _proj(_SUMMARY),
    "missing_summary_of_month": _proj(f"SELECT * FROM ({_SUMMARY}) WHERE transaction_month = DATE '2000-06-01'"),
    "partner_hierarchy_totals": _proj(
        f"""SELECT partner_name, company_name, product_name, {money('t')} AS total_amount, row_count,
            {money('sum(t) OVER (PARTITION BY partner_name)')} AS partner_name_total,
            {money('sum(t) OVER (PARTITION BY partner_name, company_name)')} AS company_name_total
        FROM (SELECT partner_name, company_name, product_name, sum(missed_revenue) AS t, count(*) AS row_count FROM miss GROUP BY ALL)"""
    ),
    "top_products_by_term": _proj(
        f"""SELECT product_name, term, {money('sum(missed_revenue)')} AS revenue_impact,
            count(DISTINCT original_subscription_id) AS subscription_count
        FROM miss WHERE product_name IN (SELECT product_name FROM miss GROUP BY product_name
            ORDER BY sum(missed_revenue) DESC, product_name LIMIT 10) GROUP BY ALL"""
    ),
    "product_term_pivot": _proj(
        "SELECT product_name, "
        + ", ".join(
            f"{money(f'''coalesce(sum(missed_revenue) FILTER (WHERE {c}), 0)''')} AS revenue_impact_{n}, "
            f"count(DISTINCT original_subscription_id) FILTER (WHERE {c}) AS subscription_count_{n}"
            for n, c in (("monthly", "term = 'Monthly'"), ("annual", "term = 'Annual'"))
        )
        + f""", {money('sum(missed_revenue)')} AS revenue_impact_total,
            count(DISTINCT (original_subscription_id, term)) AS subscription_count_total FROM miss GROUP BY product_name"""
    ),
    "ledger_upload": _proj(
        _upload(
            "miss", "net_missed_revenue", "net_missed_revenue > 0", "net_missed_revenue < 0",
            "CASE WHEN segment = 'BUILDING' THEN 'C' WHEN segment <> 'MACHINERY' THEN 'P' END",
            'latest_id_in_month AS "Subscription ID", transaction_month AS "Billing Period Start", commit_end AS "Billing Period End"',
            "Missing subscription charges",
        )
    ),
    "order_upload": _proj(
        f"""SELECT company_name AS "companyName", strftime(start_date, '%Y-%m-%d') AS "orderDate",
            strftime(transaction_month, '%Y-%m-%d') AS "serviceStart", strftime(transaction_month, '%Y-%m-%d') AS "startPeriod",
            strftime(transaction_month + INTERVAL 1 MONTH, '%Y-%m-%d') AS "endPeriod", 'seat' AS "unitOfMeasure",
            product_name AS description, product_name AS "bobDescription", '' AS "descriptionExtras", 'FLAT' AS "rateType",
            'RECURRING' AS "chargeType", {money('unit_price', 4)} AS price, {money('unit_price * quantity', 4)} AS total,
            {money('unit_price * 0.9', 4)} AS cost, {money('unit_price * 0.9 * quantity', 4)} AS "costTotal",
            {money('unit_price * 0.8', 4)} AS "platformCost", {money('unit_price * 0.8 * quantity', 4)} AS "platformCostTotal",
            'Marketplace' AS "offeredBy", NULL::VARCHAR AS "purchaseOrderNumber", '' AS details, NULL::VARCHAR AS "currencyId",
            'G-' || completed_line_id AS "completedLineItemId", 'S-' || latest_id_in_month AS "subscriptionId",
            'O-' || original_subscription_id AS "originalSubscriptionGuid", product_uuid AS "productUUID",
            product_name AS "productName", vendor AS "productVendorId", NULL::VARCHAR AS sku, term, 'FLAT' AS "ratePlanType",
            false AS "isFlatRate", CAST(quantity AS DOUBLE) AS quantity, 'PG-' || partner_id AS "partnerId",
            'C-' || company_id AS "companyId", strftime(transaction_month, '%Y-%m-%d') AS "invoiceDate",
            'subscription' AS type, strftime(commit_end, '%Y-%m-%d') AS "billingRenewal"
        FROM named QUALIFY row_number() OVER (PARTITION BY completed_line_id, latest_id_in_month, original_subscription_id
            ORDER BY transaction_month) = 1"""
    ),
    "batch_assignment": """SELECT id, batch, 'invoices_batch' || lpad(CAST(batch AS VARCHAR), CAST(greatest(3, length(CAST(batch AS VARCHAR))) AS INTEGER), '0') || '_2000-06-01.csv'
            AS file_name
        FROM (SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderkey) - 1) // 700 + 1 AS batch FROM orders)""",
    "bob_assessment": _bob(_ASSESSMENT),
    "bob_summary": _bob(_BOB_SUMMARY),
    "bob_headline": _bob(_headline()),
    "bob_headline_partner": _bob(_headline("AND partner_id = 3")),
    "bob_failed_postings": _bob(f"{_ASSESSMENT} WHERE failed AND invoice_date BETWEEN DATE '2000-01-01' AND DATE '2000-06-01'"),
    "bob_duplicate_settlements": _bob(f"{_BOB_SUMMARY} WHERE dup AND invoice_date >= DATE '2000-01-01'"),
}
