"""Statements for invoice reconciliation."""

from oracle.views import count, money, statement

_VALID = """lower(status) = 'active' AND quantity > 0 AND commitment_term_end_date >= DATE '2000-06-01'"""

_ITEMS = f"""
last_items AS (
    SELECT id AS item_id, max(guid) AS guid, arg_max(term_in_months, (product_id, supplier_id, total, quantity)) AS term
    FROM cli GROUP BY id
),
billable AS (
    SELECT i.* FROM last_items i WHERE term = 1
        AND item_id IN (SELECT completed_line_id FROM subscription WHERE {_VALID})
)"""


def _missing(entity_name: str, flags: str, columns: str, *views: str, tail: str = "") -> str:
    extra = """
    rc AS (SELECT company_id, sum(cost_total) AS c FROM open_rows WHERE invoice_date = DATE '2000-06-01' GROUP BY ALL),
    lc AS (SELECT company_id, sum(credit) - sum(debit) AS c FROM ledger
        WHERE transaction_date >= DATE '2000-06-01' AND transaction_date < DATE '2000-07-01' GROUP BY ALL)"""
    body = f"""SELECT {columns}, DATE '2000-06-01' AS invoice_date,
            CAST(coalesce(CAST(rc.c AS DECIMAL(28,4)), CAST(lc.c AS DECIMAL(28,4)), 0) AS DOUBLE) AS cost
        FROM customer LEFT JOIN rc ON rc.company_id = c_custkey LEFT JOIN lc ON lc.company_id = c_custkey {tail}
        WHERE {flags} AND coalesce(rc.c, lc.c, 0) <> 0
            AND c_custkey NOT IN (SELECT {entity_name} FROM invoice WHERE status <> 'Void'
                AND invoice_date = DATE '2000-06-01' AND {entity_name} IS NOT NULL)"""
    return statement(body, "open_rows", "ledger", "invoice", *views, extra=extra)


_RECON = """
al AS (
    SELECT line.*, o_custkey AS owner, line.id AS line_id FROM line JOIN orders ON o_orderkey = invoice_id
        JOIN product p ON p.id = product_id WHERE p.anniversary_billing
),
subs AS (SELECT s.* FROM subscription s JOIN product p ON p.id = s.product_id WHERE p.anniversary_billing),
tx AS (SELECT completed_line_item_id AS tid, owner, completed_line_item_id, invoice_date FROM al WHERE return_flag <> 'R'),
hdr AS (SELECT o_orderkey AS invoice_id, o_custkey AS partner_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders),
lc AS (SELECT invoice_id, count(*) AS n, count(DISTINCT line_id) AS ids, min(start_period) AS s, max(end_period) AS e FROM al GROUP BY ALL),
sc AS (SELECT al.invoice_id, count(*) AS n FROM al JOIN subs ON completed_line_id = completed_line_item_id GROUP BY ALL),
tc AS (SELECT al.invoice_id, count(*) AS n FROM al JOIN tx USING (completed_line_item_id) GROUP BY ALL),
due AS (SELECT DISTINCT company_id AS partner_id, CAST(date_trunc('month', billing_cycle_start) AS DATE) AS m, completed_line_id
    FROM subs WHERE lower(status) = 'active'),
dt AS (SELECT partner_id, m, count(*) AS n FROM due GROUP BY ALL),
ms AS (SELECT hdr.invoice_id, count(*) AS n FROM hdr JOIN due USING (partner_id, m)
    WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.invoice_id = hdr.invoice_id AND al.completed_line_item_id = due.completed_line_id)
    GROUP BY ALL),
mt AS (SELECT hdr.invoice_id, count(*) AS n FROM hdr JOIN tx ON tx.owner = hdr.partner_id AND tx.invoice_date = hdr.m
    WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.invoice_id = hdr.invoice_id AND al.completed_line_item_id = tx.tid)
    GROUP BY ALL),
pl AS (SELECT owner, count(DISTINCT line_id) AS n FROM al GROUP BY ALL),
ps AS (SELECT company_id, count(*) AS n, count(*) FILTER (WHERE lower(status) = 'active') AS a FROM subs GROUP BY ALL),
pt AS (SELECT owner, count(*) AS n FROM tx GROUP BY ALL)"""

_TX = "tx AS (SELECT partner_id, invoice_date, completed_line_item_id AS tid FROM owned_line WHERE return_flag <> 'R')"

_BUNDLE = """
ch AS (SELECT id, partner_id FROM invoice WHERE invoice_date = DATE '2000-06-01'),
ow AS (SELECT DISTINCT partner_id FROM ch WHERE partner_id IS NOT NULL),
pa AS (SELECT * FROM product WHERE anniversary_billing),
al AS (SELECT l.* FROM owned_line l JOIN pa ON pa.id = l.product_id),
ol AS (SELECT * FROM al WHERE invoice_id IN (SELECT id FROM ch)),
su AS (SELECT s.*, a.partner_id FROM subscription s JOIN pa ON pa.id = s.product_id JOIN accounts a ON a.company_id = s.company_id),
om AS (SELECT l.*, p.anniversary_billing FROM owned_line l JOIN product p ON p.id = l.product_id WHERE return_flag <> 'R'),
it AS (SELECT c.* FROM cli c JOIN pa ON pa.id = c.product_id)"""

STATEMENTS = {
    "missing_partner_invoices": _missing(
        "owner_company_id",
        """NOT c_acctbal < -900 AND NOT (c_mktsegment = 'MACHINERY' AND c_acctbal > 9000)
            AND NOT (c_mktsegment = 'BUILDING' AND c_acctbal > 9500) AND c_acctbal < 9800
            AND NOT (c_mktsegment = 'FURNITURE' AND c_acctbal > 8000)""",
        """c_custkey AS partner_id, c_name AS partner_name, CAST(length(c_name) AS INTEGER) AS payment_day,
            c_acctbal < 0 AS is_invoice_dirty, CAST(c_nationkey AS BIGINT) AS currency_id""",
    ),
    "missing_company_invoices": _missing(
        "company_id",
        """c_acctbal >= -900 AND c_mktsegment IN ('BUILDING','AUTOMOBILE','HOUSEHOLD')
            AND (c_mktsegment = 'AUTOMOBILE' OR c_acctbal <= 8000)""",
        """c_custkey AS company_id, c_name AS company_name, CAST(length(c_name) AS INTEGER) AS payment_day,
            c_acctbal < 0 AS is_invoice_dirty, CAST(c_nationkey AS BIGINT) AS currency_id,
            CAST(c_nationkey AS BIGINT) AS partner_id, n_name AS partner_name""",
        tail="JOIN nation ON n_nationkey = c_nationkey",
    ),
    "billable_items": statement("SELECT item_id FROM billable", "cli", "subscription", extra=_ITEMS),
    "item_flags": statement(
        f"""SELECT l.r IS NOT NULL AS cli_in_invoice, coalesce(s.v, false) AND b.term = 1 AS cli_should_be_billable,
            t.guid IS NOT NULL AS has_transaction_for_period, b.item_id AS cli_id, s.s.id AS subscription_id,
            'https://billing.example/subscriptions/' || s.s.id AS subscription_url,
            s.s.original_subscription_id AS original_subscription_id,
            'https://billing.example/subscriptions/' || s.s.original_subscription_id AS original_subscription_url,
            l.r.id AS invoice_row_id, s.s.status AS sub_status, s.s.quantity AS sub_quantity, b.term AS cli_term_in_months,
            s.s.commitment_term_end_date AS sub_commitment_end, CAST(l.r.total AS DOUBLE) AS invoice_row_total,
            l.r.start_period AS invoice_row_start_period, l.r.end_period AS invoice_row_end_period
        FROM billable b
        JOIN (SELECT completed_line_id, arg_max(x, id) AS s, arg_max({_VALID}, id) AS v FROM subscription x GROUP BY ALL) s
            ON s.completed_line_id = b.item_id
        LEFT JOIN (SELECT completed_line_item_id, arg_max(y, id) AS r FROM line y
            WHERE invoice_date = DATE '2000-06-01' GROUP BY ALL) l ON l.completed_line_item_id = b.item_id
        LEFT JOIN (SELECT DISTINCT 'G-' || completed_line_item_id AS guid FROM line
            WHERE return_flag <> 'R' AND invoice_date = DATE '2000-06-01') t ON t.guid = b.guid""",
        "cli", "subscription", "line",
        extra=_ITEMS,
    ),
    "invoice_reconciliation": statement(
        """SELECT hdr.invoice_id, hdr.partner_id, hdr.m AS invoice_month, coalesce(lc.n, 0) AS line_count,
            coalesce(sc.n, 0) AS subscription_count, coalesce(tc.n, 0) AS transaction_count,
            lc.s AS billing_period_start, lc.e AS billing_period_end, coalesce(pl.n, 0) AS partner_line_items,
            coalesce(ps.n, 0) AS partner_subscriptions, coalesce(ps.a, 0) AS active_subscriptions,
            coalesce(pt.n, 0) AS partner_transactions, coalesce(dt.n, 0) AS should_be_in_invoice,
            CASE WHEN coalesce(sc.n, 0) > 0 THEN coalesce(ms.n, 0) ELSE 0 END AS missing_subscriptions,
            CASE WHEN coalesce(tc.n, 0) > 0 THEN coalesce(mt.n, 0) ELSE 0 END AS missing_transactions,
            CASE WHEN coalesce(lc.n, 0) > 0 THEN pl.n - lc.ids ELSE 0 END AS missing_line_items
        FROM hdr LEFT JOIN lc USING (invoice_id) LEFT JOIN sc USING (invoice_id) LEFT JOIN tc USING (invoice_id)
            LEFT JOIN ms USING (invoice_id) LEFT JOIN mt USING (invoice_id)
            LEFT JOIN dt ON dt.partner_id = hdr.partner_id AND dt.m = hdr.m
            LEFT JOIN pl ON pl.owner = hdr.partner_id LEFT JOIN ps ON ps.company_id = hdr.partner_id
            LEFT JOIN pt ON pt.owner = hdr.partner_id""",
        "line", "product", "subscription",
        extra=_RECON,
    ),
    "missing_subscription_rows": statement(
        """SELECT s.company_id AS partner_id, s.id AS subscription_id, s.completed_line_id, s.billing_cycle_start, s.quantity
        FROM subs s WHERE lower(status) = 'active'
            AND EXISTS (SELECT 1 FROM hdr JOIN sc USING (invoice_id)
                WHERE hdr.partner_id = s.company_id AND hdr.m = date_trunc('month', s.billing_cycle_start))
            AND NOT EXISTS (SELECT 1 FROM hdr JOIN al USING (invoice_id) WHERE hdr.partner_id = s.company_id
                AND hdr.m = date_trunc('month', s.billing_cycle_start) AND al.completed_line_item_id = s.completed_line_id)""",
        "line", "product", "subscription",
        extra=_RECON,
    ),
    "missing_transaction_rows": statement(
        """SELECT t.owner AS partner_id, t.completed_line_item_id, t.invoice_date, t.line_id AS transaction_id, t.product_id, t.quantity
        FROM al t WHERE return_flag <> 'R'
            AND EXISTS (SELECT 1 FROM hdr JOIN tc USING (invoice_id) WHERE hdr.partner_id = t.owner AND hdr.m = t.invoice_date)
            AND NOT EXISTS (SELECT 1 FROM hdr JOIN al USING (invoice_id) WHERE hdr.partner_id = t.owner
                AND hdr.m = t.invoice_date AND al.completed_line_item_id = t.completed_line_item_id)""",
        "line", "product", "subscription",
        extra=_RECON,
    ),
    "missing_lines": statement(
        """SELECT line_id AS id, invoice_id, owner AS partner_id, product_id, start_period FROM al
        WHERE owner IN (SELECT o_custkey FROM orders JOIN lc ON invoice_id = o_orderkey WHERE o_orderstatus <> 'P')
            AND line_id NOT IN (SELECT line_id FROM al JOIN orders ON o_orderkey = invoice_id WHERE o_orderstatus <> 'P')""",
        "line", "product", "subscription",
        extra=_RECON,
    ),
    "matched_lines": statement(
        """SELECT id, invoice_id, invoice_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AS is_matched
        FROM line""",
        "line",
    ),
    "first_lines": statement(
        """SELECT completed_line_item_id, min(id) AS id, arg_min(invoice_id, id) AS invoice_id, arg_min(product_id, id) AS product_id
        FROM line GROUP BY completed_line_item_id""",
        "line",
    ),
    "invoice_bundle_rows": statement(
        """SELECT 'invoice' AS frame, NULL::BIGINT AS invoice_id, id::VARCHAR AS row_key FROM ch
            UNION ALL SELECT 'invoice_line_items', invoice_id, id FROM ol
            UNION ALL SELECT 'subscriptions', invoice_id, su.id::VARCHAR FROM su JOIN ol ON ol.completed_line_item_id = su.completed_line_id
            UNION ALL SELECT 'transactions', ol.invoice_id, 'G-' || om.completed_line_item_id
                FROM om JOIN cli ON cli.id = om.completed_line_item_id JOIN ol ON ol.completed_line_item_id = cli.id
            UNION ALL SELECT 'completed_line_items', invoice_id, it.id::VARCHAR FROM it JOIN ol ON ol.completed_line_item_id = it.id
            UNION ALL SELECT 'partner_line_items', invoice_id, id FROM al
                WHERE partner_id IN (FROM ow) AND start_period >= DATE '1999-01-01'
            UNION ALL SELECT 'partner_subscriptions', NULL, id::VARCHAR FROM su
                WHERE partner_id IN (FROM ow) AND start_date >= DATE '1999-01-01'
            UNION ALL SELECT 'partner_transactions', NULL, 'G-' || completed_line_item_id FROM om
                WHERE anniversary_billing AND partner_id IN (FROM ow) AND start_period >= DATE '1999-01-01'
            UNION ALL SELECT 'partner_completed_line_items', NULL, it.id::VARCHAR FROM it JOIN orders ON o_orderkey = order_id
                JOIN accounts a ON a.company_id = o_custkey
                WHERE a.partner_id IN (FROM ow) AND provision_start >= DATE '1999-01-01'""",
        "invoice", "product", "owned_line", "subscription", "cli",
        extra=_BUNDLE,
    ),
    "transaction_stats": statement(
        """SELECT partner_id, count(*) AS total_transactions, count(DISTINCT tid) AS distinct_transaction_ids,
            count(*) - count(DISTINCT tid) AS duplicate_transactions FROM tx GROUP BY partner_id""",
        "owned_line",
        extra=_TX,
    ),
    "transaction_months": statement(
        """SELECT partner_id, CAST(year(invoice_date) AS INTEGER) AS year, CAST(month(invoice_date) AS INTEGER) AS month,
            count(*) AS transaction_count FROM tx GROUP BY ALL""",
        "owned_line",
        extra=_TX,
    ),
    "invoice_bundle": statement(
        """SELECT * FROM (
            SELECT 'invoice' AS frame, count(*) AS row_count FROM ch
            UNION ALL SELECT 'invoice_line_items', count(*) FROM ol
            UNION ALL SELECT 'subscriptions', count(*) FROM su JOIN ol ON ol.completed_line_item_id = su.completed_line_id
            UNION ALL SELECT 'transactions', count(*) FROM om JOIN cli ON cli.id = om.completed_line_item_id
                JOIN ol ON ol.completed_line_item_id = cli.id
            UNION ALL SELECT 'completed_line_items', count(*) FROM it JOIN ol ON ol.completed_line_item_id = it.id
            UNION ALL SELECT 'partner_line_items', count(*) FROM al WHERE partner_id IN (FROM ow) AND start_period >= DATE '1999-01-01'
            UNION ALL SELECT 'partner_subscriptions', count(*) FROM su WHERE partner_id IN (FROM ow) AND start_date >= DATE '1999-01-01'
            UNION ALL SELECT 'partner_transactions', count(*) FROM om
                WHERE anniversary_billing AND partner_id IN (FROM ow) AND start_period >= DATE '1999-01-01'
            UNION ALL SELECT 'partner_completed_line_items', count(*) FROM it JOIN orders ON o_orderkey = order_id
                JOIN accounts a ON a.company_id = o_custkey
                WHERE a.partner_id IN (FROM ow) AND provision_start >= DATE '1999-01-01')""",
        "invoice", "product", "owned_line", "subscription", "cli",
        extra=_BUNDLE,
    ),
}
