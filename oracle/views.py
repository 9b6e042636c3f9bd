"""The shared test tables seen as billing tables, in SQL, and helpers to build statements on them."""

SHARDS = "['billing_task','billing_task_2','mca_task','mca_task_2','mca_task_3','mca_task_4','mca_task_5']"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "tasks": (
        (),
        f"""SELECT event_id AS id,
            list_extract({SHARDS}, CAST(user_id % 7 AS INTEGER) + 1) AS task_table,
            CASE WHEN event_type <> 'click' THEN 'svc-' || event_type END AS service,
            event_type AS method, props AS payload,
            CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'waiting' ELSE 'finished' END AS raw_status,
            CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'new' ELSE 'finished' END AS status,
            CAST(round(value * 1000) AS BIGINT) AS run_duration,
            ts - to_milliseconds(CAST(round(value * 1000) AS BIGINT)) AS created_dt,
            ts AS updated_dt, ts AS run_on, CAST(ts AS DATE) AS invoice_date,
            CASE WHEN event_type = 'error' THEN
                CASE WHEN k < 25 THEN 'connection timeout ' || k
                     WHEN k < 50 THEN 'missing price {{plan ' || k || '}}'
                     WHEN k < 75 THEN 'duplicate key ' || k
                     ELSE 'unexpected | value ' || k END END AS error_message,
            user_id AS subscription_id, k AS product_id
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    ),
    "places": (
        (),
        """SELECT CAST(n_nationkey AS BIGINT) AS partner_id, n_name AS partner_name,
            CAST(r_regionkey AS BIGINT) AS currency_id, r_name AS region,
            CASE r_name WHEN 'AFRICA' THEN 'GBP' WHEN 'AMERICA' THEN 'USD' WHEN 'ASIA' THEN 'SGD'
                WHEN 'EUROPE' THEN 'EUR' WHEN 'MIDDLE EAST' THEN 'AED' END AS currency_code,
            CAST(CASE r_name WHEN 'AFRICA' THEN 1.24 WHEN 'AMERICA' THEN 1 WHEN 'ASIA' THEN 0.74
                WHEN 'EUROPE' THEN 1.07 ELSE 1 END AS DECIMAL(12,6)) AS rate
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    ),
    "accounts": (
        ("places",),
        """SELECT c_custkey AS company_id, c_name AS company_name, c_mktsegment AS segment, c_acctbal, places.*
        FROM customer JOIN places ON places.partner_id = c_nationkey""",
    ),
    "invoice": (
        ("accounts",),
        """SELECT o_orderkey AS id, 'INV-' || o_orderkey AS alternate_id, o_custkey AS owner_company_id,
            CAST(date_trunc('month', o_orderdate) AS DATE) AS invoice_date,
            CAST(o_orderdate AS DATE) + 30 AS due_date, CAST(o_orderdate AS DATE) AS order_date,
            CASE o_orderstatus WHEN 'F' THEN 'Paid' WHEN 'O' THEN 'Unpaid' ELSE 'Void' END AS status,
            CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(o_totalprice AS DECIMAL(18,2)) AS balance,
            CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.05 AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS sales_tax,
            CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN true
                 WHEN o_orderpriority IN ('3-MEDIUM','5-LOW') THEN false END AS is_email_sent,
            o_orderpriority <> '5-LOW' AS approved, o_orderpriority AS priority,
            CASE WHEN o_orderpriority <> '3-MEDIUM' THEN a.partner_id END AS partner_id,
            CASE WHEN o_orderpriority IN ('3-MEDIUM','5-LOW') THEN o_custkey END AS company_id,
            a.partner_id AS owner_partner_id, a.partner_name, a.company_name, a.currency_id, a.currency_code,
            a.region AS business_unit_code, a.region, a.rate
        FROM orders JOIN accounts a ON a.company_id = o_custkey""",
    ),
    "line": (
        (),
        """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
            l_orderkey AS invoice_id, CAST(l_linenumber AS BIGINT) AS line_number, l_partkey AS product_id,
            l_suppkey AS supplier_id, CAST(l_quantity AS BIGINT) AS quantity,
            CAST(l_extendedprice AS DECIMAL(18,2)) AS total,
            CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS cost_total,
            CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(18,2)) AS DECIMAL(18,4)) AS billing_fee,
            CASE l_returnflag WHEN 'A' THEN 'subscription' WHEN 'N' THEN 'prorate' ELSE 'arrears' END AS row_type,
            CASE WHEN l_linenumber < 7 THEN CASE l_linestatus WHEN 'F' THEN 'Monthly' ELSE 'Annual' END END AS term,
            l_linestatus AS line_status, l_returnflag AS return_flag,
            CAST(l_tax AS DECIMAL(18,2)) = 0.08 AS is_voided,
            CAST(date_trunc('month', l_shipdate) AS DATE) AS invoice_date,
            CAST(l_shipdate AS DATE) AS start_period, CAST(l_shipdate AS DATE) + 30 AS end_period,
            CASE WHEN l_returnflag = 'R' THEN l_orderkey END AS arrears_subscription_id,
            l_orderkey * 8 + l_linenumber AS completed_line_item_id
        FROM lineitem""",
    ),
    "owned_line": (
        ("line", "accounts"),
        """SELECT line.*, a.*, o_orderstatus AS order_status
        FROM line JOIN orders ON o_orderkey = invoice_id JOIN accounts a ON a.company_id = o_custkey""",
    ),
    "ledger": (
        ("line",),
        """SELECT line.id, invoice_id, o_custkey AS company_id, product_id,
            CASE return_flag WHEN 'A' THEN 'BOB_CUSTOMER_PAYMENT' WHEN 'N' THEN 'CHECK_ISSUED' ELSE 'SERVICE_CREDIT' END AS type,
            CAST(CASE WHEN return_flag = 'N' THEN 0 ELSE total END AS DECIMAL(18,2)) AS credit,
            CAST(CASE WHEN return_flag = 'N' THEN total ELSE 0 END AS DECIMAL(18,2)) AS debit,
            start_period AS transaction_date, 'posting ' || line.id AS description
        FROM line JOIN orders ON o_orderkey = invoice_id WHERE line_status = 'F'""",
    ),
    "open_rows": (
        ("line",),
        """SELECT o_custkey AS company_id, cost_total, invoice_date
        FROM line JOIN orders ON o_orderkey = invoice_id WHERE line_status = 'O'""",
    ),
    "product": (
        (),
        """SELECT p_partkey AS id, 'PR-' || p_partkey AS uuid, p_name AS name, p_type AS sku, p_brand AS vendor,
            p_size <= 40 AS anniversary_billing, p_size AS size FROM part""",
    ),
    "subscription": (
        (),
        """SELECT o_orderkey AS id, o_custkey AS original_subscription_id, o_custkey AS company_id,
            o_custkey AS product_id,
            CASE o_orderstatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Cancelled' ELSE 'Pending' END AS status,
            CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) / 50000) AS BIGINT) AS quantity,
            CAST(o_orderdate AS DATE) AS start_date,
            CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + 90 END AS end_date,
            CAST(o_orderdate AS DATE) AS billing_cycle_start,
            CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN
                CAST(CAST(o_orderdate AS DATE) + to_months(CAST(left(o_orderpriority, 1) AS INTEGER) * 3) AS DATE) END
                AS commitment_term_end_date,
            o_orderkey * 8 + 1 AS completed_line_id,
            CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH','3-MEDIUM') THEN 'Monthly' ELSE 'Annual' END AS term,
            CAST(o_totalprice AS DECIMAL(18,2)) AS price
        FROM orders""",
    ),
    "cli": (
        ("line",),
        """SELECT completed_line_item_id AS id, 'G-' || completed_line_item_id AS guid, product_id, supplier_id,
            row_type AS type, CASE WHEN line_status = 'F' THEN 1 ELSE 12 END AS term_in_months, quantity, total,
            cost_total AS gross_revenue, start_period AS provision_start, is_voided AS voided,
            arrears_subscription_id, invoice_id AS order_id
        FROM line""",
    ),
}


def statement(body: str, *views: str, extra: str = "") -> str:
    """`body` with the views it uses, and what they use, as common table expressions."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for dependency in VIEWS[name][0]:
            need(dependency)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        need(view)
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    if extra:
        parts.append(extra.strip().rstrip(","))
    return f"WITH {', '.join(parts)} {body}" if parts else body


def ratio(num: str, den: str, digits: int = 2) -> str:
    """num / den of whole numbers, rounded half away from zero, without binary error; null for den = 0."""
    scale = 10**digits
    n = f"CAST({num} AS HUGEINT)"
    d = f"CAST({den} AS HUGEINT)"
    return (
        f"CASE WHEN ({den}) = 0 THEN NULL ELSE CAST(sign({n}) * ((abs({n}) * {2 * scale} + {d}) // (2 * {d})) AS DOUBLE)"
        f" / {scale}.0 END"
    )


def percent(part: str, whole: str, digits: int = 2) -> str:
    return ratio(f"({part}) * 100", whole, digits)


def money(expression: str, digits: int = 2) -> str:
    return f"CAST(round({expression}, {digits}) AS DOUBLE)"


def count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"
