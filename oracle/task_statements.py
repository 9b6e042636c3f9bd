"""Statements for task telemetry and duration alerting."""

from oracle.views import count, percent, ratio, statement

METHODS = "('purchase','view','signup','error','click')"

# Ranks are taken from a full sort here, on purpose another way than the engine's.
_DURATIONS = f"""
dur_rows AS (
    SELECT task_table, invoice_date, method, run_duration AS v,
        row_number() OVER (PARTITION BY task_table, invoice_date, method ORDER BY run_duration) - 1 AS rk,
        count(*) OVER (PARTITION BY task_table, invoice_date, method) AS n
    FROM tasks
    WHERE status = 'finished' AND method IN {METHODS} AND run_duration IS NOT NULL
        AND invoice_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'
),
dur_stats AS (
    SELECT task_table, invoice_date, method, CAST(max(n) AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS s,
        min(v) AS lo, max(v) AS hi,
        {", ".join(
            f"max(CASE WHEN rk = ((n-1)*{p})//100 THEN v END)*100 + "
            f"(max(CASE WHEN rk = ((n-1)*{p}+99)//100 THEN v END) - max(CASE WHEN rk = ((n-1)*{p})//100 THEN v END))"
            f" * ((max(n)-1)*{p} % 100) AS p{p}"
            for p in (50, 95, 99)
        )}
    FROM dur_rows GROUP BY ALL
),
dur AS (
    SELECT task_table, invoice_date, method, n AS total_tasks, lo AS min_runtime_ms, hi AS max_runtime_ms,
        {ratio('s', 'n')} AS avg_runtime_ms, s AS total_runtime_ms,
        {ratio('lo', '1000')} AS min_runtime_sec, {ratio('hi', '1000')} AS max_runtime_sec,
        {ratio('s', 'n*1000')} AS avg_runtime_sec, {ratio('s', '1000')} AS total_runtime_sec,
        {ratio('s', '60000')} AS total_runtime_min, {ratio('s', '3600000')} AS total_runtime_hours,
        {ratio('p50', '100000')} AS p50_runtime_sec, {ratio('p95', '100000')} AS p95_runtime_sec,
        {ratio('p99', '100000')} AS p99_runtime_sec,
        s > 500000 AS alert_24hr_exceeded, hi > 150000 AS alert_30min_task_exceeded,
        CASE WHEN s > 500000 THEN 'ALERT: Total runtime exceeds 500 seconds ('
                || CAST(CAST({ratio('s', '3600000')} AS DECIMAL(18,2)) AS VARCHAR) || 'h)'
            WHEN hi > 150000 THEN 'WARNING: Individual task exceeds 150 seconds ('
                || CAST(CAST({ratio('hi', '1000')} AS DECIMAL(18,2)) AS VARCHAR) || 's)' END AS alert_message
    FROM dur_stats
)"""


def _dur(body: str) -> str:
    return statement(body, "tasks", extra=_DURATIONS)


def _mean2(column: str) -> str:
    return ratio(f"sum(CAST(CAST({column} AS DECIMAL(18,2)) * 100 AS BIGINT))", f"count({column}) * 100")


_HOURS = "sum(CAST(total_runtime_hours AS DECIMAL(18,2)))"

_STATES = f"""
chg AS (
    SELECT *, CASE WHEN method = 'click' THEN 'reviewed' ELSE status END AS st FROM tasks
),
states AS (
    SELECT h.*, a.region AS partner_region, product.vendor
    FROM (
        SELECT subscription_id, product_id, arg_max(st, (updated_dt, id)) AS current_status,
            bool_or(st = 'error') AS ever_error, bool_or(st = 'finished') AS ever_finished,
            bool_or(st = 'reviewed') AS ever_reviewed,
            CAST(date_trunc('month', min(run_on)) AS DATE) AS run_on_month,
            arg_max(error_message, (updated_dt, id)) FILTER (WHERE st = 'error') AS last_error_message
        FROM chg GROUP BY ALL
    ) h JOIN accounts a ON a.company_id = h.subscription_id JOIN product ON product.id = h.product_id
),
totals AS (
    SELECT run_on_month, partner_region, vendor, count(*) AS tasks_total,
        {count('ever_finished')} AS finished_tasks_total, {count('ever_error')} AS errored_tasks_total,
        {count('ever_reviewed')} AS reviewed_tasks_total,
        {count("current_status = 'new'")} AS new_tasks_current,
        {count("current_status = 'error'")} AS errored_tasks_current,
        {count("current_status = 'reviewed'")} AS reviewed_tasks_current,
        {count("current_status = 'finished'")} AS finished_tasks_current,
        {count("ever_error AND current_status <> 'error'")} AS errored_tasks_resolved,
        {count("ever_error AND current_status = 'error'")} AS errored_tasks_unresolved
    FROM states GROUP BY ALL
),
cats AS (
    SELECT run_on_month, vendor,
        CASE WHEN last_error_message LIKE '%timeout%' THEN 'Connectivity'
             WHEN last_error_message LIKE '%missing price%' THEN 'Pricing'
             WHEN last_error_message LIKE '%duplicate key%' THEN 'Duplicate' ELSE 'Other' END AS error_category,
        count(*) AS errors_total, {count("current_status <> 'error'")} AS errors_resolved,
        {count("current_status = 'error'")} AS errors_unresolved
    FROM states WHERE ever_error GROUP BY ALL
)"""


def _st(body: str) -> str:
    return statement(body, "tasks", "accounts", "product", extra=_STATES)


_SUMS = [
    "tasks_total", "finished_tasks_total", "errored_tasks_total", "reviewed_tasks_total", "new_tasks_current",
    "errored_tasks_current", "reviewed_tasks_current", "finished_tasks_current", "errored_tasks_resolved",
    "errored_tasks_unresolved",
]


def _breakdown(key: str) -> str:
    sums = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMS)
    return f"""SELECT *, {percent('errored_tasks_total', 'tasks_total')} AS error_rate,
        coalesce({percent('errored_tasks_resolved', 'errored_tasks_total')}, 0) AS resolution_rate
        FROM (SELECT {key}, {sums} FROM totals GROUP BY ALL)"""


_BILLING = """
billing AS (
    SELECT id, 'create-' || lower(priority) AS method,
        CASE status WHEN 'Paid' THEN 'finished' WHEN 'Unpaid' THEN 'new' ELSE 'error' END AS status,
        order_date AS run_on, invoice_date AS run_on_month, region AS partner_region
    FROM invoice
),
monthly AS (
    SELECT run_on_month, partner_region, method, count(*) AS tasks_total,
        count(*) FILTER (WHERE status = 'finished') AS finished_tasks_total,
        count(*) FILTER (WHERE status = 'error') AS errored_tasks_total,
        count(*) FILTER (WHERE status = 'reviewed') AS reviewed_tasks_total,
        count(*) FILTER (WHERE status = 'new') AS new_tasks_current,
        count(*) FILTER (WHERE status = 'error') AS errored_tasks_current
    FROM billing GROUP BY ALL
),
mt AS (
    SELECT run_on_month, sum(tasks_total) AS a, sum(finished_tasks_total) AS b, sum(errored_tasks_total) AS c,
        sum(reviewed_tasks_total) AS d FROM monthly GROUP BY ALL
),
prev AS (
    SELECT run_on_month, CAST(coalesce(lag(a) OVER w, 0) AS BIGINT) AS prev_tasks_total,
        CAST(coalesce(lag(b) OVER w, 0) AS BIGINT) AS prev_finished_total,
        CAST(coalesce(lag(c) OVER w, 0) AS BIGINT) AS prev_errored_total,
        CAST(coalesce(lag(d) OVER w, 0) AS BIGINT) AS prev_reviewed_total
    FROM mt WINDOW w AS (ORDER BY run_on_month)
),
lagged AS (SELECT monthly.*, prev.* EXCLUDE (run_on_month) FROM monthly JOIN prev USING (run_on_month)
    WHERE run_on_month = DATE '2000-06-01')"""


def _bill(body: str) -> str:
    return statement(body, "invoice", extra=_BILLING)


def _change(now: str, before: str) -> str:
    return f"CASE WHEN {before} = 0 THEN CASE WHEN {now} > 0 THEN 100.0 ELSE 0.0 END ELSE {percent(f'{now} - {before}', before)} END"


_DETAILS = """
details AS (
    SELECT replace(left(t.error_message, 300), '|', '-') AS error_message,
        CAST(a.partner_id AS VARCHAR) || ' - ' || a.partner_name AS partner_info, p.name AS product_info,
        t.subscription_id, a.company_id AS original_subscription_id, t.method, t.status,
        a.region AS partner_region, p.vendor, CAST(t.run_on AS DATE) AS run_on
    FROM tasks t LEFT JOIN accounts a ON a.company_id = t.subscription_id
        LEFT JOIN product p ON p.id = a.company_id
    WHERE CAST(t.run_on AS DATE) = DATE '2024-01-15'
)"""


def _details(body: str) -> str:
    return statement(body, "tasks", "accounts", "product", extra=_DETAILS)


_ETA = """CASE WHEN hourly_completed <= 0 THEN 'N/A'
    WHEN total_count * 60 // hourly_completed = 0 THEN '< 1 min'
    WHEN total_count * 60 // hourly_completed < 60 THEN (total_count * 60 // hourly_completed) || ' min'
    WHEN (total_count * 60 // hourly_completed) % 60 = 0 THEN (total_count * 60 // hourly_completed // 60) || ' hr'
    ELSE (total_count * 60 // hourly_completed // 60) || ' hr ' || ((total_count * 60 // hourly_completed) % 60) || ' min' END"""

_BACKLOG = """
listed AS (SELECT unnest(['billing_task','billing_task_2','mca_task','mca_task_2','mca_task_3','mca_task_4',
    'mca_task_5','widget_task']) AS table_name),
opens AS (SELECT task_table, method, count(*) AS n FROM tasks WHERE status = 'new' GROUP BY ALL),
hourly AS (SELECT task_table, count(*) AS h FROM tasks
    WHERE status = 'finished' AND updated_dt BETWEEN TIMESTAMP '2024-01-30 22:00:00' AND TIMESTAMP '2024-01-30 23:00:00' GROUP BY ALL),
backlog AS (
    SELECT table_name,
        coalesce(method, CASE WHEN table_name = 'widget_task' THEN 'table_not_found' ELSE 'no_data' END) AS method,
        coalesce(n, 0) AS open_count, coalesce(h, 0) AS hourly_completed
    FROM listed LEFT JOIN opens ON opens.task_table = table_name LEFT JOIN hourly ON hourly.task_table = table_name
)"""
_BACKLOG_OPEN_END = _BACKLOG.replace(
    "BETWEEN TIMESTAMP '2024-01-30 22:00:00' AND TIMESTAMP '2024-01-30 23:00:00'", ">= TIMESTAMP '2024-01-30 22:00:00'"
)

STATEMENTS = {
    "task_duration_alerts": _dur("SELECT * FROM dur"),
    "alert_details": _dur(
        """SELECT CASE WHEN alert_24hr_exceeded THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
            invoice_date AS "date", task_table AS "table", method,
            CASE WHEN alert_24hr_exceeded THEN total_runtime_hours END AS runtime_hours,
            CASE WHEN NOT alert_24hr_exceeded THEN max_runtime_sec END AS max_runtime_sec, total_tasks,
            CASE WHEN alert_24hr_exceeded THEN 'Total runtime ' || CAST(CAST(total_runtime_hours AS DECIMAL(18,2)) AS VARCHAR)
                    || 'h exceeds 500 seconds threshold'
                ELSE 'Individual task ' || CAST(CAST(max_runtime_sec AS DECIMAL(18,2)) AS VARCHAR)
                    || 's exceeds 150 seconds threshold' END AS message
        FROM dur WHERE alert_24hr_exceeded OR alert_30min_task_exceeded"""
    ),
    "latest_alerts": _dur(
        """SELECT invoice_date AS "date", CASE WHEN alert_24hr_exceeded THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
            task_table AS "table", method FROM dur WHERE alert_24hr_exceeded OR alert_30min_task_exceeded
        ORDER BY 1 DESC, 2 DESC, 3, 4 LIMIT 25"""
    ),
    "tasks_by_parameters": statement(
        """SELECT task_table, count(*) AS task_count FROM tasks WHERE method = 'view' AND run_on >= DATE '2024-01-15'
        GROUP BY task_table""",
        "tasks",
    ),
    "alert_summary": _dur(
        f"""SELECT {count('alert_24hr_exceeded OR alert_30min_task_exceeded')} AS total_alerts,
            {count('alert_24hr_exceeded')} AS critical_alerts,
            {count('alert_30min_task_exceeded AND NOT alert_24hr_exceeded')} AS warning_alerts,
            coalesce(max(total_runtime_hours), 0) AS max_runtime_hours,
            count(DISTINCT invoice_date) FILTER (WHERE alert_message IS NOT NULL) AS affected_date_count,
            max(invoice_date) FILTER (WHERE alert_message IS NOT NULL) AS latest_affected_date
        FROM dur"""
    ),
    "warning_only_groups": _dur(
        """SELECT task_table, invoice_date, method, max_runtime_sec, alert_message,
            CASE WHEN max_runtime_sec < 60 THEN printf('%.1fs', max_runtime_sec)
                WHEN max_runtime_sec < 3600 THEN printf('%.1fm', max_runtime_sec / 60)
                ELSE printf('%.1fh', max_runtime_sec / 3600) END AS max_runtime_text
        FROM dur WHERE alert_30min_task_exceeded AND NOT alert_24hr_exceeded"""
    ),
    "performance_summary": _dur(
        f"""SELECT CAST(sum(total_tasks) AS BIGINT) AS total_tasks, CAST({_HOURS} AS DOUBLE) AS total_runtime_hours,
            {ratio('CAST(sum(CAST(avg_runtime_sec AS DECIMAL(18,2)) * total_tasks) * 100 AS BIGINT)', 'sum(total_tasks) * 100')} AS avg_runtime_sec,
            max(p95_runtime_sec) AS p95_runtime_sec,
            arg_max(task_table, (total_runtime_hours, invoice_date, method, task_table)) AS slowest_task_table,
            CAST(max(invoice_date) - min(invoice_date) + 1 AS INTEGER) AS date_range_days
        FROM dur"""
    ),
    "overall_performance": statement(
        f"""SELECT count(*) AS total_tasks, {count("status = 'finished'")} AS completed_tasks,
            {count("status = 'new'")} AS new_tasks, {count("status = 'error'")} AS error_tasks,
            min(created_dt) AS first_task_queued,
            max(updated_dt) FILTER (WHERE status = 'finished') AS last_task_completed,
            {ratio("epoch_us(max(updated_dt) FILTER (WHERE status = 'finished')) - epoch_us(min(created_dt))", "3600000000")} AS total_runtime_hours,
            {percent(count("status = 'finished'"), 'count(*)')} AS completion_rate_percent,
            {ratio("sum(run_duration) FILTER (WHERE status = 'finished')", "(count(run_duration) FILTER (WHERE status = 'finished')) * 1000")} AS avg_task_runtime_seconds
        FROM tasks WHERE invoice_date = DATE '2024-01-15'""",
        "tasks",
    ),
    "task_distribution": statement(
        f"""SELECT task_table, method, count(*) AS task_count, {count("status = 'finished'")} AS completed_count,
            {count("status = 'new'")} AS new_count, {count("status = 'error'")} AS error_count,
            {percent(count("status = 'finished'"), 'count(*)')} AS completion_rate,
            {ratio("sum(run_duration) FILTER (WHERE status = 'finished')", "(count(run_duration) FILTER (WHERE status = 'finished')) * 1000")} AS avg_runtime_seconds
        FROM tasks WHERE invoice_date = DATE '2024-01-15' GROUP BY ALL""",
        "tasks",
    ),
    "duration_trends": _dur(
        f"""SELECT invoice_date, method, CAST({_HOURS} AS DOUBLE) AS total_runtime_hours,
            CAST(sum(total_tasks) AS BIGINT) AS total_tasks, {_mean2('avg_runtime_sec')} AS avg_runtime_sec
        FROM dur GROUP BY invoice_date, method"""
    ),
    "method_comparison": _dur(
        f"""SELECT method, CAST(sum(total_tasks) AS BIGINT) AS total_tasks, CAST({_HOURS} AS DOUBLE) AS total_runtime_hours,
            {_mean2('avg_runtime_sec')} AS avg_runtime_sec, {_mean2('p95_runtime_sec')} AS p95_runtime_sec,
            coalesce({ratio('sum(total_tasks) * 100', f'CAST({_HOURS} * 100 AS BIGINT)')}, 0) AS tasks_per_hour
        FROM dur GROUP BY method"""
    ),
    "table_comparison": _dur(
        f"""SELECT task_table, CAST(sum(total_tasks) AS BIGINT) AS total_tasks,
            CAST({_HOURS} AS DOUBLE) AS total_runtime_hours, {_mean2('avg_runtime_sec')} AS avg_runtime_sec,
            {ratio('sum(total_tasks)', '(SELECT count(DISTINCT invoice_date) FROM dur)')} AS avg_tasks_per_day
        FROM dur GROUP BY task_table"""
    ),
    "available_dates": statement(
        """SELECT DISTINCT invoice_date, method, task_table AS source_table FROM tasks
        WHERE status = 'finished' ORDER BY invoice_date DESC, method, source_table LIMIT 20""",
        "tasks",
    ),
    "status_table": statement(
        f"""SELECT method, {count("raw_status = 'waiting'")} AS new, {count("raw_status = 'error'")} AS error,
            {count("raw_status = 'reviewed'")} AS reviewed, {count("raw_status = 'finished'")} AS finished,
            {count("raw_status = 'excluded'")} AS excluded, count(*) AS total FROM tasks GROUP BY method""",
        "tasks",
    ),
    "status_share": statement(
        f"""SELECT s.status, count(t.id) AS task_count,
            {percent('count(t.id)', '(SELECT count(*) FROM tasks)')} AS share_percent,
            CASE WHEN s.status = 'finished' THEN {ratio('sum(run_duration)', 'count(run_duration)')} END AS avg_run_duration
        FROM (SELECT unnest(['new','error','reviewed','finished','excluded']) AS status) s
            LEFT JOIN tasks t ON t.status = s.status GROUP BY s.status""",
        "tasks",
    ),
    "method_counts": "SELECT event_type AS method, count(*) AS task_count FROM events GROUP BY event_type",
    "latest_finished": statement(
        """SELECT task_table AS table_name,
            CASE WHEN task_table LIKE 'billing%' THEN 'Billing' ELSE 'MCA' END AS task_type,
            method, updated_dt, coalesce(service, 'unknown') AS task_runner
        FROM (SELECT *, row_number() OVER (PARTITION BY task_table ORDER BY updated_dt DESC, id DESC) AS rn
            FROM tasks WHERE status = 'finished') WHERE rn = 1""",
        "tasks",
    ),
    "open_backlog": statement("SELECT * FROM backlog", "tasks", extra=_BACKLOG),
    "open_backlog_eta": statement(
        f"""SELECT table_name, total_count, method_breakdown, hourly_completed, {_ETA} AS eta FROM (
            SELECT table_name, CAST(sum(open_count) AS BIGINT) AS total_count,
                CASE WHEN max(method) = 'table_not_found' THEN 'Table not found in database'
                    WHEN max(method) = 'no_data' THEN 'No open tasks'
                    ELSE string_agg(method || ' (' || open_count || ')', '; ' ORDER BY method) END AS method_breakdown,
                max(hourly_completed) AS hourly_completed
            FROM backlog GROUP BY table_name)""",
        "tasks",
        extra=_BACKLOG_OPEN_END,
    ),
    "data_freshness": statement(
        """SELECT 'cc' AS schema, task_table AS table_name,
            date_trunc('second', max(updated_dt)) - INTERVAL 7 HOUR AS latest_written FROM tasks GROUP BY task_table""",
        "tasks",
    ),
    "sharded_invoice_tasks": statement(
        """SELECT id, task_table, service, method, CASE WHEN id % 10 <> 0 THEN invoice_date END AS invoice_date,
            CASE WHEN task_table LIKE 'billing%' THEN product_id END AS partner_id,
            CASE WHEN task_table NOT LIKE 'billing%' THEN error_message END AS error_message, NULL::VARCHAR AS guid, run_duration
        FROM tasks""",
        "tasks",
    ),
    "sharded_billing_tasks": statement(
        """SELECT id, task_table, method, raw_status AS status_clean,
            CASE WHEN id % 10 <> 0 THEN CAST(product_id AS VARCHAR) END AS partner_id_parsed, NULL::VARCHAR AS company_id_parsed,
            DATE '2024-01-01' AS run_on_month
        FROM tasks WHERE method IN ('view','error','signup') AND run_on >= DATE '2024-01-01' AND run_on < DATE '2024-01-16'""",
        "tasks",
    ),
    "sharded_arrears_tasks": statement(
        """SELECT t.id, CASE t.id % 2 WHEN 0 THEN 'arrears_task' ELSE 'arrears_task_2' END AS task_table, 'new' AS status_clean,
            subscription_id, s.original_subscription_id, t.product_id, p.name AS product_name, p.vendor, error_message
        FROM tasks t JOIN subscription s ON s.id = subscription_id JOIN product p ON p.id = t.product_id
        WHERE method = 'purchase' AND run_on >= DATE '2024-01-01' AND run_on < DATE '2024-01-16'""",
        "tasks", "subscription", "product",
    ),
    "sharded_backlog": statement("SELECT * FROM backlog", "tasks", extra=_BACKLOG),
    "daily_task_counts": statement(
        """SELECT CAST(run_on AS DATE) AS running_day, status, count(*) AS task_count FROM tasks
        WHERE CAST(run_on AS DATE) > DATE '2024-01-30' - 20 AND CAST(run_on AS DATE) <= DATE '2024-01-30' AND method IN ('view','click','error') GROUP BY ALL""",
        "tasks",
    ),
    "merged_task_states": _st(
        """SELECT subscription_id, product_id, CAST(date_trunc('month', min(run_on)) AS DATE) AS run_on_month,
            arg_max(st, (updated_dt, id)) AS current_status, bool_or(st = 'error') AS ever_error,
            bool_or(st = 'finished') AS ever_finished, bool_or(st = 'reviewed') AS ever_reviewed,
            arg_max(error_message, (updated_dt, id)) FILTER (WHERE st = 'error') AS last_error_message
        FROM chg GROUP BY ALL"""
    ),
    "task_states": _st(
        """SELECT subscription_id, product_id, partner_region, vendor, run_on_month, current_status, ever_error,
            ever_finished, ever_reviewed, last_error_message FROM states"""
    ),
    "region_breakdown": _st(_breakdown("partner_region")),
    "vendor_breakdown": _st(_breakdown("vendor")),
    "top_error_vendors": _st(
        f"""SELECT * FROM ({_breakdown('vendor')}) WHERE errored_tasks_current > 0
        ORDER BY errored_tasks_current DESC, tasks_total DESC, vendor LIMIT 10"""
    ),
    "vendors_needing_validation": _st(
        """SELECT vendor, CAST(sum(new_tasks_current) AS BIGINT) AS new_tasks,
            CAST(sum(errored_tasks_current) AS BIGINT) AS error_tasks,
            CAST(sum(new_tasks_current + errored_tasks_current) AS BIGINT) AS total_incomplete,
            string_agg(DISTINCT partner_region, ', ' ORDER BY partner_region) AS regions
        FROM totals WHERE new_tasks_current > 0 OR errored_tasks_current > 0 GROUP BY vendor"""
    ),
    "error_totals": _st(
        """SELECT CAST(sum(errored_tasks_unresolved) AS BIGINT) AS errored_tasks_unresolved,
            CAST(sum(errored_tasks_resolved) AS BIGINT) AS errored_tasks_resolved,
            CAST(sum(errored_tasks_total) AS BIGINT) AS errored_tasks_total
        FROM totals WHERE run_on_month = DATE '2024-01-01'"""
    ),
    "completeness": _st(
        """SELECT bool_and(new_tasks_current = 0) AS data_collection_complete,
            bool_and(new_tasks_current + errored_tasks_current = 0) AS data_validation_complete FROM totals"""
    ),
    "error_categories": _st("SELECT * FROM cats"),
    "error_category_metrics": _st(
        f"""SELECT error_category, CAST(sum(errors_total) AS BIGINT) AS errors_total,
            CAST(sum(errors_resolved) AS BIGINT) AS errors_resolved,
            CAST(sum(errors_unresolved) AS BIGINT) AS errors_unresolved, count(DISTINCT vendor) AS vendor_count,
            {percent('sum(errors_resolved)', 'sum(errors_total)')} AS resolution_rate
        FROM cats GROUP BY error_category"""
    ),
    "category_vendors": _st(
        f"""SELECT vendor, CAST(sum(errors_total) AS BIGINT) AS errors_total,
            CAST(sum(errors_resolved) AS BIGINT) AS errors_resolved,
            CAST(sum(errors_unresolved) AS BIGINT) AS errors_unresolved,
            {percent('sum(errors_resolved)', 'sum(errors_total)')} AS resolution_rate
        FROM cats WHERE error_category = 'Pricing' GROUP BY vendor"""
    ),
    "arrears_error_top100": statement(
        """SELECT CAST(run_on AS DATE) AS run_on, error_message,
            CASE WHEN error_message LIKE '%timeout%' THEN 'Connectivity' WHEN error_message LIKE '%missing price%' THEN 'Pricing'
                WHEN error_message LIKE '%duplicate key%' THEN 'Duplicate' ELSE 'Other' END AS error_category,
            status, count(*) AS occurrence_count
        FROM tasks WHERE error_message IS NOT NULL GROUP BY ALL
        ORDER BY run_on DESC, occurrence_count DESC, error_message, status LIMIT 100""",
        "tasks",
    ),
    "monthly_method_status": _bill(
        """SELECT method, status, count(*) AS task_count FROM billing
        WHERE run_on_month = DATE '2000-06-01' GROUP BY ALL"""
    ),
    "monthly_run_status": _bill(
        """SELECT run_on AS run_day, status, count(*) AS task_count FROM billing
        WHERE run_on_month = DATE '2000-06-01' GROUP BY ALL"""
    ),
    "method_status_pivot": _bill(
        f"""SELECT method, {count("status = 'new'")} AS new, {count("status = 'error'")} AS error,
            {count("status = 'finished'")} AS finished
        FROM billing WHERE run_on_month = DATE '2000-06-01' GROUP BY method"""
    ),
    "task_status_lag": _bill("SELECT * FROM lagged"),
    "task_status_change": _bill(
        f"""SELECT *, {_change('tasks_total', 'tasks_previous')} AS tasks_change_percent,
            {_change('finished_total', 'finished_previous')} AS finished_change_percent,
            {_change('errored_total', 'errored_previous')} AS errored_change_percent,
            {_change('reviewed_total', 'reviewed_previous')} AS reviewed_change_percent
        FROM (SELECT run_on_month, CAST(sum(tasks_total) AS BIGINT) AS tasks_total,
                CAST(sum(finished_tasks_total) AS BIGINT) AS finished_total,
                CAST(sum(errored_tasks_total) AS BIGINT) AS errored_total,
                CAST(sum(reviewed_tasks_total) AS BIGINT) AS reviewed_total,
                max(prev_tasks_total) AS tasks_previous, max(prev_finished_total) AS finished_previous,
                max(prev_errored_total) AS errored_previous, max(prev_reviewed_total) AS reviewed_previous
            FROM lagged GROUP BY run_on_month)"""
    ),
    "method_completeness": _bill(
        f"""SELECT {", ".join(
            f"count(*) FILTER (WHERE method ILIKE '%{t}%') > 0 AND coalesce(sum(new_tasks_current + errored_tasks_current) "
            f"FILTER (WHERE method ILIKE '%{t}%'), 0) = 0 AS {n}_complete"
            for n, t in (("medium", "MEDIUM"), ("urgent", "urgent"), ("absent", "Tax"))
        )} FROM monthly"""
    ),
    "arrears_task_details": _details(
        "SELECT * FROM details WHERE vendor = 'Brand#4' AND method IN ('error','signup','view')"
    ),
    "vendor_digest": _details(
        """SELECT *, new_tasks = 0 AS ready,
            'Arrears Error - ' || vendor || ' - ' || CAST(run_on AS VARCHAR) AS summary FROM (
            SELECT run_on, method, vendor, count(*) FILTER (WHERE status = 'error') AS task_count,
                count(DISTINCT partner_info) FILTER (WHERE status = 'error') AS partners_impacted,
                count(DISTINCT subscription_id) FILTER (WHERE status = 'error') AS subscriptions_impacted,
                coalesce(string_agg(DISTINCT partner_region, ', ' ORDER BY partner_region)
                    FILTER (WHERE status = 'error'), '') AS regions,
                count(*) FILTER (WHERE status = 'new') AS new_tasks
            FROM details GROUP BY ALL) WHERE task_count > 0"""
    ),
    "ticket_rows": _details(
        """SELECT CASE WHEN error_message LIKE '%{%' AND error_message LIKE '%}%'
                THEN replace(replace(error_message, '{', '\\{'), '}', '\\}') ELSE error_message END AS error_message,
            partner_info, product_info, subscription_id, original_subscription_id, method, status, partner_region,
            vendor, run_on FROM details WHERE status = 'error'"""
    ),
    "vendor_usage_status": statement(
        """SELECT s.*, CAST(coalesce(cur, 0) AS DOUBLE) AS current_month_usd, CAST(coalesce(pri, 0) AS DOUBLE) AS prior_month_usd,
            coalesce(round(CASE WHEN pri <> 0 THEN CAST(coalesce(cur, 0) - pri AS DOUBLE) / CAST(pri AS DOUBLE) * 100 END, 4), 0)
                AS revenue_change_percent,
            CAST(coalesce(cur, 0) - coalesce(pri, 0) AS DOUBLE) AS revenue_difference_usd
        FROM (
            SELECT vendor, count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'error') AS error,
                count(*) FILTER (WHERE status = 'reviewed') AS reviewed,
                count(*) FILTER (WHERE status = 'finished') AS finished,
                count(*) FILTER (WHERE status = 'excluded') AS excluded, count(*) AS total,
                count(DISTINCT subscription_id) AS subscriptions
            FROM tasks JOIN product ON product.id = tasks.product_id GROUP BY vendor
        ) s LEFT JOIN (
            SELECT vendor, sum(total) FILTER (WHERE invoice_date = DATE '2000-06-01') AS cur,
                sum(total) FILTER (WHERE invoice_date = DATE '2000-05-01') AS pri
            FROM line JOIN product ON product.id = line.product_id GROUP BY vendor
        ) u ON u.vendor = s.vendor""",
        "tasks", "product", "line",
    ),
    "subscription_arrears_tasks": statement(
        """SELECT subscription_id, c_custkey AS original_subscription_id, CAST(c_custkey AS VARCHAR) || ' ' || c_name AS company_info,
            run_on, method, service, status, error_message, task_table AS table_source
        FROM tasks JOIN customer ON c_custkey = subscription_id""",
        "tasks",
    ),
    "billing_day_groups": """SELECT p_size AS billing_day_of_month, p_name AS name, 'runner-' || p_brand AS task_runner
        FROM part WHERE p_size IN (1, 2, 3)""",
    "category_share": statement(
        """SELECT CASE method WHEN 'purchase' THEN 'Invoice Generation' WHEN 'view' THEN 'Invoice Release' END AS category,
            status, count(*) AS task_count FROM tasks GROUP BY ALL""",
        "tasks",
    ),
}
