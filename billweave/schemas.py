"""Declared columns of the billing tables (the fields the operators read)."""

import re

_MONEY = "decimal(18,4)"

Fields = dict[str, str]


def _schema(text: str) -> Fields:
    """Column name to Spark type, from "name type, name type" text."""
    pairs = re.findall(r"(\w+)\s+([a-z]+(?:\(\d+,\d+\))?)", text)
    return dict(pairs)


def ddl(fields: Fields) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())


# The columns of any task table; a shard that lacks one gets nulls.
TASK_FIELDS = _schema(
    """id bigint, service string, method string, payload string, status string,
    created_dt timestamp, updated_dt timestamp, error_count int, error_message string,
    run_on timestamp, run_duration bigint, partner_id bigint, run_on_date_time timestamp,
    guid string, subscription_id bigint, product_id bigint"""
)

TABLES: dict[str, Fields] = {
    "invoice": _schema(
        f"""id bigint, alternate_id string, guid string, invoice_date date, due_date date,
        partner_id bigint, company_id bigint, status string, total {_MONEY}, balance {_MONEY},
        carried_balance {_MONEY}, sales_tax {_MONEY}, currency_id bigint, business_unit_code string,
        is_email_sent boolean, approved boolean, created_dt timestamp, updated_dt timestamp,
        billing_id bigint, billing_number string, archive_rows_match boolean"""
    ),
    "csv_invoice_row_archive": _schema(
        f"""id bigint, invoice_id bigint, partner_id bigint, partner_name string, company_id bigint,
        company_name string, product_id bigint, product_name string, row_type string, term string,
        sku string, quantity int, price {_MONEY}, total {_MONEY}, total_after_tax {_MONEY},
        cost_total {_MONEY}, cost_total_after_tax {_MONEY}, platform_cost {_MONEY},
        platform_cost_total {_MONEY}, billed_by_platform boolean, bills_in_arrears boolean,
        billing_fee {_MONEY}, billing_fee_after_tax {_MONEY}, currency_code string, invoice_date date,
        start_period date, end_period date, arrears_subscription_id bigint,
        completed_line_item_id bigint, is_voided boolean, created_dt timestamp"""
    ),
    "csv_invoice_row": _schema(
        f"partner_id bigint, company_id bigint, cost_total {_MONEY}, invoice_date date"
    ),
    "ledger": _schema(
        f"""id bigint, partner_id bigint, company_id bigint, product_id bigint, type string,
        credit {_MONEY}, debit {_MONEY}, description string, transaction_date date,
        credit_memo_id bigint, invoice_id bigint"""
    ),
    "credit_memo": _schema(
        f"""id bigint, alternate_id string, credit_sum {_MONEY}, created_date date, send_date date,
        business_unit_unique_code string, partner_id bigint"""
    ),
    "ledger_entry_sales_tax": _schema(
        f"ledger_entry_id bigint, amount_excluding_tax {_MONEY}, tax_amount {_MONEY}, rate {_MONEY}"
    ),
    "partner": _schema(
        """id bigint, guid string, name string, business_unit_guid string, payment_day int,
        is_invoice_dirty boolean, currency_id bigint, deleted boolean, test_partner boolean,
        is_root_partner boolean, is_house_account boolean, auto_invoice_enabled boolean,
        registration_number string, tax_id string"""
    ),
    "company": _schema(
        """id bigint, name string, partner_id bigint, payment_day int, is_invoice_dirty boolean,
        currency_id bigint, status string, bill_on_behalf_of_enabled boolean, is_telco boolean"""
    ),
    "product": _schema(
        "id bigint, uuid string, name string, sku string, vendor string, anniversary_billing boolean"
    ),
    "subscription": _schema(
        """id bigint, original_subscription_id bigint, partner_id bigint, company_id bigint,
        product_id bigint, status string, quantity int, start_date date, end_date date,
        billing_cycle_start date, billing_cycle_end date, commitment_term_end_date date,
        commitment_term_id bigint, completed_line_id bigint, created_dt timestamp"""
    ),
    "completed_line_item": _schema(
        f"""id bigint, guid string, arrears_subscription_id bigint, product_id bigint,
        rate_plan_id bigint, completed_order_id bigint, approving_user_id bigint, type string,
        term string, term_in_months int, quantity int, total {_MONEY}, provision_start date,
        voided boolean, currency_id bigint, gross_revenue {_MONEY}, partner_buy_rate {_MONEY},
        actual_retail_price {_MONEY}, wholesale_buy_rate {_MONEY}, sku string, created_dt timestamp"""
    ),
    "order_manager_transaction": _schema(
        f"""guid string, completed_line_item_id string, subscription_id bigint, product_uuid string,
        partner_id string, company_id bigint, quantity int, price {_MONEY}, total {_MONEY},
        start_period date, end_period date, invoice_date date, order_date date, charge_type string,
        type string, term string, sku string, product_name string"""
    ),
    "currency": _schema("id bigint, api_code string, iso_code string"),
    "business_unit_cache": _schema("uuid string, unique_code string, name string"),
    "rate_plan": _schema("id bigint, user_id bigint, start_date date, end_date date"),
    "app_user": _schema("id bigint, first_name string, last_name string, email string"),
    "commitment_term": _schema("id bigint, term_in_months int"),
    "provision_task": _schema(
        "id bigint, subscription_id bigint, type string, status string, additional_params string"
    ),
    "completed_order": _schema("id bigint, partner_id bigint"),
    "arrears_configuration_assignment": _schema(
        "product_id bigint, arrears_product_usage_configuration_id bigint"
    ),
    "arrears_product_usage_configuration": _schema(
        "id bigint, name string, task_runner string, billing_day_of_month int"
    ),
}

# The tables whose last write the freshness report shows.
FRESHNESS_TABLES = [
    "arrears_task", "arrears_task_2", "billing_task", "billing_task_2", "mca_task", "mca_task_2",
    "mca_task_3", "mca_task_4", "mca_task_5", "widget_task", "csv_invoice_row_archive", "invoice",
    "subscription", "partner", "company", "product", "business_unit_cache", "currency",
]


def empty(spark, name: str):
    """An empty DataFrame of a declared table."""
    return spark.createDataFrame([], ddl(TABLES[name]))


def require_columns(df, columns) -> None:
    """Fail before planning when input columns are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
