"""Adjustment files: ledger uploads and order uploads."""

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from billweave.functions import dates
from billweave.operators import ordered
from billweave.schemas import require_columns

METHODS = ("missed_billing", "duplicate_billing")

ORDER_UPLOAD_INPUT = [
    "company_name", "successor_subscription_start_date", "estimated_billing_start_period",
    "estimated_billing_end_period", "product_unit_of_measure", "successor_rate_plan_type", "charge_type",
    "actual_retail_price", "partner_buy_rate", "wholesale_buy_rate", "completed_order_purchase_order_number",
    "currency_guid", "completed_line_item_guid", "subscription_guid", "original_subscription_guid", "product_uuid",
    "product_vendor_uuid", "product_name", "completed_line_item_sku", "successor_term", "is_flat_rate",
    "current_subscription_quantity", "partner_guid", "company_guid", "transaction_month",
    "successor_commitment_term_end_date",
]


def ledger_upload(
    rows: DataFrame,
    type_column: str,
    partner_value: str,
    company_value: str,
    partner_cost: str,
    company_cost: str,
    method: str,
    as_of: date,
    description: str = "Ledger Adjustment",
    partner_id: str | None = None,
    company_id: str | None = None,
    subscription_id: str | None = None,
    company_name: str | None = None,
    product_name: str | None = None,
    quantity: str | None = None,
    start_period: str | None = None,
    end_period: str | None = None,
) -> DataFrame:
    """Ledger upload rows. Missed billing charges positive amounts and credits negative ones.

    Duplicate billing does the opposite. Rows of another type, and amounts of zero or null, are dropped.
    """
    if method not in METHODS:
        raise ValueError(f"unknown calculation method {method!r}, expected one of {list(METHODS)}")

    def optional(name: str | None) -> Column:
        return F.lit(None).cast("string") if name is None else F.col(name)

    def named(name: str | None) -> Column:
        text = F.lit(None).cast("string") if name is None else F.col(name).cast("string")
        return F.coalesce(text, F.lit("N/A"))

    is_partner = F.col(type_column) == partner_value
    amount = F.when(is_partner, F.col(partner_cost)).when(F.col(type_column) == company_value, F.col(company_cost))
    charged = amount > 0 if method == "missed_billing" else amount < 0
    credited = amount < 0 if method == "missed_billing" else amount > 0
    rounded = F.round(F.abs(amount), 2)
    count = F.coalesce(optional(quantity).try_cast("decimal(18,4)").cast("bigint").cast("string"), F.lit("N/A"))
    text = F.concat(
        F.lit(f"{description} for Company: "), named(company_name), F.lit(" and Product: "), named(product_name),
        F.lit(" at a quantity of "), count,
    )
    none = F.lit(None).cast("string")
    return rows.filter(charged | credited).select(
        F.when(is_partner, optional(partner_id)).alias("Partner ID"),
        optional(company_id).alias("Company ID"),
        optional(subscription_id).alias("Subscription ID"),
        F.when(charged, "SERVICE_CHARGE").otherwise("SERVICE_CREDIT").alias("Type"),
        F.lit(dates.month_start(as_of).isoformat()).alias("Transaction Date"),
        F.when(credited, rounded).alias("Credit"),
        F.when(charged, rounded).alias("Debit"),
        F.trim(text).alias("Description"),
        none.alias("Partner UUID"),
        none.alias("Vendor ID"),
        none.alias("Company UUID"),
        F.lit(False).alias("Tax Excluded"),
        none.alias("Subscription UUID"),
        none.alias("Vendor UUID"),
        optional(start_period).alias("Billing Period Start"),
        optional(end_period).alias("Billing Period End"),
        none.alias("Product ID"),
    )


def order_upload(rows: DataFrame, order: Sequence[Column], offered_by: str = "") -> DataFrame:
    """Order upload rows, one per (item, subscription, original subscription): the first by `order`."""
    require_columns(rows, ORDER_UPLOAD_INPUT)
    first = ordered.keep_first(
        rows, ["completed_line_item_guid", "subscription_guid", "original_subscription_guid"], order
    )
    quantity = F.col("current_subscription_quantity").try_cast("decimal(18,4)")

    def price(column: str) -> Column:
        return F.col(column).try_cast("decimal(18,6)")

    def day(column: str) -> Column:
        return F.date_format(column, "yyyy-MM-dd")

    def unit(column: str) -> Column:
        return F.round(price(column), 4)

    def whole(column: str) -> Column:
        return F.round(price(column) * quantity, 4)

    # The fields of the upload format, in its order.
    return first.select(
        F.col("company_name").alias("companyName"),
        day("successor_subscription_start_date").alias("orderDate"),
        day("estimated_billing_start_period").alias("serviceStart"),
        day("estimated_billing_start_period").alias("startPeriod"),
        day("estimated_billing_end_period").alias("endPeriod"),
        F.col("product_unit_of_measure").alias("unitOfMeasure"),
        F.col("product_name").alias("description"),
        F.col("product_name").alias("bobDescription"),
        F.lit("").alias("descriptionExtras"),
        F.col("successor_rate_plan_type").alias("rateType"),
        F.col("charge_type").alias("chargeType"),
        unit("actual_retail_price").alias("price"),
        whole("actual_retail_price").alias("total"),
        unit("partner_buy_rate").alias("cost"),
        whole("partner_buy_rate").alias("costTotal"),
        unit("wholesale_buy_rate").alias("platformCost"),
        whole("wholesale_buy_rate").alias("platformCostTotal"),
        F.lit(offered_by).alias("offeredBy"),
        F.col("completed_order_purchase_order_number").alias("purchaseOrderNumber"),
        F.lit("").alias("details"),
        F.col("currency_guid").alias("currencyId"),
        F.col("completed_line_item_guid").alias("completedLineItemId"),
        F.col("subscription_guid").alias("subscriptionId"),
        F.col("original_subscription_guid").alias("originalSubscriptionGuid"),
        F.col("product_uuid").alias("productUUID"),
        F.col("product_name").alias("productName"),
        F.col("product_vendor_uuid").alias("productVendorId"),
        F.col("completed_line_item_sku").alias("sku"),
        F.col("successor_term").alias("term"),
        F.col("successor_rate_plan_type").alias("ratePlanType"),
        F.col("is_flat_rate").alias("isFlatRate"),
        quantity.alias("quantity"),
        F.col("partner_guid").alias("partnerId"),
        F.col("company_guid").alias("companyId"),
        day("transaction_month").alias("invoiceDate"),
        F.lit("subscription").alias("type"),
        day("successor_commitment_term_end_date").alias("billingRenewal"),
    )
