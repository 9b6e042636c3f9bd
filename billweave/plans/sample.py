"""The shared test tables seen as billing tables.

orders become invoices and subscriptions, lineitem becomes invoice lines, ledger postings and
completed line items, events become tasks, customer becomes company, nation becomes partner, region
becomes business unit and currency, part becomes product with its brand as vendor. Every table is a
projection (and dimension joins) of whole tables, so Spark prunes what a query does not use.
"""

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.constants import ARREARS_BILL_METHOD, ARREARS_TABLES, DURATION_TABLES, WAITING_STATUSES
from billweave.functions import dates, labels
from billweave.session import configure
from billweave.sources.scratch import scratch_folder
from billweave.sources.tables import ParquetTables

ORDERS_AS_OF = date(2000, 6, 1)
EVENTS_AS_OF = datetime(2024, 1, 30, 23, 0)
EVENTS_DAY = EVENTS_AS_OF.date()
CRITICAL_SECONDS = 500
WARNING_SECONDS = 150
EVENT_METHODS = ["purchase", "view", "signup", "error", "click"]

# The currency of each region; one is not in the rate table on purpose.
REGION_CURRENCY = {"AFRICA": "GBP", "AMERICA": "USD", "ASIA": "SGD", "EUROPE": "EUR", "MIDDLE EAST": "AED"}

# Error message patterns and their categories, first match wins.
ERROR_RULES = [
    ("timeout", "Connectivity"),
    ("missing price", "Pricing"),
    ("duplicate key", "Duplicate"),
]


def dec(column: str, digits: int = 2) -> Column:
    return F.col(column).cast(f"decimal(18,{digits})")


def mapped(column: Column, values: dict[str, str]) -> Column:
    result = F.lit(None).cast("string")
    for key, value in values.items():
        result = F.when(column == key, value).otherwise(result)
    return result


class Sample:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = configure(spark)
        self.source = ParquetTables(spark, root)
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self.source.table(name)
        return self._raw[name]

    def tasks(self) -> DataFrame:
        """Tasks in seven shards; run time in ms, payload with one id, messages on errors."""
        shard = F.element_at(F.array(*[F.lit(t) for t in DURATION_TABLES]), (F.col("user_id") % 7 + 1).cast("int"))
        kind = F.col("event_type")
        key = labels.json_text(F.col("props"), "k").cast("bigint")
        run_ms = F.round(F.col("value") * 1000).cast("bigint")
        problem = (
            F.when(key < 25, F.concat(F.lit("connection timeout "), key.cast("string")))
            .when(key < 50, F.concat(F.lit("missing price {plan "), key.cast("string"), F.lit("}")))
            .when(key < 75, F.concat(F.lit("duplicate key "), key.cast("string")))
            .otherwise(F.concat(F.lit("unexpected | value "), key.cast("string")))
        )
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            shard.alias("task_table"),
            F.when(kind != "click", F.concat(F.lit("svc-"), kind)).alias("service"),
            kind.alias("method"),
            F.col("props").alias("payload"),
            F.when(kind == "error", "error").when(kind == "signup", "waiting").otherwise("finished").alias("raw_status"),
            F.when(kind == "error", "error").when(kind == "signup", "new").otherwise("finished").alias("status"),
            run_ms.alias("run_duration"),
            (F.col("ts") - F.make_dt_interval(secs=run_ms.cast("decimal(18,6)") / 1000)).alias("created_dt"),
            F.col("ts").alias("updated_dt"),
            F.col("ts").alias("run_on"),
            F.to_date("ts").alias("invoice_date"),
            F.when(kind == "error", problem).alias("error_message"),
            F.col("user_id").alias("subscription_id"),
            key.alias("product_id"),
        )

    def task_shards(self) -> "TaskShards":
        """The tasks as tables of their own with differing columns, written to the shared folder.

        Billing tables have a partner and no error message, the others the reverse. Payloads nest the invoice date; those of
        every tenth id are cut off. Arrears tables hold the purchases.
        """
        folder = scratch_folder(self.spark)
        cut = F.col("id") % 10 == 0
        nested = F.format_string('{"invoiceDate":{"value":"%s"},"partnerId":%d}', F.col("invoice_date").cast("string"), F.col("product_id"))
        rows = self.tasks().select(
            "id", "task_table", "service", "method", F.when(cut, F.left(nested, F.lit(20))).otherwise(nested).alias("payload"),
            F.concat(F.lit(" "), F.upper("raw_status")).alias("status"),
            *[F.col(c).cast("timestamp").alias(c) for c in ("created_dt", "updated_dt", "run_on")],
            "run_duration", "error_message", F.col("product_id").alias("partner_id"), "subscription_id", "product_id",
            F.unix_millis(F.col("updated_dt").cast("timestamp")).alias("__ts_ms"),
        )
        for name in DURATION_TABLES:
            lacking = "error_message" if name.startswith("billing") else "partner_id"
            rows.filter(F.col("task_table") == name).drop("task_table", lacking, "subscription_id", "product_id").write.parquet(
                f"{folder}/{name}.parquet"
            )
        for k, name in enumerate(ARREARS_TABLES):
            purchases = rows.filter((F.col("method") == "purchase") & (F.col("id") % len(ARREARS_TABLES) == k))
            kept = purchases.withColumn("method", F.lit(ARREARS_BILL_METHOD)).withColumn("status", F.lit(WAITING_STATUSES[k]))
            kept.drop("task_table", "payload", "partner_id").write.parquet(f"{folder}/{name}.parquet")
        return TaskShards(self, folder)

    def places(self) -> DataFrame:
        """Nation with its region, currency included."""
        return (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.col("n_nationkey").cast("bigint").alias("partner_id"),
                F.col("n_name").alias("partner_name"),
                F.col("r_regionkey").cast("bigint").alias("currency_id"),
                F.col("r_name").alias("region"),
                mapped(F.col("r_name"), REGION_CURRENCY).alias("currency_code"),
            )
        )

    def accounts(self) -> DataFrame:
        """Company with partner, region and currency."""
        customers = self.raw("customer").select(
            F.col("c_custkey").alias("company_id"),
            F.col("c_name").alias("company_name"),
            F.col("c_nationkey").cast("bigint").alias("partner_id"),
            F.col("c_mktsegment").alias("segment"),
        )
        return customers.join(self.places(), "partner_id")

    def partner(self) -> DataFrame:
        return self.places().select(
            F.col("partner_id").alias("id"),
            F.concat(F.lit("PG-"), F.col("partner_id").cast("string")).alias("guid"),
            F.col("partner_name").alias("name"),
            F.col("currency_id").cast("string").alias("business_unit_guid"),
            F.col("currency_id"),
            F.concat(F.lit("R"), F.col("partner_id").cast("string")).alias("registration_number"),
            F.concat(F.lit("T"), F.col("partner_id").cast("string")).alias("tax_id"),
        )

    def partner_accounts(self) -> DataFrame:
        """Customers in the partner role, with the flags that exclude them from invoicing."""
        balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.length("c_name").alias("payment_day"),
            (balance < 0).alias("is_invoice_dirty"),
            F.col("c_nationkey").cast("bigint").alias("currency_id"),
            (balance < -900).alias("deleted"),
            ((segment == "MACHINERY") & (balance > 9000)).alias("test_partner"),
            ((segment == "BUILDING") & (balance > 9500)).alias("is_root_partner"),
            ((segment == "FURNITURE") & (balance > 8000)).alias("is_house_account"),
            (balance < 9800).alias("auto_invoice_enabled"),
        )

    def company(self) -> DataFrame:
        balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.col("c_nationkey").cast("bigint").alias("partner_id"),
            F.length("c_name").alias("payment_day"),
            (balance < 0).alias("is_invoice_dirty"),
            F.col("c_nationkey").cast("bigint").alias("currency_id"),
            F.when(balance < -900, "Deleted").otherwise("Active").alias("status"),
            segment.isin("BUILDING", "AUTOMOBILE", "HOUSEHOLD").alias("bill_on_behalf_of_enabled"),
            F.when(segment != "AUTOMOBILE", balance > 8000).alias("is_telco"),
        )

    def currency(self) -> DataFrame:
        code = mapped(F.col("r_name"), REGION_CURRENCY)
        return self.raw("region").select(
            F.col("r_regionkey").cast("bigint").alias("id"), code.alias("api_code"), code.alias("iso_code")
        )

    def business_unit(self) -> DataFrame:
        return self.raw("region").select(
            F.col("r_regionkey").cast("string").alias("uuid"),
            F.col("r_name").alias("unique_code"),
            F.col("r_name").alias("name"),
        )

    def product(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"),
            F.concat(F.lit("PR-"), F.col("p_partkey").cast("string")).alias("uuid"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("sku"),
            F.col("p_brand").alias("vendor"),
            (F.col("p_size") <= 40).alias("anniversary_billing"),
            F.col("p_size").alias("size"),
        )

    def invoice(self) -> DataFrame:
        priority = F.col("o_orderpriority")
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("owner_company_id"),
            F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string")).alias("alternate_id"),
            F.col("o_orderdate").alias("order_ts"),
            dates.month_of(F.col("o_orderdate")).alias("invoice_date"),
            F.date_add(F.to_date("o_orderdate"), 30).alias("due_date"),
            F.when(F.col("o_orderstatus") == "F", "Paid")
            .when(F.col("o_orderstatus") == "O", "Unpaid")
            .otherwise("Void")
            .alias("status"),
            dec("o_totalprice").alias("total"),
            dec("o_totalprice").alias("balance"),
            (dec("o_totalprice") * F.lit("0.05").cast("decimal(4,2)")).cast("decimal(18,2)").alias("sales_tax"),
            F.when(priority.isin("1-URGENT", "2-HIGH"), True)
            .when(priority.isin("3-MEDIUM", "5-LOW"), False)
            .alias("is_email_sent"),
            (priority != "5-LOW").alias("approved"),
            priority.alias("priority"),
        )
        owners = self.accounts().withColumnRenamed("partner_id", "owner_partner_id")
        return orders.join(owners, orders["owner_company_id"] == owners["company_id"]).select(
            *orders.columns,
            F.when(priority_is_not_company(), F.col("owner_partner_id")).alias("partner_id"),
            F.when(F.col("priority").isin("3-MEDIUM", "5-LOW"), F.col("owner_company_id")).alias("company_id"),
            "owner_partner_id",
            "partner_name",
            "company_name",
            "currency_id",
            "currency_code",
            F.col("region").alias("business_unit_code"),
            "region",
        )

    def line(self) -> DataFrame:
        """Invoice lines without owner: everything lineitem itself tells."""
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        # narrow decimals: products stay within 18 digits, which Spark computes on longs
        total = F.col("l_extendedprice").cast("decimal(12,2)")
        discount, tax = F.col("l_discount").cast("decimal(3,2)"), F.col("l_tax").cast("decimal(3,2)")
        cost = (total * (F.lit(1) - discount)).cast("decimal(18,4)")
        return self.raw("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
            F.col("l_orderkey").alias("invoice_id"),
            F.col("l_linenumber").cast("bigint").alias("line_number"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("supplier_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            total.alias("total"),
            cost.alias("cost_total"),
            (total * tax).cast("decimal(18,4)").alias("billing_fee"),
            F.when(flag == "A", "subscription").when(flag == "N", "prorate").otherwise("arrears").alias("row_type"),
            F.when(F.col("l_linenumber") < 7, F.when(status == "F", "Monthly").otherwise("Annual")).alias("term"),
            status.alias("line_status"),
            flag.alias("return_flag"),
            (tax == F.lit("0.08").cast("decimal(3,2)")).alias("is_voided"),
            F.col("l_shipdate").alias("ship_ts"),
            dates.month_of(F.col("l_shipdate")).alias("invoice_date"),
            F.to_date("l_shipdate").alias("start_period"),
            F.date_add(F.to_date("l_shipdate"), 30).alias("end_period"),
            F.when(flag == "R", F.col("l_orderkey")).alias("arrears_subscription_id"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("completed_line_item_id"),
        )

    def owned_line(self) -> DataFrame:
        """Invoice lines with the company, partner, region and currency of their invoice."""
        owners = self.raw("orders").select(
            F.col("o_orderkey").alias("invoice_id"),
            F.col("o_custkey").alias("company_id"),
            F.col("o_orderstatus").alias("order_status"),
        )
        # the orders get their accounts first: lines are shuffled once, by invoice
        lines, accounts = self.line(), self.accounts()
        order = ["company_id", *lines.columns, "order_status", *[c for c in accounts.columns if c != "company_id"]]
        return lines.join(owners.join(accounts, "company_id"), "invoice_id").select(*order)

    def ledger(self) -> DataFrame:
        """Postings: the archived lines, by type; payments and credits on the credit side."""
        kind = (
            F.when(F.col("return_flag") == "A", "BOB_CUSTOMER_PAYMENT")
            .when(F.col("return_flag") == "N", "CHECK_ISSUED")
            .otherwise("SERVICE_CREDIT")
        )
        is_debit = F.col("return_flag") == "N"
        zero = F.lit(0).cast("decimal(18,2)")
        owners = self.raw("orders").select(
            F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("company_id")
        )
        return (
            self.line()
            .filter(F.col("line_status") == "F")
            .join(owners, "invoice_id")
            .select(
                "id",
                "invoice_id",
                "company_id",
                "product_id",
                kind.alias("type"),
                F.when(is_debit, zero).otherwise(F.col("total")).alias("credit"),
                F.when(is_debit, F.col("total")).otherwise(zero).alias("debit"),
                F.col("start_period").alias("transaction_date"),
                "ship_ts",
                F.concat(F.lit("posting "), F.col("id")).alias("description"),
            )
        )

    def open_rows(self) -> DataFrame:
        """Invoice rows that are not archived yet."""
        owners = self.raw("orders").select(
            F.col("o_orderkey").alias("invoice_id"), F.col("o_custkey").alias("company_id")
        )
        return (
            self.line()
            .filter(F.col("line_status") == "O")
            .join(owners, "invoice_id")
            .select("company_id", "cost_total", "invoice_date", "ship_ts")
        )

    def subscription(self) -> DataFrame:
        """Each order is one version of its customer's subscription."""
        status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
        months = F.left(priority, F.lit(1)).cast("int") * 3
        day = F.to_date("o_orderdate")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("original_subscription_id"),
            F.col("o_custkey").alias("company_id"),
            F.col("o_custkey").alias("product_id"),
            F.when(status == "O", "Active").when(status == "F", "Cancelled").otherwise("Pending").alias("status"),
            F.floor(dec("o_totalprice") / 50000).cast("bigint").alias("quantity"),
            day.alias("start_date"),
            F.when(status == "F", F.date_add(day, 90)).alias("end_date"),
            day.alias("billing_cycle_start"),
            F.when(priority != "4-NOT SPECIFIED", F.add_months(day, months)).alias("commitment_term_end_date"),
            (F.col("o_orderkey") * 8 + 1).alias("completed_line_id"),
            F.when(priority.isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "Monthly").otherwise("Annual").alias("term"),
            F.col("o_orderdate").alias("created_dt"),
            dec("o_totalprice").alias("price"),
        )

    def completed_line_item(self) -> DataFrame:
        """Line items by (order, line number); the test data repeats some ids on purpose."""
        lines = self.line()
        return lines.select(
            F.col("completed_line_item_id").alias("id"),
            F.concat(F.lit("G-"), F.col("completed_line_item_id").cast("string")).alias("guid"),
            "product_id",
            "supplier_id",
            F.col("row_type").alias("type"),
            F.when(F.col("line_status") == "F", 1).otherwise(12).alias("term_in_months"),
            "quantity",
            "total",
            F.col("cost_total").alias("gross_revenue"),
            F.col("start_period").alias("provision_start"),
            F.col("ship_ts").alias("provision_ts"),
            F.col("is_voided").alias("voided"),
            F.col("arrears_subscription_id"),
            F.col("invoice_id").alias("order_id"),
        )


class TaskShards(ParquetTables):
    """The written task tables, with subscriptions and products beside them."""

    def __init__(self, sample: Sample, folder: str):
        super().__init__(sample.spark, folder)
        self.sample = sample

    def table(self, name: str) -> DataFrame:
        if name == "subscription":
            return self.sample.subscription()
        return self.sample.product() if name == "product" else super().table(name)


def priority_is_not_company() -> Column:
    return F.col("priority") != "3-MEDIUM"
