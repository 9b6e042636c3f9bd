"""Where tables come from: Parquet folders, the catalog or a JDBC database."""

import re
from collections.abc import Sequence
from datetime import date
from functools import reduce
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from billweave.constants import ARREARS_BILL_METHOD, ARREARS_TABLES, BILLING_METHODS
from billweave.functions import dates, labels
from billweave.schemas import TASK_FIELDS, Fields, ddl

_NAME = re.compile(r"[A-Za-z0-9_.]+")


def schema_prefix(schema: str) -> str:
    """A checked schema prefix that ends in a dot; empty stays empty."""
    if not schema:
        return ""
    if not _NAME.fullmatch(schema):
        raise ValueError(f"schema name may hold letters, digits, underscores and dots only: {schema!r}")
    return schema if schema.endswith(".") else schema + "."


class ParquetTables:
    """Tables stored as `<root>/<name>.parquet`, a file or a folder, on any file system Spark reads."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, Fields] | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schemas = schemas or {}

    def path(self, name: str) -> str:
        return str(PurePosixPath(self.root) / f"{name}.parquet") if "://" not in self.root else f"{self.root}/{name}.parquet"

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in self.schemas:
            reader = reader.schema(ddl(self.schemas[name]))
        return reader.parquet(self.path(name))

    def shards(self, names: Sequence[str], fields: Fields) -> DataFrame:
        """Several tables as one scan: the declared columns, null where a table lacks one, and `task_table`, the table of a row."""
        rows = self.spark.read.schema(ddl(fields)).parquet(*[self.path(name) for name in names])
        name = F.regexp_extract("_metadata.file_path", rf"/({'|'.join(names)})\.parquet(/|$)", 1)
        return rows.select(name.alias("task_table"), *fields)

    def newest(self, name: str, column: str) -> DataFrame:
        """The largest value of a whole-number column, from the footers of the files: no column data is read.

        Spark pushes the aggregate into its newer Parquet reader only, so this one table is opened with that.
        """
        setting = "spark.sql.sources.useV1SourceList"
        before = self.spark.conf.get(setting)
        self.spark.conf.set(setting, ",".join(s for s in before.split(",") if s != "parquet"))
        try:
            rows = self.spark.read.format("parquet").load(self.path(name))
        finally:
            self.spark.conf.set(setting, before)
        return rows.agg(F.max(column).alias(column))

    def exists(self, name: str) -> bool:
        try:
            self.spark.read.parquet(self.path(name))
        except AnalysisException:
            return False
        return True


class CatalogTables:
    """Tables of the session catalog, under an optional schema."""

    def __init__(self, spark: SparkSession, schema: str = ""):
        self.spark = spark
        self.prefix = schema_prefix(schema)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.prefix + name)

    def exists(self, name: str) -> bool:
        return self.spark.catalog.tableExists(self.prefix + name)


class JdbcTables:
    """Tables of a database. `split` gives (column, lower, upper, partitions) per table for parallel reads."""

    def __init__(
        self,
        spark: SparkSession,
        url: str,
        schema: str = "",
        properties: dict[str, str] | None = None,
        split: dict[str, tuple[str, int, int, int]] | None = None,
    ):
        self.spark = spark
        self.url = url
        self.prefix = schema_prefix(schema)
        self.properties = properties or {}
        self.split = split or {}

    def options(self, name: str) -> dict[str, str]:
        options = {"url": self.url, "dbtable": self.prefix + name, **self.properties}
        if name in self.split:
            column, lower, upper, partitions = self.split[name]
            options |= {
                "partitionColumn": column,
                "lowerBound": str(lower),
                "upperBound": str(upper),
                "numPartitions": str(partitions),
            }
        return options

    def table(self, name: str) -> DataFrame:
        return self.spark.read.format("jdbc").options(**self.options(name)).load()

    def exists(self, name: str) -> bool:
        try:
            self.table(name)
        except Exception:  # the driver reports a missing table in its own way
            return False
        return True


Tables = ParquetTables | CatalogTables | JdbcTables


def run_sql(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """Run SQL with named parameters (`:name`)."""
    return spark.sql(text, args=parameters)


def union_shards(
    source: Tables, names: Sequence[str], condition: Column | None = None, fields: Fields = TASK_FIELDS
) -> DataFrame:
    """One relation over sharded task tables: a `task_table` label, missing columns filled with null.

    Parquet shards are one scan, which the condition and the chosen columns reach. Shards of a catalog or database are united; the condition
    is applied to each, so it reaches each scan.
    """
    if isinstance(source, ParquetTables):
        rows = source.shards(names, fields)
        return rows if condition is None else rows.filter(condition)

    def shard(name: str) -> DataFrame:
        df = source.table(name)
        if condition is not None:
            df = df.filter(condition)
        present = set(df.columns)
        columns = [
            (F.col(column) if column in present else F.lit(None)).cast(kind).alias(column)
            for column, kind in fields.items()
        ]
        return df.select(F.lit(name).alias("task_table"), *columns)

    return reduce(DataFrame.unionByName, [shard(name) for name in names])


def existing(source: Tables, names: Sequence[str]) -> tuple[list[str], list[str]]:
    """The names split into tables that exist and tables that do not."""
    found = [name for name in names if source.exists(name)]
    return found, [name for name in names if name not in found]


def billing_tasks(
    source: Tables,
    names: Sequence[str],
    since: date,
    methods: Sequence[str] = tuple(BILLING_METHODS),
    until: date | None = None,
) -> DataFrame:
    """Billing tasks from the month of `since` to the end of the day `until`, with cleaned status and parsed payload ids."""
    condition = F.col("method").isin(list(methods)) & run_within(since, until)
    payload = F.col("_payload")
    return (
        union_shards(source, names, condition)
        .withColumn("_payload", labels.parsed(F.col("payload")))
        .withColumn("partner_id_parsed", labels.field_text(payload, "partnerId"))
        .withColumn("company_id_parsed", labels.field_text(payload, "companyId"))
        .withColumn("status_clean", labels.clean_status(F.col("status")))
        .withColumn("run_on_month", dates.month_of(F.col("run_on")))
        .drop("_payload")
    )


def run_within(since: date, until: date | None) -> Column:
    """Whether a task runs from the month of `since` on and, if given, not after the day `until`."""
    condition = F.col("run_on") >= F.lit(dates.month_start(since))
    return condition if until is None else condition & (F.col("run_on") < F.lit(date.fromordinal(until.toordinal() + 1)))


def invoice_tasks(source: Tables, names: Sequence[str]) -> DataFrame:
    """All tasks with the invoice date of their payload (`invoiceDate.value`); bad JSON gives a null date."""
    return union_shards(source, names).withColumn(
        "invoice_date", labels.field_date(labels.parsed(F.col("payload")), "invoiceDate", "value")
    )


def arrears_tasks(
    source: Tables, since: date, names: Sequence[str] = tuple(ARREARS_TABLES), until: date | None = None
) -> DataFrame:
    """Arrears billing tasks from the month of `since` to the day `until`, with subscription and product attributes."""
    condition = (F.col("method") == ARREARS_BILL_METHOD) & run_within(since, until)
    subscriptions = source.table("subscription").select(
        F.col("id").alias("subscription_id"), "original_subscription_id"
    )
    products = source.table("product").select(
        F.col("id").alias("product_id"), F.col("name").alias("product_name"), "vendor"
    )
    tasks = union_shards(source, names, condition)
    return (
        tasks.withColumn("status_clean", labels.arrears_status(F.col("status")))
        .join(subscriptions, "subscription_id")
        .join(products, "product_id")
    )


def table_freshness(sources: dict[str, Tables], names: Sequence[str], zone: str = "America/Denver") -> DataFrame:
    """Latest write of each table in each schema, from the epoch-millisecond column `__ts_ms`; of Parquet tables only footers are read."""

    def latest(schema: str, source: Tables, name: str) -> DataFrame:
        of_parquet = isinstance(source, ParquetTables)
        newest = source.newest(name, "__ts_ms") if of_parquet else source.table(name).agg(F.max("__ts_ms").alias("__ts_ms"))
        return newest.select(F.lit(schema).alias("schema"), F.lit(name).alias("table_name"), F.col("__ts_ms").alias("latest_ts_ms"))

    parts = [latest(schema, source, name) for schema, source in sources.items() for name in names]
    return reduce(DataFrame.unionByName, parts).select(
        "schema", "table_name", local_time(F.col("latest_ts_ms"), zone).alias("latest_written")
    )


def local_time(epoch_ms: Column, zone: str) -> Column:
    """Epoch milliseconds, whole seconds only, as wall-clock time in a zone."""
    seconds = F.timestamp_seconds(F.floor(epoch_ms / 1000))
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), seconds.cast("timestamp_ntz"))
