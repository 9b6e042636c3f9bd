from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from billweave import schemas
from billweave.functions import labels
from billweave.plans import registry
from billweave.session import configure
from billweave.sources import sinks, tables
from billweave.streaming import completions
from oracle import statements
from tests.conftest import rows_of


def test_schema_names_are_checked():
    assert tables.schema_prefix("") == "" and tables.schema_prefix("cc") == "cc." and tables.schema_prefix("cc.") == "cc."
    with pytest.raises(ValueError):
        tables.schema_prefix("cc; drop table x")


def test_parquet_and_catalog_tables(spark, tmp_path):
    schemas.empty(spark, "currency").write.parquet(str(tmp_path / "currency.parquet"))
    source = tables.ParquetTables(spark, str(tmp_path), schemas.TABLES)
    assert tables.existing(source, ["currency", "invoice"]) == (["currency"], ["invoice"])
    assert source.table("currency").columns == ["id", "api_code", "iso_code"]
    spark.createDataFrame([(1,)], "id long").createOrReplaceTempView("known_table")
    catalog = tables.CatalogTables(spark)
    assert catalog.exists("known_table") and not catalog.exists("unknown_table")
    got = tables.run_sql(spark, "select id from known_table where id = :wanted", wanted=1)
    assert rows_of(got) == [(1,)]


def test_every_declared_schema_is_valid(spark):
    for name, fields in schemas.TABLES.items():
        assert schemas.empty(spark, name).columns == list(fields)
    assert len(schemas.FRESHNESS_TABLES) == 18


def test_jdbc_options_split_large_tables(spark):
    source = tables.JdbcTables(spark, "jdbc:x", "cc", {"user": "u"}, {"invoice": ("id", 0, 1000, 16)})
    options = source.options("invoice")
    assert options["dbtable"] == "cc.invoice" and options["numPartitions"] == "16" and options["user"] == "u"
    assert "numPartitions" not in source.options("company")


def test_freshness_in_local_time(spark):
    class One:
        def table(self, name):
            return spark.createDataFrame([(1704067200999,), (1,)], "__ts_ms long")

    got = tables.table_freshness({"cc": One(), "event_cc": One()}, ["invoice"])
    assert rows_of(got) == [(s, "invoice", datetime(2023, 12, 31, 17, 0)) for s in ("cc", "event_cc")]


def test_batches_are_numbered_and_complete(spark, tmp_path):
    df = spark.range(2500).withColumn("v", F.col("id") * 2)
    batches = sinks.assign_batches(df, ["id"], 1000)
    assert rows_of(batches.groupBy("batch").agg(F.count("id"), F.min("id"), F.max("id"))) == [
        (1, 1000, 0, 999), (2, 1000, 1000, 1999), (3, 500, 2000, 2499),
    ]
    assert batches.select(sinks.batch_file_name("f", F.lit(7), "2024-01-01")).first()[0] == "f_batch007_2024-01-01.csv"
    path = str(tmp_path / "batches")
    sinks.write_batches(df, path, ["id"], 1000)
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 2500 and len(list((tmp_path / "batches" / "batch=1").glob("*.csv"))) == 1


def test_csv_and_partitioned_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, m string")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert rows_of(spark.read.option("header", True).csv(str(tmp_path / "csv"))) == [("1", "a"), ("2", None)]
    sinks.write_partitioned(df, str(tmp_path / "parts"), ["m"])
    assert spark.read.parquet(str(tmp_path / "parts")).filter("m = 'a'").count() == 1


def test_stream_counts_closed_hours_like_a_batch(spark, tmp_path):
    rows = [(1, "t", "finished", "2024-01-01 10:10:00"), (2, "t", "finished", "2024-01-01 10:50:00"), (3, "t", "new", "2024-01-01 10:51:00"),
            (4, "u", "finished", "2024-01-01 11:05:00"), (5, "t", "finished", "2024-01-01 14:00:00")]
    df = spark.createDataFrame(rows, "id long, task_table string, status string, ts string").withColumn(
        "updated_dt", F.to_timestamp("ts")
    )
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = completions.write_completions(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = rows_of(spark.read.parquet(str(tmp_path / "out")), "window_start", "table_name", "hourly_completed")
    batch = completions.hourly_completions(df).filter("window_end <= '2024-01-01 13:50:00'")
    assert got == rows_of(batch, "window_start", "table_name", "hourly_completed") and len(got) == 2


def test_every_query_has_a_statement():
    assert set(registry.queries()) == set(statements.all_statements())


def test_batch_names_of_four_digits(spark):
    batches = spark.createDataFrame([(7,), (100,), (1000,), (12345,)], "batch long")
    names = [r[0] for r in batches.orderBy("batch").select(sinks.batch_file_name("f", F.col("batch"), "d")).collect()]
    assert names == ["f_batch007_d.csv", "f_batch100_d.csv", "f_batch1000_d.csv", "f_batch12345_d.csv"]


def test_parquet_shards_are_one_scan(spark, tmp_path):
    """Shards with differing columns: one scan, filters and columns reach it, and each row knows its table."""
    spark.createDataFrame([(1, "m", 7)], "id long, method string, partner_id long").write.parquet(f"{tmp_path}/billing_task.parquet")
    spark.createDataFrame([(2, "m", "bad"), (3, "n", None)], "id long, method string, error_message string").write.parquet(
        f"{tmp_path}/mca_task.parquet"
    )
    source = tables.ParquetTables(spark, str(tmp_path))
    both = tables.union_shards(source, ["billing_task", "mca_task"])
    assert rows_of(both, "id", "task_table", "partner_id", "error_message") == [
        (1, "billing_task", 7, None), (2, "mca_task", None, "bad"), (3, "mca_task", None, None),
    ]
    assert both.columns == ["task_table", *schemas.TASK_FIELDS]
    few = tables.union_shards(source, ["billing_task", "mca_task"], F.col("method") == "m").select("id", "task_table")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualTo(method,m)" in plan and "error_message" not in plan
    assert rows_of(few) == [(1, "billing_task"), (2, "mca_task")]


def test_freshness_reads_footers_only(spark, tmp_path):
    configure(spark)
    spark.range(1000).selectExpr("id", "1704067200000 + id AS __ts_ms").repartition(3).write.parquet(f"{tmp_path}/invoice.parquet")
    source = tables.ParquetTables(spark, str(tmp_path))
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    plan = source.newest("invoice", "__ts_ms")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MAX(__ts_ms)]" in plan
    assert spark.conf.get("spark.sql.sources.useV1SourceList") == before
    got = tables.table_freshness({"cc": source}, ["invoice"], zone="UTC")
    assert rows_of(got) == [("cc", "invoice", datetime(2024, 1, 1))]


def test_parsed_payloads(spark):
    rows = [('{"a":{"v":"2024-01-05"},"n":5,"e":""}',), ('{"a":{"v":"nope"}',), ('{"a":{"v":"nope"}}',), ("",), (None,)]
    document = labels.parsed(F.col("p"))
    got = spark.createDataFrame(rows, "p string").select(
        labels.field_date(document, "a", "v"), labels.field_text(document, "n"), labels.field_text(document, "e")
    )
    assert rows_of(got) == [(None, None, None)] * 4 + [(date(2024, 1, 5), "5", None)]
