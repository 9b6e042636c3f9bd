"""Marts by period: partials merge to the full result, and a refresh writes changed periods only."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from billweave.operators import history, marts
from tests.conftest import rows_of

DDL = "id long, task long, status_clean string, run_on timestamp, updated_dt timestamp, error_message string"


def changes(spark, first, days, seed, start_id):
    chance = random.Random(seed)
    rows = []
    for k in range(300):
        at = first + timedelta(minutes=chance.randrange(days * 24 * 60))
        status = chance.choice(["new", "error", "finished", "reviewed", None])
        message = f"m{k}" if status == "error" and chance.random() < 0.8 else None
        rows.append((start_id + k, chance.randrange(25), status, at, at + timedelta(minutes=chance.randrange(9)), message))
    return spark.createDataFrame(rows, DDL)


def files(folder):
    return {p.parent.name: p.parent.stat().st_mtime_ns and sorted(x.name for x in p.parent.glob("part-*")) for p in Path(folder).glob("*/part-*")}


@pytest.mark.parametrize("unit", ["MM", "WEEK"])
def test_one_more_day_rewrites_one_period(spark, tmp_path, unit):
    before = changes(spark, datetime(2024, 1, 3), 80, 1, 0).unionByName(spark.createDataFrame([(9999, 1, "error", None, None, "x")], DDL))
    day = changes(spark, datetime(2024, 2, 14), 1, 2, 1000)
    mart = marts.PeriodMart(spark, str(tmp_path / unit), "run_on", marts.state_partials(["task"], ["updated_dt", "id"]), unit)
    mart.refresh(before)
    old = files(mart.path)
    assert len(old) == (3 if unit == "MM" else 12)
    both = before.unionByName(day)
    assert len(mart.periods(day)) == 1
    mart.refresh(both, mart.periods(day))
    new = files(mart.path)
    assert [p for p in new if new[p] != old[p]] == ["period=2024-02-01" if unit == "MM" else "period=2024-02-12"] and set(new) == set(old)
    dated = both.filter("run_on IS NOT NULL")
    want = history.task_states(dated, ["task"], ["updated_dt", "id"])
    got = marts.merged_states(mart.table(), ["task"])
    assert rows_of(got, *want.columns) == rows_of(want) and want.count() == 25
    mart.refresh(both, [])
    assert files(mart.path) == new


def test_reports_of_a_period_read_its_folder_only(spark, tmp_path):
    rows = changes(spark, datetime(2024, 1, 3), 80, 1, 0)
    mart = marts.PeriodMart(spark, str(tmp_path / "m"), "run_on", lambda r: r.groupBy(marts.PERIOD, "task").agg(F.count(F.lit(1)).alias("n")))
    mart.refresh(rows)
    march = mart.table().filter("period = DATE '2024-03-01'")
    assert "PartitionFilters: [isnotnull(period" in march._jdf.queryExecution().executedPlan().toString()
    assert march.agg(F.sum("n")).first()[0] == rows.filter("run_on >= '2024-03-01'").count()
    with pytest.raises(ValueError):
        marts.PeriodMart(spark, "x", "run_on", lambda r: r, "DAY")
