"""Plan guards: no cartesian products or nested-loop joins; range predicates reach Parquet."""

import contextlib
import io

import pytest

import __spark_entry__ as entry
from conftest import SF001

BATCH_QUERIES = sorted(k for k in entry.queries() if not k.startswith("stream_"))


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", BATCH_QUERIES)
def test_no_pairwise_joins(spark, name):
    plan = _plan(entry.queries()[name](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_expiry_range_is_pushed_to_parquet(spark, tmp_path):
    from shelfwise.plans import reports
    from shelfwise.sources.derived import DRIVER_AS_OF, load_driver_inventory, materialize
    inv = materialize(spark, load_driver_inventory(spark, SF001), str(tmp_path / "t"))
    plan = _plan(reports.expiring_batches(inv, DRIVER_AS_OF))
    assert "LessThanOrEqual(expiry_date,1998-08-30)" in plan
    plan = _plan(reports.product_total_stock(inv, DRIVER_AS_OF))
    # only the columns the report needs are read from the batch table
    assert "ReadSchema: struct<product_id:bigint,quantity:int,expiry_date:date,status:string,expiry_date_zero:boolean>" in plan


def test_feed_joins_only_its_top_rows(spark, tmp_path):
    from shelfwise.plans import sales
    from shelfwise.sources.derived import DRIVER_AS_OF, load_driver_inventory, materialize
    inv = materialize(spark, load_driver_inventory(spark, SF001), str(tmp_path / "f"))
    plan = _plan(sales.activity_feed(inv, DRIVER_AS_OF, n=4))
    assert "TakeOrderedAndProject" in plan and "LeftSemi" in plan
    assert "In(batch_id" not in plan                          # no keys were collected while planning


def test_feed_cuts_the_ledger_before_its_shuffle(spark, tmp_path):
    from shelfwise.plans import sales
    from shelfwise.sources.derived import DRIVER_AS_OF, load_driver_inventory, materialize
    inv = materialize(spark, load_driver_inventory(spark, SF001), str(tmp_path / "g"))
    plan = sales.activity_feed(inv, DRIVER_AS_OF, n=4)._jdf.queryExecution().executedPlan().toString().splitlines()
    steps = [step for line in plan for step in ("Final", "Exchange", "Partial")
             if ("WindowGroupLimit" in line and line.endswith(step)) or (step == "Exchange" and "hashpartitioning(batch_id" in line)]
    assert steps[:3] == ["Final", "Exchange", "Partial"]       # printed from the top
