"""The one aggregate behind recommendations and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.operators import diagnostic as D
from tallyscope.operators import fold as O
from tallyscope.operators import predictive as P
from tallyscope.sources.tables import business

FOLDER = "/root/testdata/sf0.001"


def folded(spark, by=("region",)):
    return O.fold(
        business(spark, FOLDER), by, dimension="nation", metric="net_revenue", margins=("discount_pct", "profit"),
        date="order_date", dated_metric="quantity",
    )


def test_raw_rows_are_read_once(spark):
    plan = folded(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_both_sets_equal_their_own_aggregates(spark):
    frame, by = business(spark, FOLDER), ["region"]
    rows = folded(spark).cache()
    groups = O.group_totals(rows, by)
    own = D._group_totals(frame, "net_revenue", "nation", by, ("discount_pct", "profit"))
    names = ["region", "group", "total", "row_count", "grouped", "margin_rows"]
    assert groups.select(names).exceptAll(own.select(names)).count() == 0 and groups.count() == own.count()
    days, daily = O.daily_totals(rows, by), P._daily(frame, "quantity", "order_date", by)
    names = ["region", "day", "total", "metric_rows", "n_rows", "first_at", "last_at"]
    assert days.select(names).exceptAll(daily.select(names)).count() == 0 and days.count() == daily.count()
    assert rows.select(F.sum("n_rows")).first()[0] == 2 * frame.count()


def test_each_set_carries_its_own_sums_only(spark):
    """Sums of the other set would be shuffled and written a second time."""
    rows = folded(spark)
    groups, days = rows.where(F.col("set") == O.GROUPS), rows.where(F.col("set") == O.DAYS)
    assert groups.where("dated_total is not null or dated_rows > 0 or first_at is not null").count() == 0
    assert days.where("total is not null or row_count > 0 or margin_rows > 0 or profits is not null").count() == 0
    alone = O.fold(business(spark, FOLDER), ["region"], dimension="nation", metric="quantity")
    assert dict(alone.dtypes)["first_at"] == "timestamp_ntz" and alone.count() == groups.count()
    alone = O.fold(business(spark, FOLDER), [], date="order_date", dated_metric="quantity")
    assert dict(alone.dtypes)["group"] == "string" and alone.count() == days.select("day").distinct().count()
