from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import diagnostic as D
from tallyscope.operators import shape
from tallyscope.operators.shape import exact_quantiles
from tests import frames


def rows(frame, *order):
    return [tuple(r) for r in (frame.orderBy(*order) if order else frame).collect()]


def test_grouped_comparison(spark):
    got = rows(D.grouped_comparison(frames.grouped_6(spark), "net_revenue", "region"), "group")
    assert got == [
        ("North", 220.0, 2, 110.0, 53.66, 110.0),
        ("South", 120.0, 2, 60.0, 29.27, 60.0),
        ("West", 70.0, 2, 35.0, 17.07, 35.0),
    ]


def test_summary(spark):
    s = D.diagnostic_summary(frames.grouped_6(spark), "net_revenue", "region").first()
    assert (s.total_metric_value, s.group_count, s.top_group, s.bottom_group) == (410.0, 3, "North", "West")
    assert (s.difference_top_to_bottom, s.spread_classification, s.concentration_classification) == (
        150.0, "wide", "high")
    assert s.show_split_top_bottom is False


def test_top_and_bottom(spark):
    frame = frames.six_groups_12(spark)
    s = D.diagnostic_summary(frame, "net_revenue", "region").first()
    assert (s.total_metric_value, s.show_split_top_bottom, s.spread_classification) == (1115.0, True, "wide")
    assert s.concentration_classification == "low"
    bottom = D.bottom_groups(frame, "net_revenue", "region").orderBy("position").collect()
    assert [r.group for r in bottom] == ["F", "E", "D", "C", "B"]
    top = D.top_groups(frame, "net_revenue", "region").orderBy("position").collect()
    assert [r.group for r in top] == ["A", "B", "C", "D", "E"]
    ranked = D.ranked_groups(frame, "net_revenue", "region").orderBy("rank").collect()
    assert [(r.rank, r.group) for r in ranked] == list(enumerate("ABCDEF", 1))


def test_underperformers_efficiency_and_margin(spark):
    frame = frames.grouped_6(spark)
    assert [r.group for r in D.underperformers(frame, "net_revenue", "region").collect()] == ["West"]
    assert D.efficiency_split(frame, "net_revenue", "region").first().aligned is True
    m = D.margin_flags(frame, "region").collect()
    assert [(r.group, r.average_discount, r.discount_cutoff, r.profit_cutoff) for r in m] == [
        ("West", 27.5, 19.25, 30.0)]


def test_margin_needs_both_columns(spark):
    assert D.margin_flags(frames.six_groups_12(spark), "region").collect() == []


def test_findings_order(spark):
    found = [r.finding for r in D.diagnostic_findings(frames.grouped_6(spark), "net_revenue", "region")
             .orderBy("finding_order").collect()]
    starts = ("Top contributor: North drives 53.7%", "Lowest-contributing group: West", "Performance spread is wide",
              "Contribution concentration is high", "Underperforming groups: West",
              "Average contribution per group is 136.67", "Volume and per-row efficiency align",
              "Margin concern: West")
    assert len(found) == len(starts)
    for text, start in zip(found, starts):
        assert text.startswith(start)


def test_trend(spark):
    frame = frames.grouped_6(spark)
    t = D.trend_summary(frame, "net_revenue", "order_date").collect()
    assert len(t) == 6 and {r.frequency for r in t} == {"D"}
    by = D.trend_by_dimension(frame, "net_revenue", "region", "order_date").collect()
    assert len(by) == 6
    assert {r.frequency for r in D.trend_summary(frames.six_groups_12(spark), "net_revenue", "order_date").collect()} == {"M"}


@pytest.mark.parametrize("n, grain", [(60, "D"), (61, "W"), (180, "W"), (181, "M")])
def test_trend_grain_boundaries(spark, n, grain):
    frame = frames.frame(spark, d=frames.days("2024-01-01", n), v=[1.0] * n)
    assert {r.frequency for r in D.trend_summary(frame, "v", "d").collect()} == {grain}


def test_trend_keeps_rows_without_group(spark):
    frame = frames.frame(spark, d=frames.days("2024-01-01", 4), v=[1.0, 2.0, 3.0, 4.0], g=["a", None, "b", " "])
    total = D.trend_summary(frame, "v", "d").agg(F.sum("metric_value")).first()[0]
    split = D.trend_by_dimension(frame, "v", "g", "d").agg(F.sum("metric_value")).first()[0]
    assert (total, split) == (10.0, 4.0)
    s = D.diagnostic_summary(frame, "v", "g").first()
    assert (s.total_metric_value, s.row_average) == (4.0, 2.5)


def test_trend_split_needs_two_to_eight_groups(spark):
    for n, expected in ((1, 0), (2, 2), (8, 8), (9, 0)):
        frame = frames.frame(spark, d=frames.days("2024-01-01", n), v=[1.0] * n, g=[f"g{i}" for i in range(n)])
        assert D.trend_by_dimension(frame, "v", "g", "d").count() == expected


def test_zero_and_negative_totals(spark):
    zero = frames.frame(spark, v=[5.0, -5.0], g=["a", "b"])
    assert [r.share_pct for r in D.grouped_comparison(zero, "v", "g").collect()] == [0.0, 0.0]
    s = D.diagnostic_summary(zero, "v", "g").first()
    assert (s.spread_classification, s.concentration_classification) == ("wide", "low")
    found = D.diagnostic_findings(zero, "v", "g").orderBy(F.desc("finding_order")).first().finding
    assert found.startswith("The selected metric totals 0.00")


def test_ties_follow_the_name(spark):
    frame = frames.frame(spark, v=[1.0, 1.0, 1.0], g=["c", "a", "b"])
    s = D.diagnostic_summary(frame, "v", "g").first()
    assert (s.top_group, s.bottom_group) == ("a", "c")
    ranked = D.ranked_groups(frame, "v", "g").orderBy("rank").collect()
    assert [r.group for r in ranked] == ["a", "b", "c"]


def test_single_group_has_no_efficiency_row(spark):
    frame = frames.frame(spark, v=[1.0, 2.0], g=["a", "a"])
    assert D.efficiency_split(frame, "v", "g").collect() == []


def test_nothing_usable(spark):
    frame = frames.frame(spark, v=["x", "y"], g=["a", " "])
    s = D.diagnostic_summary(frame, "v", "g").first()
    assert (s.total_metric_value, s.group_count, s.top_group, s.spread_classification) == (0.0, 0, "N/A", "N/A")
    assert D.grouped_comparison(frame, "v", "g").collect() == []
    assert "do not overlap on usable rows" in D.diagnostic_findings(frame, "v", "g").first().finding


def test_text_metric_nan_and_boolean_dimension(spark):
    frame = frames.frame(spark, v=["1", " 2 ", "n/a", "4"], g=[True, False, True, None])
    got = rows(D.grouped_comparison(frame, "v", "g").select("group", "metric_value"), "group")
    assert got == [("False", 2.0), ("True", 1.0)]
    numbers = frames.frame(spark, v=[1.0, float("nan"), 3.0], g=["a", "a", "b"])
    assert rows(D.grouped_comparison(numbers, "v", "g").select("group", "row_count"), "group") == [("a", 1), ("b", 1)]


def test_one_key_equals_no_key(spark):
    frame = frames.grouped_6(spark).withColumn("k", F.lit("x"))
    calls = [
        lambda f, by: D.grouped_comparison(f, "net_revenue", "region", by),
        lambda f, by: D.ranked_groups(f, "net_revenue", "region", by),
        lambda f, by: D.top_groups(f, "net_revenue", "region", by),
        lambda f, by: D.bottom_groups(f, "net_revenue", "region", by),
        lambda f, by: D.diagnostic_summary(f, "net_revenue", "region", by),
        lambda f, by: D.underperformers(f, "net_revenue", "region", by),
        lambda f, by: D.margin_flags(f, "region", by),
        lambda f, by: D.trend_summary(f, "net_revenue", "order_date", by),
        lambda f, by: D.trend_by_dimension(f, "net_revenue", "region", "order_date", by),
        lambda f, by: D.diagnostic_findings(f, "net_revenue", "region", by),
    ]
    for call in calls:
        alone, keyed = call(frame, ()), call(frame, ["k"]).drop("k")
        assert alone.columns == keyed.columns
        assert sorted(map(str, alone.collect())) == sorted(map(str, keyed.collect()))


def test_null_key_is_a_key(spark):
    frame = frames.frame(spark, k=["x", None, None], v=[1.0, 2.0, 6.0], g=["a", "a", "b"])
    got = rows(D.grouped_comparison(frame, "v", "g", ["k"]).select("k", "group", "share_pct"), "k", "group")
    assert got == [(None, "a", 25.0), (None, "b", 75.0), ("x", "a", 100.0)]


def test_many_groups_are_ranked_in_slices(spark):
    frame = spark.range(20000).select(
        F.concat(F.lit("g"), F.format_string("%05d", "id")).alias("g"), (F.col("id") % 997).alias("v"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("k"),
    )
    ranked = D.ranked_groups(frame, "v", "g").orderBy("rank").collect()
    assert [r.rank for r in ranked] == list(range(1, 20001))
    assert [(-r.metric_value, r.group) for r in ranked] == sorted((-r.metric_value, r.group) for r in ranked)
    keyed = D.ranked_groups(frame, "v", "g", ["k"]).where("k = 'hot'").orderBy("rank").collect()
    assert [r.rank for r in keyed] == list(range(1, len(keyed) + 1))
    assert [(-r.metric_value, r.group) for r in keyed] == sorted((-r.metric_value, r.group) for r in keyed)


def test_group_totals_are_scanned_once(spark, tmp_path):
    path = str(tmp_path / "rows")
    frames.grouped_6(spark).write.parquet(path)
    frame = spark.read.parquet(path)
    for query in (
        D.grouped_comparison(frame, "net_revenue", "region"),
        D.margin_flags(frame, "region"),
        D.trend_by_dimension(frame, "net_revenue", "region", "order_date"),
    ):
        query.collect()
        plan = query._jdf.queryExecution().executedPlan().toString()
        final = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
        assert "ReusedExchange" in final


def test_exact_quantiles_of_many_and_few_values(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    values = {
        "many": rng.normal(size=5000), "tied": rng.integers(0, 7, 4000).astype(float), "two": np.array([1.0, 4.0]),
        "one": np.array([3.0]), "same": np.zeros(3000),
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("one", None)]
    frame = spark.createDataFrame(rows, "k string, v double")
    for share in (0.25, 0.5, 0.75):
        found = exact_quantiles(frame.selectExpr("*", f"{share}D as share"), ["k"], "v", "share", "q", accuracy=500)
        got = {r["k"]: r["q"] for r in found.collect()}
        assert got.keys() == values.keys()
        for k, vs in values.items():
            assert abs(got[k] - np.quantile(vs, share)) < 1e-12, (k, share)


@pytest.mark.parametrize("low, high", [("-1e9D", "-1D"), ("3000D", "4000D"), ("1e8D", "1e9D")])
def test_a_bracket_that_misses_the_rank_is_an_error(spark, monkeypatch, low, high):
    bracket = shape._bracket

    def wrong(*args):
        return bracket(*args).withColumns({"__low": F.expr(low), "__high": F.expr(high)})

    monkeypatch.setattr(shape, "_bracket", wrong)
    frame = spark.range(10_000).selectExpr("'k' as k", "cast(id as double) as v", "0.25D as share")
    with pytest.raises(Exception, match="sketch missed the quantile.*10000"):
        exact_quantiles(frame, ["k"], "v", "share", "q").collect()
    monkeypatch.setattr(shape, "_bracket", lambda *a: bracket(*a).withColumn("__low", F.expr("2400D")))
    assert exact_quantiles(frame, ["k"], "v", "share", "q").first()["q"] == 2499.75


def test_margin_flags_have_no_percentile_in_one_task(spark):
    frame = frames.six_groups_12(spark)
    plan = D.margin_flags(frame, "region")._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "median(" not in plan
