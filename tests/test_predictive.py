from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import predictive as P
from tests import frames


def state(frame, metric="quantity", **kwargs):
    return P.forecast(frame, metric, "order_date", **kwargs)


def test_projection_of_a_weekly_series(spark):
    s = state(frames.quantities_180(spark), readiness_status="Conditional")
    r = s.first()
    assert (r.status, r.grain, r.periods, r.latest_value, r.direction) == ("Conditional", "W", 26, 285.0, "Up")
    assert r.moving_average == pytest.approx(361.8) and r.slope == pytest.approx(-20.2)
    values = [x.metric_value for x in P.forecast_projection(s).orderBy("step").collect()]
    assert values == [327.85, 320.78, 313.71, 306.64, 299.57, 292.5]
    assert r.mean_value == pytest.approx(310.175)
    assert r.volatility_score == pytest.approx(0.1131, abs=5e-5) and r.volatility == "stable"
    periods = [x.label for x in P.forecast_projection(s).orderBy("step").collect()]
    assert periods[:2] == ["2024-07-01", "2024-07-08"]


def test_short_series_is_blocked(spark):
    s = state(frames.short_5(spark), horizon=3)
    r = s.first()
    assert (r.status, r.direction, r.first_value, r.latest_value) == ("Not Ready", "Blocked", 0.0, 14.0)
    messages = [x.message for x in P.forecast_validation(s).orderBy("message_order").collect()]
    assert len(messages) == 2 and messages[0].startswith("Only 5 unique time periods")
    assert P.forecast_projection(s).collect() == []
    assert [x.finding for x in P.forecast_findings(s).collect()] == [P.FINDING_BLOCKED]


def test_no_usable_row_is_blocked_too(spark):
    frame = frames.frame(spark, order_date=["x", "y"], quantity=[1.0, 2.0])
    r = state(frame).first()
    assert (r.status, r.messages, r.periods) == ("Not Ready", [P.MESSAGE_NO_ROWS], 0)
    r = state(frame.limit(0)).first()
    assert (r.status, r.parse_rate) == ("Not Ready", 0.0)


@pytest.mark.parametrize("n, blocked", [(6, True), (11, True), (12, False)])
def test_horizon_against_history(spark, n, blocked):
    frame = frames.frame(spark, order_date=frames.days("2025-01-01", n), quantity=[float(i) for i in range(n)])
    messages = state(frame, horizon=6).first().messages
    assert (P.MESSAGE_HORIZON in messages) is blocked


@pytest.mark.parametrize("n, grain", [(90, "D"), (91, "W"), (365, "W"), (366, "M")])
def test_grain_boundaries(spark, n, grain):
    frame = frames.frame(spark, order_date=frames.days("2024-01-01", n), quantity=[1.0] * n)
    assert state(frame).first().grain == grain


def test_fixed_grain_and_month_steps(spark):
    frame = frames.quantities_180(spark)
    s = state(frame, grain="Monthly", horizon=3)
    assert [x.label for x in P.forecast_projection(s).orderBy("step").collect()] == [
        "2024-07-01", "2024-08-01", "2024-09-01"]


def test_parse_rate_blocks(spark):
    dates = [d.strftime("%Y-%m-%d") for d in frames.days("2025-01-01", 20)] + ["?"] * 6
    frame = frames.frame(spark, order_date=dates, quantity=[1.0] * 26)
    messages = state(frame, horizon=3).first().messages
    assert messages == ["Datetime parse success is 77%, which is below the 80% threshold for trustworthy forecasting."]


def test_zero_in_history_gives_no_infinite_change(spark):
    """The change after a zero is dropped; the fall to zero is a change of -100 %."""
    cases = {
        (5, 5, 0, 5, 5, 5, 5, 5): (4, "stable"),  # last six start at the zero: 0, 0, 0, 0
        (5, 5, 5, 0, 5, 5, 5, 5): (4, "volatile"),  # -1, 0, 0, 0
    }
    for values, expected in cases.items():
        frame = frames.frame(
            spark, order_date=frames.days("2025-01-01", 8), quantity=[float(v) for v in values]
        )
        r = state(frame, horizon=3).first()
        assert (r.change_count, r.volatility) == expected


def test_floor_at_zero_only_without_negative_history(spark):
    falling = [100.0, 80, 60, 40, 20, 0, 0, 0]
    frame = frames.frame(spark, order_date=frames.days("2025-01-01", 8), quantity=falling)
    assert all(x.metric_value >= 0 for x in P.forecast_projection(state(frame, horizon=4)).collect())
    lower = frames.frame(spark, order_date=frames.days("2025-01-01", 8), quantity=[v - 50 for v in falling])
    assert any(x.metric_value < 0 for x in P.forecast_projection(state(lower, horizon=4)).collect())


def test_partial_last_period_can_be_left_out(spark):
    frame = frames.quantities_180(spark)
    full = P.forecast_history(frame, "quantity", "order_date").count()
    assert P.forecast_history(frame, "quantity", "order_date", drop_partial=True).count() == full - 1


def test_chart_holds_history_and_projection(spark):
    chart = P.forecast_chart(state(frames.quantities_180(spark), keep_history=True))
    assert {r.series_type: r["count"] for r in chart.groupBy("series_type").count().collect()} == {
        "Actual": 26, "Forecast": 6}


def test_by_key_with_one_empty_series(spark):
    good = frames.quantities_180(spark).withColumn("k", F.lit("good"))
    bad = good.limit(3).withColumn("k", F.lit("bad")).withColumn("quantity", F.lit(None).cast("long"))
    s = P.forecast(good.unionByName(bad), "quantity", "order_date", ["k"])
    got = {r.k: r for r in s.collect()}
    assert got["bad"].status == "Not Ready" and got["bad"].messages == [P.MESSAGE_NO_ROWS]
    assert got["good"].status == "Ready"
    alone = P.forecast_projection(state(frames.quantities_180(spark))).collect()
    keyed = P.forecast_projection(s, ["k"]).drop("k").collect()
    assert sorted(map(str, alone)) == sorted(map(str, keyed))


def test_direction_rule(spark):
    rows = spark.createDataFrame([(100.0, 102.0), (100.0, 102.1), (10.0, 9.0), (10.0, 8.9)], "a double, b double")
    got = [r[0] for r in rows.select(P.direction_class(F.col("a"), F.col("b"))).collect()]
    assert got == ["Flat", "Up", "Flat", "Down"]


def test_averages_add_the_oldest_first(spark):
    values = [100.0, 110.0, 137.83, 226.32, 120.15, 198.48]
    rows = [(f"2024-01-{i + 1:02d}", v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "day string, value double")
    text = " ".join(r["finding"] for r in P.forecast_findings(P.forecast(frame, "value", "day", horizon=3)).collect())
    assert "recent actual average is 170.69" in text
