from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallyscope.operators import columns as C
from tallyscope.sources.tables import dirty
from tallyscope.operators import intelligence as I
from tallyscope.operators import sketches as K
from tests import frames


def buckets(frame):
    return {r.column_name: r.bucket for r in C.column_profile(frame).collect()}


def facts(frame):
    return I.dataset_facts(C.column_stats(frame)).first()


def test_buckets(spark):
    frame = frames.frame(
        spark, n=[1, 2, 3, 4], b=[True, False, True, None], day=["2025-01-01", "2025-01-02", "x", None],
        good=["2025-01-01", "2025-01-02", "2025-01-03", " "], few=["2025-01-01", "2025-01-02", None, None],
        moment=frames.days("2025-01-01", 4),
    ).withColumn("nested", F.array(F.lit(1)))
    assert buckets(frame) == {
        "n": "numeric", "b": "categorical", "day": "categorical", "good": "datetime",
        "few": "categorical", "moment": "datetime", "nested": "other",
    }


def test_repeated_dates_are_not_date_like(spark):
    frame = frames.frame(spark, d=["2025-01-01"] * 40 + ["2025-01-02"] * 10)
    assert buckets(frame) == {"d": "categorical"}  # 2 different of 50


def test_stats_of_one_column(spark):
    nan = float("nan")
    frame = spark.createDataFrame(
        [(" a ", 0.0, dt.date(2025, 1, 1)), ("a", -0.0, dt.date(2025, 2, 1)), ("", nan, None), (None, 1.0, None)],
        "t string, d double, day date",
    )
    s = {r.column_name: r for r in C.column_stats(frame).collect()}
    t, d, day = s["t"], s["d"], s["day"]
    assert (t.n_rows, t.non_null, t.non_empty, t.n_distinct, t.n_distinct_non_empty, t.n_distinct_clean) == (
        4, 3, 2, 3, 2, 1)
    assert (d.non_null, d.n_distinct, d.numeric_ok) == (3, 2, 3)
    assert (day.date_ok, day.n_times, day.n_days, day.n_months, day.depth_days) == (2, 2, 2, 2, 31)


def test_stats_of_an_empty_frame(spark):
    rows = C.column_stats(frames.grouped_6(spark).limit(0)).collect()
    assert len(rows) == 5 and all(r.n_rows == 0 and r.n_distinct == 0 for r in rows)


def test_text_dates_collapse_to_one_time(spark):
    frame = frames.frame(spark, d=["2025-01-01", "01/01/2025", "1 Jan 2025", "2025-01-02"])
    r = C.column_stats(frame).first()
    assert (r.n_distinct, r.n_times, r.n_days, r.bucket) == (4, 2, 2, "datetime")


def test_numeric_column_named_like_a_date(spark):
    frame = frames.frame(spark, year=[2023, 2024, 2025], amount=[1.0, 2.0, 3.0])
    r = facts(frame)
    assert (r.time_column, r.time_parse_rate, r.time_periods, r.time_depth_days) == ("year", 1.0, 1, 0)


def test_selectors_leave_identifiers_out(spark):
    r = facts(frames.identifiers_10(spark))
    assert r.diagnostic_metrics == ["net_revenue"]
    assert r.diagnostic_dimensions == ["region", "segment"]
    assert r.trend_dates == ["order_date"]


def test_two_word_lists(spark):
    unique = [float(i) for i in range(30)]
    frame = frames.frame(spark, demand=unique, sales=unique, other=unique)
    r = facts(frame)
    assert r.diagnostic_metrics == ["sales"]
    assert r.forecast_metrics == ["demand", "sales"]


def test_readiness_conservative(spark):
    r = facts(frames.text_dates_90(spark))
    assert (r.descriptive_status, r.diagnostic_status) == ("Ready", "Ready")
    assert (r.predictive_status, r.prescriptive_status) == ("Conditional", "Conditional")
    assert "Conditional" in r.predictive_reason
    assert "should be confirmed before anything is forced" in r.prescriptive_reason


def test_readiness_strong_time(spark):
    r = facts(frames.strong_time_180(spark))
    assert r.predictive_status == "Ready" and "time periods" in r.predictive_reason
    assert (r.time_periods, r.time_depth_days) == (6, 179)


def test_readiness_without_dimensions(spark):
    r = facts(frames.frame(spark, sales_amount=[10, 12, 15, 13, 16], profit=[3, 4, 5, 3, 6]))
    assert (r.descriptive_status, r.diagnostic_status) == ("Ready", "Conditional")
    assert (r.predictive_status, r.prescriptive_status) == ("Not Ready", "Not Ready")


def test_single_letter_word_is_kept(spark):
    r = facts(frames.frame(spark, density=[1.0, 2.0, 2.0]))  # holds a y
    assert r.target_candidates == 1


def test_dataset_type(spark):
    assert facts(frames.thirds_180(spark)).dataset_type == "transactional"
    plain = frames.frame(spark, a=[1, 2, 3], b=["x", "y", "z"])
    assert facts(plain).dataset_type == "generic_tabular"
    assert facts(plain).business_signals == [I.NO_SIGNAL]
    tickets = frames.frame(spark, ticket=["a", "b"], resolution=["x", "y"])
    assert facts(tickets).dataset_type == "service_support"


def test_depth_of_45_days_switches_to_months(spark):
    at_45 = frames.frame(spark, day=[*frames.days("2025-01-01", 46)])
    at_44 = frames.frame(spark, day=[*frames.days("2025-01-01", 45)])
    assert facts(at_45).time_periods == 2
    assert facts(at_44).time_periods == 45


def test_stats_do_not_depend_on_partitions(spark):
    frame = frames.thirds_180(spark)
    key = "column_name"
    one = C.column_stats(frame).orderBy(key).collect()
    many = C.column_stats(frame.repartition(7)).orderBy(key).collect()
    assert one == many


def test_estimated_statistics_differ_in_distinct_counts_only(spark):
    frame = dirty(spark, "/root/testdata/sf0.001")
    exact = {r["ordinal"]: r.asDict() for r in C.column_stats(frame, ["order_id", "line_no", "net_revenue", "profit"]).collect()}
    near = {r["ordinal"]: r.asDict() for r in K.approximate_column_stats(frame).collect()}
    assert exact.keys() == near.keys()
    for ordinal, row in exact.items():
        assert row.keys() == near[ordinal].keys()
        for name, value in row.items():
            if name.startswith("n_") and name != "n_rows" and value is not None:
                assert abs(near[ordinal][name] - value) <= max(1, 0.1 * value), (row["column_name"], name)
            else:
                assert near[ordinal][name] == value, (row["column_name"], name)


def test_buckets_do_not_depend_on_partitions(spark):
    """Dates stand together at one end, so that the first values of a task are all dates or none."""
    days = [f"2025-01-{1 + i % 28:02d}" for i in range(900)]
    frame = spark.createDataFrame(
        [((days + ["x"] * 60)[i], (days[:700] + ["x"] * 260)[i], f"2025-01-0{1 + i // 480}", "x", " ") for i in range(960)],
        "mostly string, partly string, few string, none string, blank string",
    )
    expected = {"mostly": "datetime", "partly": "categorical", "few": "categorical", "none": "categorical", "blank": "categorical"}
    for parts in (1, 7, 64):
        spread = frame.repartition(parts)
        assert buckets(spread) == expected
        assert {r.column_name: r.bucket for r in C.column_stats(spread).collect()} == expected
        assert {r.column_name: r.bucket for r in K.decided_column_stats(spread).collect()} == expected


def test_a_stated_order_keeps_the_first_values_rule(spark):
    frame = spark.createDataFrame([(i, f"2025-01-{1 + i % 28:02d}" if i < 50 else "x") for i in range(200)], "i int, t string")
    assert {r.column_name: r.bucket for r in C.column_profile(frame, ["i"]).collect()}["t"] == "datetime"
    assert buckets(frame)["t"] == "categorical"


def test_bitmaps_count_days_and_months_exactly(spark):
    frame = spark.sql("select timestampadd(hour, cast(id * 7919 as int), timestamp_ntz'1890-01-31 23:00:00') as at from range(4000)")
    days = {r["at"].date() for r in frame.collect()}
    for stats in (C.column_stats(frame), K.approximate_column_stats(frame)):
        r = stats.first()
        assert (r.n_days, r.n_months) == (len(days), len({(d.year, d.month) for d in days}))
        assert r.n_times == 4000


def test_columns_near_a_bound_are_counted(spark):
    """Shares of different values on both sides of 0.95 and 0.98, closer to it than a sketch can tell."""
    n = 40_000
    shares = {"a": 0.949, "b": 0.951, "c": 0.979, "d": 0.981, "e": 0.5, "f": 1.0}
    frame = spark.range(n).select(*[(F.pmod(F.col("id"), F.lit(int(n * s)))).alias(c) for c, s in shares.items()])
    exact = {r.column_name: r.n_distinct for r in C.column_stats(frame).collect()}
    estimates = K.approximate_column_stats(frame)
    near = {r.column_name for r in estimates.where(K.undecided()).collect()}
    assert {"a", "b", "c", "d", "f"} <= near and "e" not in near
    decided = K.decided_column_stats(frame)
    assert [r.ordinal for r in decided.orderBy("ordinal").collect()] == list(range(6))
    assert all(r.n_distinct == exact[r.column_name] for r in decided.collect() if r.column_name != "e")
    for pick in (C.diagnostic_metric_columns, C.forecast_metric_columns, C.dimension_columns):
        assert pick(decided).collect() == pick(C.column_stats(frame)).collect()


def test_statistics_move_a_row_per_column_and_task(spark):
    """No shuffle of the estimates grows with the rows."""
    plan = K.approximate_column_stats(dirty(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "hashpartitioning" in line and "ordinal" in line]
    assert shuffles and all("text" not in line and "cleaned" not in line.split("hashpartitioning")[1] for line in shuffles)


def test_statistics_of_several_datasets_are_those_of_each(spark):
    data = {"a": frames.thirds_180(spark), "b": frames.text_dates_90(spark), "c": frames.grouped_6(spark)}
    rows = K.stats_of_datasets(data)
    for name, frame in data.items():
        own = rows.where(F.col("dataset") == name).drop("dataset").orderBy("ordinal").collect()
        assert own == K.approximate_column_stats(frame).orderBy("ordinal").collect()
        assert own == C.column_stats(frame).orderBy("ordinal").collect()


def test_readiness_of_several_datasets_is_that_of_each(spark):
    data = {"a": frames.thirds_180(spark), "b": frames.text_dates_90(spark), "c": frames.grouped_6(spark)}
    facts = I.dataset_facts(K.decided_stats_of_datasets(data), ["dataset"])
    for name, frame in data.items():
        own = I.dataset_facts(C.column_stats(frame))
        for part in (I.readiness, I.forecast_options, I.prescriptive_options, I.dataset_type):
            got = part(facts, ["dataset"]).where(F.col("dataset") == name).drop("dataset")
            assert sorted(map(str, got.collect())) == sorted(map(str, part(own).collect()))
