from __future__ import annotations

from pyspark.sql import functions as F

from tallyscope.operators import columns as C
from tallyscope.operators import quality as Q


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def sample(spark):
    nan = float("nan")
    return spark.createDataFrame(
        [(1, "a", 1.0), (1, "a", 1.0), (1, "a", 1.0), (2, None, nan), (2, None, None), (3, "", 2.0)],
        "k int, t string, d double",
    )


def test_duplicates_treat_missing_as_equal(spark):
    assert rows(Q.duplicate_rows(sample(spark))) == [(3,)]
    assert rows(Q.duplicate_rows(sample(spark).limit(0))) == [(0,)]


def test_missing_counts_nan_but_not_blank(spark):
    assert rows(Q.missing_summary(sample(spark))) == [("d", 2, 33.33), ("t", 2, 33.33)]


def test_overview_and_log(spark):
    frame = sample(spark)
    assert rows(Q.kpi_overview(frame)) == [(6, 3, 3, 2)]
    assert rows(Q.dataset_summary(frame)) == [(6, 3)]
    log = [r[1] for r in rows(Q.quality_log(frame, C.column_profile(frame)))]
    assert "Detected 3 duplicate row(s) without removing them." in log
    assert "Detected missing values in 2 column(s)." in log
    assert "No columns met the conservative datetime detection threshold." in log
    clean = frame.dropna()
    assert Q.LOG_NO_MISSING in [r[1] for r in rows(Q.quality_log(clean, C.column_profile(clean)))]


def test_preview_is_ordered(spark):
    frame = spark.range(100).withColumn("v", -F.col("id"))
    assert [r.id for r in Q.preview(frame, ["v"], 3).collect()] == [99, 98, 97]


def test_column_names_with_dots(spark):
    frame = spark.createDataFrame([(1, None)], "`a.b` int, `c d` string")
    assert rows(Q.missing_summary(frame)) == [("c d", 1, 100.0)]
    assert rows(Q.duplicate_rows(frame)) == [(0,)]


def test_duplicates_tell_missing_columns_apart(spark):
    nan = float("nan")
    rows_ = [(None, "a", 0.0), ("a", None, 0.0), ("a", None, -0.0), ("a", None, nan), ("a", None, None)]
    frame = spark.createDataFrame(rows_, "x string, y string, z double")
    assert rows(Q.duplicate_rows(frame)) == [(2,)]
    assert rows(Q.kpi_overview(frame)) == [(5, 3, 2, 3)]
    assert rows(Q.kpi_overview(frame.limit(0))) == [(0, 3, 0, 0)]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_repeated_rows_by_filter(spark):
    """2 and 60 percent of the rows repeated; every copy is found, and rows without a copy don't move."""
    for repeated in (20, 600):
        base = spark.range(1000).select(F.col("id"), F.concat(F.lit("t"), "id").alias("t"), F.lit(None).cast("double").alias("n"))
        frame = base.unionByName(base.where(F.col("id") < repeated)).repartition(5)
        found = {r["c0"]: r["copies"] for r in Q.repeated_rows(frame).collect()}
        assert found == {i: 2 for i in range(repeated)}
        assert rows(Q.duplicate_rows(frame)) == [(repeated,)]


def test_filter_that_is_full_only_costs_time(spark, monkeypatch):
    monkeypatch.setattr(Q, "FILTER_BITS", 64)
    monkeypatch.setattr(Q, "BITMAP_BITS", 32)
    base = spark.range(1000).select("id")
    frame = base.unionByName(base.where("id < 300"))
    assert Q.repeated_rows(frame).count() == 300


def test_whole_rows_move_behind_the_filter_only(spark):
    frame = spark.range(100).select("id", F.uuid().alias("t"))
    plan = plan_of(Q.repeated_rows(frame))
    assert plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoop") >= 1 and "SortMergeJoin" not in plan


def test_overview_reads_the_rows_once(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert plan_of(Q.kpi_overview(frame)).count("Scan parquet") == 1
    assert plan_of(Q.duplicate_rows(frame)).count("Scan parquet") == 1
