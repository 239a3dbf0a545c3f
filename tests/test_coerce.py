from __future__ import annotations

import random

from pyspark.sql import functions as F

from tallyscope.functions import coerce as C
from tallyscope.functions.naming import first_column_with, normalise_name


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_round_exact_equals_decimal_correct_rounding(spark):
    rng = random.Random(7)
    values = [2.675, 1.005, 0.125, 0.375, 20.45, -20.45, 0.005, 1 / 3, 0.0, 8.0]
    values += [round(rng.uniform(-100, 100), 2) for _ in range(500)]
    values += [rng.uniform(0, 1e9) for _ in range(500)] + [rng.randrange(10**7) / 8 for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    rows = frame.select(
        "v", *[C.round_exact(F.col("v"), d).alias(f"r{d}") for d in (0, 1, 2)],
        C.fixed_text(F.col("v"), 1).alias("text"),
    ).collect()
    for r in rows:
        assert (r.r0, r.r1, r.r2) == (round(r.v, 0), round(r.v, 1), round(r.v, 2)), r.v
        assert float(r.text) == float(f"{r.v:.1f}")


def test_round_exact_passes_special_values(spark):
    frame = spark.createDataFrame([(float("inf"),), (None,)], "v double")
    assert [r[0] for r in frame.select(C.round_exact(F.col("v"), 2)).collect()] == [float("inf"), None]


def test_date_ladder(spark):
    cases = {
        "2025-01-05": "2025-01-05 00:00:00", "2025/1/5": "2025-01-05 00:00:00",
        "20250105": "2025-01-05 00:00:00", "2025": "2025-01-01 00:00:00",
        "2025-01": "2025-01-01 00:00:00", "01/05/2025": "2025-01-05 00:00:00",
        "31/12/2025": "2025-12-31 00:00:00", " 5 Jan 2025 ": "2025-01-05 00:00:00",
        "January 5, 2025 10:30": "2025-01-05 10:30:00", "2025-01-05T10:20:30": "2025-01-05 10:20:30",
        "12:30": None, "12": None, "1.5": None, "2025-13-01": None, "Foo 5, 2025": None, "": None,
        "x" * 1000: None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in frame.select("t", C.parse_timestamp(F.col("t")).cast("string").alias("p")).collect():
        assert r.p == cases[r.t], r.t


def test_number_text(spark):
    cases = {"1": 1.0, " 12 ": 12.0, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "+3": 3.0, "1d": None,
             "nan": None, "": None, "n/a": None, "1_000": None, "0x1F": None, "-inf": float("-inf")}
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    for r in frame.select("t", C.parse_number(F.col("t")).alias("p")).collect():
        assert r.p == cases[r.t], r.t


def test_dimension_cleaning(spark):
    frame = spark.createDataFrame(
        [(" a\t", True, 1.5), ("\n ", False, float("nan")), (None, None, None), (" b", True, 2.0)],
        "t string, b boolean, d double",
    )
    rows = frame.select(*[C.clean_dimension(frame, c).alias(c) for c in "tbd"]).collect()
    assert [r.t for r in rows] == ["a", None, None, "b"]
    assert [r.b for r in rows] == ["True", "False", None, "True"]
    assert [r.d for r in rows] == ["1.5", None, None, "2.0"]


def test_whole_days_counts_elapsed_days(spark):
    a, b = F.expr("timestamp_ntz'2024-01-01 10:00:00'"), F.expr("timestamp_ntz'2024-01-03 09:59:59'")
    assert one(spark, C.whole_days(a, b)) == 1
    assert one(spark, C.whole_days(a, F.lit(None).cast("timestamp_ntz"))) == 0


def test_week_starts_on_monday(spark):
    sunday, monday = F.expr("date'2025-01-05'"), F.expr("date'2025-01-06'")
    assert str(one(spark, C.period_start(sunday, F.lit("W")))) == "2024-12-30"
    assert str(one(spark, C.period_start(monday, F.lit("W")))) == "2025-01-06"


def test_names():
    assert normalise_name("  Net Revenue (USD) ") == "net_revenue_usd"
    assert first_column_with(["a", "Gross Margin", "profit"], ["profit", "margin"]) == "Gross Margin"
    assert first_column_with(["a"], ["profit"]) is None


def test_percentage(spark):
    assert one(spark, C.percentage(F.lit(1), F.lit(3))) == 33.33
    assert one(spark, C.percentage(F.lit(1), F.lit(0))) == 0.0


def test_more_date_forms(spark):
    forms = {
        "09/18/2024 11:30 PM": "2024-09-18 23:30:00",
        "2024-09-18 12:00 AM": "2024-09-18 00:00:00",
        "2024-09-18 12:00 PM": "2024-09-18 12:00:00",
        "1/2/24": "2024-01-02 00:00:00",
        "31/12/99": "1999-12-31 00:00:00",
        "20240918T120000": "2024-09-18 12:00:00",
        "Wed Sep 18 12:00:00 2024": "2024-09-18 12:00:00",
        "Wednesday, September 18, 2024": "2024-09-18 00:00:00",
        "Wednesday, September 18, 2024 11:59:59 PM": "2024-09-18 23:59:59",
        "12:30 PM": None,
        "Sunny 1/2": None,
    }
    frame = spark.createDataFrame([(t,) for t in forms], "t string")
    rows = frame.select("t", C.parse_timestamp(F.col("t")).cast("string").alias("at")).collect()
    assert {r["t"]: r["at"] for r in rows} == forms
