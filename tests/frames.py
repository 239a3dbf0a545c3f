"""Small generated frames with values worked out by hand."""

from __future__ import annotations

import datetime as dt

import pandas as pd


def days(start: str, n: int) -> list[dt.datetime]:
    first = dt.datetime.fromisoformat(start)
    return [first + dt.timedelta(days=i) for i in range(n)]


def months(year: int, n: int) -> list[dt.datetime]:
    return [dt.datetime(year + i // 12, i % 12 + 1, 1) for i in range(n)]


def frame(spark, **columns):
    """A frame in the given row order, times without zone."""
    data = spark.createDataFrame(pd.DataFrame(columns)).coalesce(1)
    for name, kind in data.dtypes:
        if kind == "timestamp":
            data = data.withColumn(name, data[name].cast("timestamp_ntz"))
    return data


def text_dates_90(spark):
    return frame(
        spark,
        order_date=[d.strftime("%Y-%m-%d") for d in days("2025-01-01", 90)],
        sales_amount=[100 + (i % 7) * 10 for i in range(90)],
        region=["North", "South", "East"] * 30,
        product_category=["A", "B", "C", "D", "E"] * 18,
    )


def strong_time_180(spark):
    return frame(
        spark,
        event_date=days("2024-01-01", 180),
        units_sold=[50 + i % 14 for i in range(180)],
        promo_flag=[i % 2 for i in range(180)],
        store_region=["North", "South", "West"] * 60,
    )


def identifiers_10(spark):
    return frame(
        spark,
        order_id=list(range(1, 11)),
        net_revenue=[100, 120, 90, 130, 110, 140, 95, 150, 160, 105],
        region=["North", "South"] * 5,
        segment=["Retail", "Wholesale"] * 5,
        order_date=days("2025-01-01", 10),
    )


def grouped_6(spark):
    return frame(
        spark,
        net_revenue=[100, 120, 70, 50, 40, 30],
        region=["North", "North", "South", "South", "West", "West"],
        order_date=days("2025-01-01", 6),
        discount_pct=[5, 7, 10, 12, 25, 30],
        profit=[30, 35, 18, 12, 3, 2],
    )


def six_groups_12(spark):
    return frame(
        spark,
        net_revenue=[200, 180, 160, 140, 120, 100, 80, 60, 40, 20, 10, 5],
        region=["A", "B", "C", "D", "E", "F"] * 2,
        order_date=months(2025, 12),
    )


def quantities_180(spark):
    return frame(
        spark, order_date=days("2024-01-01", 180), quantity=[50 + i % 10 for i in range(180)]
    )


def short_5(spark):
    return frame(spark, order_date=days("2025-01-01", 5), quantity=[10, 12, 11, 13, 14])


def thirds_180(spark, revenue=(240, 120, 40), profit=(60, 20, 2), discount=(5, 12, 30)):
    def thirds(values):
        return [values[i // 60] for i in range(180)]

    return frame(
        spark,
        order_date=days("2024-01-01", 180),
        net_revenue=thirds(revenue),
        profit=thirds(profit),
        discount_pct=thirds(discount),
        region=thirds(["North", "South", "West"]),
    )


def report_90(spark):
    return frame(
        spark,
        order_date=days("2024-01-01", 90),
        net_revenue=[100 + (i % 7) * 5 for i in range(90)],
        profit=[20 + i % 5 for i in range(90)],
        region=["North", "South", "West"] * 30,
    )
