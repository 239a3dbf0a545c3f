"""One aggregate over the raw rows, from which group totals, margins and daily totals are projected.

The rows are read once. They are folded, on the map side already, to one row per (keys, group) and one per
(keys, day), each with the sums and counts that the layers above need of that set; the others stay empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.coerce import as_number, as_timestamp, clean_dimension
from tallyscope.operators.shape import columns_of

GROUPS, DAYS = "__groups", "__days"


def fold(
    frame: DataFrame,
    by: Sequence[str] = (),
    dimension: str | None = None,
    metric: str | None = None,
    margins: tuple[str, str] | None = None,
    date: str | None = None,
    dated_metric: str | None = None,
) -> DataFrame:
    """Rows of the set ``groups`` (with ``dimension``) and of the set ``days`` (with ``date``).

    ``margins`` names the discount and profit columns; they are summed over rows that have a group and
    both values. Rows without a group or a readable date fall under a null group or day.
    """
    measures = {"metric": metric, "dated": dated_metric, **dict(zip(("discount", "profit"), margins or ()))}
    values = {"group": F.lit(None).cast("string"), "at": F.lit(None).cast("timestamp_ntz")}
    values |= {n: F.lit(None).cast("double") for n in ("metric", "dated", "discount", "profit")}
    values |= {} if dimension is None else {"group": clean_dimension(frame, dimension)}
    values |= {} if date is None else {"at": as_timestamp(frame, date)}
    values |= {n: as_number(frame, name) for n, name in measures.items() if name is not None}
    plain = frame.select(*columns_of(by), *[v.alias(f"__{n}") for n, v in values.items()])
    own = {GROUPS: ("group", "metric", "discount", "profit"), DAYS: ("at", "dated")}

    def cell(kept: Sequence[str]) -> Column:
        """The values of one set; those of the other are null, so that no sum is shuffled twice."""
        kinds = {n: plain.schema[f"__{n}"].dataType for n in values}
        return F.struct(*[(F.col(f"__{n}") if n in kept else F.lit(None).cast(kinds[n])).alias(n) for n in values])

    sets = ([GROUPS] if dimension is not None else []) + ([DAYS] if date is not None else [])
    cells = plain.select(*columns_of(by), *[cell(own[s]).alias(s) for s in sets]).unpivot(columns_of(by), sets, "set", "cell")
    cells = cells.select(*columns_of(by), "set", "cell.*").withColumn("day", F.col("at").cast("date"))
    both = F.col("discount").isNotNull() & F.col("profit").isNotNull()
    return cells.groupBy(*columns_of(by), "set", "group", "day").agg(
        F.sum("metric").alias("total"),
        F.count("metric").alias("row_count"),
        F.sum(F.when(both, F.col("discount"))).cast("double").alias("discounts"),
        F.count_if(both).alias("margin_rows"),
        F.sum(F.when(both, F.col("profit"))).cast("double").alias("profits"),
        F.sum("dated").alias("dated_total"),
        F.count("dated").alias("dated_rows"),
        F.count("*").alias("n_rows"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
    )


def group_totals(folded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals and margins per (keys, group), the rows without a group under a null group."""
    return folded.where(F.col("set") == GROUPS).select(
        *columns_of(by), "group", "total", "row_count", F.col("group").isNotNull().alias("grouped"), "discounts", "margin_rows", "profits"
    )


def daily_totals(folded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals per (keys, day), the rows without a readable date under a null day."""
    return folded.where(F.col("set") == DAYS).select(
        *columns_of(by), "day", F.col("dated_total").alias("total"), F.col("dated_rows").alias("metric_rows"), "n_rows", "first_at", "last_at"
    )
