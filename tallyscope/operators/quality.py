"""Data quality: shape, duplicate rows, missing values, overview, log, preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.functions.coerce import not_nan, percentage
from tallyscope.functions.naming import quoted

# Message texts.
SHORT_ACTIONS = (
    "CSV loaded into a Spark DataFrame for profiling.",
    "Duplicate rows counted without removing records.",
    "Missing values measured by column.",
    "Datetime detection attempted conservatively on text-like columns.",
    "No permanent cleaning transformations were applied to the uploaded dataset.",
)
LOG_LOADED = "Loaded the uploaded CSV successfully for profiling."
LOG_DUPLICATES = "Detected %d duplicate row(s) without removing them."
LOG_MISSING = "Detected missing values in %d column(s)."
LOG_NO_MISSING = "No missing values were detected across the dataset."
LOG_PROFILED = "Profiled columns into numeric, categorical, datetime, and other groups."
LOG_DATES = "Conservative datetime detection flagged %d column(s)."
LOG_NO_DATES = "No columns met the conservative datetime detection threshold."
LOG_UNCHANGED = "No permanent cleaning transformations were applied in Phase 1."


def present(frame: DataFrame, name: str) -> Column:
    """The column with NaN read as missing (blank text is not missing)."""
    value = quoted(name)
    if isinstance(frame.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return not_nan(value)
    return value


def dataset_summary(frame: DataFrame) -> DataFrame:
    """Row and column count."""
    return frame.agg(F.count("*").alias("row_count")).withColumn(
        "column_count", F.lit(len(frame.columns)).cast("long")
    )


def preview(frame: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first rows in a stated order (a table has no order of its own)."""
    return frame.orderBy(*[quoted(c) for c in order]).limit(n)


#: Bits of the filter of repeated hashes; its 2048 bitmaps of 4 KB are all that is broadcast.
FILTER_BITS = 1 << 26
BITMAP_BITS = 1 << 15


def _hashed_rows(frame: DataFrame) -> DataFrame:
    """Rows with missing values made alike (``c0``, ``c1``, ...), a 128-bit hash of each, and its gaps as 0 and 1."""
    rows = frame.select(*[present(frame, c).alias(f"c{i}") for i, c in enumerate(frame.columns)])
    # hashes skip nulls, so which columns are missing is hashed as well; + 0.0 makes -0.0 and 0.0 alike
    floats = (T.FloatType, T.DoubleType)
    values = [
        F.col(f.name) + F.lit(0.0).cast(f.dataType) if isinstance(f.dataType, floats) else F.col(f.name)
        for f in rows.schema.fields
    ]
    gaps = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in rows.columns])
    first, second = F.xxhash64(gaps, *values), F.xxhash64(*reversed(values), gaps, F.lit("second"))
    return rows.select("*", F.struct(first.alias("a"), second.alias("b")).alias("__hash"), gaps.alias("__gaps"))


def repeated_rows(frame: DataFrame) -> DataFrame:
    """Each row that occurs more than once, with its number of copies; missing equals missing.

    Only hashes are shuffled at first, folded per task. The hashes seen more than once set bits of a filter of
    fixed size, an aggregate, which every task of the second pass has: rows whose bit is not set stay where
    they are, however many hashes repeat. The others are compared as a whole, exactly, folded per task
    again: a row that fills a third of the table reaches a shuffle once per task.
    """
    rows = _hashed_rows(frame).drop("__gaps")
    seen = rows.groupBy("__hash").agg(F.count("*").alias("copies")).where("copies > 1").select("__hash")
    bit = F.pmod(F.col("__hash.a"), F.lit(FILTER_BITS))
    place, number = F.pmod(bit, F.lit(BITMAP_BITS)), F.floor(bit / BITMAP_BITS)
    filled = seen.select(number.alias("__number"), place.alias("__place")).groupBy("__number").agg(
        F.bitmap_construct_agg("__place").alias("__bits")
    )
    # at most FILTER_BITS / BITMAP_BITS rows of BITMAP_BITS / 8 bytes
    placed = rows.withColumns({"__number": number, "__place": place}).join(F.broadcast(filled), "__number")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.col("__place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.pow(F.lit(2), F.col("__place") % 8).cast("int")) > 0
    candidates = placed.where(is_set).drop("__number", "__place", "__bits", "__hash")
    return candidates.groupBy(*candidates.columns).agg(F.count("*").alias("copies")).where("copies > 1")


def duplicate_rows(frame: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows, known by 128-bit hashes; one narrow shuffle."""
    counts = _hashed_rows(frame).groupBy("__hash").agg(F.count("*").alias("copies"))
    surplus = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    return counts.agg(surplus.cast("long").alias("duplicate_rows"))


def missing_summary(frame: DataFrame) -> DataFrame:
    """Missing count and percent of every column that has missing values, worst first."""
    counts = frame.agg(
        F.count("*").alias("total"),
        *[F.count(present(frame, c)).alias(f"c{i}") for i, c in enumerate(frame.columns)],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"), (F.col("total") - F.col(f"c{i}")).alias("missing_count")
            )
            for i, c in enumerate(frame.columns)
        ]
    )
    return (
        counts.select("total", F.inline(entries))
        .where("missing_count > 0")
        .select(
            "column_name",
            "missing_count",
            percentage(F.col("missing_count"), F.col("total")).alias("missing_percentage"),
        )
        .orderBy(F.desc("missing_percentage"), F.desc("missing_count"), F.asc("column_name"))
    )


def kpi_overview(frame: DataFrame) -> DataFrame:
    """Rows, columns, duplicates and columns with missing values, from one pass over the rows.

    Rows are folded by hash; rows of one hash have the same gaps, which travel with it.
    """
    folded = _hashed_rows(frame).groupBy("__hash", "__gaps").agg(F.count("*").alias("copies"))
    with_gap = [F.max((F.substring("__gaps", i + 1, 1) == "1").cast("long")) for i in range(len(frame.columns))]
    with_gaps = sum((F.coalesce(g, F.lit(0)) for g in with_gap), F.lit(0))
    return folded.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("total_rows"),
        F.lit(len(frame.columns)).cast("long").alias("total_columns"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
        with_gaps.cast("long").alias("columns_with_missing_values"),
    )


def quality_log(frame: DataFrame, profile: DataFrame) -> DataFrame:
    """The observations as text rows; ``profile`` is the frame's column profile."""
    kpi = kpi_overview(frame)
    dates = profile.agg(F.count_if(F.col("bucket") == "datetime").alias("n")).scalar()
    gaps = F.col("columns_with_missing_values")
    messages = F.array(
        F.lit(LOG_LOADED),
        F.format_string(LOG_DUPLICATES, F.col("duplicate_rows")),
        F.when(gaps > 0, F.format_string(LOG_MISSING, gaps)).otherwise(LOG_NO_MISSING),
        F.lit(LOG_PROFILED),
        F.when(F.col("dates") > 0, F.format_string(LOG_DATES, F.col("dates"))).otherwise(LOG_NO_DATES),
        F.lit(LOG_UNCHANGED),
    )
    return kpi.withColumn("dates", dates).select(
        F.posexplode_outer(messages).alias("position", "message")
    ).select((F.col("position") + 1).cast("long").alias("message_order"), "message")


def preprocessing_summary(frame: DataFrame) -> DataFrame:
    """The same counts as one row, with the list of what was and was not done."""
    kpi = kpi_overview(frame)
    return kpi.select(
        F.col("total_rows").alias("input_rows"),
        F.col("total_columns").alias("input_columns"),
        F.col("duplicate_rows").alias("duplicate_rows_detected"),
        "columns_with_missing_values",
        F.array(*[F.lit(a) for a in SHORT_ACTIONS]).alias("profiling_actions"),
    )
