"""Column profile, per-column statistics and the column selectors built on them."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope import fixed_values as V
from tallyscope.functions.coerce import (
    NUMBER_PATTERN,
    clean_text,
    epoch_nanos,
    not_nan,
    parse_stripped_timestamp,
    ratio,
    whole_days,
)
from tallyscope.functions.naming import has_word, looks_like_identifier, normalise_name, quoted
from tallyscope.operators.shape import first_rows

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType)
MOMENTS = (T.DateType, T.TimestampType, T.TimestampNTZType)


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, MOMENTS):
        return "datetime"
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, T.StringType):
        return "text"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return "other"


def schema_frame(frame: DataFrame) -> DataFrame:
    """The schema as rows: ordinal, column_name, norm_name, kind."""
    rows = [
        {
            "ordinal": i,
            "column_name": f.name,
            "norm_name": normalise_name(f.name),
            "kind": kind_of(f.dataType),
        }
        for i, f in enumerate(frame.schema.fields)
    ]
    schema = pa.schema(
        [("ordinal", pa.int64()), ("column_name", pa.string()), ("norm_name", pa.string()),
         ("kind", pa.string())]
    )
    return frame.sparkSession.createDataFrame(pa.Table.from_pylist(rows, schema=schema))


def date_like(filled: Column, parsed: Column, different: Column) -> Column:
    """Whether a text column holds dates: most values parse, and they don't just repeat a few.

    Different values are weighed against as many as a first look would see.
    """
    seen = F.least(filled, F.lit(V.DATE_SAMPLE_SIZE))
    return F.coalesce(
        (seen >= V.DATE_SAMPLE_MIN)
        & (parsed / F.greatest(filled, F.lit(1)) >= V.DATE_SAMPLE_PARSED)
        & (F.least(different, F.lit(V.DATE_SAMPLE_SIZE)) / F.greatest(seen, F.lit(1)) >= V.DATE_SAMPLE_DISTINCT),
        F.lit(False),
    )


def bucket_of(kind: Column, dates: Column | None = None) -> Column:
    """Bucket of a column; without ``dates`` text is judged by the columns non_empty, date_ok and n_distinct_clean."""
    if dates is None:
        dates = date_like(F.col("non_empty"), F.col("date_ok"), F.col("n_distinct_clean"))
    return (
        F.when(kind.isin("numeric", "datetime", "other"), kind)
        .when((kind == "text") & dates, "datetime")
        .otherwise("categorical")
    )


def column_profile(frame: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Bucket of every column: numeric, categorical, datetime or other.

    Only text columns need data. In a stated order their first 50 non-blank values decide. Without one all
    values do, in one aggregate without a shuffle of rows: the bucket doesn't depend on where a row lies.
    """
    if order is None:
        return _profile_of_all(frame)
    keys = [f"o{j}" for j in range(len(order))]
    labels = [
        (f"c{i}", f.name) for i, f in enumerate(frame.schema.fields) if kind_of(f.dataType) == "text"
    ]
    columns = schema_frame(frame)
    if labels:
        cleaned = frame.select(
            *[quoted(c).alias(k) for c, k in zip(order, keys)],
            *[clean_text(quoted(name)).alias(label) for label, name in labels],
        )
        cells = cleaned.unpivot(keys, [label for label, _ in labels], "label", "value").where(
            "value is not null"
        )
        first = first_rows(
            cells, ["label"], [F.col(k) for k in (*keys, "value")], V.DATE_SAMPLE_SIZE, "position"
        )
        sampled = (
            first.groupBy(F.substring("label", 2, 9).cast("long").alias("ordinal"))
            .agg(
                F.count("*").alias("sampled"),
                F.count(parse_stripped_timestamp(F.col("value"))).alias("parsed"),
                F.count_distinct("value").alias("different"),
            )
        )
        columns = columns.join(sampled, "ordinal", "left").withColumn(
            "date_like", date_like(F.col("sampled"), F.col("parsed"), F.col("different"))
        )
    else:
        columns = columns.withColumn("date_like", F.lit(False))
    bucket = bucket_of(F.col("kind"), F.col("date_like"))
    return columns.select("ordinal", "column_name", "norm_name", bucket.alias("bucket"))


def _profile_of_all(frame: DataFrame) -> DataFrame:
    fields = [(i, f) for i, f in enumerate(frame.schema.fields) if kind_of(f.dataType) == "text"]
    columns = schema_frame(frame)
    cleaned = frame.select(*[clean_text(quoted(f.name)).alias(f"c{i}") for i, f in fields])
    cells = cleaned.unpivot([], [f"c{i}" for i, _ in fields], "label", "value").where("value is not null") if fields else None
    if cells is None:
        facts = columns.select("ordinal", *[F.lit(0).alias(c) for c in ("non_empty", "date_ok", "n_distinct_clean")])
    else:
        facts = cells.groupBy(F.substring("label", 2, 9).cast("long").alias("ordinal")).agg(
            F.count("*").alias("non_empty"),
            F.count(parse_stripped_timestamp(F.col("value"))).alias("date_ok"),
            F.theta_sketch_estimate(F.theta_sketch_agg(F.xxhash64("value"), 12)).alias("n_distinct_clean"),
        )
    return columns.join(facts, "ordinal", "left").select("ordinal", "column_name", "norm_name", bucket_of(F.col("kind")).alias("bucket"))


def _cell(field: T.StructField) -> Column:
    """One value in the form that keeps it exact and cheap to group by."""
    value, kind = quoted(field.name), field.dataType
    parts = {"whole": "long", "real": "double", "text": "string", "moment": "timestamp_ntz"}
    if isinstance(kind, INTEGERS):
        filled = {"whole": value.cast("long")}
    elif isinstance(kind, FLOATS):
        filled = {"real": not_nan(value.cast("double"))}
    elif isinstance(kind, T.BooleanType):
        filled = {"text": F.initcap(value.cast("string"))}
    elif isinstance(kind, (T.StringType, T.DecimalType)):
        filled = {"text": value.cast("string")}
    elif isinstance(kind, MOMENTS):
        filled = {"moment": value.cast("timestamp_ntz")}
    else:  # nested values are only counted
        filled = {"text": F.when(value.isNotNull(), "")}
    return F.struct(
        *[filled.get(p, F.lit(None)).cast(t).alias(p) for p, t in parts.items()]
    )


def column_stats(frame: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """One row per column: counts of present, blank, distinct, numeric and date values.

    Every row is unfolded into (column, value) cells and the cells are grouped, with map-side
    folding, so a value that fills a third of a column costs one row per task. Text is cleaned
    and parsed once per different value. The later groupings count distinct cleaned texts and times by a
    chain in which each key determines the next, and days and months by bitmaps. Without a stated
    order the buckets come from the same counts, so the table is read once.
    """
    fields = frame.schema.fields
    text_columns = [i for i, f in enumerate(fields) if kind_of(f.dataType) == "text"]
    date_named = [
        i
        for i, f in enumerate(fields)
        if kind_of(f.dataType) == "numeric" and any(w in normalise_name(f.name) for w in V.DATE_WORDS)
    ]
    nested = [i for i, f in enumerate(fields) if kind_of(f.dataType) == "other"]
    typed = [i for i, f in enumerate(fields) if kind_of(f.dataType) in ("numeric", "boolean")]
    cells = frame.select(*[_cell(f).alias(f"c{i}") for i, f in enumerate(fields)]).unpivot(
        [], [f"c{i}" for i in range(len(fields))], "label", "cell"
    )
    values = cells.groupBy(
        F.substring("label", 2, 9).cast("long").alias("ordinal"), "cell.whole", "cell.real", "cell.text",
        "cell.moment",
    ).agg(F.count("*").alias("n"))

    is_text, is_date_number = F.col("ordinal").isin(text_columns), F.col("ordinal").isin(date_named)
    full = F.coalesce(
        F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull()
        | F.col("moment").isNotNull(),
        F.lit(False),
    )
    cleaned = F.when(is_text, clean_text(F.col("text")))
    any_number = F.coalesce(
        F.col("real"), F.col("whole").cast("double"), F.col("text").try_cast("double")
    )
    when_time = (
        F.when(is_text, parse_stripped_timestamp(F.col("cleaned")))
        .when(is_date_number, epoch_nanos(any_number))
        .otherwise(F.col("moment"))
    )
    values = values.select("*", cleaned.alias("cleaned"))
    step = values.select(
        "ordinal", "n", full.alias("full"), "cleaned", when_time.alias("at"), is_text.alias("is_text")
    )
    filled = F.when(is_text, F.col("cleaned").isNotNull()).otherwise(F.col("full"))
    numeric = F.when(is_text, F.col("cleaned").rlike(NUMBER_PATTERN)).otherwise(
        F.col("full") & F.col("ordinal").isin(typed)
    )
    known_time = F.col("at").isNotNull()
    kept_time = F.when(is_text | is_date_number, F.col("at"))

    def tally(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    sums = ["n_rows", "non_null", "non_empty", "n_distinct", "n_distinct_non_empty", "numeric_ok",
            "date_ok", "typed_times"]
    by_text = step.groupBy(
        "ordinal", "cleaned", kept_time.alias("time_key"), F.col("at").cast("date").alias("day")
    ).agg(
        F.sum("n").alias("n_rows"),
        tally(F.col("full")).alias("non_null"),
        tally(filled).alias("non_empty"),
        F.count_if(F.col("full")).alias("n_distinct"),
        F.count_if(filled).alias("n_distinct_non_empty"),
        tally(numeric).alias("numeric_ok"),
        tally(known_time).alias("date_ok"),
        F.count_if(known_time & ~(is_text | is_date_number)).alias("typed_times"),
        F.min("at").alias("min_at"),
        F.max("at").alias("max_at"),
    )
    carried = [F.sum(c).alias(c) for c in sums] + [
        F.min("min_at").alias("min_at"), F.max("max_at").alias("max_at"),
    ]
    by_time = by_text.groupBy("ordinal", "time_key", "day").agg(
        *carried, F.count("cleaned").alias("cleaned_texts")
    )
    # days of 1024 months fill one bitmap; there are as many rows as the calendar has such spans
    month = F.year("day") * 12 + F.month("day")
    place = F.pmod(month, F.lit(1024)).cast("long")
    by_span = by_time.groupBy("ordinal", F.floor(month / 1024).alias("span")).agg(
        *carried,
        F.sum("cleaned_texts").alias("cleaned_texts"),
        F.count("time_key").alias("parsed_times"),
        F.bitmap_construct_agg(place * 32 + F.dayofmonth("day")).alias("days"),
        F.bitmap_construct_agg(place).alias("months"),
    )
    by_column = by_span.groupBy("ordinal").agg(
        *carried,
        F.sum("cleaned_texts").alias("cleaned_texts"),
        F.sum("parsed_times").alias("parsed_times"),
        F.sum(F.bitmap_count("days")).alias("n_days"),
        F.sum(F.bitmap_count("months")).alias("n_months"),
    )
    if order is None:
        own = by_column.withColumn("n_distinct_clean", F.col("cleaned_texts"))
        joined = schema_frame(frame).join(own, "ordinal", "left").withColumn("bucket", bucket_of(F.col("kind")))
    else:
        joined = column_profile(frame, order).join(by_column, "ordinal", "left")

    def counted(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long")

    def distinct(name: str) -> Column:
        return F.when(~F.col("ordinal").isin(nested), counted(name))

    return joined.select(
        "ordinal", "column_name", "norm_name", "bucket",
        *[counted(c).alias(c) for c in ("n_rows", "non_null", "non_empty")],
        distinct("n_distinct").alias("n_distinct"),
        distinct("n_distinct_non_empty").alias("n_distinct_non_empty"),
        F.when(is_text, counted("cleaned_texts")).otherwise(distinct("n_distinct")).alias("n_distinct_clean"),
        counted("numeric_ok").alias("numeric_ok"),
        counted("date_ok").alias("date_ok"),
        "min_at", "max_at",
        whole_days(F.col("min_at"), F.col("max_at")).alias("depth_days"),
        (counted("typed_times") + counted("parsed_times")).alias("n_times"),
        counted("n_days").alias("n_days"),
        counted("n_months").alias("n_months"),
    )


# --- rules on the statistics: one boolean expression each ----------------------------------


def valid_ratio() -> Column:
    return ratio(F.col("non_null"), F.col("n_rows"))


def is_metric(words: Sequence[str]) -> Column:
    """A numeric column worth measuring: filled, varying and not an identifier."""
    unique = F.col("n_distinct") / F.greatest(F.col("non_null"), F.lit(1))
    name, rows = F.col("norm_name"), F.greatest(F.col("n_rows"), F.lit(1))
    identifier = looks_like_identifier(
        name, unique, rows, V.IDENTIFIER_NAMES, V.IDENTIFIER_PARTS, words
    )
    return (
        (F.col("bucket") == "numeric")
        & (valid_ratio() >= V.COMPLETENESS)
        & (F.col("n_distinct") >= 2)
        & ~identifier
        & (has_word(name, words) | (unique < 0.95))
    )


def is_dimension() -> Column:
    """A categorical column with few enough groups to compare."""
    groups, filled, rows = F.col("n_distinct_clean"), F.col("non_empty"), F.col("n_rows")
    half = F.greatest(F.floor(rows / 2), F.lit(2))
    return (
        (F.col("bucket") == "categorical")
        & (filled > 0)
        & (filled / F.greatest(rows, F.lit(1)) >= 0.5)
        & (groups >= 2)
        & (groups <= F.least(F.lit(V.MAX_DIMENSION_GROUPS), half))
        & (groups / F.greatest(filled, F.lit(1)) < 0.95)
    )


def is_trend_date() -> Column:
    return (
        (F.col("bucket") == "datetime")
        & (ratio(F.col("date_ok"), F.col("n_rows")) >= 0.75)
        & (F.col("n_times") >= 2)
    )


def is_forecast_date() -> Column:
    return (
        (F.col("bucket") == "datetime")
        & (ratio(F.col("date_ok"), F.col("n_rows")) >= V.FORECAST_PARSE_RATE)
        & (F.col("n_times") >= V.FORECAST_MIN_PERIODS)
    )


def metric_priority() -> Column:
    """Position in the preference list, after the list when nothing matches."""
    ladder = F.when(F.lit(False), 0)
    for position, word in enumerate(V.FORECAST_PRIORITY):
        ladder = ladder.when(F.col("norm_name").contains(word), position)
    return ladder.otherwise(len(V.FORECAST_PRIORITY)).cast("long")


def _chosen(stats: DataFrame, rule: Column) -> DataFrame:
    return stats.where(rule).select("ordinal", "column_name")


def diagnostic_metric_columns(stats: DataFrame) -> DataFrame:
    return _chosen(stats, is_metric(V.BUSINESS_WORDS)).orderBy("ordinal")


def forecast_metric_columns(stats: DataFrame) -> DataFrame:
    return (
        stats.where(is_metric(V.FORECAST_WORDS))
        .select("ordinal", "column_name", metric_priority().alias("priority"), "norm_name")
        .orderBy("priority", "norm_name", "ordinal")
        .drop("norm_name")
    )


def dimension_columns(stats: DataFrame) -> DataFrame:
    return _chosen(stats, is_dimension()).orderBy("ordinal")


def trend_date_columns(stats: DataFrame) -> DataFrame:
    return _chosen(stats, is_trend_date()).orderBy("ordinal")


def forecast_date_columns(stats: DataFrame) -> DataFrame:
    return _chosen(stats, is_forecast_date()).orderBy("ordinal")
