"""Column statistics from one map-side aggregate over the cells of one or several datasets.

Every row is unfolded into cells, and the cells are folded per column: counts, the smallest value hashes of
the different values (a theta sketch: mergeable, whatever the order of the rows or their partitions) and, for
dates, bitmaps of days and months. What is shuffled is a row per task, column and about 85 years of dates.

A sketch counts exactly up to ``EXACT`` different values. Beyond, it is off by 1.6 percent (one standard
deviation). ``decided_column_stats`` counts a column's values in a second pass only where an estimate lies so
near to one of the bounds of the selection rules that it could fall on the wrong side.

Against ``columns.column_stats`` this parses text in every row instead of once for each different value, and shuffles
no values: the choice where columns are nearly unique and the network is what limits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope import fixed_values as V
from tallyscope.functions.coerce import NUMBER_PATTERN, clean_text, epoch_nanos, parse_stripped_timestamp, whole_days
from tallyscope.functions.naming import normalise_name, quoted
from tallyscope.operators import columns as C
from tallyscope.session import materialise

#: Logarithm of the hashes a sketch holds.
SKETCH = 12
EXACT = 1 << SKETCH
#: Standard deviations an estimate may be wrong.
SIGMAS = 5
#: Months whose days fill one bitmap.
BITMAP_MONTHS = 1024

COUNTS = ("n_rows", "non_null", "non_empty", "numeric_ok", "date_ok")


def long_cells(frame: DataFrame, **constants: str) -> DataFrame:
    """Every cell as a row: ordinal, what its column is, and its typed value; ``constants`` go in front."""
    fields = frame.schema.fields
    kinds = []
    for field in fields:
        kind = C.kind_of(field.dataType)
        dated = kind == "numeric" and any(w in normalise_name(field.name) for w in V.DATE_WORDS)
        kinds.append("date_number" if dated else "number" if kind in ("numeric", "boolean") else kind)
    rows = frame.select(*[C._cell(f).alias(f"c{i}") for i, f in enumerate(fields)]).unpivot(
        [], [f"c{i}" for i in range(len(fields))], "label", "cell"
    )
    ordinal = F.substring("label", 2, 9).cast("long")
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), ordinal.cast("int"))
    return rows.select(*[F.lit(v).alias(k) for k, v in constants.items()], ordinal.alias("ordinal"), kind.alias("kind"), "cell.*")


def sketched(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (keys, ordinal): exact counts, times, days and months, and estimates of different values."""
    is_text = F.col("kind") == "text"
    some = [F.col(c).isNotNull() for c in ("whole", "real", "text", "moment")]
    full = reduce(Column.__or__, some)
    cells = cells.withColumn("cleaned", F.when(is_text, clean_text(F.col("text"))))
    number = F.coalesce(F.col("real"), F.col("whole").cast("double"), F.col("text").try_cast("double"))
    at = (
        F.when(is_text, parse_stripped_timestamp(F.col("cleaned")))
        .when(F.col("kind") == "date_number", epoch_nanos(number))
        .otherwise(F.col("moment"))
    )
    counted = full & (F.col("kind") != "other")
    cells = cells.select(
        *keys, "ordinal", "kind", "cleaned", full.alias("full"), at.alias("at"),
        F.when(counted, F.xxhash64("whole", "real", "text", "moment")).alias("value"),
    ).withColumn("month", F.year("at") * 12 + F.month("at"))
    filled = F.when(is_text, F.col("cleaned").isNotNull()).otherwise(F.col("full"))
    numeric = F.when(is_text, F.col("cleaned").rlike(NUMBER_PATTERN)).otherwise(F.col("full") & F.col("kind").isin("number", "date_number"))
    place = F.pmod("month", F.lit(BITMAP_MONTHS)).cast("long")

    def different(value: Column) -> Column:
        return F.theta_sketch_agg(value, SKETCH)

    parts = cells.groupBy(*keys, "ordinal", "kind", F.floor(F.col("month") / BITMAP_MONTHS).alias("years")).agg(
        F.count("*").alias("n_rows"),
        F.count_if("full").alias("non_null"),
        F.count_if(filled).alias("non_empty"),
        F.count_if(numeric).alias("numeric_ok"),
        F.count("at").alias("date_ok"),
        F.min("at").alias("min_at"),
        F.max("at").alias("max_at"),
        different(F.col("value")).alias("values"),
        different(F.when(is_text & filled, F.col("value"))).alias("filled_values"),
        different(F.when(F.col("cleaned").isNotNull(), F.xxhash64("cleaned"))).alias("cleaned_values"),
        different(F.when(F.col("at").isNotNull(), F.xxhash64("at"))).alias("times"),
        F.bitmap_construct_agg(place * 32 + F.dayofmonth("at")).alias("days"),
        F.bitmap_construct_agg(place).alias("months"),
    )

    def count(sketch: str) -> Column:
        return F.theta_sketch_estimate(F.theta_union_agg(sketch, SKETCH))

    def of_text(sketch: str) -> Column:
        return F.when(F.col("kind") == "text", count(sketch)).otherwise(count("values"))

    return parts.groupBy(*keys, "ordinal", "kind").agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        F.min("min_at").alias("min_at"), F.max("max_at").alias("max_at"),
        count("values").alias("n_distinct"),
        of_text("filled_values").alias("n_distinct_non_empty"),
        of_text("cleaned_values").alias("n_distinct_clean"),
        count("times").alias("n_times"),
        F.sum(F.bitmap_count("days")).alias("n_days"),
        F.sum(F.bitmap_count("months")).alias("n_months"),
    )


def _finished(schema: DataFrame, counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The rows of ``column_stats`` for every column of ``schema`` (ordinal, column_name, norm_name, kind)."""
    rows = schema.join(counts.drop("kind"), [*keys, "ordinal"], "left")
    nested = F.col("kind") == "other"

    def counted(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)

    def distinct(name: str) -> Column:
        return F.when(~nested, F.coalesce(F.col(name), F.lit(0)).cast("long")).alias(name)

    rows = rows.select(
        *keys, "ordinal", "column_name", "norm_name", "kind", *[counted(c) for c in ("n_rows", "non_null", "non_empty")],
        *[distinct(c) for c in ("n_distinct", "n_distinct_non_empty", "n_distinct_clean")],
        counted("numeric_ok"), counted("date_ok"), "min_at", "max_at",
        whole_days(F.col("min_at"), F.col("max_at")).alias("depth_days"), *[counted(c) for c in ("n_times", "n_days", "n_months")],
    )
    return rows.select(*keys, "ordinal", "column_name", "norm_name", C.bucket_of(F.col("kind")).alias("bucket"), *rows.columns[len(keys) + 4 :])


def approximate_column_stats(frame: DataFrame) -> DataFrame:
    """``column_stats`` from one pass; different values and times are estimates beyond ``EXACT``."""
    return _finished(C.schema_frame(frame), sketched(long_cells(frame)))


def undecided() -> Column:
    """Whether an estimate lies near a bound of the rules in ``columns`` and ``intelligence``: shares of
    different values in numeric columns, and in categorical ones that and half of the rows."""
    rows, full, filled = F.col("n_rows"), F.col("non_null"), F.col("non_empty")
    half = F.floor(rows / 2)
    bounds = [
        ("numeric", "n_distinct", full * 0.95), ("numeric", "n_distinct", full * 0.98),
        ("categorical", "n_distinct_non_empty", half), ("categorical", "n_distinct_non_empty", filled * 0.9),
        ("categorical", "n_distinct_clean", half), ("categorical", "n_distinct_clean", filled * 0.95),
    ]
    error = SIGMAS / EXACT**0.5
    near = F.lit(False)
    for bucket, name, place in bounds:
        estimate = F.col(name)
        close = (estimate >= EXACT * (1 - error)) & (F.abs(estimate - place) <= estimate * error + 1)
        near = near | ((F.col("bucket") == bucket) & close)
    return F.coalesce(near, F.lit(False))


def decided_column_stats(frame: DataFrame) -> DataFrame:
    """Statistics on which every rule decides as on exact ones.

    The estimates are written (a row per column); columns that are undecided, and only those, are read
    again and counted exactly.
    """
    estimates = materialise(approximate_column_stats(frame))
    names = [r["ordinal"] for r in estimates.where(undecided()).select("ordinal").collect()]
    if not names:
        return estimates
    fields = frame.schema.fields
    exact = C.column_stats(frame.select(*[quoted(fields[i].name) for i in names]))
    ordinals = F.get(F.array(*[F.lit(i).cast("long") for i in names]), F.col("ordinal").cast("int"))
    return estimates.where(~F.col("ordinal").isin(names)).unionByName(exact.withColumn("ordinal", ordinals))


def stats_of_datasets(frames: dict[str, DataFrame]) -> DataFrame:
    """Estimated statistics of several datasets in one job: the rows of ``column_stats`` with ``dataset``."""
    cells = reduce(DataFrame.unionByName, [long_cells(f, dataset=name) for name, f in frames.items()])
    schema = reduce(
        DataFrame.unionByName, [C.schema_frame(f).select(F.lit(name).alias("dataset"), "*") for name, f in frames.items()]
    )
    return _finished(schema, sketched(cells, ["dataset"]), ["dataset"])


def decided_stats_of_datasets(frames: dict[str, DataFrame]) -> DataFrame:
    """``stats_of_datasets`` on which every rule decides as on exact statistics: only undecided columns
    are read again, and only from the datasets that have any."""
    estimates = materialise(stats_of_datasets(frames))
    again: dict[str, list[int]] = {}
    for row in estimates.where(undecided()).select("dataset", "ordinal").collect():
        again.setdefault(row["dataset"], []).append(row["ordinal"])
    settled = estimates
    for name, places in again.items():
        fields = frames[name].schema.fields
        exact = C.column_stats(frames[name].select(*[quoted(fields[i].name) for i in places]))
        ordinals = F.get(F.array(*[F.lit(i).cast("long") for i in places]), F.col("ordinal").cast("int"))
        settled = settled.where((F.col("dataset") != name) | ~F.col("ordinal").isin(places)).unionByName(
            exact.withColumn("ordinal", ordinals).withColumn("dataset", F.lit(name))
        )
    return settled
