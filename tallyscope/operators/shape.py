"""Helpers that combine a frame with facts about the same frame, per key, without cross joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope.functions.naming import quoted
from tallyscope.session import checkpointed

BRACKET_MISSED = "the sketch missed the quantile; raise the accuracy. Values of the key: "


def columns_of(by: Sequence[str]) -> list[Column]:
    return [quoted(name) for name in by]


KEY = "__key"


def one_key(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    """The keys as one struct, the column ``KEY``: never null itself, and equal where null fields meet."""
    key = F.struct(*[quoted(c).alias(f"k{i}") for i, c in enumerate(by)]).alias(KEY)
    return frame.select(key, *[quoted(c) for c in frame.columns if c not in by])


def own_keys(frame: DataFrame, by: Sequence[str]) -> DataFrame:
    """The inverse of ``one_key``."""
    keys = [F.col(KEY)[f"k{i}"].alias(c) for i, c in enumerate(by)]
    return frame.select(*keys, *[quoted(c) for c in frame.columns if c != KEY])


def attach(frame: DataFrame, facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the columns of ``facts`` (one row per key) to every row of ``frame``.

    Without keys ``facts`` is one row and becomes a scalar subquery, evaluated once. With keys it
    is an equi-join (null keys match), so a hot key is split by the adaptive skew join. ``facts``
    is usually an aggregate of ``frame``; both then read the same shuffle output. Keys that can't be null
    (``one_key``) are compared plainly: the join then keeps the partitions of aggregates and windows over them.
    """
    added = [c for c in facts.columns if c not in by]
    if not by:
        one = facts.select(F.struct(*[quoted(c) for c in added])).scalar()
        return frame.withColumn("__facts", one).select(
            *[quoted(c) for c in frame.columns], *[F.col("__facts")[c].alias(c) for c in added]
        )
    right = facts.select(
        *[quoted(c).alias(f"__key{i}") for i, c in enumerate(by)], *[quoted(c) for c in added]
    )
    condition = None
    for i, c in enumerate(by):
        known = not (frame.schema[c].nullable or facts.schema[c].nullable)
        same = quoted(c) == F.col(f"__key{i}") if known else quoted(c).eqNullSafe(F.col(f"__key{i}"))
        condition = same if condition is None else condition & same
    return frame.join(right, condition, "left").drop(*[f"__key{i}" for i in range(len(by))])


def first_rows(
    frame: DataFrame, by: Sequence[str], order: Sequence[Column], n: int | None, position: str
) -> DataFrame:
    """The first ``n`` rows per key, numbered from 1; all of them for None.

    Each task keeps at most ``n`` rows per key before anything is shuffled (take-ordered without
    keys, window group limit with keys), so neither a hot key nor an empty key list makes one task
    see a whole group.
    """
    if n is None:
        return number_rows(frame, by, order, position)
    if not by:
        frame = frame.orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy(*columns_of(by)).orderBy(*order))
    return frame.withColumn(position, rank.cast("long")).where(F.col(position) <= n)


def number_rows(
    frame: DataFrame, by: Sequence[str], order: Sequence[Column], position: str
) -> DataFrame:
    """Number all rows per key from 1 in the given order, with no task holding a whole key.

    A global range sort is written once; a row's number is its place in its sorted slice plus the
    sizes of the slices before it (one row per slice), minus the start of its key.
    """
    slices = checkpointed(frame.orderBy(*columns_of(by), *order))
    placed = slices.select(
        "*",
        F.spark_partition_id().alias("__slice"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("__place"),
    )
    sizes = placed.groupBy("__slice").agg(F.count("*").alias("__size"))
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "__slice", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start")
    )
    # bounded by the number of sort partitions
    numbered = placed.join(F.broadcast(starts), "__slice").withColumn(
        "__global", F.col("__start") + F.col("__place")
    )
    if by:
        first = numbered.groupBy(*columns_of(by)).agg(F.min("__global").alias("__first"))
        numbered = attach(numbered, first, by)
    else:
        numbered = numbered.withColumn("__first", F.lit(0))
    return numbered.select(
        *[quoted(c) for c in frame.columns],
        (F.col("__global") - F.col("__first") + 1).cast("long").alias(position),
    )


def _bracket(keys: list[Column], frame: DataFrame, value: str, share: str, accuracy: int) -> DataFrame:
    """Per key: rows, wanted rank from 0, and two values that should enclose the rank."""
    margin = 3 / accuracy
    shares = (0.25, 0.5, 0.75)
    ends = [x for s in shares for x in (s - margin, s + margin)]
    sketch = frame.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.first(share).alias("__share"), F.min(value).alias("__min"),
        F.max(value).alias("__max"), F.percentile_approx(value, ends, accuracy).alias("__ends"),
    )
    at = F.when(F.col("__share") == shares[0], 0).when(F.col("__share") == shares[1], 2).otherwise(4)
    large = F.col("__n") > accuracy
    return sketch.select(
        *keys, "__n", (F.col("__share") * (F.col("__n") - 1)).alias("__rank"),
        F.when(large, F.get("__ends", at)).otherwise(F.col("__min")).alias("__low"),
        F.when(large, F.get("__ends", at + 1)).otherwise(F.col("__max")).alias("__high"),
    )


def exact_quantiles(
    frame: DataFrame, by: Sequence[str], value: str, share: str, result: str, accuracy: int = 10_000
) -> DataFrame:
    """One row per key: ``result`` is the exact quantile of the doubles in ``value``, linear between
    neighbours, and ``result`` + "_count" their number.

    ``share`` is a column that is constant within a key, one of 0.25, 0.5 and 0.75. A mergeable sketch
    brackets the rank first: its ranks are at most 1/accuracy of the rows wrong, so bounds 3/accuracy
    away from the share enclose it wherever a key has more than ``accuracy`` rows; smaller keys are their
    own bracket. Values below the bracket are only counted, and the window sees the different values
    inside it: at most ``accuracy`` of a small key, and of a large one a few in ``accuracy``.

    The bracket is proven by its counts: no more values than the rank says may lie below it, and as many
    below and inside it. Should a sketch miss, the query fails and says so; it never returns a neighbour.
    """
    keys, values = columns_of(by), frame.where(F.col(value).isNotNull())
    placed = attach(values, _bracket(keys, values, value, share, accuracy), by)
    # all values below the bracket are one row to count, and all above it
    side = F.when(F.col(value) < F.col("__low"), -1).when(F.col(value) > F.col("__high"), 1).otherwise(0)
    counts = (
        placed.withColumn("__side", side)
        .groupBy(*keys, "__side", F.when(F.col("__side") == 0, F.col(value)).alias("__value"))
        .agg(F.count("*").alias("__count"), F.first("__rank").alias("__rank"), F.first("__n").alias("__n"))
    )
    up_to = Window.partitionBy(*keys).orderBy("__side", "__value")
    reached = F.sum("__count").over(up_to.rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("__reached", reached)

    def first_beyond(place: Column) -> Column:
        return F.min(F.when(F.col("__reached") > place, F.struct("__side", "__value")))

    found = counts.groupBy(*keys).agg(
        F.first("__rank").alias("__rank"),
        F.first("__n").alias("__n"),
        first_beyond(F.floor("__rank")).alias("__lower"),
        first_beyond(F.ceil("__rank")).alias("__upper"),
    )
    missed = F.raise_error(F.concat(F.lit(BRACKET_MISSED), F.col("__n"))).cast("double")

    def proven(neighbour: str) -> Column:
        return F.when(F.col(neighbour)["__side"] == 0, F.col(neighbour)["__value"]).otherwise(missed)

    weight = F.col("__rank") - F.floor("__rank")
    between = F.when(weight == 0, proven("__lower")).otherwise(
        (1 - weight) * proven("__lower") + weight * proven("__upper")
    )
    return found.select(*keys, between.alias(result), F.col("__n").alias(f"{result}_count"))


def numbered_items(
    frame: DataFrame, by: Sequence[str], array: str | Column, position: str, item: str
) -> DataFrame:
    """Array elements as rows numbered from 1.

    The outer form is deliberate: for the inner one the optimizer adds a size filter below the
    explode and repeats the expressions behind the array in it.
    """
    return (
        frame.select(*columns_of(by), F.posexplode_outer(array).alias("__i", item))
        .where(F.col(item).isNotNull())
        .select(*columns_of(by), (F.col("__i") + 1).cast("long").alias(position), item)
    )
