"""Grouped comparison of a metric over a dimension, its summary, trend, margin flags and findings.

Every operator takes ``by``: the same analysis per key, in one job. Raw rows are folded once to
(by, group) totals; all later steps work on those totals or on one row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope import fixed_values as V
from tallyscope.functions.coerce import (
    as_number,
    as_timestamp,
    clean_dimension,
    fixed_text,
    period_start,
    round_exact,
    whole_days,
)
from tallyscope.functions.naming import first_column_with
from tallyscope.operators.shape import (
    attach,
    columns_of,
    exact_quantiles,
    first_rows,
    number_rows,
    numbered_items,
)

# Finding texts, in the order they appear (%s = name or formatted number).
FINDING_TOP = "Top contributor: %s drives %s%% of total %s (%s)."
FINDING_LOWEST = (
    "Lowest-contributing group: %s contributes %s, which is %s below the top group."
)
FINDING_SPREAD = "Performance spread is %s: the top-to-bottom contribution gap is %s."
FINDING_CONCENTRATION = (
    "Contribution concentration is %s: the leading group accounts for %s%% of total %s."
)
FINDING_UNDER = "Underperforming groups: %s are materially below the group average for %s."
FINDING_AVERAGES = (
    "Average contribution per group is %s, while the overall per-row average for %s is %s."
)
FINDING_ALIGNED = (
    "Volume and per-row efficiency align: %s leads both total %s and average value per row."
)
FINDING_SPLIT = (
    "Volume versus efficiency split: %s leads total %s, but %s has the strongest average value"
    " per row."
)
FINDING_MARGIN = (
    "Margin concern: %s show relatively high discount levels while profit remains weak, so"
    " discounting may be eroding value in those segments."
)
FINDING_WEAK_TOTAL = (
    "The selected metric totals %s, so overall performance is weak before any deeper causal"
    " interpretation."
)
FINDING_NO_ROWS = (
    "No diagnostic findings were generated because `%s` and `%s` do not overlap on usable rows."
)
LOWEST_LABEL = "Lowest-Contributing Group"
NOT_AVAILABLE = "N/A"
UNDERPERFORMING_SHARE = 0.6
WEAK_EFFICIENCY_SHARE = 0.75


def _group_totals(
    frame: DataFrame, metric: str, dimension: str, by: Sequence[str], margins: tuple[str, str] | None = None
) -> DataFrame:
    """Sum and count per (by, group), the rows without a group included under a null group; with
    ``margins`` (discount and profit column) their sums over the rows that have both.

    ``grouped`` marks the others. It is an aggregate, so a filter on it stays above the shuffle and
    every use of the totals reads the same shuffle output; a filter on ``group`` would move into
    the scan and make it another one.
    """
    both = F.col("discount").isNotNull() & F.col("profit").isNotNull()
    sums = [] if margins is None else [
        F.sum(F.when(both, F.col("discount"))).cast("double").alias("discounts"),
        F.count_if(both).alias("margin_rows"),
        F.sum(F.when(both, F.col("profit"))).cast("double").alias("profits"),
    ]
    return (
        frame.select(
            *columns_of(by),
            clean_dimension(frame, dimension).alias("group"),
            as_number(frame, metric).alias("metric"),
            *(as_number(frame, name).alias(n) for n, name in zip(("discount", "profit"), margins or ())),
        )
        .groupBy(*columns_of(by), "group")
        .agg(
            F.sum("metric").alias("total"),
            F.count("metric").alias("row_count"),
            F.bool_or(F.col("group").isNotNull()).alias("grouped"),
            *sums,
        )
    )


def _usable(totals: DataFrame) -> DataFrame:
    return totals.where("grouped and row_count > 0").drop("grouped")


def _as_double(name: str) -> Column:
    return F.col(name).cast("double")


def _mean() -> Column:
    return _as_double("total") / F.col("row_count")


def _best_first(value: Column) -> list[Column]:
    return [value.desc(), F.col("group").asc()]


def grouped_comparison(
    frame: DataFrame, metric: str, dimension: str, by: Sequence[str] = ()
) -> DataFrame:
    """Total, row count, mean and share of every group.

    The total is an aggregate of the same group totals: it reads their shuffle output again
    instead of scanning twice, and no window gathers all groups in one task.
    """
    groups = _usable(_group_totals(frame, metric, dimension, by))
    whole = groups.where("row_count > 0").groupBy(*columns_of(by)).agg(
        F.sum("total").alias("__whole")
    )
    share = _as_double("total") / F.nullif(_as_double("__whole"), F.lit(0.0)) * 100
    return attach(groups, whole, by).select(
        *columns_of(by),
        "group",
        _as_double("total").alias("metric_value"),
        "row_count",
        _mean().alias("average_value"),
        F.coalesce(round_exact(share, 2), F.lit(0.0)).alias("share_pct"),
        round_exact(_mean(), 2).alias("efficiency_index"),
    )


def ranked_groups(
    frame: DataFrame, metric: str, dimension: str, by: Sequence[str] = ()
) -> DataFrame:
    """The comparison with a rank from 1, best total first, ties by name."""
    groups = grouped_comparison(frame, metric, dimension, by)
    return number_rows(groups, by, _best_first(F.col("metric_value")), "rank")


def top_groups(
    frame: DataFrame, metric: str, dimension: str, by: Sequence[str] = (), n: int = 5
) -> DataFrame:
    groups = grouped_comparison(frame, metric, dimension, by)
    return first_rows(groups, by, _best_first(F.col("metric_value")), n, "position")


def bottom_groups(
    frame: DataFrame, metric: str, dimension: str, by: Sequence[str] = (), n: int = 5
) -> DataFrame:
    """The lowest totals, lowest first."""
    groups = grouped_comparison(frame, metric, dimension, by)
    order = [F.col("metric_value").asc(), F.col("group").desc()]
    return first_rows(groups, by, order, n, "position")


def spread_class(top: Column, bottom: Column) -> Column:
    ratio = F.try_divide(top, bottom)
    return (
        F.when((bottom <= 0) | (ratio >= 2.5), "wide").when(ratio >= 1.5, "moderate").otherwise("narrow")
    )


def concentration_class(share: Column) -> Column:
    return F.when(share >= 50, "high").when(share >= 30, "moderate").otherwise("low")


def _key_summary(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per key from the group totals: extremes, totals and means in a single fold."""
    usable = F.col("grouped") & (F.col("row_count") > 0)
    fields = {"name": F.col("group"), "value": _as_double("total"), "mean": _mean()}

    def entry(order: Column) -> Column:
        """What a group is compared by, order and name, in front of what is kept of it."""
        return F.when(usable, F.struct(order.alias("__order"), *[c.alias(n) for n, c in fields.items()]))

    def best(order: Column) -> Column:
        return F.min(entry(order))

    def worst(order: Column) -> Column:
        return F.max(entry(order))

    folded = totals.groupBy(*columns_of(by)).agg(
        F.sum(F.when(usable, F.col("total"))).cast("double").alias("whole"),
        F.count_if(usable).alias("group_count"),
        F.sum("total").cast("double").alias("all_rows_total"),
        F.sum("row_count").alias("all_rows"),
        F.avg(F.when(usable, _mean())).alias("mean_of_means"),
        best(-_as_double("total")).alias("top"),
        worst(-_as_double("total")).alias("bottom"),
        best(-_mean()).alias("best_mean"),
        best(_mean()).alias("lowest_mean"),
    )
    folded = folded.withColumns(
        {c: F.col(c).dropFields("__order") for c in ("top", "bottom", "best_mean", "lowest_mean")}
    )
    share = F.col("top.value") / F.nullif(F.col("whole"), F.lit(0.0)) * 100
    return folded.select(
        "*",
        (F.col("whole") / F.nullif(F.col("group_count"), F.lit(0))).alias("mean_group_total"),
        F.coalesce(F.try_divide("all_rows_total", "all_rows"), F.lit(0.0)).alias("row_average"),
        F.coalesce(round_exact(share, 2), F.lit(0.0)).alias("top_share"),
        (F.col("top.value") - F.col("bottom.value")).alias("gap"),
        F.when(F.col("group_count") > 0, spread_class(F.col("top.value"), F.col("bottom.value")))
        .otherwise(NOT_AVAILABLE).alias("spread"),
    ).withColumn(
        "concentration",
        F.when(F.col("group_count") > 0, concentration_class(F.col("top_share"))).otherwise(
            NOT_AVAILABLE
        ),
    )


def diagnostic_summary(
    frame: DataFrame, metric: str, dimension: str, by: Sequence[str] = ()
) -> DataFrame:
    summary = _key_summary(_group_totals(frame, metric, dimension, by), by)

    def or_zero(value: str) -> Column:
        return F.coalesce(F.col(value), F.lit(0.0))

    def or_none(value: str) -> Column:
        return F.coalesce(F.col(value), F.lit(NOT_AVAILABLE))

    return summary.select(
        *columns_of(by),
        or_zero("whole").alias("total_metric_value"),
        "group_count",
        or_none("top.name").alias("top_group"),
        or_zero("top.value").alias("top_group_value"),
        or_none("bottom.name").alias("bottom_group"),
        or_zero("bottom.value").alias("bottom_group_value"),
        or_zero("gap").alias("difference_top_to_bottom"),
        F.lit(LOWEST_LABEL).alias("lowest_group_label"),
        F.col("spread").alias("spread_classification"),
        F.col("concentration").alias("concentration_classification"),
        (F.col("group_count") > 5).alias("show_split_top_bottom"),
        "row_average",
        F.coalesce("mean_group_total", F.lit(0.0)).alias("mean_group_total"),
    )


def underperformers(
    frame: DataFrame, metric: str, dimension: str, by: Sequence[str] = ()
) -> DataFrame:
    """Groups whose total is below 60 % of the mean group total."""
    groups = _usable(_group_totals(frame, metric, dimension, by))
    return _under(groups, by).select(
        *columns_of(by), "group", _as_double("total").alias("metric_value"), "mean_group_total"
    )


def _under(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    mean = groups.where("row_count > 0").groupBy(*columns_of(by)).agg(
        (F.sum("total").cast("double") / F.count("*")).alias("mean_group_total")
    )
    return attach(groups, mean, by).where(
        _as_double("total") < F.col("mean_group_total") * UNDERPERFORMING_SHARE
    )


def efficiency_split(
    frame: DataFrame, metric: str, dimension: str, by: Sequence[str] = ()
) -> DataFrame:
    """Leader by total against leader by mean; only where at least two groups exist."""
    summary = _key_summary(_group_totals(frame, metric, dimension, by), by)
    return summary.where("group_count >= 2").select(
        *columns_of(by),
        F.col("top.name").alias("volume_leader"),
        F.col("best_mean.name").alias("efficiency_leader"),
        F.col("best_mean.mean").alias("efficiency_leader_average"),
        (F.col("top.name") == F.col("best_mean.name")).alias("aligned"),
    )


def margin_columns(frame: DataFrame) -> tuple[str, str] | None:
    """The discount and profit columns, by name, in schema order."""
    discount = first_column_with(frame.columns, V.DISCOUNT_WORDS)
    profit = first_column_with(frame.columns, V.PROFIT_WORDS)
    return (discount, profit) if discount and profit else None


def margin_flags(frame: DataFrame, dimension: str, by: Sequence[str] = ()) -> DataFrame:
    """Groups with a mean discount in the top quarter and a total profit not above the median."""
    discount, profit = margin_columns(frame) or (None, None)
    keys = columns_of(by)
    if discount is None:
        none = F.lit(None).cast("double")
        return frame.limit(0).select(
            *keys, F.lit("").alias("group"), none.alias("average_discount"),
            none.alias("total_profit"), none.alias("discount_cutoff"), none.alias("profit_cutoff"),
        )
    return _flagged(_group_totals(frame, profit, dimension, by, (discount, profit)), by)


def _flagged(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """``margin_flags`` from the totals of all groups."""
    keys = columns_of(by)
    groups = totals.where("grouped and margin_rows > 0").select(
        *keys, "group", (F.col("discounts") / F.col("margin_rows")).alias("average_discount"),
        F.col("profits").alias("total_profit"),
    )
    counted = F.greatest(F.count("average_discount"), F.count("total_profit"))
    if by:  # only keys with several groups have cutoffs to look for
        groups = attach(groups, groups.groupBy(*keys).agg(counted.alias("__groups")), by).where("__groups >= 2")
        groups = groups.drop("__groups")
    measures = F.array(
        F.struct(F.lit(0.75).alias("__cut"), F.col("average_discount").alias("__cut_value")),
        F.struct(F.lit(0.5).alias("__cut"), F.col("total_profit").alias("__cut_value")),
    )
    values = groups.select(*keys, F.inline(measures))
    quantiles = exact_quantiles(values, [*by, "__cut"], "__cut_value", "__cut", "__cutoff")
    cutoffs = quantiles.groupBy(*keys).agg(
        F.max(F.when(F.col("__cut") == 0.75, F.col("__cutoff"))).alias("discount_cutoff"),
        F.max(F.when(F.col("__cut") == 0.5, F.col("__cutoff"))).alias("profit_cutoff"),
        F.max("__cutoff_count").alias("__groups"),
    )
    return (
        attach(groups, cutoffs, by)
        .where(
            (F.col("__groups") >= 2)
            & (F.col("average_discount") >= F.col("discount_cutoff"))
            & (F.col("total_profit") <= F.col("profit_cutoff"))
        )
        .drop("__groups")
    )


# --- trend ---------------------------------------------------------------------------------


def _dated_totals(
    frame: DataFrame, metric: str, date: str, dimension: str | None, by: Sequence[str]
) -> DataFrame:
    """Totals per day (and group); the grain is chosen later, so raw rows are read once."""
    group = [] if dimension is None else [clean_dimension(frame, dimension).alias("group")]
    keys = [*columns_of(by), F.col("day"), *([F.col("group")] if group else [])]
    return (
        frame.select(
            *columns_of(by),
            as_number(frame, metric).alias("metric"),
            as_timestamp(frame, date).alias("at"),
            *group,
        )
        .dropna(subset=["metric", "at"])
        .withColumn("day", F.col("at").cast("date"))
        .groupBy(*keys)
        .agg(
            F.sum("metric").alias("total"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
            *([F.bool_or(F.col("group").isNotNull()).alias("grouped")] if group else []),
        )
    )


def _grain(depth: Column) -> Column:
    return F.when(depth >= 180, "M").when(depth >= 60, "W").otherwise("D")


def _period() -> Column:
    return period_start(F.col("day"), F.col("frequency")).cast("timestamp_ntz")


def trend_summary(frame: DataFrame, metric: str, date: str, by: Sequence[str] = ()) -> DataFrame:
    """Total per period; the grain follows the time covered. Rows without a group count too.

    The window sees one row per day of a series, so its size is bounded by the calendar.
    """
    series = Window.partitionBy(*columns_of(by))
    days = _dated_totals(frame, metric, date, None, by)
    depth = whole_days(F.min("first_at").over(series), F.max("last_at").over(series))
    return (
        days.withColumn("frequency", _grain(depth))
        .withColumn("period", _period())
        .groupBy(*columns_of(by), "frequency", "period")
        .agg(F.sum("total").cast("double").alias("metric_value"))
    )


def trend_by_dimension(
    frame: DataFrame, metric: str, dimension: str, date: str, by: Sequence[str] = (),
    most_groups: int = V.MAX_TREND_GROUPS,
) -> DataFrame:
    """Total per period and group, only where there are two to ``most_groups`` groups."""
    # each condition holds for every row; it makes both uses read the same shuffle output
    cells = _dated_totals(frame, metric, date, dimension, by).where(
        "last_at >= first_at and (total > 0 or not total > 0)"
    )
    facts = cells.groupBy(*columns_of(by)).agg(
        whole_days(F.min("first_at"), F.max("last_at")).alias("__depth"),
        F.count_distinct(F.when(F.col("grouped"), F.col("group"))).alias("__groups"),
    )
    return (
        attach(cells, facts, by)
        .where(F.col("grouped") & F.col("__groups").between(2, most_groups))
        .withColumn("frequency", _grain(F.col("__depth")))
        .withColumn("period", _period())
        .groupBy(*columns_of(by), "frequency", "period", "group")
        .agg(F.sum("total").cast("double").alias("metric_value"))
    )


# --- facts and findings --------------------------------------------------------------------


def diagnostic_facts(
    frame: DataFrame, metric: str, dimension: str, by: Sequence[str] = (),
    weak_named: int = 5, margin_named: int = 3,
) -> DataFrame:
    """One row per key with everything the findings and the rules need.

    ``weak_named`` and ``margin_named`` say how many groups a sentence names; ``underperformers`` and
    ``margin_flags`` return all of them.
    """
    margins = margin_columns(frame)
    totals = _group_totals(frame, metric, dimension, by, margins)
    return facts_of_totals(totals, metric, dimension, by, margins is not None, weak_named, margin_named)


def facts_of_totals(
    totals: DataFrame, metric: str, dimension: str, by: Sequence[str], margins: bool,
    weak_named: int | None = 5, margin_named: int | None = 3,
) -> DataFrame:
    """``diagnostic_facts`` from the totals of all groups; ``margins`` says whether they carry margin sums."""
    return with_findings(key_facts(totals, by, margins, weak_named, margin_named), metric, dimension)


def key_facts(
    totals: DataFrame, by: Sequence[str], margins: bool, weak_named: int | None = 5, margin_named: int | None = 3
) -> DataFrame:
    """The facts without their texts: narrow rows, for joins."""
    facts = _key_summary(totals, by)
    order = [F.col("total").desc(), F.col("group").asc()]
    weak = first_rows(_under(_usable(totals), by), by, order, weak_named, "__place")
    names = F.transform(
        F.array_sort(F.collect_list(F.struct("__place", "group"))), lambda r: r["group"]
    )
    facts = attach(facts, weak.groupBy(*columns_of(by)).agg(names.alias("weak_groups")), by)
    if not margins:
        facts = facts.withColumn("margin_groups", F.lit(None).cast("array<string>"))
    else:
        flagged = first_rows(_flagged(totals, by), by, [F.col("group").asc()], margin_named, "__place")
        facts = attach(
            facts, flagged.groupBy(*columns_of(by)).agg(names.alias("margin_groups")), by
        )
    empty = F.array().cast("array<string>")
    return facts.withColumns({"weak_groups": F.coalesce("weak_groups", empty), "margin_groups": F.coalesce("margin_groups", empty)})


def with_findings(facts: DataFrame, metric: str, dimension: str) -> DataFrame:
    """``key_facts`` with the chosen columns and the finding texts."""
    facts = facts.withColumns({"metric": F.lit(metric), "dimension": F.lit(dimension)})
    return facts.withColumn("findings", _finding_texts())


def margin_text() -> Column:
    return F.when(
        F.size("margin_groups") > 0,
        F.format_string(FINDING_MARGIN, F.array_join("margin_groups", ", ")),
    )


def _finding_texts() -> Column:
    text, metric = F.format_string, F.col("metric")
    top, bottom = F.col("top.name"), F.col("bottom.name")
    share, gap = fixed_text(F.col("top_share"), 1), fixed_text(F.col("gap"), 2)
    present = [
        text(FINDING_TOP, top, share, metric, fixed_text(F.col("top.value"), 2)),
        text(FINDING_LOWEST, bottom, fixed_text(F.col("bottom.value"), 2), gap),
        text(FINDING_SPREAD, F.col("spread"), gap),
        text(FINDING_CONCENTRATION, F.col("concentration"), share, metric),
        F.when(
            F.size("weak_groups") > 0,
            text(FINDING_UNDER, F.array_join("weak_groups", ", "), metric),
        ),
        text(
            FINDING_AVERAGES, fixed_text(F.col("mean_group_total"), 2), metric,
            fixed_text(F.col("row_average"), 2),
        ),
        F.when(
            F.col("group_count") >= 2,
            F.when(top == F.col("best_mean.name"), text(FINDING_ALIGNED, top, metric)).otherwise(
                text(FINDING_SPLIT, top, metric, F.col("best_mean.name"))
            ),
        ),
        margin_text(),
        F.when(F.col("whole") <= 0, text(FINDING_WEAK_TOTAL, fixed_text(F.col("whole"), 2))),
    ]
    absent = F.array(text(FINDING_NO_ROWS, metric, F.col("dimension")))
    return F.when(F.col("group_count") > 0, F.array_compact(F.array(*present))).otherwise(absent)


def diagnostic_findings(
    frame: DataFrame, metric: str, dimension: str, by: Sequence[str] = ()
) -> DataFrame:
    facts = diagnostic_facts(frame, metric, dimension, by)
    return numbered_items(facts, by, "findings", "finding_order", "finding")
