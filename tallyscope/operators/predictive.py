"""Short-horizon projection of a metric over time, with validation, volatility and findings.

Raw rows are folded once to totals per (by, day). A series is bounded by the calendar, so windows
over one series see at most one row per day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyscope import fixed_values as V
from tallyscope.functions.coerce import (
    as_number,
    as_timestamp,
    fixed_text,
    percent_text,
    period_start,
    ratio,
    round_exact,
    whole_days,
)
from tallyscope.operators.shape import columns_of, numbered_items

# Message texts.
MESSAGE_PARSE = (
    "Datetime parse success is %s, which is below the 80%% threshold for trustworthy forecasting."
)
MESSAGE_METRIC = (
    "The selected metric only has %s usable numeric values, so aggregation is not reliable enough."
)
MESSAGE_PERIODS = (
    "Only %d unique time periods are available after aggregation, which is below the minimum of 6."
)
MESSAGE_OBSERVATIONS = (
    "Only %d aggregated observations are available, so the series is too short for a cautious"
    " forecast."
)
MESSAGE_HORIZON = (
    "The requested forecast horizon is too long relative to the available history, so the"
    " projection would not be trustworthy."
)
MESSAGE_NO_ROWS = "No rows contain both a valid datetime value and a numeric forecast metric."
FINDING_DIRECTION = (
    "Short-term direction is %s: the first forecasted period is %s, the latest actual value is"
    " %s, and the recent actual average is %s."
)
FINDING_AVERAGE = (
    "The projected average across the forecast horizon is %s, compared with the latest actual"
    " value of %s."
)
FINDING_VOLATILITY = "Recent series behavior appears %s because %s."
FINDING_CONDITIONAL = (
    "Forecasting is being shown cautiously because predictive readiness is Conditional, so the"
    " projection should be treated as directional rather than definitive."
)
FINDING_SHORT = (
    "Caution: only %d historical periods were available, so the forecast is based on limited time"
    " depth."
)
FINDING_PARSE = (
    "Caution: datetime parsing succeeded on %s of rows, so a small portion of the source data was"
    " excluded from the forecast."
)
FINDING_BLOCKED = (
    "Forecasting was not forced because the selected data does not provide a sufficiently strong"
    " time-series basis."
)
REASON_TOO_FEW = "there are too few period-over-period changes to show meaningful instability"
REASON_VOLATILE = (
    "the last %d historical periods show high variance relative to the series mean, with a"
    " volatility ratio of %s"
)
REASON_VARIABLE = (
    "the last %d historical periods show moderate variance relative to the series mean, with a"
    " volatility ratio of %s"
)
REASON_STABLE = (
    "the last %d historical periods remain relatively close to the series mean, with a volatility"
    " ratio of %s"
)
STATUS_CAUTIOUS = "Forecasting is enabled cautiously."
STATUS_ENABLED = "Forecasting is enabled."
STATUS_DETAIL = "%s Using %s aggregation across %d historical periods."
STATUS_BLOCKED = (
    "Forecasting is blocked because the selected time-series inputs do not meet the minimum"
    " validation rules."
)
READY_PARSE = "%s datetime parse success"
READY_PERIODS = "%d historical periods available"
READY_GRAIN = "%s aggregation selected"
READY_STATUS = "Predictive readiness status is %s"
VOLATILE, VARIABLE, STABLE = "volatile", "moderately variable", "stable"
UP, DOWN, FLAT, BLOCKED = "Up", "Down", "Flat", "Blocked"


def _daily(frame: DataFrame, metric: str, date: str, by: Sequence[str]) -> DataFrame:
    """Totals and row counts per day; rows without a readable date fall under a null day."""
    at = as_timestamp(frame, date)
    return (
        frame.select(*columns_of(by), as_number(frame, metric).alias("metric"), at.alias("at"))
        .withColumn("day", F.col("at").cast("date"))
        .groupBy(*columns_of(by), "day")
        .agg(
            F.sum("metric").alias("total"),
            F.count("metric").alias("metric_rows"),
            F.count("*").alias("n_rows"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
        )
    )


def _periods(days: DataFrame, by: Sequence[str], grain: str, drop_partial: bool) -> DataFrame:
    """Totals per period with the facts of the series on every row.

    Days without a usable value fall under a null period, so that a series with nothing usable
    still has a row. After the fold to days everything is partitioned by ``by`` only: one shuffle
    serves the windows, the fold to periods and the fold to one row per series.
    """
    series = Window.partitionBy(*columns_of(by))
    dated = F.when(F.col("day").isNotNull(), F.col("n_rows")).otherwise(0)
    rows = F.sum("n_rows").over(series)
    days = days.select(
        *columns_of(by), "day", "total", "metric_rows",
        ratio(F.sum(dated).over(series), rows).alias("parse_rate"),
        ratio(F.sum("metric_rows").over(series), rows).alias("metric_ratio"),
        whole_days(F.min("first_at").over(series), F.max("last_at").over(series)).alias("depth"),
    )
    if grain in V.GRAIN_CODES:
        code = F.lit(V.GRAIN_CODES[grain])
    else:
        code = F.when(F.col("depth") >= 365, "M").when(F.col("depth") >= 90, "W").otherwise("D")
    start = F.when(F.col("metric_rows") > 0, period_start(F.col("day"), F.col("grain")))
    periods = (
        days.withColumn("grain", code)
        .withColumn("start", start)
        .groupBy(*columns_of(by), "parse_rate", "metric_ratio", "grain", "start")
        .agg(F.sum("total").cast("double").alias("total"))
        .withColumn("metric_value", F.when(F.col("start").isNotNull(), F.col("total")))
        .drop("total")
    )
    if drop_partial:
        periods = periods.withColumn("__last", F.max("start").over(series)).where(
            "start is null or start < __last"
        ).drop("__last")
    return periods


def forecast_history(
    frame: DataFrame, metric: str, date: str, by: Sequence[str] = (), grain: str = "Auto",
    drop_partial: bool = False,
) -> DataFrame:
    """Total per present period. ``drop_partial`` leaves out the last, usually unfinished, one."""
    periods = _periods(_daily(frame, metric, date, by), by, grain, drop_partial)
    return periods.where("start is not null").select(
        *columns_of(by), "grain", F.col("start").cast("timestamp_ntz").alias("period"), "metric_value"
    )


def direction_class(reference: Column, compared: Column) -> Column:
    difference = compared - reference
    flat = F.abs(difference) <= F.greatest(F.abs(reference) * 0.02, F.lit(1.0))
    return F.when(flat, FLAT).when(difference > 0, UP).otherwise(DOWN)


def _series(periods: DataFrame, by: Sequence[str], keep_history: bool) -> DataFrame:
    """One row per series: its facts, length, minimum and the statistics of its last periods."""
    series = Window.partitionBy(*columns_of(by))
    latest = series.orderBy(F.col("start").desc_nulls_last())
    change = F.try_divide(F.col("metric_value"), F.lead("metric_value").over(latest)) - 1
    rows = periods.select(
        "*",
        F.row_number().over(latest).alias("back"),
        change.alias("change"),
        F.count("start").over(series).alias("periods"),
        F.min("metric_value").over(series).alias("lowest"),
    )
    history = []
    if keep_history:  # a series has at most one entry per day
        entry = F.struct(F.col("start").cast("timestamp_ntz").alias("period"), "metric_value")
        history = [
            F.array_sort(F.collect_list(F.when(F.col("start").isNotNull(), entry))).alias("history")
        ]
    else:
        rows = rows.where("back <= 6")

    def last(n: int) -> Column:
        return F.when(F.col("back") <= n, F.col("metric_value"))

    def finite(value: Column) -> Column:
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)

    # doubles are added oldest first, so that an average doesn't depend on the way they arrive
    place = F.struct((-F.col("back")).alias("place"), F.col("metric_value").cast("double").alias("value"))
    newest = F.array_sort(F.collect_list(F.when(F.col("back") <= 6, place)))

    def average(n: int) -> Column:
        chosen = F.filter("newest", lambda x: (x["place"] >= -n) & x["value"].isNotNull())
        total = F.aggregate(chosen, F.lit(0.0), lambda done, x: done + x["value"])
        return F.try_divide(total, F.size(chosen))

    changes = F.when(F.col("back") <= 5, finite(F.col("change")))
    recent = rows.groupBy(*columns_of(by)).agg(
        F.coalesce(F.max("parse_rate"), F.lit(0.0)).alias("parse_rate"),
        F.coalesce(F.max("metric_ratio"), F.lit(0.0)).alias("metric_ratio"),
        F.coalesce(F.max("grain"), F.lit("D")).alias("grain"),
        F.coalesce(F.max("periods"), F.lit(0)).alias("periods"),
        F.min("lowest").alias("lowest"),
        F.max("start").alias("last_start"),
        F.max(last(1)).alias("latest"),
        newest.alias("newest"),
        F.coalesce(F.regr_slope(last(5), -F.col("back")), F.lit(0.0)).alias("slope"),
        F.count(last(6)).alias("recent_periods"),
        F.count(changes).alias("change_count"),
        F.stddev_samp(changes).alias("volatility_score"),
        F.coalesce(
            F.try_divide(F.stddev_samp(last(6)), F.abs(F.avg(last(6)))), F.lit(0.0)
        ).alias("relative_std"),
        *history,
    )
    return recent.withColumns({"moving_average": average(5), "recent_average": average(4)}).drop("newest")


def _with_volatility(state: DataFrame) -> DataFrame:
    label = (
        F.when(F.col("volatility_score") >= V.VOLATILE_FROM, VOLATILE)
        .when(F.col("volatility_score") >= V.VARIABLE_FROM, VARIABLE)
        .otherwise(STABLE)
    )
    ratio_text = fixed_text(F.col("relative_std"), 2)
    reason = (
        F.when(F.col("change_count") == 0, REASON_TOO_FEW)
        .when(label == VOLATILE, F.format_string(REASON_VOLATILE, F.col("recent_periods"), ratio_text))
        .when(label == VARIABLE, F.format_string(REASON_VARIABLE, F.col("recent_periods"), ratio_text))
        .otherwise(F.format_string(REASON_STABLE, F.col("recent_periods"), ratio_text))
    )
    return state.withColumns({"volatility": label, "volatility_reason": reason})


def _messages(horizon: int) -> Column:
    """What blocks a forecast, in order; an empty list means it may run."""
    periods = F.col("periods")
    checks = [
        F.when(
            F.col("parse_rate") < V.FORECAST_PARSE_RATE,
            F.format_string(MESSAGE_PARSE, percent_text(F.col("parse_rate"))),
        ),
        F.when(
            F.col("metric_ratio") < V.COMPLETENESS,
            F.format_string(MESSAGE_METRIC, percent_text(F.col("metric_ratio"))),
        ),
        F.when(periods < V.FORECAST_MIN_PERIODS, F.format_string(MESSAGE_PERIODS, periods)),
        F.when(periods < V.FORECAST_MIN_PERIODS, F.format_string(MESSAGE_OBSERVATIONS, periods)),
        F.when(
            F.lit(horizon) > F.greatest(F.lit(3), F.floor(periods / 2)), F.lit(MESSAGE_HORIZON)
        ),
    ]
    return F.when(periods == 0, F.array(F.lit(MESSAGE_NO_ROWS))).otherwise(
        F.array_compact(F.array(*checks))
    )


def _points(horizon: int) -> Column:
    """The projected periods of a series as an array, a closed form of its last values."""

    def point(step: Column) -> Column:
        trend = F.col("latest") + F.col("slope") * step
        blended = F.col("moving_average") * V.MOVING_AVERAGE_WEIGHT + trend * V.TREND_WEIGHT
        floored = F.when(F.col("lowest") >= 0, F.greatest(blended, F.lit(0.0))).otherwise(blended)
        start = (
            F.when(F.col("grain") == "M", F.add_months("last_start", step))
            .when(F.col("grain") == "W", F.date_add("last_start", step * 7))
            .otherwise(F.date_add("last_start", step))
        )
        return F.struct(
            step.cast("long").alias("step"),
            start.cast("timestamp_ntz").alias("period"),
            round_exact(floored, 2).alias("value"),
        )

    return F.transform(F.sequence(F.lit(1), F.lit(horizon)), point)


def forecast(
    frame: DataFrame,
    metric: str,
    date: str,
    by: Sequence[str] = (),
    grain: str = "Auto",
    horizon: int = 6,
    readiness_status: str = V.READY,
    readiness_reason: str = "",
    drop_partial: bool = False,
    keep_history: bool = False,
    days: DataFrame | None = None,
) -> DataFrame:
    """One row per key: status, messages, projected points, cards and findings.

    The other functions of this module are projections of this row, for any number of series. ``days``
    are daily totals that are there already (``fold.daily_totals``); ``frame`` is not read then.
    """
    days = _daily(frame, metric, date, by) if days is None else days
    state = series_facts(days, by, grain, drop_partial, keep_history)
    return described(state, metric, date, horizon, readiness_status, readiness_reason)


def series_facts(
    days: DataFrame, by: Sequence[str] = (), grain: str = "Auto", drop_partial: bool = False, keep_history: bool = False
) -> DataFrame:
    """One row per key with the numbers of its series, from daily totals: narrow rows, for joins."""
    return _series(_periods(days, by, grain, drop_partial), by, keep_history)


def described(
    state: DataFrame, metric: str, date: str, horizon: int = 6, readiness_status: str = V.READY, readiness_reason: str = ""
) -> DataFrame:
    """``series_facts`` with all that follows from them within the row: points, status and texts."""
    state = _with_volatility(state).withColumn("horizon", F.lit(horizon).cast("long")).withColumn(
        "messages", _messages(horizon)
    )
    usable = F.size("messages") == 0
    state = state.withColumns(
        {
            "status": F.when(~usable, V.NOT_READY).otherwise(
                V.READY if readiness_status == V.READY else V.CONDITIONAL
            ),
            "points": F.when(usable, _points(horizon)).otherwise(
                F.filter(_points(1), lambda p: F.lit(False))
            ),
            "metric": F.lit(metric),
            "date": F.lit(date),
        }
    )
    total = F.aggregate("points", F.lit(0.0), lambda a, p: a + p["value"])
    state = state.withColumns(
        {
            "latest_value": F.coalesce("latest", F.lit(0.0)),
            "first_value": F.coalesce(F.get("points", F.lit(0))["value"], F.lit(0.0)),
            "mean_value": F.coalesce(F.try_divide(total, F.size("points")), F.lit(0.0)),
        }
    ).withColumn(
        "direction",
        F.when(usable, direction_class(F.col("latest"), F.col("first_value"))).otherwise(BLOCKED),
    )
    grain_label = F.when(F.col("grain") == "M", "Monthly").when(F.col("grain") == "W", "Weekly").otherwise("Daily")
    state = state.withColumn("grain_label", grain_label)
    prefix = STATUS_CAUTIOUS if readiness_status == V.CONDITIONAL else STATUS_ENABLED
    reason = readiness_reason.rstrip(".")
    ready_reasons = F.array_compact(
        F.array(
            F.format_string(READY_PARSE, percent_text(F.col("parse_rate"))),
            F.format_string(READY_PERIODS, F.col("periods")),
            F.format_string(READY_GRAIN, F.col("grain_label")),
            F.lit(READY_STATUS % readiness_status.lower()),
            F.lit(reason if readiness_reason else None).cast("string"),
        )
    )
    return state.withColumns(
        {
            "status_reason": F.when(
                usable,
                F.format_string(
                    STATUS_DETAIL, F.lit(prefix), F.lower("grain_label"), F.col("periods")
                ),
            ).otherwise(STATUS_BLOCKED),
            "readiness_reasons": F.concat(ready_reasons, F.col("messages")),
            "findings": F.when(usable, _findings(readiness_status)).otherwise(
                F.array(F.lit(FINDING_BLOCKED))
            ),
        }
    )


def volatility_text() -> Column:
    return F.format_string(FINDING_VOLATILITY, F.col("volatility"), F.col("volatility_reason"))


def _findings(readiness_status: str) -> Column:
    text, latest = F.format_string, fixed_text(F.col("latest_value"), 2)
    return F.array_compact(
        F.array(
            text(
                FINDING_DIRECTION, F.lower("direction"), fixed_text(F.col("first_value"), 2), latest,
                fixed_text(F.col("recent_average"), 2),
            ),
            text(FINDING_AVERAGE, fixed_text(F.col("mean_value"), 2), latest),
            volatility_text(),
            F.lit(FINDING_CONDITIONAL if readiness_status == V.CONDITIONAL else None).cast("string"),
            F.when(F.col("periods") < 9, text(FINDING_SHORT, F.col("periods"))),
            F.when(F.col("parse_rate") < 0.95, text(FINDING_PARSE, percent_text(F.col("parse_rate")))),
        )
    )


# --- projections of the forecast row -------------------------------------------------------


def forecast_projection(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = state.select(*columns_of(by), F.inline_outer("points")).where("step is not null")
    return rows.select(
        *columns_of(by), "step", "period", F.date_format("period", "yyyy-MM-dd").alias("label"),
        F.col("value").alias("metric_value"),
    )


def forecast_cards(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return state.select(
        *columns_of(by),
        "status",
        F.col("periods").alias("historical_periods_used"),
        F.col("horizon").alias("forecast_horizon"),
        F.col("latest_value").alias("latest_actual_value"),
        F.col("first_value").alias("first_forecast_value"),
        F.col("mean_value").alias("projected_average_forecast_value"),
        F.col("direction").alias("projected_direction"),
    )


def forecast_inputs(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return state.select(
        *columns_of(by),
        F.col("metric").alias("metric_column"),
        F.col("date").alias("datetime_column"),
        F.col("grain").alias("aggregation_grain"),
        F.col("grain_label").alias("aggregation_grain_label"),
        F.col("horizon").alias("forecast_horizon"),
        F.col("parse_rate").alias("datetime_parse_success_rate"),
        F.col("metric_ratio").alias("metric_valid_ratio"),
        F.col("periods").alias("historical_periods"),
        F.lit(V.FORECAST_METHOD).alias("forecast_method_label"),
    )


def forecast_volatility(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return state.select(
        *columns_of(by),
        F.coalesce("recent_periods", F.lit(0)).alias("recent_periods"),
        "volatility_score", "relative_std",
        F.coalesce("volatility", F.lit(STABLE)).alias("volatility"),
    )


def forecast_validation(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return numbered_items(state, by, "messages", "message_order", "message")


def forecast_findings(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return numbered_items(state, by, "findings", "finding_order", "finding")


def forecast_reasons(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return numbered_items(state, by, "readiness_reasons", "reason_order", "reason")


def forecast_chart(state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """History and projection below each other, labelled; needs a state with its history."""

    def labelled(array: str, value: str, label: str) -> Column:
        return F.transform(
            array,
            lambda e: F.struct(
                e["period"].alias("period"), e[value].alias("metric_value"),
                F.lit(label).alias("series_type"),
            ),
        )

    rows = F.concat(
        labelled("history", "metric_value", "Actual"), labelled("points", "value", "Forecast")
    )
    return state.select(*columns_of(by), F.inline_outer(rows)).where("period is not null")
