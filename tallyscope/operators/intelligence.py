"""Dataset intelligence: signals, dataset type, supporting evidence and readiness per layer.

``dataset_facts`` folds the column statistics (one row per column) into one row; everything else
in this module is a projection of that row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope import fixed_values as V
from tallyscope.functions.coerce import percent_text, ratio
from tallyscope.functions.naming import has_word
from tallyscope.operators import columns as C
from tallyscope.operators.shape import columns_of

# Reason texts and signal labels (%s = text, %d = whole number).
DESCRIPTIVE_READY = (
    "The dataset is valid tabular data with %d rows and %d columns, so descriptive summaries and"
    " KPI reporting can be trusted."
)
DESCRIPTIVE_BLOCKED = (
    "The dataset is not yet a valid tabular structure, so descriptive analysis should stay blocked."
)
DIAGNOSTIC_INVALID = (
    "Diagnostic analysis is blocked because the dataset is not yet a valid tabular input."
)
DIAGNOSTIC_READY = (
    "The dataset has %d measurable field(s) and %d usable dimension(s), which supports"
    " slice-and-compare diagnostics."
)
DIAGNOSTIC_NO_DIMENSION = (
    "The dataset has %d measurable field(s), but it still needs a reliable dimension for"
    " meaningful drill-down analysis."
)
DIAGNOSTIC_NO_MEASURE = (
    "The dataset has %d usable dimension(s), but it still needs at least one measurable field for"
    " diagnostic comparisons."
)
DIAGNOSTIC_NOTHING = (
    "Diagnostic readiness is not established because measurable fields and explanatory dimensions"
    " were not confirmed."
)
PREDICTIVE_READY_TIME = (
    "Predictive readiness is Ready because `%s` parsed at %s, covers %d time periods, and spans"
    " %d days."
)
PREDICTIVE_READY_TARGET = (
    "Predictive readiness is Ready because `%s` looks like a plausible outcome with %d valid rows"
    " and %d supporting feature(s)."
)
GAP_ROWS = "only %d rows are available for pre-modeling checks"
GAP_FIELDS = "measurable fields and slice dimensions are not both established yet"
GAP_TIME_DEPTH = "time depth is not strong enough yet for trustworthy forecasting-style readiness"
GAP_NO_TIME = "no reliable datetime structure was confirmed"
GAP_OUTCOME = "the best outcome candidate has %d valid rows with %d supporting feature(s)"
GAP_NO_OUTCOME = "no plausible target-like outcome column was detected"
SIGNAL_TIME = "datetime evidence is partial (%s parse success across %d time periods)"
SIGNAL_OUTCOME = "%d plausible target-like column(s) were detected"
SIGNAL_DEFAULT = "some early modeling signals exist"
PREDICTIVE_CONDITIONAL = "Predictive readiness is Conditional because %s, but %s."
PREDICTIVE_BLOCKED = "Predictive readiness is Not Ready because %s."
PRESCRIPTIVE_READY = (
    "Prescriptive readiness is Ready because the dataset already shows strong outcome evidence"
    " plus %d actionable decision dimension(s) for future rule logic."
)
PRESCRIPTIVE_CONDITIONAL = (
    "Prescriptive readiness is Conditional because %s, but stronger decision logic signals should"
    " be confirmed before anything is forced."
)
REASON_DIMENSIONS = "%d actionable dimension(s) were detected"
REASON_OUTCOMES = "%d valid outcome row(s) are available"
REASON_CAUTIOUS = "predictive evidence is still being treated conservatively"
PRESCRIPTIVE_BLOCKED_CATEGORY = (
    "Prescriptive readiness is Not Ready because category-style dimensions exist, but there is not"
    " yet enough trustworthy outcome evidence or actionable structure."
)
PRESCRIPTIVE_BLOCKED = (
    "Prescriptive readiness is Not Ready because the dataset does not yet show enough actionable"
    " dimensions or dependable outcome support."
)
SIGNAL_LABELS = {
    "date_column_present": "Date column present",
    "revenue_like_column_detected": "Revenue-like column detected",
    "id_column_detected": "ID column detected",
    "category_dimension_detected": "Category or segment dimension detected",
    "target_like_numeric_outcome_detected": "Target-like numeric outcome detected",
}
NO_SIGNAL = "No strong business signals detected beyond generic tabular structure"


def _names(rule: Column, *order: Column) -> Column:
    """Names of the columns a rule picks, ordered; bounded by the number of columns."""
    row = F.struct(*order, F.col("ordinal"), F.col("column_name"))
    return F.transform(F.array_sort(F.collect_list(F.when(rule, row))), lambda r: r["column_name"])


def _date_metrics() -> tuple[Column, Column, Column]:
    """Parse rate over non-empty values, number of periods, whole days covered."""
    rate = ratio(F.col("date_ok"), F.col("non_empty"))
    months = F.col("depth_days") >= V.MONTH_COUNT_DEPTH_DAYS
    periods = F.when(months, F.col("n_months")).otherwise(F.col("n_days"))
    return rate, periods, F.col("depth_days")


def _usable_rules() -> tuple[Column, Column]:
    usable_numeric = (
        (F.col("bucket") == "numeric")
        & (C.valid_ratio() >= V.COMPLETENESS)
        & (F.col("n_distinct") >= 2)
    )
    filled, groups, rows = F.col("non_empty"), F.col("n_distinct_non_empty"), F.col("n_rows")
    rate, periods, _ = _date_metrics()
    usable_category = (
        (F.col("bucket") == "categorical")
        & (filled > 0)
        & (ratio(filled, rows) >= V.COMPLETENESS)
        & (groups >= 2)
        & (groups <= F.greatest(F.lit(25), F.floor(rows * 0.5)))
        & (ratio(groups, filled) <= 0.9)
    )
    usable_date = (F.col("bucket") == "datetime") & (rate >= 0.75) & (periods >= 2)
    return usable_numeric, usable_category | usable_date


def dataset_facts(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All evidence about a dataset in one row, from its column statistics; one row per key for the
    statistics of several datasets."""
    name, bucket = F.col("norm_name"), F.col("bucket")
    usable_numeric, usable_dimension = _usable_rules()
    rate, periods, depth = _date_metrics()
    is_date = bucket == "datetime"
    date_candidate = is_date | has_word(name, V.DATE_WORDS)
    some_time = (rate > 0) | (periods > 0) | (depth > 0)
    earlier_first = F.when(is_date, -F.col("ordinal")).otherwise(-F.col("ordinal") - 10**6)
    target_candidate = (bucket == "numeric") & has_word(name, V.OUTCOME_WORDS)
    dates_last = F.when(is_date, 1).otherwise(0)
    numeric = bucket == "numeric"

    folded = stats.groupBy(*columns_of(by)).agg(
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("row_count"),
        F.count("*").alias("column_count"),
        _names(numeric).alias("numeric_columns"),
        _names(bucket == "categorical").alias("categorical_columns"),
        _names(is_date).alias("datetime_columns"),
        _names(usable_numeric).alias("usable_numeric"),
        _names(usable_dimension, dates_last).alias("usable_dimensions"),
        _names(usable_dimension & has_word(name, V.ACTIONABLE_WORDS), dates_last).alias(
            "actionable_dimensions"
        ),
        _names(C.is_metric(V.BUSINESS_WORDS)).alias("diagnostic_metrics"),
        _names(C.is_dimension()).alias("diagnostic_dimensions"),
        _names(C.is_trend_date()).alias("trend_dates"),
        _names(C.is_metric(V.FORECAST_WORDS), C.metric_priority(), name).alias("forecast_metrics"),
        _names(C.is_forecast_date()).alias("forecast_dates"),
        F.coalesce(F.bool_or(date_candidate), F.lit(False)).alias("time_candidate"),
        F.max(
            F.when(
                date_candidate & some_time,
                F.struct(
                    rate.alias("rate"), periods.alias("periods"), depth.alias("depth"),
                    earlier_first.alias("order"), F.col("column_name"),
                ),
            )
        ).alias("time"),
        F.count_if(target_candidate).alias("target_candidates"),
        F.max(
            F.when(
                target_candidate & (F.col("non_null") > 0),
                F.struct(
                    F.col("non_null").alias("rows"), C.valid_ratio().alias("ratio"),
                    (-F.col("ordinal")).alias("order"), F.col("column_name"),
                    usable_numeric.alias("usable"),
                ),
            )
        ).alias("target"),
        F.coalesce(F.bool_or(date_candidate), F.lit(False)).alias("date_column_present"),
        F.coalesce(F.bool_or(numeric & has_word(name, V.REVENUE_SIGNAL_WORDS)), F.lit(False)).alias(
            "revenue_like_column_detected"
        ),
        F.coalesce(F.bool_or(has_word(name, V.ID_SIGNAL_WORDS)), F.lit(False)).alias(
            "id_column_detected"
        ),
        F.coalesce(F.bool_or(has_word(name, V.CATEGORY_SIGNAL_WORDS)), F.lit(False)).alias(
            "category_dimension_detected"
        ),
        F.coalesce(F.bool_or(numeric & has_word(name, V.TARGET_SIGNAL_WORDS)), F.lit(False)).alias(
            "target_like_numeric_outcome_detected"
        ),
        *[
            F.coalesce(F.bool_or(has_word(name, words)), F.lit(False)).alias(label)
            for label, words in (
                ("customer_words", V.CUSTOMER_TYPE_WORDS),
                ("support_words", V.SUPPORT_TYPE_WORDS),
                ("marketing_words", V.MARKETING_TYPE_WORDS),
            )
        ],
    )
    folded = folded.select(
        "*",
        F.col("time.column_name").alias("time_column"),
        F.coalesce("time.rate", F.lit(0.0)).alias("time_parse_rate"),
        F.coalesce("time.periods", F.lit(0)).cast("long").alias("time_periods"),
        F.coalesce("time.depth", F.lit(0)).cast("long").alias("time_depth_days"),
        F.col("target.column_name").alias("target_column"),
        F.coalesce("target.rows", F.lit(0)).cast("long").alias("target_rows"),
        F.coalesce("target.ratio", F.lit(0.0)).alias("target_ratio"),
    ).select(
        "*",
        (
            F.greatest(
                F.size("usable_numeric")
                - F.coalesce(F.col("target.usable").cast("int"), F.lit(0)),
                F.lit(0),
            )
            + F.size("usable_dimensions")
        ).cast("long").alias("feature_count"),
    )
    enough_rows = F.col("row_count") >= V.STRONG_MODELING_ROWS
    folded = folded.select(
        "*",
        (
            F.col("time_candidate")
            & (F.col("time_parse_rate") >= 0.9)
            & (F.col("time_periods") >= V.STRONG_TIME_PERIODS)
            & (F.col("time_depth_days") >= V.STRONG_TIME_DEPTH_DAYS)
            & enough_rows
        ).alias("time_strong"),
        (
            (F.col("target_candidates") > 0)
            & (F.col("target_rows") >= V.TARGET_ROWS)
            & (F.col("feature_count") >= 1)
        ).alias("target_candidate"),
        (
            F.col("target_column").isNotNull()
            & enough_rows
            & (F.col("target_rows") >= V.STRONG_TARGET_ROWS)
            & (F.col("target_ratio") >= 0.75)
            & (F.col("feature_count") >= 3)
        ).alias("target_strong"),
    ).select(
        "*",
        ((F.size("actionable_dimensions") > 0) & F.col("target_candidate")).alias(
            "decision_candidate"
        ),
        (
            (F.size("actionable_dimensions") >= 2)
            & F.col("target_strong")
            & (F.col("target_rows") >= V.STRONG_TARGET_ROWS)
            & enough_rows
        ).alias("decision_strong"),
    )
    folded = folded.withColumn("type_scores", _type_scores()).withColumn(
        "dataset_type", _winning_type()
    )
    signals = F.array_compact(
        F.array(*[F.when(F.col(flag), F.lit(label)) for flag, label in SIGNAL_LABELS.items()])
    )
    folded = folded.withColumn(
        "business_signals", F.when(F.size(signals) > 0, signals).otherwise(F.array(F.lit(NO_SIGNAL)))
    )
    return _with_readiness(folded).drop("time", "target")


def _type_scores() -> Column:
    """Points per dataset type, in the declared order of the types."""
    revenue = F.col("revenue_like_column_detected")
    fired = {
        "date": F.col("date_column_present"),
        "revenue": revenue,
        "id": F.col("id_column_detected"),
        "category": F.col("category_dimension_detected"),
        "target": F.col("target_like_numeric_outcome_detected"),
        "customer_words": F.col("customer_words"),
        "support_words": F.col("support_words"),
        "marketing_words": F.col("marketing_words"),
        "single_date": (F.size("datetime_columns") == 1) & (F.size("numeric_columns") <= 2),
        "categories_and_revenue": (F.size("categorical_columns") >= 2) & revenue,
        "baseline": F.lit(True),
    }
    return F.array(
        *[
            reduce(
                Column.__add__,
                [fired[rule].cast("long") * points[i] for rule, points in V.TYPE_POINTS.items()],
            )
            for i in range(len(V.DATASET_TYPES))
        ]
    )


def _winning_type() -> Column:
    """First type with the highest score; two points or fewer say nothing."""
    best = F.array_max("type_scores")
    types = F.array(*[F.lit(t) for t in V.DATASET_TYPES])
    winner = F.get(types, (F.array_position("type_scores", best) - 1).cast("int"))
    return F.when(best <= 2, V.DATASET_TYPES[-1]).otherwise(winner)


def _with_readiness(facts: DataFrame) -> DataFrame:
    rows, numerics, dimensions = F.col("row_count"), F.size("usable_numeric"), F.size("usable_dimensions")
    valid = (rows > 0) & (F.col("column_count") > 0)
    text = F.format_string

    facts = facts.withColumn(
        "descriptive_status", F.when(valid, V.READY).otherwise(V.NOT_READY)
    ).withColumn(
        "diagnostic_status",
        F.when(valid & (numerics > 0) & (dimensions > 0), V.READY)
        .when(valid & ((numerics > 0) | (dimensions > 0)), V.CONDITIONAL)
        .otherwise(V.NOT_READY),
    )
    diagnostic = F.col("diagnostic_status")
    outcome, time = F.col("target_candidates") > 0, F.col("time_candidate")
    facts = facts.withColumn(
        "predictive_status",
        F.when(~valid | (diagnostic == V.NOT_READY), V.NOT_READY)
        .when(F.col("time_strong") | F.col("target_strong"), V.READY)
        .when(
            (rows >= V.MODELING_ROWS)
            & (time | outcome | ((diagnostic == V.READY) & (F.col("feature_count") >= 2))),
            V.CONDITIONAL,
        )
        .otherwise(V.NOT_READY),
    )
    predictive = F.col("predictive_status")
    facts = facts.withColumn(
        "prescriptive_status",
        F.when(diagnostic == V.NOT_READY, V.NOT_READY)
        .when((predictive == V.READY) & F.col("decision_strong"), V.READY)
        .when((diagnostic == V.READY) & F.col("decision_candidate"), V.CONDITIONAL)
        .otherwise(V.NOT_READY),
    )

    def listed(*items: Column) -> Column:
        return F.array_compact(F.array(*items))

    percent = percent_text(F.col("time_parse_rate"))
    gaps = listed(
        F.when(rows < V.MODELING_ROWS, text(GAP_ROWS, rows)),
        F.when(diagnostic != V.READY, F.lit(GAP_FIELDS)),
        F.when(~time, F.lit(GAP_NO_TIME)).when(~F.col("time_strong"), F.lit(GAP_TIME_DEPTH)),
        F.when(~outcome, F.lit(GAP_NO_OUTCOME)).when(
            ~F.col("target_strong"), text(GAP_OUTCOME, F.col("target_rows"), F.col("feature_count"))
        ),
    )
    signals = listed(
        F.when(time, text(SIGNAL_TIME, percent, F.col("time_periods"))),
        F.when(outcome, text(SIGNAL_OUTCOME, F.col("target_candidates"))),
    )
    signal_text = F.when(F.size(signals) > 0, F.array_join(signals, "; ")).otherwise(SIGNAL_DEFAULT)
    gap_text = F.array_join(gaps, ", ")
    actionable = F.size("actionable_dimensions")
    reasons = listed(
        text(REASON_DIMENSIONS, actionable),
        text(REASON_OUTCOMES, F.col("target_rows")),
        F.when(predictive != V.READY, F.lit(REASON_CAUTIOUS)),
    )
    return facts.withColumns(
        {
            "descriptive_reason": F.when(
                valid, text(DESCRIPTIVE_READY, rows, F.col("column_count"))
            ).otherwise(DESCRIPTIVE_BLOCKED),
            "diagnostic_reason": F.when(~valid, DIAGNOSTIC_INVALID)
            .when((numerics > 0) & (dimensions > 0), text(DIAGNOSTIC_READY, numerics, dimensions))
            .when(numerics > 0, text(DIAGNOSTIC_NO_DIMENSION, numerics))
            .when(dimensions > 0, text(DIAGNOSTIC_NO_MEASURE, dimensions))
            .otherwise(DIAGNOSTIC_NOTHING),
            "predictive_reason": F.when(
                (predictive == V.READY) & F.col("time_strong"),
                text(
                    PREDICTIVE_READY_TIME, F.col("time_column"), percent, F.col("time_periods"),
                    F.col("time_depth_days"),
                ),
            )
            .when(
                predictive == V.READY,
                text(
                    PREDICTIVE_READY_TARGET, F.col("target_column"), F.col("target_rows"),
                    F.col("feature_count"),
                ),
            )
            .when(predictive == V.CONDITIONAL, text(PREDICTIVE_CONDITIONAL, signal_text, gap_text))
            .otherwise(text(PREDICTIVE_BLOCKED, gap_text)),
            "prescriptive_reason": F.when(
                F.col("prescriptive_status") == V.READY, text(PRESCRIPTIVE_READY, actionable)
            )
            .when(
                F.col("prescriptive_status") == V.CONDITIONAL,
                text(PRESCRIPTIVE_CONDITIONAL, F.array_join(reasons, ", ")),
            )
            .when(F.col("category_dimension_detected"), PRESCRIPTIVE_BLOCKED_CATEGORY)
            .otherwise(PRESCRIPTIVE_BLOCKED),
        }
    )


# --- projections of the facts row ----------------------------------------------------------


def signal_flags(facts: DataFrame) -> DataFrame:
    return facts.select(*SIGNAL_LABELS)


def business_signals(facts: DataFrame) -> DataFrame:
    return facts.select(F.posexplode_outer("business_signals").alias("i", "signal")).select(
        (F.col("i") + 1).cast("long").alias("signal_order"), "signal"
    )


def type_scores(facts: DataFrame) -> DataFrame:
    return facts.select(F.posexplode_outer("type_scores").alias("i", "score")).select(
        F.get(F.array(*[F.lit(t) for t in V.DATASET_TYPES]), F.col("i")).alias("dataset_type"), "score"
    )


def dataset_type(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return facts.select(*columns_of(by), "dataset_type")


def datetime_support(facts: DataFrame) -> DataFrame:
    return facts.select(
        F.col("time_candidate").alias("candidate_present"),
        F.col("time_column").alias("best_column"),
        F.col("time_parse_rate").alias("parse_success_rate"),
        F.col("time_periods").alias("unique_periods"),
        "time_depth_days",
        F.col("time_strong").alias("strong"),
    )


def target_support(facts: DataFrame) -> DataFrame:
    return facts.select(
        F.col("target_candidates").alias("candidate_count"),
        F.col("target_column").alias("best_target_column"),
        F.col("target_rows").alias("best_target_valid_rows"),
        F.col("target_ratio").alias("best_target_valid_ratio"),
        F.col("feature_count").alias("feature_support_count"),
        F.col("target_candidate").alias("candidate"),
        F.col("target_strong").alias("strong"),
    )


def decision_support(facts: DataFrame) -> DataFrame:
    return facts.select(
        F.array_join("actionable_dimensions", ", ").alias("actionable_dimensions"),
        F.col("target_rows").alias("valid_outcome_rows"),
        F.col("decision_candidate").alias("candidate"),
        F.col("decision_strong").alias("strong"),
    )


def readiness(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per layer: status and reason."""
    layers = ("descriptive", "diagnostic", "predictive", "prescriptive")
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).cast("long").alias("layer_order"),
                F.lit(layer).alias("layer"),
                F.col(f"{layer}_status").alias("status"),
                F.col(f"{layer}_reason").alias("reason"),
            )
            for i, layer in enumerate(layers)
        ]
    )
    return facts.select(*columns_of(by), F.inline(rows))


def _allowed(layer: str) -> Column:
    return F.col(f"{layer}_status").isin(V.READY, V.CONDITIONAL)


def _only(array: str) -> Column:
    return F.when(F.size(array) == 1, F.get(array, F.lit(0)))


def diagnostic_enabled() -> Column:
    return (
        _allowed("diagnostic")
        & (F.size("diagnostic_metrics") > 0)
        & (F.size("diagnostic_dimensions") > 0)
    )


def forecast_supported() -> Column:
    return (F.size("forecast_metrics") > 0) & (F.size("forecast_dates") > 0)


def forecast_enabled() -> Column:
    return forecast_supported() & _allowed("predictive")


def prescriptive_enabled() -> Column:
    return _allowed("prescriptive") & (diagnostic_enabled() | forecast_enabled())


def diagnostic_options(facts: DataFrame) -> DataFrame:
    return facts.select(
        diagnostic_enabled().alias("enabled"),
        F.array_join("diagnostic_metrics", ", ").alias("metric_columns"),
        F.array_join("diagnostic_dimensions", ", ").alias("dimension_columns"),
        F.array_join("trend_dates", ", ").alias("datetime_columns"),
        _only("trend_dates").alias("default_date_column"),
        F.col("diagnostic_status").alias("readiness_status"),
    )


def forecast_options(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return facts.select(
        *columns_of(by),
        forecast_enabled().alias("enabled"),
        forecast_supported().alias("time_series_support"),
        F.array_join("forecast_metrics", ", ").alias("metric_columns"),
        F.get("forecast_metrics", F.lit(0)).alias("default_metric_column"),
        F.array_join("forecast_dates", ", ").alias("datetime_columns"),
        _only("forecast_dates").alias("default_datetime_column"),
        F.lit(", ".join(V.GRAIN_OPTIONS)).alias("grain_options"),
        F.lit(", ".join(map(str, V.FORECAST_HORIZONS))).alias("horizon_options"),
        F.col("predictive_status").alias("readiness_status"),
        F.col("predictive_reason").alias("readiness_reason"),
    )


def prescriptive_options(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return facts.select(
        *columns_of(by),
        prescriptive_enabled().alias("enabled"),
        F.col("prescriptive_status").alias("readiness_status"),
        F.col("prescriptive_reason").alias("readiness_reason"),
        diagnostic_enabled().alias("diagnostic_enabled"),
        forecast_enabled().alias("forecast_enabled"),
    )
