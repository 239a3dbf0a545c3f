"""The registered queries: each takes (session, table folder) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.operators import columns as C
from tallyscope.operators import diagnostic as D
from tallyscope.operators import intelligence as I
from tallyscope.operators import narrative as N
from tallyscope.operators import predictive as P
from tallyscope.operators import prescriptive as X
from tallyscope.operators import quality as Q
from tallyscope.operators import report as R
from tallyscope.operators import sketches as K
from tallyscope.session import scratch_path
from tallyscope.sources import csv_files as S
from tallyscope.sources.report_text import read_report_text, write_report_text
from tallyscope.sources.tables import business, dirty, narratives, table

Query = Callable[[SparkSession, str], DataFrame]

#: Tables whose readiness is judged in one job: some are Ready, some Conditional, some blocked.
PROFILED = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "labels")
DIRTY_ORDER = ["order_id", "line_no", "net_revenue", "profit"]


def _rounded(frame: DataFrame, *names: str) -> DataFrame:
    """Values built from several floating steps, at the precision two engines agree on."""
    return frame.withColumns({n: F.round(n, 6) for n in names})


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return I.dataset_facts(C.column_stats(business(spark, folder)))


def _estimated(frame: DataFrame) -> DataFrame:
    """Exact parts of the estimated statistics, and whether each estimate is within five percent."""
    counts = ("n_distinct", "n_distinct_non_empty", "n_distinct_clean", "n_times")
    exact = C.column_stats(frame).select("ordinal", *[F.col(c).alias(f"true_{c}") for c in counts])
    rows = K.approximate_column_stats(frame).join(exact, "ordinal")
    close = [(F.abs(F.col(c) - F.col(f"true_{c}")) <= F.col(f"true_{c}") * 0.08).alias(f"{c}_close") for c in counts]
    return rows.select(
        "ordinal", "column_name", "bucket", "n_rows", "non_null", "non_empty", "numeric_ok", "date_ok", "min_at", "max_at",
        "depth_days", "n_days", "n_months", *close,
    )


def _facts_by_table(spark: SparkSession, folder: str) -> DataFrame:
    frames = {name: table(spark, folder, name) for name in PROFILED}
    return I.dataset_facts(K.decided_stats_of_datasets(frames), ["dataset"])


def _csv_copy(spark: SparkSession, folder: str) -> str:
    """The dirty rows as CSV files in the shared folder."""
    path = scratch_path(spark, "csv")
    (
        dirty(spark, folder)
        .write.option("header", True)
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_type", "ts", F.col("value").cast("decimal(18,4)").alias("value")
    )


def _prescriptive(spark: SparkSession, folder: str, by=()) -> DataFrame:
    frame = business(spark, folder)
    chosen = X.chosen_columns(I.dataset_facts(C.column_stats(frame)))
    return X.prescriptive(frame, chosen, by)


def _limitations(spark: SparkSession, folder: str, name: str) -> DataFrame:
    frame = table(spark, folder, name)
    chosen = X.chosen_columns(I.dataset_facts(K.decided_column_stats(frame)))
    return X.prescriptive_limitations(X.prescriptive(frame, chosen))


def _scan_types(spark: SparkSession, folder: str) -> DataFrame:
    return S.inferred_types(S.scan_csv(spark, _csv_copy(spark, folder)))


def _csv_totals(spark: SparkSession, folder: str) -> DataFrame:
    frame = S.read_csv(spark, _csv_copy(spark, folder))
    return D.grouped_comparison(frame, "quantity_text", "segment")


def queries() -> dict[str, Query]:
    def on_business(op, *args, **kwargs) -> Query:
        return lambda s, d: op(business(s, d), *args, **kwargs)

    def on_dirty(op, *args, **kwargs) -> Query:
        return lambda s, d: op(dirty(s, d), *args, **kwargs)

    def on_stats(op) -> Query:
        return lambda s, d: op(C.column_stats(business(s, d)))

    def on_facts(op) -> Query:
        return lambda s, d: op(_facts(s, d))

    def on_tables(op) -> Query:
        return lambda s, d: op(_facts_by_table(s, d), ["dataset"])

    def on_forecast(op, by=(), **kwargs) -> Query:
        return lambda s, d: op(
            P.forecast(business(s, d), "net_revenue", "order_date", by, **kwargs), by
        )

    def on_events(op, by=("event_type",), **kwargs) -> Query:
        return lambda s, d: op(P.forecast(_events(s, d), "value", "ts", by, **kwargs), by)

    def on_rules(op, by=()) -> Query:
        return lambda s, d: op(_prescriptive(s, d, by), by)

    def on_texts(op) -> Query:
        return lambda s, d: op(narratives(s, d), "doc_id", "narrative")

    region = ["region"]

    def shown_report(s, d):
        run = R.assess(business(s, d), ["region"])
        return R.report_lines(R.report_sections(run, "business"), ["region"])

    def report_text(s, d):
        run = R.assess(business(s, d))
        return R.report_text(R.report_sections(run, "business"), (), "business", "2001-08-01 00:00:00")

    def written_reports(s, d):
        """One report a region, written; then one region's is written anew, and all are read back."""
        sections = R.report_sections(R.assess(business(s, d), region), "business")
        path = scratch_path(s, "reports")
        for stamp, chosen in (("2001-08-01 00:00:00", sections), ("2001-09-01 00:00:00", sections.where("region = 'ASIA'"))):
            write_report_text(R.report_text(chosen, region, "business", stamp), path, region, replace=True)
        return read_report_text(s, path, region)

    def narrative_section(s, d):
        """Each region's compact summary as the narrative of its report."""
        run = R.assess(business(s, d), region)
        story = N.narrative_for_report(R.fallback_summary(run), "region", "summary")
        sections = R.report_sections(run, "business", narrative=story.withColumnRenamed("doc_id", "region"))
        return R.report_lines(sections, region).where(F.col("section") == R.NARRATIVE_TITLE)

    def preview(s, d):
        rows = business(s, d).select(
            "order_id", "line_no", "order_date", "region", "segment",
            F.col("net_revenue").cast("double").alias("net_revenue"),
        )
        return Q.preview(rows, ["order_id", "line_no", "net_revenue"])

    def preprocessing(s, d):
        return Q.preprocessing_summary(dirty(s, d)).withColumn(
            "profiling_actions", F.array_join("profiling_actions", " ")
        )

    money = ("net_revenue", "segment")
    return {
        # sources
        "csv_scan": lambda s, d: S.scan_csv(s, _csv_copy(s, d)),
        "csv_infer": _scan_types,
        "csv_grouped": _csv_totals,
        "preview": preview,
        # quality
        "dataset_summary": on_dirty(Q.dataset_summary),
        "duplicate_rows": on_dirty(Q.duplicate_rows),
        "repeated_rows": lambda s, d: Q.repeated_rows(dirty(s, d)).agg(
            F.count("*").alias("different_rows"), F.sum("copies").alias("copies")
        ),
        "missing_summary": on_dirty(Q.missing_summary),
        "kpi_overview": on_dirty(Q.kpi_overview),
        "preprocessing_summary": preprocessing,
        "quality_log": lambda s, d: Q.quality_log(
            dirty(s, d), C.column_profile(dirty(s, d), DIRTY_ORDER)
        ),
        # columns
        "column_profile": on_dirty(C.column_profile, DIRTY_ORDER),
        "column_stats": on_dirty(C.column_stats, DIRTY_ORDER),
        "column_profile_of_all": on_dirty(C.column_profile),
        "column_stats_business": on_business(C.column_stats),
        "column_stats_estimated": lambda s, d: _estimated(dirty(s, d)),
        "diagnostic_metric_columns": on_stats(C.diagnostic_metric_columns),
        "forecast_metric_columns": on_stats(C.forecast_metric_columns),
        "dimension_columns": on_stats(C.dimension_columns),
        "trend_date_columns": on_stats(C.trend_date_columns),
        "forecast_date_columns": on_stats(C.forecast_date_columns),
        # intelligence
        "signal_flags": on_facts(I.signal_flags),
        "business_signals": on_facts(I.business_signals),
        "type_scores": on_facts(I.type_scores),
        "dataset_type": on_facts(I.dataset_type),
        "datetime_support": on_facts(I.datetime_support),
        "target_support": on_facts(I.target_support),
        "decision_support": on_facts(I.decision_support),
        "readiness": on_facts(I.readiness),
        "readiness_estimated": lambda s, d: I.readiness(I.dataset_facts(K.decided_column_stats(business(s, d)))),
        "diagnostic_options": on_facts(I.diagnostic_options),
        "forecast_options": on_facts(I.forecast_options),
        "prescriptive_options": on_facts(I.prescriptive_options),
        "dataset_type_by_table": on_tables(I.dataset_type),
        "readiness_by_table": on_tables(I.readiness),
        "forecast_options_by_table": on_tables(I.forecast_options),
        "prescriptive_options_by_table": on_tables(I.prescriptive_options),
        # diagnostic
        "grouped_comparison": on_business(D.grouped_comparison, *money),
        "grouped_comparison_dirty": on_dirty(D.grouped_comparison, "quantity_text", "segment"),
        "grouped_comparison_by_region": on_business(D.grouped_comparison, *money, by=region),
        "ranked_groups": on_business(D.ranked_groups, "net_revenue", "nation"),
        "ranked_groups_by_region": on_business(D.ranked_groups, "profit", "nation", by=region),
        "top_groups": on_business(D.top_groups, "net_revenue", "nation"),
        "top_groups_by_region": on_business(D.top_groups, "net_revenue", "nation", by=region, n=2),
        "bottom_groups": on_business(D.bottom_groups, "net_revenue", "nation"),
        "diagnostic_summary": on_business(D.diagnostic_summary, *money),
        "diagnostic_summary_by_region": on_business(
            D.diagnostic_summary, "net_revenue", "status", by=region
        ),
        "underperformers": on_business(D.underperformers, "net_revenue", "status"),
        "underperformers_by_region": on_business(
            D.underperformers, "net_revenue", "status", by=region
        ),
        "underperformers_orders": on_business(D.underperformers, "net_revenue", "order_id"),
        "underperformers_orders_by_region": on_business(
            D.underperformers, "net_revenue", "order_id", by=region
        ),
        "efficiency_split": on_business(D.efficiency_split, *money),
        "efficiency_split_by_region": on_business(D.efficiency_split, *money, by=region),
        "margin_flags": lambda s, d: _rounded(
            D.margin_flags(business(s, d), "nation"), "discount_cutoff", "profit_cutoff"
        ),
        "margin_flags_by_region": lambda s, d: _rounded(
            D.margin_flags(business(s, d), "nation", region), "discount_cutoff", "profit_cutoff"
        ),
        "trend_summary": on_business(D.trend_summary, "net_revenue", "order_date"),
        "trend_summary_by_region": on_business(
            D.trend_summary, "net_revenue", "order_date", by=region
        ),
        "trend_summary_text_dates": on_dirty(D.trend_summary, "quantity_text", "order_day"),
        "trend_by_dimension": on_business(
            D.trend_by_dimension, "net_revenue", "region", "order_date"
        ),
        "trend_by_dimension_too_many": on_business(
            D.trend_by_dimension, "net_revenue", "nation", "order_date"
        ),
        "trend_by_nation": on_business(
            D.trend_by_dimension, "net_revenue", "nation", "order_date", most_groups=25
        ),
        "margin_flags_orders": lambda s, d: _rounded(
            D.margin_flags(business(s, d), "order_id"), "discount_cutoff", "profit_cutoff"
        ),
        "diagnostic_findings": on_business(D.diagnostic_findings, "net_revenue", "nation"),
        "diagnostic_findings_by_region": on_business(
            D.diagnostic_findings, "net_revenue", "status", by=region
        ),
        # predictive
        "forecast_history": on_business(P.forecast_history, "net_revenue", "order_date"),
        "forecast_history_by_nation": on_business(
            P.forecast_history, "net_revenue", "order_date", ["nation"]
        ),
        "forecast_history_complete": on_business(
            P.forecast_history, "net_revenue", "order_date", drop_partial=True
        ),
        "forecast_inputs": on_forecast(P.forecast_inputs),
        "forecast_projection": on_forecast(P.forecast_projection),
        "forecast_projection_by_nation": on_forecast(P.forecast_projection, ["nation"]),
        "forecast_projection_events": on_events(P.forecast_projection),
        "forecast_cards": lambda s, d: _rounded(
            on_forecast(P.forecast_cards)(s, d), "projected_average_forecast_value"
        ),
        "forecast_cards_by_nation": lambda s, d: _rounded(
            on_forecast(P.forecast_cards, ["nation"])(s, d), "projected_average_forecast_value"
        ),
        "forecast_volatility": lambda s, d: _rounded(
            on_forecast(P.forecast_volatility)(s, d), "volatility_score", "relative_std"
        ),
        "forecast_volatility_events": lambda s, d: _rounded(
            on_events(P.forecast_volatility)(s, d), "volatility_score", "relative_std"
        ),
        "forecast_validation": on_events(P.forecast_validation, horizon=30),
        "forecast_chart": lambda s, d: P.forecast_chart(
            P.forecast(business(s, d), "net_revenue", "order_date", keep_history=True)
        ),
        "forecast_findings": on_forecast(P.forecast_findings),
        "forecast_findings_events": on_events(P.forecast_findings, readiness_status="Conditional"),
        "forecast_reasons": on_forecast(P.forecast_reasons),
        # prescriptive
        "recommendations": on_rules(X.recommendations),
        "recommendations_by_region": on_rules(X.recommendations, ["region"]),
        "prescriptive_summary": on_rules(X.prescriptive_summary),
        "prescriptive_findings": on_rules(X.prescriptive_findings),
        "prescriptive_limitations": on_rules(X.prescriptive_limitations),
        "prescriptive_limitations_orders": on_rules(X.prescriptive_limitations, ["order_id"]),
        "prescriptive_limitations_lineitem": lambda s, d: _limitations(s, d, "lineitem"),
        # report and narrative
        "report_lines": shown_report,
        "report_text": report_text,
        "insight_facts": lambda s, d: R.insight_facts(R.assess(business(s, d))),
        "report_written": written_reports,
        "report_narrative": narrative_section,
        "fallback_summary_by_region": lambda s, d: R.fallback_summary(R.assess(business(s, d), region)),
        "narrative_lines": on_texts(N.narrative_lines),
        "narrative_sections": on_texts(N.narrative_sections),
        "narrative_items": on_texts(N.narrative_items),
        "narrative_quality": on_texts(N.narrative_quality),
        "narrative_short": on_texts(N.narrative_short),
    }
