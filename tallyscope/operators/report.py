"""Report rows, report text and compact facts, one report per key from a single job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope.functions.coerce import fixed_text
from tallyscope.operators import columns as C
from tallyscope.operators import intelligence as I
from tallyscope.operators import prescriptive as X
from tallyscope.operators import quality as Q
from tallyscope.operators.shape import attach, columns_of, numbered_items
from tallyscope.session import materialise

# Section titles and item texts.
TITLES = (
    "Data Quality Summary",
    "Column Profiling Summary",
    "Dataset Intelligence Summary",
    "Descriptive Analytics Summary",
    "Diagnostic Analytics Summary",
    "Predictive Analytics Summary",
    "Prescriptive Analytics Summary",
    "Key Recommendations",
)
NARRATIVE_TITLE = "AI Insight Summary"
NO_RECOMMENDATIONS = "Prescriptive recommendations are not available yet for this dataset."
OUTLOOK_LINE = (
    "Projected direction is %s, with the first forecast at %s versus the latest actual value of %s."
)
DEFAULT_TITLE = "Business Insight Report"
PREVIEW_SECTIONS = 4


def assess(frame: DataFrame, by: Sequence[str] = (), stats: DataFrame | None = None) -> dict:
    """Run all layers once: dataset facts and counts (a few values) and one result row per key."""
    facts = materialise(I.dataset_facts(C.column_stats(frame) if stats is None else stats))
    chosen = X.chosen_columns(facts)
    return {
        "by": tuple(by),
        "chosen": chosen,
        "facts": facts.first().asDict(),
        "kpi": Q.kpi_overview(frame).first().asDict(),
        "result": X.prescriptive(frame, chosen, by),
    }


def _texts(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(i) for i in items])


def _dataset_sections(run: dict, dataset_name: str, file_size: str) -> list[Column]:
    facts, kpi = run["facts"], run["kpi"]
    layers = ("descriptive", "diagnostic", "predictive", "prescriptive")
    states = ", ".join(f"{layer.title()}={facts[layer + '_status']}" for layer in layers)
    return [
        _texts(
            [
                f"Duplicate rows detected: {kpi['duplicate_rows']}",
                f"Columns with missing values: {kpi['columns_with_missing_values']}",
                *Q.SHORT_ACTIONS[:3],
            ]
        ),
        _texts(
            [
                f"Numeric columns: {len(facts['numeric_columns'])}",
                f"Categorical columns: {len(facts['categorical_columns'])}",
                f"Datetime columns: {len(facts['datetime_columns'])}",
                f"Example numeric fields: {', '.join(facts['numeric_columns'][:5]) or 'None'}",
            ]
        ),
        _texts(
            [
                f"Detected dataset type: {facts['dataset_type'].replace('_', ' ').title()}",
                f"Readiness states: {states}",
                f"Business signals: {', '.join(facts['business_signals'][:5])}",
            ]
        ),
        _texts(
            [
                f"Total rows: {kpi['total_rows']}",
                f"Total columns: {kpi['total_columns']}",
                f"Dataset name: {dataset_name}",
                f"File size: {file_size}",
            ]
        ),
    ]


def _layer_sections(run: dict) -> list[Column]:
    chosen, d, p = run["chosen"], F.col("d"), F.col("p")
    name, number = F.concat, F.format_string

    def labelled(label: str, value: Column) -> Column:
        return name(F.lit(label + ": "), F.coalesce(value.cast("string"), F.lit("N/A")))

    diagnostic = _texts([chosen["diagnostic_reason"]])
    if chosen["diagnostic"]:
        diagnostic = F.concat(
            F.array(
                labelled("Primary metric reviewed", d["metric"]),
                labelled("Primary dimension reviewed", d["dimension"]),
                labelled("Leading group", d["top"]["name"]),
                labelled("Lowest-contributing group", d["bottom"]["name"]),
            ),
            F.slice(d["findings"], 1, 3),
        )
    predictive = _texts([chosen["predictive_reason"]])
    if chosen["forecast"]:
        predictive = F.concat(
            F.array(
                labelled("Forecast status", p["status"]),
                labelled("Forecast metric", p["metric"]),
                number(
                    "Projected direction: %s (directional only when readiness is conditional)",
                    p["direction"],
                ),
                labelled("Historical periods used", p["periods"]),
            ),
            F.slice(p["findings"], 1, 3),
            F.slice(p["messages"], 1, 2),
        )
    prescriptive, advice = _texts([chosen["prescriptive_reason"]]), _texts([NO_RECOMMENDATIONS])
    if chosen["prescriptive"]:
        prescriptive = F.concat(
            F.array(
                labelled("Prescriptive status", F.col("status")),
                labelled("Recommendations triggered", F.size("recommendations")),
                labelled("Highest-priority issue", F.col("highest_priority_issue")),
            ),
            F.slice("findings", 1, 3),
        )
        advice = F.transform(
            F.slice("recommendations", 1, 5),
            lambda r: number(
                "Category: %s | Priority: %s | Issue: %s | Action: %s",
                r["category"], r["priority"], r["issue_detected"], r["suggested_action"],
            ),
        )
    return [diagnostic, predictive, prescriptive, advice]


def report_sections(
    run: dict,
    dataset_name: str = "dataset",
    file_size: str = "Unknown",
    narrative: DataFrame | None = None,
) -> DataFrame:
    """One row per key with its sections; ``narrative`` adds a last section (key columns, items)."""
    by = run["by"]
    result = run["result"]
    arrays = _dataset_sections(run, dataset_name, file_size) + _layer_sections(run)
    titles = list(TITLES)
    if narrative is not None:
        told = narrative.select(*columns_of(by), F.col("items").alias("narrative_items"))
        result = attach(result, told, by)
        arrays.append(F.coalesce("narrative_items", F.array().cast("array<string>")))
        titles.append(NARRATIVE_TITLE)
    sections = F.array(
        *[
            F.struct(
                F.lit(i + 1).cast("long").alias("section_order"), F.lit(title).alias("section"),
                items.alias("items"),
            )
            for i, (title, items) in enumerate(zip(titles, arrays))
        ]
    )
    return result.select(
        *columns_of(by), F.filter(sections, lambda s: F.size(s["items"]) > 0).alias("sections")
    )


def report_lines(sections: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The report as rows (section order, section, item order, item)."""
    titles = ("section_order", "section")
    rows = sections.select(*columns_of(by), F.inline_outer("sections"))
    return numbered_items(rows, (*by, *titles), "items", "item_order", "item")


def report_text(
    sections: DataFrame,
    by: Sequence[str] = (),
    dataset_name: str = "dataset",
    generated_at: str | Column = "",
    title: str = DEFAULT_TITLE,
    max_sections: int | None = None,
) -> DataFrame:
    """One plain-text report per key, built inside its row."""
    shown = F.col("sections") if max_sections is None else F.slice("sections", 1, max_sections)
    stamp = generated_at if isinstance(generated_at, Column) else F.lit(generated_at)
    body = F.transform(
        shown,
        lambda s: F.concat_ws(
            "\n",
            s["section"],
            F.repeat(F.lit("-"), F.length(s["section"])),
            F.transform(s["items"], lambda i: F.concat(F.lit("- "), i)),
            F.lit(""),
        ),
    )
    head = F.concat_ws(
        "\n", F.lit(title), F.lit(f"Dataset: {dataset_name}"), F.concat(F.lit("Generated: "), stamp),
        F.lit(""), F.array_join(body, "\n"),
    )
    return sections.select(*columns_of(by), F.concat(F.rtrim(head, F.lit("\n ")), F.lit("\n")).alias("report"))


def insight_facts(run: dict) -> DataFrame:
    """The few facts worth telling per key: type, counts, findings, outlook, recommendations."""
    by, chosen, facts, kpi = run["by"], run["chosen"], run["facts"], run["kpi"]
    d, p = F.col("d"), F.col("p")

    def of(kind: str, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("fact")))

    outlook = F.lit(chosen["predictive_reason"])
    if chosen["forecast"]:
        outlook = F.format_string(
            OUTLOOK_LINE, p["direction"], fixed_text(p["first_value"], 2),
            fixed_text(p["latest_value"], 2),
        )
    advice = _texts([chosen["prescriptive_reason"]])
    if chosen["prescriptive"]:
        advice = F.transform(
            F.slice("recommendations", 1, 2),
            lambda r: F.format_string(
                "%s priority: %s. Action: %s", r["priority"], r["issue_detected"],
                r["suggested_action"],
            ),
        )
    kpis = _texts(
        [
            f"Rows: {kpi['total_rows']}",
            f"Columns: {kpi['total_columns']}",
            f"Duplicate rows: {kpi['duplicate_rows']}",
        ]
    )
    parts = [of("Dataset type", _texts([facts["dataset_type"]])), of("KPI", kpis)]
    if chosen["diagnostic"]:
        parts.append(of("Diagnostic", F.slice(d["findings"], 1, 3)))
    parts += [of("Predictive direction", F.array(outlook)), of("Recommendation", advice)]
    told = numbered_items(run["result"], by, F.concat(*parts), "fact_order", "f")
    return told.select(*columns_of(by), "fact_order", "f.kind", "f.fact")


def fallback_summary(run: dict) -> DataFrame:
    """The same facts as one text per key."""
    by = run["by"]
    lines = insight_facts(run).groupBy(*columns_of(by)).agg(
        F.array_sort(F.collect_list(F.struct("fact_order", "kind", "fact"))).alias("f")
    )
    body = F.transform("f", lambda f: F.concat(F.lit("- "), f["kind"], F.lit(": "), f["fact"]))
    return lines.select(
        *columns_of(by),
        F.concat_ws("\n", F.lit("Compact fallback summary"), F.lit(""), body).alias("summary"),
    )
