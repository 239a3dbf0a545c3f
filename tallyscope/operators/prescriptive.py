"""Rules over diagnostic and forecast evidence.

One evidence row per key carries the facts of both layers; the rules are one array of conditional
structs over that row. Flags and lists travel as data, nothing is recovered from text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope import fixed_values as V
from tallyscope.functions.coerce import fixed_text
from tallyscope.functions.naming import quoted
from tallyscope.operators import diagnostic as D
from tallyscope.operators import intelligence as I
from tallyscope.operators import predictive as P
from tallyscope.operators.fold import daily_totals, fold, group_totals
from tallyscope.operators.shape import KEY, attach, columns_of, numbered_items, one_key, own_keys
from tallyscope.session import freed_shuffles, materialise

# Categories, bases and texts of the rules.
RISK, GROWTH = "Risk Controls", "Growth Opportunities"
EFFICIENCY, MONITORING = "Efficiency Improvements", "Monitoring Priorities"
HIGH, MEDIUM, LOW = "High", "Medium", "Low"
FROM_DIAGNOSTIC, FROM_FORECAST, FROM_BOTH = "diagnostic-based", "predictive-based", "combined"
WHOLE_SERIES, WHOLE_DATASET = "Overall series", "Overall dataset"
FIELDS = (
    "category", "priority", "issue_detected", "affected_group", "supporting_evidence",
    "suggested_action", "recommendation_basis",
)
ISSUES = {
    "concentration_high": "Top group concentration risk",
    "concentration_moderate": "Moderate group concentration",
    "spread_wide": "Wide performance spread across groups",
    "spread_moderate": "Moderate performance gap across groups",
    "weak_mean": "Weak per-row efficiency",
    "efficient_follower": "High-efficiency segment is not yet the top contributor",
    "margin": "Discount pressure is weakening profit",
    "outlook_weak": "Forecast indicates weak near-term trajectory",
    "outlook_up": "Forecast points to near-term momentum",
    "unstable": "Recent trend instability",
    "limited": "Forecast confidence is limited",
    "dominant_down": "Dominant segment risk with downward outlook",
    "weak_uncertain": "Weak segment performance with limited forecast confidence",
    "concentrated_unstable": "Concentrated performance with unstable trend",
    "uneven_growth": "Forecasted growth with uneven segment performance",
    "nothing": "Evidence is limited for stronger prescriptive actions",
}
EVIDENCE = {
    "concentration_high": "%s contributes %s%% of total %s.",
    "concentration_moderate": "%s is the leading %s and contributes %s%% of total %s.",
    "spread_wide": "Lowest-Contributing Group is %s below the top group on total %s.",
    "spread_moderate": "%s trails the top group by %s on total %s.",
    "weak_mean": "%s averages %s per row versus a group average of %s.",
    "efficient_follower": (
        "%s has the strongest per-row average at %s, but it is not the top total contributor."
    ),
    "outlook_weak": (
        "The forecast direction is %s, with a first projected value of %s versus the latest actual"
        " of %s."
    ),
    "outlook_up": (
        "The forecast direction is up, with a first projected value of %s above the latest actual"
        " of %s."
    ),
    "limited": (
        "Predictive readiness is conditional, so the forecast should be treated as directional"
        " rather than high-confidence."
    ),
    "dominant_down": (
        "%s dominates current performance and the overall forecast direction is down."
    ),
    "weak_uncertain": (
        "%s is the lowest contributor, and the forecast outlook is %s with conditional confidence."
    ),
    "concentrated_unstable": (
        "%s leads current contribution, while the predictive layer flags recent instability."
    ),
    "uneven_growth": (
        "The overall forecast points up, but %s remains materially behind the leading group."
    ),
    "nothing": (
        "Prescriptive readiness is %s, and the current evidence does not justify stronger"
        " interventions."
    ),
}
ACTIONS = {
    "concentration_high": (
        "Reduce reliance on %s by protecting secondary %s contributors and rebalancing growth"
        " efforts."
    ),
    "concentration_moderate": (
        "Protect the leading %s while developing secondary groups so overall performance is less"
        " dependent on one segment."
    ),
    "spread_wide": (
        "Investigate weak %s performance and test targeted actions to lift contribution before"
        " scaling them more broadly."
    ),
    "spread_moderate": (
        "Review what the stronger %s segments are doing well and adapt those practices for %s"
        " where feasible."
    ),
    "weak_mean": (
        "Improve efficiency in %s by reviewing pricing, mix, and execution rather than relying on"
        " volume alone."
    ),
    "efficient_follower": (
        "Consider scaling what works in %s to unlock growth without depending only on the current"
        " leading segment."
    ),
    "margin": (
        "Review discounting rules, pricing discipline, and segment-level margin guardrails before"
        " expanding promotions."
    ),
    "outlook_weak": (
        "Prepare a short-term response plan if %s does not recover, and protect core performance"
        " drivers over the next forecast periods."
    ),
    "outlook_up": (
        "Protect the conditions supporting recent momentum in %s and look for segments that can"
        " absorb incremental growth."
    ),
    "unstable": (
        "Monitor %s more frequently and phase actions carefully while recent volatility remains"
        " elevated."
    ),
    "limited": (
        "Use the forecast as a monitoring aid and re-evaluate once more historical depth is"
        " available."
    ),
    "dominant_down": (
        "Prioritize contingency planning for the leading segment and accelerate diversification"
        " into secondary contributors."
    ),
    "weak_uncertain": (
        "Improve efficiency in %s first, because weaker segment performance is combining with an"
        " uncertain near-term outlook."
    ),
    "concentrated_unstable": (
        "Protect high-contribution groups while reducing operational dependence on a single"
        " unstable performance driver."
    ),
    "uneven_growth": (
        "Use the improving outlook to selectively invest in lifting %s rather than concentrating"
        " all growth on already-strong segments."
    ),
    "nothing": (
        "Continue tracking the existing diagnostic and predictive signals before making more"
        " targeted decisions."
    ),
}
NO_ISSUE = "No recommendation triggered"
FINDING_READINESS = (
    "Prescriptive readiness is %s, so recommendation strength stays conservative."
)
FINDING_ISSUE = "The highest-priority issue is %s."
FINDING_COVERAGE = "Recommendation coverage spans %s."
FINDING_COMBINED = (
    "%d recommendation(s) are backed by both current-state and forecast evidence."
)
FINDING_OUTLOOK = "Predictive support is available and currently points %s in the short term."
FINDING_LIMITED = (
    "Predictive support is limited, so recommendations rely more heavily on diagnostic evidence."
)
FINDING_OFF = (
    "Prescriptive recommendations are currently limited because the supporting evidence path is"
    " not strong enough yet."
)
LIMIT_CONDITIONAL = "Recommendations are conditional because the evidence base is still maturing."
LIMIT_FORECAST = (
    "Predictive support is limited or unavailable, so recommendations lean more heavily on"
    " current-state diagnostic evidence."
)
LIMIT_OFF = (
    "Prescriptive recommendations require at least a usable diagnostic or predictive evidence path."
)

_RECOMMENDATION = "array<struct<" + ",".join(f"{f}:string" for f in FIELDS) + ">>"


def chosen_columns(facts: DataFrame) -> dict:
    """The column choices of a dataset: the one small collect between profiling and analysis."""
    choices = (
        I.diagnostic_enabled().alias("diagnostic"),
        I.forecast_enabled().alias("forecast"),
        I.prescriptive_enabled().alias("prescriptive"),
        F.get("diagnostic_metrics", F.lit(0)).alias("metric"),
        F.get("diagnostic_dimensions", F.lit(0)).alias("dimension"),
        F.get("forecast_metrics", F.lit(0)).alias("forecast_metric"),
        F.get("forecast_dates", F.lit(0)).alias("forecast_date"),
        *[f"{layer}_{part}" for layer in ("diagnostic", "predictive", "prescriptive")
          for part in ("status", "reason")],
    )
    with freed_shuffles(facts.sparkSession):
        return facts.select(*choices).first().asDict()


def evidence(
    frame: DataFrame, chosen: dict, by: Sequence[str] = (), horizon: int = 6, margin_named: int | None = 3
) -> DataFrame:
    """One row per key: diagnostic facts as struct ``d`` and forecast as struct ``p``.

    A layer that is not enabled stays a null struct. One aggregate over the raw rows is written, the
    layers are projections of it, and their rows are written again: rules, findings and reports read them.
    The layers are joined as numbers and names; texts, many times as wide, are made of the joined rows.
    Both layers carry the keys as one struct, so a key's rows move once in each layer and not again for joins.
    ``margin_named`` bounds the groups that the margin rule names, None for all.
    """
    wanted_d = [
        "group_count", "top", "bottom", "best_mean", "lowest_mean", "mean_of_means", "top_share",
        "gap", "spread", "concentration", "metric", "dimension", "margin_groups", "margin_text",
        "findings",
    ]
    wanted_p = [
        "status", "metric", "direction", "first_value", "latest_value", "volatility",
        "volatility_text", "messages", "findings", "periods", "status_reason", "readiness_reasons",
    ]
    diagnosed, predicted, own = None, None, by
    margins = D.margin_columns(frame) if chosen["diagnostic"] else None
    if chosen["diagnostic"] or chosen["forecast"]:
        folded = materialise(fold(
            frame, by, margins=margins,
            **({"dimension": chosen["dimension"], "metric": chosen["metric"]} if chosen["diagnostic"] else {}),
            **({"date": chosen["forecast_date"], "dated_metric": chosen["forecast_metric"]} if chosen["forecast"] else {}),
        ))
        if own:
            folded, by = one_key(folded, own), [KEY]
    if chosen["diagnostic"]:
        diagnosed = D.key_facts(group_totals(folded, by), by, margins is not None, margin_named=margin_named)
    if chosen["forecast"]:
        predicted = P.series_facts(daily_totals(folded, by), by)
    if diagnosed is not None and predicted is not None:
        rows = attach(_packed(diagnosed, by, "d"), _packed(predicted, by, "p"), by)
    elif diagnosed is not None:
        rows = _packed(diagnosed, by, "d")
    elif predicted is not None:
        rows = _packed(predicted, by, "p")
    else:
        rows = frame.groupBy(*columns_of(by)).agg(F.lit(1).alias("__one")).select(*columns_of(by))
    if diagnosed is not None:
        rows = D.with_findings(rows.select("*", "d.*"), chosen["metric"], chosen["dimension"])
        rows = _repacked(rows.withColumn("margin_text", D.margin_text()), by, "d", wanted_d, "p")
    else:
        rows = rows.withColumn("d", F.lit(None).cast(_struct_type(D_TYPES)))
    if predicted is not None:
        rows = P.described(
            rows.select("*", "p.*"), chosen["forecast_metric"], chosen["forecast_date"], horizon,
            chosen["predictive_status"], chosen["predictive_reason"],
        )
        rows = _repacked(rows.withColumn("volatility_text", P.volatility_text()), by, "p", wanted_p, "d")
    else:
        rows = rows.withColumn("p", F.lit(None).cast(_struct_type(P_TYPES)))
    rows = rows.select(*columns_of(by), "d", "p")
    return materialise(own_keys(rows, own) if by != own else rows)


def _packed(facts: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """The columns of ``facts`` besides the keys as one struct."""
    return facts.select(*columns_of(by), F.struct(*[quoted(c) for c in facts.columns if c not in by]).alias(name))


def _repacked(rows: DataFrame, by: Sequence[str], name: str, wanted: Sequence[str], other: str) -> DataFrame:
    """Keys, ``other`` if it is there, and the wanted columns as the struct ``name``, null where it was null."""
    full = F.when(F.col(name).isNotNull(), F.struct(*wanted)).alias(name)
    return rows.select(*columns_of(by), *[c for c in rows.columns if c == other], full)


_ENTRY = "struct<name:string,value:double,mean:double>"
D_TYPES = {
    "group_count": "bigint", "top": _ENTRY, "bottom": _ENTRY, "best_mean": _ENTRY,
    "lowest_mean": _ENTRY, "mean_of_means": "double", "top_share": "double", "gap": "double",
    "spread": "string", "concentration": "string", "metric": "string", "dimension": "string",
    "margin_groups": "array<string>", "margin_text": "string", "findings": "array<string>",
}
P_TYPES = {
    "status": "string", "metric": "string", "direction": "string", "first_value": "double",
    "latest_value": "double", "volatility": "string", "volatility_text": "string",
    "messages": "array<string>", "findings": "array<string>", "periods": "bigint",
    "status_reason": "string", "readiness_reasons": "array<string>",
}


def _struct_type(types: dict[str, str]) -> str:
    return "struct<" + ",".join(f"{k}:{t}" for k, t in types.items()) + ">"


def _rules(readiness_status: str) -> Column:
    """All rules in evaluation order; a rule that does not fire is null."""
    text, d, p = F.format_string, F.col("d"), F.col("p")
    top, bottom, metric, dimension = d["top"]["name"], d["bottom"]["name"], d["metric"], d["dimension"]
    share, gap = fixed_text(d["top_share"], 1), fixed_text(d["gap"], 2)
    usable = p["status"] != V.NOT_READY
    direction, outlook = p["direction"], F.lower(p["direction"])
    first, latest = fixed_text(p["first_value"], 2), fixed_text(p["latest_value"], 2)
    volatile = usable & (p["volatility"] == P.VOLATILE)
    conditional = p["status"] == V.CONDITIONAL
    weakest, leader = d["lowest_mean"], d["best_mean"]

    def rule(key, fires, category, priority, affected, basis, evidence=None, action=()) -> Column:
        shown = evidence if isinstance(evidence, Column) else text(EVIDENCE[key], *(evidence or ()))
        priority = priority if isinstance(priority, Column) else F.lit(priority)
        affected = affected if isinstance(affected, Column) else F.lit(affected)
        values = (
            F.lit(category), priority, F.lit(ISSUES[key]), affected, shown,
            text(ACTIONS[key], *action), F.lit(basis),
        )
        return F.when(fires, F.struct(*[v.alias(f) for v, f in zip(values, FIELDS)]))

    return F.array(
        rule("concentration_high", d["concentration"] == "high", RISK, HIGH, top, FROM_DIAGNOSTIC,
             (top, share, metric), (top, dimension)),
        rule("concentration_moderate", d["concentration"] == "moderate", RISK, MEDIUM, top,
             FROM_DIAGNOSTIC, (top, dimension, share, metric), (dimension,)),
        rule("spread_wide", d["spread"] == "wide", GROWTH, HIGH, bottom, FROM_DIAGNOSTIC,
             (gap, metric), (bottom,)),
        rule("spread_moderate", d["spread"] == "moderate", GROWTH, MEDIUM, bottom, FROM_DIAGNOSTIC,
             (bottom, gap, metric), (dimension, bottom)),
        rule("weak_mean", weakest["mean"] < d["mean_of_means"] * D.WEAK_EFFICIENCY_SHARE, EFFICIENCY,
             MEDIUM, weakest["name"], FROM_DIAGNOSTIC,
             (weakest["name"], fixed_text(weakest["mean"], 2), fixed_text(d["mean_of_means"], 2)),
             (weakest["name"],)),
        rule("efficient_follower", leader["name"] != top, GROWTH, MEDIUM, leader["name"],
             FROM_DIAGNOSTIC, (leader["name"], fixed_text(leader["mean"], 2)), (leader["name"],)),
        rule("margin", F.size(d["margin_groups"]) > 0, EFFICIENCY, HIGH,
             F.array_join(d["margin_groups"], ", "), FROM_DIAGNOSTIC, d["margin_text"]),
        rule("outlook_weak", usable & direction.isin(P.DOWN, P.FLAT), RISK,
             F.when(direction == P.DOWN, HIGH).otherwise(MEDIUM), WHOLE_SERIES, FROM_FORECAST,
             (outlook, first, latest), (p["metric"],)),
        rule("outlook_up", usable & (direction == P.UP), GROWTH, MEDIUM, WHOLE_SERIES, FROM_FORECAST,
             (first, latest), (p["metric"],)),
        rule("unstable", volatile, MONITORING, MEDIUM, WHOLE_SERIES, FROM_FORECAST,
             p["volatility_text"], (p["metric"],)),
        rule("limited", conditional, MONITORING, LOW, WHOLE_SERIES, FROM_FORECAST),
        rule("dominant_down", (d["concentration"] == "high") & usable & (direction == P.DOWN), RISK,
             HIGH, top, FROM_BOTH, (top,)),
        rule("weak_uncertain", bottom.isNotNull() & conditional & direction.isin(P.DOWN, P.FLAT),
             EFFICIENCY, HIGH, bottom, FROM_BOTH, (bottom, outlook), (bottom,)),
        rule("concentrated_unstable", d["concentration"].isin("high", "moderate") & volatile, RISK,
             F.when(d["concentration"] == "high", HIGH).otherwise(MEDIUM), top, FROM_BOTH, (top,)),
        rule("uneven_growth", (d["spread"] == "wide") & (direction == P.UP), GROWTH, MEDIUM, bottom,
             FROM_BOTH, (bottom,), (bottom,)),
    )


def prescriptive(
    frame: DataFrame, chosen: dict, by: Sequence[str] = (), horizon: int = 6, margin_named: int | None = 3
) -> DataFrame:
    """One row per key: evidence, recommendations by priority, summary, findings, limitations."""
    rows = evidence(frame, chosen, by, horizon, margin_named)
    status = chosen["prescriptive_status"]
    if not chosen["prescriptive"]:
        nothing = F.array().cast("array<string>")
        return rows.withColumns(
            {
                "status": F.lit(status),
                "recommendations": F.array().cast(_RECOMMENDATION),
                "highest_priority_issue": F.lit(NO_ISSUE),
                "findings": F.array(F.lit(FINDING_OFF)),
                "limitations": F.array(F.lit(LIMIT_OFF)),
                "active_categories": nothing,
            }
        )
    fallback = F.struct(
        *[
            F.lit(v).alias(f)
            for v, f in zip(
                (MONITORING, LOW, ISSUES["nothing"], WHOLE_DATASET,
                 EVIDENCE["nothing"] % status.lower(), ACTIONS["nothing"], FROM_DIAGNOSTIC),
                FIELDS,
            )
        ]
    )
    fired = F.array_compact(_rules(status))
    rows = rows.withColumn("fired", fired)

    def of(priority: str) -> Column:
        return F.filter("fired", lambda r: r["priority"] == priority)

    ordered = F.concat(of(HIGH), of(MEDIUM), of(LOW))  # keeps rule order within a priority
    rows = rows.withColumn(
        "recommendations", F.when(F.size("fired") > 0, ordered).otherwise(F.array(fallback))
    ).drop("fired")
    categories = F.array_sort(F.array_distinct(F.transform("recommendations", lambda r: r["category"])))
    combined = F.size(F.filter("recommendations", lambda r: r["recommendation_basis"] == FROM_BOTH))
    p = F.col("p")
    usable = p.isNotNull() & (p["status"] != V.NOT_READY)
    rows = rows.withColumns(
        {
            "status": F.lit(status),
            "highest_priority_issue": F.get("recommendations", F.lit(0))["issue_detected"],
            "active_categories": categories,
        }
    )
    findings = F.array(
        F.lit(FINDING_READINESS % status.lower()),
        F.format_string(FINDING_ISSUE, F.lower("highest_priority_issue")),
        F.format_string(FINDING_COVERAGE, F.array_join("active_categories", ", ")),
        F.when(combined > 0, F.format_string(FINDING_COMBINED, combined)),
        F.when(usable, F.format_string(FINDING_OUTLOOK, F.lower(p["direction"]))).when(
            F.size(p["messages"]) > 0, FINDING_LIMITED
        ),
    )
    limitations = F.array(
        F.lit(LIMIT_CONDITIONAL if status == V.CONDITIONAL else None).cast("string"),
        F.when(~usable, F.lit(LIMIT_FORECAST)),
        F.when(~usable, F.get(p["messages"], F.lit(0))),
        F.when(~usable, F.get(p["messages"], F.lit(1))),
    )
    return rows.withColumns(
        {"findings": F.array_compact(findings), "limitations": F.array_compact(limitations)}
    )


# --- projections of the prescriptive row ---------------------------------------------------


def recommendations(result: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rows = numbered_items(result, by, "recommendations", "position", "r")
    return rows.select(*columns_of(by), "position", *[F.col(f"r.{f}").alias(f) for f in FIELDS])


def prescriptive_summary(result: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, top issue and the number of recommendations per category and basis."""

    def count(field: str, value: str) -> Column:
        return F.size(F.filter("recommendations", lambda r: r[field] == value)).cast("long")

    return result.select(
        *columns_of(by),
        F.size("recommendations").cast("long").alias("total_recommendations"),
        "highest_priority_issue",
        *[
            count("category", c).alias(c.lower().replace(" ", "_"))
            for c in (RISK, GROWTH, EFFICIENCY, MONITORING)
        ],
        *[
            count("recommendation_basis", b).alias(b.replace("-", "_"))
            for b in (FROM_DIAGNOSTIC, FROM_FORECAST, FROM_BOTH)
        ],
    )


def prescriptive_findings(result: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return numbered_items(result, by, "findings", "finding_order", "finding")


def prescriptive_limitations(result: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return numbered_items(result, by, "limitations", "limitation_order", "limitation")
