from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyscope.operators import columns as C
from tallyscope.operators import intelligence as I
from tallyscope.operators import prescriptive as X
from tallyscope.operators import report as R
from tallyscope.session import materialise
from tests import frames


def analysed(frame, by=()):
    chosen = X.chosen_columns(I.dataset_facts(C.column_stats(frame)))
    return chosen, X.prescriptive(frame, chosen, by)


ISSUE_ORDER = ["concentration_high", "spread_wide", "margin", "weak_mean", "outlook_up", "uneven_growth"]


def test_six_rules_in_order(spark):
    for frame in (
        frames.thirds_180(spark),
        frames.thirds_180(spark, (300, 110, 20), (70, 18, 1), (4, 12, 28)),
    ):
        chosen, result = analysed(frame)
        rows = X.recommendations(result).orderBy("position").collect()
        assert [r.issue_detected for r in rows] == [X.ISSUES[k] for k in ISSUE_ORDER]
        assert [r.priority for r in rows] == ["High"] * 3 + ["Medium"] * 3
        assert rows[2].affected_group == "West"
        # the affected group, evidence and action are texts without gaps
        assert all(all(v is not None and "null" not in str(v) for v in r) for r in rows)


def test_forecast_of_thirds(spark):
    from tallyscope.operators import predictive as P

    points = P.forecast_projection(P.forecast(frames.thirds_180(spark), "net_revenue", "order_date"))
    values = [r.metric_value for r in points.orderBy("step").collect()]
    assert values[0] == 236.0 and values[-1] == 208.0


def test_conditional_rules(spark):
    chosen, result = analysed(frames.report_90(spark))
    assert chosen["predictive_status"] == "Conditional"
    rows = X.recommendations(result).orderBy("position").collect()
    keys = ["outlook_weak", "weak_uncertain", "concentration_moderate", "limited"]
    assert [r.issue_detected for r in rows] == [X.ISSUES[k] for k in keys]
    assert [r.priority for r in rows] == ["High", "High", "Medium", "Low"]
    summary = X.prescriptive_summary(result).first()
    assert (summary.total_recommendations, summary.combined, summary.risk_controls) == (4, 1, 2)
    found = [r.finding for r in X.prescriptive_findings(result).orderBy("finding_order").collect()]
    assert found[1] == "The highest-priority issue is forecast indicates weak near-term trajectory."
    assert found[3].startswith("1 recommendation(s) are backed by both")
    assert [r.limitation for r in X.prescriptive_limitations(result).collect()] == [X.LIMIT_CONDITIONAL]


def test_limited_result(spark):
    frame = frames.frame(spark, sales_amount=[10, 12, 15, 13, 16], profit=[3, 4, 5, 3, 6])
    chosen, result = analysed(frame)
    assert chosen["prescriptive"] is False
    assert X.recommendations(result).collect() == []
    row = X.prescriptive_summary(result).first()
    assert (row.total_recommendations, row.highest_priority_issue) == (0, X.NO_ISSUE)
    assert [r.finding for r in X.prescriptive_findings(result).collect()] == [X.FINDING_OFF]


def test_one_key_equals_no_key(spark):
    frame = frames.thirds_180(spark)
    chosen, alone = analysed(frame)
    keyed = X.prescriptive(frame.withColumn("k", F.lit("x")), chosen, ["k"])
    a = X.recommendations(alone).collect()
    b = X.recommendations(keyed, ["k"]).drop("k").collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_null_keys_have_their_own_row(spark):
    frame = frames.thirds_180(spark)
    chosen, alone = analysed(frame)
    both = F.explode(F.array(F.lit(None).cast("string"), F.lit("x")))
    keyed = X.prescriptive(frame.select("*", both.alias("k"), F.lit(None).cast("int").alias("n")), chosen, ["k", "n"])
    wanted = sorted(map(str, X.recommendations(alone).collect()))
    rows = X.recommendations(keyed, ["k", "n"])
    for key in ("k is null", "k = 'x'"):
        assert sorted(map(str, rows.where(key).drop("k", "n").collect())) == wanted


def test_rows_of_a_key_move_once_in_each_layer(spark, monkeypatch):
    """Joins that match null keys by two expressions would shuffle every side again."""
    written = []
    monkeypatch.setattr(X, "materialise", lambda frame: written.append(frame) or materialise(frame))
    frame = frames.thirds_180(spark)
    chosen = X.chosen_columns(I.dataset_facts(C.column_stats(frame)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        X.evidence(frame.withColumn("k", F.col("region")), chosen, ["k"])
        plan = written[-1]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "hashpartitioning" in plan
    assert "hashpartitioning(coalesce(" not in plan


def test_report(spark, tmp_path):
    from tallyscope.operators import narrative as N
    from tallyscope.sources.report_text import read_report_text, write_report_text

    frame = frames.report_90(spark)
    run = R.assess(frame)
    sections = R.report_sections(run, "sample.csv", "1.0 KB")
    lines = R.report_lines(sections).collect()
    assert {r.section for r in lines} == set(R.TITLES)
    texts = [r.item for r in lines]
    for wanted in ("Total rows: 90", "Dataset name: sample.csv", "File size: 1.0 KB", "Primary metric reviewed: net_revenue",
                   "Historical periods used: 90", "Duplicate rows detected: 0"):
        assert wanted in texts
    text = R.report_text(sections, (), "sample.csv", "2026-01-01 00:00:00").first().report
    head = text.split("\n")
    assert head[:4] == ["Business Insight Report", "Dataset: sample.csv", "Generated: 2026-01-01 00:00:00", ""]
    assert head[4:6] == ["Data Quality Summary", "--------------------"] and text.endswith("\n")
    preview = R.report_text(sections, (), max_sections=R.PREVIEW_SECTIONS).first().report
    assert "Descriptive Analytics Summary" in preview and "Diagnostic Analytics Summary" not in preview

    story = spark.createDataFrame([(1, "###\n- ok\n11111\nrevenue is stable")], "id long, t string")
    told = R.report_sections(run, narrative=N.narrative_for_report(story, "id", "t"))
    last = [r.item for r in R.report_lines(told).where(F.col("section") == R.NARRATIVE_TITLE).collect()]
    assert "Revenue is stable" in last

    facts = R.insight_facts(run).orderBy("fact_order").collect()
    assert [r.kind for r in facts].count("KPI") == 3 and [r.kind for r in facts].count("Recommendation") == 2
    assert R.fallback_summary(run).first().summary.startswith("Compact fallback summary\n\n- Dataset type: ")

    by_region = R.assess(frame, ["region"])
    reports = R.report_text(R.report_sections(by_region), ["region"])
    path = str(tmp_path / "reports")
    write_report_text(reports, path, ["region"])
    back = spark.read.text(path, wholetext=True).collect()
    assert {r.region for r in back} == {"North", "South", "West"}
    assert all(r.value.startswith("Business Insight Report\n") for r in back)
    again = R.report_text(R.report_sections(by_region).where("region = 'West'"), ["region"], generated_at="later")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_report_text(again, path, ["region"])
    write_report_text(again, path, ["region"], replace=True)
    kept = {r.region: r.report for r in read_report_text(spark, path, ["region"]).collect()}
    assert kept["West"] == again.first().report and "Generated: later" in kept["West"]
    assert kept == {r.region: r.report for r in reports.where("region != 'West'").collect()} | {"West": kept["West"]}


def test_layers_are_joined_before_their_texts_are_made(spark, monkeypatch):
    """The join of both layers sorts rows of a key's numbers; with the texts they are many times as wide."""
    written = []
    monkeypatch.setattr(X, "materialise", lambda frame: written.append(frame) or frame)
    frame = frames.thirds_180(spark)
    chosen = X.chosen_columns(I.dataset_facts(C.column_stats(frame)))
    X.evidence(frame, chosen, ["region"])
    plan = written[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" in plan and "Join" in plan
    assert "format_string" not in plan[plan.index("Join") :]
