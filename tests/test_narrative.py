from __future__ import annotations

from tallyscope.operators import narrative as N


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, t string")


def items(spark, text):
    rows = N.narrative_items(docs(spark, text), "id", "t").orderBy("position").collect()
    return [r.item for r in rows]


CLEAN = (
    "Executive Summary:\n- revenue remains stable.\nKey Insights:\n- top segment concentration remains"
    " meaningful.\nRisks:\n- margin pressure persists.\nRecommended Actions:\n- protect pricing discipline.\n"
)
SQUASHED = (
    "ExecutiveSummary:\n- revenue remains stable.\n- revenue remains stable.\n\nRisks:\n"
    "* margin pressure may persist..\nRecommendedActions:\n- protect pricing discipline\n"
)


def test_clean_text(spark):
    got = items(spark, CLEAN)
    assert got[0] == "Executive Summary" and "Revenue remains stable." in got


def test_squashed_headings_and_repeats(spark):
    got = items(spark, SQUASHED)
    assert got == [
        "Executive Summary", "Revenue remains stable.", "Risks", "Margin pressure may persist.",
        "Recommended Actions", "Protect pricing discipline",
    ]
    quality = N.narrative_quality(docs(spark, SQUASHED), "id", "t").first()
    assert quality.passes is True and quality.unique_count == 3


def test_weak_text_keeps_its_short_form(spark):
    weak = "###\n- ok\n11111\nrevenue is stable"
    frame = docs(spark, weak)
    quality = N.narrative_quality(frame, "id", "t").first()
    assert (quality.passes, quality.reason) == (False, N.REASON_MALFORMED)
    short = [r.item for r in N.narrative_short(frame, "id", "t").orderBy("position").collect()]
    assert "Revenue is stable" in short
    assert N.narrative_for_report(frame, "id", "t").first().items == short


def test_lines_before_any_heading_and_caps(spark):
    got = items(spark, "\n".join(f"line number {w}" for w in ("one", "two", "three", "four")))
    assert got == ["Key Insights", "Line number one", "Line number two", "Line number three"]


def test_empty_and_missing_text(spark):
    rows = N.narrative_quality(docs(spark, "", None, "only one useful line"), "id", "t").orderBy("doc_id").collect()
    assert [r.reason for r in rows] == [N.REASON_EMPTY, N.REASON_EMPTY, N.REASON_THIN]


def test_punctuation_numbering_and_line_ends(spark):
    got = items(spark, "Risks\r\n1. costs rise , then fall ;; soon\r- Risks: demand  weakens !!")
    assert got == ["Risks", "Costs rise, then fall; soon", "Demand weakens !"]


def test_repeated_characters_are_malformed(spark):
    frame = docs(spark, "aaaaaaaaaaaa\nzzzzzz zzzzzz\nthis is a good line")
    assert N.narrative_quality(frame, "id", "t").first().malformed_count == 2


def test_no_shuffle(spark):
    for op in (N.narrative_lines, N.narrative_sections, N.narrative_quality, N.narrative_short):
        plan = op(docs(spark, CLEAN), "id", "t")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_source_text_is_split_once(spark):
    import tempfile

    from tallyscope.sources.tables import narratives

    folder = tempfile.mkdtemp()
    texts = ["a", "", None, "\n".join("line %d" % i for i in range(12)), "1\n2", "\n\n\n\n\n\n\n\n\n\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    made = narratives(spark, folder)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("split(text") == 1
    rows = {r.doc_id: r.narrative for r in made.collect()}
    head = "ExecutiveSummary:\n- {0}\n- {0}\n\nKey Insights :"
    assert rows[0] == head.format("a") + "\n## Risks\nRecommendedActions:"
    assert rows[1] == head.format("") + "\n## Risks\nRecommendedActions:"
    assert rows[2] == "ExecutiveSummary:\n\nKey Insights :\n## Risks\nRecommendedActions:"
    assert rows[4] == head.format("1") + "\n* 2\n## Risks\nRecommendedActions:"
    assert rows[3].endswith("## Risks\n1. line 5\n2.  line 6\n2.  line 7\nRecommendedActions:\n- line 8 ..\n-line 9 ..\n-line 10 ..\n-line 11")


def test_patterns_equal_the_plain_ones(spark):
    import random

    from pyspark.sql import functions as F

    blank = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    every = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    one = spark.createDataFrame([(c,) for c in every], "t string")
    for new, old in ((N.BLANK, blank), (N.NOT_SPACE, f"[{blank}&&[^ ]]")):
        assert one.where(F.col("t").rlike(new) != F.col("t").rlike(old)).count() == 0
    assert one.where(F.col("t").rlike(N.BLANK)).count() == 29
    pick = random.Random(3)
    signs = list("aZ  \t\n.,;:!?-#") + ["\u00a0", "\u2028", "\u3000", "\U0001f600"]
    texts = spark.createDataFrame([("".join(pick.choices(signs, k=30)),) for _ in range(3000)], "t string")
    for new, old, to in (
        (N.SPACE_BEFORE_MARK, blank + r"+([,.;:])", "$1"), (N.REPEATED_MARK, r"([:;,.!?]){2,}", "$1"),
        (N.SPACES_OR_TABS, r"[ \t]+", " "), (N.BLANKS, blank + "+", " "),
    ):
        assert texts.where(F.regexp_replace("t", new, to) != F.regexp_replace("t", old, to)).count() == 0


def test_items_after_the_cap_are_not_normalised(spark):
    """One pass per section, which ends its work at the cap."""
    plan = N.narrative_quality(docs(spark, CLEAN), "id", "t")._jdf.queryExecution().optimizedPlan().toString()
    assert "array_position" not in plan and plan.count("aggregate(") == 5


def test_headings_in_odd_forms(spark):
    text = "##KEY INSIGHTS:\nfirst point here\n\u00a0-- rIsKs ##\nsecond point here\nexecutive summaries\n\u212aey insights\nthird"
    got = items(spark, text)
    assert got == ["Key Insights", "First point here", "Third", "Risks", "Second point here", "Executive summaries"]
