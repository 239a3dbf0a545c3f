"""Cleaning, sectioning and quality gates for narrative text, one document per row.

Everything happens inside the row with array expressions: no shuffle, so neither many documents
nor one very long document changes the plan. Each step is linear in the length of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyscope import fixed_values as V
from tallyscope.functions.coerce import let, strip
from tallyscope.functions.naming import quoted
from tallyscope.operators.shape import numbered_items

# Patterns. Blank means any white space, also beyond ASCII. A class is tested member by member at every
# character; the ranges before && turn most characters away at once.
_BLANKS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANK = r"[\x00-\x20\x85-\uffff&&" + _BLANKS + "]"
NOT_SPACE = r"[\x00-\x1f\x85-\uffff&&" + _BLANKS + "]"  # a blank other than the space
BULLET = r"(?md)^[-*\u2022]" + BLANK + "*"
SQUASHED_HEADING = r"(?md)^([A-Z])([a-z]+)([A-Z][a-z]+):" + BLANK + "*$"
SPACE_BEFORE_MARK = BLANK + r"++([,.;:])"
REPEATED_MARK = r"[:;,.!?]+([:;,.!?])"
# runs that one space replaces, but for those that are one already
SPACES_OR_TABS = r"[ \t]{2,}|\t"
BLANKS = " " + BLANK + "+|" + NOT_SPACE + BLANK + "*"
LINE_BREAKS = r"[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
NUMBERING = r"^\p{Nd}+\." + BLANK + "*"
LEADING_SECTION = (
    r"^(?i)(executive summary|key insights|risks|recommended actions)" + BLANK + "*:" + BLANK + "*"
)
MAY_BE_HEADING = "^(?:[#-]|" + BLANK + ")*(?iu:executive|key|risks|recommended)"
REPEATED_CHARACTER = r"([^\n])\1{4,}"
MIN_LINE_LENGTH = 8
MIN_LETTER_SHARE = 0.45
REASON_EMPTY = "No usable AI content was produced."
REASON_THIN = "AI output is too thin to include in the report."
REASON_MALFORMED = "AI output looks malformed after cleanup."


def _clean_line(line: Column) -> Column:
    tidy = F.regexp_replace(
        F.regexp_replace(strip(line), SPACE_BEFORE_MARK, "$1"), REPEATED_MARK, "$1"
    )

    def repaired(tidied: Column) -> Column:
        line_words = F.lower(F.rtrim(tidied, F.lit(":")))
        squashed = {s.replace(" ", "").lower(): s + ":" for s in V.NARRATIVE_SECTIONS}
        names = F.create_map(*[F.lit(x) for pair in squashed.items() for x in pair])
        short = F.length(tidied) <= max(map(len, squashed)) + 1  # a tidy line ends with one mark at most
        return F.coalesce(F.when(short, F.try_element_at(names, line_words)), tidied)

    return let(tidy, repaired)


def cleaned_text(text: Column) -> Column:
    """Normalised line ends, blanks, bullets, punctuation and headings."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, SPACES_OR_TABS, " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, BULLET, "- ")
    t = F.regexp_replace(t, SQUASHED_HEADING, "$1$2 $3:")
    return strip(F.array_join(F.transform(F.split(t, "\n"), _clean_line), "\n"))


def _heading(line: Column) -> Column:
    """The section a line announces, null for content."""
    bare = F.btrim(F.btrim(strip(line), F.lit("#")), F.lit("-"))
    bare = F.lower(F.rtrim(strip(bare), F.lit(":")))
    names = F.create_map(*[F.lit(x) for s in V.NARRATIVE_SECTIONS for x in (s.lower(), s)])
    return F.when(line.rlike(MAY_BE_HEADING), F.try_element_at(names, bare))


def _content(line: Column) -> Column:
    """One line without bullet, numbering or repeated heading, starting with a capital."""
    c = strip(F.ltrim(line, F.lit("-* ")))
    c = F.regexp_replace(F.regexp_replace(c, NUMBERING, ""), LEADING_SECTION, "")
    c = F.btrim(F.regexp_replace(c, BLANKS, " "), F.lit(" -"))
    return let(
        c, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)))
    )


def comparable(text: Column) -> Column:
    """Lower-case letters and digits only, for duplicate detection."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _first_different(items: Column, limit: int | None) -> Column:
    """The items that differ after normalisation, in order, at most ``limit``.

    One pass; once the limit is reached, the items after it are not normalised.
    """

    def add(done: Column, item: Column) -> Column:
        def added(key: Column) -> Column:
            new = (key != "") & ~F.array_contains(done["keys"], key)
            more = F.struct(F.array_append(done["keys"], key).alias("keys"), F.array_append(done["items"], item).alias("items"))
            return F.when(new, more).otherwise(done)

        grown = let(comparable(item), added)
        return grown if limit is None else F.when(F.size(done["keys"]) < limit, grown).otherwise(done)

    none = F.array().cast("array<string>")
    return F.aggregate(items, F.struct(none.alias("keys"), none.alias("items")), add, lambda done: done["items"])


def structured(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Per document: cleaned text, the kept items of each section, quality and short summary."""
    rows = documents.select(
        quoted(key).alias("doc_id"), cleaned_text(quoted(text)).alias("cleaned")
    )
    lines = F.filter(
        F.transform(F.split("cleaned", LINE_BREAKS), strip), lambda line: line != ""
    )
    rows = rows.withColumn("lines", lines)
    marked = F.transform(
        "lines",
        lambda line: F.coalesce(F.concat(F.lit("\n"), _heading(line)), _content(line)),
    )
    rows = rows.withColumn("marked", F.filter(marked, lambda m: m != ""))
    # items never hold a line feed, so an empty line announces a heading and nothing else
    blocks = F.split(
        F.concat_ws("\n", F.lit(V.NARRATIVE_DEFAULT_SECTION), F.array_join("marked", "\n")), "\n\n"
    )
    rows = rows.withColumn("blocks", F.transform(blocks, lambda b: F.split(b, "\n")))

    def items(section: str, cap: int) -> Column:
        own = F.filter("blocks", lambda b: F.get(b, F.lit(0)) == section)
        content = F.flatten(
            F.transform(own, lambda b: F.filter(b, lambda x, i: (i > 0) & (x != "")))
        )
        return _first_different(content, cap)

    names = [f"s{i}" for i in range(len(V.NARRATIVE_SECTIONS))]
    rows = rows.withColumns(
        {
            n: items(s, cap)
            for n, s, cap in zip(names, V.NARRATIVE_SECTIONS, V.NARRATIVE_CAPS)
        }
    )
    empty = F.array().cast("array<string>")
    flat = F.concat(
        *[
            F.when(F.size(n) > 0, F.concat(F.array(F.lit(s)), F.col(n))).otherwise(empty)
            for n, s in zip(names, V.NARRATIVE_SECTIONS)
        ]
    )
    section_rows = F.concat(
        *[
            F.transform(
                n, lambda x, i: F.struct(
                    F.lit(o + 1).cast("long").alias("section_order"), F.lit(s).alias("section"),
                    (i + 1).cast("long").alias("item_order"), x.alias("item"),
                )
            )
            for o, (n, s) in enumerate(zip(names, V.NARRATIVE_SECTIONS))
        ]
    )
    rows = rows.select("doc_id", "cleaned", flat.alias("items"), section_rows.alias("sections"))
    content = F.filter("items", lambda i: ~i.isin(*V.NARRATIVE_SECTIONS))
    rows = rows.withColumn("content", content)
    rows = rows.withColumn("unique_items", _first_different(F.col("content"), None))
    bad = F.size(F.filter("unique_items", looks_malformed))
    unique = F.size("unique_items")
    reason = (
        F.when(F.size("content") == 0, REASON_EMPTY)
        .when(unique < 2, REASON_THIN)
        .when(bad >= F.greatest(F.lit(2), F.floor(unique / 2)), REASON_MALFORMED)
        .otherwise("")
    )
    return rows.withColumns(
        {
            "unique_count": unique.cast("long"),
            "malformed_count": bad.cast("long"),
            "reason": reason,
            "passes": reason == "",
            "short": F.slice("content", 1, 4),
        }
    )


def looks_malformed(line: Column) -> Column:
    letters = F.length(F.regexp_replace(line, r"[^\p{L}]", ""))
    return (
        (F.length(line) < MIN_LINE_LENGTH)
        | line.rlike(REPEATED_CHARACTER)
        | (letters / F.greatest(F.length(line), F.lit(1)) < MIN_LETTER_SHARE)
    )


def _numbered(rows: DataFrame, array: str | Column, name: str) -> DataFrame:
    return numbered_items(rows, ["doc_id"], array, "position", name)


def narrative_lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The cleaned lines that are not empty, with their line number."""
    rows = documents.select(quoted(key).alias("doc_id"), cleaned_text(quoted(text)).alias("cleaned"))
    return _numbered(rows, F.split("cleaned", "\n"), "line").where("line <> ''")


def narrative_sections(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The kept items per section, in report order."""
    rows = structured(documents, key, text).select("doc_id", F.inline_outer("sections"))
    return rows.where("item is not null")


def narrative_items(documents: DataFrame, key: str, text: str) -> DataFrame:
    """The flat list: each section name followed by its items."""
    return _numbered(structured(documents, key, text), "items", "item")


def narrative_quality(documents: DataFrame, key: str, text: str) -> DataFrame:
    return structured(documents, key, text).select(
        "doc_id", "unique_count", "malformed_count", "passes", "reason"
    )


def narrative_short(documents: DataFrame, key: str, text: str) -> DataFrame:
    return _numbered(structured(documents, key, text), "short", "item")


def narrative_for_report(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Per document the lines a report shows: all of them, or the short form of a weak text."""
    rows = structured(documents, key, text)
    return rows.select(
        "doc_id", F.when(F.col("passes"), F.col("items")).otherwise(F.col("short")).alias("items")
    )
