"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

``measures`` adds the counts of a text, ``ratios`` what rules look at, and ``RULES`` is the table: a
ratio's name with its least and greatest allowed value. ``verdict`` turns the table into one boolean
column plus the list of broken rules. There is no shuffle: a row is judged by itself.

Repeated three-word windows are compared by their 64-bit hash; sorting (hash, position) pairs brings
equal ones together. The stop-word rule asks only texts in Latin letters, told by fewer than 1.5 bytes a code
point: its words are those of four languages, and texts in other scripts can't hold them. Null text counts as empty: no words, base_failed. A text of white space only, or
of one endless word, is a text like others. Repeated rows and null ids are judged one by one; columns
of the input named like a result are replaced, others are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import documents, text_bytes

# Common function words of four languages.
STOP_WORDS = (
    "the of and to in is that was for with as on be are by this from or at it "
    "der die das und ist nicht von mit ein eine zu den im auf für des dem sich auch "
    "le la les de des et un une du est que qui dans pour par sur avec en "
    "el los las y un una del que por con para se no es al su lo"
).split()

#: ratio: (least, greatest) allowed value; None where that side is open.
RULES: dict[str, tuple[float | None, float | None]] = {
    "mean_word_chars": (1.5, 20.0),
    "symbols_per_word": (None, 0.5),
    "dup_line_share": (None, 0.5),
    "stop_word_share": (0.01, None),
}
SPACE = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"


def measures(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_stop_words, n_repeat_words."""
    text = text_bytes(text_column)
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select(
        "doc_id",
        F.length(F.translate("text", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.octet_length("text") * 2 <= F.length("text") * 3).alias("is_latin"),
        lines.alias("lines"),
        F.array_remove(F.split("text", SPACE), "").alias("words"),
    )
    n = F.size("words")
    # a window starts at each word but the last two
    windows = F.slice(
        F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), 1, F.greatest(n - 2, F.lit(0))
    )
    rows = rows.select(
        "doc_id", "word_chars", "n_symbols", "is_latin",
        n.cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        windows.alias("windows"),
    )
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("windows", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs))

    def repeated(x: Column, j: Column) -> Column:
        before, after = F.get("windows", j - 1)["h"], F.get("windows", j + 1)["h"]
        return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

    starts = F.transform(F.filter("windows", repeated), lambda x: x["i"])
    covered = F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2))))
    n_repeat = F.when(F.col("windows").isNull(), F.lit(0)).otherwise(F.size(covered))
    return rows.withColumn("n_repeat_words", n_repeat.cast("long")).drop("windows")


def ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "stop_word_share": F.when(F.col("is_latin"), F.col("n_stop_words") / words),
    }


def broken(rules: dict[str, tuple[float | None, float | None]]) -> Column:
    """Names of the broken rules, compiled from the table; a ratio that is null breaks none."""
    value, checks = ratios(), []
    for name, (least, most) in rules.items():
        too_low = value[name] < least if least is not None else F.lit(False)
        too_high = value[name] > most if most is not None else F.lit(False)
        checks.append(F.when(too_low | too_high, F.lit(name)))
    return F.array_compact(F.array(*checks))


def judge(docs: DataFrame, rules: dict[str, tuple[float | None, float | None]] | None = None, text_column: str = "text") -> DataFrame:
    """Counts, base_failed, kept and the broken rules of every row."""
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    found = measures(docs, text_column).withColumns({"base_failed": base, "broken_rules": broken(rules or RULES)})
    return found.withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_stop_words", F.array_join("broken_rules", ",").alias("broken_rules"),
    )
