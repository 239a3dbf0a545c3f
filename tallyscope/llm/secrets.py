"""Secret scans with multipart credential linking, in DataFrame operations only.

Three base kinds are found by pattern: ``assign`` (a value given to a password-like name), ``access``
(access identifiers) and ``hex`` (long hexadecimal keys). Three weak kinds mean little alone:
``ident`` (a user or account name), ``endpoint`` (a service address) and ``secret`` (a long mixed
string). Parts are joined as intervals within a scope, a block of text without blank lines:
a weak part is reported only if a part that completes it lies before or after it in the same scope, without
overlapping it, however far away (``near`` may bound that). ``secret`` is completed by an access
identifier, an ``ident`` or an ``endpoint``; the other two by an assignment, a hex key or a ``secret``.
Weak parts that overlap a base part are never reported.

Matches are taken with their lengths and those of the pieces between them, so a running sum gives
places. The interval join is windows over the parts of a text: each part sees the last complement of a kind
that ends before it and the first that starts behind it, which is linear in the parts, never a list of
pairs. Parts of one kind don't overlap each other, so if the next one by place overlaps the weak part, the one
beyond it doesn't. One shuffle carries the parts, keyed by id and text; equal rows are folded before it and counted.

Null text counts as empty. Every row gets a result, repeated rows the same one, also with null
ids. A text of any length is scanned whole. Other columns are ignored. Places are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.functions.naming import quoted
from tallyscope.llm.common import documents, text_bytes, unused

# Fixed patterns: the base kinds. Runs of hexadecimal digits below 32 are left out by the pattern itself.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
IDENT = r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]+"""
ENDPOINT = r"""(?:https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+"""
SECRET = r"[A-Za-z0-9/+_-]{20,}={0,2}"
SCOPE = r"\n[\x20\t\r]*\n"

#: Kind, pattern, and which matches count.
KINDS = (
    ("assign", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8),
    ("access", ACCESS, lambda m: F.length(m) >= 16),
    ("hex", HEX, lambda m: F.lit(True)),
    ("ident", IDENT, lambda m: F.lit(True)),
    ("endpoint", ENDPOINT, lambda m: F.lit(True)),
    ("secret", SECRET, lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")),
    ("scope", SCOPE, lambda m: F.lit(True)),
)
NUMBER = {kind: i for i, (kind, _, _) in enumerate(KINDS)}
BASE = ("assign", "access", "hex")
COMPLETES = {
    "secret": ("access", "ident", "endpoint"),
    "ident": ("assign", "hex", "secret"),
    "endpoint": ("assign", "hex", "secret"),
}


def row_key(doc_id: Column | str = "doc_id", text: Column | None = None) -> Column:
    """Tells rows of different id or text apart."""
    text = text_bytes() if text is None else text
    return F.sha2(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit("/"), text).cast("binary"), 256)


def parts(docs: DataFrame) -> DataFrame:
    """row_key, doc_id and copies with one row per match in order (an empty one for texts without)."""
    rows = docs.select("doc_id", row_key().alias("row_key"), text_bytes().alias("text"))
    rows = rows.select("*", *(F.expr("regexp_extract_all(text, {}, 0)".format(_quoted(p))).alias(k) for k, p, _ in KINDS[:-1]))
    # scopes matter only where a weak part stands
    weak = F.size("ident") + F.size("endpoint") + F.size("secret") > 0
    empty = F.array().cast("array<string>")
    rows = rows.withColumn("scope", F.when(weak, F.expr(f"regexp_extract_all(text, {_quoted(SCOPE)}, 0)")).otherwise(empty))
    for kind, pattern, _ in KINDS:
        between = F.when(F.size(kind) > 0, F.transform(F.split("text", pattern, -1), F.length))
        rows = rows.withColumn(f"{kind}_gaps", between)

    def found(kind: str, counts) -> Column:
        def one(match: Column, i: Column) -> Column:
            return F.struct(
                F.lit(NUMBER[kind]).alias("kind"), i.alias("i"), F.get(f"{kind}_gaps", i).alias("gap"),
                F.length(match).alias("length"), counts(match).alias("counts"),
            )

        return F.transform(kind, one)

    every = F.concat(*(found(kind, counts) for kind, _, counts in KINDS))
    rows = rows.select("row_key", "doc_id", every.alias("parts"))
    folded = rows.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"), F.first("parts").alias("parts"), F.count("*").alias("copies")
    )
    return folded.select("row_key", "doc_id", "copies", F.explode_outer("parts").alias("part")).select(
        "row_key", "doc_id", "copies", "part.*"
    )


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def link(found: DataFrame, near: int | None = None) -> DataFrame:
    """Places of all parts, and whether they are reported. The scope bounds where a complement may stand;
    ``near`` bounds the characters between as well."""
    earlier = (Window.unboundedPreceding, -1)
    of_kind = Window.partitionBy("row_key", "kind").orderBy("i")
    rows = found.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(of_kind.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("end") - F.col("length"))
    counted = [F.when(F.col("counts"), F.col(c)) for c in ("start", "end")]
    later = Window.partitionBy("row_key", "kind").orderBy(F.desc("i")).rowsBetween(*earlier)
    rows = rows.withColumn("end_before", F.last(counted[1], ignorenulls=True).over(of_kind.rowsBetween(*earlier)))
    rows = rows.withColumn("start_after", F.last(counted[0], ignorenulls=True).over(later))
    # matches that don't count stay as rows without a kind, so that no text is lost
    rows = rows.withColumn("kind", F.when(F.col("counts"), F.col("kind")))
    text = Window.partitionBy("row_key")
    before = text.orderBy("start", "kind", "end").rowsBetween(*earlier)
    # frames that grow from the end of the text: one that shrinks is computed anew for every row
    behind = text.orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(*earlier)
    past = text.orderBy(F.desc("end"), F.desc("kind"), F.desc("start")).rowsBetween(*earlier)
    is_base = F.col("kind") < len(BASE)
    is_scope = F.col("kind") == NUMBER["scope"]
    beside_parts = {
        "scope_start": F.max(F.when(is_scope, F.col("start"))).over(before),
        "scope_end": F.min(F.when(is_scope, F.col("start"))).over(behind),
        "base_end": F.max(F.when(is_base, F.col("end"))).over(before),
        "base_start": F.min(F.when(is_base, F.col("start"))).over(behind),
    }
    for kind in sorted({k for others in COMPLETES.values() for k in others}):
        of = F.col("kind") == NUMBER[kind]
        beside_parts[f"{kind}_before"] = F.last(F.when(of, F.struct("end", F.col("end_before").alias("other"))), ignorenulls=True).over(before)
        beside_parts[f"{kind}_after"] = F.last(F.when(of, F.struct("start", F.col("start_after").alias("other"))), ignorenulls=True).over(past)
    rows = rows.withColumns(beside_parts)
    reported = is_base
    clear = (F.coalesce("base_end", F.lit(-1)) <= F.col("start")) & (F.coalesce("base_start", F.col("end")) >= F.col("end"))
    for weak, others in COMPLETES.items():
        ends = [F.when(F.col(f"{k}_before.end") <= F.col("start"), F.col(f"{k}_before.end")).otherwise(F.col(f"{k}_before.other")) for k in others]
        starts = [F.when(F.col(f"{k}_after.start") >= F.col("end"), F.col(f"{k}_after.start")).otherwise(F.col(f"{k}_after.other")) for k in others]
        end, start = F.greatest(*ends), F.least(*starts)
        # no part holds a line break, so it lies wholly before or behind the end of a scope
        ahead = end > F.coalesce("scope_start", F.lit(-1))
        after = start < F.coalesce("scope_end", start + 1)
        if near is not None:
            ahead, after = ahead & (F.col("start") - end <= near), after & (start - F.col("end") <= near)
        beside = F.coalesce(ahead, F.lit(False)) | F.coalesce(after, F.lit(False))
        reported = reported | ((F.col("kind") == NUMBER[weak]) & clear & beside)
    return rows.select("row_key", "doc_id", "copies", "kind", "start", "end", F.coalesce(reported, F.lit(False)).alias("reported"))


def find_secrets(docs: DataFrame, near: int | None = None) -> DataFrame:
    """One row per different row of ``docs``: row_key, doc_id, copies, and its spans in order."""
    span = F.struct(F.col("start").cast("long").alias("start"), F.col("kind"), F.col("end").cast("long").alias("end"))
    return (
        link(parts(docs), near)
        .groupBy("row_key")
        .agg(
            F.first("doc_id").alias("doc_id"), F.first("copies").alias("copies"),
            F.array_sort(F.collect_list(F.when(F.col("reported"), span))).alias("spans"),
        )
    )


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(kind) for kind, _, _ in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, near: int | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, digest of base spans and all spans, for every row."""
    rows = find_secrets(docs, near)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == NUMBER[kind])).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    rows = rows.select(
        "doc_id", *(count(k) for k in BASE), F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return rows.drop("copy")


def redact(docs: DataFrame, mark: str = "[SECRET]", near: int | None = None) -> DataFrame:
    """All rows and columns of ``docs``, with every reported span of ``text`` replaced by ``mark``.

    Texts without spans, null ones included, stay as they are.
    """
    key, found = unused(docs, "row_key"), unused(docs, "spans")
    spans = find_secrets(docs, near).where(F.size("spans") > 0).select(F.col("row_key").alias(key), F.col("spans").alias(found))
    joined = docs.withColumn(key, row_key()).join(spans, key, "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(done: Column, span: Column) -> Column:
        # spans may touch or overlap; what is behind ``at`` has been replaced already
        gap = F.substring(F.col("text"), (done["at"] + 1).cast("int"), F.greatest(span["start"] - done["at"], F.lit(0)).cast("int"))
        more = F.when(span["start"] >= done["at"], F.array(gap, F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(done["at"], span["end"]).alias("at"), F.concat(done["out"], more).alias("out"))

    built = F.aggregate(found, start, step, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(F.col("text"), (d["at"] + 1).cast("int"), F.length("text"))))
    return joined.withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(built)).select(*(quoted(c) for c in docs.columns))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
