"""CSV ingestion: scan as text, normalise missing tokens, infer types, cast; file manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.fixed_values import MISSING_TOKENS
from tallyscope.functions.coerce import NUMBER_PATTERN, fixed_text, strip
from tallyscope.functions.naming import quoted

# The grammar of whole numbers and of truth values.
WHOLE_PATTERN = r"^[+-]?\d+$"
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")


def _files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """File names and sizes from the listing; the content column is never read."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("binaryFile").load(paths).select("path", "length")


def source_manifest(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Name, bytes and readable size of every file."""
    size = F.col("length")
    readable = (
        F.when(size < 1024, F.format_string("%d B", size))
        .when(size < 1024 * 1024, F.concat(fixed_text(size / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(fixed_text(size / (1024 * 1024), 1), F.lit(" MB")))
    )
    return _files(spark, paths).select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        size.alias("file_size_bytes"),
        readable.alias("file_size_display"),
    )


def open_quotes(spark: SparkSession, paths: str | Sequence[str]) -> list[str]:
    """Files in which some line holds an odd number of quotes: a quoted field may go on in the next.

    One pass over the lines, folded per file before anything is shuffled.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    files = spark.read.text(paths).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.bool_or(quotes % 2 == 1).alias("open")
    )
    return sorted(r["file"] for r in files.where("open").collect())


def scan_csv(
    spark: SparkSession, paths: str | Sequence[str], multi_line: bool | None = None
) -> DataFrame:
    """All columns as text, with the usual missing tokens as null.

    A quoted line break needs multi-line reading, which keeps a file in one task. Files are first
    checked, whatever their size: only those with a line of odd quotes are read that way, all others
    stay splittable. ``multi_line`` decides for all files instead.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)

    def reader(whole_files: bool):
        return (
            spark.read.option("header", True)
            .option("multiLine", whole_files)
            .option("escape", '"')
            .option("mode", "PERMISSIVE")
            .option("nullValue", "")
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )

    broken = open_quotes(spark, paths) if multi_line is None else []
    raw = reader(bool(multi_line or broken)).csv(paths)
    if broken:
        # a filter on file paths prunes the listing, so each file is read by one of the two scans
        file = F.col("_metadata.file_path")
        split = reader(False).schema(raw.schema).csv(paths).where(~file.isin(broken))
        raw = split.unionByName(raw.where(file.isin(broken)))
    return raw.select(
        *[F.when(~quoted(c).isin(*MISSING_TOKENS), quoted(c)).alias(c) for c in raw.columns]
    )


def _is_truth(value: Column) -> Column:
    return value.isin(*TRUE_TOKENS, *FALSE_TOKENS)


def inferred_types(raw: DataFrame) -> DataFrame:
    """One row per column with the narrowest type all its values fit; dates stay text.

    Whole numbers never lose a digit: beyond 64 bits they are decimals, beyond 38 digits text.
    """
    counts = []
    for i, name in enumerate(raw.columns):
        value = quoted(name)
        whole = strip(value).rlike(WHOLE_PATTERN)
        counts += [
            F.count(value).alias(f"n{i}"),
            F.count_if(whole).alias(f"i{i}"),
            F.count_if(whole & strip(value).try_cast("bigint").isNotNull()).alias(f"w{i}"),
            F.count_if(whole & strip(value).try_cast("decimal(38,0)").isNotNull()).alias(f"d{i}"),
            F.count_if(strip(value).rlike(NUMBER_PATTERN)).alias(f"r{i}"),
            F.count_if(_is_truth(value)).alias(f"t{i}"),
        ]
    entries = []
    for i, name in enumerate(raw.columns):
        n = F.col(f"n{i}")
        kind = (
            F.when((n == 0), "double")
            .when(F.col(f"w{i}") == n, "bigint")
            .when(F.col(f"d{i}") == n, "decimal(38,0)")
            .when(F.col(f"i{i}") == n, "string")
            .when(F.col(f"r{i}") == n, "double")
            .when(F.col(f"t{i}") == n, "boolean")
            .otherwise("string")
        )
        entries.append(
            F.struct(
                F.lit(i).cast("long").alias("ordinal"), F.lit(name).alias("column_name"),
                kind.alias("data_type"), n.alias("non_null"),
            )
        )
    return raw.agg(*counts).select(F.inline(F.array(*entries)))


def typed(raw: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast the text columns to the inferred types."""

    def cast(field: T.StructField) -> Column:
        value, kind = quoted(field.name), types[field.name]
        if kind == "boolean":
            return F.when(_is_truth(value), value.isin(*TRUE_TOKENS))
        if kind == "string":
            return value
        return strip(value).try_cast(kind)

    return raw.select(*[cast(f).alias(f.name) for f in raw.schema.fields])


def read_csv(
    spark: SparkSession, paths: str | Sequence[str], multi_line: bool | None = None
) -> DataFrame:
    """Scan, infer, cast. The type list (one row per column) is the only thing collected."""
    raw = scan_csv(spark, paths, multi_line)
    types = {r["column_name"]: r["data_type"] for r in inferred_types(raw).collect()}
    return typed(raw, types)
