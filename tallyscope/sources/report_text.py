"""Text sink: one report per key, written by the tasks that hold the keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report_text(reports: DataFrame, path: str, by: Sequence[str] = (), replace: bool = False) -> None:
    """Write the ``report`` column, one folder per key. A report is one row, so its lines stay
    together without any shuffle.

    ``replace`` puts new reports in the place of old ones: with keys only the folders of the keys in
    ``reports`` are overwritten, the others stay as they are. Without it an existing ``path`` is an error.
    """
    mode = "overwrite" if replace else "error"
    writer = reports.select(*by, "report").write.mode(mode).option("lineSep", "\n")
    if by:
        writer = writer.partitionBy(*by).option("partitionOverwriteMode", "dynamic")
    writer.text(path)


def read_report_text(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """The reports below ``path``, one row per file, with the keys as text; the last line break of a
    report is its own, that of the file is taken off."""
    schema = ", ".join(["value string", *[f"`{c}` string" for c in by]])
    rows = spark.read.schema(schema).text(path, wholetext=True)
    return rows.select(*by, F.regexp_replace("value", r"\n\z", "").alias("report"))
