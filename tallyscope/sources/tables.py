"""Parquet tables and the wide views built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.functions.coerce import let


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def business(spark: SparkSession, folder: str) -> DataFrame:
    """One wide row per order line.

    Lines meet their part first and become the columns of a part and of money, which are narrow; the
    orders side is widened on its own. So the large line table is shuffled for two joins at most, never
    with the texts of its order, and the lines of an order end in one task, where folds by order are small.
    No side is forced to broadcast: sizes decide, at run time too, and a hot part or order key is
    split by the adaptive skew join. Money is decimal, which makes sums independent of row order.
    """
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))

    def money(value):
        return value.cast("decimal(18,4)")

    lines = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "part"), F.expr("l_partkey = p_partkey"))
        .select(
            "l_orderkey",
            F.col("p_brand").alias("product_brand"),
            F.col("p_type").alias("product_type"),
            money(F.col("l_quantity")).alias("quantity"),
            money(F.col("l_discount") * 100).alias("discount_pct"),
            money(revenue).alias("net_revenue"),
            money(revenue - F.col("l_quantity") * F.col("p_retailprice")).alias("profit"),
            F.col("l_linenumber").alias("line_no"),
        )
    )
    orders = (
        table(spark, folder, "orders")
        .join(table(spark, folder, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, folder, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    return lines.join(orders, F.expr("l_orderkey = o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        "product_brand", "product_type", "quantity", "discount_pct", "net_revenue", "profit", "line_no",
    )


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    """The wide rows with gaps, blanks, padded text, unreadable numbers and repeated rows."""
    order = F.col("order_id")
    rows = business(spark, folder).select(
        "order_id",
        "line_no",
        "order_date",
        F.when(order % 17 == 0, F.lit(None))
        .when(order % 19 == 0, F.lit("   "))
        .otherwise(F.concat(F.lit(" "), F.col("segment"), F.lit(" ")))
        .alias("segment"),
        F.when(order % 23 == 0, F.lit("n/a"))
        .otherwise(F.round("quantity").cast("long").cast("string"))
        .alias("quantity_text"),
        F.date_format("order_date", "MM/dd/yyyy").alias("order_day"),
        F.when(order % 29 != 0, F.col("net_revenue")).alias("net_revenue"),
        "discount_pct",
        "profit",
        "region",
    )
    # every 50th order twice, in one pass over the joined rows
    copies = F.when(order % 50 == 0, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.withColumn("__copy", F.explode(copies)).drop("__copy")


def narratives(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a sectioned narrative: headings, bullets and a repeated first line."""

    def story(lines):
        def part(start: int, length, bullet: str, join: str):
            chosen = F.slice(lines, start, length)
            return F.when(F.size(lines) >= start, F.concat(F.lit(bullet), F.array_join(chosen, join)))

        first = F.concat(F.lit("- "), F.get(lines, F.lit(0)))
        return F.concat_ws(
            "\n",
            F.lit("ExecutiveSummary:"), first, first, F.lit(""),
            F.lit("Key Insights :"), part(2, 4, "* ", "\n* "),
            F.lit("## Risks"), part(6, 3, "1. ", "\n2.  "),
            F.lit("RecommendedActions:"), part(9, F.size(lines), "- ", " ..\n-"),
        )

    text = let(F.split("text", "\n"), story)  # split once
    return table(spark, folder, "documents").select("doc_id", text.alias("narrative"))
