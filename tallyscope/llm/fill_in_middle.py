"""Fill-in-the-middle: a text is cut at two places and its parts are put in another order behind marks.

The places are ranks among the units of the text: code points, or matches of a pattern such as words. An
indexable skip list finds them. Its nodes are short runs of the text; a node stands on lane j when its number
is a multiple of ``FAN ** j``, and every link carries how many units and how many code points it passes over.
From the highest lane down, links are taken while the units passed stay within the rank; what is left is
counted inside one node. Widths are sums of the lane below, so both ranks are reached exactly.

A null text is an empty one; an empty text, or one that holds a mark already, stays plain, so that every
output can be taken apart again. A null id counts as the empty text in the hash. Repeated rows come out
repeated. Very long texts cost memory in proportion to their own bytes. Other columns are left out of the
result, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import documents, ship

PLAIN, PSM, SPM = "plain", "psm", "spm"
#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
#: Nodes one link of a lane passes over on the lane below.
FAN = 4
#: Bytes in a node of code points, units in a node of a pattern.
NODE_BYTES, NODE_UNITS = 512, 32


class SkipList:
    """Lanes of links over the nodes of one text; ``widths`` are the units and the code points in each node."""

    def __init__(self, widths: np.ndarray) -> None:
        self.lanes = [widths]
        while len(self.lanes[-1]) > FAN:
            below = self.lanes[-1]
            self.lanes.append(np.add.reduceat(below, np.arange(0, len(below), FAN)))
        self.units = int(self.lanes[-1][:, 0].sum())

    def seek(self, rank: int) -> tuple[int, int, int]:
        """The node that holds the unit of this rank, and the units and code points before that node."""
        node, units, points = 0, 0, 0
        for lane in reversed(self.lanes):
            node = min(node * FAN, len(lane))
            while node < len(lane) and units + lane[node, 0] <= rank:
                units, points, node = units + int(lane[node, 0]), points + int(lane[node, 1]), node + 1
        return node, units, points


def cut_code_points(text: memoryview | bytes, draws: Sequence[int]) -> list[int]:
    """Units, and for each draw the code points before the unit of rank ``draw % (units + 1)``; UTF-8 in."""
    data = np.frombuffer(text, "u1")
    first = (data & 0xC0) != 0x80
    if not len(data):
        return [0] + [0] * len(draws)
    starts = np.add.reduceat(first, np.arange(0, len(data), NODE_BYTES), dtype="i8")
    nodes = SkipList(np.stack([starts, starts], axis=1))
    out = [nodes.units]
    for draw in draws:
        rank = draw % (nodes.units + 1)
        node, units, points = nodes.seek(rank)
        inside = first[node * NODE_BYTES : (node + 1) * NODE_BYTES]
        # of this node, the code points before the one looked for
        out.append(points + int(np.flatnonzero(inside)[: rank - units].size))
    return out


def cut_matches(text: str, pattern: re.Pattern, draws: Sequence[int]) -> list[int]:
    """As ``cut_code_points`` for matches of a pattern, left to right. A unit reaches to the next match;
    what stands before the first match belongs to it."""
    edges, units = [0], 0
    for match in pattern.finditer(text):
        if units and units % NODE_UNITS == 0:
            edges.append(match.start())
        units += 1
    widths = np.full((len(edges), 2), NODE_UNITS, "i8")
    widths[-1, 0] = units - NODE_UNITS * (len(edges) - 1)
    widths[:, 1] = np.diff([*edges, len(text)])
    nodes, out = SkipList(widths), [units]
    for draw in draws:
        rank = draw % (units + 1)
        node, before, points = nodes.seek(rank)
        if rank > before:
            for _, match in zip(range(rank - before + 1), pattern.finditer(text, points)):
                points = match.start()
        out.append(points)
    return out


def cuts(unit: str | None):
    """A column function (text as bytes, two draws) -> units, lower and higher cut in code points."""
    kind = "struct<units: long, low: long, high: long>"
    pattern = None if unit is None else re.compile(unit)

    def place(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        rows = []
        for value, *draws in zip(text, one.to_pylist(), two.to_pylist()):
            data = value.as_buffer()
            found = cut_code_points(data, draws) if pattern is None else cut_matches(str(data, "utf-8"), pattern, draws)
            rows.append((found[0], *sorted(found[1:])))
        columns = np.array(rows, "i8").reshape(-1, 3)
        return pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(3)], names=["units", "low", "high"])

    place.__annotations__ = {"text": pa.Array, "one": pa.Array, "two": pa.Array, "return": pa.Array}
    return F.arrow_udf(place, kind)


def transform(
    docs: DataFrame, unit: str | None = None, seed: str = "1", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
    marks: Sequence[str] = MARKS,
) -> DataFrame:
    """One row per document: doc_id, text, n (units), form, prefix_chars, middle_chars, output.

    ``unit`` is a pattern, None for code points. Of a hundred documents, those hashed to ``plain_from`` and
    above stay plain; of the others, ``spm_below`` have their suffix first.
    """
    ship(docs.sparkSession)
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), hashed.alias("hash"))
    draws = [F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    rows = rows.select("doc_id", "text", *(d.alias(f"h{i}") for i, d in enumerate(draws, 1)))
    rows = rows.withColumn("cut", cuts(unit)(F.col("text").cast("binary"), "h1", "h2"))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains("text", F.lit(mark))
    form = (
        F.when((F.length("text") == 0) | marked | (F.col("h3") % 100 >= plain_from), PLAIN)
        .when(F.col("h4") % 100 < spm_below, SPM).otherwise(PSM)
    )
    low, high = F.col("cut.low").cast("int"), F.col("cut.high").cast("int")
    prefix, middle = F.substr("text", F.lit(1), low), F.substr("text", low + 1, high - low)
    suffix = F.substr("text", high + 1, F.length("text"))
    before, behind, between = (F.lit(m) for m in marks)
    output = (
        F.when(F.col("form") == PLAIN, F.col("text"))
        .when(F.col("form") == PSM, F.concat(before, prefix, behind, suffix, between, middle))
        .otherwise(F.concat(behind, suffix, before, prefix, between, middle))
    )
    moved = F.col("form") != PLAIN
    return rows.withColumn("form", form).select(
        "doc_id", "text", F.col("cut.units").alias("n"), "form", F.when(moved, F.col("cut.low")).alias("prefix_chars"),
        F.when(moved, F.col("cut.high") - F.col("cut.low")).alias("middle_chars"), output.alias("output"),
    )


def restore(rows: DataFrame, into: str = "restored", marks: Sequence[str] = MARKS) -> DataFrame:
    """Add the text as rebuilt from the columns output and form alone.

    No part holds a mark, and no end of one mark is the start of another, so the first place of each mark is
    its own.
    """
    before, behind, between = marks
    suffix_at, middle_at = F.position(F.lit(behind), "output"), F.position(F.lit(between), "output")
    prefix_at, size = F.position(F.lit(before), "output"), F.length("output")

    def part(start: Column, mark: str, stop: Column) -> Column:
        return F.substr("output", start + len(mark), stop - start - len(mark))

    places = rows.withColumn("__at", F.struct(prefix_at.alias("p"), suffix_at.alias("s"), middle_at.alias("m"), (size + 1).alias("e")))
    p, s, m, e = (F.col("__at")[c] for c in "psme")
    middle = part(m, between, e)
    text = (
        F.when(F.col("form") == PLAIN, F.col("output"))
        .when(F.col("form") == PSM, F.concat(part(p, before, s), middle, part(s, behind, m)))
        .otherwise(F.concat(part(p, before, m), middle, part(s, behind, p)))
    )
    return places.select(*rows.columns, text.alias(into))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = restore(transform(documents(spark, sf_dir)).drop("text"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


#: The same rows for DuckDB, by plain slices of the text.
SQL = """
with t as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
d as (
  select doc_id, text, length(text)::bigint as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2,
    ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from t),
c as (
  select doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
    case when n = 0 or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
         when h4 % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (
  select *, substring(text, 1, low) as prefix, substring(text, low + 1, high - low) as middle,
    substring(text, high + 1, n - high) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then low end as prefix_chars,
  case when form <> 'plain' then high - low end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p"""
