"""Balanced shards by vector bin packing: bytes, tokens and rows at once.

Equal texts form a group; a group has a vector of its bytes, tokens (words) and rows. Units are placed,
largest first, in the shard where the dot product of their vector with the residual capacity is
highest (all in shares of the corpus). The unit is

* a group, if it holds more than ``1 / HEAVY`` of a shard in some dimension: there are at most
  ``3 * HEAVY * shards`` of them; one that exceeds a shard is split in ``SALTS`` parts by a hash first;
* a cell of groups otherwise: groups are hashed to ``CELLS`` cells, whose sums reach the driver. A
  corpus with fewer groups than cells is placed nearly group by group.

So the driver sees a bounded number of vectors, whatever the corpus, and copies stay together unless
they are more than a shard holds. The smallest units go, last, where most bytes are missing, so that
the law ``bytes`` holds: shard sizes differ by less than a light unit.

A slot is a gapless number within the shard, by bucket counts and a window inside a bucket; no task
numbers a whole shard. Null text counts as empty (size 1, CRC 0); repeated rows and null ids are rows
like others. An empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.llm.common import documents, scratch, text_bytes

SHARDS = 8
CELLS = 1 << 15
HEAVY = 64
SALTS = 256
#: Share of the bytes, in the smallest units, that goes where bytes are missing.
TAIL = 0.02
BUCKET_ROWS = 100_000
SPREAD = 1 << 16
DIMENSIONS = ("size", "tokens", "one")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit; ``vectors`` has the columns of DIMENSIONS."""
    totals = vectors.sum(axis=0)
    shares = vectors / np.where(totals > 0, totals, 1)
    order = np.argsort(-shares.max(axis=1), kind="stable")
    room = np.full((shards, vectors.shape[1]), 1 / shards)
    tail = np.cumsum(shares[order[::-1], 0])[::-1] <= TAIL
    where = np.zeros(len(vectors), "i4")
    for unit, last in zip(order.tolist(), tail.tolist()):
        share = shares[unit]
        shard = int(np.argmax(room[:, 0] if last else room @ share))
        where[unit] = shard
        room[shard] -= share
    return where


def shard_documents(docs: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, group for every row."""
    spark = docs.sparkSession
    text = text_bytes()
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.size(F.split(F.trim(text), r"\s+")).cast("long").alias("tokens"),
        F.md5(text.cast("binary")).alias("group"),
    )
    # rows that are equal in all columns differ in their spread, so that their slots don't gather in one bucket
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)).alias("spread")
    rows = rows.select("*", F.pmod(F.xxhash64("group"), F.lit(cells)).cast("int").alias("cell"), spread)
    rows = scratch(rows, "sizes")
    sums = [F.sum(c).alias(c) for c in ("size", "tokens")]
    groups = scratch(rows.groupBy("group", "cell").agg(*sums, F.count("*").alias("one")), "groups")
    total = groups.agg(*(F.sum(c).alias(c) for c in DIMENSIONS)).first()
    limit = {c: max(1, (total[c] or 0) / shards / HEAVY) for c in DIMENSIONS}
    is_heavy = F.greatest(*((F.col(c) > limit[c]).cast("int") for c in DIMENSIONS)) == 1
    heavy = groups.where(is_heavy).select("group", *DIMENSIONS).orderBy("group").collect()
    light = groups.where(~is_heavy).groupBy("cell").agg(*(F.sum(c).alias(c) for c in DIMENSIONS)).orderBy("cell").collect()

    salt = F.pmod(F.xxhash64("doc_id", "group"), F.lit(SALTS)).cast("int")
    beyond = [r["group"] for r in heavy if any(r[c] * shards > total[c] for c in DIMENSIONS)]
    salted = rows.where(F.col("group").isin(beyond)).groupBy("group", salt.alias("salt")).agg(*sums, F.count("*").alias("one"))
    units, keys = [], []
    for row in salted.orderBy("group", "salt").collect() if beyond else []:
        keys.append((row["group"], None, row["salt"]))
        units.append([row[c] for c in DIMENSIONS])
    for row in heavy:
        if row["group"] not in beyond:
            keys.append((row["group"], None, 0))
            units.append([row[c] for c in DIMENSIONS])
    for row in light:
        keys.append((None, row["cell"], 0))
        units.append([row[c] for c in DIMENSIONS])
    where = place(np.array(units, "f8").reshape(-1, len(DIMENSIONS)), shards).tolist()
    parts: dict[str, list[int]] = {}
    for (group, _, part), shard in zip(keys, where):
        if group is not None:
            parts.setdefault(group, [0] * (SALTS if group in beyond else 1))[part] = shard
    whole = spark.createDataFrame(list(parts.items()), "group string, parts array<int>")
    celled = spark.createDataFrame([(k[1], s) for k, s in zip(keys, where) if k[0] is None], "cell int, cell_shard int")
    # both sides are bounded by the parameters: 3 * HEAVY * shards and ``cells`` rows
    placed = rows.join(F.broadcast(whole), "group", "left").join(F.broadcast(celled), "cell", "left")
    buckets = max(1, (total["one"] or 0) // shards // BUCKET_ROWS)
    part = F.pmod(salt, F.size("parts"))
    placed = placed.select(
        "doc_id", "size", "text_crc32", "group",
        F.when(F.col("parts").isNotNull(), F.col("parts")[part]).otherwise(F.col("cell_shard")).alias("shard"),
        F.pmod(F.xxhash64("group", "doc_id", "spread", F.lit(3)), F.lit(buckets * 8)).cast("int").alias("bucket"),
    )
    placed = scratch(placed, "placed")
    sizes = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(
        F.col("shard").alias("in_shard"), F.col("bucket").alias("in_bucket"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"),
    )
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "group")
    numbered = placed.withColumn("row", F.row_number().over(inside)).join(
        firsts, (F.col("shard") == F.col("in_shard")) & (F.col("bucket") == F.col("in_bucket"))
    )
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + F.col("row") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group",
    )


def op6_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
