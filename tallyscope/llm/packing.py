"""Best-fit packing of documents into sequences, planned on the histogram of lengths.

1. Every document is encoded once; documents longer than a sequence are cut into full pieces and a
   rest. What goes on is one narrow row per piece, numbered within its task and length and written to the
   shared folder, which fixes the numbers.
2. The driver gets the histogram: one count for each length, ``capacity`` rows whatever the corpus.
   Best-fit decreasing runs over counts: bins with the same room form a range of sequence numbers, and
   a step places as many pieces of one length as a range holds. The plan has one entry a step.
3. Pieces take the planned slots: a piece's rank within its length, its number after the counts of the
   tasks before, selects the plan entry, hence sequence and offset. Pieces aren't sorted, and neither a
   length that most pieces have nor a row that repeats gathers in a task.

The plan is broadcast. It grows with the number of lengths, not with the corpus; beyond
``PLAN_ENTRIES`` the planner raises instead of broadcasting.

Null text is the empty text: one piece with the end id alone. Null and repeated document ids are
kept, each row is a document of its own. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyscope.llm.bpe import encoder
from tallyscope.llm.common import documents, scratch, ship, text_bytes

CAPACITY = 2048
PLAN_ENTRIES = 4_000_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, number: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32; with ``number`` what ``numbered`` adds, too."""
    ship(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches):
        encode, end = encoder(tokenizer), struct.pack("<I", end_id)
        for batch in batches:
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = encode.encode(text) + end
                for i in range(0, len(ids), 4 * capacity):
                    part = ids[i : i + 4 * capacity]
                    out.append((doc_id, i // 4 // capacity, i // 4, len(part) // 4, zlib.crc32(part)))
            if out:
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), types)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    if not number:
        return texts.mapInArrow(cut, schema)
    add = numbering(3, capacity)  # in the same worker
    return texts.mapInArrow(lambda batches: add(cut(batches)), f"{schema}, _row long").withColumn("_task", F.spark_partition_id())


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts.

    Rows (length, first rank, first sequence, offset), sorted by length and rank: the piece of this
    length with rank r goes to sequence ``first sequence + r - first rank`` at ``offset``.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges [from, to) of sequences
    heap: list[int] = []
    entries, used = [], 0

    def put(room: int, first: int, last: int) -> None:
        if room > 0 and first < last:
            if not rooms.setdefault(room, []):
                heapq.heappush(heap, room)
            rooms[room].append((first, last))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        waiting = []
        while left:
            while heap and heap[0] < length:  # too small for this length, not for later ones
                waiting.append(heapq.heappop(heap))
            if heap:
                room = heap[0]
                first, last = rooms[room].pop()
                if not rooms[room]:
                    heapq.heappop(heap)
            else:
                room, first = capacity, used
                last = used = used + -(-left // (capacity // length))
            n = min(left, last - first)
            entries.append((length, rank, first, capacity - room))
            put(room - length, first, first + n)
            put(room, first + n, last)
            rank, left = rank + n, left - n
        for room in waiting:
            heapq.heappush(heap, room)
    if len(entries) > PLAN_ENTRIES:
        raise ValueError(f"a plan of {len(entries)} entries is too large to broadcast")
    out = np.array(entries, "i8").reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def numbering(at: int, capacity: int) -> Callable:
    """Adds _row to batches, a row's number from 0 among those of its length (the column ``at``) in its task."""

    def number(batches):
        reached = np.zeros(capacity + 1, "i8")
        for batch in batches:
            length = batch.column(at).to_numpy()
            order = np.argsort(length, kind="stable")
            starts = np.flatnonzero(np.diff(length[order], prepend=-1))
            sizes = np.diff(starts, append=len(length))
            place = np.empty(len(length), "i8")
            place[order] = np.arange(len(length)) - np.repeat(starts, sizes) + reached[length[order]]
            reached += np.bincount(length, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, "_row"])

    return number


def numbered(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds _row (see ``numbering``) and _task."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    number = numbering(rows.columns.index("length"), capacity)
    return rows.mapInArrow(number, ", ".join([*fields, "_row long"])).withColumn("_task", F.spark_partition_id())


def best_fit(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with a length (0 < length <= capacity), numbered if they aren't."""
    spark = rows.sparkSession
    spread = scratch(rows if "_row" in rows.columns else numbered(rows, capacity), "pieces")
    rows = spread.drop("_row", "_task")
    sizes = scratch(spread.groupBy("length", "_task").count(), "task-counts")
    counted = {int(n): int(c) for n, c in sizes.groupBy("length").agg(F.sum("count")).collect()}
    table = plan(counted, capacity)
    sent = spark.sparkContext.broadcast((table[:, 0] << 44 | table[:, 1], table))
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("length", "_task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    ranked = spread.join(firsts, ["length", "_task"]).select(*rows.columns, (F.col("_first") + F.col("_row")).alias("_rank"))
    names = rows.columns

    def place(batches):
        keys, steps = sent.value
        for batch in batches:
            length, rank = (batch.column(names.index("length")).to_numpy(), batch.column(len(names)).to_numpy())
            step = steps[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(step[:, 2] + rank - step[:, 1]), pa.array(step[:, 3])],
                names=[*names, "sequence_id", "offset"],
            )

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    return best_fit(pieces(docs, tokenizer, capacity, number=True), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
