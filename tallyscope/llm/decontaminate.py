"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Items and documents are normalised alike: A-Z in lower case, words as runs of letters, digits and
bytes beyond ASCII. A window is ten consecutive words of an item, or a shorter item as a whole. Words
of the benchmark get numbers, and the automaton runs over the numbers of a text's words, once; words
the benchmark doesn't have are number 0. Word numbers map back to places in the original text by
scanning it again, only for texts that are hit.

The benchmark goes to all tasks, so its size is checked: sets of items beyond ``BLOCK_BYTES`` are split in
blocks by a running sum, each a pass of its own over the documents, and a document's hits are united.
So the benchmark may grow without a task holding more than one block.

Null or wordless texts have no words and no hits, wordless items no windows. A null item id still
marks words but isn't listed. Items that repeat count once by id. Repeated rows and null doc_ids are
handled row by row. An empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.common import documents, held, plain_names, scratch, ship, text_bytes

WINDOW = 10
BLOCK_BYTES = 4 << 20
#: Bytes that are no part of a word become blanks; A-Z become a-z.
FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)
#: Words in the original text, where A-Z are still there.
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


class Matcher:
    """The automaton of one block of items."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.translate(FOLD).split()]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                owners.setdefault(tuple(words[i : i + window]), set()).update([] if item_id is None else [item_id])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, ids in owners.items():
            self.automaton.add_word(key, (len(key), ids))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners
        # a match has at least this many words of the benchmark in a row
        self.least = min(map(len, owners), default=0)

    def find(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit ranges of words (end exclusive, merged), items."""
        words = text.translate(FOLD).split()
        if self.empty:
            return len(words), [], set()
        get, ranges, items = self.numbers.get, [], set()
        for end, (length, ids) in self.automaton.iter(tuple([get(w, 0) for w in words])):
            items |= ids
            start = end - length + 1
            while ranges and ranges[-1][1] >= start:
                start = min(start, ranges.pop()[0])
            ranges.append((start, end + 1))
        return len(words), ranges, items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def places(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of word ranges in the original text."""
    ends, out, first = iter(ranges), [], None
    now = next(ends, None)
    for i, word in enumerate(WORD.finditer(text)):
        if now is None:
            break
        if i == now[0]:
            first = word.start()
        if i == now[1] - 1:
            out.append((first, word.end()))
            now = next(ends, None)
    return out


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _matcher(key: str, items: list[tuple[str | None, bytes]], window: int) -> Matcher:
    matchers = held("matchers")
    if key not in matchers:
        matchers.clear()
        matchers[key] = Matcher(items, window)
    return matchers[key]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of bounded size; one item larger than a block is a block."""
    rows = benchmark.select(F.col("item_id").cast("string"), text_bytes().cast("binary").alias("text")).distinct()
    block, size = [], 0
    for item_id, text in rows.toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, bytes(text)))
        size += len(text)
    yield block


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with n_words, its hit word ranges, spans and items."""
    spark = docs.sparkSession
    ship(spark)
    schema = (
        "doc_id long, row_key string, n_words long, ranges array<struct<start:long,end:long>>, "
        "spans array<struct<start:long,end:long>>, items array<string>"
    )
    types = [
        pa.int64(), pa.string(), pa.int64(), *[pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))] * 2,
        pa.list_(pa.string()),
    ]

    def scan(sent, key):
        def run(batches):
            matcher = _matcher(key, sent.value, window)
            for batch in batches:
                out = []
                for doc_id, row_key, text in zip(*(c.to_pylist() for c in batch.columns)):
                    n, ranges, items = matcher.find(text)
                    spans = places(text.decode("utf-8", "replace"), ranges) if ranges else []
                    as_rows = [[{"start": a, "end": b} for a, b in x] for x in (ranges, spans)]
                    out.append((doc_id, row_key, n, *as_rows, sorted(items)))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*out), types)],
                        names=["doc_id", "row_key", "n_words", "ranges", "spans", "items"],
                    )

        return run

    passes = []
    text = text_bytes().cast("binary")
    for i, block in enumerate(_blocks(benchmark, block_bytes)):
        key = hashlib.sha256(repr((window, block)).encode()).hexdigest()
        row_key = F.lit(None).cast("string") if i == 0 else F.sha2(F.concat(text, F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key.alias("row_key"), text.alias("text"))
        passes.append((rows, spark.sparkContext.broadcast(block), key))
    if len(passes) == 1:
        rows, sent, key = passes[0]
        return rows.mapInArrow(scan(sent, key), schema).drop("row_key")
    found = None
    keyed = passes[1][0]
    for _, sent, key in passes:
        one = scratch(keyed.mapInArrow(scan(sent, key), schema), "hits")
        found = one if found is None else found.unionByName(one)
    # rows with one key have equal text and id, hence equal hits: their number is kept
    lists = [F.flatten(F.collect_set(c)).alias(c) for c in ("ranges", "spans", "items")]
    united = found.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count("*").alias("copies"), *lists
    )
    copies = F.explode(F.sequence(F.lit(1), (F.col("copies") / len(passes)).cast("int"))).alias("copy")
    return united.select("doc_id", "n_words", "ranges", "spans", F.array_distinct("items").alias("items"), copies).drop("copy")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans for every row."""

    def sum_up(batches):
        for batch in batches:
            rows = batch.to_pylist()
            ranges = [merged([(r["start"], r["end"]) for r in x["ranges"]]) for x in rows]
            spans = [merged([(r["start"], r["end"]) for r in x["spans"]]) for x in rows]
            n_hit = [sum(b - a for a, b in x) for x in ranges]
            items = [sorted(x["items"]) for x in rows]
            span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()), pa.array([digest(set(x)) for x in items]),
                    pa.array(np.array(n_hit, "i8") > 0), pa.array(items, pa.list_(pa.string())),
                    pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], span_type),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    schema = (
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
        "items array<string>, spans array<struct<start:long,end:long>>"
    )
    return hits(docs, benchmark, window, block_bytes).mapInArrow(sum_up, schema)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose ``text`` has no window of the benchmark."""
    spark = docs.sparkSession
    ship(spark)
    names, at, schema = docs.columns, docs.columns.index("text"), docs.schema

    def without(sent, key):
        def run(batches):
            matcher = _matcher(key, sent.value, window)
            for batch in batches:
                keep = [not matcher.find((t or "").encode())[1] for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns, names=names)

        return run

    for block in _blocks(benchmark, block_bytes):
        key = hashlib.sha256(repr((window, block)).encode()).hexdigest()
        docs = plain_names(docs).mapInArrow(without(spark.sparkContext.broadcast(block), key), schema)
    return docs


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    places = F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))
    return found.withColumns({"items": F.array_join("items", ","), "spans": F.array_join(places, ",")})
