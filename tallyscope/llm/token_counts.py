"""Token counts by a two-tier lookup of pre-tokens, without any shuffle.

Tier one is a table of frequent pre-tokens and their numbers of tokens, broadcast to all tasks; its
size is bounded by a parameter. It is counted on a bounded sample of short documents, because it only
decides what is quick: a count never depends on it. Tier two is a cache in each worker, bounded too,
that the library fills with the pre-tokens met on the way.

Both tiers hold pre-tokens of every script: Latin texts are split by a pattern here, all others by the
library's own pre-tokenizer, and a special token's string inside a text counts as one token. No text is
encoded whole.

Null and empty texts have no tokens; very long texts are counted slice by slice, cut where
pre-tokens end (a text without any such place, one word a megabyte long, is one slice). Repeated rows are counted one by one. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.bpe import Encoder, encoder
from tallyscope.llm.common import documents, fraction_of, ship, text_bytes

TABLE_ENTRIES = 1 << 16
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 16_384


def pre_tokens(encode: Encoder, text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text, slice by slice, without special tokens."""
    if encode.plain(text):
        yield from encode.pieces(text)
    else:
        for part in encode.special.split(text):
            if part:
                yield from encode.pieces_of_any(part)


def frequent_lengths(
    docs: DataFrame, tokenizer: str, entries: int = TABLE_ENTRIES, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES
) -> bytes:
    """The compact table: pre-tokens by falling count, zlib-packed, with one byte of length each.

    At most about ``sample_docs`` texts of at most ``sample_bytes`` bytes reach the driver.
    """
    encode, counts = encoder(tokenizer), Counter()
    sample = fraction_of(docs.select("doc_id", "text"), F.col("doc_id"), sample_docs, docs.count())
    sample = sample.where(F.octet_length("text") <= sample_bytes).limit(2 * sample_docs)
    for (text,) in sample.select("text").collect():
        for pieces in pre_tokens(encode, text):
            counts.update(pieces)
    rows = [(p, len(encode[p]) // 4) for p, _ in counts.most_common(entries) if "\0" not in p]
    rows = [(p, n) for p, n in rows if n < 256]
    return zlib.compress("\0".join(p for p, _ in rows).encode()) + b"|" + bytes(n for _, n in rows)


class Lengths(dict):
    """Tier one for good; tier two comes and goes with ``entries``."""

    def __init__(self, table: bytes, tokenizer: str, entries: int = 500_000):
        self.encode, self.entries = encoder(tokenizer), entries
        unpack = zlib.decompressobj()
        names = unpack.decompress(table) + unpack.flush()
        lengths = unpack.unused_data[1:]
        self.first = dict(zip(names.decode().split("\0"), lengths)) if lengths else {}
        self.update(self.first)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.entries + len(self.first):
            self.clear()
            self.update(self.first)
        n = self[piece] = len(self.encode.merged(piece))
        return n

    def count(self, text: str) -> int:
        tokens = sum(sum(map(self.__getitem__, pieces)) for pieces in pre_tokens(self.encode, text))
        return tokens + sum(1 for _ in self.encode.special.finditer(text))


_lengths: dict[tuple[str, int], Lengths] = {}


def lengths_of(table: bytes, tokenizer: str) -> Lengths:
    key = (tokenizer, zlib.crc32(table))
    if key not in _lengths:
        _lengths.clear()
        _lengths[key] = Lengths(table, tokenizer)
    return _lengths[key]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row."""
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(docs.select("doc_id", F.col(text_column).alias("text")), tokenizer))

    def count(batches):
        lengths = lengths_of(table.value, tokenizer)
        for batch in batches:
            tokens = [lengths.count(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(np.array(tokens, "i8") > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = text_bytes(text_column)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
