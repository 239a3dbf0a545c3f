"""Token ids in seekable files: one zstandard frame per document and a trailing seek table.

A file is

    frame of document 0, frame of document 1, ...      ids, little-endian, 2 or 4 bytes each
    skippable frame: width, document ids, null marks   the directory
    skippable frame: seek table                        (compressed, raw size, xxh64 checksum) a frame

The seek table is the one of the public seekable zstandard format: a skippable frame, its footer last
in the file. A plain zstandard reader gets all ids in turn; ours reads the tail, then only the frames
of the documents asked for, and compares each with its checksum.

Rows are range-partitioned by document id, sorted and encoded inside their partition as a stream, so
a task holds one batch of texts. A document id that fills a third of the table is spread by the
text's hash. A task writes under a name of its own; only files that successful tasks have reported are read, so
a repeated attempt leaves an unused file and nothing else. Files go through pyarrow's file systems,
to any store a URI names.

Null text encodes as the empty text (the end id alone); null ids come first; repeated rows are kept
one by one, in any order among themselves; an empty table gives no file. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.llm.bpe import encoder
from tallyscope.llm.common import OUT_ROWS, delete_on_exit, documents, ship, text_bytes
from tallyscope.session import scratch_path

# Fixed values of the public zstandard seekable format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80
LEVEL = 1
#: Documents read ahead in one piece while a whole file is scanned.
READ_AHEAD = 4 << 20


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class TokenFileWriter:
    """Appends documents to one open binary stream."""

    def __init__(self, stream, width: int):
        import zstandard

        self.stream, self.width = stream, width
        self.compress = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        self.table, self.doc_ids, self.nulls, self.ids = bytearray(), [], bytearray(), 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids``: little-endian unsigned 32-bit integers."""
        import xxhash

        raw = np.frombuffer(ids, "<u4").astype("<u2").tobytes() if self.width == 2 else ids
        frame = self.compress(raw)
        self.stream.write(frame)
        self.table += struct.pack("<III", len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.ids += len(ids) // 4

    def close(self) -> None:
        directory = struct.pack("<I", self.width) + np.array(self.doc_ids, "<i8").tobytes() + bytes(self.nulls)
        self.stream.write(struct.pack("<II", SKIPPABLE - 1, len(directory)) + directory)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(self.table) + 9) + self.table)
        self.stream.write(struct.pack("<IBI", len(self.doc_ids), CHECKSUMS, SEEKABLE))
        self.stream.close()


class TokenFileReader:
    """Random access to the documents of one file."""

    def __init__(self, uri: str):
        import zstandard

        system, path = _file_system(uri)
        self.file, self.decompress = system.open_input_file(path), zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table = np.frombuffer(self.file.read_at(12 * count, size - 9 - 12 * count), "<u4").reshape(-1, 3)
        self.packed, self.raw, self.checks = (table[:, i].astype("i8") for i in range(3))
        self.starts = np.concatenate([[0], np.cumsum(self.packed)])
        tail = self.file.read_at(12 + 9 * count, int(self.starts[-1]))
        self.width = struct.unpack("<I", tail[8:12])[0]
        self.doc_ids = np.frombuffer(tail, "<i8", count, 12)
        self.nulls = np.frombuffer(tail, "u1", count, 12 + 8 * count)

    def __len__(self) -> int:
        return len(self.packed)

    def _checked(self, i: int, frame: bytes) -> np.ndarray:
        import xxhash

        raw = self.decompress(frame, max_output_size=int(self.raw[i]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[i]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def ids(self, i: int) -> np.ndarray:
        """The ids of document ``i`` alone."""
        return self._checked(i, self.file.read_at(int(self.packed[i]), int(self.starts[i])))

    def __iter__(self) -> Iterator[np.ndarray]:
        at, block = 0, b""
        for i in range(len(self)):
            start, end = int(self.starts[i]), int(self.starts[i + 1])
            if end > at + len(block):
                at, block = start, self.file.read_at(max(READ_AHEAD, end - start), start)
            yield self._checked(i, block[start - at : end - at])

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text"
) -> list[tuple[int, str, int, int]]:
    """Encode all documents into files below ``folder``, in ascending order of ids over the files.

    Returns one (file number, URI, documents, ids) for each file: the manifest.
    """
    ship(docs.sparkSession)

    def write(batches):
        encode, end = encoder(tokenizer), struct.pack("<I", end_id)
        width = 2 if max(encoder(tokenizer).library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        writer, name = None, f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.zst"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if writer is None:
                    system, path = _file_system(name)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    writer = TokenFileWriter(system.open_output_stream(path, compression=None), width)
                writer.add(doc_id, encode.encode(text) + end)
        if writer is not None:
            writer.close()
            row = [[TaskContext.get().partitionId()], [name], [len(writer.doc_ids)], [writer.ids]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["part", "uri", "docs", "ids"])

    ordered = docs.select(F.col(id_column).cast("long").alias("id"), text_bytes(text_column).alias("text"))
    ordered = ordered.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("id").asc_nulls_first()
    )
    rows = ordered.mapInArrow(write, "part long, uri string, docs long, ids long").collect()
    return sorted(tuple(r) for r in rows)


def read_token_files(spark: SparkSession, manifest: list[tuple[int, str, int, int]]) -> DataFrame:
    """All documents of the files: doc_id, start (ids before it), n_tokens, ids_crc32."""
    ship(spark)
    rows, start = [], 0
    for _, uri, _, ids in manifest:
        rows.append((uri, start))
        start += ids

    def read(batches):
        for batch in batches:
            for uri, first in zip(*(c.to_pylist() for c in batch.columns)):
                reader, out = TokenFileReader(uri), []
                for i, ids in enumerate(reader):
                    doc_id = None if reader.nulls[i] else int(reader.doc_ids[i])
                    out.append((doc_id, first, len(ids), zlib.crc32(ids.tobytes())))
                    first += len(ids)
                    if len(out) == OUT_ROWS or i + 1 == len(reader):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, pa.int64()) for x in zip(*out)],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        out = []
                reader.close()

    files = spark.createDataFrame(rows, "uri string, first long")
    if rows:
        files = files.repartitionByRange(len(rows), "first")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write the files to the shared folder and read them back."""
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    delete_on_exit(spark, folder)
    manifest = write_token_files(documents(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, manifest)
