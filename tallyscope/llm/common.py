"""Helpers shared by the corpus operators: input columns, scratch tables, shipping code to tasks."""

from __future__ import annotations

import ctypes
import inspect
import os
import tempfile
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyscope.session import scratch_path

#: Records in one Arrow batch that a task hands back; keeps a worker's memory flat.
OUT_ROWS = 4096
#: Records of a batch that are Python values at a time.
FEW_ROWS = 256


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application (as ``--py-files`` would)."""
    context = spark.sparkContext
    if getattr(context, "_tallyscope_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="tallyscope-code-"), "tallyscope_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._tallyscope_shipped = True


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder when the driver ends."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def scratch(frame: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, safe against lost
    executors, with a fixed placement of rows. The folder goes when the driver ends."""
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def give_back() -> None:
    """Return memory that freed objects left in this worker to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """A function of batches, or of one group's table, after which a worker keeps no freed memory: it
    may stay idle for long, beside an executor that needs the room."""

    def batches_then_back(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    def group_then_back(table):
        out = run(table)
        give_back()
        return out

    return batches_then_back if inspect.isgeneratorfunction(run) else group_then_back


_held: dict[str, dict] = {}


def held(kind: str, make: Callable[[], dict] = dict) -> dict:
    """This worker's cache of one kind. Workers serve one stage after the other: the caches of other
    kinds are emptied first, and their memory goes back."""
    if kind not in _held:
        for other in _held.values():
            other.clear()
        _held.clear()
        give_back()
        _held[kind] = make()
    return _held[kind]


def unused(frame: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, whatever its case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def few_at_a_time(batch: pa.RecordBatch, *columns: str | int):
    """The rows of a batch as tuples of Python values, without ever holding all of them besides the batch."""
    for at in range(0, batch.num_rows, FEW_ROWS):
        some = batch.slice(at, FEW_ROWS)
        yield from zip(*(some.column(c).to_pylist() for c in columns))


def plain_names(frame: DataFrame) -> DataFrame:
    """Columns numbered, for ``mapInArrow``, which can't take names with dots."""
    return frame.toDF(*(f"c{i}" for i in range(len(frame.columns))))


def text_bytes(text: Column | str = "text") -> Column:
    """The text as UTF-8 bytes, empty for null. Tasks take bytes, so that nothing is decoded twice."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def held_out(doc_id: Column | str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def fraction_of(frame: DataFrame, key: Column, rows: int, total: int) -> DataFrame:
    """About ``rows`` of ``total`` rows, chosen by a hash of ``key``; all of them when there are fewer."""
    if total <= rows:
        return frame
    limit = int(rows / total * (1 << 30))
    return frame.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) < limit)
