"""Session defaults and the shared folder used for materialised intermediate frames."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app_name: str = "tallyscope", **conf: str) -> SparkSession:
    """A session with adaptive execution on and wall-clock (zone free) time handling."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session that runs in one process without that setting (a laptop) gets a temporary folder,
    removed at its end; on a cluster, a local one included, a machine-local folder would be invisible to
    the other executors, so we refuse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tallyscope-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries built and run inside leave no shuffle files behind.

    Only for a result that is kept elsewhere: a second run of the same frame would shuffle again.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def materialise(frame: DataFrame) -> DataFrame:
    """Write an already aggregated frame once to the shared folder and cut its lineage.

    The files survive the loss of an executor, so later jobs never recompute the raw scan. They are columns,
    compressed: a few times smaller than rows, and later jobs read only those they use. The shuffles
    behind them are deleted at once. Where rows must keep their partition and order, see ``checkpointed``.
    """
    spark = frame.sparkSession
    if "void" in frame.schema.simpleString():  # files of columns have no such type
        return checkpointed(frame)
    path = scratch_path(spark, "rows")
    with freed_shuffles(spark):
        frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def checkpointed(frame: DataFrame) -> DataFrame:
    """Write a frame once with its partitions and the order of their rows, and cut its lineage."""
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    with freed_shuffles(frame.sparkSession):
        return frame.select("*").checkpoint(eager=True)
