"""Session settings and the shared folders that jobs may write to."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cohortlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Kryo; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster. Only a local session may fall back to a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    fallback = tempfile.mkdtemp(prefix="cohortlens-")
    atexit.register(shutil.rmtree, fallback, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", fallback)
    context.setCheckpointDir(fallback)
    return fallback


#: Folders handed out inside each open `workspace`, innermost last.
_OPEN: list[list[str]] = []


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder, unique per call, below the shared folder. An open `workspace` owns it."""
    path = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Owner of what is written inside: the folders go when the block ends, so results must be consumed before."""
    _OPEN.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in _OPEN.pop():
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def pinned(df: DataFrame) -> DataFrame:
    """`df` written below the shared folder and read back.

    What follows no longer depends on a re-run of the tasks before it, reads only the columns it
    needs, and Spark knows the size of the result. Run the consumer inside `workspace` to have the
    folder deleted afterwards.
    """
    path = work_dir(df.sparkSession, "pinned")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
