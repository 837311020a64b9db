"""Session construction and the shared folder for durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings that change results are pinned; sizing is left to the cluster.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_spark(app_name: str = "dossier", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session; ``master`` is only set for local runs and tests."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the setting is absent one is made for a local master only, because a machine-local folder is
    invisible to the other machines of a cluster.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="dossier-")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


_WRITTEN: list[str] = []
_REQUEST: ContextVar[bool] = ContextVar("request", default=False)
# A request of one filing has no skew to even out and no sizes to find out about; compiling stages costs more than its rows.
REQUEST_CONF = {
    "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false",
}


def in_request() -> bool:
    return _REQUEST.get()


@contextmanager
def single_request(spark: SparkSession) -> Iterator[None]:
    """A block that answers one request about one or two filings, where jobs cost more than rows.

    Its intermediate results are bounded by these filings, so they stay with the driver as local relations, whose known
    sizes let Spark plan joins without a job to measure them. Nothing lazy may leave the block.
    """
    before = {key: spark.conf.get(key, None) for key in REQUEST_CONF}
    token = _REQUEST.set(True)
    try:
        for key, value in REQUEST_CONF.items():
            spark.conf.set(key, value)
        yield
    finally:
        _REQUEST.reset(token)
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """A block in which the shuffle files of every finished job are removed at once, not when the driver next collects garbage.

    Only for jobs that write their whole result, so that no later job reads their shuffles.
    """
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def at_driver(df: DataFrame) -> DataFrame:
    """The rows of a small result as a local relation; for single requests only."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def durable(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back; what its job shuffled is removed.

    Used where several later stages read the same costly result: the written table cuts the
    lineage, survives the loss of executors and still gives column pruning on every read.
    It stays until ``release`` or the end of an ``intermediates`` block. Within a single request it is a local
    relation instead.
    """
    if in_request():
        return at_driver(df)
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    with shuffles_removed(spark):
        df.write.mode("errorifexists").parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def temporary_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed like an intermediate table."""
    _WRITTEN.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def durable_parts(parts: Iterable[DataFrame], label: str, compression: str = "snappy") -> DataFrame:
    """Write one table part by part and read it back: what the job of a part shuffled is gone before the next begins."""
    path = None
    for df in parts:
        path = path or temporary_path(df.sparkSession, label)
        with shuffles_removed(df.sparkSession):
            df.write.mode("append").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame, label: str) -> None:
    """Remove the table that ``durable`` wrote last under this label, once nothing lazy reads it any more."""
    for path in reversed(_WRITTEN):
        if path.startswith(f"{shared_dir(df.sparkSession)}/{label}-"):
            remove(df.sparkSession, path)
            return _WRITTEN.remove(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Remove the intermediate tables written after the first ``keep`` ones; call it when results have been consumed."""
    while len(_WRITTEN) > keep:
        remove(spark, _WRITTEN.pop())


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """A block whose intermediate tables are removed at its end; nothing lazy may leave it."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        release(spark, before)
