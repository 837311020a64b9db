"""Helpers shared by the operators: input columns, shared storage, shipping of modules, connected components."""

from __future__ import annotations

import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(name: str) -> None:
    """Send the functions of a module to the executors by value, so that they need no copy of the repository."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_shared(spark: SparkSession) -> None:
    """Make checkpoints possible: in the folder named by ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent, a temporary folder serves a local master only.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="dossier-checkpoints-")
    context.setCheckpointDir(folder)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session that hands texts to Python a few megabytes at a time.

    An executor holds several copies of a batch on both sides; 64 MB each, the default, would be most of a small
    executor's memory outside the heap. Only the size of batches changes, never a result; a smaller setting is kept.
    """
    conf = df.sparkSession.conf
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(BATCH)) > BATCH_BYTES:
        conf.set(BATCH, str(BATCH_BYTES))
    return df


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and cut its lineage there.

    Spark's context cleaner removes the files when nothing refers to them any more
    (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    ensure_shared(df.sparkSession)
    return df.checkpoint(eager=True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` does not use yet (Spark resolves names without regard to case)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def named(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def host_of(url: Column) -> Column:
    """The lower-case host of an address; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(a, b)`` of longs: one row ``(node, root)`` per node.

    ``root`` is the smallest node of the component. Alternates two contractions until nothing changes: every
    node links its larger neighbours to the least of its neighbourhood, then its smaller ones. Each step is a
    map-side combined minimum and an equi-join that adaptive execution splits where a node has many links, so
    no task ever holds the links of one node. The number of edges never grows.
    """
    edges = materialise(edges.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Every edge now runs from a larger node to a smaller one.
        least = linked.groupBy("a").agg(F.min("b").alias("m"))
        down = linked.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = materialise(down.union(least.select("a", F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
