"""Two-pass external shuffle into shards."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, ensure_shared, free_names, named, ship

ship(__name__)

SHARDS = 8
SEED = 20_240_607
BUCKET_BYTES = 32 << 20


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (none for null) and one more."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def shuffle_buckets(records: DataFrame, path: str, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[str, str]:
    """Write ``records`` below ``path`` as shuffled buckets; returns the names of the two columns added.

    First pass: every record goes to one of ``ceil(bytes / bucket_bytes)`` buckets by a seeded hash of its content and
    its place in the input, so that neither a repeated key nor equal records gather in one bucket. Second pass: a
    task reads one bucket into memory, orders it by content, shuffles it with a generator seeded by the bucket's
    number (Fisher-Yates) and writes it. The columns are the bucket and the place in it.
    """
    bucket, place = free_names(records, "bucket", "place")
    columns = [named(c) for c in records.columns]
    total = records.agg(F.sum(record_size(named(text)))).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    content = F.xxhash64(F.lit(seed), *columns)
    (salt, order) = free_names(records.withColumn(bucket, F.lit(0)).withColumn(place, F.lit(0)), "salt", "content")
    salted = records.withColumn(salt, F.monotonically_increasing_id()).withColumn(order, content)
    dealt = salted.withColumn(bucket, F.pmod(F.xxhash64(named(order), named(salt)), F.lit(buckets)).cast("int")).drop(salt)
    dealt = dealt.repartitionById(buckets, named(bucket)).sortWithinPartitions(bucket, order)
    schema = ", ".join(f"`{c}` {t}" for c, t in records.dtypes) + f", `{bucket}` int, `{place}` long"

    def permute(batches):
        import pyarrow as pa

        def mixed(held, number):
            rows = pa.Table.from_batches(held).drop_columns([order])
            n = rows.num_rows
            rows = rows.take(pa.array(np.random.Generator(np.random.PCG64([seed, number])).permutation(n)))
            yield from rows.append_column(place, pa.array(np.arange(n, dtype=np.int64))).to_batches(max_chunksize=2048)

        held, current = [], None
        for batch in batches:
            numbers = batch.column(batch.schema.get_field_index(bucket)).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and int(numbers[a]) != current:
                    yield from mixed(held, current)
                    held = []
                current = int(numbers[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from mixed(held, current)

    bounded_batches(dealt).mapInArrow(permute, schema).write.parquet(path)
    return bucket, place


def shard(
    records: DataFrame, path: str, shards: int = SHARDS, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """The shuffled records below ``path`` with ``shard`` and ``slot`` (renamed where taken).

    The buckets one after another are a uniform order of all records; it is dealt out record by record, so the shards'
    sizes in rows are at most one apart and slots are gapless from 0 in each. Only the counts of the buckets, one
    number per ``bucket_bytes`` of input, meet on the driver. The written folder holds the whole records.

    Null texts and null values in any column are kept, repeated rows are records of their own, a text larger than a
    bucket makes its bucket larger by itself alone. An empty table gives no rows.
    """
    spark = records.sparkSession
    bucket, place = shuffle_buckets(records, path, text, seed, bucket_bytes)
    written = spark.read.schema(records.withColumn(bucket, F.lit(0)).withColumn(place, F.lit(0).cast("long")).schema).parquet(path)
    counts = {r[0]: r[1] for r in written.groupBy(named(bucket)).count().collect()}
    before, rows = 0, []
    for number in sorted(counts):
        rows.append((number, before))
        before += counts[number]
    own, start = free_names(written, "own_bucket", "start")
    offsets = spark.createDataFrame(rows, f"`{own}` int, `{start}` long")
    at = named(start) + named(place)
    names = free_names(records, "shard", "slot")
    joined = written.join(F.broadcast(offsets), named(bucket) == named(own))
    return joined.select(
        *[named(c) for c in records.columns], (at % shards).cast("int").alias(names[0]), F.floor(at / shards).cast("long").alias(names[1])
    )


def write_shards(sharded: DataFrame, path: str, shard: str = "shard") -> None:
    """One folder per shard; every task writes what it holds of each."""
    sharded.write.partitionBy(shard).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    ensure_shared(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a path made by ``scratch``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
