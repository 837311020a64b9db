"""Idempotent loading: upserts by key, created/updated counts, replace-by-key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one that is greatest by ``order``, whole (nulls overwrite)."""
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "row.*").select(*rows.columns)


def upsert(
    stored: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str], kept: Sequence[str] = ()
) -> DataFrame:
    """``stored`` with every incoming key inserted or overwritten; the last incoming row of a key wins.

    Columns in ``kept`` stay as they are stored where the key exists. Only the incoming side is reduced; stored rows are
    unique already and pass through an anti-join.
    """
    newest = latest_per_key(incoming, keys, order)
    untouched = stored.join(newest.select(*keys), list(keys), "left_anti")
    if kept:
        first = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in kept])
        newest = newest.join(first, list(keys), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in kept})
    return untouched.unionByName(newest.select(*stored.columns))


def upsert_counts(stored: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many incoming rows create a key and how many update one.

    A key that is new and occurs n times counts once as created and n - 1 times as updated.
    """
    sizes = incoming.groupBy(*keys).agg(F.count("*").alias("n"))
    existing = stored.select(*keys).distinct().withColumn("known", F.lit(True))
    created = F.coalesce(F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)), F.lit(0))
    return sizes.join(existing, list(keys), "left").agg(
        created.cast("bigint").alias("created"),
        (F.coalesce(F.sum("n"), F.lit(0)) - created).cast("bigint").alias("updated"),
    )


def replace_by_key(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], affected: DataFrame | None = None) -> DataFrame:
    """Drop every stored row of an affected key, then add the incoming rows.

    ``affected`` names the keys to clear; by default the keys present in ``incoming``.
    """
    cleared = (affected if affected is not None else incoming).select(*keys).distinct()
    return stored.join(cleared, list(keys), "left_anti").unionByName(incoming)


def only_for(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts whose accession number belongs to one of the filings."""
    return facts.join(filings.select("accession_number"), "accession_number", "left_semi")


def link_filings(facts: DataFrame, filings: DataFrame, key: str = "filing_key") -> DataFrame:
    """Facts with the key of their filing, null where the filing is unknown."""
    return facts.join(filings.select("accession_number", key), "accession_number", "left")


def first_per_group(rows: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """First ``limit`` rows per group in source order (bounded per task before the shuffle)."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)
