"""Ingestion as a file stream: keyed state drops re-delivered facts, the rest of each micro-batch is upserted by source key.

The state holds the facts that arrived within ``delay``, so its size is bounded by the arrivals of that time. What comes again
later, and what differs in any column, reaches the upsert, where it changes nothing but what it should. Files may come in any
order: the best fact is chosen by filing date, and a fact keeps the place at which it first came.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dossier import schemas
from dossier.operators.upserts import link_filings, upsert_counts
from dossier.plans.service import linkable, load_number, store_facts
from dossier.session import durable, intermediates
from dossier.sources import feeds
from dossier.sources.tables import TableStore

DELAY = "1 day"
COUNTS = "batch_id bigint, received bigint, created bigint, updated bigint"


def stream_facts(store: TableStore, folder: str, checkpoint: str, delay: str = DELAY) -> StreamingQuery:
    """Load company-fact files as they arrive below ``folder``; stops when caught up.

    A fact that comes again within ``delay`` with the same content, at the same place of its payload, is dropped by the stream.
    """
    payloads = store.spark.readStream.schema(schemas.COMPANY_FACTS).option("multiLine", True).json(folder)
    facts = feeds.flatten_facts(payloads)
    content = [c for c in facts.columns if c != "ingest_seq"]
    arrived = facts.select(
        *content, F.slice("ingest_seq", 2, 4).alias("place"), F.current_timestamp().alias("arrived")
    ).withWatermark("arrived", delay)
    fresh = arrived.dropDuplicatesWithinWatermark([*content, "place"]).drop("arrived")

    def merge(batch: DataFrame, batch_id: int) -> None:
        with intermediates(store.spark):
            # Written once: each evaluation of a micro-batch would go through its state again.
            rows = durable(batch.withColumn("ingest_seq", F.concat(F.array(F.lit(load_number())), "place")).drop("place"), "arrived-facts")
            received = rows.count()
            if not received:
                return
            changed = upsert_counts(store.read_for("facts", rows), rows, ["source_key"]).first()
            store_facts(store, link_filings(rows, linkable(store.read_for("filings", rows)), "filing_accession"))
            counted = store.spark.createDataFrame([(batch_id, received, changed.created, changed.updated)], COUNTS)
            counted.write.mode("overwrite").parquet(f"{_counts(checkpoint)}/load={batch_id}")

    return fresh.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _counts(checkpoint: str) -> str:
    return checkpoint.rstrip("/") + "-counts"


def stream_counts(store: TableStore, checkpoint: str) -> DataFrame:
    """Facts received, created and updated by each micro-batch of a stream that has loaded any.

    A micro-batch that is repeated after a crash overwrites its counts, and may then count as updated what it created before.
    """
    return store.spark.read.schema(COUNTS).parquet(_counts(checkpoint) + "/load=*")
