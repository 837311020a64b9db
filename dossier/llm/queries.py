"""The registered queries of the operators, with their production parameters, and the SQL of those that have one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import (
    common, decontam, infill, langid, licences, linededup, packing, pii, quotes, sharding, simhash, turnfix, vectors, voronoi,
)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: what stands open, and what is disguised."""
    found = pii.detect(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, every = F.col("pii.base"), F.concat("pii.base", "pii.added")
    counts = [pii.count(base, kind).alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(every).alias("spans"),
        F.size("pii.added").cast("long").alias("n_added"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and place of every document after the two passes; the digest is taken from the written records."""
    docs = common.table(spark, sf_dir, "documents")
    folder = sharding.scratch(spark, "shards")
    found = sharding.shard(docs, folder)
    digest = common.materialise(found.select(
        "doc_id", sharding.record_size(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    ))
    sharding.discard(spark, folder)
    return digest


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the labelled ones."""
    docs = common.table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.training_rows(docs)))
    found = langid.identify(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(~langid.training_rows(found), F.lit(False))
    return found.select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices and texts among all lines and documents."""
    return licences.scan(common.table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.9 or more."""
    return vectors.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op7_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages without quotations, linked to the messages they quote."""
    return quotes.link(common.table(spark, sf_dir, "conversations"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test windows found in every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find(docs, common.table(spark, sf_dir, "benchmark"))
    items = F.col("found.item_ids")
    return found.select(
        "doc_id", F.col("found.n_words").alias("n_words"), F.col("found.n_hit").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        decontam.contaminated().alias("contaminated"),
    )


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens."""
    docs = common.table(spark, sf_dir, "documents")
    return packing.pack(common.materialise(packing.tokenise(docs, with_ids=False)))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page without the boilerplate lines of its host."""
    pages = common.table(spark, sf_dir, "pages")
    rows = pages.select("page_id", common.host_of(F.col("url")).alias("host"), linededup.html_lines(F.col("html")).alias("text"))
    rows = common.materialise(rows)  # read twice; the markup is read once
    return linededup.drop_lines(rows, counts=("n_lines", "n_dropped"))


def op11_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors of greatest integer inner product with every fiftieth vector."""
    vectors_ = common.table(spark, sf_dir, "embeddings")
    return voronoi.top_k(vectors_, F.col("vec_id") % 50 == 0, k=5)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after reproducible damage."""
    conversations = common.table(spark, sf_dir, "conversations")
    return turnfix.audit(turnfix.damage(conversations), every=conversations)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut in three and rearranged; the digests are taken from the output and from the text rebuilt of it."""
    found = infill.transform(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    output, form = F.col("infill.output"), F.col("infill.form")
    return found.select(
        "doc_id", "infill.n", "infill.form", "infill.prefix_chars", "infill.middle_chars", F.sha2(output, 256).alias("output_sha256"),
        F.sha2(infill.restored(output, form), 256).alias("restored_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_sharding": op2_sharding,
    "op3_language_id": op3_language_id,
    "op4_simhash": op4_simhash,
    "op5_licence_scan": op5_licence_scan,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_quotation_linking": op7_quotation_linking,
    "op8_decontamination": op8_decontamination,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_line_dedup": op10_line_dedup,
    "op11_voronoi_topk": op11_voronoi_topk,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op5_licence_scan": licences.sql(),
    "op6_embedding_dedup": vectors.sql(),
    "op7_quotation_linking": quotes.sql(),
    "op8_decontamination": decontam.sql(),
    "op10_line_dedup": linededup.pages_sql(),
    "op11_voronoi_topk": voronoi.sql(),
    "op12_conversation_repair": turnfix.sql(),
    "op13_fill_in_middle": infill.sql(),
}
