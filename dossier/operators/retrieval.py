"""Hash-vector index and filtered top-k similarity search within filings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.coerce import point_id
from dossier.functions.vectors import cosine, count_vector, count_vectors
from dossier.session import durable, in_request

EMBED_MODES = ("text", "text_with_metadata")


def embed_chunks(
    chunks: DataFrame,
    dimensions: int = K.DENSE_DIMENSIONS,
    embed_mode: str = "text",
    column: str = "vector",
) -> DataFrame:
    """Add the count vector of each chunk: of its text alone, or of its metadata lines and text."""
    if embed_mode not in EMBED_MODES:
        raise ValueError(f"embed_mode must be one of {EMBED_MODES}")
    body = F.col("text")
    if embed_mode == "text_with_metadata":
        fields = [f for f in chunks.schema["metadata"].dataType.names]
        lines = [F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f"metadata.{f}").cast("string"), F.lit("None"))) for f in fields]
        body = F.concat_ws("\n", *lines, body)
    vector = count_vector if in_request() else count_vectors
    return chunks.withColumn(column, vector(body, dimensions))


def build_index(chunks: DataFrame, hybrid: bool = False, embed_mode: str = "text") -> DataFrame:
    """The searchable table: chunk rows, a stable point id, the dense and optionally the sparse vector."""
    index = embed_chunks(chunks, embed_mode=embed_mode).withColumn("point_id", point_id(F.col("chunk_id")))
    return embed_chunks(index, K.SPARSE_DIMENSIONS, embed_mode, "sparse_vector") if hybrid else index


def filter_by(df: DataFrame, **values: object) -> DataFrame:
    """Conjunctive equality filter; an absent (null) value puts no condition on its column."""
    for name, value in values.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def filter_matches(question: str, chunk: str, keys: Sequence[str]) -> Column:
    """The same filter with per-question values: a null question field matches every chunk."""
    condition = F.lit(True)
    for key in keys:
        wanted = F.col(f"{question}.{key}")
        condition = condition & (wanted.isNull() | F.coalesce(wanted == F.col(f"{chunk}.{key}"), F.lit(False)))
    return condition


def score_pairs(
    questions: DataFrame,
    index: DataFrame,
    filters: Sequence[str] = (),
    vector: str = "vector",
    score: str = "score",
) -> DataFrame:
    """Similarity of each question to the chunks of its own filing that pass the filters.

    An equi-join on the accession number: never a product over filings. Adaptive execution turns it
    into a broadcast when the questions are measured to be small and splits a filing that attracts
    most of the questions. Only ids and the score leave the join.
    """
    q, c = questions.alias("q"), index.alias("c")
    joined = q.join(c, (F.col("q.accession_number") == F.col("c.accession_number")) & filter_matches("q", "c", filters))
    return joined.select(
        F.col("q.question_id"),
        F.col("q.top_k"),
        F.col("c.accession_number"),
        F.col("c.chunk_id"),
        cosine(F.col(f"q.{vector}"), F.col(f"c.{vector}")).alias(score),
    ).where(F.col(score).isNotNull())


def largest_top_k(questions: DataFrame) -> int:
    """The greatest ``top_k`` that any of the (written) questions asks for."""
    return questions.agg(F.max("top_k")).first()[0] or 0


def keep_top(scored: DataFrame, order: Column, limit: int) -> DataFrame:
    """First ``top_k`` rows per question; ``limit`` is the greatest of them.

    The literal bound lets Spark keep at most ``limit`` rows per question in every task before the
    shuffle, so a question with very many candidates never reaches one task whole.
    """
    w = Window.partitionBy("question_id").orderBy(order, F.col("chunk_id"))
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return ranked.where(F.col("rank") <= F.col("top_k"))


def embed_questions(questions: DataFrame, column: str, dimensions: int, keep: Sequence[str] = ()) -> DataFrame:
    """Question vectors as a small written table, so that they are computed once and not per pair."""
    vector = count_vector(F.col("question"), dimensions).alias(column)
    return durable(questions.select("question_id", "accession_number", "top_k", *keep, vector), "question-vectors")


def retrieve(
    questions: DataFrame,
    index: DataFrame,
    filters: Sequence[str] = ("form_type", "fiscal_year", "fiscal_quarter", "section_type"),
) -> DataFrame:
    """Top-k chunks per question by cosine similarity, ties by chunk id.

    ``questions``: ``question_id, question, accession_number, top_k`` and the filter columns.
    Ranks on ids first and fetches the chunk text for the winners only.
    """
    keyed = embed_questions(questions, "vector", K.DENSE_DIMENSIONS, filters)
    slim = index.select("accession_number", "chunk_id", "vector", *[f for f in filters if f != "accession_number"])
    return keep_top(score_pairs(keyed, slim, filters), F.desc("score"), largest_top_k(keyed))


def fetch_hits(hits: DataFrame, index: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach chunk columns to retrieved ids."""
    wanted = [c for c in columns if c not in ("accession_number", "chunk_id")]
    return hits.join(index.select("accession_number", "chunk_id", *wanted), ["accession_number", "chunk_id"])


def strong(hits: DataFrame, minimum: float = K.MIN_SIMILARITY) -> DataFrame:
    """Hits at or above the similarity floor; an unknown score passes, NaN does not."""
    score = F.col("score")
    return hits.where(score.isNull() | ((score >= minimum) & ~F.isnan(score)))


def _relative(score: str) -> Column:
    """Min-max scaled score within the question's list; all-equal lists keep their score."""
    w = Window.partitionBy("question_id")
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.coalesce(F.try_divide(F.col(score) - low, high - low), F.col(score))


def retrieve_hybrid(questions: DataFrame, index: DataFrame, alpha: float = 0.5, filters: Sequence[str] = ()) -> DataFrame:
    """Dense and sparse top-k lists fused by relative score: ``alpha * dense + (1 - alpha) * sparse``.

    Each list is cut to the question's ``top_k`` and min-max scaled; a chunk missing from a list
    contributes zero for it.
    """
    lists = []
    for vector, dimensions, name in (("vector", K.DENSE_DIMENSIONS, "dense"), ("sparse_vector", K.SPARSE_DIMENSIONS, "sparse")):
        keyed = embed_questions(questions, vector, dimensions, filters)
        slim = index.select("accession_number", "chunk_id", vector, *[f for f in filters if f != "accession_number"])
        limit = largest_top_k(keyed)
        top = keep_top(score_pairs(keyed, slim, filters, vector=vector), F.desc("score"), limit)
        lists.append(
            top.withColumn("part", _relative("score") * (alpha if name == "dense" else 1 - alpha)).select(
                "question_id", "top_k", "accession_number", "chunk_id", "part"
            )
        )
    fused = (
        lists[0].unionByName(lists[1])
        .groupBy("question_id", "top_k", "accession_number", "chunk_id")
        .agg(F.sum("part").alias("score"))
    )
    return keep_top(fused, F.desc(F.round("score", 9)), limit)
