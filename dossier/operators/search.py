"""Exact search: nearest vectors over whole tables, and sparse retrieval through posting lists."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.vectors import cosine
from dossier.operators.retrieval import embed_questions, keep_top, largest_top_k
from dossier.session import durable

# Executors need no copy of the package: the functions of this module travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Vectors of a tile and queries of a block: the scores of one unit of work take 32 MB at most.
TILE, BLOCK = 4096, 1024
DIGITS = 9
# Postings of one part of a list, and the greatest weights that its head states.
SEGMENT, HEAD = 4096, K.MAX_TOP_K


# ---- vectors ----


def usable(vector: Column) -> Column:
    """The vector in doubles; null where it is null, all zero, or holds null or non-finite components."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite & F.exists(doubles, lambda x: x != 0), doubles)


def unit_rows(vectors: pd.Series) -> np.ndarray:
    rows = np.vstack(vectors.to_numpy())
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def best_of(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best vectors of one tile for every query of one block; equal scores by id."""
    asked, held = rows[rows["asked"]], rows[~rows["asked"]].sort_values("id", kind="stable")
    if not len(asked) or not len(held):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
    scores = np.round(unit_rows(asked["v"]) @ unit_rows(held["v"]).T, DIGITS) + 0.0
    least = -np.partition(-scores, min(k, len(held)) - 1, axis=1)[:, min(k, len(held)) - 1]
    i, j = np.nonzero(scores >= least[:, None])
    order = np.lexsort((j, -scores[i, j], i))
    i, j = i[order], j[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    i, j = i[first], j[first]
    return pd.DataFrame({"query_id": asked["id"].to_numpy()[i], "vec_id": held["id"].to_numpy()[j], "score": scores[i, j]})


def nearest(queries: DataFrame, vectors: DataFrame, k: int, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of greatest cosine for every query, over all of ``vectors``.

    Both have ``id, vector``. Blocks of queries meet tiles of vectors as units of a fixed size, each of which keeps ``k`` rows
    a query; those are merged, cut again in every task before the shuffle. Scores are rounded to nine digits and ties go to
    the smaller id. Vectors without a direction have no score; those of different lengths do not meet.
    """
    found = {}
    for name, rows in (("asked", queries), ("held", vectors)):
        rows = rows.select(F.col("id").cast("bigint").alias("id"), usable(F.col("vector")).alias("v")).where("v is not null and id is not null")
        found[name] = rows.withColumn("dim", F.size("v"))
    sizes = found["held"].groupBy("dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sizes = sizes.join(found["asked"].groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "dim")
    hashed = F.xxhash64("id")

    def units(rows: DataFrame, own: str, other: str, asked: bool) -> DataFrame:
        spread = rows.join(sizes, "dim").select(
            "dim", "id", "v", F.pmod(hashed, F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)
        )
        return spread.select("dim", "blocks", "tiles", F.lit(asked).alias("asked"), "id", "v")

    both = units(found["asked"], "blocks", "tiles", True).union(units(found["held"], "tiles", "blocks", False))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None
        for batch in batches:
            for mine, rows in batch.groupby(["dim", "blocks", "tiles"], sort=False):
                if held and mine != key:
                    yield best_of(pd.concat(held), k)
                    held = []
                key = mine
                held.append(rows)
        if held:
            yield best_of(pd.concat(held), k)

    dealt = both.repartition("dim", "blocks", "tiles").sortWithinPartitions("dim", "blocks", "tiles")
    scored = dealt.mapInPandas(score, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


# ---- posting lists ----


def _inverter() -> Callable[..., Column]:
    """The lists of one segment from the vectors of its chunks, which come in the order of their ids."""

    def invert(chunks: pa.Array) -> pa.Array:
        buckets, weights, places, per_list, per_row = [], [], [], [], []
        for row in range(len(chunks)):
            idx, cnt, norm = chunks.slice(row, 1).flatten().flatten()
            sizes = idx.value_lengths().to_numpy(zero_copy_only=False)
            bucket, place = idx.flatten().to_numpy(), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            weight = cnt.flatten().to_numpy() / np.repeat(norm.to_numpy(), sizes)
            order = np.lexsort((place, -weight, bucket))
            bucket = bucket[order]
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            buckets.append(bucket[first])
            weights.append(weight[order])
            places.append(place[order])
            per_list.append(np.diff(np.r_[first, len(bucket)]))
            per_row.append(len(first))

        def joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *parts]).astype(kind)

        def nested(sizes: np.ndarray, values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)

        weight, sizes = joined(weights, "f8"), joined(per_list, "i8")
        starts = np.cumsum(sizes) - sizes
        leading = np.arange(len(weight)) - np.repeat(starts, sizes) < most_of_head
        lists = pa.StructArray.from_arrays(
            [
                pa.array(joined(buckets, "i4")), pa.array(weight[starts]), nested(np.minimum(sizes, most_of_head), pa.array(weight[leading])),
                nested(sizes, pa.array(joined(places, "i4"))),
            ],
            ["bucket", "most", "head", "places"],
        )
        return nested(np.array(per_row, dtype="i8"), lists)

    most_of_head = HEAD
    return F.arrow_udf(invert, "array<struct<bucket: int, most: double, head: array<double>, places: array<int>>>")


def list_segments(index: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The inverted index of ``accession_number, chunk_id, sparse_vector``: ``accession_number, part, chunk_ids, lists``.

    A row holds all lists of one filing, whose postings are places in ``chunk_ids``, so a chunk's vector is moved once and not
    its postings one by one. A filing of very many chunks is cut into parts by a hash of the chunk, so none outgrows a row; there
    are at most as many such filings as ``segment`` goes into the index, few enough to broadcast.
    """
    cut = index.groupBy("accession_number").agg(F.ceil(F.count("*") / segment).cast("int").alias("parts")).where("parts > 1")
    rows = index.where("sparse_vector.norm > 0").join(F.broadcast(cut), "accession_number", "left")
    part = F.pmod(F.xxhash64("chunk_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    chunk = F.struct("chunk_id", "sparse_vector.idx", "sparse_vector.cnt", "sparse_vector.norm")
    gathered = rows.select("accession_number", part, chunk.alias("chunk")).groupBy("accession_number", "part").agg(
        F.array_sort(F.collect_list("chunk")).alias("chunks")
    )
    vectors = F.transform("chunks", lambda c: F.struct(c["idx"].alias("idx"), c["cnt"].alias("cnt"), c["norm"].alias("norm")))
    return gathered.select("accession_number", "part", F.col("chunks.chunk_id").alias("chunk_ids"), _inverter()(vectors).alias("lists"))


def _as_rows(segments: DataFrame, lists: Column) -> DataFrame:
    rows = segments.select("accession_number", "part", "chunk_ids", F.explode(lists).alias("l"))
    ids = F.transform("l.places", lambda place: F.get("chunk_ids", place))
    return rows.select("accession_number", "l.bucket", "part", "l.most", "l.head", ids.alias("postings"))


def build_postings(index: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The inverted index as one row per part of a list: ``accession_number, bucket, part, most, head, postings``.

    The greatest weight, the greatest few in order, and the postings (``chunk_id``, heaviest first). A weight is the
    bucket's share of its chunk's vector.
    """
    return _as_rows(list_segments(index, segment), F.col("lists"))


def asked_lists(terms: DataFrame, segments: DataFrame) -> DataFrame:
    """``build_postings`` for the terms' buckets alone: the terms of a filing meet each of its segments once."""
    asked = terms.groupBy("accession_number").agg(F.collect_set("bucket").alias("asked"))
    met = segments.join(asked, "accession_number")
    return _as_rows(met, F.filter("lists", lambda held: F.array_contains("asked", held["bucket"])))


def essential_terms(terms: DataFrame, postings: DataFrame) -> DataFrame:
    """The terms ``(question_id, accession_number, bucket)`` whose lists have to be read.

    A list's head alone bounds what its term can add to a score, and gives a score that ``top_k`` chunks reach. Terms are
    passed over, least bound first, while all those passed over together stay below that score: a chunk that
    has no other term cannot be among the best.
    """
    weight = F.col("cnt") / F.col("norm")
    heads = terms.join(postings.select("accession_number", "bucket", "most", "head"), ["accession_number", "bucket"])
    reach = F.when(F.size("head") >= F.col("top_k"), F.get("head", F.col("top_k") - 1)).otherwise(0.0)
    bounds = heads.groupBy("question_id", "accession_number", "bucket").agg(
        F.max(weight * F.col("most")).alias("bound"), F.max(weight * reach).alias("reached")
    )
    rising = Window.partitionBy("question_id").orderBy("bound", "bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("question_id")
    judged = bounds.withColumn("passed", F.sum("bound").over(rising)).withColumn("least", F.max("reached").over(whole))
    return judged.where(F.col("passed") >= F.col("least") - 1e-9).select("question_id", "accession_number", "bucket")


def retrieve_sparse(questions: DataFrame, index: DataFrame, postings: DataFrame) -> DataFrame:
    """Top-k chunks per question by cosine of sparse vectors, among the chunks that share a word with it; ties by chunk id.

    Only the lists of the question's essential terms are read; the exact scores come from the vectors of the chunks found.
    ``postings`` are rows of ``build_postings`` or, for large tables, of ``list_segments``.
    """
    keyed = embed_questions(questions, "sparse_vector", K.SPARSE_DIMENSIONS)
    entry = F.explode(F.arrays_zip("sparse_vector.idx", "sparse_vector.cnt")).alias("e")
    terms = keyed.select("question_id", "accession_number", "top_k", F.col("sparse_vector.norm").alias("norm"), entry)
    terms = terms.select("question_id", "accession_number", "top_k", "norm", F.col("e.idx").alias("bucket"), F.col("e.cnt").alias("cnt"))
    if "lists" in postings.columns:
        postings = durable(asked_lists(terms, postings), "asked-lists")
    read = essential_terms(terms, postings).join(postings.select("accession_number", "bucket", "postings"), ["accession_number", "bucket"])
    found = read.select("question_id", "accession_number", F.explode("postings").alias("chunk_id")).distinct()
    asked = keyed.select("question_id", "top_k", F.col("sparse_vector").alias("asked"))
    scored = found.join(asked, "question_id").join(index.select("accession_number", "chunk_id", "sparse_vector"), ["accession_number", "chunk_id"])
    scored = scored.select("question_id", "top_k", "accession_number", "chunk_id", cosine(F.col("asked"), F.col("sparse_vector")).alias("score"))
    return keep_top(scored, F.desc("score"), largest_top_k(keyed))
