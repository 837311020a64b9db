"""Hashed bag-of-words vectors as plain Spark expressions.

A vector is kept as bucket counts, ``struct<idx: array<int>, cnt: array<int>, norm: double>``.
Dot products of counts are exact integers, so the cosine does not depend on summation order and
equal scores are exactly equal wherever they are computed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import let, words


def bucket(token: Column, dimensions: int) -> Column:
    """First four bytes of the token's SHA-256, big-endian, modulo the dimension count."""
    return F.pmod(F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint"), F.lit(dimensions)).cast("int")


def _run_lengths(ordered: Column) -> Column:
    """Distinct values of a sorted array with their counts, in one pass over neighbours."""
    starts = F.array_compact(F.transform(
        ordered, lambda v, i: F.when((i == 0) | (F.get(ordered, F.greatest(i - 1, F.lit(0))) != v), i)
    ))
    return let(
        starts,
        lambda firsts: F.struct(
            F.transform(firsts, lambda first: F.get(ordered, first)).alias("idx"),
            F.transform(
                firsts, lambda first, i: (F.coalesce(F.get(firsts, i + 1), F.size(ordered)) - first).cast("int")
            ).alias("cnt"),
        ),
    )


def count_vector(text: Column, dimensions: int = K.DENSE_DIMENSIONS) -> Column:
    """Bucket counts and L2 norm of the words of ``text``."""
    ordered = F.sort_array(F.transform(words(text), lambda w: bucket(w, dimensions)))
    return let(
        let(ordered, _run_lengths),
        lambda v: F.struct(
            v["idx"].alias("idx"),
            v["cnt"].alias("cnt"),
            F.sqrt(F.aggregate(v["cnt"], F.lit(0).cast("bigint"), lambda acc, c: acc + c * c).cast("double")).alias("norm"),
        ),
    )


def _counter(dimensions: int) -> Callable[..., Column]:
    """``count_vector`` of lower-cased text by the batch; built from nested definitions, so executors need no copy of the package.

    A worker remembers the hashes of up to 200,000 words.
    """
    word = re.compile(r"[a-z0-9][a-z0-9_\-]*")

    class Hashes(dict):
        def __missing__(self, token: str) -> int:
            if len(self) >= 200_000:
                self.clear()
            self[token] = value = int.from_bytes(sha256(token.encode()).digest()[:4], "big")
            return value

    hashes = Hashes()

    def count(texts: pa.Array) -> pa.Array:
        rows = texts.to_pylist()
        found = [word.findall(row) if row is not None else [] for row in rows]
        sizes = np.fromiter(map(len, found), np.int64, len(rows))
        buckets = np.fromiter((hashes[w] for ws in found for w in ws), np.int64, int(sizes.sum())) % dimensions
        keys, counts = np.unique(np.repeat(np.arange(len(rows)), sizes) * dimensions + buckets, return_counts=True)
        owner = keys // dimensions
        ends = np.searchsorted(owner, np.arange(len(rows) + 1)).astype(np.int32)
        offsets = pa.array(ends, mask=np.array([row is None for row in rows] + [False]))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (keys % dimensions, counts)]
        squares = np.bincount(owner, (counts * counts).astype(np.float64), minlength=len(rows))
        norm = pa.array(np.sqrt(squares), mask=np.array([row is None for row in rows], dtype=bool))
        return pa.StructArray.from_arrays([*lists, norm], ["idx", "cnt", "norm"])

    return F.arrow_udf(count, "struct<idx: array<int>, cnt: array<int>, norm: double>")


def count_vectors(text: Column, dimensions: int = K.DENSE_DIMENSIONS) -> Column:
    """The same value as ``count_vector``, for long columns of text: words are hashed in batches, repeated ones once."""
    return _counter(dimensions)(F.lower(text))


def dot(left: Column, right: Column) -> Column:
    """Exact integer dot product; iterates the shorter-lived left side, probes the right."""
    return F.aggregate(
        F.transform(
            left["idx"],
            lambda b, i: left["cnt"][i].cast("bigint")
            * F.coalesce(F.get(right["cnt"], (F.array_position(right["idx"], b) - 1).cast("int")), F.lit(0)),
        ),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; null when either side has no words."""
    return F.try_divide(dot(left, right).cast("double"), left["norm"] * right["norm"])


def dense_values(vector: Column, dimensions: int = K.DENSE_DIMENSIONS) -> Column:
    """The L2-normalised vector in full; all zeros when there are no words."""

    def fill(v: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(dimensions - 1)),
            lambda b: F.coalesce(
                F.try_divide(F.get(v["cnt"], (F.array_position(v["idx"], b) - 1).cast("int")).cast("double"), v["norm"]),
                F.lit(0.0),
            ),
        )

    return let(vector, fill)


def sparse_values(vector: Column) -> Column:
    """Values parallel to ``idx`` of the L2-normalised sparse vector."""
    return let(vector, lambda v: F.transform(v["cnt"], lambda c: c.cast("double") / v["norm"]))


def array_cosine(left: Column, right: Column) -> Column:
    """Cosine of two plain numeric arrays."""
    def inner(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)

    return F.try_divide(inner(left, right), F.sqrt(inner(left, left)) * F.sqrt(inner(right, right)))
