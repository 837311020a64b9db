"""Embedding near-dedup: tiles of vectors in principal axes, compared with early stops."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, components, materialise, named, ship

ship(__name__)

COSINE = 0.9
TILE = 4096
SAMPLE = 20_000
LEAD = 16  # dimensions added per step
SLACK = 1e-9  # of a bound, for rounding
SALTS = 16


def unit_rows(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, v`` with ``v`` null where a vector is null, zero, or holds null or non-finite components."""
    v = named(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = finite & F.exists(v, lambda x: x != 0)
    return vectors.select(named(vec_id).alias("vec_id"), F.when(usable, v).alias("v"))


def principal_axes(classes: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Axes (columns) by falling variance of the unit vectors, from a bounded sample by hash.

    The axes only decide how soon a comparison stops, never its result. Vectors of the most frequent length set
    the dimension; others are compared in their own groups without a change of axes.
    """
    rows = classes.select("v").where(F.pmod(F.xxhash64("v"), F.lit(8)) == 0).limit(sample).collect() or classes.select("v").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    sizes = np.bincount([len(r.v) for r in rows])
    size = int(sizes.argmax())
    x = np.array([r.v for r in rows if len(r.v) == size])
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.linalg.eigh(np.cov(x.T) if len(x) > 1 else np.eye(size))[1][:, ::-1]


def normalised(values: np.ndarray) -> np.ndarray:
    """Rows of length one; divided by their largest part first, so that no square over- or underflows."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def close_pairs(
    a: np.ndarray, b: np.ndarray, threshold: float, same: bool, lead: int = LEAD, rows: int = 256
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit rows (in principal axes) that can reach the threshold, after all dimensions.

    The leading dimensions of all pairs of a tile are multiplied first; the rest of a product is at most the
    product of the suffix norms, so pairs whose sum cannot reach the threshold stop there. The survivors
    continue, ``lead`` dimensions at a time, until their product is complete. Given in blocks of ``rows`` rows of ``a``.
    """
    size = a.shape[1]
    first = min(lead, size)
    suffix_a = np.sqrt(np.cumsum(a[:, ::-1] ** 2, axis=1))[:, ::-1]
    suffix_b = np.sqrt(np.cumsum(b[:, ::-1] ** 2, axis=1))[:, ::-1]
    suffix_a, suffix_b = np.pad(suffix_a, ((0, 0), (0, 1))), np.pad(suffix_b, ((0, 0), (0, 1)))
    # Lead product plus bound of the rest as one product: the suffix norm is a further dimension.
    left = np.hstack([a[:, :first], suffix_a[:, first:first + 1]])
    right = np.hstack([b[:, :first], suffix_b[:, first:first + 1]]).T
    for at in range(0, len(a), rows):
        bound = left[at:at + rows] @ right
        i, j = np.nonzero(bound >= threshold - SLACK)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        done = first
        dot = np.einsum("ij,ij->i", a[i, :first], b[j, :first])
        while done < size and len(i):
            until = min(size, done + lead)
            dot = dot + np.einsum("ij,ij->i", a[i, done:until], b[j, done:until])
            go = dot + suffix_a[i, until] * suffix_b[j, until] >= threshold - SLACK
            i, j, dot, done = i[go], j[go], dot[go], until
        yield i, j


def tiles(classes: DataFrame, axes: np.ndarray, tile: int) -> DataFrame:
    """``classes`` with ``tile``: about ``tile`` vectors each, neighbours along the first axis together.

    Cut points come from a quantile sketch; a tile that ends up larger (many equal places on the axis) is split by
    hash.
    """

    @F.pandas_udf("double")
    def along(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            place = np.zeros(len(batch))
            fit = np.flatnonzero(batch.map(len).to_numpy() == len(axes))
            if len(fit):
                place[fit] = normalised(np.vstack(batch.iloc[fit].to_numpy()).astype(np.float64)) @ axes[:, 0]
            yield pd.Series(place)

    rows = materialise(classes.select("*", F.size("v").alias("dim"), along("v").alias("place")))
    total = rows.count()
    parts = max(1, -(-total // tile))
    cuts = sorted(set(rows.approxQuantile("place", [i / parts for i in range(1, parts)], min(0.01, 0.25 / parts)))) if parts > 1 else []

    @F.pandas_udf("int")
    def slab(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.searchsorted(cuts, batch.to_numpy()).astype(np.int32))

    rows = rows.withColumn("slab", slab("place"))
    counts = rows.groupBy("dim", "slab").agg(F.ceil(F.count("*") / tile).cast("int").alias("split"))
    rows = rows.join(F.broadcast(counts), ["dim", "slab"])  # a row per tile
    part = F.pmod(F.xxhash64("vec_id"), F.col("split"))
    return rows.withColumn("tile", F.struct("dim", "slab", part.cast("int").alias("part")))


def compare(classes: DataFrame, threshold: float = COSINE, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """Links of distinct usable vectors: rows ``(a, b, links)``.

    ``classes`` has ``vec_id, v, n`` (a representative, its vector, its number of copies). Rows with ``links`` above 0
    carry the links of vector ``a`` within a pair of tiles, counted with copies; the others connect ``a`` and ``b``, as a
    forest, the way the pair of tiles links them. Every pair of tiles is one task's work whose size does not depend on the input; pairs of tiles
    further apart on the first axis than the threshold allows are never formed.
    """
    axes = principal_axes(classes, sample)
    placed = materialise(tiles(classes, axes, tile).select("vec_id", "v", "n", "tile", "place"))
    bounds = placed.groupBy("tile").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    bounds = materialise(bounds.withColumn("number", F.xxhash64("tile")))
    apart = float(np.sqrt(max(0.0, 2.0 - 2.0 * threshold)) + 1e-6)
    # All pairs of tiles, dealt out by a salt of the left one.
    left = bounds.select(F.col("tile").alias("t1"), F.col("low").alias("l1"), F.col("high").alias("h1"), "number")
    left = left.withColumn("salt", F.pmod(F.col("number"), F.lit(SALTS)).cast("int")).withColumnRenamed("number", "n1")
    right = bounds.select(F.col("tile").alias("t2"), F.col("low").alias("l2"), F.col("high").alias("h2"), F.col("number").alias("n2"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    meet = left.join(right, (F.col("t1.dim") == F.col("t2.dim")) & (left.salt == right.salt)).where(
        (F.col("t1") <= F.col("t2")) & (F.col("l2") - F.col("h1") <= apart) & (F.col("l1") - F.col("h2") <= apart)
    )
    own = F.when(F.col("t1") == F.col("t2"), F.array("t1")).otherwise(F.array("t1", "t2"))
    sides = meet.select("n1", "n2", "t1", F.explode(own).alias("tile"))
    dealt = sides.join(placed.select("tile", "vec_id", "v", "n"), "tile").select(
        "n1", "n2", (F.col("tile") != F.col("t1")).alias("second"), "vec_id", "v", "n"
    )

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None
        for batch in batches:
            marks = batch[["n1", "n2"]].to_numpy()
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and tuple(marks[a]) != key:
                    yield work(pd.concat(held))
                    held = []
                key = tuple(marks[a])
                held.append(batch.iloc[a:b])
        if held:
            yield work(pd.concat(held))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        ids, n, second = rows["vec_id"].to_numpy(), rows["n"].to_numpy(), rows["second"].to_numpy()
        raw = np.vstack(rows["v"].to_numpy()).astype(np.float64)
        raw /= np.abs(raw).max(axis=1, keepdims=True)
        norm = np.linalg.norm(raw, axis=1)
        turned = raw / norm[:, None]
        if raw.shape[1] == len(axes):
            turned = turned @ axes
        same = not second.any()
        first, other = np.flatnonzero(~second), np.flatnonzero(second)
        other = first if same else other
        counts, label, forest = np.zeros(len(rows)), np.arange(len(rows)), []
        for i, j in close_pairs(turned[first], turned[other], threshold, same):
            i, j = first[i], other[j]
            for at in range(0, len(i), 50_000):
                a, b = i[at:at + 50_000], j[at:at + 50_000]
                # The exact check, in double precision on the vectors as they are.
                keep = np.einsum("ij,ij->i", raw[a], raw[b]) / (norm[a] * norm[b]) >= threshold
                a, b = a[keep], b[keep]
                counts += np.bincount(a, n[b], len(rows)) + np.bincount(b, n[a], len(rows))
                while len(a):
                    apart_ = label[a] != label[b]
                    a, b = a[apart_], b[apart_]
                    if len(a):
                        x, y = sorted((label[a[0]], label[b[0]]))
                        forest.append((ids[x], ids[y]))
                        label[label == y] = x
        linked = np.flatnonzero(counts)
        # A row with links belongs to its first vector alone; one without is an edge of the forest.
        a = np.concatenate([ids[linked], np.array([f[0] for f in forest], np.int64)])
        b = np.concatenate([np.zeros(len(linked), np.int64), np.array([f[1] for f in forest], np.int64)])
        total = np.concatenate([counts[linked].astype(np.int64), np.zeros(len(forest), np.int64)])
        return pd.DataFrame({"a": a, "b": b, "links": total})

    return bounded_batches(dealt).repartition("n1", "n2").sortWithinPartitions("n1", "n2").mapInPandas(link, "a long, b long, links long")


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = COSINE, tile: int = TILE,
    sample: int = SAMPLE,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors``.

    Rows link when the cosine of their vectors is at least ``threshold`` in double precision. Vectors that are null,
    zero or hold null or non-finite components link with nothing, nor do vectors of different lengths. Equal vectors are
    compared once and stand for all their copies. ``component_id`` is the least id reachable by links.

    Ids should be unique and not null: rows of one id count as separate vectors and share the smallest id; rows with a
    null id are passed over when links are made (no links, null component, not kept).
    """
    rows = unit_rows(vectors, vec_id, embedding)
    usable = rows.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    classes = materialise(usable.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")))
    found = materialise(compare(classes, threshold, tile, sample))
    links = found.where("links > 0").groupBy("a").agg(F.sum("links").alias("others"))
    roots = components(found.where("links = 0"))
    classes = classes.join(links, F.col("vec_id") == F.col("a"), "left").drop("a")
    classes = classes.join(roots, F.col("vec_id") == F.col("node"), "left")
    classes = classes.select("v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "vec_id").alias("lead"))
    one = F.when(F.col("vec_id").isNotNull(), F.col("v")).alias("v")
    joined = rows.select("vec_id", one).join(classes, "v", "left")
    component = F.coalesce("lead", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def sql(threshold: float = COSINE) -> str:
    """The same result over ``embeddings`` in SQL, by all pairs."""
    return f"""
with recursive good as (
  select vec_id, v, sqrt(list_inner_product(v, v)) as norm from (select vec_id, embedding::double[] as v from embeddings)
  where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
),
links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_inner_product(a.v, b.v) / (a.norm * b.norm) >= {threshold}
),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select a, min(b) as component_id from reach group by a) c on c.a = e.vec_id
left join (select a, count(*) as n from links group by a) l on l.a = e.vec_id"""
