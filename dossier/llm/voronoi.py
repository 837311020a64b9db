"""Exact top-k by inner product as a Voronoi join: cells around pivots, bounds from their summaries, local solving."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dossier.llm.common import bounded_batches, materialise, named, ship

ship(__name__)

K = 5
SCALE = 256
# Most pivots, the square root of the number of vectors up to here: they and their summaries go to every task.
PIVOTS = 1024
TILE = 8192  # data vectors of one unit of work
BLOCK = 2048  # queries of one unit of work
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def whole(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component as whole doubles; null for vectors that take no part.

    Those are vectors that are null or hold null or non-finite components (as they are or after scaling).
    """
    scaled = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    usable = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a double is a long in Spark; beyond 2 ** 53 every double is whole already.
    floor = F.transform(scaled, lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    return F.when(usable, floor)


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows, exactly: in doubles where no sum can pass 2 ** 53, else in whole numbers.

    Products beyond a long stand at its ends.
    """
    size = queries.shape[1]
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * size
    if most < EXACT:
        return (queries @ data.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in queries.tolist()], [[int(x) for x in row] for row in data.tolist()]
    made = [[min(LONG, max(-LONG - 1, sum(a * b for a, b in zip(q, d)))) for d in exact[1]] for q in exact[0]]
    return np.array(made, np.int64).reshape(len(queries), len(data))


class Cells:
    """The pivots with the summaries of their cells: what bounds a score without a look at the cell's vectors."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        self.squares = (pivots ** 2).sum(axis=1)
        # Filled in by ``summarised``: farthest member, longest member, the members kept as witnesses.
        self.radius = np.full(len(pivots), -np.inf)
        self.longest = np.zeros(len(pivots))
        self.witnesses = np.zeros((0, pivots.shape[1]))
        self.copies = np.zeros(0, np.int64)

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        squares = (vectors ** 2).sum(axis=1)[:, None] + self.squares[None, :] - 2.0 * (vectors @ self.pivots.T)
        return np.sqrt(np.maximum(squares, 0.0))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = self.distances(vectors)
        cell = far.argmin(axis=1)
        # From the difference itself: the expanded square loses digits for a vector on its pivot.
        return cell, np.sqrt(((vectors - self.pivots[cell]) ** 2).sum(axis=1))

    def threshold(self, queries: np.ndarray, k: int) -> np.ndarray:
        """A score that at least ``k`` vectors reach, per query: the k-th best of the witnesses, counted with copies."""
        if self.copies.sum() < k:
            return np.full(len(queries), -np.inf)
        found = queries @ self.witnesses.T
        order = np.argsort(-found, axis=1, kind="stable")
        enough = (np.cumsum(self.copies[order], axis=1) >= k).argmax(axis=1)
        rows = np.arange(len(queries))
        return found[rows, order[rows, enough]]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No member of a cell scores more than this with a query (one row per query, one column per cell).

        A member lies within the radius of the pivot, so its score is at most that of the pivot plus the query's length
        times the radius. Its distance to the query is at least the query's distance to the pivot less the radius, and
        at least the query's distance to the plane between its own pivot and this one; with the members' greatest length
        this gives a bound too. The least of them counts.
        """
        length = np.sqrt((queries ** 2).sum(axis=1))[:, None]
        by_pivot = queries @ self.pivots.T + length * self.radius[None, :]
        far = self.distances(queries)
        own = far.argmin(axis=1)
        between = np.sqrt(np.maximum(self.squares[own][:, None] + self.squares[None, :] - 2.0 * (self.pivots[own] @ self.pivots.T), 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (far ** 2 - far[np.arange(len(queries)), own][:, None] ** 2) / (2.0 * between)
        plane = np.where(between > 0, plane, 0.0)
        apart = np.maximum(np.maximum(far - self.radius[None, :], plane) - self.slack(length), 0.0)
        by_distance = (length ** 2 + self.longest[None, :] ** 2 - apart ** 2) / 2.0
        return np.where(np.isinf(self.radius)[None, :], -np.inf, np.minimum(by_pivot, by_distance) + self.slack(length) ** 2 + 1.0)

    def slack(self, length: np.ndarray) -> np.ndarray:
        """More than rounding can change a length or, squared, a score."""
        return 1e-5 * (length + float(np.sqrt(self.squares.max(initial=0.0))) + float(self.longest.max(initial=0.0)))

    def needed(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Which cells may hold one of a query's best ``k`` (one row per query)."""
        return self.bounds(queries) >= self.threshold(queries, k)[:, None] - self.slack(np.zeros(1)) ** 2 - 1.0


def stacked(values: pd.Series) -> np.ndarray:
    return np.vstack(values.to_numpy()).astype(np.float64)


def pivots_of(classes: DataFrame, most: int = PIVOTS) -> tuple[int, np.ndarray]:
    """The most frequent length and up to ``most`` vectors of it, by hash: a bounded sample that decides speed only."""
    sizes = classes.where("dim > 0").groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return 0, np.zeros((0, 0))
    dim, total = sizes[0]["dim"], sizes[0]["count"]
    wanted = max(1, min(most, int(total ** 0.5)))
    rows = classes.where(F.col("dim") == dim).select("v").orderBy(F.xxhash64("v"), "v").limit(wanted).collect()
    found = np.array([r.v for r in rows], np.float64).reshape(len(rows), dim)
    # Lengths of such vectors could overflow a bound, so vectors that long have cells without bounds.
    return dim, found[np.abs(found).max(axis=1, initial=0.0) < 1e100]


def assigned(classes: DataFrame, dim: int, cells: Cells) -> DataFrame:
    """``classes`` with ``cell`` and ``off``, the distance to its pivot; cell -1 where there is no pivot or no bound."""

    @F.pandas_udf("cell int, off double")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, off = np.full(len(batch), -1, np.int32), np.zeros(len(batch))
            fit = np.flatnonzero([len(v) == dim and float(np.abs(v).max(initial=0.0)) < 1e100 for v in batch])
            if len(fit) and len(cells.pivots):
                cell[fit], off[fit] = cells.nearest(stacked(batch.iloc[fit]))
            yield pd.DataFrame({"cell": cell, "off": off})

    return bounded_batches(classes).withColumn("p", place("v")).select("*", "p.cell", "p.off").drop("p")


def summarised(placed: DataFrame, cells: Cells, k: int) -> None:
    """Take the summary of every cell to the driver: one row and at most ``k + 1`` witnesses a cell, ``PIVOTS`` cells at most."""
    inside = placed.where("cell >= 0")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    for r in inside.groupBy("cell").agg(F.max("off").alias("off"), F.max(length).alias("length")).collect():
        cells.radius[r["cell"]], cells.longest[r["cell"]] = r["off"], r["length"]
    near = Window.partitionBy("cell").orderBy("off", F.col("ids")[0])
    rows = inside.withColumn("r", F.row_number().over(near)).where(F.col("r") <= k + 1).select("v", F.size("ids").alias("n")).collect()
    cells.witnesses = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), cells.pivots.shape[1])
    cells.copies = np.array([r["n"] for r in rows], np.int64)


def blocks_of(counts: dict[int, int], cells: Cells, block: int) -> tuple[dict[int, int], dict[int, int]]:
    """First block and number of blocks of every query cell: neighbouring cells share a block until it is full."""
    if not counts:
        return {}, {}
    members = sorted(counts)
    centre = cells.pivots[members] - cells.pivots[members].mean(axis=0)
    axis = np.linalg.eigh(centre.T @ centre)[1][:, -1]
    first, parts, at, room = {}, {}, -1, 0
    for cell in (members[i] for i in np.argsort(centre @ axis, kind="stable")):
        n = counts[cell]
        if n > room:
            at, room = at + 1, block
        first[cell], parts[cell] = at, max(1, -(-n // block))
        room = room - n if parts[cell] == 1 else 0
        at += parts[cell] - 1
    return first, parts


def numbered(key: Column, numbers: dict[int, int], default: int) -> Column:
    """The number of a cell, from a map of at most ``PIVOTS`` entries."""
    if not numbers:
        return F.lit(default)
    found = F.create_map(*[F.lit(x) for pair in sorted(numbers.items()) for x in pair])
    return F.coalesce(F.element_at(found, key), F.lit(default))


def work(queries: DataFrame, data: DataFrame, cells: Cells, k: int, tile: int, block: int) -> DataFrame:
    """Units of work ``(unit, side, cell, id, v, ids)``: a block of queries with each tile of the cells that it needs."""
    per_cell = {r["cell"]: r["count"] for r in queries.where("cell >= 0").groupBy("cell").count().collect()}
    first, parts = blocks_of(per_cell, cells, block)
    spread = F.pmod(F.xxhash64("id"), F.greatest(numbered(F.col("cell"), parts, 1), F.lit(1))).cast("int")
    # Queries of cell -1 (lengths without pivots) have blocks of their own, as many as they need.
    others = queries.where("cell < 0").groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    inside = queries.where("cell >= 0").withColumn("block", numbered(F.col("cell"), first, 0) + spread)
    outside = queries.where("cell < 0").join(others, "dim").withColumn("block", -1 - F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    queries = materialise(inside.unionByName(outside.drop("parts")))

    def need(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = set()
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                number, cell = part["block"].to_numpy(), part["cell"].to_numpy()
                pairs.update((b, -1) for b in set(number.tolist()))
                fit = np.flatnonzero(cell >= 0)
                if len(fit):
                    rows, found = np.nonzero(cells.needed(stacked(part["v"].iloc[fit]), k))
                    pairs.update(zip(number[fit][rows].tolist(), found.tolist()))
                pairs.update((b, c) for b in set(number[cell < 0].tolist()) for c in range(len(cells.pivots)))
            yield pd.DataFrame(sorted(pairs), columns=["block", "cell"])

    wanted = bounded_batches(queries).select("block", "cell", "v").mapInPandas(need, "block int, cell int").distinct()
    wanted = wanted.join(queries.select("block", "dim").distinct(), "block")
    tiles = data.groupBy("dim", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    pairs = wanted.join(tiles, ["dim", "cell"])
    units = materialise(pairs.select("dim", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")).withColumn("unit", F.xxhash64("dim", "cell", "block", "tile")))
    own = F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int").alias("tile")
    split = data.join(tiles, ["dim", "cell"]).select("dim", "cell", own, "id", "v", "ids")
    dealt = split.join(units, ["dim", "cell", "tile"]).select("unit", F.lit(1).alias("side"), "cell", "id", "v", "ids")
    none = F.lit(None).cast(data.schema["ids"].dataType).alias("ids")
    asked = queries.select("dim", "block", "id", "v").join(units, ["dim", "block"]).select("unit", F.lit(0).alias("side"), "cell", "id", "v", none)
    return asked.union(dealt)


def solve(units: DataFrame, cells: Cells, k: int, piece: int = 1024) -> DataFrame:
    """Rows ``(id, score, ids)``: for every query of a unit the ``k`` best data vectors of the unit's tile."""

    def answer(rows: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(rows)
        asked, data = rows[rows["side"] == 0], rows[rows["side"] == 1]
        if not len(asked) or not len(data):
            return made([], [], [])
        cell = int(rows["cell"].iloc[0])
        # Ties of a score go to the vector of the smallest id, so data in that order need a stable sort only.
        data = data.assign(least=[i[0] for i in data["ids"]]).sort_values("least", kind="stable")
        x, q = stacked(data["v"]), stacked(asked["v"])
        names, lists = asked["id"].to_numpy(), data["ids"].to_numpy()
        if cell >= 0 and x.shape[1] == cells.pivots.shape[1] and float(np.abs(q).max(initial=0.0)) < 1e100:
            go = np.concatenate([cells.needed(q[at:at + piece], k)[:, cell] for at in range(0, len(q), piece)])
            q, names = q[go], names[go]
        who, what, ids = [], [], []
        for at in range(0, len(q), piece):
            found = scores(q[at:at + piece], x)
            width = min(k, found.shape[1])
            # Everything at or above the k-th best score, then the first k of each query by score and smallest id.
            least = -np.partition(-found, width - 1, axis=1)[:, width - 1:width] if found.shape[1] > width else found.min(axis=1, keepdims=True)
            i, j = np.nonzero(found >= least)
            order = np.lexsort((j, -found[i, j], i))
            i, j = i[order], j[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[rank < k], j[rank < k]
            who.append(names[at:at + piece][i])
            what.append(found[i, j])
            ids.extend(lists[j])
        return made(np.concatenate(who) if who else [], np.concatenate(what) if what else [], ids)

    def made(who, what, ids) -> pd.DataFrame:
        return pd.DataFrame({"id": np.asarray(who, np.int64), "score": np.asarray(what, np.int64), "ids": pd.Series(ids, dtype=object)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None
        for batch in batches:
            marks = batch["unit"].to_numpy()
            cuts = [0, *(np.flatnonzero(marks[1:] != marks[:-1]) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and marks[a] != key:
                    yield answer(held)
                    held = []
                key = marks[a]
                held.append(batch.iloc[a:b])
        if held:
            yield answer(held)

    dealt = bounded_batches(units).repartition("unit").sortWithinPartitions("unit")
    return dealt.mapInPandas(run, T.StructType([T.StructField("id", T.LongType()), T.StructField("score", T.LongType()), units.schema["ids"]]))


def top_k(
    vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE,
    pivots: int = PIVOTS, tile: int = TILE, block: int = BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best vectors for every row that ``queries`` picks, itself excluded.

    The score is the inner product of ``floor(scale * x)``, ties go to the smaller id. Vectors that are null or hold null or
    non-finite components take no part, nor do rows without an id; vectors of different lengths never meet. Fewer than ``k`` others
    give fewer rows, an empty table none. Equal vectors are compared once and keep their ``k + 1`` smallest ids, of which a
    query can use no more; repeated rows of one id and vector count once. Rows of a query's id are its own, whatever
    their vector. Scores beyond a long stand at its ends. Other columns are not read.

    Queries are taken in blocks of at most ``block`` (about; cells are not cut while they fit), data in tiles of about ``tile``; a
    block meets the tiles of those cells alone that its bounds and thresholds leave. Where the vectors have no
    clusters the bounds leave most cells, and the work is that of all queries with all vectors.
    """
    rows = vectors.select(named(vec_id).alias("vec_id"), whole(named(embedding), scale).alias("v"), queries.alias("asked"))
    rows = materialise(rows.where("v is not null and vec_id is not null").withColumn("class", F.xxhash64("v")))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    once = rows.select("v", "class", "vec_id").distinct().withColumn("r", rank).where(F.col("r") <= k + 1)
    classes = once.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"), F.first("class").alias("class"))
    # Hashes of different vectors could meet: a class is named by its smallest id and that vector's hash.
    classes = classes.withColumn("id", F.xxhash64(F.col("ids")[0], "class")).drop("class").withColumn("dim", F.size("v"))
    classes = materialise(classes)
    dim, found = pivots_of(classes, pivots)
    cells = Cells(found)
    data = materialise(assigned(classes, dim, cells))
    summarised(data, cells, k + 1)
    wanted = rows.where("asked").select("v").distinct()
    asked = materialise(data.join(wanted, "v", "left_semi"))
    parts = solve(work(asked, data, cells, k + 1, tile, block), cells, k + 1)
    best = Window.partitionBy("id").orderBy(F.desc("score"), F.col("ids")[0])
    best = parts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    answers = materialise(best.select("id", "score", F.explode("ids").alias("vec_id")))
    # The query rows of a class share its answers; each leaves itself out.
    owners = rows.where("asked").select(F.col("vec_id").alias("query_id"), "v").distinct()
    owners = owners.join(asked.select("v", "id"), "v").select("query_id", "id")
    last = Window.partitionBy("query_id", "id").orderBy(F.desc("score"), "vec_id")
    pairs = owners.join(answers, "id").where(F.col("vec_id") != F.col("query_id")).withColumn("rank", F.row_number().over(last))
    return pairs.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def sql(k: int = K, scale: int = SCALE) -> str:
    """The same result over ``embeddings`` in SQL, by all pairs of a query and a vector."""
    return f"""
with good as (
  select distinct vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score
  from good q join good d on q.vec_id <> d.vec_id and len(q.v) = len(d.v) where q.vec_id % 50 = 0
)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from scored qualify row_number() over (partition by query_id order by score desc, vec_id) <= {k}"""
