"""Near copies by the Jaccard similarity of word shingles: candidates by MinHash bands, each link verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, components, free_names, materialise, named, ship
from dossier.llm.simhash import row_key

ship(__name__)

WORDS = 5
SIMILARITY = 0.8
# A pair of similarity 0.8 shares none of the bands with a chance of (1 - 0.8 ** 6) ** 24 = 0.0007.
BANDS, ROWS = 24, 6
SEED = 42
CHUNK = 4096
# Two sketches of 144 parts differ from the true similarity by 0.033 (one standard deviation at 0.8): pairs that look
# this much less alike are not compared in full; three in a hundred thousand at the threshold do.
MARGIN = 0.133
# Nodes of one part of a bucket, and pairs that share a node in one group of the verification.
PART, FAN = 256, 128
SEGMENT = 1 << 20  # bytes of a text hashed at once
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])


class Hasher:
    """Hashes of words and their runs, by sums of powers over the bytes of a text."""

    def __init__(self, words: int = WORDS) -> None:
        draw = np.random.RandomState(SEED)
        self.size = words
        self.letters = draw.randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(4) + draw.randint(0, 4, 256).astype(np.uint64)
        self.base = int(draw.randint(0, 1 << 62)) * 8 + 5 & (1 << 64) - 1
        self.factors = draw.randint(0, 1 << 62, words).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = self.inverses = np.ones(0, np.uint64)

    def tables(self, size: int) -> None:
        if len(self.powers) < size:
            size = max(size, 2 * len(self.powers), 4096)
            for name, base in (("powers", self.base), ("inverses", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def tokens(self, data: bytes) -> np.ndarray:
        """A hash of every word, wherever it stands; long texts are read in segments that end at white space."""
        parts, at = [], 0
        while at < len(data):
            end = min(at + SEGMENT, len(data))
            while end < len(data) and not SPACES[data[end]]:
                end += 1
            codes = np.frombuffer(data, np.uint8, end - at, at)
            solid = np.concatenate([[False], ~SPACES[codes], [False]])
            starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(solid[:-1] & ~solid[1:])
            self.tables(len(codes) + 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[codes] * self.powers[:len(codes)], dtype=np.uint64)])
            found = (sums[ends] - sums[starts]) * self.inverses[starts]
            found ^= found >> np.uint64(31)
            parts.append(found * self.factors[0])
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of the runs of so many words (one of all words where there are fewer)."""
        each = self.tokens(text.encode("utf-8", "surrogatepass").lower()) if text else np.zeros(0, np.uint64)
        if not len(each):
            return each
        size = min(self.size, len(each))
        n = len(each) - size + 1
        found = np.full(n, size, np.uint64)
        for i in range(size):
            found = (found ^ (found >> np.uint64(29))) + each[i:i + n] * self.factors[i]
        found ^= found >> np.uint64(32)
        return np.unique(found)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return Hasher(words)(text)


def multipliers() -> np.ndarray:
    return np.random.RandomState(SEED).randint(0, 1 << 62, (2, BANDS * ROWS, 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def least(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least of the hashes under every one of the mixing functions."""
    found = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        mixed = hashes[None, at:at + CHUNK] * factors[0]
        mixed += factors[1]
        found = np.minimum(found, mixed.min(axis=1))
    return found


def bands(found: np.ndarray) -> list[int]:
    """One hash for every band of least hashes."""
    import xxhash

    return [xxhash.xxh64_intdigest(part.tobytes(), i) - (1 << 63) for i, part in enumerate(found.reshape(BANDS, ROWS))]


def sketch(found: np.ndarray) -> bytes:
    """Sixteen bits of each least hash."""
    return (found & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def signed(documents: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """The rows ``(doc_id, kd, kt, node, bands)``: rows of equal shingle sets share a node (0 without words)."""

    @F.pandas_udf("node long, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        factors, hasher = multipliers(), Hasher(words)
        for batch in batches:
            rows = []
            for value in batch:
                found = hasher(value)
                node = xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63) if len(found) else 0
                rows.append((node, bands(least(found, factors)) if len(found) else []))
            yield pd.DataFrame(rows, columns=["node", "bands"])

    source = documents.select(named(doc_id).alias("doc_id"), *row_key(doc_id, text), named(text).alias("text"))
    return bounded_batches(source).withColumn("s", of("text")).select("doc_id", "kd", "kt", "s.node", "s.bands")


def hashed(documents: DataFrame, doc_id: str, text: str, chosen: DataFrame, words: int) -> DataFrame:
    """``node, bands, hashes, sketch`` of every chosen node (``node, kd, kt, bands``, of one of its rows): texts are moved once, here."""

    @F.pandas_udf("hashes binary, sketch binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        factors, hasher = multipliers(), Hasher(words)
        for batch in batches:
            found = [hasher(value) for value in batch]
            yield pd.DataFrame({"hashes": [f.tobytes() for f in found], "sketch": [sketch(least(f, factors)) for f in found]})

    keyed = documents.select(*row_key(doc_id, text), named(text).alias("text"))
    texts = keyed.join(chosen, ["kd", "kt"]).dropDuplicates(["node"]).select("node", "bands", "text")
    return bounded_batches(texts).withColumn("s", of("text")).select("node", "bands", "s.hashes", "s.sketch")


def verified(pairs: DataFrame, arrays: DataFrame, similarity: float = SIMILARITY, fan: int = FAN) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets (``node, hashes``) have a Jaccard similarity of ``similarity`` or more.

    The pairs of one ``a`` meet in groups of about ``fan``: each group gets the set of ``a`` once, and those of the others.
    """

    def alike(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, None
        for batch in batches:
            found = []
            for a, salt, side, node, hashes in batch.itertuples(index=False, name=None):
                mine = np.frombuffer(hashes, np.uint64)
                if side == 0:
                    last, held = (a, salt), mine
                elif last == (a, salt):
                    # Sets of too different sizes cannot be alike.
                    if min(len(held), len(mine)) < similarity * max(len(held), len(mine)) - 1e-9:
                        continue
                    shared = overlap(held, mine)
                    if shared >= similarity * (len(held) + len(mine) - shared) - 1e-9:
                        found.append((a, node))
            yield pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    groups = pairs.groupBy("a").agg(F.ceil(F.count("*") / fan).cast("int").alias("groups"))
    dealt = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("salt"), "b")
    sides = dealt.select("a", "salt", F.lit(1).alias("side"), F.col("b").alias("node"))
    sides = sides.union(dealt.select("a", "salt", F.lit(0), "a").distinct())
    both = sides.join(arrays.select("node", "hashes"), "node").select("a", "salt", "side", "node", "hashes")
    dealt = bounded_batches(both).repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    return dealt.mapInPandas(alike, "a long, b long")


def overlap(mine: np.ndarray, other: np.ndarray) -> int:
    """How many values two sorted sets share."""
    at = np.searchsorted(mine, other)
    return int(np.count_nonzero(mine[np.minimum(at, len(mine) - 1)] == other))


def met(rows: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` between different components that meet in a part pair ``(band, value, i, j)``, as a forest.

    A pair is judged in the first band that its nodes share, by their sketches and, where these look alike, by their whole sets;
    pairs that are connected already are passed over. So a task puts out fewer links than it has nodes.
    """
    enough = (similarity - MARGIN) * BANDS * ROWS

    def linked(group: pd.DataFrame, band: int, i: int, j: int) -> list[tuple[int, int]]:
        made: list[tuple[int, int]] = []
        nodes, own = group["node"].to_numpy(), group["own"].to_numpy()
        label = np.unique(group["comp"].to_numpy(), return_inverse=True)[1]
        marks = np.frombuffer(b"".join(group["sketch"]), np.uint16).reshape(len(group), -1)
        keys = np.vstack(group["bands"].to_numpy())
        sets = [np.frombuffer(h, np.uint64) for h in group["hashes"]]
        sizes = np.array([len(h) for h in sets])
        right = np.flatnonzero(own == j)
        for x in np.flatnonzero(own == i):
            others = right[right > x] if i == j else right
            others = others[label[others] != label[x]]
            low, high = np.minimum(sizes[others], sizes[x]), np.maximum(sizes[others], sizes[x])
            others = others[low >= similarity * high - 1e-9]
            others = others[(marks[others] == marks[x]).sum(axis=1) >= enough]
            others = others[(keys[others] == keys[x]).argmax(axis=1) == band]
            for y in others:
                if label[x] != label[y]:
                    shared = overlap(sets[x], sets[y])
                    if shared >= similarity * (sizes[x] + sizes[y] - shared) - 1e-9:
                        made.append((nodes[x], nodes[y]))
                        label[label == label[y]] = label[x]
        return made

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        key = None

        def out() -> pd.DataFrame:
            found = linked(pd.concat(held), int(key[0]), int(key[2]), int(key[3]))
            return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

        for batch in batches:
            marks = batch[["band", "value", "i", "j"]].to_numpy()
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and tuple(marks[a]) != key:
                    yield out()
                    held = []
                key = tuple(marks[a])
                held.append(batch.iloc[a:b])
        if held:
            yield out()

    dealt = bounded_batches(rows).repartition("value", "i", "j").sortWithinPartitions("band", "value", "i", "j")
    return dealt.mapInPandas(meet, "a long, b long")


def shared_buckets(members: DataFrame) -> DataFrame:
    """The rows ``(band, value, node)`` of buckets of two nodes or more, with the least node ``low`` of the bucket."""
    sizes = members.groupBy("band", "value").agg(F.min("node").alias("low"), F.max("node").alias("high"))
    return members.join(sizes.where("low <> high").drop("high"), ["band", "value"])


def links(shared: DataFrame, arrays: DataFrame, similarity: float = SIMILARITY, part: int = PART) -> DataFrame:
    """The component ``(node, root)`` of all linked nodes, from ``shared_buckets`` and ``hashed`` rows.

    First every node is verified against one node only, the least that it shares a bucket with: this connects nearly all
    near copies, however many they are. Then the buckets that still hold several components are gone through in full: their
    nodes are cut into parts of about ``part`` that meet pair by pair, in tasks that judge the pairs of different components and put
    out a forest. So no link of a bucket is lost but by its sketch, a group of near copies of any size costs one
    verification a node, and no task holds more than two parts. The work in a bucket of many texts that are not alike
    grows with the square of its size, in tasks of a fixed size.
    """
    first = shared.where("node <> low").groupBy(F.col("node").alias("b")).agg(F.min("low").alias("a")).select("a", "b")
    found = materialise(verified(materialise(first), arrays, similarity))
    rooted = components(found)
    placed = shared.join(rooted, "node", "left").select("band", "value", "node", F.coalesce("root", "node").alias("comp"))
    placed = materialise(placed)
    several = placed.groupBy("band", "value").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("n")).where("c1 <> c2")
    left = placed.join(several.select("band", "value", F.ceil(F.col("n") / part).cast("int").alias("parts")), ["band", "value"])
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    left = left.select("band", "value", "node", "comp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    left = left.select("band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "comp", "own")
    more = materialise(met(left.join(arrays, "node"), similarity))
    return rooted if more.isEmpty() else components(found.union(more))


def grouped(documents: DataFrame, doc_id: str, text: str, words: int, similarity: float) -> DataFrame:
    """``doc_id, kd, kt, root`` of every row: rows of one root are connected by near copies; rows without words are one."""
    prints = materialise(signed(documents, doc_id, text, words))
    chosen = prints.groupBy("node").agg(F.min(F.struct("kt", "kd")).alias("row"), F.first("bands").alias("bands"))
    nodes = materialise(chosen.select("node", "row.kd", "row.kt", "bands"))
    shared = materialise(shared_buckets(nodes.select(F.posexplode("bands").alias("band", "value"), "node")))
    candidates = nodes.join(shared.select("node").distinct(), "node", "left_semi")
    arrays = materialise(hashed(documents, doc_id, text, candidates, words))
    rooted = materialise(links(shared, arrays, similarity))
    found = prints.select("doc_id", "kd", "kt", "node").join(rooted, "node", "left")
    return found.select("doc_id", "kd", "kt", F.coalesce("root", "node").alias("root"))


def merged(rows: DataFrame, linked: DataFrame) -> DataFrame:
    """``rows`` (``doc_id, kd, kt, root``) with the roots made one that a group of ``linked`` (``kd, kt, root``) has rows of."""
    rows = materialise(rows)
    met = rows.select("kd", "kt", "root").distinct().join(linked.select("kd", "kt", F.col("root").alias("group")), ["kd", "kt"])
    met = materialise(met.select("group", "root").distinct())
    least = met.groupBy("group").agg(F.min("root").alias("a"))
    edges = met.join(least, "group").where("root <> a").select("a", F.col("root").alias("b"))
    tops = components(edges).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return rows.join(tops, "root", "left").select("doc_id", "kd", "kt", F.coalesce("top", "root").alias("root"))


def keep_one(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
    linked: DataFrame | None = None,
) -> DataFrame:
    """``documents`` with one row of every group of near copies: the one of least id, in its own columns.

    Groups are connected by pairs whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more;
    such a pair is missed where it shares none of the bands (one in 1,400 at 0.8, far fewer above). Texts without words (null and
    empty ones too) are one group. A row without an id stays only where its whole group has none. Of repeated rows, and of
    rows of one id in one group, one stays (of least text hash). Very long texts are compared whole. An empty table stays empty.
    Groups that another method found among the same rows (``linked``: ``kd, kt, root``) are connected too.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "kt", "kd")).alias("first")
    rows = grouped(documents, doc_id, text, words, similarity)
    rows = rows if linked is None else merged(rows, linked)
    kept = rows.groupBy("root").agg(first).select("first.kd", "first.kt")
    kd, kt = free_names(documents, "kd", "kt")
    keyed = documents.select("*", *row_key(doc_id, text, (kd, kt)))
    stay = keyed.join(kept.select(F.col("kd").alias(kd), F.col("kt").alias(kt)), [kd, kt], "left_semi")
    return stay.dropDuplicates([kd, kt]).select(*map(named, documents.columns))
