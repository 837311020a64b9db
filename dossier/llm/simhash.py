"""SimHash near-dedup: fingerprints linked within a Hamming radius by BK-trees over shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, components, free_names, materialise, named, ship

ship(__name__)

SHINGLE = 3
RADIUS = 3
SEED = 42
# Fingerprints that one tree holds at most; larger shards are cut finer, and in the end into pairs of parts.
SHARD = 4096
LEVELS = 3
CHUNK = 50_000


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The 64-bit SimHash of the whole text as a signed long (0 without words)."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        some = tokens[at:at + CHUNK + words - 1] if len(tokens) >= words else tokens
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        if len(some) >= words:
            starts, ends = starts[:len(some) - words + 1], ends[words - 1:]
        else:
            starts, ends = starts[:1], ends[-1:]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
        for part in range(0, len(hashes), 4096):
            bits = np.unpackbits(hashes[part:part + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def with_fingerprint(documents: DataFrame, text: str = "text", out: str = "fingerprint", words: int = SHINGLE) -> DataFrame:
    """``documents`` with the fingerprint of every whole text as a long (renamed where taken)."""
    (column,) = free_names(documents, out)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fingerprint(text, words) for text in batch], dtype="int64")

    return bounded_batches(documents).withColumn(column, of(named(text)))


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def masks(level: int, radius: int) -> list[int]:
    """Bit masks of the shard keys of a level.

    Of ``radius + 1`` parts of the bits one has no difference between two linked fingerprints. Each level cuts the
    bits that its parent left free into as many parts again, so linked fingerprints share a key at every level.
    """
    found = [(0, list(range(64)))]
    for _ in range(level):
        deeper = []
        for mask, free in found:
            for j in range(radius + 1):
                part = free[j * len(free) // (radius + 1):(j + 1) * len(free) // (radius + 1)]
                deeper.append((mask | sum(1 << b for b in part), [b for b in free if b not in set(part)]))
        found = deeper
    return [mask - (1 << 64) if mask >= 1 << 63 else mask for mask, _ in found]


class Tree:
    """A BK-tree over fingerprints: the children of a node are keyed by their Hamming distance to it."""

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.group: list[int] = []

    def find(self, i: int) -> int:
        while self.group[i] != i:
            self.group[i] = self.group[self.group[i]]
            i = self.group[i]
        return i

    def near(self, value: int) -> list[int]:
        """Nodes within the radius: only edges whose key is within it of the distance are followed."""
        found, todo, radius, values, children = [], [0] if self.values else [], self.radius, self.values, self.children
        while todo:
            node = todo.pop()
            d = (values[node] ^ value).bit_count()
            if d <= radius:
                found.append(node)
            for edge, child in children[node].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found

    def add(self, value: int) -> None:
        """Link the value to what is near it, then hang it into the tree."""
        me = len(self.values)
        self.group.append(me)
        for other in self.near(value):
            a, b = self.find(other), self.find(me)
            if a != b:
                self.group[max(a, b)] = min(a, b)
        node = 0
        while self.values:
            d = (self.values[node] ^ value).bit_count()
            below = self.children[node].get(d)
            if below is None:
                self.children[node][d] = me
                break
            node = below
        self.values.append(value)
        self.children.append({})

    def edges(self) -> list[tuple[int, int]]:
        """One link per value that is not the first of its group."""
        roots = map(self.find, range(len(self.values)))
        return [(self.values[r], self.values[i]) for i, r in enumerate(roots) if r != i]


def search(shards: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Links ``(a, b)`` within every shard: a forest that connects what the shard's links connect."""

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, current = Tree(radius), None
        made: list[tuple[int, int]] = []
        for batch in batches:
            for *key, value in batch.itertuples(index=False, name=None):
                if key != current:
                    made += tree.edges()
                    tree, current = Tree(radius), key
                tree.add(value & 0xFFFFFFFFFFFFFFFF)
                if len(made) > 10_000:
                    yield as_frame(made)
                    made = []
        yield as_frame(made + tree.edges())

    def as_frame(made: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame(np.array(made, np.uint64).reshape(-1, 2).astype(np.int64), columns=["a", "b"])

    dealt = shards.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInPandas(link, "a long, b long")


def links(fingerprints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints ``fp`` within ``radius`` bits of each other.

    Fingerprints meet in shards: by the pigeonhole rule two linked ones agree in one of ``radius + 1`` parts of
    their bits. Each shard of at most ``shard`` fingerprints gets one BK-tree in one task. Larger shards are cut again by the same
    rule over the remaining bits; what is still larger after the last level is split into parts that meet pair by
    pair. No link is lost either way, and no task holds more than ``shard`` fingerprints.
    """
    level, parent, found = 1, None, []
    rows = fingerprints.select("fp")
    while True:
        options = masks(level, radius)
        if parent is None:
            pairs = F.array(*[F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(options)])
        else:
            width = radius + 1
            choices = F.array(*[F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(options)])
            pairs = F.slice(choices, F.col("parent") * width + 1, F.lit(width))
        spread = rows.select("fp", F.explode(pairs).alias("s")).select("fp", "s.path", "s.key")
        large = materialise(spread.groupBy("path", "key").agg(F.count("*").alias("n")).where(F.col("n") > shard))
        if large.isEmpty():
            found.append(search(spread, ["path", "key"], radius))
            break
        found.append(search(spread.join(large, ["path", "key"], "left_anti"), ["path", "key"], radius))
        over = spread.join(large, ["path", "key"])
        if level == LEVELS:
            parts = F.ceil(F.col("n") * 3 / shard).cast("int")  # two parts stay within a shard, uneven as they may be
            own = F.pmod(F.xxhash64("fp"), parts).cast("int")
            meet = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(F.least(i, own).alias("i"), F.greatest(i, own).alias("j")))
            met = over.select("path", "key", "fp", F.explode(meet).alias("m")).select("path", "key", "m.i", "m.j", "fp")
            found.append(search(met, ["path", "key", "i", "j"], radius))
            break
        rows = materialise(over.select("fp", F.col("path").alias("parent")))
        parent, level = level, level + 1
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result


def _rooted(documents: DataFrame, doc_id: str, text: str, radius: int, words: int) -> tuple[DataFrame, DataFrame]:
    """The rows ``(doc_id, kd, kt, fp)`` and the component ``(fp, root)`` of every distinct fingerprint."""
    source = documents.select(named(doc_id).alias("doc_id"), *row_key(doc_id, text), named(text).alias("text"))
    prints = materialise(with_fingerprint(source, "text", "fp", words).select("doc_id", "kd", "kt", "fp"))
    classes = materialise(prints.select("fp").distinct())
    linked = components(links(classes, radius))
    rooted = classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return prints, materialise(rooted)


def row_key(doc_id: str, text: str, names: tuple[str, str] = ("kd", "kt")) -> list[Column]:
    """Two hashes that tell rows apart by id and text; never null."""
    return [F.xxhash64(named(doc_id)).alias(names[0]), F.xxhash64(named(text)).alias(names[1])]


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: its fingerprint and the least id reachable by links.

    Equal fingerprints are one node, so copies are never paired; only the links of different fingerprints are
    made, as a forest. The fingerprint of a text without words (null or empty too) is zero and is linked like any
    other. Null ids take part and are passed over when the least id is chosen; a component of
    null ids alone has a null ``component_id``. Repeated rows stay. Other columns are not read.
    """
    prints, rooted = _rooted(documents, doc_id, text, radius, words)
    leads = prints.groupBy("fp").agg(F.min("doc_id").alias("lead")).join(rooted, "fp")
    leads = materialise(leads)
    least = leads.groupBy("root").agg(F.min("lead").alias("component_id"))
    assigned = leads.join(least, "root").select("fp", "component_id")
    return prints.join(assigned, "fp").select("doc_id", "fp", "component_id")


def groups(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """``kd, kt, root`` of the distinct rows (see ``row_key``): rows of one root are reachable by links."""
    prints, rooted = _rooted(documents, doc_id, text, radius, words)
    return prints.join(rooted, "fp").select("kd", "kt", "root").distinct()


def keep_one(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """``documents`` with one row of every near-duplicate group: the one of least id, in its own columns.

    A row without an id stays only where its whole group has none. Of repeated rows, and of rows of one id in one
    group, one stays (of least text hash).
    """
    prints, rooted = _rooted(documents, doc_id, text, radius, words)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "kt", "kd")).alias("first")
    kept = prints.join(rooted, "fp").groupBy("root").agg(first).select("first.kd", "first.kt")
    kd, kt = free_names(documents, "kd", "kt")
    keyed = documents.select("*", *row_key(doc_id, text, (kd, kt)))
    stay = keyed.join(kept.select(F.col("kd").alias(kd), F.col("kt").alias(kt)), [kd, kt], "left_semi")
    return stay.dropDuplicates([kd, kt]).select(*map(named, documents.columns))
