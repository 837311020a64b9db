"""Benchmark decontamination: token windows of documents looked up in a broadcast set of test windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, free_names, named, ship

ship(__name__)

WINDOW = 13
# Test words that one broadcast set may hold. A larger benchmark is scanned in several passes of bounded sets.
WORDS_PER_SET = 5_000_000
SCHEMA = "n_words long, n_hit long, item_ids array<string>, hit_spans array<struct<first:long,last:long>>"


def _letters() -> bytes:
    """Byte translation: A-Z to lower case, letters, digits and all bytes outside ASCII kept, the rest to spaces."""
    keep = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
    return bytes(b if b in keep else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


LETTERS = _letters()


def split_words(text: str | None) -> list[bytes]:
    """The lower-case words of a text (null has none)."""
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


def build_set(items: list[tuple[str, str | None]], window: int) -> tuple[dict, dict]:
    """Vocabulary word -> number, and window length -> {window of numbers: indexes of its items}.

    A window is a byte string of 32-bit word numbers; an item of fewer words than ``window`` is one window.
    """
    vocabulary: dict[bytes, int] = {}
    windows: dict[int, dict[bytes, set[int]]] = {}
    for index, (_, text) in enumerate(items):
        words = split_words(text)
        if not words:
            continue
        ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in words), np.uint32, len(words))
        size = min(window, len(words))
        for start in range(len(words) - size + 1):
            windows.setdefault(size, {}).setdefault(ids[start:start + size].tobytes(), set()).add(index)
    return vocabulary, windows


MIX = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` word numbers."""
    out = np.zeros(len(ids) - size + 1, np.uint64)
    for k in range(size):
        out = (out ^ ids[k:k + len(out)].astype(np.uint64)) * MIX
        out ^= out >> np.uint64(29)
    return out


def prepare(windows: dict[int, dict[bytes, set[int]]]) -> dict[int, np.ndarray]:
    """Per window length the sorted hashes of the windows, for the scan before the exact look-up."""
    return {
        size: np.unique(np.concatenate([rolling(np.frombuffer(w, np.uint32), size) for w in found]))
        for size, found in windows.items()
    }


def scan(text: str | None, vocabulary: dict, windows: dict, hashes: dict) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, spans of hit words (first, last), indexes of the items with an occurring window."""
    words = split_words(text)
    n = len(words)
    ids = np.fromiter(map(vocabulary.get, words, (0 for _ in range(n))), np.uint32, n)
    known = np.concatenate(([0], np.cumsum(ids > 0)))
    spans: list[tuple[int, int]] = []
    items: set[int] = set()
    for size, found in windows.items():
        if n < size:
            continue
        starts = np.flatnonzero(known[size:] - known[:-size] == size)  # runs of test words only
        for block in range(0, len(starts), 1 << 16):
            some = starts[block:block + (1 << 16)]
            hashed = np.zeros(len(some), np.uint64)
            for k in range(size):
                hashed = (hashed ^ ids[some + k].astype(np.uint64)) * MIX
                hashed ^= hashed >> np.uint64(29)
            at = np.searchsorted(hashes[size], hashed)
            at[at == len(hashes[size])] = 0
            for start in some[hashes[size][at] == hashed]:
                owners = found.get(ids[start:start + size].tobytes())
                if owners:  # verified word by word
                    items |= owners
                    spans.append((int(start), int(start) + size - 1))
    merged: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return n, merged, items


def benchmark_sets(benchmark: DataFrame, item_id: str, text: str, words_per_set: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in groups of at most ``words_per_set`` words (an item above the bound has a group of its own).

    They come one partition after another, and only one group is held at a time. Without items there is one empty group.
    """
    rows = benchmark.select(named(item_id).cast("string"), named(text)).where(named(text).isNotNull())
    group: list[tuple[str, str | None]] = []
    held, given = 0, False
    for key, value in rows.toLocalIterator():
        size = len(split_words(value))
        if group and held + size > words_per_set:
            yield group
            given, group, held = True, [], 0
        group.append((key, value))
        held += size
    if group or not given:
        yield group


def matcher(shared, window: int):
    """The look-up of texts in one broadcast group of items."""

    @F.pandas_udf(SCHEMA)
    def look_up(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        items = shared.value
        vocabulary, windows = build_set(items, window)
        hashes = prepare(windows)
        for batch in batches:
            rows = []
            for value in batch:
                n, spans, hit = scan(value, vocabulary, windows, hashes)
                names = sorted({items[i][0] for i in hit if items[i][0] is not None})
                rows.append((n, sum(b - a + 1 for a, b in spans), names, [{"first": a, "last": b} for a, b in spans]))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "item_ids", "hit_spans"])

    return look_up


def find(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, words_per_set: int = WORDS_PER_SET, out: str = "found",
) -> DataFrame:
    """``documents`` with a struct column of the words and hits of every whole text.

    The struct ``out`` (renamed where taken) has ``n_words``, ``n_hit`` (words inside any occurrence of a test
    window), ``item_ids`` (items with occurring windows, sorted as strings, without repeats) and ``hit_spans``
    (first and last word of each hit stretch). A word is a run of ASCII letters, digits and characters outside
    ASCII, with A-Z lower-cased.

    The test windows are broadcast in sets of at most ``words_per_set`` words, so the broadcast never exceeds a
    fixed size; a larger benchmark adds passes over the rows, which stay a narrow operation without a shuffle.

    Null or empty texts have no words and no hits. Null item texts and items without words have no windows; null item
    ids take part and are not listed. Repeated rows each get their own result. An empty benchmark hits nothing.
    """
    (column,) = free_names(documents, out)
    context = documents.sparkSession.sparkContext
    parts = []
    result = bounded_batches(documents)
    for group in benchmark_sets(benchmark, item_id, item_text, words_per_set):
        (part,) = free_names(result, f"{column}_{len(parts)}")
        result = result.withColumn(part, matcher(context.broadcast(group), window)(named(text)))
        parts.append(part)
    if len(parts) == 1:
        return result.withColumnRenamed(parts[0], column)
    spans = F.array_sort(F.flatten(F.array(*[named(p)["hit_spans"] for p in parts])))
    merged = F.aggregate(
        spans, F.array().cast("array<struct<first:bigint,last:bigint>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["first"] <= F.element_at(acc, -1)["last"] + 1),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                F.element_at(acc, -1)["first"].alias("first"),
                F.greatest(F.element_at(acc, -1)["last"], s["last"]).alias("last"),
            ))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    hits = F.aggregate(merged, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[named(p)["item_ids"] for p in parts]))))
    whole = F.struct(
        named(parts[0])["n_words"].alias("n_words"), hits.alias("n_hit"), items.alias("item_ids"), merged.alias("hit_spans")
    )
    return result.withColumn(column, whole).drop(*parts)


def contaminated(found: str = "found"):
    """Whether a document is contaminated: it has hits, and they make up a twentieth of its words or more."""
    n_hit, n_words = named(found)["n_hit"], named(found)["n_words"]
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove(documents: DataFrame, benchmark: DataFrame, text: str = "text", mode: str = "documents", **options) -> DataFrame:
    """``documents`` without contamination, in their own columns.

    ``mode="documents"`` drops contaminated documents and leaves the others untouched; ``mode="spans"`` keeps every
    document and cuts the hit stretches of words out of contaminated ones (separators around a cut are kept).
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"unknown mode: {mode}")
    columns = documents.columns
    (found,) = free_names(documents, "found")
    checked = find(documents, benchmark, text, out=found, **options)
    if mode == "documents":
        return checked.where(~contaminated(found)).select(*map(named, columns))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        import re

        word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
        out = []
        for value, hit in zip(texts, spans):
            if value is None or hit is None or not len(hit):
                out.append(value)
                continue
            at = [m.span() for m in word.finditer(value)]
            kept, last = [], 0
            for span in hit:
                kept.append(value[last:at[span["first"]][0]])
                last = at[span["last"]][1]
            out.append("".join(kept) + value[last:])
        return pd.Series(out, dtype=object)

    spans = F.when(contaminated(found), named(found)["hit_spans"])
    return checked.withColumn(text, cut(named(text), spans)).select(*map(named, columns))


def sql(window: int = WINDOW) -> str:
    """The digest of ``documents`` against ``benchmark`` in SQL, by all windows of either side."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all(coalesce({low}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
with items as (select item_id, w, least({window}, len(w)) as k from (select item_id, {words} as w from benchmark) where len(w) > 0),
item_windows as (
  select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as win from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from items)
),
docs as (select doc_id, {words} as w from documents),
doc_windows as (
  select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as win
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from docs cross join (select distinct k from items) where len(w) >= k)
),
hits as (select doc_id, k, i, item_id from doc_windows join item_windows using (k, win)),
hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
hit_items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed
  from (select distinct doc_id, item_id::varchar as item from hits where item_id is not null) group by doc_id
)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit_words using (doc_id) left join hit_items using (doc_id)"""
