"""Fill-in-middle transformation: documents cut in three by counts of content-defined chunks, each chunk counted once."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, free_names, named, ship

ship(__name__)

SEED = 1
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_SHARE, SPM_SHARE = 10, 20  # of a hundred documents; of a hundred documents that are cut
# Bytes of a chunk: cut where the rolling hash of the last 32 bytes starts with so many zero bits, within these bounds.
BITS, LEAST, MOST = 10, 256, 8192
WINDOW = 32
SEGMENT = 1 << 20  # bytes hashed at once
CACHE_BYTES = 32 << 20  # chunk contents that a task remembers
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])


def chunk_ends(data: bytes, bits: int = BITS, least: int = LEAST, most: int = MOST) -> Iterator[int]:
    """Ends of the chunks of ``data``: places that depend on the 32 bytes before them, so equal passages are cut alike.

    A chunk has at least ``least`` bytes, unless it is the last one, and at most ``most``.
    """
    gear = np.random.RandomState(SEED).randint(0, 1 << 32, 256, np.uint64).astype(np.uint32)
    start = 0
    for at in range(0, len(data), SEGMENT):
        lead = min(at, WINDOW - 1)
        rolling = gear[np.frombuffer(data, np.uint8, min(SEGMENT, len(data) - at) + lead, at - lead)]
        for shift in (1, 2, 4, 8, 16):
            rolling[shift:] = rolling[shift:] + (rolling[:-shift] << np.uint32(shift))
        for end in (np.flatnonzero(rolling[lead:] >> np.uint32(32 - bits) == 0) + at + 1).tolist():
            while end - start > most:
                start += most
                yield start
            if end - start >= least:
                start = end
                yield start
    while len(data) - start > most:
        start += most
        yield start
    if start < len(data):
        yield len(data)


def unit_starts(chunk: bytes, unit: str) -> np.ndarray:
    """Offsets at which a unit starts, as if white space stood before the chunk.

    A ``codepoint`` starts at each byte that does not continue another; a ``word`` at each first byte of a run without
    white space.
    """
    codes = np.frombuffer(chunk, np.uint8)
    if unit == "codepoint":
        return np.flatnonzero(codes & 0xC0 != 0x80)
    if unit == "word":
        solid = ~SPACES[codes]
        return np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]))
    raise ValueError(f"unknown unit {unit!r}")


class Counter:
    """Counts of units by chunk content, remembered for the chunks used last.

    A remembered summary is used for a chunk of the same bytes only: the content itself is the key. It holds the
    number of units that start in the chunk and what its borders need: whether its first unit may belong to the chunk
    before, and whether its end leaves a unit open.
    """

    def __init__(self, unit: str, cache_bytes: int = CACHE_BYTES) -> None:
        self.unit, self.room = unit, cache_bytes
        self.known: OrderedDict[bytes, tuple[int, bool, bool]] = OrderedDict()
        self.hits = self.misses = 0

    def summary(self, chunk: bytes) -> tuple[int, bool, bool]:
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            self.known.move_to_end(chunk)
            return found
        self.misses += 1
        words = self.unit == "word"
        found = (len(unit_starts(chunk, self.unit)), words and not SPACES[chunk[0]], words and not SPACES[chunk[-1]])
        self.known[chunk] = found
        self.room -= len(chunk)
        while self.room < 0:
            self.room += len(self.known.popitem(last=False)[0])
        return found

    def chunks(self, data: bytes) -> tuple[list[int], list[int], list[bool]]:
        """Ends of the chunks, units that start up to each end, and whether each chunk starts inside a unit."""
        ends, totals, inside = [], [], []
        start, total, open_ = 0, 0, False
        for end in chunk_ends(data):
            count, joins, leaves = self.summary(data[start:end])
            inside.append(joins and open_)
            total += count - inside[-1]
            ends.append(end)
            totals.append(total)
            start, open_ = end, leaves
        return ends, totals, inside

    def locate(self, data: bytes, unit: int, ends: list[int], totals: list[int], inside: list[bool]) -> int:
        """The byte offset before unit number ``unit`` (from 0); only the chunk where it starts is looked into."""
        if unit == 0:
            return 0
        if not totals or unit >= totals[-1]:
            return len(data)
        at = int(np.searchsorted(totals, unit, side="right"))
        start = ends[at - 1] if at else 0
        starts = unit_starts(data[start:ends[at]], self.unit)[int(inside[at]):]
        return start + int(starts[unit - (totals[at - 1] if at else 0)])


def codepoints(data: bytes) -> int:
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def rearranged(
    data: bytes, key: str, counter: Counter, seed: int, plain_share: int, spm_share: int, sentinels: tuple[bytes, bytes, bytes]
) -> tuple[int, str, int | None, int | None, bytes]:
    ends, totals, inside = counter.chunks(data)
    n = totals[-1] if totals else 0
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not data or any(s in data for s in sentinels) or h3 % 100 >= 100 - plain_share:
        return n, "plain", None, None, data
    first, second = (counter.locate(data, u, ends, totals, inside) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = data[:first], data[first:second], data[second:]
    p, s, m = sentinels
    spm = h4 % 100 < spm_share
    output = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    return n, "spm" if spm else "psm", codepoints(prefix), codepoints(middle), output


def transform(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "codepoint", seed: int = SEED,
    plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE, sentinels: tuple[str, str, str] = SENTINELS,
    cache_bytes: int = CACHE_BYTES, into: str = "infill",
) -> DataFrame:
    """``documents`` with a struct column ``into``: ``n, form, prefix_chars, middle_chars, output``.

    A text of ``n`` units is cut before two units that the seed and the id decide, and put out as ``psm`` (prefix, suffix,
    middle), ``spm`` (suffix, prefix, middle) or ``plain`` (as it is; empty texts and those that hold a sentinel always
    are). ``unit`` is ``codepoint`` or ``word``; white space before a word belongs to the part before the cut. The cuts depend
    on the whole text, seed and id alone, never on what a task remembers.

    A null text counts as empty, a null id as the empty string. Repeated rows and ties of ids are rows like any other and come out
    alike. ``into`` must not be a column of ``documents``. An empty table stays empty.
    """
    if into.lower() in {c.lower() for c in documents.columns}:
        raise ValueError(f"the column {into!r} exists already")
    marks = tuple(s.encode() for s in sentinels)

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output binary")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        counter = Counter(unit, cache_bytes)
        for keys, texts in batches:
            rows = [rearranged(bytes(t), k, counter, seed, plain_share, spm_share, marks) for k, t in zip(keys, texts)]
            found = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    raw = free_names(documents, "raw")[0]
    key = F.coalesce(named(doc_id).cast("string"), F.lit(""))
    made = bounded_batches(documents).withColumn(raw, of(key, F.coalesce(named(text), F.lit("")).cast("binary")))
    parts = [F.col(f"{raw}.{c}") for c in ("n", "form", "prefix_chars", "middle_chars")]
    return made.select(*map(named, documents.columns), F.struct(*parts, F.col(f"{raw}.output").cast("string").alias("output")).alias(into))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made from. No part of a cut text holds a sentinel, so the first ones are the marks."""
    p, s, m = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one, two = F.locate(second, output), F.locate(m, output)
        left = F.substring(output, F.lit(len(first) + 1), one - F.lit(len(first) + 1))
        right = F.substring(output, one + F.lit(len(second)), two - one - F.lit(len(second)))
        return left, right, F.substring(output, two + F.lit(len(m)), F.length(output))

    prefix, suffix, middle = parts(p, s)
    suffix_, prefix_, middle_ = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def sql() -> str:
    """The same digests over ``documents`` by plain substrings."""
    p, s, m = SENTINELS
    return f"""
with hashed as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), i, 8))::bigint) as h
  from documents
),
cut as (
  select *, least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b,
    case when t = '' or contains(t, '{p}') or contains(t, '{s}') or contains(t, '{m}') or h[3] % 100 >= {100 - PLAIN_SHARE} then 'plain'
      when h[4] % 100 < {SPM_SHARE} then 'spm' else 'psm' end as form
  from hashed
),
parts as (select *, substring(t, 1, a) as pre, substring(t, a + 1, b - a) as mid, substring(t, b + 1) as suf from cut)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a end::bigint as prefix_chars,
  case when form <> 'plain' then b - a end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '{p}' || pre || '{s}' || suf || '{m}' || mid
    else '{s}' || suf || '{p}' || pre || '{m}' || mid end) as output_sha256,
  sha256(case form when 'plain' then t else pre || mid || suf end) as restored_sha256
from parts"""
