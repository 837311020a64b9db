"""Language identification by cross-parsing against suffix automata of labelled text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, free_names, materialise, named, ship

ship(__name__)

# The bounded sample of labelled rows: texts per language, their excerpts, and characters per language.
TRAIN_TEXTS = 200
EXCERPT = 256
TRAIN_CHARS = 24_576
DENSE = 252  # symbols up to which the transitions are held as a full table; with more, as a hash table
BLOCK = 2048  # a phrase ends at every multiple of so many characters of a text
BATCH_CHARS = 2_000_000
UNDETERMINED = "und"
MIN_PHRASE = 1.5
SPACE, FOREIGN, FIRST = 0, 1, 2


def training_rows(documents: DataFrame, doc_id: str = "doc_id") -> Column:
    """The rows that may be learned from: checksum of the id not 1 modulo 3 (a null id is none of them)."""
    return F.crc32(named(doc_id).cast("string")) % 3 != 1


def training_sample(
    documents: DataFrame, text: str, lang: str, texts: int = TRAIN_TEXTS, chars: int = TRAIN_CHARS, excerpt: int = EXCERPT
) -> DataFrame:
    """Excerpts ``(lang, excerpt)``: per language those of least hash among the texts of least hash.

    Texts are told apart by their hash first, so that a large group of copies counts once.
    """
    rows = documents.where(named(lang).isNotNull() & (F.length(named(text)) > 0))
    rows = rows.select(named(lang).cast("string").alias("lang"), F.xxhash64(named(text)).alias("h"), named(text).alias("text"))
    listed = rows.select("lang", "h").distinct()
    # First within fine parts, so that what meets in a task is bounded however many tasks there are.
    part = listed.withColumn("part", F.pmod("h", F.lit(64)))
    part = part.withColumn("r", F.expr("row_number() over (partition by lang, part order by h)")).where(F.col("r") <= texts)
    rank = F.expr("row_number() over (partition by lang order by h)")
    chosen = materialise(part.withColumn("r", rank).where(F.col("r") <= texts).select("lang", "h"))
    # At most ``texts`` rows per language.
    found = rows.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"])
    pieces = F.expr(f"transform(sequence(0, (length(text) - 1) div {excerpt}), i -> substring(text, i * {excerpt} + 1, {excerpt}))")
    cut = found.select("lang", F.explode(pieces).alias("excerpt"))
    rank = F.expr("row_number() over (partition by lang order by xxhash64(excerpt), excerpt)")
    return cut.withColumn("r", rank).where(F.col("r") <= chars // excerpt).drop("r")


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The transitions of the suffix automaton of a sequence, by state."""
    link, length, nxt = [-1], [0], [{}]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
        last = cur
    return nxt


def hash_table(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (distinct, not negative) and values by slot of an open table of at least four slots a key; free slots have key -1."""
    slots = 1 << max(4, int(4 * len(keys) - 1).bit_length())
    held, to = np.full(slots, -1, np.int64), np.zeros(slots, np.int64)
    at, left = slot_of(keys, slots), np.arange(len(keys))
    while len(left):
        free = held[at[left]] < 0
        held[at[left[free]]] = keys[left[free]]  # of several keys for a slot the last one gets it
        placed = held[at[left]] == keys[left]
        to[at[left[placed]]] = values[left[placed]]
        left = left[~placed]
        at[left] = (at[left] + 1) & (slots - 1)
    return held, to


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(65 - slots.bit_length())).astype(np.int64)


class Model:
    """Parsing tables of all languages, over all letters of the sample (which bounds their number).

    With few letters they are one array: an entry is twice the offset of the next state's row, plus 1 where a phrase
    starts with the symbol (at the root, or where the longest match is over). With many letters the transitions are a
    hash table by state and symbol, and what it does not hold starts a phrase. A symbol that occurs nowhere in the
    language is a phrase of its own.
    """

    def __init__(self, excerpts: dict[str, list[str]]) -> None:
        self.langs = sorted(excerpts)
        counts: dict[str, int] = {}
        for parts in excerpts.values():
            for ch in "".join(parts).lower():
                if ch.isalpha():
                    counts[ch] = counts.get(ch, 0) + 1
        letters = sorted(sorted(counts), key=lambda ch: -counts[ch])
        self.width = FIRST + len(letters)
        self.codes = np.zeros(0x110000, np.uint8 if self.width <= 256 else np.uint32)
        self.codes[[c for c in range(0x110000) if chr(c).isalpha()]] = FOREIGN
        for i, ch in enumerate(letters):
            self.codes[ord(ch)] = FIRST + i
        self.roots, self.scale = [], []
        found = []
        for lang in self.langs:
            joined: list[int] = []
            for part in excerpts[lang]:
                joined += [*self.symbols(part).tolist(), FOREIGN]  # no phrase runs across excerpts
            found.append(automaton(joined))
            self.scale.append(np.log2(max(2, len(joined))))
        self.sparse = self.width > DENSE
        (self._hashed if self.sparse else self._tabled)(found)

    def _tabled(self, found: list[list[dict[int, int]]]) -> None:
        tables, base = [], 0
        for nxt in found:
            arcs = np.full((len(nxt), self.width), -1, np.int64)
            for state, out in enumerate(nxt):
                for c, to in out.items():
                    arcs[state, c] = to
            arcs[:, FOREIGN] = -1
            offsets = np.where(arcs >= 0, (arcs * self.width + base) * 2, -1)
            start = np.where(arcs[0] >= 0, offsets[0] + 1, base * 2 + 1)
            offsets = np.where(offsets >= 0, offsets, start[None, :])
            offsets[0] = start
            tables.append(offsets.reshape(-1))
            self.roots.append(base)
            base += arcs.size
        kind = np.int32 if base < 1 << 30 else np.int64
        self.table = np.concatenate(tables).astype(kind) if tables else np.zeros(0, kind)

    def _hashed(self, found: list[list[dict[int, int]]]) -> None:
        keys: list[int] = []
        values: list[int] = []
        base = 0
        self.starts = np.zeros((len(found), self.width), np.int64)
        for row, nxt in enumerate(found):
            self.roots.append(base)
            self.starts[row] = base
            for c, to in nxt[0].items():
                if c != FOREIGN:
                    self.starts[row, c] = base + to
            for state, out in enumerate(nxt[1:], 1):
                for c, to in out.items():
                    if c != FOREIGN:
                        keys.append((base + state) * self.width + c)
                        values.append(base + to)
            base += len(nxt)
        self.held, self.to = hash_table(np.array(keys, np.int64), np.array(values, np.int64))

    def moved(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states (languages x lanes) by the hash table, and where a phrase starts."""
        keys = (state * self.width + symbols).reshape(-1)
        at = slot_of(keys, len(self.held))
        seen = self.held[at]
        todo = np.flatnonzero((seen != keys) & (seen >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.held) - 1)
            seen[todo] = self.held[at[todo]]
            todo = todo[(seen[todo] != keys[todo]) & (seen[todo] >= 0)]
        starts = (seen != keys).reshape(state.shape)
        return np.where(starts, self.starts[:, symbols], self.to[at].reshape(state.shape)), starts

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a lower-cased text; all that is no letter is space, runs of it squeezed."""
        codes = self.codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != SPACE) | (codes[:-1] != SPACE)
        return codes[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of every text (rows) by every language (columns).

        The blocks of all texts are parsed side by side: one table look-up moves all of them one symbol on.
        """
        owners, blocks = [], []
        for i, symbols in enumerate(texts):
            for at in range(0, len(symbols), BLOCK):
                owners.append(i)
                blocks.append(symbols[at:at + BLOCK])
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not blocks:
            return out
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        lanes = np.zeros((sizes[0], len(blocks)), np.int32)
        for lane, i in enumerate(order):
            lanes[:sizes[lane], lane] = blocks[i]
        roots = np.array(self.roots, np.int64 if self.sparse else self.table.dtype)[:, None]
        state = np.repeat(roots, len(blocks), axis=1)
        count = np.zeros(state.shape, np.int32)
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lanes longer than each step
        for step in range(sizes[0]):
            n = live[step]
            if self.sparse:
                state[:, :n], starts = self.moved(state[:, :n], lanes[step, :n])
                count[:, :n] += starts
                continue
            moved = self.table[state[:, :n] + lanes[step, :n]]
            count[:, :n] += moved & 1
            state[:, :n] = moved >> 1
        np.add.at(out, np.array(owners)[order], count.T)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score and mean phrase length of every text."""
        found: list[tuple[str, float, float]] = []
        group: list[np.ndarray] = []
        held = 0

        def close() -> None:
            counts = self.phrases(group)
            for symbols, row in zip(group, counts):
                if not self.langs or not (symbols != SPACE).any():
                    found.append((UNDETERMINED, 0.0, 0.0))
                    continue
                rates = row * np.array(self.scale) / len(symbols)
                best = int(np.argmin(rates))  # the first of the alphabet on equal rates
                others = np.delete(rates, best)
                score = 1.0 - rates[best] / others.min() if len(others) else 1.0
                found.append((self.langs[best], float(min(1.0, max(0.0, score))), len(symbols) / row[best]))

        for text in texts:
            symbols = self.symbols(text or "")
            group.append(symbols)
            held += len(symbols)
            if held >= BATCH_CHARS:
                close()
                group, held = [], 0
        close()
        return found


def fit(documents: DataFrame, text: str = "text", lang: str = "lang", **bounds: int) -> Model:
    """Learn the languages from the labelled rows of ``documents`` (all rows given; restrict them before).

    The sample is bounded (``texts`` and ``chars`` per language), so the model is of a fixed size per language. Null
    languages and null or empty texts are left out. Without any labelled text the model knows no language.
    """
    excerpts: dict[str, list[str]] = {}
    for row in training_sample(documents, text, lang, **bounds).collect():
        excerpts.setdefault(row.lang, []).append(row.excerpt)
    return Model({name: sorted(parts) for name, parts in excerpts.items()})


def identify(documents: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """``documents`` with a struct column ``out`` (renamed where taken): ``lang``, ``score``, ``phrase``.

    ``lang`` is the language whose automaton parses the whole text into the fewest normalised phrases, ``score`` (0 to
    1) its lead over the next one, ``phrase`` the mean length of its phrases. Null texts, texts without a
    letter and all texts under a model without languages are ``und`` with score 0; equal rates go to the first
    language by name. Rows are independent, so repeated rows agree and nothing is shuffled.
    """
    # Plain data only: broadcasts are pickled by reference to their classes, which executors need not have.
    shared = documents.sparkSession.sparkContext.broadcast(vars(model))
    (column,) = free_names(documents, out)

    @F.pandas_udf("lang string, score double, phrase double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model.__new__(Model)
        vars(own).update(shared.value)
        for batch in batches:
            yield pd.DataFrame(own.predict(list(batch)), columns=["lang", "score", "phrase"])

    return bounded_batches(documents).withColumn(column, predict(named(text)))


def keep_identified(documents: DataFrame, model: Model, text: str = "text", min_phrase: float = MIN_PHRASE) -> DataFrame:
    """``documents`` in a learned language, in their own columns.

    Rejected are undetermined texts and those that share hardly more than single letters with the language they are
    nearest to (mean phrase below ``min_phrase``).
    """
    (column,) = free_names(documents, "language")
    found = identify(documents, model, text, column)
    kept = found.where((named(column)["lang"] != UNDETERMINED) & (named(column)["phrase"] >= min_phrase))
    return kept.select(*map(named, documents.columns))
