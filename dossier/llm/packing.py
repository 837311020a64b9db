"""Best-fit packing of token pieces under several capacities at once."""

from __future__ import annotations

import zlib
import numpy as np
from pyspark.sql import DataFrame

from dossier.llm.common import bounded_batches, free_names, named, ship

ship(__name__)

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k"
# Pieces that one task packs together; more pieces make more tasks, never larger ones.
GROUP = 10_000
# Weights of the residual tokens, documents and attention cost, each relative to its capacity. Tokens lead, so
# that the fewest sequences result where the other capacities leave room.
WEIGHTS = (1.0, 1e-4, 1e-4)
LONG_RUN = 2000


class Encoder:
    """Text -> token ids as the tokenizer file gives them (ids of special strings in a text included).

    The merge ranks of the same vocabulary, read by the faster library, give the same ids; texts with an unbroken
    run of over ``LONG_RUN`` characters go through the tokenizer file itself, whose merging is not quadratic in
    the length of a run.
    """

    def __init__(self, tokenizer: str = TOKENIZER) -> None:
        import base64
        import json
        import re

        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(f"{tokenizer}.json")
        self.exact = None
        with open(self.path, encoding="utf-8") as described:
            special = {t["content"]: t["id"] for t in json.load(described)["added_tokens"]}
        with open(public_tokenizers.path(f"{tokenizer}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding(tokenizer, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.run = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))

    def __call__(self, text: str) -> np.ndarray:
        if self.run.search(text):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.path)
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")


def tokenise(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER,
    end_id: int = 0, with_ids: bool = True,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``doc_id, piece, start, length, ids_crc32`` and the ``ids`` if wanted.

    The ids of a document are those of its whole text and ``end_id``. Only longer ones are cut; the first piece takes
    what is left over, all others are full. ``start`` is the number of the document's ids before the piece,
    ``ids_crc32`` the checksum of its little-endian 32-bit ids.

    A null text counts as empty: one piece that holds the end id. Repeated rows and null ids are kept as they are;
    other columns are not read. An empty table has no pieces.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def cut(batches):
        import pyarrow as pa

        encode = Encoder(tokenizer)
        for batch in batches:
            owners, pieces, starts, lengths, sums, held = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                ids = np.append(encode(value.as_py() or ""), np.uint32(end_id)).astype("<u4")
                bounds = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    owners.append(row)
                    pieces.append(piece)
                    starts.append(a)
                    lengths.append(b - a)
                    sums.append(zlib.crc32(ids[a:b].tobytes()))
                    if with_ids:
                        held.append(ids[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(pieces, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (starts, lengths, sums)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(held, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    source = documents.select(named(doc_id).alias("doc_id"), named(text).cast("string").alias("text"))
    return bounded_batches(source).mapInArrow(cut, schema)


def choose(lengths: np.ndarray, capacity: int, max_documents: int, max_attention: int, weights: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and place of every piece (lengths in falling order).

    Each piece goes into the open bin with room in every capacity whose residual vector, each part relative to its
    capacity, has the least weighted norm afterwards; a bin that cannot take the least piece is closed.
    """
    n = len(lengths)
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    tokens, docs, cost = (np.zeros(n, np.float64) for _ in range(3))
    number = np.zeros(n, np.int64)
    open_, made, least = 0, 0, float(lengths[-1]) if n else 0.0
    wt, wd, wc = weights[0] / capacity**2, weights[1] / max_documents**2, weights[2] / float(max_attention) ** 2
    for i, length in enumerate(lengths.tolist()):
        square = float(length) * length
        spot = -1
        if open_:
            t, d, c = tokens[:open_] - length, docs[:open_] - 1, cost[:open_] - square
            room = np.flatnonzero((t >= 0) & (d >= 0) & (c >= 0))
            if len(room):
                norm = wt * t[room] ** 2 + wd * d[room] ** 2 + wc * c[room] ** 2
                spot = int(room[np.argmin(norm)])
        if spot < 0:
            spot, open_ = open_, open_ + 1
            tokens[spot], docs[spot], cost[spot], number[spot] = capacity, max_documents, max_attention, made
            made += 1
        bins[i], places[i] = number[spot], capacity - tokens[spot]
        tokens[spot] -= length
        docs[spot] -= 1
        cost[spot] -= square
        if tokens[spot] < least or docs[spot] < 1 or cost[spot] < least * least:
            open_ -= 1
            for part in (tokens, docs, cost, number):
                part[spot] = part[open_]
    return bins, places


def pack(
    pieces: DataFrame, length: str = "length", capacity: int = CAPACITY, max_documents: int | None = None,
    max_attention: int | None = None, weights: tuple = WEIGHTS, group: int = GROUP,
) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (renamed where taken): their place in sequences.

    A sequence holds at most ``capacity`` tokens, ``max_documents`` pieces and an attention cost (sum of squared
    lengths) of ``max_attention``; by default the latter two leave as much room as the tokens do. Pieces are dealt
    evenly, whatever their keys, to tasks of about ``group`` pieces, which pack them by best fit in falling order
    of length. Offsets are gapless from 0 in each sequence.

    ``pieces`` should be a stored table (see ``materialise``); it is counted once. A piece with a null or negative
    length, or one that no sequence can hold, is an error. An empty table stays empty.
    """
    max_documents = max_documents or capacity
    max_attention = max_attention or capacity * capacity
    sequence, offset = free_names(pieces, "sequence_id", "offset")
    columns = pieces.columns
    parts = max(1, -(-pieces.count() // group))
    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes) + f", `{sequence}` long, `{offset}` long"

    def place(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        lengths = rows.column(length).to_numpy(zero_copy_only=False)
        if rows.column(length).null_count or lengths.min() < 0 or lengths.max() > capacity or lengths.max() ** 2 > max_attention:
            raise ValueError("a piece has no length, or no sequence can hold it")
        # A fixed order, so that a task that runs again places its rows alike.
        flat = [c for c in columns if not pa.types.is_nested(rows.schema.field(c).type)]
        order = pc.sort_indices(rows, [(length, "descending")] + [(c, "ascending") for c in flat if c != length])
        rows = rows.take(order)
        bins, places = choose(lengths[order.to_numpy()], capacity, max_documents, max_attention, weights)
        base = TaskContext.get().partitionId() << 32
        rows = rows.append_column(sequence, pa.array(bins + base)).append_column(offset, pa.array(places))
        yield from rows.to_batches(max_chunksize=10_000)

    return pieces.repartition(parts).mapInArrow(place, schema)
