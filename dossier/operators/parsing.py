"""Documents to sections to overlapping chunks, one row in, many rows out, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.html import extract_text
from dossier.functions.text import EOL, NOT_SPACE, SPACE, classify_heading, let, normalize_heading, rstrip, strip

_BLANK = rf"[^\S{EOL}]"


def with_text(documents: DataFrame, content: str = "content") -> DataFrame:
    """Replace raw document content by its readable text."""
    return documents.withColumn("text", extract_text(F.col(content))).drop(content)


def _heading_lines(text: Column) -> Column:
    """Lines that may be headings, each with its offset and classified type.

    The text is cut at the end of every line before one that begins with "item" once blanks and the trimmed
    punctuation are skipped, so only a handful of pieces per document are ever looked at. The line end itself goes.
    """
    pieces = F.split(text, rf"[{EOL}](?iU)(?=(?:{_BLANK}|[.:\-])*item)")

    def describe(piece: Column) -> Column:
        line = F.regexp_extract(piece, rf"\A([^{EOL}]*)", 1)
        return let(
            strip(line),
            lambda name: F.struct(
                (F.length(piece) + 1).alias("size"),
                name.alias("name"),
                let(normalize_heading(name), classify_heading).alias("type"),
                (F.length(line) - F.length(F.regexp_replace(line, rf"(?U)\A{SPACE}+", ""))).alias("indent"),
            ),
        )

    return F.transform(pieces, describe)


_MARKERS = "array<struct<name: string, type: string, offset: int>>"


def find_markers(text: Column) -> Column:
    """Section headings in order, without one that repeats the last kept type within the minimum gap."""

    def step(state: Column, piece: Column) -> Column:
        offset = state["at"] + piece["indent"]
        last = F.try_element_at(state["kept"], F.lit(-1))
        repeats = (last["type"] == piece["type"]) & (offset - last["offset"] < K.MIN_MARKER_GAP)
        keep = piece["type"].isNotNull() & ~F.coalesce(repeats, F.lit(False))
        marker = F.struct(piece["name"].alias("name"), piece["type"].alias("type"), offset.cast("int").alias("offset"))
        return F.struct(
            (state["at"] + piece["size"]).alias("at"),
            F.when(keep, F.concat(state["kept"], F.array(marker))).otherwise(state["kept"]).alias("kept"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_MARKERS).alias("kept"))
    return F.aggregate(_heading_lines(text), start, step, lambda state: state["kept"])


def detect_sections(documents: DataFrame, text: str = "text") -> DataFrame:
    """One row per section: from each heading up to the next; the whole text when there is none.

    Adds ``section_sequence, section_name, section_type, section_text, text_hash, start_offset,
    end_offset`` and drops the full text.
    """
    body = F.col(text)
    whole = F.array(F.struct(F.lit("Document").alias("name"), F.lit("document").alias("type"), F.lit(0).alias("offset")))
    marked = documents.withColumn("_markers", find_markers(body)).withColumn("_any", F.size("_markers") > 0)
    bounds = let(
        F.when(F.col("_any"), F.col("_markers")).otherwise(whole.cast(_MARKERS)),
        lambda ms: F.transform(
            ms,
            lambda m, i: F.struct(
                m["name"].alias("name"),
                m["type"].alias("type"),
                m["offset"].alias("start"),
                F.coalesce(F.get(ms, i + 1)["offset"], F.length(body)).alias("stop"),
            ),
        ),
    )
    kept = [c for c in documents.columns if c != text]
    rows = marked.select("*", F.posexplode(bounds).alias("_pos", "_s"))
    cut = F.substring(body, F.col("_s.start") + 1, F.col("_s.stop") - F.col("_s.start"))
    return rows.select(
        *kept,
        (F.col("_pos") + 1).alias("section_sequence"),
        F.col("_s.name").alias("section_name"),
        F.col("_s.type").alias("section_type"),
        F.when(F.col("_any"), strip(cut)).otherwise(cut).alias("section_text"),
        F.col("_s.start").alias("start_offset"),
        F.col("_s.stop").alias("end_offset"),
    ).withColumn("text_hash", F.sha2("section_text", 256))


def token_windows(text: Column, max_tokens: int, overlap_tokens: int) -> Column:
    """Overlapping windows of white-space tokens with their character spans.

    One match takes a whole stride of tokens, so the work per window does not depend on its tokens one by one: a window is
    its whole strides and the first tokens of the next one, and its position is the summed length of the strides before it.
    """
    if max_tokens < 1 or not 0 <= overlap_tokens < max_tokens:
        raise ValueError("need max_tokens >= 1 and 0 <= overlap_tokens < max_tokens")
    stride = max_tokens - overlap_tokens
    whole, rest = divmod(max_tokens, stride)
    token = f"{NOT_SPACE}++{SPACE}*+"
    lead = F.length(F.regexp_extract(text, rf"(?U)\A({SPACE}*+)", 1))
    strides = F.regexp_extract_all(text, F.lit(rf"(?U)((?:{token}){{1,{stride}}}+)"), 1)

    def window(ss: Column, w: Column) -> Column:
        body = F.array_join(F.slice(ss, w + 1, F.lit(whole)), "")
        if rest:
            tail = F.regexp_extract(F.get(ss, w + whole), rf"(?U)\A((?:{token}){{1,{rest}}}+)", 1)
            body = F.concat(body, F.coalesce(tail, F.lit("")))
        return rstrip(body)

    def cut(ss: Column, sizes: Column, before: Column, count: Column) -> Column:
        last = F.when(count <= max_tokens, F.lit(0)).otherwise(F.ceil((count - max_tokens) / F.lit(stride)).cast("int"))
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda w: let(
                window(ss, w),
                lambda chunk: F.struct(
                    chunk.alias("text"),
                    F.least(count - w * stride, F.lit(max_tokens)).alias("token_count"),
                    (before + F.aggregate(F.slice(sizes, F.lit(1), w), F.lit(0), lambda acc, n: acc + n)).alias("start"),
                    F.length(chunk).alias("size"),
                ),
            ),
        )

    def bind(ss: Column) -> Column:
        in_last = F.size(F.regexp_extract_all(F.element_at(ss, -1), F.lit(rf"(?U)({NOT_SPACE}++)"), 1))
        bound = F.struct(
            F.transform(ss, F.length).alias("sizes"), lead.alias("before"), ((F.size(ss) - 1) * stride + in_last).alias("count")
        )
        return F.when(F.size(ss) > 0, let(bound, lambda b: cut(ss, b["sizes"], b["before"], b["count"])))

    return let(strides, bind)


def chunk_id(accession: Column, section: Column, chunk: Column) -> Column:
    return F.format_string("%s:s%04d:c%04d", accession, section, chunk)


def cut_chunks(
    sections: DataFrame,
    max_tokens: int = K.DEFAULT_MAX_TOKENS,
    overlap_tokens: int = K.DEFAULT_OVERLAP_TOKENS,
    text: str = "section_text",
) -> DataFrame:
    """One row per token window of every section, with a deterministic chunk id.

    Expects ``accession_number, section_sequence, start_offset`` next to the section text.
    """
    kept = [c for c in sections.columns if c != text]
    rows = sections.select(*kept, F.posexplode(token_windows(F.col(text), max_tokens, overlap_tokens)).alias("_pos", "_w"))
    start = F.col("start_offset") + F.col("_w.start")
    return rows.select(
        chunk_id(F.col("accession_number"), F.col("section_sequence"), F.col("_pos") + 1).alias("chunk_id"),
        *[c for c in kept if c not in ("start_offset", "end_offset", "text_hash")],
        (F.col("_pos") + 1).alias("chunk_sequence"),
        F.col("_w.text").alias("text"),
        F.col("_w.token_count").alias("token_count"),
        start.alias("source_start"),
        (start + F.col("_w.size")).alias("source_end"),
    )


METADATA_KEYS = (
    "accession_number", "cik", "filing_date", "fiscal_quarter", "fiscal_year", "form_type", "report_date",
    "section_name", "section_sequence", "section_type", "source_url",
)
OVERLAY_KEYS = ("chunk_id", "source_end", "source_start", "token_count")


def with_metadata(chunks: DataFrame, keys: Sequence[str] = METADATA_KEYS) -> DataFrame:
    """Pack filing and section fields, overlaid with the chunk's own fields, into ``metadata``."""
    return chunks.withColumn("metadata", F.struct(*keys, *OVERLAY_KEYS))


def parse_counts(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sections and chunks created per filing; a filing whose text is empty still counts its section."""
    made = sections.groupBy("accession_number").agg(F.count("*").alias("sections_created"))
    cut = chunks.groupBy("accession_number").agg(F.count("*").alias("chunks_created"))
    return made.join(cut, "accession_number", "left").select(
        "accession_number", "sections_created", F.coalesce("chunks_created", F.lit(0)).alias("chunks_created")
    )
