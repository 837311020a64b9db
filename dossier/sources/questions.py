"""Benchmark questions from JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import constants as K
from dossier import schemas
from dossier.operators.evaluation import response_citations
from dossier.operators.guards import response_text
from dossier.operators.upserts import latest_per_key


WEB = "array<struct<chunk_id: string, section_name: string, section_type: string, source_url: string, snippet: string>>"


def parse_questions(lines: DataFrame, column: str = "value") -> DataFrame:
    """Question rows from JSON lines; blank lines and ``#`` comments are skipped, defaults filled in.

    A line that is not a valid question fails the query with the line's text.
    """
    text = F.trim(F.col(column))
    rows = lines.where((text != "") & ~text.startswith("#"))
    kept = [c for c in lines.columns if c != column]
    parsed = rows.select(*kept, text.alias("line"), F.from_json(text, schemas.QUESTION, {"mode": "PERMISSIVE"}).alias("q"))
    valid = (
        F.col("q").isNotNull()
        & (F.coalesce(F.col("q.id"), F.lit("")) != "")
        & (F.coalesce(F.col("q.question"), F.lit("")) != "")
        & (F.coalesce(F.col("q.accession_number"), F.lit("")) != "")
        & F.col("q.expected").isNotNull()
        & F.coalesce(F.col("q.top_k"), F.lit(K.DEFAULT_TOP_K)).between(1, K.MAX_TOP_K)
    )
    # A condition on a question may be evaluated before comments are left out, so these must not raise.
    skipped = (F.col("line") == "") | F.col("line").startswith("#")
    checked = parsed.select(
        *kept,
        F.when(valid | skipped, F.col("q")).otherwise(
            F.raise_error(F.concat(F.lit("Invalid eval question: "), F.col("line"))).cast(parsed.schema["q"].dataType)
        ).alias("q")
    ).select(*kept, "q.*")
    e = F.col("expected")
    empty = F.array().cast("array<string>")
    lists = ("answer_keywords", "citation_chunk_ids", "section_types", "xbrl_concepts")
    expected = F.struct(
        F.coalesce(e["supported"], F.lit(True)).alias("supported"),
        *[F.coalesce(e[name], empty).alias(name) for name in lists],
        *[e[name].alias(name) for name in ("numeric_value", "numeric_unit", "insufficient_reason")],
    )
    return checked.withColumns({
        "expected": expected,
        "question_type": F.coalesce("question_type", F.lit("text")),
        "top_k": F.coalesce("top_k", F.lit(K.DEFAULT_TOP_K)),
    }).withColumnRenamed("id", "question_id")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of JSONL files in file order (``question_order``); without any question it is an error.

    The order is that of the files, their blocks, and the lines within a block, however the blocks are dealt out.
    """
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", place.alias("question_order"))
    text = F.trim(F.col("value"))
    kept = lines.where((text != "") & ~text.startswith("#"))
    if kept.isEmpty():
        raise ValueError(f"No eval questions found in {path}")
    return parse_questions(kept)


def read_stored_answers(spark: SparkSession, folder: str | None) -> DataFrame:
    """``question_id, variant, answer, web`` of the answer files ``<variant>-<question id>-<digest>.json`` of a folder.

    A file holds an extracted answer or a raw response. Of several files for a question the last written counts. Without a
    folder there are none.
    """
    if folder is None:
        return spark.createDataFrame([], f"question_id string, variant string, answer string, web {WEB}")
    variants = "|".join(v for v, *_ in K.VARIANTS)
    name = F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))), rf"^({variants})-(.*)-[^-]*\.json$", 0)
    rows = spark.read.schema(schemas.STORED_ANSWER).option("multiLine", True).json(folder).select(
        "*", name.alias("name"), F.col("_metadata.file_modification_time").alias("written")
    ).where("name <> ''")
    response = F.struct("output_text", "output")
    found = rows.select(
        F.regexp_extract("name", rf"^({variants})-(.*)-[^-]*\.json$", 1).alias("variant"),
        F.regexp_extract("name", rf"^({variants})-(.*)-[^-]*\.json$", 2).alias("question_id"),
        F.struct("written", "name").alias("order"),
        F.coalesce("answer", response_text(response)).alias("answer"),
        F.coalesce("web_citations", response_citations(F.col("output"))).cast(WEB).alias("web"),
    )
    return latest_per_key(found, ["question_id", "variant"], ["order"]).drop("order")
