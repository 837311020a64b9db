"""Scoring answer variants on a question benchmark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from dossier import constants as K
from dossier.functions.numeric import expected_tokens, number_text, number_tokens, percent_text
from dossier.functions.text import any_contains, casefold, clip, digits, let, squash, strip
from dossier.operators import answering, retrieval
from dossier.operators.questions import classify
from dossier.operators.snippets import best_snippets
from dossier.session import durable

SCORES = (
    "answer_correct", "supported_match", "keyword_match", "citation_recall", "section_recall", "evidence_recall",
    "numeric_match", "numeric_grounding_match", "refusal_match", "latency_ms", "error",
)


# ---- scores -----------------------------------------------------------------------------------


def recall(expected: Column, observed: Column) -> Column:
    """Share of expected values observed; repeated expectations count repeatedly; 1.0 if none."""
    hits = F.size(F.filter(expected, lambda e: F.array_contains(observed, e)))
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(F.try_divide(hits.cast("double"), F.size(expected).cast("double")))


def keyword_match(keywords: Column, context: Column) -> Column:
    """Share of keywords contained in the context, ignoring case; 1.0 if none are expected."""
    def share(folded: Column) -> Column:
        hits = F.size(F.filter(keywords, lambda k: F.contains(folded, casefold(k))))
        return F.when(F.size(keywords) == 0, F.lit(1.0)).otherwise(F.try_divide(hits.cast("double"), F.size(keywords).cast("double")))

    return let(casefold(context), share)


def answer_context(answer: Column, snippets: Column) -> Column:
    return F.concat(answer, F.lit(" "), F.array_join(snippets, " "))


def grounding_match(value: Column, concepts: Column, unit: Column, grounding: Column) -> Column:
    """1.0 when the grounding has the expected value, concept and unit; -1.0 for non-numeric questions."""
    wanted = F.coalesce(digits(value), F.lit(""))
    matches = (
        grounding.isNotNull()
        & ((wanted == "") | (digits(F.coalesce(grounding["value"], F.lit(""))) == wanted))
        & ((F.size(concepts) == 0) | F.coalesce(F.array_contains(concepts, grounding["concept"]), F.lit(False)))
        & (unit.isNull() | F.coalesce(grounding["unit"] == unit, F.lit(False)))
    )
    return F.when(value.isNull() & (F.size(concepts) == 0), F.lit(-1.0)).otherwise(matches.cast("double"))


def numeric_match(value: Column, concepts: Column, grounded: Column, context: Column) -> Column:
    """1.0 when grounded or when the expected number (also scaled down) is quoted in the context."""
    quoted = F.arrays_overlap(expected_tokens(value), number_tokens(context))
    return (
        F.when(value.isNull() & (F.size(concepts) == 0), F.lit(-1.0))
        .when(grounded == 1.0, F.lit(1.0))
        .when(value.isNull(), F.lit(0.0))
        .otherwise(F.coalesce(quoted, F.lit(False)).cast("double"))
    )


def refusal_match(expected_supported: Column, expected_reason: Column, supported: Column, reason: Column) -> Column:
    reason_ok = expected_reason.isNull() | F.coalesce(reason == expected_reason, F.lit(False))
    return F.when(expected_supported, F.lit(-1.0)).otherwise((~supported & reason_ok).cast("double"))


def answer_correct(
    error: Column, expected_supported: Column, supported: Column, is_numeric: Column, has_keywords: Column,
    refusal: Column, numeric: Column, keyword: Column,
) -> Column:
    return (
        F.when(error.isNotNull(), F.lit(0.0))
        .when(~expected_supported, refusal)
        .when(~supported, F.lit(0.0))
        .when(is_numeric, (numeric == 1.0).cast("double"))
        .when(has_keywords, (keyword == 1.0).cast("double"))
        .otherwise(F.lit(1.0))
    )


def score(predictions: DataFrame) -> DataFrame:
    """Score rows holding ``expected`` (struct) next to a prediction; adds the columns in ``SCORES``.

    Expects ``question_id, variant, expected, supported, answer, citations, numeric_grounding,
    insufficient_evidence_reason, latency_ms, error``.
    """
    e = F.col("expected")
    value, concepts = e["numeric_value"], e["xbrl_concepts"]
    cited = predictions.withColumn("_context", answer_context(F.col("answer"), F.col("citations.snippet")))
    scored = (
        cited.withColumn("keyword_match", keyword_match(e["answer_keywords"], F.col("_context")))
        .withColumn("citation_recall", recall(e["citation_chunk_ids"], F.col("citations.chunk_id")))
        .withColumn("section_recall", recall(e["section_types"], F.array_compact(F.col("citations.section_type"))))
        .withColumn("numeric_grounding_match", grounding_match(value, concepts, e["numeric_unit"], F.col("numeric_grounding")))
        .withColumn("numeric_match", numeric_match(value, concepts, F.col("numeric_grounding_match"), F.col("_context")))
        .withColumn(
            "refusal_match",
            refusal_match(e["supported"], e["insufficient_reason"], F.col("supported"), F.col("insufficient_evidence_reason")),
        )
    )
    is_numeric = value.isNotNull() | (F.size(concepts) > 0)
    correct = answer_correct(
        F.col("error"), e["supported"], F.col("supported"), is_numeric, F.size(e["answer_keywords"]) > 0,
        F.col("refusal_match"), F.col("numeric_match"), F.col("keyword_match"),
    )
    return scored.select(
        *[c for c in predictions.columns if c not in ("latency_ms", "error")],
        F.col("error").alias("error_text"),
        correct.alias("answer_correct"),
        (F.col("supported") == e["supported"]).cast("double").alias("supported_match"),
        "keyword_match", "citation_recall", "section_recall",
        F.when(F.size(e["citation_chunk_ids"]) > 0, F.col("citation_recall")).otherwise(F.col("section_recall")).alias("evidence_recall"),
        "numeric_match", "numeric_grounding_match", "refusal_match",
        F.col("latency_ms"),
        F.col("error").isNotNull().cast("double").alias("error"),
    )


def aggregate(scores: DataFrame, *by: str) -> DataFrame:
    """Mean metrics per variant (or the given keys); conditional means skip the -1.0 marker."""
    return scores.groupBy(*(by or ("variant",))).agg(*mean_metrics())


def mean_metrics() -> list[Column]:
    def applicable(name: str) -> Column:
        return F.avg(F.when(F.col(name) >= 0, F.col(name)))

    return [
        F.count("*").alias("questions"),
        F.avg("answer_correct").alias("accuracy"),
        F.avg("supported_match").alias("supported_accuracy"),
        F.avg("evidence_recall").alias("evidence_recall"),
        F.avg("citation_recall").alias("citation_recall"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.avg("error").alias("error_rate"),
        applicable("numeric_match").alias("numeric_accuracy"),
        applicable("numeric_grounding_match").alias("numeric_grounding_accuracy"),
        applicable("refusal_match").alias("refusal_accuracy"),
    ]


def headline(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metrics per variant, averaged over issuers and, as ``pooled_``, over all questions.

    One pass over the scores, by grouping sets. The two differ where issuers have different numbers of questions, and for
    conditional metrics where they have different numbers of applicable ones.
    """
    issuer, variant = F.col("issuer"), F.col("variant")
    levels = scores.groupingSets([[issuer, variant], [variant]], issuer, variant).agg(F.grouping_id().alias("level"), *mean_metrics())
    pooled = F.col("level") != 0
    means = [F.avg(F.when(~pooled, F.col(m))).alias(m) for m in metrics]
    return levels.groupBy("variant").agg(*means, *[F.max(F.when(pooled, F.col(m))).alias(f"pooled_{m}") for m in metrics])


# ---- predictions ------------------------------------------------------------------------------


def variant_table(spark: SparkSession, names: Sequence[str] = K.DEFAULT_VARIANTS) -> DataFrame:
    known = {row[0]: row for row in K.VARIANTS}
    missing = [n for n in names if n not in known]
    if missing:
        raise ValueError(f"unknown variants: {missing}")
    rows = [(i, *known[n]) for i, n in enumerate(names)]
    return spark.createDataFrame(
        rows, "variant_rank int, variant string, use_filters boolean, use_facts boolean, use_model boolean"
    )


def expand(questions: DataFrame, variants: DataFrame) -> DataFrame:
    """Every question under every variant; filters are only kept for variants that use them.

    The variant side is the fixed dimension of at most eight rows, hence the broadcast.
    """
    crossed = questions.crossJoin(F.broadcast(variants))
    for name in answering.FILTERS:
        crossed = crossed.withColumn(name, F.when(F.col("use_filters"), F.col(name)))
    return crossed


def closed_book(questions: DataFrame) -> DataFrame:
    """Refusals without any filing context."""
    unsupported = classify(F.col("question")) == "unsupported"
    return questions.select(
        "*",
        F.lit(False).alias("supported"),
        F.when(unsupported, F.lit(K.UNSUPPORTED_ANSWER)).otherwise(F.lit(K.INSUFFICIENT_ANSWER)).alias("answer"),
        F.when(unsupported, F.lit("unsupported_query_type")).otherwise(F.lit("closed_book_no_filing_context")).alias(
            "insufficient_evidence_reason"
        ),
    )


PREDICTED = (
    "query_type", "confidence", "citations", "numeric_grounding", "retrieval_count", "error", "answer_mode", "synthesis_status",
    "synthesis_reason",
)


def predict(
    questions: DataFrame, variants: DataFrame, filings: DataFrame, index: DataFrame, facts: DataFrame,
    stored: DataFrame | None = None, model: str | None = None,
) -> DataFrame:
    """Predictions of all variants for every question.

    All retrieval variants run as one answering job over (question, variant) rows. The guarded variant and the external ones take
    generated answers from ``stored`` (``question_id, variant, answer, web``). A question that a variant cannot run
    for, because it is malformed or its filing cannot be searched, becomes an error row instead of failing the run. The questions, and
    what is needed of the filings they name, are written once, since many steps read them.
    """
    questions = durable(questions, "asked-questions")
    named = questions.select("accession_number").distinct()
    filings = durable(filings.join(named, "accession_number", "left_semi").select(
        "accession_number", "cik", "form_type", "fiscal_year", "fiscal_quarter"
    ), "asked-filings")
    rows = expand(questions, variants).withColumn("base_id", F.col("question_id")).withColumn(
        "question_id", F.concat_ws("|", F.col("base_id").cast("string"), F.col("variant"))
    )
    external = F.col("variant").startswith(K.EXTERNAL_PREFIX)
    searched = rows.where((F.col("variant") != "closed_book") & ~external)
    answered = answering.answer(searched, filings, index, facts).withColumn("error", F.lit(None).cast("string"))
    guarded = F.col("use_model")
    none = [F.lit(None).cast("string").alias(c) for c in ("answer_mode", "synthesis_status", "synthesis_reason")]
    names = [*answered.columns, "answer_mode", "synthesis_status", "synthesis_reason"]
    if stored is not None:
        key = F.concat_ws("|", "question_id", "variant")
        candidates = stored.where(F.col("variant") == K.GUARDED_VARIANT).select(key.alias("question_id"), F.col("answer").alias("candidate_answer"))
        judged = answering.with_answer_mode(answered.where(guarded), candidates, model).select(*names)
        answered = answered.where(~guarded).select("*", *none).unionByName(judged)
    else:
        answered = answered.select("*", *none)
    types = {f.name: f.dataType for f in answered.schema.fields}

    def complete(df: DataFrame) -> DataFrame:
        for name in PREDICTED:
            if name not in df.columns:
                value = F.array() if name == "citations" else F.lit(None)
                df = df.withColumn(name, value.cast(types[name]))
        return df.select(*names)

    books = complete(closed_book(rows.where(F.col("variant") == "closed_book")))
    needing = rows.where((F.col("variant") != "closed_book") & (~external | (F.col("variant") == K.CONTEXT_VARIANT)))
    errors = answering.request_errors(needing.where(~external), filings, index).unionByName(
        answering.request_errors(needing.where(external), filings, index, every=True)
    )
    failed = needing.join(errors, "question_id").select(
        "*",
        F.lit(False).alias("supported"),
        F.lit(K.INSUFFICIENT_ANSWER).alias("answer"),
        F.lit("eval_variant_error").alias("insufficient_evidence_reason"),
    )
    result = answered.unionByName(books).unionByName(complete(failed))
    if stored is None:
        return result
    asked = rows.where(external).join(errors.select("question_id"), "question_id", "left_anti")
    excerpts = context_excerpts(asked.where(F.col("variant") == K.CONTEXT_VARIANT), index)
    return result.unionByName(complete(external_predictions(asked, stored, excerpts, types["citations"])))


def context_excerpts(questions: DataFrame, index: DataFrame) -> DataFrame:
    """``question_id, excerpts``: the citations of the chunks retrieved for each question, in rank order."""
    hits = retrieval.retrieve(questions, index, answering.FILTERS)
    columns = ("section_name", "section_type", "source_url", "source_start", "source_end", "text")
    found = retrieval.fetch_hits(hits, index, columns).join(questions.select("question_id", "question"), "question_id")
    cited = best_snippets(found, "question")
    listed = F.sort_array(F.collect_list(F.struct("rank", F.struct(*answering.CITATION_FIELDS).alias("citation"))))
    return cited.groupBy("question_id").agg(listed["citation"].alias("excerpts"))


# ---- stored answers of external models ----------------------------------------------------------


def looks_like_refusal(answer: Column) -> Column:
    folded = casefold(answer)
    return (strip(folded) == "") | any_contains(folded, K.REFUSAL_MARKERS)


def external_reason(answer: Column, query_type: Column, fiscal_year: Column) -> Column:
    """Refusal reason of a free-form answer; null when it is an answer."""
    folded = casefold(answer)
    clarifies = (
        F.contains(folded, F.lit("do you mean")) & any_contains(folded, K.CLARIFICATION_WORDS)
    ) | F.contains(folded, F.lit("tell me which of the above"))
    empty = strip(answer) == ""
    return (
        F.when(empty & F.coalesce(fiscal_year > K.LAST_KNOWN_FISCAL_YEAR, F.lit(False)), F.lit("no_retrieved_evidence"))
        .when(empty, F.lit("openai_empty_answer"))
        .when(~looks_like_refusal(answer), F.lit(None).cast("string"))
        .when(clarifies, F.lit("no_metric_match"))
        .when(query_type == "unsupported", F.lit("unsupported_query_type"))
        .otherwise(F.lit("openai_insufficient_evidence"))
    )


def web_citations(sources: DataFrame) -> DataFrame:
    """Citations for web sources: first mention of each URL per question.

    ``sources``: ``question_id, position, url, title, source``.
    """
    first = sources.where(F.coalesce(F.col("url"), F.lit("")) != "").groupBy("question_id", "url").agg(
        F.min(F.struct("position", "title", "source")).alias("s")
    )
    title = F.coalesce(F.nullif(F.col("s.title"), F.lit("")), F.nullif(F.col("s.source"), F.lit("")), F.col("url"))
    return first.select(
        "question_id",
        F.col("s.position").alias("position"),
        F.concat(F.lit("web:"), F.substring(F.sha1(F.col("url").cast("binary")), 1, 12)).alias("chunk_id"),
        title.alias("section_name"),
        F.lit("web").alias("section_type"),
        F.col("url").alias("source_url"),
        title.alias("snippet"),
    )


def context_prompt(questions: DataFrame, excerpts: DataFrame | None = None, max_chars: int = K.EXCERPT_CHARS) -> DataFrame:
    """``question_id, prompt`` for an external model, with or without retrieved excerpts.

    ``excerpts``: ``question_id, rank, chunk_id, section, text`` (at most ``top_k`` per question).
    """
    def some(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0)) != 0

    period = F.when(some("fiscal_year") & some("fiscal_quarter"), F.concat(F.lit("Q"), F.col("fiscal_quarter").cast("string"), F.lit(" "), F.col("fiscal_year").cast("string"))).when(
        some("fiscal_year"), F.concat(F.lit("FY "), F.col("fiscal_year").cast("string"))
    )
    head = F.concat_ws(
        "\n",
        F.concat(F.lit("Question: "), F.col("question")),
        F.concat(F.lit("Accession number: "), F.col("accession_number")),
        F.concat(F.lit("Company: "), F.nullif(F.col("company"), F.lit(""))) if "company" in questions.columns else F.lit(None).cast("string"),
        F.concat(F.lit("Form type: "), F.nullif(F.col("form_type"), F.lit(""))),
        F.concat(F.lit("Period: "), period),
    )
    if excerpts is None:
        return questions.select("question_id", head.alias("prompt"))
    blocks = excerpts.select(
        "question_id",
        F.struct(
            "rank",
            F.concat(
                F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("chunk_id"), F.lit(" / "), F.col("section"),
                F.lit("\n"), clip(F.col("text"), max_chars), F.lit("\n"),
            ).alias("block"),
        ).alias("b"),
    ).groupBy("question_id").agg(F.sort_array(F.collect_list("b"))["block"].alias("blocks"))
    body = F.coalesce(F.array_join("blocks", "\n"), F.lit("No filing excerpts were retrieved."))
    return questions.join(blocks, "question_id", "left").select(
        "question_id", strip(F.concat(head, F.lit("\n\nFiling excerpts:\n"), body)).alias("prompt")
    )


def cache_key(variant: Column, question_id: Column, question: Column, prompt: Column, model: str) -> Column:
    """Key of a stored model answer: readable prefix and a digest of everything the answer depends on."""
    payload = F.to_json(F.struct(
        F.lit(model).alias("model"), prompt.alias("prompt"), question.alias("question"), question_id.alias("question_id"),
        variant.alias("variant"),
    ))
    return F.concat_ws("-", variant, question_id, F.substring(F.sha2(payload, 256), 1, 24))


def external_predictions(
    rows: DataFrame, stored: DataFrame, excerpts: DataFrame | None = None, citations: DataType | None = None
) -> DataFrame:
    """Predictions of external variants from stored answers (``question_id, variant, answer`` and optionally ``web``).

    A question without a stored answer becomes an error row: this engine makes no network calls. Given the type of
    ``citations``, a prediction cites its excerpts (``question_id, excerpts``) and then the web sources of its answer.
    """
    own = "base_id" if "base_id" in rows.columns else "question_id"
    web = [F.col("web").alias("_web")] if "web" in stored.columns else []
    held = stored.select(F.col("question_id").alias("_id"), "variant", F.col("answer").alias("_stored"), *web)
    joined = rows.withColumn("_id", F.col(own).cast("string")).join(held, ["_id", "variant"], "left")
    missing = F.col("_stored").isNull()
    cited = []
    if citations is not None:
        joined = joined.join(excerpts, "question_id", "left")
        fields = citations.elementType.names
        shaped = F.transform("_web", lambda w: F.struct(*[
            (w[n] if n in ("chunk_id", "section_name", "section_type", "source_url", "snippet") else F.lit(None)).alias(n) for n in fields
        ])).cast(citations)
        seen = F.transform("excerpts", lambda e: F.struct(*[(e[n] if n in answering.CITATION_FIELDS else F.lit(None)).alias(n) for n in fields])).cast(citations)
        empty = F.array().cast(citations)
        cited = [
            F.concat(F.coalesce(seen, empty), F.coalesce(shaped, empty)).alias("citations"),
            F.coalesce(F.size("excerpts"), F.lit(0)).cast("int").alias("retrieval_count"),
        ]
    return joined.select(
        *rows.columns,
        (~missing & (strip(F.col("_stored")) != "") & ~looks_like_refusal(F.col("_stored"))).alias("supported"),
        F.coalesce("_stored", F.lit("OpenAI baseline failed to produce an answer.")).alias("answer"),
        F.when(missing, F.lit("openai_eval_error"))
        .otherwise(external_reason(F.col("_stored"), classify(F.col("question")), F.col("fiscal_year")))
        .alias("insufficient_evidence_reason"),
        F.when(missing, F.lit("no stored answer")).alias("error"),
        *cited,
    )


def response_citations(output: Column) -> Column:
    """Web citations of a raw response: sources of its searches and cited pages of its messages, each page once."""
    def mentioned(item: Column) -> Column:
        cited = F.flatten(F.transform(F.coalesce(item["content"], F.array()), lambda c: F.coalesce(c["annotations"], F.array())))
        return F.when(item["type"] == "web_search_call", item["action"]["sources"]).when(
            item["type"] == "message", F.filter(cited, lambda a: a["type"] == "url_citation")
        )

    every = F.flatten(F.array_compact(F.transform(output, mentioned)))
    named = F.filter(every, lambda s: F.coalesce(s["url"], F.lit("")) != "")

    def first_mentions(sources: Column) -> Column:
        urls = F.transform(sources, lambda s: s["url"])
        return let(urls, lambda u: F.filter(sources, lambda s, i: F.array_position(u, s["url"]) == i + 1))

    def citation(source: Column) -> Column:
        title = F.coalesce(F.nullif(source["title"], F.lit("")), F.nullif(source["source"], F.lit("")), source["url"])
        return F.struct(
            F.concat(F.lit("web:"), F.substring(F.sha1(source["url"].cast("binary")), 1, 12)).alias("chunk_id"),
            title.alias("section_name"), F.lit("web").alias("section_type"), source["url"].alias("source_url"), title.alias("snippet"),
        )

    return F.transform(let(named, first_mentions), citation)


# ---- report -------------------------------------------------------------------------------------


def report_rows(metrics: DataFrame) -> DataFrame:
    """One formatted headline row per variant."""
    def cell(name: str) -> Column:
        return percent_text(F.col(name))

    return metrics.select(
        "variant",
        F.concat(
            F.lit("| "),
            F.concat_ws(
                " | ",
                F.replace(F.col("variant"), F.lit("_"), F.lit(" ")),
                cell("accuracy"), cell("numeric_accuracy"), cell("numeric_grounding_accuracy"), cell("refusal_accuracy"),
                cell("evidence_recall"), number_text(F.col("avg_latency_ms")), cell("error_rate"),
            ),
            F.lit(" |"),
        ).alias("line"),
    )


def failure_examples(scores: DataFrame, question_order: str, variant_order: str, limit: int = K.FAILURE_LIMIT) -> DataFrame:
    """The first failures, question by question, then in variant order."""
    def shown(flag: str) -> Column:
        return F.initcap(F.col(flag).cast("string"))

    clipped = clip_for_report(F.col("answer"))
    line = F.format_string(
        '- `%s` / `%s`: expected_supported=%s, predicted_supported=%s, reason=%s, answer="%s"',
        F.col("question_id"), F.col("variant"), shown("expected.supported"), shown("supported"),
        F.coalesce(F.nullif(F.col("insufficient_evidence_reason"), F.lit("")), F.lit("n/a")), clipped,
    )
    return (
        scores.where(F.col("answer_correct") != 1.0)
        .orderBy(question_order, variant_order)
        .limit(limit)
        .select(F.col(question_order), F.col(variant_order), line.alias("line"))
    )


def clip_for_report(answer: Column) -> Column:
    return clip(F.replace(squash(answer), F.lit("|"), F.lit("\\|")), K.REPORT_ANSWER_CHARS)


