"""The application surface: ingest, parse, retrieve, ask, compare, index, evaluate.

Each function works on the tables of a ``TableStore`` and on any number of filings or questions at once;
the single-item helpers below them serve the command line.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import __version__
from dossier import constants as K
from dossier.operators import answering, comparison, evaluation, parsing, retrieval, upserts
from dossier.operators import facts as FA
from dossier.session import at_driver, durable, in_request, intermediates, remove, single_request
from dossier.sources import feeds
from dossier.sources.questions import read_questions, read_stored_answers
from dossier.sources.tables import TableStore


class FilingNotFound(ValueError):
    """The requested filing is not in the store (a front end answers 404; other ``ValueError`` 422)."""


def health() -> dict[str, str]:
    return {"status": "ok", "version": __version__}


def load_number() -> int:
    """The number of a load: later loads have greater ones."""
    return time.time_ns() // 1_000_000


def ingest(
    store: TableStore,
    cache_dir: str,
    form_types: Sequence[str] = K.DEFAULT_FORMS,
    filing_limit: int = K.DEFAULT_FILING_LIMIT,
    fact_concepts: Sequence[str] | None = None,
    facts_for_ingested_filings_only: bool = False,
    use_documents: bool = True,
    ciks: Sequence[str] | None = None,
) -> dict[str, int]:
    """Load every company feed found in the cache; running it again updates instead of duplicating."""
    with intermediates(store.spark):
        return _ingest(store, cache_dir, form_types, filing_limit, fact_concepts, facts_for_ingested_filings_only, use_documents, ciks)


def _ingest(store, cache_dir, form_types, filing_limit, fact_concepts, facts_for_ingested_filings_only, use_documents, ciks) -> dict[str, int]:
    spark = store.spark
    submissions, payloads = feeds.read_submissions(spark, cache_dir), feeds.read_company_facts(spark, cache_dir)
    companies = feeds.normalize_companies(submissions)
    filings = feeds.normalize_filings(feeds.transpose_recent(submissions), form_types, filing_limit)
    facts = feeds.flatten_facts(payloads, fact_concepts, load_number())
    if ciks is not None:
        companies, filings, facts = (df.where(F.col("cik").isin(list(ciks))) for df in (companies, filings, facts))
    companies, filings = durable(companies, "companies"), durable(filings, "filings")
    if use_documents:
        key = feeds.document_key(F.col("cik"), F.col("accession_number"), F.col("primary_document"))
        paths = feeds.list_documents(spark, cache_dir).select("document_key", F.col("path").alias("raw_artifact_path"))
        filings = filings.withColumn("document_key", key).join(paths, "document_key", "left").drop("document_key")
    else:
        filings = filings.withColumn("raw_artifact_path", F.lit(None).cast("string"))
    if facts_for_ingested_filings_only:
        facts = upserts.only_for(facts, filings)

    counts: dict[str, int] = {}
    for name, rows, key, order in (
        ("companies", companies, "cik", ["loaded_at", "loaded_from"]),
        ("filings", filings, "accession_number", ["position"]),
        ("facts", facts, "source_key", ["ingest_seq"]),
    ):
        if name == "facts":  # linked to the filings stored just before
            rows = durable(upserts.link_filings(rows, linkable(store.read_for("filings", rows)), "filing_accession"), "facts")
        changed = upserts.upsert_counts(store.read_for(name, rows), rows, [key]).first()
        counts[f"{name}_created"], counts[f"{name}_updated"] = changed.created, changed.updated
        store_facts(store, rows) if name == "facts" else store.upsert(name, rows, order)
    counts["filing_documents_cached"] = filings.where("raw_artifact_path is not null").count()
    return counts


def store_facts(store: TableStore, facts: DataFrame) -> None:
    """Upsert facts, then bring the table of best facts up to date with them.

    The second step reads the facts as they are stored, since a fact keeps the place at which it was first ingested. Both
    tables are bucketed by company; a crash in between is mended by loading again. A kept table of another form is made anew.
    """
    known = keeps_best(store)
    if not known and store.manifest("best_facts") is not None:
        remove(store.spark, f"{store.root}/best_facts")
    store.upsert("facts", facts, ["ingest_seq"])
    stored = store.read_for("facts", facts) if known else store.read("facts")
    loaded = stored.join(facts.select("source_key").distinct(), "source_key", "left_semi") if known else stored
    store.update("best_facts", facts if known else stored, lambda best: FA.merge_best(best, loaded))


def keeps_best(store: TableStore) -> bool:
    """Whether the store has the table of best facts, by filing, form and period."""
    manifest = store.manifest("best_facts")
    return manifest is not None and "form_type" in [f["name"] for f in manifest["schema"]["fields"]]


def known_facts(store: TableStore, companies: DataFrame) -> DataFrame:
    """The companies' best facts; all their facts in a store that was filled before that table was kept."""
    return store.read_for("best_facts" if keeps_best(store) else "facts", companies)


def linkable(filings: DataFrame) -> DataFrame:
    return filings.select("accession_number", F.col("accession_number").alias("filing_accession"))


def accession_table(store: TableStore, accession_numbers: Sequence[str]) -> DataFrame:
    return store.spark.createDataFrame([(a,) for a in dict.fromkeys(accession_numbers)], "accession_number string")


def named_filings(store: TableStore, accession_numbers: Sequence[str] | None) -> DataFrame:
    """The named filings, or all; an unknown one is an error."""
    if accession_numbers is None:
        return store.read("filings")
    asked = accession_table(store, accession_numbers)
    filings = store.read_for("filings", asked)
    unknown = asked.join(filings, "accession_number", "left_anti").first()
    if unknown is not None:
        raise FilingNotFound(f"Filing not found for accession number: {unknown.accession_number}")
    return filings.join(asked, "accession_number", "left_semi")


def parse(
    store: TableStore,
    cache_dir: str,
    accession_numbers: Sequence[str] | None = None,
    max_tokens: int = K.DEFAULT_MAX_TOKENS,
    overlap_tokens: int = K.DEFAULT_OVERLAP_TOKENS,
) -> DataFrame:
    """Re-parse filings (all with a document by default), replacing their sections and chunks.

    A named filing without a document, and any whose document is gone, is an error before anything is replaced.
    """
    filings = named_filings(store, accession_numbers)
    bare = filings.where("raw_artifact_path is null").first() if accession_numbers is not None else None
    if bare is not None:
        raise ValueError(f"Filing has no raw artifact path: {bare.accession_number}")
    filings = filings.where("raw_artifact_path is not null")
    documents = feeds.read_documents(store.spark, cache_dir, filings.select(F.col("raw_artifact_path").alias("path")))
    documents = documents.select(F.col("path").alias("raw_artifact_path"), "content")
    read = filings.select("accession_number", "raw_artifact_path").join(documents, "raw_artifact_path")
    parsed = parsing.detect_sections(parsing.with_text(filings.join(read.drop("raw_artifact_path"), "accession_number")))
    sections = durable(parsed, "sections")
    gone = filings.join(sections.select("accession_number").distinct(), "accession_number", "left_anti").first()
    if gone is not None:
        raise FileNotFoundError(gone.raw_artifact_path)
    chunks = parsing.with_metadata(parsing.cut_chunks(sections, max_tokens, overlap_tokens))
    affected = sections.select("accession_number").distinct()
    kept = ("accession_number", "section_sequence", "section_name", "section_type", "text_hash")
    store.replace("sections", sections.select(*kept), affected)
    store.replace("chunks", retrieval.build_index(chunks, hybrid=True), affected)
    fresh = store.read_for("chunks", affected).join(affected, "accession_number", "left_semi")
    return parsing.parse_counts(sections, fresh)


def index(store: TableStore, path: str, accession_numbers: Sequence[str] | None = None, hybrid: bool = False) -> int:
    """Add the named filings (all by default) to the searchable table at ``path``; returns how many chunks were indexed.

    Filings that the table already holds are replaced, all others stay. An unknown filing, and a named one
    without chunks, is an error.
    """
    filings = named_filings(store, accession_numbers)
    if accession_numbers is None:
        rows = store.read("chunks")
    else:
        rows = store.read_for("chunks", filings).join(filings.select("accession_number"), "accession_number", "left_semi")
        empty = filings.join(rows.select("accession_number").distinct(), "accession_number", "left_anti").first()
        if empty is not None:
            raise ValueError(f"No chunks found for filing: {empty.accession_number}")
    if not hybrid:
        rows = rows.drop("sparse_vector")
    folder, _, name = path.rstrip("/").rpartition("/")
    affected = rows.select("accession_number").distinct()
    TableStore(store.spark, folder or ".", store.buckets).replace(name, rows, affected)
    return rows.count()


def searchable(store: TableStore, questions: DataFrame, index_path: str | None = None) -> DataFrame:
    """The buckets of the stored chunks, or of an index, that the questions' filings lie in."""
    if index_path is None:
        return store.read_for("chunks", questions)
    folder, _, name = index_path.rstrip("/").rpartition("/")
    return TableStore(store.spark, folder or ".", store.buckets).read_for(name, questions)


def _checked(value: int, low: int, high: int, name: str) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


QUESTION_SCHEMA = """question_id string, question string, accession_number string, top_k int, cik string, form_type string,
    fiscal_year int, fiscal_quarter int, section_type string"""


def question_table(
    store: TableStore, accession_number: str, question: str, top_k: int = K.DEFAULT_TOP_K, most: int | None = K.MAX_TOP_K, **filters: object
) -> DataFrame:
    """One question as a table; only a question that is to be answered has a greatest ``top_k``."""
    if not question or not accession_number:
        raise ValueError("question and accession number must not be empty")
    _checked(top_k, 1, most or top_k, "top_k")
    row = ("q", question, accession_number, top_k, *[filters.get(name) for name in answering.FILTERS])
    return store.spark.createDataFrame([row], QUESTION_SCHEMA)


def raise_failed(questions: DataFrame, filings: DataFrame, chunks: DataFrame, every: bool = False) -> None:
    """Raise for a question whose filing is unknown or has no chunks (refused types need none unless ``every``)."""
    failed = answering.request_errors(questions, filings, chunks, every).first()
    if failed is not None:
        raise (FilingNotFound if failed.error.startswith("Filing not found") else ValueError)(failed.error)


def retrieve(store: TableStore, questions: DataFrame, hybrid: bool = False, index_path: str | None = None) -> DataFrame:
    """The chunks most similar to each question, by dense or by fused dense and sparse vectors, under its filters."""
    filings, chunks = store.read_for("filings", questions), searchable(store, questions, index_path)
    raise_failed(questions, filings, chunks, every=True)
    if hybrid:
        hits = retrieval.retrieve_hybrid(questions, chunks, filters=answering.FILTERS)
    else:
        hits = retrieval.retrieve(questions, chunks, answering.FILTERS)
    columns = ("text", "section_name", "section_type", "source_start", "source_end", "source_url")
    return retrieval.fetch_hits(hits, chunks, columns)


def stored_candidates(store: TableStore, path: str) -> DataFrame:
    """Generated answers kept by question id: JSON lines of ``question_id, candidate_answer``."""
    return store.spark.read.schema("question_id string, candidate_answer string").json(path)


def ask(store: TableStore, questions: DataFrame, candidates: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """Answers in the envelope; raises when a question cannot be run at all.

    ``candidates`` are generated answers, which are used only where they pass the guards.
    """
    filings, chunks = store.read_for("filings", questions), store.read_for("chunks", questions)
    if in_request():
        named = questions.select("accession_number")
        filings, chunks = (at_driver(df.join(named, "accession_number", "left_semi")) for df in (filings, chunks))
    raise_failed(questions, filings, chunks)
    companies = filings.join(questions.select("accession_number"), "accession_number", "left_semi").select("cik")
    answers = answering.answer(questions, filings, chunks, known_facts(store, at_driver(companies) if in_request() else companies))
    return answering.with_answer_mode(answers, candidates, model)


def ask_one(store: TableStore, question: DataFrame, candidates: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """``ask`` for the one question of a ``question_table``, answered at once."""
    with single_request(store.spark):
        return at_driver(ask(store, question, candidates, model))


def compare(
    store: TableStore, accession_number: str, section_type: str = "risk_factors",
    previous_accession_number: str | None = None, max_claims: int = K.DEFAULT_TOP_K,
) -> DataFrame:
    """The comparison of one filing's section with an earlier filing's, made at once."""
    _checked(max_claims, 1, K.MAX_TOP_K, "max_claims")
    with single_request(store.spark):
        return at_driver(_compare(store, accession_number, section_type, previous_accession_number, max_claims))


def _compare(store: TableStore, accession_number: str, section_type: str, previous_accession_number: str | None, max_claims: int) -> DataFrame:
    current = store.read("filings", accession_number=accession_number).first()
    if current is None:
        raise FilingNotFound(f"Filing not found: {accession_number}")
    request = store.spark.createDataFrame(
        [("c", accession_number, section_type, previous_accession_number, max_claims)],
        "pair_id string, accession_number string, section_type string, prior_accession_number string, max_claims int",
    )
    # The company's filings name the prior one; only the buckets of these filings are read further.
    filings = durable(store.read("filings", cik=current.cik), "company-filings")
    if previous_accession_number and filings.where(F.col("accession_number") == previous_accession_number).first() is None:
        filings = durable(filings.unionByName(store.read("filings", accession_number=previous_accession_number)), "company-filings")
    prior = comparison.previous_filing(filings).where(F.col("accession_number") == accession_number).first()
    both = [accession_number, previous_accession_number or (prior.previous_accession_number if prior else None)]
    keys = accession_table(store, [a for a in both if a])
    sections, chunks = (
        at_driver(store.read_for(name, keys).join(keys, "accession_number", "left_semi")) for name in ("sections", "chunks")
    )
    return comparison.compare(request, filings, sections, chunks)


def variant_note(variant: tuple[str, bool, bool, bool]) -> str:
    """A line of the report that states what a variant uses."""
    name, *used = variant
    parts = ("filters of the question", "structured facts", "stored answers")
    return f"- `{name}`: {', '.join(part for part, on in zip(parts, used) if on) or 'none of filters, facts and stored answers'}."


def evaluate(
    store: TableStore, dataset: str, variants: Sequence[str] = K.DEFAULT_VARIANTS, stored_answers: str | None = None,
    model: str = K.DEFAULT_MODEL,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Scores, metrics and the report lines of a benchmark run.

    Variants that need a model take its answers from ``stored_answers``, the folder of answer files; a question without
    one is an error row of an external variant, and unavailable to the guarded one. Every variant runs by itself and
    its latency is its own wall clock divided by its predictions: a variant's questions are answered as a batch.
    """
    questions = read_questions(store.spark, dataset)
    table = evaluation.variant_table(store.spark, variants)
    answers = read_stored_answers(store.spark, stored_answers)
    filings, chunks = store.read_for("filings", questions), store.read_for("chunks", questions)
    companies = filings.join(questions.select("accession_number"), "accession_number", "left_semi").select("cik")
    facts = known_facts(store, companies)
    scored = []
    for variant in dict.fromkeys(variants):
        started = time.perf_counter()
        one = table.where(F.col("variant") == variant)
        predictions = durable(evaluation.predict(questions, one, filings, chunks, facts, answers, model), "predictions")
        per_row = (time.perf_counter() - started) * 1000.0 / max(predictions.count(), 1)
        scored.append(evaluation.score(predictions.withColumn("latency_ms", F.lit(per_row))))
    scores = durable(reduce(DataFrame.unionByName, scored), "scores")
    metrics = evaluation.aggregate(scores)
    shown = {row.variant: row.line for row in evaluation.report_rows(metrics).collect()}
    failures = [row.line for row in evaluation.failure_examples(scores, "question_order", "variant_rank").collect()]
    lines = [
        K.REPORT_TITLE, "", f"Dataset: `{dataset}`", f"Questions: {questions.count()}", "", *K.REPORT_HEADINGS[:1], "",
        *K.REPORT_TABLE, *[shown[v] for v in variants if v in shown], "", *K.REPORT_HEADINGS[1:2], "", *map(variant_note, K.VARIANTS), "",
        *K.REPORT_HEADINGS[2:], "", *(failures or ["No failing examples in this run."]), "",
    ]
    return scores, metrics, lines


def result_rows(scores: DataFrame) -> Iterator[dict]:
    """Every question's prediction and scores under every variant, one after another."""
    rows = scores.orderBy("question_order", "variant_rank").drop("question_order", "variant_rank")
    for row in rows.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
        yield json.loads(row.line)
