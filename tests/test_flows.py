"""Feeds through answers and comparisons on a small store, driven like a user would."""

import json

import pytest
from pyspark.sql import functions as F

from dossier.cli import build_parser, run
from dossier.operators import answering, evaluation, snippets, upserts
from dossier.plans import service
from dossier.sources.questions import parse_questions, read_questions
from dossier.sources import tables
from dossier.sources.tables import TableStore, ordered
from dossier.streaming.ingest import stream_counts, stream_facts

RISKS = {"24": "Competition is intense in all markets. Supply chains may fail us. New rules could raise costs.", "23": "Competition is intense in all markets. Currency moves may hurt us."}


def filing_html(year, sales):
    return (
        f"<html><body><h1>Annual report</h1><p>Item 1. Business</p><p>We design and market phones and computers.</p><p>Item 1A. Risk Factors</p><p>{RISKS[year]}</p>"
        f"<p>Item 7. Management's Discussion and Analysis of Results</p><p>Total net sales were $ {sales} in millions for the year.</p></body></html>"
    )


@pytest.fixture(scope="module")
def cache(tmp_path_factory):
    root = tmp_path_factory.mktemp("cache")
    submissions = {
        "cik": 77, "name": "Acme Inc.", "tickers": ["", "ACM"], "exchanges": ["NYSE"], "sic": "1", "fiscalYearEnd": "0930",
        "filings": {"recent": {
            "accessionNumber": ["0000000077-24-000001", "0000000077-24-000002", "0000000077-23-000001"], "form": ["10-K", "8-K", "10-K"],
            "filingDate": ["2024-11-01", "2024-10-01", "2023-11-01"], "reportDate": ["2024-09-28", "2024-09-30", "2023-09-30"],
            "primaryDocument": ["k24.htm", "x.htm", "k23.htm"],
        }},
    }
    def fact(value, year):
        return {"val": value, "fy": year, "fp": "FY", "form": "10-K", "filed": f"{year}-11-01", "accn": f"0000000077-{year % 100}-000001"}

    facts = {"cik": 77, "entityName": "Acme", "facts": {"us-gaap": {
        "Revenues": {"label": "Revenues", "units": {"USD": [fact(391035000000, 2024), fact(383285000000, 2023), {"val": "oops"}]}},
        "OperatingExpenses": {"label": None, "units": {"USD": [fact(1000000, 2024)]}},
    }}}
    for folder, payload in (("submissions", submissions), ("companyfacts", facts)):
        (root / folder).mkdir()
        (root / folder / "CIK0000000077.json").write_text(json.dumps(payload))
    for year, sales in (("24", "391,035"), ("23", "999,999")):
        folder = root / "filings" / "0000000077" / f"00000000772{year[1]}000001"
        folder.mkdir(parents=True)
        (folder / f"k{year}.htm").write_text(filing_html(year, sales))
    return str(root)


@pytest.fixture(scope="module")
def store(spark, cache, tmp_path_factory):
    store = TableStore(spark, str(tmp_path_factory.mktemp("store")))
    first = service.ingest(store, cache)
    again = service.ingest(store, cache)
    assert first == {"companies_created": 1, "companies_updated": 0, "filings_created": 2, "filings_updated": 0, "facts_created": 3, "facts_updated": 0, "filing_documents_cached": 2}
    assert (again["filings_created"], again["filings_updated"], again["facts_created"], again["facts_updated"]) == (0, 2, 0, 3)
    counts = service.parse(store, cache, max_tokens=12, overlap_tokens=2).collect()
    assert {r.sections_created for r in counts} == {3}
    return store


def test_ingested_rows(store):
    assert store.read("companies").first().ticker == "ACM"
    newest = ordered(store.read("filings"), "filings").first()
    assert (newest.fiscal_year, newest.fiscal_quarter) == (2024, None)
    assert newest.source_url.endswith("/77/000000007724000001/k24.htm")
    assert store.read("facts").count() == 3


def test_parsing_again_replaces(store, cache):
    before = store.read("chunks").count()
    service.parse(store, cache, ["0000000077-24-000001"], 12, 2)
    assert store.read("chunks").count() == before


A24, A23 = "0000000077-24-000001", "0000000077-23-000001"


def ask_all(store, asked, candidates=None):
    """Answers by id for ``{id: (question, accession, section type)}``, in one job."""
    rows = [(i, text, accession, 5, None, None, None, None, section) for i, (text, accession, section) in asked.items()]
    questions = store.spark.createDataFrame(rows, service.QUESTION_SCHEMA)
    if candidates is not None:
        candidates = store.spark.createDataFrame(list(candidates.items()), "question_id string, candidate_answer string")
    return {r.question_id: r for r in service.ask(store, questions, candidates, "m").collect()}


def test_answers_are_grounded_cited_or_refused(store):
    got = ask_all(store, {
        "good": ("How much revenue was reported in 2024?", A24, None),
        "bad": ("How much revenue were net sales in millions for the year?", A23, None),
        "missing": ("How much was spent on dividends?", A24, None),
        "vague": ("What is the total number?", A24, None),
        "text": ("Which phones and computers does it design?", A24, None),
        "advice": ("Should I buy it?", "no-such-filing", None),
        "section": ("Describe supply risk", A24, "risk_factors"),
    })
    good = got["good"]
    assert good.supported and good.confidence == 1.0 and good.numeric_grounding.status == "validated"
    assert good.answer == "The structured SEC fact for revenue is 391,035,000,000 USD for FY 2024 (XBRL concept: Revenues)."
    assert (got["bad"].supported, got["bad"].insufficient_evidence_reason) == (False, "numeric_fact_mismatch")
    assert got["missing"].insufficient_evidence_reason == "fact_not_found"
    assert got["vague"].insufficient_evidence_reason == "no_metric_match"
    text = got["text"]
    assert text.supported and "phones" in text.answer and text.citations[0].section_type == "business" and 0 < text.confidence <= 1
    assert (got["advice"].query_type, got["advice"].retrieval_count) == ("unsupported", 0)
    assert {c.section_type for c in got["section"].citations} == {"risk_factors"}


def test_requests_that_cannot_run_are_errors(store):
    with pytest.raises(service.FilingNotFound):
        ask_all(store, {"x": ("Describe risks", "no-such-filing", None)})
    with pytest.raises(ValueError):
        service.question_table(store, "a", "b", 21)


def test_generated_answers_are_guarded(store):
    expected = {
        "Revenue was 391,035,000,000 USD in FY 2024.": ("llm", "succeeded", None),
        "Revenue was 391,035,000,001 USD in FY 2024.": ("extractive", "fallback", "numeric_value_changed_or_omitted"),
        "Revenue was 391,035,000,000 in FY 2024.": ("extractive", "fallback", "numeric_unit_changed_or_omitted"),
        "Revenue was $391,035,000,000 in FY 2023.": ("extractive", "fallback", "numeric_period_changed_or_omitted"),
        "You should buy: $391,035,000,000 in FY 2024.": ("extractive", "fallback", "investment_advice_language"),
        "$391,035,000,000 in FY 2024, https://evil.example/x.": ("extractive", "fallback", "unknown_citation_reference"),
        "  ": ("extractive", "fallback", "empty_llm_answer"),
        None: ("extractive", "unavailable", "missing_openai_api_key"),
    }
    texts = {f"q{i}": text for i, text in enumerate(expected)}
    got = ask_all(store, {i: ("How much revenue was reported in 2024?", A24, None) for i in texts}, texts)
    assert {texts[i]: (r.answer_mode, r.synthesis_status, r.synthesis_reason) for i, r in got.items()} == expected


def test_comparison(store):
    row = service.compare(store, "0000000077-24-000001").first()
    assert row.supported and row.prior_accession_number == "0000000077-23-000001"
    added = {c.snippet for c in row.added_claims}
    assert any("Supply chains" in a for a in added) and not any(a.startswith("Competition is intense in all markets.") for a in added)
    assert {c.filing_role for c in row.citations} == {"current", "prior"}
    assert service.compare(store, "0000000077-23-000001").first().insufficient_evidence_reason == "previous_filing_missing"
    assert service.compare(store, "0000000077-24-000001", "controls").first().insufficient_evidence_reason == "current_section_missing"
    with pytest.raises(service.FilingNotFound):
        service.compare(store, "zzz")


def test_evaluation_run(store, tmp_path):
    lines = [
        {"id": "n", "question": "How much revenue in 2024?", "accession_number": "0000000077-24-000001", "question_type": "numeric",
         "expected": {"xbrl_concepts": ["Revenues"], "numeric_value": "391,035,000,000", "numeric_unit": "USD"}},
        {"id": "r", "question": "Should I sell?", "accession_number": "0000000077-24-000001", "expected": {"supported": False, "insufficient_reason": "unsupported_query_type"}},
        {"id": "e", "question": "Describe things", "accession_number": "missing", "expected": {"answer_keywords": ["x"]}},
    ]
    path = tmp_path / "q.jsonl"
    path.write_text("# comment\n\n" + "\n".join(json.dumps(line) for line in lines))
    scores, metrics, report = service.evaluate(store, str(path))
    by = {(r.question_id.split("|")[0], r.variant): r for r in scores.collect()}
    assert by["n", "improved_rag_xbrl"].answer_correct == 1.0 and by["n", "closed_book"].answer_correct == 0.0
    assert by["r", "closed_book"].refusal_match == 1.0
    assert by["e", "naive_rag"].insufficient_evidence_reason == "eval_variant_error" and by["e", "naive_rag"].error == 1.0
    best = {r.variant: r for r in metrics.collect()}["improved_rag_xbrl"]
    assert best.numeric_grounding_accuracy == 1.0 and abs(best.error_rate - 1 / 3) < 1e-9
    assert any(line.startswith("| improved rag xbrl | 66.7%") for line in report)
    latency = {r.variant: r.avg_latency_ms for r in metrics.collect()}
    assert min(latency.values()) > 0 and len(set(latency.values())) == len(latency)  # each variant has its own clock
    (tmp_path / "empty.jsonl").write_text("# nothing\n")
    with pytest.raises(ValueError):
        read_questions(store.spark, str(tmp_path / "empty.jsonl"))


def test_question_lines_are_validated(spark):
    df = spark.createDataFrame([('{"id": "x"}',)], "value string")
    with pytest.raises(Exception, match="Invalid eval question"):
        parse_questions(df).collect()


def test_command_line(store, cache):
    def call(*argv):
        return list(run(build_parser().parse_args(["--store", store.root, "--cache", cache, *argv]), store))

    assert call("health")[0]["status"] == "ok"
    hits = call("retrieve-sec-filing", "0000000077-24-000001", "supply chains", "--top-k", "2")
    assert len(hits) == 2 and {"chunk_id", "score", "text"} <= hits[0].keys()
    assert call("ask-sec-filing", "0000000077-24-000001", "How much revenue?")[0]["supported"]
    assert call("compare-sec-filing", "0000000077-24-000001", "--max-claims", "1")[0]["supported"]
    assert call("index-sec-filing", "--path", store.root + "/searchable", "--hybrid")[0]["indexed"] == store.read("chunks").count()
    assert len(call("parse-sec-filing", "--max-tokens", "12", "--overlap-tokens", "2")) == 2
    with pytest.raises(Exception, match="one to ten digits"):
        call("ingest-sec-company", "no number")


def test_stream_of_feeds_is_idempotent(spark, cache, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    for checkpoint in ("one", "two"):
        stream_facts(store, cache + "/companyfacts", str(tmp_path / checkpoint)).awaitTermination()
        assert store.read("facts").count() == 3


def test_stream_drops_what_comes_again(spark, tmp_path):
    def payload(value, filed):
        reported = {"val": value, "accn": "a", "fy": "2024", "fp": "FY", "form": "10-K", "filed": filed}
        return {"cik": "5", "facts": {"us-gaap": {"Assets": {"label": "Assets", "units": {"USD": [reported]}}}}}

    store, feed, checkpoint = TableStore(spark, str(tmp_path / "store")), tmp_path / "feed", str(tmp_path / "state")
    feed.mkdir()
    deliveries = [[payload("2", "2024-03-01")], [payload("1", "2024-02-01"), payload("2", "2024-03-01")], [payload("2", "2024-03-01")]]
    dropped = 0
    for n, files in enumerate(deliveries):
        for i, body in enumerate(files):
            (feed / f"f{n}-{i}.json").write_text(json.dumps(body))
        query = stream_facts(store, str(feed), checkpoint)
        query.awaitTermination()
        for progress in query.recentProgress:
            dropped += sum(op.customMetrics.get("numDroppedDuplicateRows", 0) for op in progress.stateOperators)
    assert dropped == 2
    assert [tuple(r)[1:] for r in stream_counts(store, checkpoint).orderBy("batch_id").collect()] == [(1, 1, 0), (1, 1, 0)]
    assert sorted(int(r.value) for r in store.read("facts").collect()) == [1, 2]
    # The older fact came later and is not the best one.
    assert {int(r.fact.value) for r in store.read("best_facts").where("lookup_key not like '1%'").collect()} == {2}


def test_every_question_is_answered_or_an_error(store):
    schema = service.QUESTION_SCHEMA
    asked = store.spark.createDataFrame(
        [(i, q, a, k, None, None, None, None, None) for i, q, a, k in (
            ("fine", "How much revenue?", A24, 3), ("null", None, A24, 3), ("blank", "  ", A24, 3), ("nowhere", "How much revenue?", None, 3),
            ("none", "How much revenue?", A24, 0), ("open", "How much revenue?", A24, None), ("unknown", "How much revenue?", "missing", 3),
            ("digits", "Is revenue $" + "9" * 80 + " or 1e999 million?", A24, 3), ("refused", "Should I sell?", "missing", 3),
        )], schema,
    )
    filings, chunks, facts = (store.read(name) for name in ("filings", "chunks", "facts"))
    answers = {r.question_id for r in answering.answer(asked, filings, chunks, facts).collect()}
    errors = {r.question_id: r.error for r in answering.request_errors(asked, filings, chunks).collect()}
    assert answers == {"fine", "digits", "refused"} and errors.keys() == {"null", "blank", "nowhere", "none", "open", "unknown"}
    assert errors["unknown"] == "Filing not found: missing" and errors["null"] == "question must not be empty"


def test_upsert_overwrites_with_nulls_and_counts_repeats(spark):
    stored = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    incoming = spark.createDataFrame([("b", None, 1), ("c", 5, 1), ("c", 6, 2)], "k string, v int, n int")
    got = {r.k: r.v for r in upserts.upsert(stored, incoming, ["k"], ["n"]).collect()}
    assert got == {"a": 1, "b": None, "c": 6}
    assert tuple(upserts.upsert_counts(stored, incoming, ["k"]).first()) == (1, 2)


def test_snippets_prefer_labelled_values(spark):
    table = "Acme | 2025 Form 10-K | 22\n\nThe table shows sales (in millions):\n\n2025\nChange\nServices\n$\n109,158\n14\n%\nTotal net sales\n$\n416,161\n6\n%\n"
    asked = [("q", "c", table, "How much revenue was reported in 2025? revenue net sales 416,161,000,000")]
    row = snippets.best_snippets(spark.createDataFrame(asked, "question_id string, chunk_id string, text string, query string")).first()
    assert row.snippet.startswith("Total net sales") and "416,161" in row.snippet


def test_score_ladder(spark):
    out = spark.range(1).select(
        evaluation.recall(F.array(F.lit("a"), F.lit("a"), F.lit("b")), F.array(F.lit("a"))).alias("recall"),
        evaluation.keyword_match(F.array(F.lit("Straße"), F.lit("no")), F.lit("STRASSE")).alias("keywords"),
        answering.confidence(F.array(F.lit(0.4), F.lit(1.7))).alias("confidence"),
    ).first()
    assert abs(out.recall - 2 / 3) < 1e-9 and out.keywords == 0.5 and out.confidence == 1.0


def test_index_keeps_other_filings(store):
    path = store.root + "/added"
    chunks = {r.accession_number: r["count"] for r in store.read("chunks").groupBy("accession_number").count().collect()}
    assert service.index(store, path, [A24]) == chunks[A24]
    assert service.index(store, path, [A23], hybrid=True) == chunks[A23]
    assert service.index(store, path, [A23]) == chunks[A23]
    held = TableStore(store.spark, store.root).read("added")
    assert {r.accession_number: r["count"] for r in held.groupBy("accession_number").count().collect()} == chunks
    with pytest.raises(service.FilingNotFound):
        service.index(store, path, [A24, "unknown"])
    assert TableStore(store.spark, store.root).read("added").count() == sum(chunks.values())
    question = service.question_table(store, A24, "supply chains", 3)
    found = [service.retrieve(store, question, index_path=p).select("chunk_id", "score").collect() for p in (None, path)]
    assert sorted(found[0]) == sorted(found[1]) and len(found[0]) == 3


def test_buckets_with_and_without_sparse_vectors(spark, tmp_path):
    dense = spark.createDataFrame([(f"f{i}", f"f{i}-c", 1) for i in range(40)], "accession_number string, chunk_id string, token_count int")
    sparse = dense.withColumn("sparse_vector", F.array(F.lit(1.5)))
    where = {r.accession_number: r.bucket for r in dense.select("accession_number", tables._bucket(F.col("accession_number"), 4).alias("bucket")).collect()}
    for bucket in range(4):
        # Only one bucket is rewritten with the column; whichever file gives the schema, it is read and kept.
        fresh = TableStore(spark, str(tmp_path / str(bucket)), buckets=4)
        fresh.replace("index", dense, dense.select("accession_number"))
        first, second, *_ = sorted(k for k, b in where.items() if b == bucket)
        some = sparse.where(F.col("accession_number") == first)
        fresh.replace("index", some, some.select("accession_number"))
        some = dense.where(F.col("accession_number") == second)
        fresh.replace("index", some, some.select("accession_number"))
        held = {r.accession_number: r.sparse_vector for r in fresh.read("index").collect()}
        assert held == {k: [1.5] if k == first else None for k in where}


def test_retrieval_has_no_greatest_number(store):
    chunks = store.read("chunks", accession_number=A24).count()
    question = service.question_table(store, A24, "supply chains", 50, None)
    assert service.retrieve(store, question).count() == chunks
    hybrid = service.retrieve(store, service.question_table(store, A24, "supply chains", 50, None, section_type="risk_factors"), hybrid=True)
    assert {r.section_type for r in hybrid.collect()} == {"risk_factors"}
    with pytest.raises(service.FilingNotFound):
        service.retrieve(store, service.question_table(store, "unknown", "x"))


def test_filings_that_cannot_be_parsed_are_errors(spark, cache, tmp_path):
    import os

    own = TableStore(spark, str(tmp_path / "store"), buckets=4)
    service.ingest(own, cache, use_documents=False)
    with pytest.raises(service.FilingNotFound):
        service.parse(own, cache, ["unknown"])
    with pytest.raises(ValueError, match="no raw artifact path"):
        service.parse(own, cache, [A24])
    service.ingest(own, cache)
    gone = own.read("filings", accession_number=A23).first().raw_artifact_path.removeprefix("file:")
    os.rename(gone, gone + ".away")
    try:
        with pytest.raises(FileNotFoundError):
            service.parse(own, cache, [A23])
        assert service.parse(own, cache, [A24]).count() == 1
    finally:
        os.rename(gone + ".away", gone)


def test_facts_keep_their_first_place_and_know_their_filing(spark, cache, tmp_path):
    own = TableStore(spark, str(tmp_path / "store"), buckets=4)
    service.ingest(own, cache)
    first = {r.source_key: r.ingest_seq for r in own.read("facts").collect()}
    service.ingest(own, cache)
    assert {r.source_key: r.ingest_seq for r in own.read("facts").collect()} == first
    assert {r.filing_accession for r in own.read("facts").collect()} == {A24, A23}


def test_all_rows_of_many_filings_are_shown(spark, tmp_path):
    cache, n = tmp_path / "cache", 25
    accessions = [f"0000000088-24-{i:06d}" for i in range(n)]
    (cache / "submissions").mkdir(parents=True)
    (cache / "companyfacts").mkdir()
    recent = {"accessionNumber": accessions, "form": ["10-K"] * n, "filingDate": ["2024-11-01"] * n, "reportDate": ["2024-09-28"] * n, "primaryDocument": ["d.htm"] * n}
    (cache / "submissions" / "CIK0000000088.json").write_text(json.dumps({"cik": 88, "name": "Many", "filings": {"recent": recent}}))
    (cache / "companyfacts" / "CIK0000000088.json").write_text(json.dumps({"cik": 88, "facts": {}}))
    for a in accessions:
        folder = cache / "filings" / "0000000088" / a.replace("-", "")
        folder.mkdir(parents=True)
        (folder / "d.htm").write_text(filing_html("24", "1"))
    store = TableStore(spark, str(tmp_path / "store"), buckets=2)
    service.ingest(store, str(cache), filing_limit=n)
    shown = list(run(build_parser().parse_args(["--store", store.root, "--cache", str(cache), "parse-sec-filing"]), store))
    assert sorted(r["accession_number"] for r in shown) == accessions


def test_variants_with_stored_answers(store, tmp_path):
    folder = tmp_path / "answers"
    folder.mkdir()
    web = {"type": "web_search_call", "action": {"sources": [{"url": "https://a.example/1", "title": "One"}, {"url": "https://a.example/1"}]}}
    said = {"type": "message", "content": [{"type": "output_text", "text": " Revenue was 391,035,000,000 USD. ", "annotations": [
        {"type": "url_citation", "url": "https://b.example/2"}, {"type": "file", "url": "https://no.example"}]}]}
    files = {
        "openai_closed_book-n-0123456789abcdef01234567": {"answer": "I cannot answer this."},
        "openai_retrieved_context-n-0123456789abcdef01234567": {"answer": "Revenue was 391,035,000,000 USD in FY 2024."},
        "openai_web_search-n-0123456789abcdef01234567": {"output": [web, said]},
        "improved_rag_xbrl_llm-n-0123456789abcdef01234567": {"answer": "Revenue was 391,035,000,000 USD in FY 2024."},
        "improved_rag_xbrl_llm-m-0123456789abcdef01234567": {"answer": "Revenue was 1 USD in FY 2024."},
    }
    for name, content in files.items():
        (folder / f"{name}.json").write_text(json.dumps(content))
    expected = {"xbrl_concepts": ["Revenues"], "numeric_value": "391,035,000,000", "numeric_unit": "USD"}
    lines = [{"id": i, "question": "How much revenue in 2024?", "accession_number": a, "expected": expected} for i, a in (("n", A24), ("m", A24), ("x", "unknown"))]
    (tmp_path / "q.jsonl").write_text("\n".join(map(json.dumps, lines)))
    variants = ["improved_rag_xbrl_llm", "openai_closed_book", "openai_retrieved_context", "openai_web_search"]
    args = build_parser().parse_args(["--store", store.root, "run-eval", "--dataset", str(tmp_path / "q.jsonl"), "--stored-answers", str(folder),
                                      "--report", str(tmp_path / "report"), *[x for v in variants for x in ("--variant", v)]])
    metrics = run(args, store)
    assert {m["variant"] for m in metrics} == set(variants)
    results = {tuple(r["question_id"].split("|")): r for r in json.loads((tmp_path / "report.json").read_text())["results"]}
    assert len(results) == 12
    guarded = results["n", "improved_rag_xbrl_llm"]
    assert (guarded["answer_mode"], guarded["synthesis_status"], guarded["answer"]) == ("llm", "succeeded", "Revenue was 391,035,000,000 USD in FY 2024.")
    assert results["m", "improved_rag_xbrl_llm"]["synthesis_reason"] == "numeric_value_changed_or_omitted"
    context = results["n", "openai_retrieved_context"]
    assert context["supported"] and context["retrieval_count"] == len(context["citations"]) > 0 and context["numeric_match"] == 1.0
    found = results["n", "openai_web_search"]
    assert [c["source_url"] for c in found["citations"]] == ["https://a.example/1", "https://b.example/2"] and found["citations"][0]["section_name"] == "One"
    assert found["answer"] == "Revenue was 391,035,000,000 USD." and found["answer_correct"] == 1.0
    assert not results["n", "openai_closed_book"]["supported"]
    assert results["m", "openai_web_search"]["insufficient_evidence_reason"] == "openai_eval_error"
    assert results["x", "openai_retrieved_context"]["insufficient_evidence_reason"] == "eval_variant_error"
    report = (tmp_path / "report.md").read_text()
    assert "## Ablation Notes" in report and "## Failure Examples" in report


def test_comparison_cuts_each_compared_section_once(spark):
    from pyspark.sql import functions as F

    from dossier.operators import comparison

    cut = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def pieces(text):
        cut.add(1)
        return [text] if text.strip() else []

    filings = spark.createDataFrame(
        [(f"a{day}", "1", "10-K", f"2020-01-0{day}", "u") for day in (1, 2, 3)], "accession_number string, cik string, form_type string, filing_date string, source_url string"
    )
    texts = {
        ("a1", 1, "business"): "The first claim stands here.\nIt is of the first filing.", ("a1", 2, "mda"): "Nothing that is compared.", ("a1", 3, "controls"): " ",
        ("a2", 1, "business"): "The first claim stands here.\nIt is of the second filing.", ("a2", 2, "mda"): "Nothing that is compared.", ("a2", 3, "controls"): "Some controls are described.",
        ("a3", 1, "business"): "tiny", ("a3", 2, "legal_proceedings"): "No such section before.",
    }
    sections = spark.createDataFrame([(*key, key[2], text, 0) for key, text in texts.items()], (
        "accession_number string, section_sequence int, section_type string, section_name string, section_text string, start_offset int"
    ))
    chunks = sections.select("accession_number", "section_sequence", F.explode(pieces("section_text")).alias("text")).select(
        "*", F.concat_ws(":", "accession_number", "section_sequence").alias("chunk_id"), F.lit(0).alias("source_start"), F.length("text").alias("source_end")
    )
    asked = [(1, "a2", "business"), (2, "a2", "controls"), (3, "a3", "legal_proceedings"), (4, "a3", "business"), (5, "a1", "mda"), (6, "a2", "risk_factors")]
    requests = spark.createDataFrame([(*r, None, 3) for r in asked], "pair_id long, accession_number string, section_type string, prior_accession_number string, max_claims int")
    found = {r.pair_id: r for r in comparison.compare(requests, filings, sections, chunks).collect()}
    assert cut.value <= len(texts)  # once for both questions: which sections have chunks, and what these claim
    assert [c.snippet for c in found[1].added_claims] == ["It is of the second filing."]
    assert [c.snippet for c in found[1].removed_claims] == ["It is of the first filing."]
    assert found[1].unchanged_claim_count == 1
    assert {k: r.insufficient_evidence_reason for k, r in found.items()} == {
        1: None, 2: "section_chunks_missing", 3: "prior_section_missing", 4: "section_chunks_missing", 5: "previous_filing_missing", 6: "current_section_missing",
    }
    # A section whose chunks hold no claim has chunks all the same.
    pairs, claims = comparison.resolve_pairs(requests, filings, sections, chunks)
    assert {r.pair_id: r.reason for r in pairs.collect()}[4] is None
    assert claims.where("accession_number = 'a3'").count() == 0


def test_stripping_takes_every_kind_of_white_space(spark):
    from pyspark.sql import functions as F

    from dossier.functions import text as T

    space = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    assert sorted(T.SPACES) == space
    inner = "a" + "".join(space) + "b\u200b"
    df = spark.createDataFrame([("".join(space) + inner + "".join(space),), ("".join(space),), ("",), (None,)], "v string")
    rows = [tuple(r) for r in df.select(T.strip(F.col("v")), T.rstrip(F.col("v"))).collect()]
    assert rows == [(inner, "".join(space) + inner), ("", ""), ("", ""), (None, None)]


def test_variants_share_snippets_and_read_only_named_filings(spark, monkeypatch):
    from dossier.operators import parsing, retrieval
    from dossier.schemas import FACTS

    sections = [(f"a-{i}", 1, 0, "risk_factors", "Risk", f"u{i}", f"Risks of unit {i} are many and its products are few. Net sales were $ 1,{i}00 in total.") for i in range(4)]
    df = spark.createDataFrame(sections, "accession_number string, section_sequence int, start_offset int, section_type string, section_name string, source_url string, section_text string")
    filings = spark.createDataFrame([(f"a-{i}", f"c{i}", "10-K", 2020, None) for i in range(9)], "accession_number string, cik string, form_type string, fiscal_year int, fiscal_quarter int")
    index = retrieval.build_index(parsing.cut_chunks(df.join(filings, "accession_number"), 64, 8))
    asked = [("q0", "Describe the products of the unit", "a-0"), ("q1", "Which risks are many?", "a-1"), ("q2", "Describe the products of the unit", "a-0"), ("q3", "Which risks?", "a-7"), ("q4", "Which risks?", "b")]
    fields = "question_id string, question string, accession_number string, top_k int, cik string, form_type string, fiscal_year int, fiscal_quarter int, section_type string"
    questions = spark.createDataFrame([(*q, 3, None, "10-K", None, None, None) for q in asked], fields)
    seen = {}
    choose, errors = answering.best_snippets, answering.request_errors

    def counted(hits, *rest):
        seen["chosen"] = hits.select("accession_number", "chunk_id", "query").count()
        return choose(hits, *rest)

    def read(rows, filings, *rest, **named):
        seen["filings"] = filings.count()
        return errors(rows, filings, *rest, **named)

    monkeypatch.setattr(answering, "best_snippets", counted)
    monkeypatch.setattr(answering, "request_errors", read)
    found = evaluation.predict(questions, evaluation.variant_table(spark), filings, index, spark.createDataFrame([], FACTS))
    rows = {(r.base_id, r.variant): r for r in found.collect()}
    assert seen == {"chosen": 2, "filings": 3} and len(rows) == found.count() == 20
    assert rows["q0", "naive_rag"].citations == rows["q2", "improved_rag_xbrl"].citations and "products are few" in rows["q0", "naive_rag"].citations[0].snippet
    assert rows["q3", "naive_rag"].error == "No chunks found for filing: a-7" and rows["q4", "improved_rag"].error == "Filing not found: b"
