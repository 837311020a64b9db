"""Explicit schemas of the source feeds and of the stored tables; nothing is inferred."""

from __future__ import annotations

# Company submissions: a few scalars and a "columnar" object of parallel arrays.
SUBMISSIONS = """
    cik string, name string, entityName string, tickers array<string>, exchanges array<string>, sic string,
    fiscalYearEnd string,
    filings struct<recent: struct<
        accessionNumber: array<string>, form: array<string>, filingDate: array<string>, reportDate: array<string>,
        primaryDocument: array<string>, fy: array<string>, fp: array<string>>>
"""

# Company facts: taxonomy -> concept -> unit -> list of reported values.
COMPANY_FACTS = """
    cik string, entityName string,
    facts map<string, map<string, struct<label: string, units: map<string, array<struct<
        val: string, accn: string, fy: string, fp: string, form: string, filed: string, frame: string>>>>>>
"""

EXPECTED = """struct<
    supported: boolean, answer_keywords: array<string>, citation_chunk_ids: array<string>,
    section_types: array<string>, xbrl_concepts: array<string>, numeric_value: string, numeric_unit: string,
    insufficient_reason: string>"""

QUESTION = f"""
    id string, question string, accession_number string, question_type string, top_k int, cik string,
    form_type string, fiscal_year int, fiscal_quarter int, section_type string, expected {EXPECTED},
    metadata map<string, string>
"""

# A stored model answer: either the extracted answer with its web citations, or the raw response itself.
SOURCES = "array<struct<type: string, url: string, title: string, source: string>>"
STORED_ANSWER = f"""
    answer string, web_citations array<struct<chunk_id: string, section_name: string, section_type: string, source_url: string, snippet: string>>,
    output_text string,
    output array<struct<type: string, action: struct<sources: {SOURCES}>,
        content: array<struct<type: string, text: string, annotations: {SOURCES}>>>>
"""

COMPANIES = "cik string, ticker string, name string, exchange string, sic string, fiscal_year_end string"
FILINGS = """
    accession_number string, cik string, form_type string, filing_date date, report_date date, fiscal_year int,
    fiscal_quarter int, source_url string, raw_artifact_path string
"""
FACTS = """
    source_key string, cik string, accession_number string, concept string, label string, unit string,
    value decimal(38,6), fiscal_period string, fiscal_year int, fiscal_quarter int, form_type string,
    filed_date date, frame string, ingest_seq array<bigint>, filing_accession string
"""
# The newest fact per company, concept, filing, form and period; kept up to date by every load of facts.
BEST_FACTS = """
    cik string, concept string, form_type string, accession_number string, fiscal_year int, fiscal_quarter int, fiscal_period string,
    lookup_key string, newest struct<filed: date, seq: array<bigint>, source: string>,
    fact struct<label: string, unit: string, value: decimal(38,6)>
"""
