"""Command line: ``python -m dossier.cli --store DIR --cache DIR <command> ...``."""

from __future__ import annotations

import argparse
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.coerce import normalize_cik, require
from dossier.plans import service
from dossier.session import get_spark, intermediates
from dossier.sources.tables import TableStore, write_report


# Command -> (options and positional arguments as (names, settings)). Shared groups come first.
TOP_K = ("--top-k", {"type": int, "default": K.DEFAULT_TOP_K})
SECTION = ("--section-type", {})
ONE, MANY = ("accession_number", {}), ("accession_number", {"nargs": "*"})
COMMANDS = {
    "ingest-sec-company": [
        ("cik", {"nargs": "*", "help": "companies to load; all cached ones by default"}),
        ("--forms", {"nargs": "+", "default": K.DEFAULT_FORMS}), ("--limit", {"type": int, "default": K.DEFAULT_FILING_LIMIT}),
        ("--fact-concepts", {"nargs": "+"}), ("--facts-for-ingested-filings-only", {"action": "store_true"}),
        ("--skip-documents", {"action": "store_true"}),
    ],
    "parse-sec-filing": [
        MANY, ("--max-tokens", {"type": int, "default": K.DEFAULT_MAX_TOKENS}),
        ("--overlap-tokens", {"type": int, "default": K.DEFAULT_OVERLAP_TOKENS}),
    ],
    "retrieve-sec-filing": [
        ONE, ("query", {}), TOP_K, SECTION, ("--hybrid", {"action": "store_true"}), ("--index-path", {"help": "search this index, not the chunks"}),
    ],
    "ask-sec-filing": [
        ONE, ("question", {}), TOP_K, SECTION, ("--answer-mode", {"choices": ["extractive", "llm"], "default": "extractive"}),
        ("--candidates", {"help": "JSON lines of stored generated answers, for the answer mode llm"}),
    ],
    "compare-sec-filing": [
        ONE, ("--section-type", {"default": "risk_factors"}), ("--previous-accession-number", {}),
        ("--max-claims", {"type": int, "default": K.DEFAULT_TOP_K}),
    ],
    "run-eval": [
        ("--dataset", {"required": True}),
        ("--variant", {"dest": "variants", "action": "append", "choices": [v for v, *_ in K.VARIANTS]}),
        ("--stored-answers", {"help": "folder of stored model answers"}),
        ("--report", {"default": "eval_report", "help": "path prefix of the JSON and Markdown files"}),
    ],
    "index-sec-filing": [MANY, ("--path", {"required": True}), ("--hybrid", {"action": "store_true"})],
    "health": [],
}


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="dossier")
    parser.add_argument("--store", required=True, help="folder of the stored tables")
    parser.add_argument("--cache", default="data/cache", help="folder of the downloaded feeds and documents")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        command = commands.add_parser(name)
        for argument, settings in arguments:
            command.add_argument(argument, **settings)
    return parser


def shown(df: DataFrame) -> Iterator[dict]:
    """All rows, fetched a partition at a time."""
    for row in df.select(F.to_json(F.struct("*")).alias("line")).toLocalIterator():
        yield json.loads(row.line)


def company_ids(store: TableStore, given: list[str]) -> list[str]:
    """Ten-digit company identifiers; a value that is none is an error."""
    rows = store.spark.createDataFrame([(c,) for c in given], "cik string")
    return [row[0] for row in rows.select(require(normalize_cik(rows.cik), "a company id needs one to ten digits")).collect()]


def run(args: argparse.Namespace, store: TableStore) -> Iterable[object]:
    """Execute one command; gives JSON-ready results, all of them."""
    command = args.command
    if command == "health":
        return [service.health()]
    if command == "ingest-sec-company":
        ciks = company_ids(store, args.cik) if args.cik else None
        return [service.ingest(store, args.cache, args.forms, args.limit, args.fact_concepts,
                               args.facts_for_ingested_filings_only, not args.skip_documents, ciks)]
    if command == "parse-sec-filing":
        return shown(service.parse(store, args.cache, args.accession_number or None, args.max_tokens, args.overlap_tokens))
    if command == "retrieve-sec-filing":
        asked = service.question_table(store, args.accession_number, args.query, args.top_k, None, section_type=args.section_type)
        return shown(service.retrieve(store, asked, args.hybrid, args.index_path))
    if command == "ask-sec-filing":
        asked = service.question_table(store, args.accession_number, args.question, args.top_k, section_type=args.section_type)
        candidates = None
        if args.answer_mode == "llm":
            none = store.spark.createDataFrame([], "question_id string, candidate_answer string")
            candidates = service.stored_candidates(store, args.candidates) if args.candidates else none
        return shown(service.ask_one(store, asked, candidates, K.DEFAULT_MODEL))
    if command == "compare-sec-filing":
        return shown(service.compare(store, args.accession_number, args.section_type, args.previous_accession_number, args.max_claims))
    if command == "index-sec-filing":
        return [{"indexed": service.index(store, args.path, args.accession_number or None, args.hybrid)}]
    scores, metrics, lines = service.evaluate(store, args.dataset, args.variants or K.DEFAULT_VARIANTS, args.stored_answers)
    rows = [row.asDict() for row in metrics.collect()]
    write_report(args.report, service.result_rows(scores), rows, lines)
    return rows


def main() -> None:
    args = build_parser().parse_args()
    spark = get_spark("dossier")
    with intermediates(spark):
        for result in run(args, TableStore(spark, args.store)):
            print(json.dumps(result, default=str))


if __name__ == "__main__":
    main()
