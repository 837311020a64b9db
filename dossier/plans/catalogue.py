"""Named queries over the benchmark tables: one per operator or flow.

Each takes ``(spark, sf_dir)``, reads whole tables and returns a DataFrame whose columns have plain
types (strings, 64-bit integers, doubles, booleans) so that results can be compared across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import constants as K
from dossier import schemas
from dossier.functions import coerce as C
from dossier.functions import numeric as N
from dossier.functions import text as T
from dossier.functions import vectors as V
from dossier.functions.html import extract_text
from dossier.operators import answering as A
from dossier.operators import comparison as CMP
from dossier.operators import evaluation as E
from dossier.operators import facts as FA
from dossier.operators import guards as G
from dossier.operators import parsing as P
from dossier.operators import questions as Q
from dossier.operators import retrieval as R
from dossier.operators import search as SE
from dossier.operators import snippets as S
from dossier.operators import upserts as U
from dossier.plans import corpus as X
from dossier.session import discard, durable, durable_parts, temporary_path
from dossier.sources import feeds, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MAX_TOKENS, OVERLAP = 64, 8
# Shares of the companies whose facts are loaded into a kept table one after another.
COMPANY_SHARES = 4


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def long(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def day(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def joined(items: Column) -> Column:
    return F.array_join(items, "|")


def sha(column: Column | str) -> Column:
    return F.sha2(column if isinstance(column, str) else column, 256)


# ---- shared inputs ----------------------------------------------------------------------------


def sections_of(spark: SparkSession, sf: str) -> DataFrame:
    return P.detect_sections(X.filing_texts(spark, sf))


def chunks_of(spark: SparkSession, sf: str) -> DataFrame:
    return P.cut_chunks(sections_of(spark, sf), MAX_TOKENS, OVERLAP)


def index_of(spark: SparkSession, sf: str, hybrid: bool = False) -> DataFrame:
    """The chunk index as a written table: flows read it several times, each with its own columns."""
    return durable(R.build_index(chunks_of(spark, sf), hybrid), "index")


def series_documents(spark: SparkSession, sf: str) -> DataFrame:
    return X.spread_table(spark, sf, "documents").select("doc_id", "text")


def user_turns(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))


def every_question(spark: SparkSession, sf: str) -> DataFrame:
    """Derived questions of all filings, all user turns and all benchmark texts."""
    derived = X.all_questions(spark, sf).select(F.concat(F.lit("f"), F.col("question_id").cast("string")).alias("qid"), "question")
    turns = user_turns(spark, sf).select(F.format_string("c%d.%d", "conv_id", "turn").alias("qid"), "question")
    items = X.table(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), F.col("text").alias("question"))
    return derived.unionByName(turns).unionByName(items)


# ---- text -----------------------------------------------------------------------------------------


@query
def html_sniff(spark, sf):
    pages = X.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body"))
    docs = X.table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    return pages.unionByName(docs).select("kind", "id", T.looks_like_html(F.col("body")).alias("is_html"))


@query
def html_extract(spark, sf):
    return X.spread_table(spark, sf, "pages").select("page_id", extract_text(F.col("html")).alias("text"))


@query
def text_normalize(spark, sf):
    messy = F.concat(F.lit("\t "), F.replace(F.col("text"), F.lit(". "), F.lit(".  \r\n\t\r \n ")), F.lit(" \n"))
    out = T.normalize_layout(messy)
    return series_documents(spark, sf).select("doc_id", long(F.length(out)).alias("n_chars"), sha(out).alias("text_hash"))


@query
def heading_classify(spark, sf):
    lines = X.filing_texts(spark, sf).select("filing_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    typed = lines.select("filing_key", long("line_no").alias("line_no"), T.classify_heading(T.normalize_heading(T.strip(F.col("line")))).alias("section_type"))
    return typed.where("section_type is not null")


@query
def section_markers(spark, sf):
    found = X.filing_texts(spark, sf).select("filing_key", F.posexplode(P.find_markers(F.col("text"))).alias("pos", "m"))
    return found.select("filing_key", long("pos").alias("pos"), "m.name", "m.type", long("m.offset").alias("offset"))


@query
def filing_sections(spark, sf):
    return sections_of(spark, sf).select(
        "accession_number", long("section_sequence").alias("section_sequence"), "section_name", "section_type",
        long("start_offset").alias("start_offset"), long("end_offset").alias("end_offset"), "text_hash",
    )


@query
def chunk_windows(spark, sf):
    docs = series_documents(spark, sf).select(
        F.col("doc_id").cast("string").alias("accession_number"), F.lit(1).alias("section_sequence"), F.lit(10).alias("start_offset"), "text"
    )
    return P.cut_chunks(docs, MAX_TOKENS, OVERLAP, "text").select(
        "chunk_id", long("token_count").alias("token_count"), long("source_start").alias("source_start"),
        long("source_end").alias("source_end"), sha("text").alias("text_hash"),
    )


@query
def filing_chunks(spark, sf):
    meta = P.with_metadata(chunks_of(spark, sf))
    return meta.select(
        "chunk_id", long("token_count").alias("token_count"), sha("text").alias("text_hash"),
        F.col("metadata.accession_number").alias("accession_number"), F.col("metadata.section_type").alias("section_type"),
        F.col("metadata.form_type").alias("form_type"), F.col("metadata.source_url").alias("source_url"),
        day("metadata.filing_date").alias("filing_date"),
        long("metadata.source_start").alias("source_start"), long("metadata.source_end").alias("source_end"),
    )


@query
def parse_counts(spark, sf):
    sections = sections_of(spark, sf)
    return P.parse_counts(sections, P.cut_chunks(sections, MAX_TOKENS, OVERLAP))


@query
def word_tokens(spark, sf):
    words = T.words(F.col("text"))
    return series_documents(spark, sf).select(
        "doc_id", long(F.size(words)).alias("words"), long(F.size(F.array_distinct(words))).alias("distinct_words"), sha(joined(words)).alias("words_hash")
    )


@query
def claim_split(spark, sf):
    rows = series_documents(spark, sf).select("doc_id", F.posexplode(T.claims(F.col("text"))).alias("pos", "claim"))
    return rows.select("doc_id", long("pos").alias("pos"), "claim", T.claim_key(F.col("claim")).alias("claim_key"))


@query
def claim_distinct(spark, sf):
    claims = CMP.section_claims(chunks_of(spark, sf))
    return claims.select("accession_number", long("section_sequence").alias("section_sequence"), "claim_key", "chunk_id", long("claim_pos").alias("claim_pos"), "claim")


@query
def evidence_fragments(spark, sf):
    rows = series_documents(spark, sf).select("doc_id", F.posexplode(T.fragments(F.col("text"))).alias("pos", "fragment"))
    return rows.select("doc_id", long("pos").alias("pos"), "fragment")


def with_page_markers(text: Column) -> Column:
    """Put a page-marker line after every third line."""
    return F.array_join(
        F.transform(F.split(text, "\n"), lambda line, i: F.when(i % 3 == 2, F.concat(line, F.lit("\nReport | 2024 Form 10-K | 7\n APPLE  INC. "))).otherwise(line)), "\n"
    )


@query
def content_lines(spark, sf):
    rows = series_documents(spark, sf).select("doc_id", F.posexplode(T.content_lines(with_page_markers(F.col("text")))).alias("pos", "line"))
    return rows.select("doc_id", long("pos").alias("pos"), "line")


@query
def line_windows(spark, sf):
    lines = T.content_lines(F.col("text"))
    forward = T.line_windows(lines, 0, K.LINES_AHEAD)
    centred = T.line_windows(lines, K.LINES_BEFORE_CENTRE, K.LINES_AFTER_CENTRE)
    docs = series_documents(spark, sf)
    parts = [docs.select("doc_id", F.lit(kind).alias("kind"), F.posexplode(w).alias("pos", "window")) for kind, w in (("forward", forward), ("centred", centred))]
    return parts[0].unionByName(parts[1]).select("doc_id", "kind", long("pos").alias("pos"), sha("window").alias("window_hash"))


@query
def numeric_evidence(spark, sf):
    text = F.col("text")
    return chunks_of(spark, sf).select(
        "chunk_id", S.has_numeric_evidence(F.array(text)).alias("has_number"),
        S.has_no_material_change(F.array(F.concat(text, F.when(F.col("token_count") < 30, " No Material  changes").otherwise(" No material Changes")))).alias("no_change"),
        T.is_page_marker(text).alias("page_marker"),
    )


# ---- questions --------------------------------------------------------------------------------------


@query
def query_classify(spark, sf):
    return every_question(spark, sf).select("qid", Q.classify(F.col("question")).alias("query_type"))


@query
def metric_match(spark, sf):
    metric = FA.match_metric(F.col("question"))
    return every_question(spark, sf).withColumn("metric", metric).where("metric is not null").select(
        "qid", "metric", FA.metric_label(F.col("metric")).alias("label"), joined(FA.metric_concepts(F.col("metric"))).alias("concepts")
    )


@query
def query_terms(spark, sf):
    terms = every_question(spark, sf).select("qid", "question", Q.query_terms(F.col("question")).alias("terms"))
    return terms.select(
        "qid", joined("terms").alias("terms"), Q.is_numeric_query(F.col("question")).alias("numeric"),
        joined(Q.target_numbers(F.col("terms"))).alias("targets"),
    )


# ---- vectors --------------------------------------------------------------------------------------


@query
def dense_embed(spark, sf):
    rows = series_documents(spark, sf).select("doc_id", F.posexplode(V.dense_values(V.count_vector(F.col("text")))).alias("bucket", "value"))
    return rows.where("value > 0").select("doc_id", long("bucket").alias("bucket"), F.round("value", 9).alias("value"))


@query
def sparse_embed(spark, sf):
    vectors = series_documents(spark, sf).select("doc_id", V.count_vector(F.col("text"), K.SPARSE_DIMENSIONS).alias("v"))
    rows = vectors.select("doc_id", F.explode(F.arrays_zip(F.col("v.idx").alias("bucket"), V.sparse_values(F.col("v")).alias("value"))).alias("e"))
    return rows.select("doc_id", long("e.bucket").alias("bucket"), F.round("e.value", 9).alias("value"))


@query
def point_ids(spark, sf):
    docs = series_documents(spark, sf).select(P.chunk_id(F.col("doc_id").cast("string"), F.lit(1), F.lit(1)).alias("chunk_id"))
    return docs.select("chunk_id", C.point_id(F.col("chunk_id")).alias("point_id"))


def hit_rows(hits: DataFrame) -> DataFrame:
    return hits.select("question_id", long("rank").alias("rank"), "chunk_id", F.round("score", 9).alias("score"))


@query
def retrieve_topk(spark, sf):
    return hit_rows(R.retrieve(X.questions(spark, sf), index_of(spark, sf), ()))


@query
def filtered_topk(spark, sf):
    return hit_rows(R.retrieve(X.questions(spark, sf), index_of(spark, sf), A.FILTERS))


@query
def strong_hits(spark, sf):
    index = index_of(spark, sf)
    strong = R.fetch_hits(R.strong(R.retrieve(X.questions(spark, sf), index, ())), index, ("section_type", "text"))
    return strong.select("question_id", long("rank").alias("rank"), "chunk_id", "section_type", sha("text").alias("text_hash"))


@query
def hybrid_topk(spark, sf):
    return hit_rows(R.retrieve_hybrid(X.questions(spark, sf), index_of(spark, sf, hybrid=True)))


@query
def sparse_topk(spark, sf):
    """Top-k by sparse vectors through posting lists."""
    embedded = R.embed_chunks(chunks_of(spark, sf), K.SPARSE_DIMENSIONS, column="sparse_vector")
    index = durable(embedded.select("accession_number", "chunk_id", "sparse_vector"), "sparse-index")
    return hit_rows(SE.retrieve_sparse(X.questions(spark, sf), index, durable(SE.list_segments(index), "list-segments")))


@query
def vector_topk(spark, sf):
    """Cosine top-k over given vectors: every fiftieth vector against all of them."""
    vectors = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return SE.nearest(vectors.where("id % 50 = 0"), vectors, K.DEFAULT_TOP_K).withColumn("rank", long("rank"))


# ---- coercion, identifiers, numbers -------------------------------------------------------------------


@query
def identifiers(spark, sf):
    key = F.col("c_custkey").cast("string")
    dirty = F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("123456789"), F.lpad(key, 4, "0"))).otherwise(F.concat(F.lit(" CIK-"), key, F.lit(" ")))
    acc = F.when(F.col("c_custkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" 00-"), key, F.lit("-9 ")))
    return X.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), C.normalize_cik(dirty).alias("cik"), C.undashed(acc).alias("accession"),
        C.document_url(dirty, acc, F.concat(F.lit(" //d"), key, F.lit(".htm ")), "https://example.org/files/").alias("url"),
    )


@query
def coercions(spark, sf):
    key = F.col("o_orderkey")
    text = F.when(key % 6 == 0, F.lit("  ")).when(key % 6 == 1, F.lit("abc")).when(key % 6 == 2, F.concat(F.lit(" "), key.cast("string"), F.lit(" "))).when(
        key % 6 == 3, F.concat(key.cast("string"), F.lit(".25"))
    ).when(key % 6 == 4, F.date_format(F.col("o_orderdate").cast("date"), "yyyy-MM-dd")).otherwise(F.date_format(F.col("o_orderdate").cast("date"), "yyyy-M-dd"))
    return X.spread_table(spark, sf, "orders").select(
        key.alias("id"), C.optional_string(text).alias("as_string"), long(F.coalesce(C.optional_int(text), F.lit(-1))).alias("as_int"),
        day(C.optional_date(text)).alias("as_date"), C.optional_decimal(text).cast("string").alias("as_decimal"),
        C.first_non_empty(F.array(F.lit(None).cast("string"), F.lit(" "), text, F.lit("z"))).alias("first_text"),
    )


@query
def fiscal_calendar(spark, sf):
    report = F.col("o_orderdate").cast("date")
    key = F.col("o_orderkey")
    form = X.form_of(F.col("o_orderpriority"))
    year_end = F.when(key % 9 == 0, F.lit("1399")).when(key % 9 == 1, F.lit(None).cast("string")).otherwise(X.year_end(F.col("o_custkey")))
    source_year = F.when(key % 10 == 0, F.year(report) + 3)
    period = F.when(key % 8 == 0, F.lit("Q4")).when(key % 8 == 1, F.lit("Q5")).when(key % 8 == 2, F.lit("FY"))
    year, quarter = C.fiscal_year(form, report, year_end, source_year), C.fiscal_quarter(form, report, year_end, period)
    return X.spread_table(spark, sf, "orders").select(
        key.alias("id"), long(year).alias("fiscal_year"), long(F.coalesce(quarter, F.lit(-1))).alias("fiscal_quarter"),
        C.lookup_period(form, quarter).alias("lookup_period"), C.period_label(C.lookup_period(form, quarter), year, quarter).alias("label"),
        C.period_label(F.lit(None).cast("string"), F.when(key % 3 > 0, year), quarter).alias("bare_label"),
    )


@query
def source_keys(spark, sf):
    return X.facts(spark, sf).groupBy("source_key").agg(F.count("*").alias("n"), F.max("ingest_seq").alias("last_seq"))


@query
def fact_format(spark, sf):
    v = F.col("l_extendedprice").cast("decimal(18,2)")
    value = F.when(F.col("l_linenumber") % 2 == 0, v).when(F.col("l_linenumber") == 3, F.floor(v) * -1000).otherwise(F.floor(v)).cast("decimal(38,6)")
    return X.spread_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), N.format_fact_value(value).alias("shown"), joined(F.sort_array(N.fact_tokens(value))).alias("tokens")
    )


@query
def number_tokens(spark, sf):
    return series_documents(spark, sf).select(
        "doc_id", joined(F.sort_array(N.large_number_tokens(F.col("text")))).alias("large"), joined(F.sort_array(N.number_tokens(F.col("text")))).alias("all_numbers")
    )


@query
def expected_tokens(spark, sf):
    value = F.concat(F.lit("$"), F.format_number(F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 1000000).otherwise(10), 0))
    return X.spread_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), joined(F.sort_array(N.expected_tokens(value))).alias("tokens"))


# ---- feeds and loading ----------------------------------------------------------------------------------


def feed_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """One submissions-shaped JSON payload per customer, with ragged arrays."""
    key = F.col("c_custkey")
    k = key.cast("string")
    recent = F.struct(
        F.array(F.concat(k, F.lit("-01")), F.concat(k, F.lit("-02")), F.concat(k, F.lit("-03")), F.concat(k, F.lit("-04"))).alias("accessionNumber"),
        F.array(F.lit("10-K"), F.when(key % 2 == 0, F.lit("8-K")).otherwise(F.lit("10-Q")), F.lit(" 10-Q "), F.lit("10-K")).alias("form"),
        F.array(F.lit("2024-02-01"), F.lit("2024-05-02"), F.when(key % 3 == 0, F.lit("bad")).otherwise(F.lit("2024-08-01")), F.lit("2025-02-03")).alias("filingDate"),
        F.array(F.lit("2023-12-31"), F.lit("2024-03-30"), F.lit("2024-06-29")).alias("reportDate"),
        F.array(F.lit("a.htm"), F.lit("/b.htm"), F.when(key % 5 == 0, F.lit(" ")).otherwise(F.lit("c.htm")), F.lit("d.htm")).alias("primaryDocument"),
        F.array(F.when(key % 4 == 0, F.lit("2031")).otherwise(F.lit(""))).alias("fy"),
        F.array(F.lit(None).cast("string"), F.lit("Q3")).alias("fp"),
    )
    payload = F.struct(
        k.alias("cik"),
        F.when(key % 3 == 0, F.lit("")).otherwise(F.col("c_name")).alias("name"),
        F.when(key % 6 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("Entity "), k)).alias("entityName"),
        F.array(F.lit(" "), F.concat(F.lit("T"), k)).alias("tickers"),
        F.when(key % 2 == 0, F.array(F.lit("NYSE"))).otherwise(F.array().cast("array<string>")).alias("exchanges"),
        F.lit(" 3571 ").alias("sic"),
        X.year_end(key).alias("fiscalYearEnd"),
        F.struct(recent.alias("recent")).alias("filings"),
    )
    parsed = F.from_json(F.to_json(payload, {"ignoreNullFields": "false"}), schemas.SUBMISSIONS)
    return X.table(spark, sf, "customer").select(parsed.alias("p")).select("p.*")


@query
def company_rows(spark, sf):
    return feeds.normalize_companies(feed_payloads(spark, sf))


@query
def transpose_columns(spark, sf):
    return feeds.transpose_recent(feed_payloads(spark, sf)).select(
        "cik", long("position").alias("position"), "accessionNumber", "form", "filingDate", "reportDate", "primaryDocument", "fy", "fp"
    )


@query
def filing_rows(spark, sf):
    rows = feeds.normalize_filings(feeds.transpose_recent(feed_payloads(spark, sf)), limit=2)
    return rows.select(
        "accession_number", "cik", "form_type", day("filing_date").alias("filing_date"), day("report_date").alias("report_date"),
        long(F.coalesce("fiscal_year", F.lit(-1))).alias("fiscal_year"), long(F.coalesce("fiscal_quarter", F.lit(-1))).alias("fiscal_quarter"),
        "primary_document", "source_url", long("position").alias("position"),
    )


@query
def limit_per_company(spark, sf):
    rows = X.filings(spark, sf).where(F.col("form_type").isin(K.DEFAULT_FORMS))
    return U.first_per_group(rows, "cik", "filing_key", 3).select("cik", long("position").alias("position"), "accession_number")


@query
def facts_flatten(spark, sf):
    """Nested fact payloads, one per line item, flattened to rows."""
    number = F.col("l_linenumber")
    amount = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    reported = F.struct(
        F.when(number == 2, F.lit("n/a")).otherwise(amount).alias("val"),
        F.when(number != 3, F.concat(F.lit("a-"), F.col("l_orderkey").cast("string"))).alias("accn"),
        F.when(number == 4, F.lit("x")).otherwise(F.year(F.col("l_shipdate").cast("date")).cast("string")).alias("fy"),
        F.when(number == 5, F.lit("FY")).otherwise(F.concat(F.lit("Q"), number.cast("string"))).alias("fp"),
        F.lit("10-Q").alias("form"),
        day(F.col("l_shipdate").cast("date")).alias("filed"),
        F.lit(None).cast("string").alias("frame"),
    )
    second = F.struct(*[(F.lit("7") if n == "val" else reported[n]).alias(n) for n in ("val", "accn", "fy", "fp", "form", "filed", "frame")])
    concept = F.struct(F.lit(" Label ").alias("label"), F.create_map(F.lit("USD"), F.array(reported, second)).alias("units"))
    payload = F.struct(
        F.col("l_suppkey").cast("string").alias("cik"),
        F.create_map(F.lit("gaap"), F.create_map(X.pick(X.CONCEPTS, F.col("l_partkey")), concept)).alias("facts"),
    )
    rows = X.spread_table(spark, sf, "lineitem").select(F.from_json(F.to_json(payload), schemas.COMPANY_FACTS).alias("p")).select("p.*")
    flat = feeds.flatten_facts(rows, [c for i, c in enumerate(X.CONCEPTS) if i % 2 == 0])
    return flat.select(
        "cik", "accession_number", "concept", "label", "unit", F.col("value").cast("decimal(18,2)").cast("string").alias("value"), "fiscal_period",
        long(F.coalesce("fiscal_year", F.lit(-1))).alias("fiscal_year"), long(F.coalesce("fiscal_quarter", F.lit(-1))).alias("fiscal_quarter"),
        day("filed_date").alias("filed_date"), F.element_at("ingest_seq", 5).alias("position"), "source_key",
    )


@query
def facts_for_filings(spark, sf):
    annual = X.filings(spark, sf).where("form_type = '10-K'")
    return U.only_for(X.facts(spark, sf), annual).groupBy("concept").agg(F.count("*").alias("n"), F.sum("value").cast("decimal(30,2)").cast("string").alias("total"))


@query
def facts_linked(spark, sf):
    linked = U.link_filings(X.facts(spark, sf), X.filings(spark, sf).where("form_type <> '8-K'"))
    return linked.groupBy("concept", F.col("filing_key").isNull().alias("unlinked")).agg(F.count("*").alias("n"), F.coalesce(F.sum("filing_key"), F.lit(-1)).alias("key_sum"))


def split_events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = X.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "props")
    stored = U.latest_per_key(events.where("event_id % 10 < 6 and user_id % 5 <> 0"), ["user_id", "event_type"], ["event_id"])
    return stored, events.where("event_id % 10 >= 6 or user_id % 5 = 0")


@query
def upsert_latest(spark, sf):
    stored, incoming = split_events(spark, sf)
    return U.upsert(stored, incoming, ["user_id", "event_type"], ["event_id"])


@query
def upsert_counts(spark, sf):
    stored, incoming = split_events(spark, sf)
    return U.upsert_counts(stored, incoming, ["user_id", "event_type"])


@query
def replace_chunks(spark, sf):
    """Filings of even key re-parsed with larger windows; the others keep their chunks."""
    sections = sections_of(spark, sf)
    keep = ("accession_number", "filing_key", "chunk_id", "token_count")
    stored = P.cut_chunks(sections, MAX_TOKENS, OVERLAP).select(*keep)
    fresh = P.cut_chunks(sections.where("filing_key % 2 = 0"), 2 * MAX_TOKENS, OVERLAP).select(*keep)
    return U.replace_by_key(stored, fresh, ["accession_number"], sections.where("filing_key % 2 = 0")).select(
        "accession_number", "chunk_id", long("token_count").alias("token_count")
    )


@query
def index_replace(spark, sf):
    """A stored index to which some filings, known and new ones, are added cut wider: the others keep their rows."""
    sections = durable(sections_of(spark, sf), "sections")
    store = tables.TableStore(spark, temporary_path(spark, "store"), buckets=64)
    first = R.build_index(P.cut_chunks(sections.where("filing_key % 100 <> 50"), MAX_TOKENS, OVERLAP))
    again = R.build_index(P.cut_chunks(sections.where("filing_key % 50 = 0"), 2 * MAX_TOKENS, OVERLAP), hybrid=True)
    for rows in (first, again):
        store.replace("index", rows, rows.select("accession_number").distinct())
    return store.read("index").select(
        "accession_number", "chunk_id", long("token_count").alias("token_count"), F.col("sparse_vector").isNotNull().alias("sparse")
    )


@query
def ordered_filings(spark, sf):
    """Annual filings newest first, numbered within each company."""
    return tables.numbered_filings(R.filter_by(X.filings(spark, sf), form_type="10-K", fiscal_quarter=None)).select(
        "cik", "accession_number", long("position").alias("position")
    )


@query
def fact_selection(spark, sf):
    picked = FA.select_facts(X.facts(spark, sf), ["Revenues", "Assets"], fiscal_year=1998, form_type=None, fiscal_period="FY")
    return tables.ordered(picked, "facts").select("concept", "cik", "accession_number", F.col("value").cast("decimal(20,2)").cast("string").alias("value"), day("filed_date").alias("filed_date"))


# ---- facts ----------------------------------------------------------------------------------------------


def looked_up(found: DataFrame) -> DataFrame:
    return found.select(
        "question_id", "metric", long(F.coalesce("tier", F.lit(0))).alias("tier"), F.col("fact.concept").alias("concept"), F.col("fact.source_key").alias("source_key"), "reason"
    )


@query
def fact_lookup(spark, sf):
    return looked_up(FA.lookup(X.all_questions(spark, sf), X.filings(spark, sf), X.facts(spark, sf)))


@query
def fact_lookup_kept(spark, sf):
    """The same lookup against the kept table of best facts, after two loads: half of the facts, then all of them.

    The loads are made for one share of the companies after another, so that only a share of the facts is on the move at once.
    """
    facts = durable(X.facts(spark, sf), "all-facts", "zstd")
    share = F.pmod(F.crc32(F.coalesce("cik", F.lit(""))), F.lit(COMPANY_SHARES))
    shares = [facts.where(share == i) for i in range(COMPANY_SHARES)]
    loads = (FA.merge_best(FA.best_facts(rows.where(F.crc32("source_key") % 2 == 0)), rows) for rows in shares)
    best = durable_parts(loads, "best-facts", "zstd")
    discard(best, "all-facts")
    return looked_up(FA.lookup(X.all_questions(spark, sf), X.filings(spark, sf), best))


# ---- comparison -------------------------------------------------------------------------------------------


def series_filings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as dated filings: source is the company, language the form, one filing a day."""
    return X.spread_table(spark, sf, "documents").select(
        F.col("doc_id").alias("filing_key"),
        F.lpad(F.regexp_replace("source", "[^0-9]", ""), 10, "0").alias("cik"),
        F.concat(F.lpad(F.regexp_replace("source", "[^0-9]", ""), 10, "0"), F.format_string("-20-%06d", "doc_id")).alias("accession_number"),
        F.col("lang").alias("form_type"),
        F.date_add(F.lit("1900-01-01").cast("date"), F.floor(F.col("doc_id") / 2).cast("int")).alias("filing_date"),
        F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("source_url"),
        X.with_headings(F.col("text"), F.col("doc_id")).alias("text"),
    )


def comparison_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Sections are written once, since finding them costs more than reading them again."""
    filings = series_filings(spark, sf)
    sections = durable(P.detect_sections(filings).select(
        "accession_number", "section_sequence", "section_name", "section_type", "section_text", "start_offset"
    ), "series-sections")
    chunks = P.cut_chunks(sections, MAX_TOKENS, OVERLAP)
    key = F.col("filing_key")
    explicit = filings.select(
        (key + 1).alias("filing_key"), F.when(key % 7 == 0, F.col("accession_number")).when(key % 7 == 1, F.lit("none")).alias("prior_accession_number")
    )
    types = [t for t, _ in K.HEADING_RULES]
    requests = filings.join(explicit, "filing_key", "left").select(
        key.alias("pair_id"), "accession_number", X.pick(types, key).alias("section_type"), "prior_accession_number", (key % 5 + 1).cast("int").alias("max_claims")
    )
    return requests, filings.drop("text"), sections, chunks


@query
def previous_filing(spark, sf):
    return CMP.previous_filing(X.filings(spark, sf))


def usable_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All pairs, and the claims of their sections."""
    return CMP.resolve_pairs(*comparison_inputs(spark, sf))


@query
def comparison_support(spark, sf):
    pairs, _ = usable_pairs(spark, sf)
    return pairs.select("pair_id", "current_accession", "prior_accession", "section_type", "reason")


@query
def claims_changed(spark, sf):
    """Claims present on one side only, with the side's citation."""
    pairs, claims = usable_pairs(spark, sf)
    rows = CMP.diff_claims(pairs.where("reason is null"), claims).where("change <> 'unchanged'")
    side = F.when(F.col("change") == "added", F.col("current")).otherwise(F.col("prior"))
    return rows.select("pair_id", "change", "claim_key", side["chunk_id"].alias("chunk_id"), side["claim"].alias("claim"))


@query
def claims_unchanged(spark, sf):
    pairs, claims = usable_pairs(spark, sf)
    rows = CMP.diff_claims(pairs.where("reason is null"), claims.select("accession_number", "section_sequence", "claim_key"))
    return rows.groupBy("pair_id").agg(F.count(F.when(F.col("change") == "unchanged", 1)).alias("unchanged"))


@query
def compare_sections(spark, sf):
    out = CMP.compare(*comparison_inputs(spark, sf))
    return out.select(
        "pair_id", "current_accession_number", "prior_accession_number", "section_type", "supported", "summary",
        joined(F.col("added_claims.snippet")).alias("added"), joined(F.col("removed_claims.snippet")).alias("removed"),
        long("unchanged_claim_count").alias("unchanged"), joined(F.transform("citations", lambda c: F.concat_ws("/", c["filing_role"], c["chunk_id"]))).alias("cited"),
        "insufficient_evidence_reason",
    )


# ---- answers -----------------------------------------------------------------------------------------------


def retrieved(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Top-k hits of the derived questions with their text, and the questions."""
    index, questions = index_of(spark, sf), X.questions(spark, sf)
    hits = R.fetch_hits(R.retrieve(questions, index, ()), index, ("text", "section_name", "section_type"))
    return hits.join(questions.select("question_id", F.col("question").alias("query")), "question_id"), questions


@query
def snippet_scores(spark, sf):
    hits, _ = retrieved(spark, sf)
    return S.scored_candidates(hits).select("question_id", "chunk_id", long("pos").alias("pos"), "score", sha("fragment").alias("fragment_hash"))


@query
def snippet_best(spark, sf):
    hits, _ = retrieved(spark, sf)
    return S.best_snippets(hits).select("question_id", "chunk_id", "snippet")


def answers_of(spark: SparkSession, sf: str) -> DataFrame:
    return A.answer(X.questions(spark, sf), X.filings(spark, sf), index_of(spark, sf), X.facts(spark, sf))


@query
def ask_filings(spark, sf):
    out = answers_of(spark, sf)
    return out.select(
        "question_id", "query_type", "supported", "answer", F.round("confidence", 9).alias("confidence"),
        A.confidence_tone(F.col("confidence")).alias("tone"), joined(F.col("citations.chunk_id")).alias("cited"),
        long("retrieval_count").alias("retrieval_count"), "insufficient_evidence_reason",
    )


@query
def ask_grounding(spark, sf):
    g = F.col("numeric_grounding")
    return answers_of(spark, sf).where(g.isNotNull()).select(
        "question_id", g["status"].alias("status"), g["metric"].alias("metric"), g["concept"].alias("concept"), g["value"].alias("value"),
        g["unit"].alias("unit"), g["source_key"].alias("source_key"), g["reason"].alias("reason"),
    )


@query
def ask_citations(spark, sf):
    rows = answers_of(spark, sf).select("question_id", F.posexplode("citations").alias("pos", "c"))
    return rows.select(
        "question_id", long("pos").alias("pos"), "c.chunk_id", "c.accession_number", "c.section_name", "c.section_type", "c.source_url",
        long("c.source_start").alias("source_start"), long("c.source_end").alias("source_end"), F.round("c.score", 9).alias("score"), "c.snippet",
    )


def generated(answers: DataFrame) -> DataFrame:
    """Stand-ins for generator output: faithful, altered, advising, mis-citing, empty or absent."""
    key = F.col("question_id")
    text = (
        F.when(key % 6 == 0, F.concat(F.lit("In short: "), F.col("answer")))
        .when(key % 6 == 1, F.concat(F.col("answer"), F.lit(" You should buy.")))
        .when(key % 6 == 2, F.concat(F.col("answer"), F.lit(" See 0000000001-20-000001:s0001:c0001.")))
        .when(key % 6 == 3, F.lit("  "))
        .when(key % 6 == 4, F.concat(F.lit("It was 5 (https://example.org/x).")))
    )
    return answers.select("question_id", text.alias("candidate_answer"))


@query
def answer_envelope(spark, sf):
    answers = answers_of(spark, sf)
    out = A.with_answer_mode(answers, generated(answers), "model-x")
    return out.select("question_id", "answer", "answer_mode", "synthesis_model", "synthesis_status", "synthesis_reason")


@query
def guard_checks(spark, sf):
    """Guards over all conversation turns, as answers to a validated fact derived from the turn's keys."""
    key = F.col("conv_id")
    answer = F.concat(
        F.col("text"),
        F.when(key % 4 == 0, F.lit(" Hold Rating. ")).otherwise(F.lit("")),
        F.when(key % 3 == 0, F.concat(F.lit(" $ 1,234 in Q2 of FISCAL 20"), F.lpad((key % 30).cast("string"), 2, "0"), F.lit("."))).otherwise(F.lit(" 1234 dollars q2 2021")),
        F.when(key % 5 == 0, F.lit(" (https://example.org/a/1).")).when(key % 5 == 1, F.lit(" 0000000001-20-000001:s0001:c0001")).otherwise(F.lit("")),
    )
    fact = F.struct(
        F.lit("validated").alias("status"), F.lit("1,234").alias("value"), F.when(key % 7 == 0, F.lit("shares")).otherwise(F.lit("USD")).alias("unit"),
        F.lit(2021).alias("fiscal_year"), F.when(key % 2 == 0, F.lit(2)).alias("fiscal_quarter"), F.when(key % 3 == 0, F.lit("FY")).otherwise(F.lit("Q2")).alias("fiscal_period"),
    )
    citations = F.array(F.struct(F.when(key % 2 == 0, F.lit("0000000001-20-000001:s0001:c0001")).otherwise(F.lit("x")).alias("chunk_id"), F.lit("https://example.org/a/1").alias("source_url")))
    rows = X.table(spark, sf, "conversations").select("conv_id", "turn", answer.alias("answer"), fact.alias("g"), citations.alias("citations"))
    return rows.select(
        "conv_id", "turn", G.gives_advice(F.col("answer")).alias("advice"),
        G.cites_unknown(F.col("answer"), F.col("citations.chunk_id"), F.col("citations.source_url")).alias("unknown"),
        G.numeric_reason(F.col("answer"), F.col("g")).alias("numeric_reason"),
        G.validation_reason(F.col("answer"), F.lit("numeric"), F.col("citations"), F.col("g")).alias("reason"),
    )


@query
def synthesis_prompts(spark, sf):
    prompt = G.synthesis_prompt(F.col("question"), F.col("answer"), F.col("citations"), F.col("numeric_grounding"))
    return answers_of(spark, sf).select("question_id", prompt.alias("prompt"))


# ---- evaluation ---------------------------------------------------------------------------------------------


@query
def closed_book(spark, sf):
    return E.closed_book(X.all_questions(spark, sf)).select("question_id", "supported", "answer", "insufficient_evidence_reason")


def predictions_of(spark: SparkSession, sf: str) -> DataFrame:
    return E.predict(X.questions(spark, sf), E.variant_table(spark), X.filings(spark, sf), index_of(spark, sf), X.facts(spark, sf))


@query
def variant_predictions(spark, sf):
    return predictions_of(spark, sf).select(
        F.col("base_id").alias("question_id"), "variant", "supported", "answer", joined(F.col("citations.chunk_id")).alias("cited"),
        long(F.coalesce("retrieval_count", F.lit(0))).alias("retrieval_count"), "insufficient_evidence_reason", "error",
    )


def with_expected(predictions: DataFrame) -> DataFrame:
    """Expectations derived from each question's filing."""
    key = F.col("base_id")
    empty = F.array().cast("array<string>")
    kind = Q.classify(F.col("question"))
    numeric = kind == "numeric"
    expected = F.struct(
        (kind != "unsupported").alias("supported"),
        F.when(key % 12 == 4, F.array(F.lit("Item"), F.lit("RISK"))).otherwise(empty).alias("answer_keywords"),
        F.when(key % 4 == 1, F.array(F.concat(F.col("accession_number"), F.lit(":s0001:c0001")), F.lit("none"))).otherwise(empty).alias("citation_chunk_ids"),
        F.when(key % 4 == 2, F.array(F.lit("business"), F.lit("business"), F.lit("mda"))).otherwise(empty).alias("section_types"),
        F.when(numeric, F.array(F.lit("Revenues"))).otherwise(empty).alias("xbrl_concepts"),
        F.when(numeric & (key % 12 == 0), F.format_number(F.floor("amount") * 1000, 0)).alias("numeric_value"),
        F.when(numeric & (key % 24 == 0), F.lit("USD")).alias("numeric_unit"),
        F.when(kind == "unsupported", F.lit("unsupported_query_type")).alias("insufficient_reason"),
    )
    return predictions.withColumn("expected", expected).withColumn("latency_ms", F.lit(0.0))


def scores_of(spark: SparkSession, sf: str) -> DataFrame:
    amounts = X.raw_filings(spark, sf).select("accession_number", "amount")
    return E.score(with_expected(predictions_of(spark, sf).join(amounts, "accession_number")))


@query
def eval_scores(spark, sf):
    return scores_of(spark, sf).select(
        F.col("base_id").alias("question_id"), "variant", *[F.round(c, 9).alias(c) for c in E.SCORES if c not in ("latency_ms",)]
    )


METRICS = ("accuracy", "supported_accuracy", "evidence_recall", "citation_recall", "error_rate", "numeric_accuracy", "numeric_grounding_accuracy", "refusal_accuracy")


@query
def variant_metrics(spark, sf):
    return E.aggregate(scores_of(spark, sf)).select("variant", "questions", *[F.round(m, 9).alias(m) for m in METRICS])


@query
def issuer_headline(spark, sf):
    """The mean of the issuers' means and the mean over all questions, side by side."""
    found = E.headline(scores_of(spark, sf).withColumn("issuer", F.substring("accession_number", 1, 10)), METRICS)
    return found.select("variant", *[F.round(m, 9).alias(m) for m in (*METRICS, *[f"pooled_{m}" for m in METRICS])])


@query
def report_rows(spark, sf):
    return E.report_rows(E.aggregate(scores_of(spark, sf)))


@query
def failure_examples(spark, sf):
    scored = scores_of(spark, sf).withColumn("question_id", F.col("base_id"))
    return E.failure_examples(scored, "base_id", "variant_rank").select(F.col("base_id").alias("question_id"), long("variant_rank").alias("variant_rank"), "line")


@query
def label_metrics(spark, sf):
    """Conditional means over document labels: -1 marks "not applicable"."""
    labels = X.table(spark, sf, "labels")
    docs = X.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    rows = docs.join(labels, "doc_id", "left").select(
        F.col("lang").alias("variant"),
        F.coalesce(F.col("quality"), F.lit(0)).cast("double").alias("answer_correct"),
        (F.col("n_chars") > 1000).cast("double").alias("supported_match"),
        F.coalesce(F.col("toxic"), F.lit(1)).cast("double").alias("evidence_recall"),
        F.lit(1.0).alias("citation_recall"), F.col("n_chars").cast("double").alias("latency_ms"), F.col("quality").isNull().cast("double").alias("error"),
        F.coalesce(F.col("quality").cast("double"), F.lit(-1.0)).alias("numeric_match"),
        F.when(F.col("toxic") == 1, F.lit(-1.0)).otherwise(F.coalesce(F.col("quality").cast("double"), F.lit(-1.0))).alias("numeric_grounding_match"),
        F.lit(-1.0).alias("refusal_match"),
    )
    return E.aggregate(rows).select("variant", "questions", *[F.round(m, 9).alias(m) for m in (*METRICS, "avg_latency_ms")])


@query
def keyword_fraction(spark, sf):
    """Share of a user turn's terms that the next turn of the conversation contains."""
    turns = X.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), Q.query_terms(F.col("text")).alias("terms"))
    pairs = asked.join(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(E.keyword_match(F.col("terms"), F.col("text")), 9).alias("fraction"),
                        F.round(E.recall(F.col("terms"), T.words(F.col("text"))), 9).alias("recall"))


@query
def external_refusals(spark, sf):
    """Refusal detection over conversation turns, some extended by typical refusal wording."""
    key = F.col("conv_id") + F.col("turn")
    tails = ["", " I CANNOT answer that.", " Do you mean capex or R&D?", " Not enough information.", " can’t tell you to buy", " Tell me which of the above"]
    answer = F.when(key % 11 == 0, F.lit(" ")).otherwise(F.concat(F.col("text"), X.pick(tails, key)))
    rows = X.table(spark, sf, "conversations").select("conv_id", "turn", answer.alias("answer"), F.when(key % 2 == 0, F.lit(2030)).alias("fiscal_year"),
                                                      F.when(key % 4 == 1, F.lit("unsupported")).otherwise(F.lit("text")).alias("query_type"))
    return rows.select("conv_id", "turn", E.looks_like_refusal(F.col("answer")).alias("refusal"),
                       E.external_reason(F.col("answer"), F.col("query_type"), F.col("fiscal_year")).alias("reason"))


@query
def web_citations(spark, sf):
    """Cited pages, first mention of each URL wins."""
    pages = X.table(spark, sf, "pages")
    sources = pages.select(
        F.lit("q1").alias("question_id"), F.col("page_id").alias("position"), F.col("url"),
        F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.regexp_extract("url", r"//([^/]+)", 1)).alias("title"),
        F.when(F.col("page_id") % 2 == 0, F.lit("site")).alias("source"),
    ).withColumn("question_id", F.concat(F.lit("q"), (F.length("url") % 5).cast("string")))
    return E.web_citations(sources).select("question_id", long("position").alias("position"), "chunk_id", "section_name", "section_type", "source_url", "snippet")


@query
def response_citations(spark, sf):
    """Answer text and web citations of raw responses, one built from every page."""
    url, key = F.col("url"), F.col("page_id")
    kind = "array<struct<type: string, url: string, title: string, source: string>>"

    def source(kind_: str, address: Column) -> Column:
        title = F.when(key % 3 == 0, F.lit("")).otherwise(F.regexp_extract("url", r"//([^/]+)", 1))
        return F.struct(F.lit(kind_).alias("type"), address.alias("url"), title.alias("title"), F.when(key % 2 == 0, F.lit("site")).alias("source"))

    none = F.lit(None).cast("string")
    search = F.struct(
        F.lit("web_search_call").alias("type"), F.struct(F.array(source("url", url), source("url", url), source("url", none)).cast(kind).alias("sources")).alias("action"),
        F.lit(None).cast(f"array<struct<type: string, text: string, annotations: {kind}>>").alias("content"),
    )
    cited = F.array(source("url_citation", F.concat(url, F.lit("#2"))), source("file", F.lit("x")), source("url_citation", url)).cast(kind)
    parts = F.array(
        F.struct(F.lit("output_text").alias("type"), F.concat(F.lit(" see "), url, F.lit(" ")).alias("text"), cited.alias("annotations")),
        F.struct(F.lit("refusal").alias("type"), F.lit("no").alias("text"), F.lit(None).cast(kind).alias("annotations")),
    )
    message = F.struct(F.lit("message").alias("type"), F.lit(None).cast(f"struct<sources: {kind}>").alias("action"), parts.alias("content"))
    response = F.struct(F.when(key % 5 == 0, F.lit(" said ")).alias("output_text"), F.array(search, message).alias("output"))
    rows = X.table(spark, sf, "pages").select("page_id", response.alias("r"))
    return rows.select("page_id", G.response_text(F.col("r")).alias("answer"), F.posexplode(E.response_citations(F.col("r.output"))).alias("pos", "c")).select(
        "page_id", long("pos").alias("pos"), "answer", "c.chunk_id", "c.section_name", "c.section_type", "c.source_url"
    )


@query
def external_scores(spark, sf):
    """Scores of an external variant whose stored answers are the assistant's turns."""
    turns = X.table(spark, sf, "conversations")
    key = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("question_id")
    variant = F.lit("openai_web_search").alias("variant")
    stored = turns.where("role = 'assistant'").select(key, variant, F.col("text").alias("answer"))
    empty = F.array().cast("array<string>")
    expected = F.struct(
        (F.col("conv_id") % 3 != 0).alias("supported"), F.array(F.lit("THE"), F.lit("de")).alias("answer_keywords"), empty.alias("citation_chunk_ids"),
        empty.alias("section_types"), empty.alias("xbrl_concepts"), *[F.lit(None).cast("string").alias(n) for n in ("numeric_value", "numeric_unit", "insufficient_reason")],
    )
    asked = turns.select(key, variant, F.col("text").alias("question"), F.lit(2024).alias("fiscal_year"), expected.alias("expected"))
    predicted = E.external_predictions(asked, stored).withColumns({
        "citations": F.lit(None).cast("array<struct<chunk_id: string, section_type: string, snippet: string>>"),
        "numeric_grounding": F.lit(None).cast("struct<status: string, value: string, unit: string, concept: string>"), "latency_ms": F.lit(0.0),
    }).withColumn("citations", F.coalesce("citations", F.array()))
    names = ("answer_correct", "supported_match", "keyword_match", "refusal_match", "numeric_match", "error")
    return E.score(predicted).select("question_id", *[F.round(n, 9).alias(n) for n in names])


@query
def context_prompts(spark, sf):
    hits, questions = retrieved(spark, sf)
    section = F.coalesce(F.nullif(F.col("section_name"), F.lit("")), F.col("section_type"), F.lit("unknown section"))
    excerpts = hits.select("question_id", "rank", "chunk_id", section.alias("section"), "text")
    return E.context_prompt(questions.withColumn("company", F.col("cik")), excerpts)


@query
def stored_answers(spark, sf):
    """External variants answered from a stored table of conversation turns."""
    turns = X.table(spark, sf, "conversations").where("role = 'assistant'")
    stored = turns.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("question_id"), F.lit("openai_closed_book").alias("variant"), F.col("text").alias("answer"))
    asked = X.table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("question_id"),
        F.lit("openai_closed_book").alias("variant"), F.col("text").alias("question"), F.lit(2024).alias("fiscal_year"),
    )
    out = E.external_predictions(asked, stored)
    key = E.cache_key(F.col("variant"), F.col("question_id"), F.col("question"), F.concat(F.lit("Question: "), F.col("question")), "m")
    return out.select("question_id", "supported", "insufficient_evidence_reason", "error", key.alias("cache_key"))
