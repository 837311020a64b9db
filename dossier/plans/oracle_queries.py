"""SQL statement of every named query that SQL can express."""

from __future__ import annotations

from dossier import constants as K
from dossier.plans import corpus as X
from dossier.plans import oracles as O
from dossier.plans.oracles import NL, q

FINAL: dict[str, str] = {}

FINAL["html_sniff"] = """
select kind, id, regexp_matches(lower(substr(body, 1, 500)), '<html|<body|</') as is_html from (
  select 'page' as kind, page_id as id, html as body from pages union all select 'document', doc_id, text from documents)"""


def _page_text() -> str:
    e = "html"
    for tag in K.SKIPPED_TAGS:
        e = rf"regexp_replace({e}, '(?is)<{tag}\b.*?</{tag}\s*>', '', 'g')"
    e = rf"regexp_replace({e}, '(?s)<!--.*?-->', chr(2) || chr(3), 'g')"
    e = rf"regexp_replace({e}, '(?i)</?({'|'.join(K.BLOCK_TAGS)})\b[^>]*>', chr(2) || {NL} || chr(3), 'g')"
    e = rf"regexp_replace({e}, '<[^>]*>', chr(2) || chr(3), 'g')"
    # A text run of nothing but blanks between two tags is dropped.
    e = rf"regexp_replace({e}, '\x03\s+\x02', chr(3) || chr(2), 'g')"
    e = rf"regexp_replace({e}, '[\x02\x03]', '', 'g')"
    # Entities are resolved three times in a row.
    for _ in range(3):
        for name, char in (("quot", "'\"'"), ("middot", "'·'"), ("copy", "'©'"), ("lt", "'<'"), ("gt", "'>'"), ("amp", "'&'")):
            e = f"replace({e}, '&{name};', {char})"
    return O.normalize_layout(e)


FINAL["html_extract"] = f"select page_id, {_page_text()} as text from pages"

_messy = f"(chr(9) || ' ' || replace(text, '. ', '.  ' || chr(13) || chr(10) || chr(9) || chr(13) || ' ' || chr(10) || ' ') || ' ' || {NL})"
FINAL["text_normalize"] = f"select doc_id, length(t) as n_chars, sha256(t) as text_hash from (select doc_id, {O.normalize_layout(_messy)} as t from documents)"
FINAL["heading_classify"] = "select filing_key, line_no, type as section_type from x_heads where type is not null"
FINAL["section_markers"] = 'select filing_key, pos, name, type, "offset" from x_marks'
FINAL["filing_sections"] = """
select accession_number, section_sequence::bigint as section_sequence, section_name, section_type, start_offset::bigint as start_offset, end_offset::bigint as end_offset,
  sha256(section_text) as text_hash from x_sections"""
FINAL["chunk_windows"] = """
select chunk_id, token_count::bigint as token_count, source_start::bigint as source_start, source_end::bigint as source_end, sha256(text) as text_hash from x_doc_chunks"""
FINAL["filing_chunks"] = """
select chunk_id, token_count::bigint as token_count, sha256(text) as text_hash, accession_number, section_type, form_type, source_url,
  strftime(filing_date, '%Y-%m-%d') as filing_date, source_start::bigint as source_start, source_end::bigint as source_end from x_chunk_meta"""
FINAL["parse_counts"] = """
select accession_number, count(*) as sections_created, (select count(*) from x_chunks c where c.accession_number = s.accession_number) as chunks_created
from x_sections s group by accession_number"""
FINAL["word_tokens"] = f"""
select doc_id, len(w) as words, len(list_distinct(w)) as distinct_words, sha256(array_to_string(w, '|')) as words_hash from (select doc_id, {O.words('text')} as w from documents)"""
FINAL["claim_split"] = f"""
select doc_id, pos, claim, {O.claim_key('claim')} as claim_key from (select doc_id, unnest({O.claims('text')}) as claim, generate_subscripts({O.claims('text')}, 1) - 1 as pos from documents)"""
FINAL["claim_distinct"] = "select accession_number, section_sequence::bigint as section_sequence, claim_key, chunk_id, claim_pos, claim from x_claims"
FINAL["evidence_fragments"] = f"""
select doc_id, unnest({O.fragments('text')}) as fragment, generate_subscripts({O.fragments('text')}, 1) - 1 as pos from documents"""
_marked = f"array_to_string(list_transform(string_split(text, {NL}), lambda l, i: case when i % 3 = 0 then l || {NL} || 'Report | 2024 Form 10-K | 7' || {NL} || ' APPLE  INC. ' else l end), {NL})"
FINAL["content_lines"] = f"""
select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) - 1 as pos from (select doc_id, {O.content_lines('t')} as ls from (select doc_id, {_marked} as t from documents))"""
FINAL["line_windows"] = f"""
select doc_id, kind, pos, sha256(w) as window_hash from (
  select doc_id, 'forward' as kind, unnest({O.windows('ls', 0, K.LINES_AHEAD)}) as w, generate_subscripts(ls, 1) - 1 as pos from (select doc_id, {O.content_lines('text')} as ls from documents)
  union all
  select doc_id, 'centred', unnest({O.windows('ls', K.LINES_BEFORE_CENTRE, K.LINES_AFTER_CENTRE)}), generate_subscripts(ls, 1) - 1 from (select doc_id, {O.content_lines('text')} as ls from documents))"""
_changed = "lower(text || case when token_count < 30 then ' No Material  changes' else ' No material Changes' end)"
FINAL["numeric_evidence"] = f"""
select chunk_id, {O.number_evidence('text')} as has_number, contains({_changed}, 'no material changes') as no_change, {O.page_marker('text')} as page_marker from x_chunks"""

FINAL["query_classify"] = f"select qid, {O.classify('question')} as query_type from x_every_question"
_concepts = {k: "|".join(c) for k, _, c, _ in K.METRICS}
FINAL["metric_match"] = f"""
select qid, metric, {O.metric_attr('metric', O.LABELS)} as label, {O.metric_attr('metric', _concepts)} as concepts
from (select qid, {O.match_metric('question')} as metric from x_every_question) where metric is not null"""
# Distinct terms have no defined order in list_distinct; terms are compared in order of first occurrence.
_ordered = "list_filter(w, lambda x, i: list_position(w, x) = i and length(x) > 2 and x not in " + O.in_list(K.STOPWORDS) + ")"
FINAL["query_terms"] = f"""
select qid, array_to_string(ts, '|') as terms, {O.numeric_query('question')} as "numeric", array_to_string({O.targets('ts')}, '|') as targets
from (select qid, question, {_ordered} as ts from (select qid, question, {O.words('question')} as w from x_every_question))"""


def _embedding(d: int) -> str:
    return f"""
select doc_id, bucket, round(cnt / sqrt((sum(cnt * cnt) over (partition by doc_id))::double), 9) as value from (
  select doc_id, {O.bucket('word', d)} as bucket, count(*) as cnt from (select doc_id, unnest({O.words('text')}) as word from documents) group by all)"""


FINAL["dense_embed"] = _embedding(K.DENSE_DIMENSIONS)
FINAL["sparse_embed"] = _embedding(K.SPARSE_DIMENSIONS)
_namespace = K.POINT_ID_NAMESPACE.replace("-", "")
FINAL["point_ids"] = f"""
select chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) as point_id
from (select chunk_id, sha1(unhex('{_namespace}') || encode(chunk_id)) as h from (select doc_id || ':s0001:c0001' as chunk_id from documents))"""
FINAL["retrieve_topk"] = "select question_id, rank, chunk_id, round(score, 9) as score from x_plain_hits"
FINAL["filtered_topk"] = "select question_id, rank, chunk_id, round(score, 9) as score from x_filtered_hits"
FINAL["strong_hits"] = f"select question_id, rank, chunk_id, section_type, sha256(text) as text_hash from x_retrieved where score >= {K.MIN_SIMILARITY}"
FINAL["hybrid_topk"] = """
select question_id, rank, chunk_id, round(score, 9) as score from (select *, row_number() over (partition by question_id order by round(score, 9) desc, chunk_id) as rank from x_fused) where rank <= top_k"""
FINAL["sparse_topk"] = """
select question_id, rank, chunk_id, round(score, 9) as score from (
  select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank from x_sparse_scored where score > 0) where rank <= top_k"""
FINAL["vector_topk"] = """
select query_id, rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
    select q.vec_id as query_id, d.vec_id, round(list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 9) as score
    from embeddings q join embeddings d on q.vec_id % 50 = 0 and len(q.embedding) = len(d.embedding))) where rank <= 5"""

_dirty = "(case when c_custkey % 7 = 0 then 'n/a' when c_custkey % 11 = 0 then '123456789' || lpad(c_custkey::varchar, 4, '0') else ' CIK-' || c_custkey || ' ' end)"
_acc = "(case when c_custkey % 5 = 0 then '  ' else ' 00-' || c_custkey || '-9 ' end)"
_doc = "' //d' || c_custkey || '.htm '"
FINAL["identifiers"] = f"""
select c_custkey as id, {O.normalize_cik(_dirty)} as cik, nullif(replace(trim({_acc}), '-', ''), '') as accession,
  {O.document_url(O.normalize_cik(_dirty), _acc, _doc, 'https://example.org/files/')} as url from customer"""
FINAL["coercions"] = rf"""
select id, {O.opt_string('t')} as as_string, coalesce(case when regexp_matches({O.strip('t')}, '^[+-]?\d+$') then try_cast({O.strip('t')} as int) end, -1)::bigint as as_int,
  strftime({O.opt_date('t')}, '%Y-%m-%d') as as_date,
  (case when regexp_matches({O.strip('t')}, '^[+-]?\d+(\.\d+)?$') then try_cast({O.strip('t')} as decimal(38,6)) end)::varchar as as_decimal, coalesce({O.opt_string('t')}, 'z') as first_text
from (select o_orderkey as id, case o_orderkey % 6 when 0 then '  ' when 1 then 'abc' when 2 then ' ' || o_orderkey || ' ' when 3 then o_orderkey || '.25'
  when 4 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%Y-%-m-%d') end as t from orders)"""
FINAL["fiscal_calendar"] = f"""
select id, fy::bigint as fiscal_year, coalesce(fq, -1)::bigint as fiscal_quarter, {O.lookup_period('form', 'fq')} as lookup_period,
  {O.period_label(O.lookup_period('form', 'fq'), 'fy', 'fq')} as label, {O.period_label('null::varchar', 'case when id % 3 > 0 then fy end', 'fq')} as bare_label
from (select id, form, {O.fiscal_year('form', 'report', 'ye', 'given')}::int as fy,
    coalesce(case when regexp_matches(period, '^Q[1-4]$') then substr(period, 2, 1)::int end, {O.inferred_quarter('form', 'report', 'ye')})::int as fq
  from (select o_orderkey as id, {O.FORM} as form, o_orderdate::date as report,
      case o_orderkey % 9 when 0 then '1399' when 1 then null else {O.YEAR_END} end as ye, case when o_orderkey % 10 = 0 then year(o_orderdate) + 3 end as given,
      case o_orderkey % 8 when 0 then 'Q4' when 1 then 'Q5' when 2 then 'FY' end as period from orders))"""
FINAL["source_keys"] = "select source_key, count(*) as n, max(ingest_seq) as last_seq from x_facts group by source_key"
FINAL["fact_format"] = f"""
select id, {O.fact_text('v')} as shown, array_to_string(list_sort({O.fact_tokens('v')}), '|') as tokens from (
  select l_orderkey as id, (case when l_linenumber % 2 = 0 then l_extendedprice::decimal(18,2) when l_linenumber = 3 then floor(l_extendedprice::decimal(18,2)) * -1000
    else floor(l_extendedprice::decimal(18,2)) end)::decimal(30,6) as v from lineitem)"""
FINAL["number_tokens"] = f"""
select doc_id, array_to_string(list_sort({O.number_tokens('text', K.LARGE_NUMBER_DIGITS)}), '|') as large, array_to_string(list_sort({O.number_tokens('text')}), '|') as all_numbers from documents"""
FINAL["expected_tokens"] = f"""
select id, array_to_string(list_sort(list_distinct({O.expected_tokens('v')})), '|') as tokens from (
  select o_orderkey as id, '$' || {O.grouped('floor(o_totalprice)::bigint * case when o_orderkey % 3 = 0 then 1000000 else 10 end')} as v from orders)"""

# One row per cell of the ragged feed arrays.
_k = "c_custkey"
_cells = f"""(select lpad(c_custkey::varchar, 10, '0') as cik10, c_custkey::varchar as cik, {_k} as key, {O.YEAR_END.replace('o_custkey', _k)} as fye, unnest([
  {{'position': 0, 'accession': {_k} || '-01', 'form': '10-K', 'filed': '2024-02-01', 'report': '2023-12-31', 'doc': 'a.htm', 'fy': case when {_k} % 4 = 0 then '2031' else '' end, 'fp': null::varchar}},
  {{'position': 1, 'accession': {_k} || '-02', 'form': case when {_k} % 2 = 0 then '8-K' else '10-Q' end, 'filed': '2024-05-02', 'report': '2024-03-30', 'doc': '/b.htm', 'fy': null, 'fp': 'Q3'}},
  {{'position': 2, 'accession': {_k} || '-03', 'form': ' 10-Q ', 'filed': case when {_k} % 3 = 0 then 'bad' else '2024-08-01' end, 'report': '2024-06-29', 'doc': case when {_k} % 5 = 0 then ' ' else 'c.htm' end, 'fy': null, 'fp': null}},
  {{'position': 3, 'accession': {_k} || '-04', 'form': '10-K', 'filed': '2025-02-03', 'report': null, 'doc': 'd.htm', 'fy': null, 'fp': null}}]) as r from customer)"""
FINAL["company_rows"] = f"""
select lpad(c_custkey::varchar, 10, '0') as cik, 'T' || c_custkey as ticker,
  case when c_custkey % 3 <> 0 then c_name when c_custkey % 6 <> 0 then 'Entity ' || c_custkey else 'CIK ' || lpad(c_custkey::varchar, 10, '0') end as name,
  case when c_custkey % 2 = 0 then 'NYSE' end as exchange, '3571' as sic, {O.YEAR_END.replace('o_custkey', _k)} as fiscal_year_end from customer"""
FINAL["transpose_columns"] = f"""
select cik, r.position::bigint as position, r.accession as "accessionNumber", r.form as form, r.filed as "filingDate", r.report as "reportDate", r.doc as "primaryDocument", r.fy as fy, r.fp as fp from {_cells}"""
FINAL["filing_rows"] = f"""
select accession_number, cik, form_type, filing_date, report_date, coalesce(fy, -1)::bigint as fiscal_year, coalesce(fq, -1)::bigint as fiscal_quarter, primary_document, source_url, position from (
  select *, row_number() over (partition by cik order by position) as n from (
    select r.accession as accession_number, cik10 as cik, trim(r.form) as form_type, r.filed as filing_date, r.report as report_date, trim(r.doc) as primary_document,
      {O.document_url('cik', 'r.accession', 'r.doc')} as source_url, r.position::bigint as position,
      {O.fiscal_year('trim(r.form)', 'r.report::date', 'fye', "try_cast(nullif(r.fy, '') as int)")} as fy,
      coalesce(case when r.fp = 'Q3' then 3 end, {O.inferred_quarter('trim(r.form)', 'r.report::date', 'fye')}) as fq from {_cells})
  where form_type in ('10-K', '10-Q') and filing_date <> 'bad' and primary_document <> '') where n <= 2"""
FINAL["limit_per_company"] = """
select cik, position, accession_number from (select cik, accession_number, row_number() over (partition by cik order by filing_key) as position from x_filings where form_type in ('10-K', '10-Q')) where position <= 3"""

_even = [c for i, c in enumerate(X.CONCEPTS) if i % 2 == 0]
_fact_key = O.source_key("accession_number", "cik", "concept", "filed", "fiscal_period", "fy", "'10-Q'", "null::varchar", "'USD'", "val")
FINAL["facts_flatten"] = f"""
select cik, accession_number, concept, 'Label' as label, 'USD' as unit, val::decimal(18,2)::varchar as value, fiscal_period, coalesce(fy, -1)::bigint as fiscal_year,
  coalesce(case when regexp_matches(fiscal_period, '^Q[1-4]$') then substr(fiscal_period, 2)::int end, -1)::bigint as fiscal_quarter, strftime(filed, '%Y-%m-%d') as filed_date, position, {_fact_key} as source_key
from (select lpad(l_suppkey::varchar, 10, '0') as cik, case when l_linenumber <> 3 then 'a-' || l_orderkey end as accession_number, {O.pick(X.CONCEPTS, 'l_partkey')} as concept,
    unnest([{{'p': 0, 'v': case when l_linenumber = 2 then null else l_extendedprice::decimal(18,2)::varchar end}}, {{'p': 1, 'v': '7'}}], recursive := true),
    v as val, p::bigint as position, case when l_linenumber = 5 then 'FY' else 'Q' || l_linenumber end as fiscal_period, case when l_linenumber <> 4 then year(l_shipdate) end as fy, l_shipdate::date as filed
  from lineitem) where val is not null and concept in {O.in_list(_even)}"""
FINAL["facts_flatten"] = FINAL["facts_flatten"].replace(
    "unnest([{'p': 0, 'v': case when l_linenumber = 2 then null else l_extendedprice::decimal(18,2)::varchar end}, {'p': 1, 'v': '7'}], recursive := true),\n    v as val, p::bigint as position,",
    "case when p = 1 then '7' when l_linenumber <> 2 then l_extendedprice::decimal(18,2)::varchar end as val, p as position,",
).replace("from lineitem)", "from lineitem cross join (select unnest([0, 1])::bigint as p))")

FINAL["facts_for_filings"] = """
select concept, count(*) as n, sum(value)::decimal(30,2)::varchar as total from x_facts where accession_number in (select accession_number from x_filings where form_type = '10-K') group by concept"""
FINAL["facts_linked"] = """
select concept, g.filing_key is null as unlinked, count(*) as n, coalesce(sum(g.filing_key), -1)::bigint as key_sum
from x_facts f left join (select * from x_filings where form_type <> '8-K') g using (accession_number) group by all"""
_stored = "(select user_id, event_type, max(event_id) as event_id from events where event_id % 10 < 6 and user_id % 5 <> 0 group by all)"
_incoming = "(select user_id, event_type, max(event_id) as event_id, count(*) as n from events where event_id % 10 >= 6 or user_id % 5 = 0 group by all)"
FINAL["upsert_latest"] = f"""
select e.user_id, e.event_type, e.event_id, e.value, e.props from {_stored} s full outer join {_incoming} i using (user_id, event_type) join events e on e.event_id = coalesce(i.event_id, s.event_id)"""
FINAL["upsert_counts"] = f"""
select (count(*) filter (s.event_id is null))::bigint as created, (sum(i.n) - count(*) filter (s.event_id is null))::bigint as updated from {_incoming} i left join {_stored} s using (user_id, event_type)"""
O.chunk_views("x_wide_chunks", "x_wide_source", "section_text", 128, 8)
O.VIEWS["x_wide_source"] = "select * from x_sections where filing_key % 2 = 0"
FINAL["replace_chunks"] = """
select accession_number, chunk_id, token_count::bigint as token_count from x_chunks where filing_key % 2 = 1
union all select accession_number, chunk_id, token_count::bigint from x_wide_chunks"""
FINAL["index_replace"] = """
select accession_number, chunk_id, token_count::bigint as token_count, false as sparse from x_chunks where filing_key % 50 <> 0
union all select accession_number, chunk_id, token_count::bigint, true from x_wide_chunks where filing_key % 50 = 0"""
FINAL["ordered_filings"] = "select cik, accession_number, row_number() over (partition by cik order by filing_date desc, accession_number) as position from x_filings where form_type = '10-K'"
FINAL["fact_selection"] = """
select concept, cik, accession_number, value::decimal(20,2)::varchar as value, strftime(filed_date, '%Y-%m-%d') as filed_date from x_facts
where concept in ('Revenues', 'Assets') and fiscal_year = 1998 and fiscal_period = 'FY' order by filed_date desc nulls last, ingest_seq desc"""
FINAL["fact_lookup"] = "select question_id, metric, coalesce(tier, 0)::bigint as tier, concept, source_key, lookup_reason as reason from x_look_found"
FINAL["fact_lookup_kept"] = FINAL["fact_lookup"]

FINAL["previous_filing"] = "select accession_number, previous_accession_number from x_previous"
FINAL["comparison_support"] = "select pair_id, current_accession, prior_accession, section_type, reason from s_pairs"
FINAL["claims_changed"] = "select pair_id, change, claim_key, chunk_id, claim from s_changes"
FINAL["claims_unchanged"] = "select pair_id, unchanged_n as unchanged from s_counts"
_summary = "'Compared ' || p.section_type || ' in ' || current_accession || ' against ' || prior_accession || ': ' || added_n || ' added claim(s), ' || removed_n || ' removed claim(s), and ' || unchanged_n || ' unchanged claim(s).'"
FINAL["compare_sections"] = f"""
select p.pair_id, current_accession as current_accession_number,
  case when coalesce(full_reason, '') not in ('current_section_missing', 'previous_filing_missing') then prior_accession end as prior_accession_number, section_type,
  full_reason is null as supported, case when full_reason is null then {_summary} else {q(K.UNCOMPARABLE_SUMMARY)} end as summary,
  case when full_reason is null then coalesce(array_to_string(added, '|'), '') else '' end as added, case when full_reason is null then coalesce(array_to_string(removed, '|'), '') else '' end as removed,
  case when full_reason is null then unchanged_n else 0 end as unchanged,
  case when full_reason is null then array_to_string(list_concat(coalesce(added_ids, []), coalesce(removed_ids, []), case when added_ids is null then [first_current] else [] end,
    case when removed_ids is null then [first_prior] else [] end), '|') else '' end as cited, full_reason as insufficient_evidence_reason
from (select s.*, f.first_current, f.first_prior, c.added_n, c.removed_n, c.unchanged_n, l.added, l.removed, l.added_ids, l.removed_ids,
    case when reason is not null then reason when first_current is null or first_prior is null then 'section_chunks_missing' end as full_reason
  from s_pairs s left join s_first f using (pair_id) left join s_counts c using (pair_id) left join s_listed l using (pair_id)) p"""

FINAL["snippet_scores"] = "select question_id, chunk_id, pos, points::double as score, sha256(fragment) as fragment_hash from x_ret_scored"
FINAL["snippet_best"] = "select question_id, chunk_id, snippet from x_ret_snippets"
FINAL["ask_filings"] = """
select question_id, query_type, supported, answer, round(confidence, 9) as confidence,
  case when round(confidence * 100) >= 80 then 'high' when round(confidence * 100) >= 50 then 'medium' else 'low' end as tone,
  array_to_string(chunk_ids, '|') as cited, retrieval_count::bigint as retrieval_count, reason as insufficient_evidence_reason from x_ask_answers"""
FINAL["ask_grounding"] = f"""
select question_id, status, metric, concept, value_text as value, unit, source_key,
  case status when 'unavailable' then case when metric is null then 'no_metric_match' else 'fact_not_found' end when 'mismatched' then {q(K.MISMATCH_REASON)} end as reason
from x_ask_answers where status is not null"""
FINAL["ask_citations"] = """
select question_id, row_number() over (partition by question_id order by rank) - 1 as pos, chunk_id, accession_number, section_name, section_type, source_url, source_start::bigint as source_start,
  source_end::bigint as source_end, round(score, 9) as score, snippet from x_ask_kept"""
_generated = """case question_id % 6 when 0 then 'In short: ' || answer when 1 then answer || ' You should buy.' when 2 then answer || ' See 0000000001-20-000001:s0001:c0001.'
  when 3 then '  ' when 4 then 'It was 5 (https://example.org/x).' end"""


def _quarter_named(text: str, quarter: str) -> str:
    return f"(contains({text}, 'q' || {quarter}) or contains({text}, 'quarter ' || {quarter}) or contains({text}, {quarter} || 'q'))"


def numeric_reason(answer: str, value: str, unit: str, year: str, quarter: str, period: str) -> str:
    f = O.fold(answer)
    years = rf"regexp_extract_all({answer}, '\b20\d{{2}}\b')"
    unit_ok = f"case when lower({unit}) = 'usd' then {O.contains_any(f, ['usd', '$', 'dollar'])} else contains({f}, lower({unit})) end"
    period_ok = (
        f"case when lower({period}) = 'fy' then {O.contains_any(f, ['fy', 'fiscal '])} when regexp_matches(lower({period}), '^q\\d+$') then {_quarter_named(f, f'substr({period}, 2)')} "
        f"else contains({f}, lower({period})) end"
    )
    return (
        f"(case when not contains({O.digits(answer)}, {O.digits(value)}) then 'numeric_value_changed_or_omitted' when not ({unit_ok}) then 'numeric_unit_changed_or_omitted' "
        f"when {year} is not null and (len(list_distinct({years})) <> 1 or not list_contains({years}, ({year})::varchar)) then 'numeric_period_changed_or_omitted' "
        f"when {quarter} is not null and not {_quarter_named(f, f'({quarter})::varchar')} then 'numeric_period_changed_or_omitted' "
        f"when coalesce({period}, '') <> '' and not ({period_ok}) then 'numeric_period_changed_or_omitted' end)"
    )


def cites_unknown(answer: str, ids: str, urls: str) -> str:
    named = rf"regexp_extract_all({answer}, {q(K.CHUNK_ID_PATTERN)})"
    linked = rf"list_transform(regexp_extract_all({answer}, {q(K.URL_PATTERN)}), lambda u: rtrim(u, {q(K.URL_TRAILING_PUNCTUATION)}))"
    return f"(len(list_filter({named}, lambda r: not list_contains({ids}, r))) > 0 or len(list_filter({linked}, lambda r: not list_contains({urls}, r))) > 0)"


def validation_reason(answer: str, ids: str, urls: str, numeric: str) -> str:
    return (
        f"(case when trim({answer}) = '' then 'empty_llm_answer' when {O.contains_any(O.fold(answer), K.ADVICE_PHRASES)} then 'investment_advice_language' "
        f"when {cites_unknown(answer, ids, urls)} then 'unknown_citation_reference' else {numeric} end)"
    )


_numeric = f"case when query_type = 'numeric' then {numeric_reason('candidate', 'value_text', 'unit', 'fact_year', 'fact_quarter', 'fact_period')} end"
_urls = "list_transform(cites, lambda c: c.source_url)"
FINAL["answer_envelope"] = f"""
select question_id, case when why is null then candidate else answer end as answer, case when why is null then 'llm' else 'extractive' end as answer_mode,
  case when candidate is not null and preflight is null then 'model-x' end as synthesis_model,
  case when candidate is null then 'unavailable' when why is null then 'succeeded' else 'fallback' end as synthesis_status, why as synthesis_reason
from (select *, case when candidate is null then 'missing_openai_api_key' when preflight is not null then preflight else {validation_reason('candidate', 'chunk_ids', _urls, _numeric)} end as why
  from (select *, {_generated} as candidate, case when not supported then 'unsupported_or_insufficient_evidence' when len(chunk_ids) = 0 then 'no_citations'
      when query_type = 'numeric' and coalesce(status, '') <> 'validated' then 'numeric_grounding_not_validated' end as preflight from x_ask_answers))"""
_turn = """(text || case when conv_id % 4 = 0 then ' Hold Rating. ' else '' end
  || case when conv_id % 3 = 0 then ' $ 1,234 in Q2 of FISCAL 20' || lpad((conv_id % 30)::varchar, 2, '0') || '.' else ' 1234 dollars q2 2021' end
  || case conv_id % 5 when 0 then ' (https://example.org/a/1).' when 1 then ' 0000000001-20-000001:s0001:c0001' else '' end)"""
_ids = "[case when conv_id % 2 = 0 then '0000000001-20-000001:s0001:c0001' else 'x' end]"
_turn_numeric = numeric_reason("answer", "'1,234'", "(case when conv_id % 7 = 0 then 'shares' else 'USD' end)", "2021", "(case when conv_id % 2 = 0 then 2 end)", "(case when conv_id % 3 = 0 then 'FY' else 'Q2' end)")
FINAL["guard_checks"] = f"""
select conv_id, turn, {O.contains_any(O.fold('answer'), K.ADVICE_PHRASES)} as advice, {cites_unknown('answer', _ids, "['https://example.org/a/1']")} as "unknown",
  {_turn_numeric} as numeric_reason, {validation_reason('answer', _ids, "['https://example.org/a/1']", _turn_numeric)} as reason
from (select conv_id, turn, {_turn} as answer from conversations)"""
_block = f"i || '. chunk_id: ' || c.chunk_id || {NL} || '   section: ' || coalesce(nullif(c.section_name, ''), c.section_type, 'unknown section') || {NL} || '   source_url: ' || coalesce(nullif(c.source_url, ''), 'not provided') || {NL} || '   snippet: ' || {O.clip('c.snippet', K.PROMPT_SNIPPET_CHARS)}"
_period = "coalesce(nullif(concat_ws(' ', nullif(fact_period, ''), 'Q' || fact_quarter, fact_year), ''), 'unknown period')"
_ground = f"""case when status is not null then {NL} || 'Numeric grounding:' || {NL} || '- status=' || status || '; metric=' || coalesce({O.metric_attr('metric', O.LABELS)}, 'unknown') || '; concept=' || coalesce(concept, 'unknown')
  || '; value=' || coalesce(value_text, 'unknown') || '; unit=' || coalesce(unit, 'unknown') || '; period=' || {_period} || '; accession=' || coalesce(fact_accession, 'unknown') end"""
FINAL["synthesis_prompts"] = f"""
select a.question_id, {O.strip(f"concat_ws({NL}, 'Question: ' || x.question, '', 'Deterministic answer:', answer, '', 'Citation snippets:', nullif(array_to_string(list_transform(coalesce(cites, []), lambda c, i: {_block}), {NL}), ''), {_ground})")} as prompt
from x_ask_answers a join x_questions x using (question_id)"""

FINAL["closed_book"] = f"""
select question_id, false as supported, case when t = 'unsupported' then {q(K.UNSUPPORTED_ANSWER)} else {q(K.INSUFFICIENT_ANSWER)} end as answer,
  case when t = 'unsupported' then 'unsupported_query_type' else 'closed_book_no_filing_context' end as insufficient_evidence_reason
from (select question_id, {O.classify('question')} as t from x_all_questions)"""
FINAL["variant_predictions"] = """
select base_id as question_id, variant, supported, answer, array_to_string(chunk_ids, '|') as cited, retrieval_count::bigint as retrieval_count, reason as insufficient_evidence_reason, error from e_predictions"""
_scores = ("answer_correct", "supported_match", "keyword_match", "citation_recall", "section_recall", "evidence_recall", "numeric_match", "numeric_grounding_match", "refusal_match")
FINAL["eval_scores"] = "select base_id as question_id, variant, " + ", ".join(f"round({s}, 9) as {s}" for s in _scores) + ", error_flag as error from e_scores"
FINAL["variant_metrics"] = "select variant, questions, " + ", ".join(f"round({m}, 9) as {m}" for m in O.METRIC_SQL) + " from e_metrics"
_means = ", ".join(f"round(avg(i.{m}), 9) as {m}" for m in O.METRIC_SQL)
_pooled = ", ".join(f"round(any_value(p.{m}), 9) as pooled_{m}" for m in O.METRIC_SQL)
FINAL["issuer_headline"] = f"select variant, {_means}, {_pooled} from e_issuers i join e_metrics p using (variant) group by variant"


def _pct(m: str) -> str:
    return f"coalesce(printf('%.1f%%', {m} * 100), 'n/a')"


FINAL["report_rows"] = f"""
select variant, '| ' || concat_ws(' | ', replace(variant, '_', ' '), {_pct('accuracy')}, {_pct('numeric_accuracy')}, {_pct('numeric_grounding_accuracy')}, {_pct('refusal_accuracy')}, {_pct('evidence_recall')},
  '0.0', {_pct('error_rate')}) || ' |' as line from e_metrics"""
_title = "case when {0} then 'True' else 'False' end"
FINAL["failure_examples"] = f"""
select base_id as question_id, variant_rank::bigint as variant_rank, '- `' || base_id || '` / `' || variant || '`: expected_supported=' || {_title.format('x_supported')} || ', predicted_supported=' || {_title.format('supported')}
  || ', reason=' || coalesce(nullif(reason, ''), 'n/a') || ', answer="' || {O.clip(f"replace({O.squash('answer')}, '|', chr(92) || '|')", K.REPORT_ANSWER_CHARS)} || '"' as line
from e_scores where answer_correct <> 1 order by base_id, variant_rank limit {K.FAILURE_LIMIT}"""
FINAL["label_metrics"] = """
select lang as variant, count(*) as questions, round(avg(coalesce(quality, 0)), 9) as accuracy, round(avg((n_chars > 1000)::int), 9) as supported_accuracy, round(avg(coalesce(toxic, 1)), 9) as evidence_recall,
  1.0::double as citation_recall, round(avg((quality is null)::int), 9) as error_rate, round(avg(quality), 9) as numeric_accuracy, round(avg(case when toxic is distinct from 1 then quality end), 9) as numeric_grounding_accuracy,
  null::double as refusal_accuracy, round(avg(n_chars), 9) as avg_latency_ms from documents left join labels using (doc_id) group by lang"""
FINAL["keyword_fraction"] = f"""
select conv_id, turn, round({O.share('ts', f"contains({O.fold('text')}, {O.fold('z')})")}, 9) as fraction, round({O.share('ts', f"list_contains({O.words('text')}, z)")}, 9) as recall
from (select a.conv_id, b.turn, {O.terms('a.text')} as ts, b.text from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1 where a.role = 'user')"""
_tails = ["", " I CANNOT answer that.", " Do you mean capex or R&D?", " Not enough information.", " can’t tell you to buy", " Tell me which of the above"]
_refuses = f"(trim({O.fold('answer')}) = '' or {O.contains_any(O.fold('answer'), K.REFUSAL_MARKERS)})"
_clarifies = f"((contains({O.fold('answer')}, 'do you mean') and {O.contains_any(O.fold('answer'), K.CLARIFICATION_WORDS)}) or contains({O.fold('answer')}, 'tell me which of the above'))"


def external_reason(answer: str, query_type: str, year: str) -> str:
    return (
        f"(case when trim({answer}) = '' and coalesce({year} > {K.LAST_KNOWN_FISCAL_YEAR}, false) then 'no_retrieved_evidence' when trim({answer}) = '' then 'openai_empty_answer' "
        f"when not {_refuses} then null when {_clarifies} then 'no_metric_match' when {query_type} = 'unsupported' then 'unsupported_query_type' else 'openai_insufficient_evidence' end)"
    )


FINAL["external_refusals"] = f"""
select conv_id, turn, {_refuses} as refusal, {external_reason('answer', 'kind', 'fy')} as reason from (
  select conv_id, turn, case when k % 11 = 0 then ' ' else text || {O.pick(_tails, 'k')} end as answer, case when k % 2 = 0 then 2030 end as fy, case when k % 4 = 1 then 'unsupported' else 'text' end as kind
  from (select *, conv_id + turn as k from conversations))"""
FINAL["web_citations"] = r"""
select question_id, position, 'web:' || substr(sha1(url), 1, 12) as chunk_id, shown as section_name, 'web' as section_type, url as source_url, shown as snippet from (
  select *, coalesce(nullif(title, ''), source, url) as shown, row_number() over (partition by question_id, url order by position) as n from (
    select 'q' || (length(url) % 5) as question_id, page_id as position, url, case when page_id % 3 = 0 then '' else regexp_extract(url, '//([^/]+)', 1) end as title,
      case when page_id % 2 = 0 then 'site' end as source from pages)) where n = 1"""
_fy = "case when coalesce(fiscal_year, 0) <> 0 and coalesce(fiscal_quarter, 0) <> 0 then 'Q' || fiscal_quarter || ' ' || fiscal_year when coalesce(fiscal_year, 0) <> 0 then 'FY ' || fiscal_year end"
_head = f"concat_ws({NL}, 'Question: ' || question, 'Accession number: ' || accession_number, 'Company: ' || cik, 'Form type: ' || form_type, 'Period: ' || ({_fy}))"
FINAL["context_prompts"] = f"""
select question_id, {O.strip(f"{_head} || {NL} || {NL} || 'Filing excerpts:' || {NL} || coalesce(body, 'No filing excerpts were retrieved.')")} as prompt
from x_questions left join (select question_id, string_agg('[' || rank || '] ' || chunk_id || ' / ' || coalesce(nullif(section_name, ''), section_type, 'unknown section') || {NL} || {O.clip('text', K.EXCERPT_CHARS)} || {NL}, {NL} order by rank) as body
  from x_retrieved group by question_id) using (question_id)"""
_shown = "coalesce(nullif(case when page_id % 3 = 0 then '' else regexp_extract(url, '//([^/]+)', 1) end, ''), case when page_id % 2 = 0 then 'site' end, address)"
FINAL["response_citations"] = f"""
select page_id, pos, case when page_id % 5 = 0 then 'said' else 'see ' || url end as answer, 'web:' || substr(sha1(address), 1, 12) as chunk_id,
  {_shown} as section_name, 'web' as section_type, address as source_url
from (select page_id, url, 0::bigint as pos, url as address from pages union all select page_id, url, 1::bigint, url || '#2' from pages)"""
_context = "(coalesce(answer, 'OpenAI baseline failed to produce an answer.') || ' ')"
FINAL["external_scores"] = f"""
select question_id, case when failed = 1 then 0.0::double when not wanted then refusal_match when not supported then 0.0::double else (keyword_match = 1)::int::double end as answer_correct,
  (supported = wanted)::int::double as supported_match, keyword_match, refusal_match, -1.0::double as numeric_match, failed as error
from (select *, case when wanted then -1.0::double else (not supported)::int::double end as refusal_match from (
  select 'c' || conv_id || '.' || turn as question_id, conv_id % 3 <> 0 as wanted, coalesce(trim(answer) <> '' and not {_refuses}, false) as supported,
    (answer is null)::int::double as failed, (contains({O.fold(_context)}, 'the')::int + contains({O.fold(_context)}, 'de')::int) / 2.0::double as keyword_match
  from (select *, case when role = 'assistant' then text end as answer from conversations)))"""
_question = "replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')"
FINAL["stored_answers"] = f"""
select 'c' || conv_id || '.' || turn as question_id, coalesce(trim(answer) <> '' and not {_refuses}, false) as supported,
  case when answer is null then 'openai_eval_error' else {external_reason('answer', O.classify('text'), '2024')} end as insufficient_evidence_reason, case when answer is null then 'no stored answer' end as error,
  'openai_closed_book-c' || conv_id || '.' || turn || '-' || substr(sha256('{{"model":"m","prompt":"Question: ' || {_question} || '","question":"' || {_question} || '","question_id":"c' || conv_id || '.' || turn || '","variant":"openai_closed_book"}}'), 1, 24) as cache_key
from (select *, case when role = 'assistant' then text end as answer from conversations)"""


def oracle_sql() -> dict[str, str]:
    return {name: O.compose(sql.strip()) for name, sql in FINAL.items()}
