"""The same queries stated in SQL over the same tables, for cross-checking results.

Views of the corpus are common table expressions; a query pulls in the ones it mentions. Expressions
are built by small functions so that a rule is written once.
"""

from __future__ import annotations

import re

from dossier import constants as K
from dossier.plans import corpus as X

NL = "chr(10)"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


# ---- expressions ----------------------------------------------------------------------------------


def squash(e: str) -> str:
    return rf"trim(regexp_replace({e}, '\s+', ' ', 'g'))"


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+$', '', 'g')"


def rstrip(e: str) -> str:
    return rf"regexp_replace({e}, '\s+$', '')"


def fold(e: str) -> str:
    folded = f"lower({e})"
    for letter, other in K.FOLDS:
        folded = f"replace({folded}, '{letter}', '{other}')"
    return folded


def words(e: str) -> str:
    return rf"regexp_extract_all(lower({e}), '[a-z0-9][a-z0-9_\-]*')"


def digits(e: str) -> str:
    return f"regexp_replace({e}, '[^0-9]', '', 'g')"


def clip(e: str, n: int) -> str:
    t = squash(e)
    return f"(case when length({t}) <= {n} then {t} else {rstrip(f'substr({t}, 1, {n - 3})')} || '...' end)"


def contains_any(e: str, needles) -> str:
    return "(" + " or ".join(f"contains({e}, {q(n)})" for n in needles) + ")"


def overlap(a: str, b: str) -> str:
    return f"list_has_any({a}, {b})"


def claims(e: str) -> str:
    marked = rf"regexp_replace({e}, '([.!?])\s+', '\1' || {NL}, 'g')"
    pieces = rf"regexp_split_to_array({marked}, '\n+')"
    return f"list_filter(list_transform({pieces}, lambda c: {squash('c')}), lambda c: length(c) >= {K.MIN_CLAIM_CHARS})"


def claim_key(e: str) -> str:
    return f"trim(regexp_replace(lower({e}), '[^a-z0-9]+', ' ', 'g'))"


def fragments(e: str) -> str:
    marked = rf"regexp_replace({e}, '([.!?])\s+', '\1' || chr(1), 'g')"
    pieces = rf"regexp_split_to_array({marked}, '\x01|\n{{2,}}')"
    return f"list_filter(list_transform({pieces}, lambda p: {strip('p')}), lambda p: p <> '')"


def page_marker(e: str) -> str:
    f = fold(e)
    return f"((contains({f}, 'form 10-') and contains({f}, '|')) or {f} in {in_list(K.PAGE_MARKER_NAMES)})"


def content_lines(e: str) -> str:
    return f"list_filter(list_transform(string_split({e}, {NL}), lambda l: {squash('l')}), lambda l: l <> '' and not {page_marker('l')})"


def windows(ls: str, before: int, after: int) -> str:
    return (
        f"list_transform(range(1, len({ls}) + 1), lambda i: array_to_string({ls}[greatest(i - {before}, 1) : i + {after}], ' '))"
    )


def heading_type(e: str) -> str:
    h = rf"trim(regexp_replace({e}, '\s+', ' ', 'g'), ' .:-' || chr(9))"
    cases = " ".join(f"when regexp_matches({h}, {q('(?i)' + p)}) then {q(t)}" for t, p in K.HEADING_RULES)
    return f"(case when {h} = '' or length({h}) > {K.MAX_HEADING_CHARS} then null {cases} end)"


def normalize_layout(e: str) -> str:
    e = rf"regexp_replace({e}, '\r\n|\r', {NL}, 'g')"
    e = rf"regexp_replace({e}, '[ \t\f\v]+', ' ', 'g')"
    e = rf"regexp_replace({e}, ' *\n *', {NL}, 'g')"
    e = rf"regexp_replace({e}, '\n{{3,}}', {NL} || {NL}, 'g')"
    return strip(e)


def number_evidence(e: str) -> str:
    return rf"regexp_matches({e}, '[$%]|\b\d+(\.\d+)?\b')"


def grouped(e: str) -> str:
    return f"format('{{:,}}', ({e})::bigint)"


def fact_text(e: str) -> str:
    return f"(case when {e} = floor({e}) then {grouped(e)} else regexp_replace(({e})::decimal(38,6)::varchar, '0+$', '') end)"


def number_tokens(e: str, least: int = 1) -> str:
    return (
        rf"list_distinct(list_filter(list_transform(regexp_split_to_array(replace({e}, ',', ''), '\s+'), lambda t: {digits('t')}), "
        f"lambda d: length(d) >= {least}))"
    )


def fact_tokens(e: str) -> str:
    scaled = ", ".join(f"case when abs({e}) % {s} = 0 then (abs({e}) / {s})::bigint::varchar end" for s in K.FACT_SCALES)
    return f"list_distinct(list_filter([{digits(fact_text(e))}, {scaled}], lambda t: t is not null and t <> ''))"


def pick(values, key: str) -> str:
    return f"{sql_list(values)}[1 + (({key}) % {len(values)})::int]"


def bucket(e: str, d: int) -> str:
    return f"(('0x' || substr(sha256({e}), 1, 8))::bigint % {d})"


def classify(e: str) -> str:
    t = squash(f"lower({e})")
    numbers = rf"regexp_extract_all(regexp_replace({t}, '\bq [1-4]( |\?|$)', 'q #\1', 'g'), '\b\d+(?:\.\d+)?\b')"
    quantity = f"(regexp_matches({t}, '[$%]') or len(list_filter({numbers}, lambda n: not (length(n) = 4 and (n[1:2] = '19' or n[1:2] = '20')))) > 0)"
    return (
        f"(case when {contains_any(t, K.UNSUPPORTED_PHRASES)} then 'unsupported' "
        f"when {overlap(words(t), sql_list(K.COMPARISON_TOKENS))} then 'comparison' "
        f"when {overlap(words(t), sql_list(K.NUMERIC_TOKENS))} or {quantity} then 'numeric' else 'text' end)"
    )


def match_metric(e: str) -> str:
    t = squash(f"lower({e})")
    cases = []
    for key, _, _, keywords in K.METRICS:
        tests = [f"list_contains({words(t)}, {q(k)})" if k.isalnum() else f"contains({t}, {q(k)})" for k in keywords]
        cases.append(f"when {' or '.join(tests)} then {q(key)}")
    return f"(case {' '.join(cases)} end)"


def terms(e: str) -> str:
    return f"list_filter(list_distinct({words(e)}), lambda w: length(w) > 2 and w not in {in_list(K.STOPWORDS)})"


def numeric_query(e: str) -> str:
    return f"({overlap(words(e), sql_list(K.SNIPPET_NUMERIC_TOKENS))} or {number_evidence(e)})"


def targets(ts: str) -> str:
    numeric = f"list_filter({ts}, lambda t: regexp_matches(t, '[0-9]'))"
    narrow = f"list_filter({numeric}, lambda t: trim(t, '0') <> '' and not (length(t) = 4 and (t[1:2] = '19' or t[1:2] = '20')))"
    return f"(case when len({narrow}) > 0 then {narrow} else {numeric} end)"


def year_end_month(e: str) -> str:
    return (
        rf"(case when regexp_matches({e}, '^\d{{4}}$') and try_cast(substr({e}, 1, 2) as int) between 1 and 12 "
        f"and try_cast(substr({e}, 3, 2) as int) between 1 and 31 then try_cast(substr({e}, 1, 2) as int) end)"
    )


def fiscal_year(form: str, report: str, end: str, given: str = "null") -> str:
    m = year_end_month(end)
    return (
        f"(case when {given} is not null then {given} when {report} is null then null when {form} = '10-K' or {m} is null then year({report}) "
        f"when month({report}) > {m} or (month({report}) = {m} and day({report}) > try_cast(substr({end}, 3, 2) as int)) then year({report}) + 1 "
        f"else year({report}) end)"
    )


def inferred_quarter(form: str, report: str, end: str) -> str:
    off = f"((month({report}) - {year_end_month(end)} + 12) % 12)"
    return f"(case when {form} = '10-Q' and {report} is not null then case when {off} > 0 then least((({off}) - 1) // 3 + 1, 3) else quarter({report}) end end)"


def lookup_period(form: str, quarter: str) -> str:
    return f"(case when {form} = '10-K' then 'FY' when {quarter} is not null then 'Q' || {quarter} end)"


def period_label(period: str, year: str, quarter: str) -> str:
    return (
        f"(case when coalesce({period}, '') <> '' and {year} is not null then {period} || ' ' || {year} when coalesce({period}, '') <> '' then {period} "
        f"when {quarter} is not null and {year} is not null then 'Q' || {quarter} || ' ' || {year} when {year} is not null then 'FY ' || {year} "
        "else 'the matched period' end)"
    )


def json_text(e: str) -> str:
    return f"coalesce('\"' || {e} || '\"', 'null')"


def source_key(accession, cik, concept, filed, period, year, form, frame, unit, value) -> str:
    parts = [
        ("accession_number", json_text(accession)), ("cik", json_text(cik)), ("concept", json_text(concept)),
        ("filed_date", json_text(f"strftime({filed}, '%Y-%m-%d')")), ("fiscal_period", json_text(period)),
        ("fiscal_year", f"coalesce(({year})::varchar, 'null')"), ("form_type", json_text(form)), ("frame", json_text(frame)),
        ("unit", json_text(unit)), ("value", json_text(value)),
    ]
    body = " || ',' || ".join(f"'\"{name}\":' || {value_}" for name, value_ in parts)
    return f"sha256('{{' || {body} || '}}')"


def document_url(cik: str, accession: str, document: str, base: str = K.ARCHIVES_BASE_URL) -> str:
    return (
        f"({q(base.rstrip('/') + '/edgar/data/')} || try_cast({cik} as bigint)::varchar || '/' || nullif(replace(trim({accession}), '-', ''), '') || '/' || "
        f"nullif(ltrim(trim({document}), '/'), ''))"
    )


def normalize_cik(e: str) -> str:
    d = digits(e)
    return f"(case when length({d}) between 1 and 10 then lpad({d}, 10, '0') end)"


def opt_string(e: str) -> str:
    return f"nullif({strip(e)}, '')"


def opt_date(e: str) -> str:
    return rf"(case when regexp_matches({strip(e)}, '^\d{{4}}-\d{{2}}-\d{{2}}$') then try_cast({strip(e)} as date) end)"


def metric_attr(key: str, values: dict) -> str:
    return f"(case {key} " + " ".join(f"when {q(k)} then {q(v)}" for k, v in values.items()) + " end)"


LABELS = {k: label for k, label, _, _ in K.METRICS}
KEYWORDS = {k: " ".join(kw) for k, _, _, kw in K.METRICS}


# ---- views of the corpus ----------------------------------------------------------------------------

YEAR_END = "lpad((o_custkey % 12 + 1)::varchar, 2, '0') || '28'"
FORM = "(case o_orderpriority when '1-URGENT' then '10-K' when '5-LOW' then '8-K' else '10-Q' end)"


def with_headings(text: str, key: str) -> str:
    n = X.LINES_PER_HEADING
    return (
        f"array_to_string(list_transform(string_split({text}, {NL}), lambda l, i: case when (i - 1) % {n} = 0 then "
        f"{pick(X.HEADINGS, f'(i - 1) // {n} + {key}')} || {NL} || l else l end), {NL})"
    )


def statement(extra: int) -> str:
    return f"'Total net sales were $ ' || {grouped(f'floor(amount)::bigint + {extra}')} || ' in thousands.' || {NL}"


QUESTION_TEXT = (
    f"replace(replace(replace({pick(X.QUESTIONS, 'filing_key')}, '{{name}}', 'Company ' || company_key), '{{year}}', coalesce(fiscal_year::varchar, '')), "
    f"'{{amount}}', {grouped('floor(amount)')})"
)




VIEWS: dict[str, str] = {}

VIEWS["x_filings"] = f"""
select *, {fiscal_year('form_type', 'report_date', 'fiscal_year_end')}::int as fiscal_year,
  {inferred_quarter('form_type', 'report_date', 'fiscal_year_end')}::int as fiscal_quarter,
  {document_url('cik', 'accession_number', 'primary_document')} as source_url
from (select o_orderkey as filing_key, o_custkey as company_key, o_totalprice as amount, o_orderstatus as status,
    lpad(o_custkey::varchar, 10, '0') as cik,
    lpad(o_custkey::varchar, 10, '0') || '-' || lpad((year(o_orderdate) % 100)::varchar, 2, '0') || '-' || lpad(o_orderkey::varchar, 6, '0') as accession_number,
    {FORM} as form_type, o_orderdate::date as filing_date, o_orderdate::date - 31 as report_date, {YEAR_END} as fiscal_year_end,
    '/f' || o_orderkey || '.htm' as primary_document from orders)"""

VIEWS["x_texts"] = f"""
select f.*, (case status when 'F' then {statement(0)} when 'P' then {statement(17)} else '' end)
  || {with_headings('d.text', 'f.filing_key')} as text
from x_filings f join documents d on d.doc_id = f.filing_key"""

VIEWS["x_facts"] = f"""
select *, 'Reported ' || concept as label, {source_key('accession_number', 'cik', 'concept', 'filed_date', 'fiscal_period', 'fiscal_year', 'form_type', 'frame', 'unit', 'value::decimal(38,6)::varchar')} as source_key
from (
  select cik, accession_number, 'Revenues' as concept, 'USD' as unit, (floor(amount)::bigint * 1000)::decimal(30,6) as value,
    {lookup_period('form_type', 'fiscal_quarter')} as fiscal_period, fiscal_year, fiscal_quarter, form_type, filing_date as filed_date,
    null::varchar as frame, filing_key * 10 as ingest_seq from x_filings
  union all
  select cik, case when l_linenumber <> 3 then accession_number end, {pick(X.CONCEPTS, 'l_partkey')}, 'USD',
    (case when l_linenumber % 2 = 1 then floor(l_extendedprice::decimal(18,2)) else l_extendedprice::decimal(18,2) end)::decimal(30,6),
    case when l_linenumber = 4 then 'CY' else {lookup_period('form_type', 'fiscal_quarter')} end, fiscal_year, fiscal_quarter, form_type,
    case when l_linenumber <> 5 then l_shipdate::date end, case when l_linenumber = 6 then 'CY' || fiscal_year end, l_orderkey * 10 + l_linenumber
  from lineitem join x_filings on l_orderkey = filing_key)"""

VIEWS["x_all_questions"] = f"""
select filing_key as question_id, {QUESTION_TEXT} as question, accession_number, (filing_key % 5 + 1)::int as top_k,
  case when filing_key % 3 = 0 then cik end as cik, case when filing_key % 4 = 0 then form_type end as form_type,
  case when filing_key % 5 = 0 then fiscal_year end as fiscal_year, case when filing_key % 6 = 0 then fiscal_quarter end as fiscal_quarter,
  case when filing_key % 7 = 0 then 'risk_factors' end as section_type from x_filings"""
VIEWS["x_derived_questions"] = "select * from x_all_questions where question_id in (select doc_id from documents)"
VIEWS["x_questions"] = """
select * from x_derived_questions
union all select -(item_id + 1) as question_id, text as question, d.* exclude (question_id, question) from x_derived_questions d join benchmark b on d.question_id = b.item_id"""
VIEWS["x_every_question"] = """
select 'f' || question_id as qid, question from x_all_questions
union all select 'c' || conv_id || '.' || turn, text from conversations where role = 'user'
union all select 'b' || item_id, text from benchmark"""


def marker_views(name: str, source: str) -> None:
    """Lines, headings, kept markers and sections of a table with ``filing_key, text``."""
    VIEWS[f"{name}_lines"] = f"""
select filing_key, line_no, line, (sum(length(line) + 1) over (partition by filing_key order by line_no) - length(line) - 1)::bigint as line_offset
from (select filing_key, unnest(string_split(text, {NL})) as line, generate_subscripts(string_split(text, {NL}), 1) - 1 as line_no from {source})"""
    VIEWS[f"{name}_heads"] = f"""
select filing_key, line_no, {strip('line')} as name, {heading_type(strip('line'))} as type,
  line_offset + length(line) - length(regexp_replace(line, '^\\s+', '')) as "offset" from {name}_lines"""
    VIEWS[f"{name}_kept"] = f"""
select filing_key, list_reduce(list({{'name': name, 'type': type, 'offset': "offset"}} order by line_no),
  lambda acc, m: case when m.type = acc[-1].type and m.offset - acc[-1].offset < {K.MIN_MARKER_GAP} then acc else list_append(acc, m) end,
  []::struct(name varchar, type varchar, "offset" bigint)[]) as kept
from {name}_heads where type is not null group by filing_key"""
    VIEWS[f"{name}_marks"] = f"""
select filing_key, pos, m.name as name, m.type as type, m.offset as "offset"
from (select filing_key, unnest(kept) as m, generate_subscripts(kept, 1) - 1 as pos from {name}_kept)"""
    VIEWS[f"{name}_sections"] = f"""
select s.*, f.accession_number, case when marked then {strip('substr(f.text, start_offset + 1, end_offset - start_offset)')} else f.text end as section_text
from (
  select filing_key, pos + 1 as section_sequence, name as section_name, type as section_type, "offset" as start_offset,
    coalesce(lead("offset") over (partition by filing_key order by pos), text_len) as end_offset, true as marked
  from {name}_marks join (select filing_key, length(text) as text_len from {source}) using (filing_key)
  union all
  select filing_key, 1, 'Document', 'document', 0, length(text), false from {source} where filing_key not in (select filing_key from {name}_marks)) s
join {source} f using (filing_key)"""
    chunk_views(f"{name}_chunks", f"{name}_sections", "section_text", 64, 8)


def chunk_views(name: str, source: str, text: str, size: int, overlap: int) -> None:
    stride = size - overlap
    VIEWS[f"{name}_pieces"] = rf"""
select *, regexp_extract_all({text}, '\S+\s*') as pieces, length({text}) - length(regexp_replace({text}, '^\s+', '')) as lead_chars from {source}"""
    VIEWS[f"{name}_spans"] = f"""
select *, unnest(range(0, 1 + case when len(pieces) <= {size} then 0 else ((len(pieces) - {size} + {stride} - 1) // {stride}) end)) as w
from {name}_pieces where len(pieces) > 0"""
    VIEWS[name] = rf"""
select * exclude (pieces, {text}, w, lead_chars),
  accession_number || ':s' || lpad(section_sequence::varchar, 4, '0') || ':c' || lpad((w + 1)::varchar, 4, '0') as chunk_id, w + 1 as chunk_sequence,
  {rstrip(f"array_to_string(pieces[w * {stride} + 1 : w * {stride} + {size}], '')")} as text,
  least(len(pieces) - w * {stride}, {size}) as token_count,
  start_offset + lead_chars + length(array_to_string(pieces[1 : w * {stride}], '')) as source_start,
  start_offset + lead_chars + length(array_to_string(pieces[1 : w * {stride}], '')) + length({rstrip(f"array_to_string(pieces[w * {stride} + 1 : w * {stride} + {size}], '')")}) as source_end
from {name}_spans"""


marker_views("x", "x_texts")

VIEWS["x_doc_sections"] = "select doc_id::varchar as accession_number, 1 as section_sequence, 10 as start_offset, text as body from documents"
chunk_views("x_doc_chunks", "x_doc_sections", "body", 64, 8)

VIEWS["x_chunk_meta"] = """
select c.*, f.cik, f.form_type, f.fiscal_year, f.fiscal_quarter, f.source_url, f.filing_date from x_chunks c join x_filings f using (filing_key)"""


def vector_views(name: str, source: str, key: str, text: str, d: int) -> None:
    VIEWS[name] = f"select {key}, {bucket('word', d)} as bucket, count(*) as cnt from (select {key}, unnest({words(text)}) as word from {source}) group by all"
    VIEWS[f"{name}_norm"] = f"select {key}, sqrt(sum(cnt * cnt)::double) as norm from {name} group by {key}"


vector_views("x_qv", "x_questions", "question_id", "question", K.DENSE_DIMENSIONS)
vector_views("x_cv", "x_chunks", "chunk_id", "text", K.DENSE_DIMENSIONS)
vector_views("x_qs", "x_questions", "question_id", "question", K.SPARSE_DIMENSIONS)
vector_views("x_cs", "x_chunks", "chunk_id", "text", K.SPARSE_DIMENSIONS)


def pair_views(name: str, qv: str, cv: str, filters) -> None:
    test = " and ".join(f"(q.{f} is null or q.{f} = c.{f})" for f in filters) or "true"
    VIEWS[f"{name}_pairs"] = f"""
select q.question_id, q.top_k, c.chunk_id, c.accession_number from x_questions q join x_chunk_meta c on q.accession_number = c.accession_number and {test}"""
    VIEWS[f"{name}_dots"] = f"""
select p.question_id, p.chunk_id, sum(a.cnt * b.cnt) as dot from {name}_pairs p join {qv} a using (question_id)
join {cv} b on b.chunk_id = p.chunk_id and b.bucket = a.bucket group by all"""
    VIEWS[f"{name}_scored"] = f"""
select p.*, coalesce(d.dot, 0)::double / (qn.norm * cn.norm) as score
from {name}_pairs p left join {name}_dots d using (question_id, chunk_id) join {qv}_norm qn using (question_id) join {cv}_norm cn on cn.chunk_id = p.chunk_id"""
    VIEWS[f"{name}_hits"] = f"""
select * from (select *, row_number() over (partition by question_id order by score desc, chunk_id) as rank from {name}_scored) where rank <= top_k"""


FILTERS = ("cik", "form_type", "fiscal_year", "fiscal_quarter", "section_type")
pair_views("x_plain", "x_qv", "x_cv", ())
pair_views("x_filtered", "x_qv", "x_cv", FILTERS)
pair_views("x_sparse", "x_qs", "x_cs", ())

_relative = "coalesce((score - min(score) over w) / nullif(max(score) over w - min(score) over w, 0), score)"
VIEWS["x_fused"] = f"""
select question_id, top_k, chunk_id, sum(part) as score from (
  select question_id, top_k, chunk_id, {_relative} * 0.5 as part from x_plain_hits window w as (partition by question_id)
  union all select question_id, top_k, chunk_id, {_relative} * 0.5 from x_sparse_hits window w as (partition by question_id)) group by all"""


def snippet_views(name: str, hits: str) -> None:
    """Candidates, scores and best snippet of a view with ``question_id, chunk_id, query, text``."""
    cands = (
        f"list_filter(list_concat(list_transform({fragments('text')}, lambda p: {squash('p')}), {windows('lines', 0, K.LINES_AHEAD)}, "
        f"{windows('lines', K.LINES_BEFORE_CENTRE, K.LINES_AFTER_CENTRE)}), lambda c: c <> '')"
    )
    VIEWS[f"{name}_lines"] = f"select *, {content_lines('text')} as lines, {terms('query')} as terms, {numeric_query('query')} as numeric_q from {hits}"
    VIEWS[f"{name}_lists"] = f"select question_id, chunk_id, terms, numeric_q, {targets('terms')} as targets, text, {cands} as found from {name}_lines"
    VIEWS[f"{name}_all"] = f"""
select question_id, chunk_id, terms, numeric_q, targets, text, unnest(found) as fragment, generate_subscripts(found, 1) - 1 as rawpos from {name}_lists"""
    VIEWS[f"{name}_first"] = f"""
select * exclude (n, text), row_number() over (partition by question_id, chunk_id order by rawpos) - 1 as pos from (
  select *, row_number() over (partition by question_id, chunk_id, {fold('fragment')} order by rawpos) as n from {name}_all) where n = 1"""
    toks = words("fragment")
    first5, first12 = (words(f"array_to_string(string_split(fragment, ' ')[1:{n}], ' ')") for n in (5, 12))
    VIEWS[f"{name}_scored"] = rf"""
select *, len(list_intersect(terms, list_distinct({toks}))) * 10.0::double
  + case when numeric_q and {number_evidence('fragment')} then 6 else 0 end + case when numeric_q and contains(fragment, '$') then 3 else 0 end
  + case when numeric_q and {overlap('targets', toks)} then 8 else 0 end + case when numeric_q and {overlap('targets', first12)} then 12 else 0 end
  + case when numeric_q then least(len(list_intersect(terms, list_distinct({first5}))), 3) * 5 else 0 end
  + case when length(fragment) between 60 and 480 then 2 else 0 end
  - case when numeric_q and regexp_matches(ltrim(fragment, '($ '), '^[\d%]') then 12 else 0 end
  - case when len(list_distinct({toks})) <= 3 then 12 else 0 end - case when {page_marker('fragment')} then 10 else 0 end as points
from {name}_first"""
    VIEWS[f"{name}_best"] = f"""
select question_id, chunk_id, fragment from (select *, row_number() over (partition by question_id, chunk_id order by points desc, pos) as n from {name}_scored) where n = 1"""
    VIEWS[f"{name}_snippets"] = f"""
select h.*, {clip('coalesce(b.fragment, h.text)', K.SNIPPET_CHARS)} as snippet from {hits} h left join {name}_best b using (question_id, chunk_id)"""


VIEWS["x_retrieved"] = "select h.*, c.text, c.section_type, c.section_name, q.question as query from x_plain_hits h join x_chunks c using (chunk_id) join x_questions q using (question_id)"
snippet_views("x_ret", "x_retrieved")

# ---- facts ---------------------------------------------------------------------------------------------

VIEWS["x_concepts"] = "select * from (values " + ", ".join(
    f"({q(key)}, {rank}, {q(concept)})" for key, _, concepts, _ in K.METRICS for rank, concept in enumerate(concepts)
) + ") t(metric, concept_rank, concept)"


def lookup_views(name: str, questions: str) -> None:
    VIEWS[f"{name}_requests"] = f"""
select *, {lookup_period('form_type', 'fiscal_quarter')} as fiscal_period from (
  select q.question_id, q.accession_number, f.cik, {match_metric('q.question')} as metric, coalesce(nullif(q.fiscal_year, 0), f.fiscal_year) as fiscal_year,
    coalesce(q.fiscal_quarter, f.fiscal_quarter) as fiscal_quarter, coalesce(nullif(q.form_type, ''), f.form_type) as form_type
  from {questions} q join x_filings f using (accession_number))"""
    def agree(*keys):
        return " and ".join(f"(r.{k} is null or r.{k} = f.{k})" for k in keys)

    VIEWS[f"{name}_matches"] = f"""
select r.question_id, c.concept_rank, f.*,
  case when {agree('fiscal_period')} and r.form_type = f.form_type and r.accession_number = f.accession_number then 1
       when {agree('fiscal_period')} and r.form_type = f.form_type then 2 else 3 end as tier
from {name}_requests r join x_concepts c using (metric) join x_facts f on f.cik = r.cik and f.concept = c.concept and {agree('fiscal_year', 'fiscal_quarter')}"""
    VIEWS[f"{name}_best"] = f"""
select * from (select *, row_number() over (partition by question_id order by tier, concept_rank, filed_date desc nulls last, ingest_seq desc, source_key desc) as n
from {name}_matches) where n = 1"""
    VIEWS[f"{name}_found"] = f"""
select r.question_id, r.metric, b.tier, b.concept, b.label, b.unit, b.value, b.fiscal_period, b.fiscal_year, b.fiscal_quarter, b.source_key,
  b.accession_number as fact_accession, b.question_id is not null as has_fact,
  case when r.metric is null then 'no_metric_match' when b.question_id is null then 'fact_not_found' end as lookup_reason
from {name}_requests r left join {name}_best b using (question_id)"""


lookup_views("x_look", "x_all_questions")

# ---- answers -----------------------------------------------------------------------------------------------


def answer_views(name: str, questions: str, hits: str) -> None:
    """The answering flow over a view of typed questions (``use_facts`` and ``query_type`` included)."""
    VIEWS[f"{name}_numeric"] = f"select * from {questions} where query_type = 'numeric' and use_facts"
    lookup_views(f"{name}_look", f"{name}_numeric")
    VIEWS[f"{name}_prepared"] = f"""
select q.*, l.question_id is not null as has_lookup, l.metric, l.concept, l.label, l.unit, l.value, l.fiscal_period as fact_period, l.fiscal_year as fact_year,
  l.fiscal_quarter as fact_quarter, l.source_key, l.fact_accession, coalesce(l.has_fact, false) as has_fact, l.lookup_reason,
  case when l.has_fact then concat_ws(' ', nullif(q.question, ''), {metric_attr('l.metric', LABELS)}, {metric_attr('l.metric', KEYWORDS)}, nullif(l.label, ''), l.concept, {fact_text('l.value')})
       else q.question end as query
from {questions} q left join {name}_look_found l using (question_id)
where q.query_type <> 'unsupported' and q.accession_number in (select accession_number from x_chunks)"""
    VIEWS[f"{name}_strong"] = f"""
select h.question_id, h.chunk_id, h.score, h.rank, c.text, c.section_name, c.section_type, c.source_url, c.source_start, c.source_end, c.accession_number, p.query, p.value, p.has_fact
from {hits} h join x_chunk_meta c using (chunk_id) join {name}_prepared p using (question_id) where h.score >= {K.MIN_SIMILARITY}"""
    snippet_views(f"{name}_sn", f"{name}_strong")
    large = number_tokens("snippet", K.LARGE_NUMBER_DIGITS)
    VIEWS[f"{name}_cited"] = f"""
select *, count(*) over (partition by question_id) as hit_count from (
select *, case when has_fact then {overlap(large, fact_tokens('value'))} else false end as supports from {name}_sn_snippets)"""
    VIEWS[f"{name}_kept"] = f"""
select * from (select *, bool_or(supports) over (partition by question_id) as any_support from {name}_cited) where supports or not any_support"""
    VIEWS[f"{name}_lists"] = f"""
select question_id, max(hit_count) as hit_count, list(snippet order by rank) as snippets, list(chunk_id order by rank) as chunk_ids, max(score) as best,
  list({{'chunk_id': chunk_id, 'section_name': section_name, 'source_url': source_url, 'snippet': snippet, 'section_type': section_type}} order by rank) as cites
from {name}_kept group by question_id"""
    VIEWS[f"{name}_counts"] = f"select question_id, count(*) as retrieval_count from {hits} group by question_id"
    observed = f"flatten(list_transform(snippets, lambda s: {number_tokens('s', K.LARGE_NUMBER_DIGITS)}))"
    VIEWS[f"{name}_status"] = f"""
select p.*, coalesce(l.hit_count, 0) as hit_count, coalesce(l.snippets, []) as snippets, coalesce(l.chunk_ids, []) as chunk_ids, l.best, l.cites,
  coalesce(c.retrieval_count, 0) as retrieval_count,
  case when has_lookup then case when not has_fact then 'unavailable' when len({observed}) > 0 and not {overlap(observed, fact_tokens('value'))} then 'mismatched' else 'validated' end end as status
from {name}_prepared p left join {name}_lists l using (question_id) left join {name}_counts c using (question_id)"""
    any_number = f"len(list_filter(snippets, lambda s: {number_evidence('s')})) > 0"
    no_change = f"len(list_filter(snippets, lambda s: contains({fold('s')}, 'no material changes'))) > 0"
    VIEWS[f"{name}_reasons"] = f"""
select *, case when hit_count = 0 then 'no_retrieved_evidence'
  when query_type = 'numeric' and not use_facts and not ({any_number}) then 'no_numeric_evidence'
  when query_type = 'numeric' and use_facts and status = 'unavailable' then coalesce(lookup_reason, 'structured_fact_unavailable')
  when query_type = 'numeric' and use_facts and status = 'mismatched' then 'numeric_fact_mismatch'
  when query_type = 'comparison' and hit_count < 2 and not ({no_change}) then 'not_enough_comparison_evidence' end as reason,
  list_filter(snippets, lambda s, i: list_position(list_transform(snippets, lambda z: {fold('z')}), {fold('s')}) = i) as uniq
from {name}_status"""
    label = period_label("fact_period", "fact_year", "fact_quarter")
    VIEWS[f"{name}_answers"] = f"""
select question_id, query_type, reason is null as supported,
  case when reason = 'no_metric_match' then {q(K.CLARIFY_METRIC_ANSWER)} when reason is not null then {q(K.INSUFFICIENT_ANSWER)}
    when query_type = 'numeric' and has_fact then 'The structured SEC fact for ' || {metric_attr('metric', LABELS)} || ' is ' || {fact_text('value')} || ' ' || unit || ' for ' || {label} || ' (XBRL concept: ' || concept || ').'
    when len(uniq) = 1 then {q(K.SINGLE_SNIPPET_PREFIX)} || uniq[1] else {q(K.MULTI_SNIPPET_PREFIX)} || array_to_string(uniq[1:{K.ANSWER_SNIPPETS}], ' ') end as answer,
  case when reason is not null then 0.0::double when query_type = 'numeric' and has_fact then 1.0::double else least(best, 1.0::double) end as confidence,
  chunk_ids, cites, retrieval_count, reason, status, metric, concept, case when has_fact then {fact_text('value')} end as value_text, unit, source_key, snippets,
  fact_period, fact_quarter, fact_year, fact_accession, has_lookup
from {name}_reasons
union all
select question_id, query_type, false, {q(K.UNSUPPORTED_ANSWER)}, 0.0::double, [], null, 0, 'unsupported_query_type', null, null, null, null, null, null, [], null, null, null, null, false
from {questions} where query_type = 'unsupported'"""


VIEWS["x_typed"] = f"select *, {classify('question')} as query_type, true as use_facts from x_questions"
answer_views("x_ask", "x_typed", "x_filtered_hits")

# ---- comparison ----------------------------------------------------------------------------------------------

VIEWS["s_texts"] = f"""
select doc_id as filing_key, lpad(regexp_replace(source, '[^0-9]', '', 'g'), 10, '0') as cik,
  lpad(regexp_replace(source, '[^0-9]', '', 'g'), 10, '0') || '-20-' || lpad(doc_id::varchar, 6, '0') as accession_number, lang as form_type,
  date '1900-01-01' + (doc_id // 2)::int as filing_date, 'https://example.org/' || doc_id as source_url, {with_headings('text', 'doc_id')} as text from documents"""
marker_views("s", "s_texts")
VIEWS["s_requests"] = f"""
select f.filing_key as pair_id, f.accession_number, {pick([t for t, _ in K.HEADING_RULES], 'f.filing_key')} as section_type,
  case when p.filing_key % 7 = 0 then p.accession_number when p.filing_key % 7 = 1 then 'none' end as explicit, (f.filing_key % 5 + 1) as max_claims
from s_texts f left join s_texts p on p.filing_key + 1 = f.filing_key"""


def previous_view(name: str, source: str) -> None:
    """Latest strictly earlier filing of the same company and form."""
    VIEWS[f"{name}_days"] = f"""
select cik, form_type, filing_date, lag(last_of_day) over (partition by cik, form_type order by filing_date) as previous
from (select cik, form_type, filing_date, max(accession_number) as last_of_day from {source} group by all)"""
    VIEWS[f"{name}_previous"] = f"""
select accession_number, previous as previous_accession_number from {source} join {name}_days using (cik, form_type, filing_date) where previous is not null"""


previous_view("x", "x_filings")
previous_view("s", "s_texts")
VIEWS["s_heads_of"] = """
select accession_number, section_type, min(section_sequence) as section_sequence, arg_min(section_name, section_sequence) as section_name from s_sections group by all"""
VIEWS["s_resolved"] = """
select r.pair_id, r.accession_number as current_accession, r.section_type, r.max_claims, k.accession_number as prior_accession,
  c.section_sequence as current_sequence, b.section_sequence as prior_sequence
from s_requests r left join s_previous p using (accession_number)
left join s_texts k on k.accession_number = coalesce(r.explicit, p.previous_accession_number)
left join s_heads_of c on c.accession_number = r.accession_number and c.section_type = r.section_type
left join s_heads_of b on b.accession_number = k.accession_number and b.section_type = r.section_type"""
VIEWS["s_pairs"] = """
select *, case when current_sequence is null then 'current_section_missing' when prior_accession is null then 'previous_filing_missing'
  when prior_sequence is null then 'prior_section_missing'
  when not exists (select 1 from s_chunks c where c.accession_number = current_accession and c.section_sequence = current_sequence)
    or not exists (select 1 from s_chunks c where c.accession_number = prior_accession and c.section_sequence = prior_sequence) then 'section_chunks_missing' end as reason
from s_resolved"""


def claim_views(name: str, source: str) -> None:
    VIEWS[f"{name}_claim_rows"] = f"""
select *, {claim_key('claim')} as claim_key from (
  select accession_number, section_sequence, chunk_id, unnest({claims('text')}) as claim, generate_subscripts({claims('text')}, 1) - 1 as claim_pos from {source})"""
    VIEWS[f"{name}_claims"] = f"""
select * exclude (n) from (select *, row_number() over (partition by accession_number, section_sequence, claim_key order by chunk_id, claim_pos) as n
from {name}_claim_rows where claim_key <> '') where n = 1"""


claim_views("x", "x_chunks")
claim_views("s", "s_chunks")
VIEWS["s_now"] = "select p.pair_id, c.* from s_pairs p join s_claims c on c.accession_number = p.current_accession and c.section_sequence = p.current_sequence where p.reason is null"
VIEWS["s_before"] = "select p.pair_id, c.* from s_pairs p join s_claims c on c.accession_number = p.prior_accession and c.section_sequence = p.prior_sequence where p.reason is null"
VIEWS["s_changes"] = """
select 'added' as change, n.* from s_now n where not exists (select 1 from s_before b where b.pair_id = n.pair_id and b.claim_key = n.claim_key)
union all select 'removed', b.* from s_before b where not exists (select 1 from s_now n where b.pair_id = n.pair_id and b.claim_key = n.claim_key)"""
VIEWS["s_counts"] = """
select p.pair_id, (select count(*) from s_changes c where c.pair_id = p.pair_id and change = 'added') as added_n,
  (select count(*) from s_changes c where c.pair_id = p.pair_id and change = 'removed') as removed_n,
  (select count(*) from s_now n join s_before b using (pair_id, claim_key) where n.pair_id = p.pair_id) as unchanged_n from s_pairs p where reason is null"""
VIEWS["s_listed"] = """
select pair_id, list(claim order by pos) filter (change = 'added') as added, list(claim order by pos) filter (change = 'removed') as removed,
  list('current/' || chunk_id order by pos) filter (change = 'added') as added_ids, list('prior/' || chunk_id order by pos) filter (change = 'removed') as removed_ids
from (select c.*, p.max_claims, row_number() over (partition by pair_id, change order by chunk_id, claim_pos) as pos from s_changes c join s_pairs p using (pair_id))
where pos <= max_claims group by pair_id"""
VIEWS["s_first"] = """
select pair_id, (select arg_min('current/' || chunk_id, (chunk_id, claim_pos)) from s_now n where n.pair_id = p.pair_id) as first_current,
  (select arg_min('prior/' || chunk_id, (chunk_id, claim_pos)) from s_before b where b.pair_id = p.pair_id) as first_prior from s_pairs p where reason is null"""

# ---- evaluation -------------------------------------------------------------------------------------------------

VIEWS["e_variants"] = "select * from (values " + ", ".join(
    f"({i}, {q(v)}, {str(f).lower()}, {str(x).lower()})"
    for i, (v, f, x, _) in enumerate(r for r in K.VARIANTS if r[0] in K.DEFAULT_VARIANTS)
) + ") t(variant_rank, variant, use_filters, use_facts)"
VIEWS["e_rows"] = f"""
select q.question_id as base_id, q.question_id || '|' || v.variant as question_id, q.question, q.accession_number, q.top_k, v.variant, v.variant_rank, v.use_facts,
  {', '.join(f'case when v.use_filters then q.{f} end as {f}' for f in FILTERS)}, {classify('q.question')} as query_type from x_questions q cross join e_variants v"""
VIEWS["e_searched"] = "select * from e_rows where variant <> 'closed_book'"
VIEWS["e_pairs"] = "select q.question_id, q.base_id, q.top_k, c.chunk_id from e_searched q join x_chunk_meta c on q.accession_number = c.accession_number and " + " and ".join(
    f"(q.{f} is null or q.{f} = c.{f})" for f in FILTERS
)
VIEWS["e_hits"] = """
select * from (select p.question_id, p.top_k, p.chunk_id, s.score, row_number() over (partition by p.question_id order by s.score desc, p.chunk_id) as rank
from e_pairs p join x_plain_scored s on s.question_id = p.base_id and s.chunk_id = p.chunk_id) where rank <= top_k"""
answer_views("e_ask", "e_searched", "e_hits")
VIEWS["e_predictions"] = f"""
select r.base_id, r.variant, r.variant_rank, r.accession_number, r.question, r.query_type, a.supported, a.answer, a.cites, a.chunk_ids, a.retrieval_count, a.reason, a.concept, a.value_text, a.unit,
  coalesce(a.has_lookup, false) as has_lookup, null::varchar as error from e_ask_answers a join e_rows r using (question_id)
union all
select base_id, variant, variant_rank, accession_number, question, query_type, false, case when query_type = 'unsupported' then {q(K.UNSUPPORTED_ANSWER)} else {q(K.INSUFFICIENT_ANSWER)} end,
  null, [], 0, case when query_type = 'unsupported' then 'unsupported_query_type' else 'closed_book_no_filing_context' end, null, null, null, false, null
from e_rows where variant = 'closed_book'
union all
select base_id, variant, variant_rank, accession_number, question, query_type, false, {q(K.INSUFFICIENT_ANSWER)}, null, [], 0, 'eval_variant_error', null, null, null, false,
  'No chunks found for filing: ' || accession_number
from e_searched where query_type <> 'unsupported' and accession_number not in (select accession_number from x_chunks)"""
VIEWS["e_expected"] = f"""
select p.*, p.query_type <> 'unsupported' as x_supported, case when base_id % 12 = 4 then ['Item', 'RISK'] else [] end as x_keywords,
  case when base_id % 4 = 1 then [p.accession_number || ':s0001:c0001', 'none'] else [] end as x_ids,
  case when base_id % 4 = 2 then ['business', 'business', 'mda'] else [] end as x_types,
  case when p.query_type = 'numeric' then ['Revenues'] else [] end as x_concepts,
  case when p.query_type = 'numeric' and base_id % 12 = 0 then {grouped('floor(f.amount)::bigint * 1000')} end as x_value,
  case when p.query_type = 'numeric' and base_id % 24 = 0 then 'USD' end as x_unit,
  case when p.query_type = 'unsupported' then 'unsupported_query_type' end as x_reason,
  p.answer || ' ' || coalesce(array_to_string(list_transform(p.cites, lambda c: c.snippet), ' '), '') as context,
  coalesce(list_transform(p.cites, lambda c: c.section_type), []) as types
from e_predictions p join x_filings f using (accession_number)"""


def share(expected: str, test: str) -> str:
    return f"(case when len({expected}) = 0 then 1.0::double else len(list_filter({expected}, lambda z: {test}))::double / len({expected}) end)"


def expected_tokens(e: str) -> str:
    n = f"try_cast({digits(e)} as hugeint)"
    return f"list_filter([nullif({digits(e)}, ''), " + ", ".join(f"case when {n} % {s} = 0 then ({n} // {s})::varchar end" for s in K.FACT_SCALES) + "], lambda t: t is not null)"


VIEWS["e_partial"] = f"""
select *, {share('x_keywords', f"contains({fold('context')}, {fold('z')})")} as keyword_match, {share('x_ids', 'list_contains(chunk_ids, z)')} as citation_recall,
  {share('x_types', 'list_contains(types, z)')} as section_recall,
  case when x_value is null and len(x_concepts) = 0 then -1.0::double
    when has_lookup and (x_value is null or {digits("coalesce(value_text, '')")} = {digits('x_value')}) and coalesce(list_contains(x_concepts, concept), false)
      and (x_unit is null or coalesce(unit = x_unit, false)) then 1.0::double else 0.0::double end as numeric_grounding_match,
  case when x_supported then -1.0::double when not supported and (x_reason is null or coalesce(reason = x_reason, false)) then 1.0::double else 0.0::double end as refusal_match
from e_expected"""
VIEWS["e_numeric"] = f"""
select *, case when x_value is null and len(x_concepts) = 0 then -1.0::double when numeric_grounding_match = 1 then 1.0::double when x_value is null then 0.0::double
  when {overlap(expected_tokens('x_value'), number_tokens('context'))} then 1.0::double else 0.0::double end as numeric_match from e_partial"""
VIEWS["e_scores"] = """
select *, case when error is not null then 0.0::double when not x_supported then refusal_match when not supported then 0.0::double
    when x_value is not null or len(x_concepts) > 0 then (numeric_match = 1)::int::double when len(x_keywords) > 0 then (keyword_match = 1)::int::double else 1.0::double end as answer_correct,
  (supported = x_supported)::int::double as supported_match, case when len(x_ids) > 0 then citation_recall else section_recall end as evidence_recall,
  (error is not null)::int::double as error_flag from e_numeric"""

METRIC_SQL = {
    "accuracy": "avg(answer_correct)", "supported_accuracy": "avg(supported_match)", "evidence_recall": "avg(evidence_recall)",
    "citation_recall": "avg(citation_recall)", "error_rate": "avg(error_flag)",
    "numeric_accuracy": "avg(case when numeric_match >= 0 then numeric_match end)",
    "numeric_grounding_accuracy": "avg(case when numeric_grounding_match >= 0 then numeric_grounding_match end)",
    "refusal_accuracy": "avg(case when refusal_match >= 0 then refusal_match end)",
}
VIEWS["e_metrics"] = "select variant, count(*) as questions, " + ", ".join(f"{e} as {n}" for n, e in METRIC_SQL.items()) + " from e_scores group by variant"
VIEWS["e_issuers"] = "select variant, substr(accession_number, 1, 10) as issuer, " + ", ".join(f"{e} as {n}" for n, e in METRIC_SQL.items()) + " from e_scores group by all"


def compose(final: str) -> str:
    """Prefix ``final`` with the views it needs, in definition order."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in set(re.findall(r"\b[a-z]_\w+", sql)) & VIEWS.keys():
            if name not in needed:
                needed.add(name)
                visit(VIEWS[name])

    visit(final)
    ctes = [f"{name} as ({sql})" for name, sql in _in_order(needed)]
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + final


def _in_order(needed: set[str]) -> list[tuple[str, str]]:
    placed: list[tuple[str, str]] = []
    done: set[str] = set()

    def place(name: str) -> None:
        if name in done:
            return
        done.add(name)
        for dep in sorted(set(re.findall(r"\b[a-z]_\w+", VIEWS[name])) & needed - {name}):
            place(dep)
        placed.append((name, VIEWS[name]))

    for name in sorted(needed):
        place(name)
    return placed
