"""Column expressions against plain Python on small inputs."""

import hashlib
import math
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import coerce as C
from dossier.functions import numeric as N
from dossier.functions import text as T
from dossier.functions import vectors as V
from dossier.functions.html import extract_text
from dossier.operators import questions as Q
from dossier.operators.facts import match_metric

TEXTS = [
    "", "   ", "One.  Two!\nThree? four\n\n\nfive six", "Net sales rose 12.5% to $ 1,234.\n\nNo change\x1fhere   end.",
    "Größe Maß MASS größe\tstraße x_y-z 10-K", "A. B. C. A sentence that is long enough. tiny.",
]


def test_squash_and_words_follow_python(apply):
    assert apply(T.squash, TEXTS) == [" ".join(t.split()) for t in TEXTS]
    assert apply(T.words, TEXTS) == [re.findall(r"[A-Za-z0-9][A-Za-z0-9_\-]*", t.lower()) for t in TEXTS]


def test_claims_and_fragments_follow_python(apply):
    def py_claims(t):
        parts = [" ".join(p.split()) for p in re.split(r"(?<=[.!?])\s+|\n+", t)]
        return [p for p in parts if len(p) >= 8]

    assert apply(T.claims, TEXTS) == [py_claims(t) for t in TEXTS]
    assert apply(T.fragments, TEXTS) == [[p.strip() for p in re.split(r"(?<=[.!?])\s+|\n{2,}", t) if p.strip()] for t in TEXTS]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("Item 1. Business", "business"), ("ITEM 1A  RISK FACTORS and more", "risk_factors"),
        ("- Item 7. Management’s Discussion and Analysis", "mda"), ("Item 3 Legal Proceedings", "legal_proceedings"),
        ("Item 9A. Controls and Procedures", "controls"), ("Item 8. Financial Statements", "financial_statements"),
        ("Item 1. Businesses", None), ("See Item 1. Business", None), ("", None), ("Item 1. Business " + "x" * 180, None),
    ],
)
def test_headings(apply, line, expected):
    assert apply(lambda c: T.classify_heading(T.normalize_heading(c)), [line]) == [expected]


def test_html_is_read_like_a_page(apply):
    page = (
        "<html><head><style>p{}</style><script>var a='</p>';</script></head><body><h1>Title &amp;amp; more</h1>"
        "<p>One<br/>two</p> <b>a</b> <b>b</b><noscript>gone</noscript>&nbsp;end</body></html>"
    )
    assert apply(extract_text, [page, "plain &lt;x&gt;\r\n\r\n\r\n\r\ny  z ", None]) == ["Title & more\n\nOne\n\ntwo\nab end", "plain <x>\n\ny z", None]


def test_line_windows_cover_neighbours(apply):
    lines = [f"l{i}" for i in range(14)]
    got = apply(lambda c: T.line_windows(T.content_lines(c), 4, 7), ["\n".join(lines)])[0]
    assert got == [" ".join(lines[max(0, i - 4): i + 8]) for i in range(14)]


def test_clip_cuts_and_strips(apply):
    assert apply(lambda c: T.clip(c, 10), ["short", "exactly te", "seven   eleven twelve"]) == ["short", "exactly te", "seven e..."]


def test_count_vectors_match_hashing(apply):
    def py(text, d):
        counts = {}
        for w in re.findall(r"[a-z0-9][a-z0-9_\-]*", text.lower()):
            b = int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big") % d
            counts[b] = counts.get(b, 0) + 1
        norm = math.sqrt(sum(c * c for c in counts.values()))
        return sorted(counts), [counts[b] for b in sorted(counts)], norm

    for d in (K.DENSE_DIMENSIONS, K.SPARSE_DIMENSIONS):
        got = apply(lambda c: V.count_vector(c, d), TEXTS)
        assert [(g.idx, g.cnt, g.norm) for g in got] == [py(t, d) for t in TEXTS]
    dense = apply(lambda c: V.dense_values(V.count_vector(c)), TEXTS)
    assert dense[0] == [0.0] * 128
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in dense[2:])


def test_cosine_of_wordless_text_is_unknown(apply):
    assert apply(lambda c: V.cosine(V.count_vector(c), V.count_vector(F.lit("net sales"))), ["!!", "net sales"])[0] is None


def test_point_ids_are_version_5_uuids(apply):
    ids = ["a:s0001:c0001", "ü"]
    namespace = uuid.UUID(K.POINT_ID_NAMESPACE)
    assert apply(C.point_id, ids) == [str(uuid.uuid5(namespace, i)) for i in ids]


def test_identifiers(apply):
    assert apply(C.normalize_cik, ["320193", " CIK0000320193 ", "none", "12345678901"]) == ["0000320193", "0000320193", None, None]
    assert apply(C.undashed, [" 0000-24-1 ", " "]) == ["0000241", None]


def test_lenient_types(apply):
    assert apply(C.optional_int, [" 7 ", "x", ""]) == [7, None, None]
    assert [str(d) if d else None for d in apply(C.optional_date, ["2024-01-05", "2024-1-5", "2024-13-01"])] == ["2024-01-05", None, None]


def test_fiscal_calendar(spark):
    rows = [
        ("10-Q", "2025-12-27", "0926", None, None, 2026, 1), ("10-K", "2025-09-27", "0926", None, None, 2025, None),
        ("10-Q", "2024-06-29", "0928", None, "Q3", 2024, 3), ("10-Q", "2024-03-31", None, 2023, "Q9", 2023, 1),
        ("10-Q", "2024-09-10", "0928", None, None, 2024, 3), ("8-K", "2024-11-10", "1399", None, None, 2024, None),
    ]
    df = spark.createDataFrame(rows, "form string, d string, fye string, given int, fp string, y int, q int").withColumn("d", F.to_date("d"))
    out = df.select(
        "y", "q", C.fiscal_year(F.col("form"), F.col("d"), F.col("fye"), F.col("given")).alias("year"),
        C.fiscal_quarter(F.col("form"), F.col("d"), F.col("fye"), F.col("fp")).alias("quarter"),
    ).collect()
    assert [(r.year, r.quarter) for r in out] == [(r.y, r.q) for r in out]


def test_fact_values(apply):
    def value(c):
        return c.cast("decimal(38,6)")

    assert apply(lambda c: N.format_fact_value(value(c)), ["391035000000", "6.110000", "-1200", "0"]) == ["391,035,000,000", "6.11", "-1,200", "0"]
    tokens = apply(lambda c: F.sort_array(N.fact_tokens(value(c))), ["416161000000", "6.11"])
    assert tokens == [["416161", "416161000", "416161000000"], ["611"]]
    assert apply(N.large_number_tokens, ["was $416,161 in 2025 and 12,34"]) == [["416161"]]


PY_NUMERIC = set(K.NUMERIC_TOKENS)


def py_classify(question):
    text = " ".join(question.lower().split())
    tokens = set(re.findall(r"[a-z0-9][a-z0-9_\-]*", text))
    if any(p in text for p in K.UNSUPPORTED_PHRASES):
        return "unsupported"
    if tokens & set(K.COMPARISON_TOKENS):
        return "comparison"
    quantity = "$" in text or "%" in text
    for m in re.finditer(r"\b\d+(\.\d+)?\b", text):
        token = m.group(0)
        year = len(token) == 4 and token[:2] in ("19", "20")
        quarter = token in ("1", "2", "3", "4") and text[max(0, m.start() - 2): m.start()].strip() == "q"
        quantity = quantity or not (year or quarter)
    return "numeric" if tokens & PY_NUMERIC or quantity else "text"


def test_classification_matches_a_scan_in_python(apply):
    rng = random.Random(7)
    pool = ["q", "q1", "2", "3.5", "2024", "19.5", "10-K", "risk", "prior", "revenue", "shareholders", "Q 4", "q 5", "$", "3%", "iraq 1", "1.2.3", "what", "2024.5"]
    questions = [" ".join(rng.choices(pool, k=rng.randint(1, 4))) for _ in range(400)]
    assert apply(Q.classify, questions) == [py_classify(x) for x in questions]


def test_metric_matching_takes_the_first_metric(apply):
    asked = ["How much revenue?", "cost of sales", "What were SG&A costs?", "R&D spend", "diluted earnings per share", "costs of goods", "nothing here", "stock buybacks"]
    assert apply(match_metric, asked) == ["revenue", "revenue", "selling_general_and_administrative", "research_and_development", "net_income", "cost_of_sales", None, "share_repurchases"]


def test_target_numbers_prefer_values_over_years(apply):
    terms = ["revenue 2025 416 161", "fiscal 2025 000", "none"]
    got = apply(lambda c: Q.target_numbers(Q.query_terms(c)), terms)
    assert got == [["416", "161"], ["2025", "000"], []]


def test_batch_vectors_equal_the_expression(apply):
    texts = [*TEXTS, None, "", "İstanbul K-9 K _a a_b", " ".join(f"w{i % 7}" for i in range(500))]
    for d in (128, 32768):
        assert apply(lambda c: V.count_vectors(c, d), texts) == apply(lambda c: V.count_vector(c, d), texts)
