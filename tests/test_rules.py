"""Refusal reasons, guards and snippets against plain Python statements of their rules."""

import itertools
import random
import re

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.operators import answering, guards, snippets

EVIDENCE = {"none": ["Plain words."], "number": ["It was 5 units."], "unchanged": ["There were NO Material Changes."]}


def expected_reason(kind, hits, shown, use_facts, status, lookup):
    if not hits:
        return "no_retrieved_evidence"
    if kind == "numeric":
        if not use_facts:
            return None if any(re.search(r"[$%]|\b\d", s) for s in shown) else "no_numeric_evidence"
        return {None: "no_metric_match", "unavailable": lookup or "structured_fact_unavailable", "mismatched": "numeric_fact_mismatch", "validated": None}[status]
    if kind == "comparison" and hits < 2 and not any("no material changes" in s.lower() for s in shown):
        return "not_enough_comparison_evidence"
    return None


def test_every_combination_of_the_reason_ladder(spark):
    cases = list(itertools.product(
        ("numeric", "comparison", "text"), (0, 1, 2), EVIDENCE, (True, False), (None, "unavailable", "mismatched", "validated"), (None, "fact_not_found"),
    ))
    rows = [(i, k, h, EVIDENCE[e] if h else [], u, s, r) for i, (k, h, e, u, s, r) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, kind string, hits int, shown array<string>, use_facts boolean, status string, lookup string")
    got = {r.i: r.reason for r in df.select("i", answering.insufficient_reason(*map(F.col, ("kind", "hits", "shown", "use_facts", "status", "lookup"))).alias("reason")).collect()}
    assert got == {i: expected_reason(*row) for i, *row in rows}


def keeps_quarter(text, quarter):
    return any(form in text for form in (f"q{quarter}", f"quarter {quarter}", f"{quarter}q"))


def expected_guard(answer, fact):
    text = answer.lower()
    if fact["status"] != "validated" or not fact["value"]:
        return "numeric_grounding_not_validated"
    if re.sub(r"\D", "", fact["value"]) not in re.sub(r"\D", "", answer):
        return "numeric_value_changed_or_omitted"
    unit = fact["unit"].lower()
    if not (any(w in text for w in ("usd", "$", "dollar")) if unit == "usd" else unit in text):
        return "numeric_unit_changed_or_omitted"
    years = set(re.findall(r"\b20\d\d\b", answer))
    kept = years == {str(fact["fiscal_year"])}
    if fact["fiscal_quarter"] is not None:
        kept = kept and keeps_quarter(text, fact["fiscal_quarter"])
    period = fact["fiscal_period"].lower()
    kept = kept and (any(w in text for w in ("fy", "fiscal ")) if period == "fy" else keeps_quarter(text, int(period[1:])))
    return None if kept else "numeric_period_changed_or_omitted"


def test_numeric_guard_on_random_answers(spark):
    rng = random.Random(5)
    parts = ["It was", "1,234", "1234", "12,345", "USD", "$", "dollars", "shares", "in", "FY", "fiscal year", "Q2", "quarter 2", "Q3", "2021", "2022", "2Q"]
    rows = []
    for i in range(400):
        fact = {
            "status": rng.choice(["validated", "validated", "validated", "mismatched"]), "value": rng.choice(["1,234", "1,234", ""]), "unit": rng.choice(["USD", "shares"]),
            "fiscal_year": 2021, "fiscal_quarter": rng.choice([None, 2]), "fiscal_period": rng.choice(["FY", "Q2"]),
        }
        words = ["1,234", "USD", "shares", "FY", "Q2", "2021"] if rng.random() < 0.6 else []
        words = [w for w in words if rng.random() < 0.9] + rng.sample(parts, rng.randint(0, 3))
        rows.append((i, " ".join(words), fact))
    schema = "i int, answer string, g struct<status: string, value: string, unit: string, fiscal_year: int, fiscal_quarter: int, fiscal_period: string>"
    df = spark.createDataFrame(rows, schema)
    got = {r.i: r.reason for r in df.select("i", guards.numeric_reason(F.col("answer"), F.col("g")).alias("reason")).collect()}
    want = {i: expected_guard(answer, fact) for i, answer, fact in rows}
    assert got == want and len(set(want.values())) == 5


def words_of(text):
    return re.findall(r"[a-z0-9][a-z0-9_\-]*", text.lower())


def fragment_points(fragment, question):
    terms = {w for w in words_of(question) if len(w) > 2 and w not in K.STOPWORDS}
    numbers = {t for t in terms if re.search(r"\d", t)}
    targets = {t for t in numbers if t.strip("0") and not re.fullmatch(r"(19|20)\d\d", t)} or numbers
    evidence = r"[$%]|\b\d+(\.\d+)?\b"
    numeric = bool(set(words_of(question)) & set(K.SNIPPET_NUMERIC_TOKENS)) or bool(re.search(evidence, question))
    tokens = set(words_of(fragment))
    lead = {n: set(words_of(" ".join(fragment.split(" ")[:n]))) for n in (5, 12)}
    points = 10.0 * len(terms & tokens)
    if numeric:
        points += 6 * bool(re.search(evidence, fragment)) + 3 * ("$" in fragment) + 8 * bool(targets & tokens) + 12 * bool(targets & lead[12])
        points += 5 * min(3, len(terms & lead[5])) - 12 * bool(re.match(r"[\d%]", fragment.lstrip("($ ")))
    return points + 2 * (60 <= len(fragment) <= 480) - 12 * (len(tokens) <= 3)


def test_fragment_scores(spark):
    rng = random.Random(2)
    vocabulary = "total revenue was $ 391,035 million 12 2021 net sales risk of supply and costs (5) % market".split()
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 25))), rng.choice(["How much revenue in 2021?", "Describe supply costs", "net sales of 391,035"])) for i in range(300)]
    scored = F.transform(snippets.scored(F.col("fragment"), F.col("_terms"), F.col("_numeric"), F.col("_targets")), lambda c: F.struct(c["fragment"], c["score"]))
    df = snippets._prepared(spark.createDataFrame(rows, "i int, fragment string, q string"), "q").select("i", "fragment", "q", scored.alias("found"))
    for row in df.collect():
        for fragment, score in row.found:
            assert score == fragment_points(fragment, row.q), (fragment, row.q)
