"""Exact vector search and posting lists against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.vectors import cosine, count_vector
from dossier.operators import evaluation, search


def test_nearest_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [1.0, None] * 3), (950, [1.0, 2.0]), (951, [2.0, 1.0]), (952, []), (953, [1e300] * 6)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")

    def score(a, b):
        a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 9)

    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    want = []
    for i, v in good:
        if i % 50 == 0:
            best = sorted((-score(v, w), j) for j, w in good if len(w) == len(v))[:4]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    for sizes in ({}, {"tile": 37, "block": 3}):
        got = search.nearest(df.where("id % 50 = 0"), df, 4, **sizes)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert search.nearest(df.limit(0), df, 4).count() == 0 and search.nearest(df, df.limit(0), 4).count() == 0


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    chunks = [(f"f{i % 3}", f"c{i:04d}", " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 30)))) for i in range(400)]
    chunks += [("f0", "copy1", chunks[0][2]), ("f0", "copy2", chunks[0][2]), ("f1", "empty", ""), ("f9", "none", None)]
    index = spark.createDataFrame(chunks, "accession_number string, chunk_id string, text string")
    index = index.withColumn("sparse_vector", count_vector(F.col("text"), K.SPARSE_DIMENSIONS)).cache()
    asked = [(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 5))), f"f{i % 3}", rng.choice([1, 3, 20])) for i in range(30)]
    asked += [("all", chunks[0][2], "f0", 5), ("no", "unknown words", "f0", 5), ("nothing", "", "f1", 5), ("nowhere", "w1", "f7", 5)]
    return index, spark.createDataFrame(asked, "question_id string, question string, accession_number string, top_k int")


def test_posting_lists_equal_a_scan(spark, lists):
    index, questions = lists
    every = questions.withColumn("q", count_vector(F.col("question"), K.SPARSE_DIMENSIONS)).join(index, "accession_number")
    every = every.select("question_id", "top_k", "chunk_id", cosine(F.col("q"), F.col("sparse_vector")).alias("score")).where("score > 0")
    want = {}
    for r in every.collect():
        want.setdefault(r.question_id, []).append((-r.score, r.chunk_id, r.top_k))
    want = {k: [(c, -s) for s, c, top in sorted(v)[:v[0][2]]] for k, v in want.items()}
    for segment in (search.SEGMENT, 10):
        got = {}
        for r in search.retrieve_sparse(questions, index, search.build_postings(index, segment)).orderBy("rank").collect():
            got.setdefault(r.question_id, []).append((r.chunk_id, r.score))
        assert got == want


def test_lists_that_cannot_matter_are_not_read(spark, lists):
    index, _ = lists
    postings = search.build_postings(index)
    assert postings.count() == postings.select("accession_number", "bucket").distinct().count()
    # A chunk of one rare word answers a question for it and many frequent ones.
    rare = spark.createDataFrame([("f0", f"r{i}", "rare rare rare") for i in range(5)], "accession_number string, chunk_id string, text string")
    index = index.unionByName(rare.withColumn("sparse_vector", count_vector(F.col("text"), K.SPARSE_DIMENSIONS)))
    postings = search.build_postings(index)
    question = spark.createDataFrame([("q", "rare " * 30 + "w0 w1 w2", "f0", 5)], "question_id string, question string, accession_number string, top_k int")
    vector = question.select("*", count_vector(F.col("question"), K.SPARSE_DIMENSIONS).alias("v"))
    terms = vector.select("question_id", "accession_number", "top_k", F.col("v.norm").alias("norm"), F.explode(F.arrays_zip("v.idx", "v.cnt")).alias("e"))
    terms = terms.select("question_id", "accession_number", "top_k", "norm", F.col("e.idx").alias("bucket"), F.col("e.cnt").alias("cnt"))
    assert terms.count() == 4 and search.essential_terms(terms, postings).count() == 1
    assert {r.chunk_id for r in search.retrieve_sparse(question, index, postings).collect()} == {f"r{i}" for i in range(5)}


def test_headline_gives_both_means(spark):
    names = ("answer_correct", "supported_match", "evidence_recall", "citation_recall", "latency_ms", "error", "numeric_match", "numeric_grounding_match", "refusal_match")
    rows = [("a", "v", 1.0, 1.0), ("a", "v", 0.0, -1.0), ("a", "v", 0.0, -1.0), ("b", "v", 1.0, 0.0), ("b", "v", 1.0, 0.0), (None, "v", 0.0, -1.0)]
    scores = spark.createDataFrame(rows, "issuer string, variant string, correct double, numeric double")
    scores = scores.withColumns({n: F.col("numeric") if n == "numeric_match" else F.col("correct") for n in names})
    got = evaluation.headline(scores, ["accuracy", "numeric_accuracy"]).first()
    assert got.accuracy == pytest.approx((1 / 3 + 1 + 0) / 3) and got.pooled_accuracy == pytest.approx(0.5)
    assert got.numeric_accuracy == pytest.approx(0.5) and got.pooled_numeric_accuracy == pytest.approx(1 / 3)


def test_segments_give_the_lists_that_are_asked_for(spark, lists):
    """A filing's lists are one row, whose chunks are moved whole; retrieval from it equals that from all lists."""
    index, questions = lists
    whole = search.list_segments(index)
    assert sorted(r.accession_number for r in whole.collect()) == ["f0", "f1", "f2"]
    assert search.list_segments(index, 10).count() > 30 and search.list_segments(index.limit(0)).count() == 0
    every = search.build_postings(index).orderBy("accession_number", "bucket").collect()
    entries = {}
    for r in index.where("sparse_vector.norm > 0").select("accession_number", "chunk_id", "sparse_vector").collect():
        for b, c in zip(r.sparse_vector.idx, r.sparse_vector.cnt):
            entries.setdefault((r.accession_number, b), []).append((-c / r.sparse_vector.norm, r.chunk_id))
    assert {(r.accession_number, r.bucket): (r.most, r["head"], r.postings) for r in every} == {
        k: (-min(v)[0], [-w for w, _ in sorted(v)[: search.HEAD]], [c for _, c in sorted(v)]) for k, v in entries.items()
    }
    for segment in (search.SEGMENT, 10):
        found = [search.retrieve_sparse(questions, index, make(index, segment)) for make in (search.list_segments, search.build_postings)]
        assert sorted(map(tuple, found[0].collect())) == sorted(map(tuple, found[1].collect())) != []
