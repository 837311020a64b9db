"""Named queries against their SQL statements on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from dossier.plans import corpus
from tools.check_oracles import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUICK = (
    "html_extract", "filing_sections", "chunk_windows", "query_classify", "metric_match", "sparse_embed", "hybrid_topk", "fiscal_calendar",
    "filing_rows", "facts_flatten", "upsert_counts", "ordered_filings", "previous_filing", "compare_sections", "guard_checks", "eval_scores",
)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return connect(SF_DIR)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, name):
    ok, note = compare(spark, duck, name, SF_DIR)
    assert ok, note


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_documents_meet_the_orders_before_longer_columns_are_derived(spark, tmp_path):
    """Only the columns of the orders that a filing is made of are moved to the documents."""
    orders = [(1, 7, 10.5, "F", "1998-01-02", "1-URGENT"), (2, 8, 20.5, "O", "1998-01-03", "5-LOW")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderdate string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, "one"), (1, "again"), (3, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "asked")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts, asked = corpus.filing_texts(spark, str(tmp_path)), corpus.questions(spark, str(tmp_path))
    assert sorted(r.text.split("\n")[-1] for r in texts.collect()) == ["again", "one"]
    assert sorted(r.question_id for r in asked.collect()) == [-2, -2, 1, 1]
    for view in (texts, asked):
        plan = view._jdf.queryExecution().optimizedPlan().toString().split("\n")
        joins = [i for i, line in enumerate(plan) if "Join Inner" in line and "o_orderkey" in line]
        derived = [i for i, line in enumerate(plan) if "format_string" in line]
        assert joins and derived and not any(all(j < i for j in joins) and "format_string" in plan[i] for i in derived if i > max(joins))
