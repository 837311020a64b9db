"""Filing-shaped views of the benchmark tables.

customer -> companies, orders -> filings, documents -> filing text, lineitem and orders -> facts.
Every view is a projection or equi-join of whole tables; ``oracles.py`` states the same views in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import coerce as C
from dossier.functions.text import literals

# Heading lines put in front of every sixth line of a document, in rotation.
HEADINGS = [
    "Item 1. Business",
    "ITEM 1A.  Risk Factors",
    "  Item 7. Management's Discussion and Analysis of Results",
    "Item 3. Legal Proceedings.",
    "- Item 9A Controls and Procedures",
    "Item 8. Financial Statements",
]
LINES_PER_HEADING = 6

QUESTIONS = [
    "How much revenue did {name} report in {year}?",
    "What were operating expenses in Q 2 {year}?",
    "What changed in risk factors versus the prior filing?",
    "Should I buy shares of {name}?",
    "Describe the main products and services",
    "How much was spent on dividends?",
    "Explain net sales of {amount} dollars",
    "Which legal proceedings are disclosed in Q 3?",
    "Is 3.5 the margin of the R&D unit?",
    "Summarize controls and procedures",
    "What was net income for fiscal {year}?",
    "How did capex compare?",
]

CONCEPTS = [concept for _, _, concepts, _ in K.METRICS for concept in concepts]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows are costly to process: spread over ``spark.dossier.inputPartitions`` tasks where that is set.

    It is set for small files that one task would read; unset, the splits are those of the files.
    """
    df = table(spark, sf_dir, name)
    parts = int(spark.conf.get("spark.dossier.inputPartitions", "0"))
    return df.repartition(parts) if parts else df


def pick(values: list[str], key: Column) -> Column:
    """One of a fixed list by key."""
    return literals(values)[F.pmod(key, F.lit(len(values))).cast("int")]


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"),
        F.concat(F.substring("c_mktsegment", 1, 3), F.col("c_custkey").cast("string")).alias("ticker"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_nationkey") % 2 == 0, "NYSE").otherwise("Nasdaq").alias("exchange"),
        (F.col("c_nationkey") + 1000).cast("string").alias("sic"),
        year_end(F.col("c_custkey")).alias("fiscal_year_end"),
    )


def year_end(custkey: Column) -> Column:
    return F.concat(F.lpad((custkey % 12 + 1).cast("string"), 2, "0"), F.lit("28"))


def accession(custkey: Column, year: Column, orderkey: Column) -> Column:
    return F.format_string("%010d-%02d-%06d", custkey, year % 100, orderkey)


def form_of(priority: Column) -> Column:
    return F.when(priority == "1-URGENT", "10-K").when(priority == "5-LOW", "8-K").otherwise("10-Q")


def raw_filings(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    """Feed rows of every order before normalisation; with ``documents`` those that have one, with its other columns.

    Documents are joined to the few columns of the orders, before the longer ones are derived.
    """
    date = F.col("o_orderdate").cast("date")
    orders, others = spread_table(spark, sf_dir, "orders"), []
    if documents is not None:
        columns = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority"]
        others = [c for c in documents.columns if c != "doc_id"]
        orders = orders.select(*columns).join(documents, F.col("o_orderkey") == F.col("doc_id"))
    return orders.select(
        F.col("o_orderkey").alias("filing_key"),
        F.col("o_custkey").alias("company_key"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderstatus").alias("status"),
        F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"),
        accession(F.col("o_custkey"), F.year(date), F.col("o_orderkey")).alias("accession_number"),
        form_of(F.col("o_orderpriority")).alias("form_type"),
        date.alias("filing_date"),
        F.date_sub(date, 31).alias("report_date"),
        year_end(F.col("o_custkey")).alias("fiscal_year_end"),
        F.concat(F.lit("/f"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("primary_document"),
        *others,
    )


def filings(spark: SparkSession, sf_dir: str, documents: DataFrame | None = None) -> DataFrame:
    raw = raw_filings(spark, sf_dir, documents)
    form, report, year_end_ = F.col("form_type"), F.col("report_date"), F.col("fiscal_year_end")
    return raw.select(
        "filing_key", "company_key", "amount", "status", "cik", "accession_number", "form_type", "filing_date", "report_date",
        C.fiscal_year(form, report, year_end_, C.null_int()).alias("fiscal_year"),
        C.inferred_quarter(form, report, year_end_).alias("fiscal_quarter"),
        C.document_url(F.col("cik"), F.col("accession_number"), F.col("primary_document")).alias("source_url"),
        *([c for c in documents.columns if c != "doc_id"] if documents is not None else []),
    )


def with_headings(text: Column, key: Column) -> Column:
    """Put a heading line in front of every sixth line of a text."""
    return F.array_join(
        F.transform(
            F.split(text, "\n"),
            lambda line, i: F.when(
                i % LINES_PER_HEADING == 0,
                F.concat(pick(HEADINGS, F.floor(i / LINES_PER_HEADING) + key), F.lit("\n"), line),
            ).otherwise(line),
        ),
        "\n",
    )


def statement(amount: Column, status: Column) -> Column:
    """A sentence that quotes the filing's amount (status F), a different one (P), or none (O)."""
    return (
        F.when(status == "F", F.concat(F.lit("Total net sales were $ "), F.format_number(F.floor(amount), 0), F.lit(" in thousands.\n")))
        .when(status == "P", F.concat(F.lit("Total net sales were $ "), F.format_number(F.floor(amount) + 17, 0), F.lit(" in thousands.\n")))
        .otherwise(F.lit(""))
    )


def filing_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings that have a document: normalised text with headings and a numeric statement."""
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return filings(spark, sf_dir, docs).withColumn(
        "text",
        F.concat(statement(F.col("amount"), F.col("status")), with_headings(F.col("body"), F.col("filing_key"))),
    ).drop("body")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured facts: one revenue fact per filing, one fact per line item."""
    filed = filings(spark, sf_dir).select(
        "filing_key", "cik", "accession_number", "form_type", "fiscal_year", "fiscal_quarter", "filing_date", "amount"
    )
    period = C.lookup_period(F.col("form_type"), F.col("fiscal_quarter"))
    revenue = filed.select(
        "cik", "accession_number",
        F.lit("Revenues").alias("concept"),
        F.lit("USD").alias("unit"),
        (F.floor("amount") * 1000).cast("decimal(38,6)").alias("value"),
        period.alias("fiscal_period"),
        "fiscal_year", "fiscal_quarter", "form_type",
        F.col("filing_date").alias("filed_date"),
        F.lit(None).cast("string").alias("frame"),
        (F.col("filing_key") * 10).alias("ingest_seq"),
    )
    number = F.col("l_linenumber")
    items = spread_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate"
    ).join(filed, F.col("l_orderkey") == F.col("filing_key"))
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    detail = items.select(
        "cik",
        F.when(number != 3, F.col("accession_number")).alias("accession_number"),
        pick(CONCEPTS, F.col("l_partkey")).alias("concept"),
        F.lit("USD").alias("unit"),
        F.when(number % 2 == 1, F.floor(amount)).otherwise(amount).cast("decimal(38,6)").alias("value"),
        F.when(number == 4, F.lit("CY")).otherwise(period).alias("fiscal_period"),
        "fiscal_year", "fiscal_quarter", "form_type",
        F.when(number != 5, F.col("l_shipdate").cast("date")).alias("filed_date"),
        F.when(number == 6, F.concat(F.lit("CY"), F.col("fiscal_year").cast("string"))).alias("frame"),
        (F.col("l_orderkey") * 10 + number).alias("ingest_seq"),
    )
    rows = revenue.unionByName(detail).withColumn("label", F.concat(F.lit("Reported "), F.col("concept")))
    key = C.source_key({**{c: F.col(c) for c in rows.columns}, "value_text": F.col("value").cast("string")})
    return rows.withColumn("source_key", key)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per filing with a document, from a rotation of templates, and the benchmark's texts asked of filings."""
    derived = question_rows(filings(spark, sf_dir, table(spark, sf_dir, "documents").select("doc_id")))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item_text"))
    asked = derived.join(items, F.col("question_id") == F.col("item_id")).withColumns(
        {"question_id": -(F.col("item_id") + 1), "question": F.col("item_text")}
    )
    return derived.unionByName(asked.select(*derived.columns))


def all_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per filing, document or not."""
    return question_rows(filings(spark, sf_dir))


def question_rows(filed: DataFrame) -> DataFrame:
    key = F.col("filing_key")
    text = pick(QUESTIONS, key)
    for mark, value in (
        ("{name}", F.concat(F.lit("Company "), F.col("company_key").cast("string"))),
        ("{year}", F.col("fiscal_year").cast("string")),
        ("{amount}", F.format_number(F.floor("amount"), 0)),
    ):
        text = F.replace(text, F.lit(mark), value)
    return filed.select(
        key.alias("question_id"),
        text.alias("question"),
        "accession_number",
        (F.pmod(key, F.lit(5)) + 1).cast("int").alias("top_k"),
        F.when(key % 3 == 0, F.col("cik")).alias("cik"),
        F.when(key % 4 == 0, F.col("form_type")).alias("form_type"),
        F.when(key % 5 == 0, F.col("fiscal_year")).alias("fiscal_year"),
        F.when(key % 6 == 0, F.col("fiscal_quarter")).alias("fiscal_quarter"),
        F.when(key % 7 == 0, F.lit("risk_factors")).alias("section_type"),
    )
