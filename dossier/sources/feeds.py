"""Company feeds (JSON) to company, filing and fact rows.

Fetching over the network is not part of the engine: it reads the cache layout a fetcher leaves behind
(``submissions/CIK*.json``, ``companyfacts/CIK*.json``, ``filings/<cik>/<accession>/<document>``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier import constants as K
from dossier import schemas
from dossier.functions import coerce as C
from dossier.operators.upserts import first_per_group

RECENT = ("accessionNumber", "form", "filingDate", "reportDate", "primaryDocument", "fy", "fp")


def read_submissions(spark: SparkSession, cache_dir: str) -> DataFrame:
    """Payloads with the time and path of their file, by which the last one of a company is known."""
    rows = spark.read.schema(schemas.SUBMISSIONS).option("multiLine", True).json(f"{cache_dir}/submissions")
    return rows.select("*", F.col("_metadata.file_modification_time").alias("loaded_at"), F.col("_metadata.file_path").alias("loaded_from"))


def read_company_facts(spark: SparkSession, cache_dir: str) -> DataFrame:
    return spark.read.schema(schemas.COMPANY_FACTS).option("multiLine", True).json(f"{cache_dir}/companyfacts")


# So many documents are opened by name; more are read as a folder and matched by path.
NAMED_DOCUMENTS = 1000


def list_documents(spark: SparkSession, cache_dir: str) -> DataFrame:
    """``path, document_key`` of every cached document; the key is ``<cik>/<accession digits>/<name>``. Opens no file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{cache_dir}/filings")
    return files.select("path", F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("document_key"))


def read_documents(spark: SparkSession, cache_dir: str, wanted: DataFrame) -> DataFrame:
    """``path, content`` of the wanted documents (a column ``path``).

    A bounded number of them is opened by name, so a request for one filing opens one file. Files that are
    gone are not in the result.
    """
    few = [row.path for row in wanted.select("path").distinct().limit(NAMED_DOCUMENTS + 1).collect()]
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    if not few:
        return spark.createDataFrame([], "path string, content string")
    reader = spark.read.option("wholetext", True).option("ignoreMissingFiles", True)
    if len(few) <= NAMED_DOCUMENTS:
        there = [p for p in few if exists(spark, p)]
        if not there:
            return spark.createDataFrame([], "path string, content string")
        return reader.text(there).select(path.alias("path"), F.col("value").alias("content"))
    files = reader.option("recursiveFileLookup", True).text(f"{cache_dir}/filings").select(path.alias("path"), F.col("value").alias("content"))
    return files.join(wanted.select("path").distinct(), "path", "left_semi")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def document_key(cik: Column, accession_number: Column, primary_document: Column) -> Column:
    return F.concat_ws("/", cik, C.undashed(accession_number), primary_document)


def normalize_companies(submissions: DataFrame) -> DataFrame:
    """One company per payload; payloads without a usable identifier are dropped."""
    cik = C.normalize_cik(F.col("cik"))
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.nullif(F.col("entityName"), F.lit("")), F.concat(F.lit("CIK "), cik))
    return submissions.select(
        cik.alias("cik"),
        C.first_non_empty(F.col("tickers")).alias("ticker"),
        name.alias("name"),
        C.first_non_empty(F.col("exchanges")).alias("exchange"),
        C.optional_string(F.col("sic")).alias("sic"),
        C.optional_string(F.col("fiscalYearEnd")).alias("fiscal_year_end"),
        *[c for c in ("loaded_at", "loaded_from") if c in submissions.columns],
    ).where(F.col("cik").isNotNull())


def transpose_recent(submissions: DataFrame, columns: Sequence[str] = RECENT) -> DataFrame:
    """Parallel arrays to rows; shorter arrays leave their missing cells null. Keeps source order in ``position``."""
    recent = F.col("filings.recent")
    zipped = F.arrays_zip(*[F.coalesce(recent[c], F.array()).alias(c) for c in columns])
    return submissions.select("cik", "fiscalYearEnd", F.posexplode(zipped).alias("position", "_r")).select(
        "cik", "fiscalYearEnd", "position", *[F.col("_r")[c].alias(c) for c in columns]
    )


def normalize_filings(
    rows: DataFrame,
    form_types: Sequence[str] = K.DEFAULT_FORMS,
    limit: int | None = None,
    archives_base_url: str = K.ARCHIVES_BASE_URL,
) -> DataFrame:
    """Transposed feed rows to filings: wanted forms with all required fields, in source order.

    ``limit`` keeps the first filings per company after these filters.
    """
    year_end = C.optional_string(F.col("fiscalYearEnd"))
    form, report = C.optional_string(F.col("form")), C.optional_date(F.col("reportDate"))
    cik = C.normalize_cik(F.col("cik"))
    accession, document = C.optional_string(F.col("accessionNumber")), C.optional_string(F.col("primaryDocument"))
    kept = rows.select(
        accession.alias("accession_number"),
        cik.alias("cik"),
        form.alias("form_type"),
        C.optional_date(F.col("filingDate")).alias("filing_date"),
        report.alias("report_date"),
        C.fiscal_year(form, report, year_end, C.optional_int(F.col("fy"))).alias("fiscal_year"),
        C.fiscal_quarter(form, report, year_end, C.optional_string(F.col("fp"))).alias("fiscal_quarter"),
        document.alias("primary_document"),
        C.document_url(cik, accession, document, archives_base_url).alias("source_url"),
        "position",
    ).where(
        F.col("form_type").isin(list(form_types))
        & F.col("cik").isNotNull()
        & F.col("accession_number").isNotNull()
        & F.col("primary_document").isNotNull()
        & F.col("filing_date").isNotNull()
    )
    if limit is not None:
        kept = first_per_group(kept.withColumnRenamed("position", "source_position"), "cik", "source_position", limit)
        kept = kept.drop("position").withColumnRenamed("source_position", "position")
    return kept


def flatten_facts(payloads: DataFrame, concepts: Sequence[str] | None = None, load: int = 0) -> DataFrame:
    """Nested facts to rows; values that are not numbers are dropped.

    ``ingest_seq`` holds the number of the load and the positions of taxonomy, concept, unit and value in the payload. It
    is ordered like them, for the "last ingested wins" rule, whatever the sizes are.
    """
    by_concept = payloads.select(
        C.normalize_cik(F.col("cik")).alias("cik"), F.posexplode("facts").alias("p1", "taxonomy", "by_concept")
    ).select("cik", "p1", F.posexplode("by_concept").alias("p2", "concept", "payload"))
    if concepts:
        by_concept = by_concept.where(F.col("concept").isin(list(concepts)))
    by_unit = by_concept.select(
        "cik", "p1", "p2", "concept", C.optional_string(F.col("payload.label")).alias("label"),
        F.posexplode("payload.units").alias("p3", "unit", "reported"),
    )
    rows = by_unit.select("cik", "p1", "p2", "p3", "concept", "label", "unit", F.posexplode("reported").alias("p4", "r"))
    typed = rows.select(
        "cik",
        C.optional_string(F.col("r.accn")).alias("accession_number"),
        "concept", "label", "unit",
        C.optional_decimal(F.col("r.val")).alias("value"),
        F.trim("r.val").alias("value_text"),
        C.optional_string(F.col("r.fp")).alias("fiscal_period"),
        C.optional_int(F.col("r.fy")).alias("fiscal_year"),
        C.quarter_of_period(C.optional_string(F.col("r.fp"))).alias("fiscal_quarter"),
        C.optional_string(F.col("r.form")).alias("form_type"),
        C.optional_date(F.col("r.filed")).alias("filed_date"),
        C.optional_string(F.col("r.frame")).alias("frame"),
        F.array(F.lit(load), "p1", "p2", "p3", "p4").cast("array<bigint>").alias("ingest_seq"),
    ).where(F.col("value").isNotNull())
    return typed.withColumn("source_key", C.source_key({c: F.col(c) for c in typed.columns})).drop("value_text")
