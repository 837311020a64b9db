"""Lenient typing of source values, identifiers and the fiscal calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import digits, let, strip

def null_int() -> Column:
    return F.lit(None).cast("int")


def optional_string(value: Column) -> Column:
    return F.nullif(strip(value.cast("string")), F.lit(""))


def optional_int(value: Column) -> Column:
    return strip(value.cast("string")).try_cast("int")


def optional_date(value: Column) -> Column:
    text = optional_string(value)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def optional_decimal(value: Column) -> Column:
    return strip(value.cast("string")).try_cast("decimal(38,6)")


def first_non_empty(values: Column) -> Column:
    return F.get(F.filter(F.transform(values, optional_string), lambda v: v.isNotNull()), 0)


def normalize_cik(value: Column) -> Column:
    """Ten-digit identifier; null marks a value with no digits or more than ten."""
    found = digits(value.cast("string"))
    return F.when(F.length(found).between(1, 10), F.lpad(found, 10, "0"))


def require(value: Column, message: str) -> Column:
    """``value``, or a query error when it is null (strict mode)."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def undashed(accession_number: Column) -> Column:
    return F.nullif(F.replace(F.trim(accession_number), F.lit("-"), F.lit("")), F.lit(""))


def document_url(cik: Column, accession_number: Column, primary_document: Column, base: str = K.ARCHIVES_BASE_URL) -> Column:
    document = F.nullif(F.ltrim(F.trim(primary_document), F.lit("/")), F.lit(""))
    return F.concat(
        F.lit(base.rstrip("/") + "/edgar/data/"),
        normalize_cik(cik).try_cast("bigint").cast("string"),
        F.lit("/"),
        undashed(accession_number),
        F.lit("/"),
        document,
    )


def year_end_month(fiscal_year_end: Column) -> Column:
    """Month of an ``MMDD`` year end, or null when it is not a plausible month and day."""
    return F.when(
        fiscal_year_end.rlike(r"^\d{4}$")
        & F.substring(fiscal_year_end, 1, 2).try_cast("int").between(1, 12)
        & F.substring(fiscal_year_end, 3, 2).try_cast("int").between(1, 31),
        F.substring(fiscal_year_end, 1, 2).try_cast("int"),
    )


def quarter_of_period(fiscal_period: Column) -> Column:
    return F.when(fiscal_period.rlike(r"^Q[1-4]$"), F.substring(fiscal_period, 2, 1).try_cast("int"))


def fiscal_year(form_type: Column, report_date: Column, fiscal_year_end: Column, source_year: Column) -> Column:
    """The feed's year if given, else derived from the report date and the year end."""
    month = year_end_month(fiscal_year_end)
    day = F.substring(fiscal_year_end, 3, 2).try_cast("int")
    past_year_end = (F.month(report_date) > month) | ((F.month(report_date) == month) & (F.dayofmonth(report_date) > day))
    return (
        F.when(source_year.isNotNull(), source_year)
        .when(report_date.isNull(), null_int())
        .when((form_type != "10-K") & month.isNotNull() & past_year_end, F.year(report_date) + 1)
        .otherwise(F.year(report_date))
        .cast("int")
    )


def inferred_quarter(form_type: Column, report_date: Column, fiscal_year_end: Column) -> Column:
    """Quarter of a quarterly report counted from its year end; the calendar quarter otherwise."""
    offset = F.pmod(F.month(report_date) - year_end_month(fiscal_year_end), F.lit(12))
    return F.when(
        (form_type == "10-Q") & report_date.isNotNull(),
        F.when(offset > 0, F.least(F.floor((offset - 1) / 3) + 1, F.lit(3))).otherwise(F.quarter(report_date)),
    ).cast("int")


def fiscal_quarter(form_type: Column, report_date: Column, fiscal_year_end: Column, fiscal_period: Column) -> Column:
    return F.coalesce(quarter_of_period(fiscal_period), inferred_quarter(form_type, report_date, fiscal_year_end))


def lookup_period(form_type: Column, quarter: Column) -> Column:
    """Fiscal period to look a fact up under."""
    return F.when(form_type == "10-K", F.lit("FY")).when(quarter.isNotNull(), F.concat(F.lit("Q"), quarter.cast("string")))


def period_label(fiscal_period: Column, year: Column, quarter: Column) -> Column:
    has_period = F.coalesce(fiscal_period, F.lit("")) != ""
    return (
        F.when(has_period & year.isNotNull(), F.concat_ws(" ", fiscal_period, year.cast("string")))
        .when(has_period, fiscal_period)
        .when(quarter.isNotNull() & year.isNotNull(), F.concat(F.lit("Q"), quarter.cast("string"), F.lit(" "), year.cast("string")))
        .when(year.isNotNull(), F.concat(F.lit("FY "), year.cast("string")))
        .otherwise(F.lit("the matched period"))
    )


def source_key(fact: dict[str, Column]) -> Column:
    """SHA-256 of the compact JSON of the ten identifying fields, keys sorted, nulls kept."""
    payload = F.struct(
        fact["accession_number"].alias("accession_number"),
        fact["cik"].alias("cik"),
        fact["concept"].alias("concept"),
        F.date_format(fact["filed_date"], "yyyy-MM-dd").alias("filed_date"),
        fact["fiscal_period"].alias("fiscal_period"),
        fact["fiscal_year"].cast("int").alias("fiscal_year"),
        fact["form_type"].alias("form_type"),
        fact["frame"].alias("frame"),
        fact["unit"].alias("unit"),
        fact["value_text"].alias("value"),
    )
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


def point_id(chunk_id: Column) -> Column:
    """Name-based (version 5) UUID of a chunk id within the fixed namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(K.POINT_ID_NAMESPACE.replace("-", ""))), F.encode(chunk_id, "UTF-8")))
    # Version nibble is 5; the variant nibble keeps its two low bits and sets the two high ones.
    return let(
        digest,
        lambda h: F.concat_ws(
            "-",
            F.substring(h, 1, 8),
            F.substring(h, 9, 4),
            F.concat(F.lit("5"), F.substring(h, 14, 3)),
            F.concat(F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"), F.substring(h, 18, 3)),
            F.substring(h, 21, 12),
        ),
    )
