"""Question classification and query terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import NUMBER_EVIDENCE, any_contains, let, literals, squash, words

_NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"
# A quarter number set off by "q " does not count as a quantity.
_SPACED_QUARTER = r"(?U)(?<=q )[1-4]\b(?!\.\d+\b)"


def has_quantity(normalized: Column) -> Column:
    """A ``$`` or ``%``, or a number that is neither a 19xx/20xx year nor a quarter."""
    numbers = F.regexp_extract_all(F.regexp_replace(normalized, _SPACED_QUARTER, "#"), F.lit(_NUMBER), 0)
    quantity = F.exists(numbers, lambda n: ~((F.length(n) == 4) & (n.startswith("19") | n.startswith("20"))))
    return normalized.rlike("[$%]") | quantity


def classify(question: Column) -> Column:
    """``unsupported`` before ``comparison`` before ``numeric`` before ``text``."""

    def ladder(text: Column) -> Column:
        return let(
            words(text),
            lambda tokens: F.when(any_contains(text, K.UNSUPPORTED_PHRASES), F.lit("unsupported"))
            .when(F.arrays_overlap(tokens, literals(K.COMPARISON_TOKENS)), F.lit("comparison"))
            .when(F.arrays_overlap(tokens, literals(K.NUMERIC_TOKENS)) | has_quantity(text), F.lit("numeric"))
            .otherwise(F.lit("text")),
        )

    return let(squash(F.lower(question)), ladder)


def query_terms(question: Column) -> Column:
    """Distinct words of at least three characters that are not stop words."""
    return F.filter(
        F.array_distinct(words(question)), lambda w: (F.length(w) > 2) & ~w.isin(K.STOPWORDS)
    )


def is_numeric_query(question: Column) -> Column:
    return F.arrays_overlap(words(question), literals(K.SNIPPET_NUMERIC_TOKENS)) | question.rlike(NUMBER_EVIDENCE)


def target_numbers(terms: Column) -> Column:
    """Terms with digits, without years and all-zero terms unless nothing else remains."""

    def choose(numeric: Column) -> Column:
        return let(
            F.filter(
                numeric,
                lambda t: (F.btrim(t, F.lit("0")) != "")
                & ~((F.length(t) == 4) & (t.startswith("19") | t.startswith("20"))),
            ),
            lambda target: F.when(F.size(target) > 0, target).otherwise(numeric),
        )

    return let(F.filter(terms, lambda t: t.rlike("[0-9]")), choose)
