"""Best evidence snippet: candidate fragments and line windows, scored against a question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions.text import (
    NUMBER_EVIDENCE, any_contains, casefold, clip, content_lines, fragments, is_page_marker, let, line_windows,
    squash, words,
)
from dossier.operators.questions import is_numeric_query, query_terms, target_numbers


def candidates(text: Column, names: Sequence[str] = K.PAGE_MARKER_NAMES) -> Column:
    """Fragments, then forward line windows, then centred line windows, in collapsed form."""
    windows = let(
        content_lines(text, names),
        lambda ls: F.concat(
            line_windows(ls, 0, K.LINES_AHEAD), line_windows(ls, K.LINES_BEFORE_CENTRE, K.LINES_AFTER_CENTRE)
        ),
    )
    return F.filter(F.concat(F.transform(fragments(text), squash), windows), lambda c: c != "")


def distinct_candidates(text: Column, names: Sequence[str] = K.PAGE_MARKER_NAMES) -> Column:
    """``(pos, fragment)`` of the candidates in order: of those equal without regard to case only the first.

    Sorting by key puts equals side by side, so the work does not grow with the square of their number.
    """
    keyed = let(
        candidates(text, names),
        lambda found: F.array_sort(F.transform(
            found, lambda c, i: F.struct(casefold(c).alias("key"), i.cast("int").alias("pos"), c.alias("fragment"))
        )),
    )

    def first_of_equals(rows: Column) -> Column:
        return F.filter(rows, lambda row, i: (i == 0) | (rows[F.greatest(i - 1, F.lit(0))]["key"] != row["key"]))

    kept = F.array_sort(F.transform(let(keyed, first_of_equals), lambda row: F.struct(row["pos"], row["fragment"].alias("fragment"))))
    return F.transform(kept, lambda row, i: F.struct(i.cast("int").alias("pos"), row["fragment"].alias("fragment")))


def _first_words(fragment: Column, count: int) -> Column:
    return words(F.array_join(F.slice(F.split(fragment, " "), 1, count), " "))


def fragment_score(
    fragment: Column, terms: Column, numeric: Column, targets: Column, names: Sequence[str] = K.PAGE_MARKER_NAMES
) -> Column:
    """Additive relevance of a collapsed fragment to a question."""

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    def score(tokens: Column) -> Column:
        lead = F.least(F.size(F.array_intersect(terms, _first_words(fragment, 5))), F.lit(3))
        opening = F.ltrim(fragment, F.lit("($ "))
        return (
            F.size(F.array_intersect(terms, tokens)) * 10.0
            + points(numeric & fragment.rlike(NUMBER_EVIDENCE), 6.0)
            + points(numeric & F.contains(fragment, F.lit("$")), 3.0)
            + points(numeric & F.arrays_overlap(targets, tokens), 8.0)
            + points(numeric & F.arrays_overlap(targets, _first_words(fragment, 12)), 12.0)
            + F.when(numeric, lead * 5.0).otherwise(F.lit(0.0))
            + points(F.length(fragment).between(60, 480), 2.0)
            - points(numeric & opening.rlike(r"(?U)^[\d%]"), 12.0)
            - points(F.size(tokens) <= 3, 12.0)
            - points(is_page_marker(fragment, names), 10.0)
        )

    return let(F.array_distinct(words(fragment)), score)


def _prepared(hits: DataFrame, query: str) -> DataFrame:
    """``hits`` with the terms of the question; the names are ours alone."""
    return hits.withColumns({"_terms": query_terms(F.col(query)), "_numeric": is_numeric_query(F.col(query))}).withColumn(
        "_targets", target_numbers(F.col("_terms"))
    )


def scored(text: Column, terms: Column, numeric: Column, targets: Column, names: Sequence[str] = K.PAGE_MARKER_NAMES) -> Column:
    """``(pos, fragment, score)`` of every candidate of a text, as an array."""
    def rows(t: Column, n: Column, g: Column) -> Column:
        return F.transform(
            distinct_candidates(text, names),
            lambda c: F.struct(c["pos"].alias("pos"), c["fragment"].alias("fragment"), fragment_score(c["fragment"], t, n, g, names).alias("score")),
        )

    bound = F.struct(terms.alias("terms"), numeric.alias("numeric"), targets.alias("targets"))
    return let(bound, lambda q: rows(q["terms"], q["numeric"], q["targets"]))


def scored_candidates(hits: DataFrame, query: str = "query", names: Sequence[str] = K.PAGE_MARKER_NAMES) -> DataFrame:
    """Every candidate of every hit with its score; ``hits`` has ``question_id, chunk_id, text``."""
    found = scored(F.col("text"), F.col("_terms"), F.col("_numeric"), F.col("_targets"), names)
    return _prepared(hits, query).select("question_id", "chunk_id", F.explode(found).alias("c")).select(
        "question_id", "chunk_id", "c.pos", "c.fragment", "c.score"
    )


def best_snippets(hits: DataFrame, query: str = "query", names: Sequence[str] = K.PAGE_MARKER_NAMES) -> DataFrame:
    """Highest-scoring candidate per hit, earliest on ties, ellipsised; the whole text if there is none.

    The choice is made within the row: nothing is exploded, shuffled or joined.
    """
    found = scored(F.col("text"), F.col("_terms"), F.col("_numeric"), F.col("_targets"), names)
    best = F.array_max(F.transform(found, lambda c: F.struct(c["score"], -c["pos"], c["fragment"].alias("fragment"))))
    return _prepared(hits, query).withColumn("snippet", clip(F.coalesce(best["fragment"], F.col("text")), K.SNIPPET_CHARS)).drop(
        "_terms", "_numeric", "_targets"
    )


def has_numeric_evidence(snippets: Column) -> Column:
    return F.exists(snippets, lambda s: s.rlike(NUMBER_EVIDENCE))


def has_no_material_change(snippets: Column) -> Column:
    return F.exists(snippets, lambda s: any_contains(casefold(s), ["no material changes"]))


def distinct_snippets(snippets: Column) -> Column:
    """First occurrence of each snippet, ignoring case (at most ``top_k`` per question)."""
    return let(
        F.transform(snippets, casefold),
        lambda keys: F.filter(snippets, lambda _, i: F.array_position(keys, keys[i]) == i + 1),
    )


