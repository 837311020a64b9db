"""Text expressions: whitespace, tokens, headings, claims, fragments and line windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier import constants as K

# Unicode white space plus the four ASCII separators that also count as white space.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"
# The same characters one by one: trimming by them needs no pattern, which would look at every character.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Line terminators that are left after text normalisation; each is one character long.
EOL = r"\n\x1c-\x1e\x85\u2028\u2029"
SENTENCE_END = r"(?<=[.!?])"
NUMBER_EVIDENCE = r"(?U)[$%]|\b\d+(\.\d+)?\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Lambda bodies re-evaluate whatever outer expression they mention for every array element;
    binding the value as a lambda variable avoids that.
    """
    return F.transform(F.array(value), body)[0]


def squash(text: Column) -> Column:
    """Collapse white-space runs to one space and trim."""
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACES))


def casefold(text: Column) -> Column:
    """Lower case, with the letters whose full case folding is another than that."""
    folded = F.lower(text)
    for letter, fold in K.FOLDS:
        folded = F.replace(folded, F.lit(letter), F.lit(fold))
    return folded


def words(text: Column) -> Column:
    """Search tokens: a letter or digit followed by letters, digits, ``_`` or ``-``."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9][a-z0-9_\-]*)"), 1)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def clip(text: Column, max_chars: int) -> Column:
    """Collapse white space, then cut to ``max_chars`` with a trailing ellipsis."""
    return let(
        squash(text),
        lambda t: F.when(F.length(t) <= max_chars, t).otherwise(
            F.concat(rstrip(F.substring(t, 1, max_chars - 3)), F.lit("..."))
        ),
    )


def looks_like_html(document: Column) -> Column:
    return F.lower(F.substring(document, 1, 500)).rlike("<html|<body|</")


def normalize_layout(text: Column) -> Column:
    """Line ends, blanks and blank lines in canonical form (entities already resolved)."""
    text = F.translate(text, "\u00a0", " ")
    text = F.regexp_replace(text, r"\r\n|\r", "\n")
    text = F.regexp_replace(text, r"[ \t\f\x0B]+", " ")
    text = F.regexp_replace(text, r" *\n *", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def normalize_heading(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(line, "\u00a0", " "), f"(?U){SPACE}+", " "), F.lit(" .:-\t"))


def classify_heading(heading: Column) -> Column:
    """Section type of a normalised heading, or null."""
    ladder = F.when((heading == "") | (F.length(heading) > K.MAX_HEADING_CHARS), F.lit(None).cast("string"))
    for section_type, pattern in K.HEADING_RULES:
        ladder = ladder.when(heading.rlike(f"(?iU){pattern}"), F.lit(section_type))
    return ladder


def claims(text: Column) -> Column:
    """Sentence- or line-sized statements of at least the minimum length."""
    parts = F.split(text, rf"(?U){SENTENCE_END}{SPACE}+|\n+")
    return F.filter(F.transform(parts, squash), lambda c: F.length(c) >= K.MIN_CLAIM_CHARS)


def claim_key(claim: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(claim), "[^a-z0-9]+", " "))


def fragments(text: Column) -> Column:
    """Evidence fragments: split after sentence ends or at blank lines (not at single line ends)."""
    parts = F.split(text, rf"(?U){SENTENCE_END}{SPACE}+|\n{{2,}}")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def is_page_marker(text: Column, names: Sequence[str] = K.PAGE_MARKER_NAMES) -> Column:
    return let(
        casefold(text),
        lambda t: (F.contains(t, F.lit("form 10-")) & F.contains(t, F.lit("|"))) | t.isin(list(names)),
    )


def content_lines(text: Column, names: Sequence[str] = K.PAGE_MARKER_NAMES) -> Column:
    """Non-blank lines in collapsed form, without page markers."""
    lines = F.transform(F.split(text, rf"\r\n|[\r\x0B\f{EOL}]"), squash)
    return F.filter(lines, lambda line: (line != "") & ~is_page_marker(line, names))


def line_windows(lines: Column, before: int, after: int) -> Column:
    """For every line, the run of lines from ``before`` above to ``after`` below, joined."""
    return let(
        lines,
        lambda ls: F.transform(
            ls,
            lambda _, i: let(
                F.greatest(i - F.lit(before), F.lit(0)),
                lambda start: F.array_join(F.slice(ls, start + 1, i - start + F.lit(after + 1)), " "),
            ),
        ),
    )


def any_contains(text: Column, needles: Sequence[str]) -> Column:
    """True when any of the fixed phrases occurs in ``text`` (already case-normalised)."""
    return text.rlike("|".join(rf"\Q{needle}\E" for needle in needles))


def literals(values: Sequence[str]) -> Column:
    """A constant array of strings (built as one expression, folded once)."""
    return F.expr("array(" + ", ".join(quoted(v) for v in values) + ")")


def quoted(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
