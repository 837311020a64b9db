"""Personal data behind disguises: text is normalised with offsets kept, searched, and mapped back."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import bounded_batches, free_names, named, ship

ship(__name__)

KINDS = ("email", "ip", "card", "phone")
SPAN = "struct<kind:string,start:long,end:long>"

# Letters of other alphabets that look like Latin ones, and what they look like.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k", "ω": "w", "γ": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "օ": "o", "ո": "n", "ս": "u", "հ": "h",
}
# Signs that stand for separators, and signs without width.
SIGNS = {
    "\u2024": ".", "\u3002": ".", "\u00b7": ".", "\u2022": ".", "\ufe52": ".", "\ufe6b": "@", "\u2010": "-", "\u2011": "-", "\u2012": "-",
    "\u2013": "-", "\u2014": "-", "\u2212": "-", "\ufe63": "-", "\ufe62": "+",
}
SPACES = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
WIDTHLESS = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
}


def _characters() -> dict[str, str]:
    """The character transducer: homoglyphs, signs, full-width forms, mathematical letters, digits of other scripts."""
    import sys
    import unicodedata

    table = {**HOMOGLYPHS, **SIGNS, **dict.fromkeys(SPACES, " "), **dict.fromkeys(WIDTHLESS, "")}
    for code in range(0x80, sys.maxunicode + 1):
        ch = chr(code)
        if ch in table:
            continue
        if unicodedata.category(ch) == "Nd":
            table[ch] = str(unicodedata.digit(ch))
        elif 0xFF01 <= code <= 0xFF5E or 0x1D400 <= code <= 0x1D7FF or 0x24B6 <= code <= 0x24E9:
            plain = unicodedata.normalize("NFKC", ch)
            if len(plain) == 1 and plain.isascii():
                table[ch] = plain
    return table


class Detector:
    """Finds the identifiers of a text, as they stand and behind disguises."""

    def __init__(self) -> None:
        words = "|".join(DIGIT_WORDS)
        self.characters = _characters()
        assert not any("\u00c0" <= c <= "\u00ff" for c in self.characters)
        self.unusual = re.compile("[^\\x00-\\x7f\u00c0-\u00ff]")  # all characters of the table and others
        self.digit = re.compile("[0-9]")
        self.domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
        self.local = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
        self.ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
        self.card = re.compile(r"[0-9](?:[ -]?[0-9])+")
        self.phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
        # Spelled digits: two or more in a row, one after a plus sign, or the parts of an address.
        self.spelled = re.compile(rf"(?<![a-z])(?:{words})(?:[ \t-]{{0,3}}(?:{words}))+(?![a-z])", re.I)
        self.after_plus = re.compile(rf"(?<=\+)(?:{words})(?![a-z])", re.I)
        self.part = re.compile(rf"{words}|[0-9]|dot|[.]", re.I)
        self.plus = re.compile(rf"(?<![a-z0-9])plus[ \t]{{1,3}}(?=[0-9]|(?:{words})(?![a-z]))", re.I)
        bracket = r"[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}(?:{0})[ \t]{{0,3}}[\])}}>][ \t]{{0,3}}"
        self.bracket_at = re.compile(rf"(?<=[a-z0-9._%+-]){bracket.format('at|@')}(?=[a-z0-9])", re.I)
        self.bracket_dot = re.compile(rf"(?<=[a-z0-9-]){bracket.format('dot|punkt|punto|point|[.]')}(?=[a-z0-9])", re.I)
        dot = rf"(?:{bracket.format('dot|punkt|punto|point|[.]')}|[ \t]{{1,3}}dot[ \t]{{1,3}})"
        number = rf"(?:[0-9]{{1,3}}|(?:{words})(?:[ \t-]{{0,3}}(?:{words})){{0,2}})"
        self.address = re.compile(rf"(?<![a-z0-9]){number}(?:(?:{dot}|[.]){number}){{3}}(?![a-z0-9])", re.I)
        # A bare "at" counts only before a domain whose dots are all or partly disguised.
        host = rf"[a-z0-9-]+(?:\.[a-z0-9-]+)*{dot}[a-z0-9-]+"
        self.bare_at = re.compile(rf"(?<=[a-z0-9._%+-])(?:[ \t]{{1,3}}at[ \t]{{1,3}}|[ \t]{{1,3}}@[ \t]{{0,3}}|@[ \t]{{1,3}})(?={host})", re.I)
        self.spaced_at = re.compile(r"(?<=[a-z0-9])(?:[ \t]{1,3}@[ \t]{0,3}|@[ \t]{1,3})(?=[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})", re.I)
        # "at" before an open domain only after something that looks like an account.
        self.open_at = re.compile(r"[ \t]{1,3}at[ \t]{1,3}(?=(?:[a-z0-9-]+\.)+[a-z]{2,}(?![a-z0-9]))", re.I)
        self.account = re.compile(r"(?:[0-9_]|[._-][a-z0-9]{1,4})$", re.I)
        self.entity = re.compile(r"&(?:#0*64|#x0*40|commat|(?P<dot>#0*46|#x0*2e|period));", re.I)
        self.letter = re.compile(r"(?<=[0-9])(?:(?P<zero>[Oo])|[Il])(?=[0-9])")
        self.bare_dot = re.compile(r"(?<=[a-z0-9-])[ \t]{1,3}dot[ \t]{1,3}(?=[a-z0-9])", re.I)
        self.opened = re.compile(r"[\[({<][ \t]{0,3}(?:at|@|[.])", re.I)
        self.hints = frozenset(w.encode() for w in [*DIGIT_WORDS, "at", "plus", "dot", "punkt", "punto", "point"])
        letters = bytes(range(0x61, 0x7B))
        self.words = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in letters else 0x20 for b in range(256))

    def find(self, text: str) -> list[tuple[str, int, int]]:
        """The base spans: leftmost, not overlapping within a kind, by kind and start."""
        found: list[tuple[str, int, int]] = []
        at = text.find("@")
        last = 0
        while at >= 0:
            start = at
            while start > last and text[start - 1] in self.local:
                start -= 1
            match = self.domain.match(text, at + 1) if start < at else None
            if match:
                last = match.end()
                found.append(("email", start, last))
            at = text.find("@", max(at + 1, last))
        if self.digit.search(text):
            for m in self.ip.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    found.append(("ip", *m.span()))
            for m in self.card.finditer(text):
                if m.end() - m.start() <= 37 and luhn(re.sub("[ -]", "", m[0])):
                    found.append(("card", *m.span()))
            for m in self.phone.finditer(text) if "+" in text else ():
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append(("phone", *m.span()))
        return found

    def normalise(self, text: str) -> tuple[str, list[int], list[int]] | None:
        """The text without disguises and the source start and end of each of its characters; None if it has none."""
        edits: list[tuple[int, int, str]] = []
        if not text.isascii():
            edits = [(m.start(), m.end(), self.characters[m[0]]) for m in self.unusual.finditer(text) if m[0] in self.characters]
        plain, starts, ends = apply(text, None, None, edits)
        rewritten = bool(edits)
        # Words without which no rule below can apply; most texts hold none of them.
        hints = self.hints.intersection(plain.encode("utf-8", "surrogatepass").translate(self.words).split())
        opened = bool(self.opened.search(plain))
        dotted = opened or bool(hints & {b"dot", b"punkt", b"punto", b"point"})
        worded = len(hints - {b"at", b"dot", b"plus", b"punkt", b"punto", b"point"}) > 0
        apart = "@" in plain
        for pattern, wanted, write in (
            (self.entity, "&" in plain, lambda m: "." if m["dot"] else "@"),
            (self.letter, True, lambda m: "0" if m["zero"] else "1"),
            (self.address, dotted, self.digits),
            (self.spelled, worded, self.digits),
            (self.plus, b"plus" in hints, lambda m: "+"),
            (self.after_plus, worded, self.digits),
            (self.bracket_at, opened, lambda m: "@"),
            (self.bare_at, dotted, lambda m: "@"),
            (self.open_at, b"at" in hints, lambda m: "@" if self.account.search(m.string, max(0, m.start() - 6), m.start()) else None),
            (self.spaced_at, apart, lambda m: "@"),
            (self.bracket_dot, dotted, lambda m: "."),
            (self.bare_dot, dotted, lambda m: "."),
        ):
            found = ((m.start(), m.end(), write(m)) for m in pattern.finditer(plain)) if wanted else ()
            edits = [e for e in found if e[2] is not None]
            if edits:
                plain, starts, ends = apply(plain, starts, ends, edits)
                rewritten = True
        if not rewritten:
            return None
        if starts is None:
            starts, ends = list(range(len(text))), list(range(1, len(text) + 1))
        return plain, starts, ends

    def digits(self, match: re.Match) -> str:
        """The digits and dots of a spelled number."""
        parts = (p.lower() for p in self.part.findall(match[0]))
        return "".join(DIGIT_WORDS.get(p, "." if p == "dot" else p) for p in parts)

    def detect(self, text: str | None) -> tuple[list, list]:
        """Base spans, and those that only the normalised text shows, at their source places."""
        text = text or ""
        base = self.find(text)
        cleared = self.normalise(text)
        if cleared is None:
            return base, []
        plain, starts, ends = cleared
        held: dict[str, list[tuple[int, int]]] = {}
        for kind, a, b in base:
            held.setdefault(kind, []).append((a, b))
        added = []
        for kind, a, b in self.find(plain):
            span = (starts[a], ends[b - 1])
            if not any(x <= span[0] and span[1] <= y for x, y in held.get(kind, ())):
                added.append((kind, *span))
        return base, added


def luhn(digits: str) -> bool:
    if not 16 <= len(digits) <= 19:
        return False
    values = [int(d) for d in digits[::-1]]
    return sum(values[::2] + [v * 2 - 9 * (v > 4) for v in values[1::2]]) % 10 == 0


def apply(text: str, starts: list[int] | None, ends: list[int] | None, edits: list[tuple[int, int, str]]):
    """Replace stretches of a text and carry the source places along (None: the places are the text's own).

    The characters of a replacement share the source stretch: its first begins and its last ends with it.
    """
    if not edits:
        return text, starts, ends
    if starts is None:
        starts, ends = list(range(len(text))), list(range(1, len(text) + 1))
    parts, new_starts, new_ends, last = [], [], [], 0
    for a, b, put in edits:
        parts += [text[last:a], put]
        new_starts += starts[last:a] + [starts[a]] * len(put)
        new_ends += ends[last:a] + [ends[b - 1]] * len(put)
        last = b
    parts.append(text[last:])
    return "".join(parts), new_starts + starts[last:], new_ends + ends[last:]


def detect(documents: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``documents`` with a struct column ``out`` (renamed where taken): ``base`` and ``added`` spans.

    A span has its kind (email, ip, card, phone) and its place in code points of the whole source text, end exclusive.
    ``base`` are the leftmost non-overlapping matches of each kind's pattern in the text as it stands; ``added`` are
    those found after look-alike letters, foreign digits, widthless signs, spelled digits and written-out "at" and
    "dot" are undone, mapped back to the source. An added span may extend a base one but never lies inside one.

    Null and empty texts have no spans. Rows are independent (repeated rows agree) and nothing is shuffled.
    """
    (column,) = free_names(documents, out)

    @F.pandas_udf(f"base array<{SPAN}>, added array<{SPAN}>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        detector = Detector()
        for batch in batches:
            rows = [
                [[{"kind": k, "start": a, "end": b} for k, a, b in part] for part in detector.detect(text)] for text in batch
            ]
            yield pd.DataFrame(rows, columns=["base", "added"])

    return bounded_batches(documents).withColumn(column, spans(named(text)))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digest(spans: Column) -> Column:
    """``kind:start:end`` of spans by kind and start, comma-joined."""
    rank = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(len(KINDS))) for x in pair])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(rank[s["kind"]].alias("r"), s["start"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """``documents`` with every span replaced by its kind in angle brackets (overlapping ones by the first's)."""
    (column,) = free_names(documents, "pii")
    found = detect(documents, text, column)

    @F.pandas_udf("string")
    def cover(texts: pd.Series, spans: pd.DataFrame) -> pd.Series:
        out = []
        for value, base, added in zip(texts, spans["base"], spans["added"]):
            if value is None or not (len(base) or len(added)):
                out.append(value)
                continue
            parts, last = [], 0
            for s in sorted([*base, *added], key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= last:
                    parts += [value[last:s["start"]], f"<{s['kind']}>"]
                last = max(last, s["end"])
            out.append("".join(parts) + value[last:])
        return pd.Series(out, dtype=object)

    return found.withColumn(text, cover(named(text), named(column))).select(*map(named, documents.columns))
