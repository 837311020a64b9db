import random
import re

import pytest
from pyspark.sql import functions as F

from dossier.operators import parsing as P


def py_windows(text, size, overlap):
    tokens = list(re.finditer(r"\S+", text))
    out, start = [], 0
    while start < len(tokens):
        end = min(start + size, len(tokens))
        a, b = tokens[start].start(), tokens[end - 1].end()
        out.append((text[a:b], end - start, a, b))
        if end == len(tokens):
            break
        start = end - overlap
    return out


def test_windows_match_a_scan_in_python(spark):
    rng = random.Random(3)
    texts = ["", "  ", "one two three four five six seven"]
    texts += ["".join(rng.choice(["a", "bé", " ", "\n", "  ", "ccc ", " "]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame([(f"d{i}", 1, 10, t) for i, t in enumerate(texts)], "accession_number string, section_sequence int, start_offset int, section_text string")
    for size, overlap in ((3, 1), (5, 0), (4, 3)):
        rows = P.cut_chunks(df, size, overlap).collect()
        got = {}
        for r in sorted(rows, key=lambda r: r.chunk_id):
            got.setdefault(r.accession_number, []).append((r.text, r.token_count, r.source_start - 10, r.source_end - 10))
        for i, t in enumerate(texts):
            assert got.get(f"d{i}", []) == py_windows(t, size, overlap), repr(t)


def test_bad_window_sizes_are_rejected():
    for size, overlap in ((0, 0), (2, 2), (2, -1)):
        with pytest.raises(ValueError):
            P.token_windows(None, size, overlap)


def test_chunk_ids(apply):
    assert apply(lambda c: P.chunk_id(c, F.lit(2), F.lit(3)), ["0000320193-24-000123"]) == ["0000320193-24-000123:s0002:c0003"]


def sections(spark, text):
    df = spark.createDataFrame([("a", text)], "accession_number string, text string")
    return sorted(P.detect_sections(df).collect(), key=lambda r: r.section_sequence)


def test_sections_run_from_heading_to_heading(spark):
    text = "Intro\nItem 1. Business\nWe sell.\n  Item 1A. Risk Factors\nSupply risk.\nItem 7. Management's Discussion and Analysis of Results\nText"
    got = sections(spark, text)
    assert [s.section_type for s in got] == ["business", "risk_factors", "mda"]
    assert got[1].section_text == "Item 1A. Risk Factors\nSupply risk." and got[1].start_offset == text.index("Item 1A")
    assert text[got[0].start_offset: got[0].end_offset].strip() == got[0].section_text


def test_text_without_headings_is_one_section(spark):
    got = sections(spark, "Nothing to see.")
    assert [(s.section_type, s.section_name, s.section_text) for s in got] == [("document", "Document", "Nothing to see.")]


def test_nearby_repeats_are_judged_against_the_last_kept_heading(spark):
    head = "Item 1. Business\n"
    filler = "x" * (150 - len(head) - 1) + "\n"
    got = sections(spark, head + filler + head + filler + head + "end")
    assert [s.start_offset for s in got] == [0, 300]


def test_counts(spark):
    df = spark.createDataFrame([("a", "Item 1. Business\nfive words are right here")], "accession_number string, text string")
    found = P.detect_sections(df)
    row = P.parse_counts(found, P.cut_chunks(found, 4, 1)).first()
    assert (row.sections_created, row.chunks_created) == (1, 3)


def test_windows_of_a_long_text(apply):
    """Every window holds the same tokens as a plain cut; the blanks in front are measured once, not per window."""
    text = " \x1c\n" + "".join(f"w{i}{' ' * (1 + i % 3)}" for i in range(1000))
    for size, overlap in ((64, 8), (10, 7), (3, 0), (1, 0)):
        got = apply(lambda c: P.token_windows(c, size, overlap), [text])[0]
        spans = [m.span() for m in re.finditer(r"\S+", text)]
        firsts = [w * (size - overlap) for w in range(len(got))]
        assert [(r.text, r.token_count, r.start, r.size) for r in got] == [
            (text[spans[f][0]:(e := spans[min(f + size, 1000) - 1][1])], min(size, 1000 - f), spans[f][0], e - spans[f][0]) for f in firsts
        ]
        assert firsts[-1] + size >= 1000 and (len(firsts) == 1 or firsts[-2] + size < 1000)
