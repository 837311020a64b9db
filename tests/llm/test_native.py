"""The operators that use DataFrame expressions only."""

import os
import re
import textwrap

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dossier.llm import licences, quotes
from tools.check_oracles import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NATIVE = ("op5_licence_scan", "op7_quotation_linking", "op10_line_dedup")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_in_the_plan(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan_of(entry.queries()[name](spark, SF)))


@pytest.mark.parametrize("name", [*NATIVE, "op6_embedding_dedup", "op8_decontamination"])
def test_query_equals_sql(spark, name):
    sf = SF.replace("sf0.001", "sf0.01")
    ok, note = compare(spark, connect(sf), name, sf)
    assert ok, note


def brute_licences(text):
    found = {}
    units = [(i, line) for i, line in enumerate(text.split("\n"))] + ([(-1, text)] if "\n" in text else [])
    for number, unit in units:
        words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), unit))
        bag = {f"{a} {b}" for a, b in zip(words, words[1:])}
        best = None
        for name, body in sorted(licences.TEMPLATES.items()):
            other = set(licences.template_bigrams(body))
            dice = 2 * len(bag & other) / (len(bag) + len(other))
            if dice >= 0.8 and (best is None or dice > best[1]):
                best = (name, dice)
        if best:
            found[number] = best
    return [(number, *best) for number, best in found.items()] + brute_passages(text, found)


def brute_passages(text, found):
    """Every window of every template's lengths, then those that nothing overlapping exceeds and no unit accounts for."""
    words = [(w, i) for i, line in enumerate(text.split("\n")) for w in re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), line))]
    pairs = [f"{a} {b}" for (a, _), (b, _) in zip(words, words[1:])]
    out = []
    for name, body in licences.TEMPLATES.items():
        other = set(licences.template_bigrams(body))
        best = {}
        for start in (i for i, pair in enumerate(pairs) if pair in other):
            for length in licences.passage_lengths(body, 0.8):
                bag = set(pairs[start:start + length])
                dice = 2 * len(bag & other) / (len(bag) + len(other))
                if dice >= 0.8 and dice > best.get(start, (0,))[0]:
                    best[start] = (dice, min(start + length, len(pairs)))
        for start, (dice, end) in best.items():
            if any(s < end and start < e and (d > dice or d == dice and s < start) for s, (d, e) in best.items()):
                continue
            if not any(n == name and (i == -1 or words[start][1] <= i <= words[end][1]) for i, (n, _) in found.items()):
                out.append((words[start][1], name, dice))
    return out


def wrapped(text):
    return "\n".join("# " + line for line in textwrap.wrap(text, 76))


def test_licences_equal_brute_force(spark):
    t = licences.TEMPLATES
    mit = t["MIT"]
    cut = " ".join(mit.split()[:-20])
    code = "\n" + "".join(f"def f{i}(a{i}): return b{i} + {i}\n" for i in range(150))
    texts = [
        None, "", "word", "RELEASED under the mit-license", "prose\n" + t["Apache-2.0 notice"] + "\nmore", mit, mit.replace(". ", ".\n"), cut,
        "Copyright (c) 2001 Someone\n\n" + mit, " ".join(mit.split()[:60]), t["ISC"].upper(), "the " * 5000 + "mit", t["GPL-3.0 notice"] + " " + t["MIT notice"],
        "Licensed under CC BY-NC 4.0. And more words", "mit license", "\n" * 500 + t["MIT notice"], t["MIT notice"],
        wrapped(t["Apache-2.0 header"]) + code, "Copyright 2001\n" + wrapped(mit) + code, "Ours. Released under the MIT License. Ask us for more of it.",
        " ".join([t["MIT notice"]] * 300), code + wrapped(t["MPL-2.0 notice"]) + code + wrapped(t["ISC"]) + code + wrapped(t["MPL-2.0 notice"]),
        code + wrapped(" ".join(mit.split()[:130])) + code + wrapped(mit.replace("software", "program")) + code, wrapped(t["GPL-3.0 header"] * 2) + code,
        "under the MIT License. Released under the MIT License under the MIT License and released",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3]), (None, t["MIT notice"])], "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("n", F.lit(2))
    got = licences.scan(docs).collect()
    want = [(i, n, *v) for i, text in [*enumerate(texts), (3, texts[3]), (None, t["MIT notice"])] for n, *v in brute_licences(text or "")]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.line_no, r.licence, r.dice)) for r in got)
    assert len(want) > 9
    passages = {(r.doc_id, r.licence) for r in got if r.scope == "passage"}
    first = texts.index(t["MIT notice"]) + 1
    assert {(first, "Apache-2.0 header"), (first + 1, "MIT"), (first + 2, "MIT notice"), (first + 4, "MPL-2.0 notice"), (first + 4, "ISC")} <= passages
    assert licences.scan(docs.where("1 = 0")).count() == 0
    assert licences.scan(docs, templates={}).count() == 0


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.95])
def test_anchors_are_in_every_match(threshold):
    import random

    rng = random.Random(1)
    for body in licences.TEMPLATES.values():
        bag = licences.template_bigrams(body)
        needed = licences.anchors(bag, threshold)
        for _ in range(30):
            kept = rng.sample(bag, rng.randint(1, len(bag)))
            if 2 * len(kept) / (len(kept) + len(bag)) >= threshold:
                held = " ".join(kept).split()
                assert needed and all(any(w in held for w in group) for group in needed)


MAIL = [
    ("c", 0, "Hello all.\n\nShall we meet on Monday?\nI would like that."),
    ("c", 1, "On Monday Ann wrote:\n> Shall we meet  on monday?\n\nYes."),
    ("c", 2, "> > Shall we meet on Monday?\n> Yes.\nNo, Tuesday."),
    ("c", 3, "> Hello all.\n>\n> Shall we meet on\n> Monday? I would like that.\nFine."),
    ("c", 4, "> never said\nOdd."),
    ("c", 5, "no quote"),
    ("d", 1, "> Shall we meet on Monday?\nOther conversation"),
    ("d", 7, "> later\nx"),
    ("d", 8, "later"),
    ("d", 9, ">>> \n>"),
    ("d", 9, None),
    ("e", 0, ""),
    (None, 1, "> Hello all.\nkeep"),
    ("c", None, "> Hello all.\nkeep"),
]


def test_quotations_lead_to_their_messages(spark):
    messages = spark.createDataFrame(MAIL, "conv_id string, turn int, text string").withColumn("Thread", F.lit("own")).withColumn("c", F.lit(1))
    got = quotes.link(messages)
    assert got.columns == ["conv_id", "turn", "text", "Thread", "c", "reply_to", "thread_", "depth", "n_quotes"]
    rows = got.collect()
    assert len(rows) == len(MAIL)
    found = {(r.conv_id, r.turn): (r.text, r.reply_to, r.thread_, r.depth, r.n_quotes) for r in rows if r.text is not None}
    assert found["c", 0] == (MAIL[0][2], None, 0, 0, 0)
    assert found["c", 1] == ("Yes.", 0, 0, 1, 1)
    assert found["c", 2] == ("No, Tuesday.", 1, 0, 2, 2)
    assert found["c", 3] == ("Fine.", 0, 0, 1, 1)
    assert found["c", 4] == ("Odd.", None, 4, 0, 1)
    assert found["c", 5] == ("no quote", None, 5, 0, 0)
    assert found["d", 1] == ("Other conversation", None, 1, 0, 1)
    assert found["d", 7] == ("x", None, 7, 0, 1)
    assert found["d", 9][0] == "" and found["e", 0] == ("", None, 0, 0, 0)
    assert found[None, 1] == ("keep", None, 1, 0, 1) and found["c", None] == ("keep", None, None, 0, 1)
    assert quotes.link(messages.where("1 = 0")).count() == 0
    assert quotes.link(messages.where("turn = 5")).collect()[0].thread_ == 5


def test_quotations_equal_sql(spark):
    """The statement over conversations, on messages that do quote."""
    import duckdb
    import pandas as pd

    rows = [(c, t, "user", text) for c, t, text in MAIL if (c, t) != ("d", 9)]
    got = quotes.link(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string"))
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"}))
    want = con.execute(quotes.sql()).fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got.collect())


def test_long_chains_and_hot_passages(spark):
    chain = [("c", i, f"> text number {i - 1}\ntext number {i}" if i else "text number 0") for i in range(70)]
    hot = [("h", i, "> the first\nanswer" if i else "the first") for i in range(300)]
    got = quotes.link(spark.createDataFrame(chain + hot, "conv_id string, turn int, text string")).collect()
    assert all((r.thread, r.depth) == (0, r.turn) for r in got if r.conv_id == "c")
    assert all((r.thread, r.depth, r.reply_to) == (0, 1, 0) for r in got if r.conv_id == "h" and r.turn)


def test_the_query_keeps_all_messages(spark):
    messages = spark.read.parquet(f"{SF}/conversations.parquet")
    got = entry.queries()["op7_quotation_linking"](spark, SF)
    assert got.count() == messages.count()
    assert got.where("text like '>%'").count() == 0


def test_quotations_of_a_very_long_message(spark):
    lines = 100_000
    text = "".join(f"> {'> ' * (i % 2)}line {i}\n" for i in range(lines))
    messages = spark.createDataFrame([("c", 0, f"line {lines - 1}"), ("c", 1, text), ("c", 2, "> a\n" * lines)], "conv_id string, turn int, text string")
    rows = {r.turn: r for r in quotes.link(messages).select("turn", "text", "reply_to", "n_quotes").collect()}
    assert [rows[t].n_quotes for t in range(3)] == [0, lines, 1]
    assert rows[1].reply_to == 0 and rows[1].text == rows[2].text == ""
