"""Voronoi top-k, conversation repair and fill-in-middle against brute force, and their edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import infill, turnfix, voronoi

# --- fill-in-middle ---


def brute_infill(doc_id, text):
    text, key = text or "", "" if doc_id is None else str(doc_id)
    n, digest = len(text), hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def documents():
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh éß字😀\n") for _ in range(6000))
    rows = [(None, "no id"), (1, None), (2, ""), (3, "has <S> inside"), (4, "<"), (5, "x" * 300_000), (6, passage), (6, passage), (-7, "😀")]
    rows += [(i, passage[:rng.randint(0, 6000)] + "tail <P " * rng.randint(0, 3)) for i in range(10, 120)]
    return rows


def test_infill_equals_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame([(i, d, t, -1, "f") for i, (d, t) in enumerate(rows)], "pos int, doc_id long, text string, raw int, form string")
    found = infill.transform(df)
    assert found.columns == [*df.columns, "infill"]
    found = found.select("*", infill.restored(F.col("infill.output"), F.col("infill.form")).alias("back"))
    got = sorted(found.collect(), key=lambda r: r.pos)
    assert len(got) == len(rows)
    for r, (doc_id, text) in zip(got, rows):
        assert tuple(r.infill) == brute_infill(doc_id, text)
        assert r.back == (text or "") and r.raw == -1 and r.form == "f"
    assert {r.infill.form for r in got} == {"plain", "psm", "spm"}


def test_infill_of_words_and_of_nothing(spark):
    text = "  one two\tthree\n four  " * 500
    rows = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string")
    starts = [m.start() for m in re.finditer(r"[^ \t-\r]+", text)] + [len(text)]
    for r in infill.transform(rows, unit="word", plain_share=0).collect():
        assert r.infill.n == 2000
        ends = (r.infill.prefix_chars, r.infill.prefix_chars + r.infill.middle_chars)
        assert all(e == 0 or e in starts for e in ends)
        h = hashlib.sha256(f"1:{r.doc_id}".encode()).hexdigest()
        wanted = sorted(int(h[i:i + 8], 16) % 2001 for i in (0, 8))
        assert ends == tuple(0 if u == 0 else starts[u] for u in wanted)
    assert infill.transform(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.transform(rows.withColumn("Infill", F.lit(1)))


def test_chunks_are_shared_and_what_is_remembered_changes_nothing():
    rng = random.Random(1)
    body = bytes(rng.choice(b"abc def") for _ in range(200_000))
    shared = infill.Counter("codepoint")
    ends = shared.chunks(body)[0]
    assert ends == list(infill.chunk_ends(body)) and max(np.diff([0, *ends])) <= infill.MOST
    assert min(np.diff([0, *ends[:-1]])) >= infill.LEAST
    shared.chunks(b"another beginning" + body)
    assert shared.hits > 0.9 * len(ends)
    for unit in ("codepoint", "word"):
        small, large = infill.Counter(unit, 4000), infill.Counter(unit)
        for at in range(0, 100_000, 7919):
            assert small.chunks(body[at:]) == large.chunks(body[at:])
        assert sum(map(len, small.known)) <= 4000
    # Across the segments in which the hash is computed.
    long = body * 12
    whole = infill.Counter("codepoint").chunks(long)
    assert whole[1][-1] == len(long) and whole[0][-1] == len(long)


# --- conversation repair ---


def brute_repair(codes):
    """The least (cost, audit) by all edit sequences, with at most one pair of insertions at a place."""
    best = {0: [(0, "")]}
    legal = re.compile(r"(s?(ua)+)?")
    found = []

    def go(at, roles, cost, audit):
        if found and cost > found[0][0]:
            return
        if at == len(codes) and legal.fullmatch(roles):
            found.append((cost, audit))
            found.sort()
            del found[1:]
        if len(audit) < 2 * len(codes) + 2 and not audit.endswith("II"):
            for role in "ua":
                go(at, roles + role, cost + 2, audit + "I")
        if at < len(codes):
            code = codes[at]
            go(at + 1, roles, cost + 3, audit + "D")
            if code != "-":
                extra = int(code.isupper())
                if code.lower() != "x":
                    go(at + 1, roles + code.lower(), cost + extra, audit + "K")
                for role in "ua":
                    go(at + 1, roles + role, cost + extra + 2, audit + "R")

    del best
    go(0, "", 0, "")
    return found[0]


def test_parses_equal_all_edit_sequences():
    rng = random.Random(2)
    cases = ["", "s", "u", "a", "ua", "sua", "asu", "--", "Ux", "aa-", "sau"] + ["".join(rng.choice("suaxSUAX-") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    for codes in cases:
        assert turnfix.cheapest(turnfix.parsed(codes)) == brute_repair(codes), codes


def test_every_split_gives_the_same_cell():
    rng = random.Random(3)
    for _ in range(100):
        codes = "".join(rng.choice("suaxSUAX-") for _ in range(rng.randint(2, turnfix.CHART)))
        cut = rng.randint(1, len(codes) - 1)
        assert turnfix.joined(turnfix.chart(codes[:cut]), turnfix.chart(codes[cut:])) == turnfix.chart(codes)


def brute_audit(rows):
    """``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired`` of the rows ``(turn, role, text)`` of a conversation."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
    numbers = {t for t, _, _ in rows if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    seen, codes, counts = set(), "", [0, 0, 0]
    for _, role, text in rows:
        solid = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not solid else 1 if (role, text) in seen else 2 if solid[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        code = role[:1] if role[:1] in tuple("sua") else "x"
        codes += "-" if fault in (0, 1) else code.upper() if fault == 2 else code
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = turnfix.cheapest(turnfix.parsed(codes))
    out, at = [], 0
    headed = None
    for edit in audit:
        if edit != "I":
            _, role, text = rows[at]
            at += 1
        if edit == "D":
            continue
        if edit == "K":
            headed = role[0] == "s" if headed is None else headed
            out.append((role, text))
        else:
            headed = False if headed is None else headed
            out.append((("user", "assistant")[(len(out) - headed) % 2], "" if edit == "I" else text))
    repaired = "\n".join(f"{r}:{t}" for r, t in out)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()), out


def check(spark, rows):
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "conv_id long, turn long, role string, text string, cost int, ck int")
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    got = {r.conv_id: tuple(r)[1:] for r in turnfix.audit(df).collect()}
    made = {}
    for r in turnfix.repair(df).orderBy("position").collect():
        made.setdefault(r.conv_id, []).append((r.role, r.text))
    assert set(got) == set(by)
    for conv, mine in by.items():
        want, out = brute_audit(mine)
        assert got[conv] == want, conv
        assert made.get(conv, []) == out


def test_audit_equals_brute_force(spark):
    rng = random.Random(4)
    texts = ["Yes.", "No", "", " \t", None, "What?", "wait!  \n", "ok .x", "é.", "long " * 5000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles[:3] * 4 + roles), rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yo."), (999, 2**62, "user", "a."), (999, -2**62, "user", "b."), (998, None, "user", "a.")]
    check(spark, rows + rows[:20])


def test_a_conversation_of_many_turns_is_spread_over_tasks(spark):
    rng = random.Random(5)
    rows = [(1, i // 2, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {i}.", f"text {i % 50}", ""])) for i in range(3000)]
    rows += [(1, 77, "user", "the same again and again.")] * 500 + [(2, 0, "user", "Hi."), (0, 0, "assistant", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        parts = turnfix.stretches(turnfix.turns(df, "conv_id", "turn", "role", "text")).groupBy("ck").count().collect()
        assert max(r["count"] for r in parts) >= 8
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def test_conversations_without_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    every = spark.createDataFrame([(1, 0, "user", "a."), (2, 0, "user", "b."), (None, 1, "user", "c.")], schema)
    left = turnfix.audit(every.where("conv_id = 1"), every=every).orderBy("conv_id").collect()
    assert [r.conv_id for r in left] == [None, 1, 2]
    assert tuple(left[0])[1:] == tuple(left[2])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert left[1].audit == "KI" and left[1].cost == 2
    assert turnfix.audit(every.limit(0)).count() == 0 and turnfix.repair(every.limit(0)).count() == 0
    damaged = turnfix.damage(every.union(every))
    assert damaged.columns == ["conv_id", "turn", "role", "text"]


# --- top-k ---


def brute_top(rows, k):
    good = sorted({
        (i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)
    })
    out = []
    for q, v in good:
        if q % 50 == 0:
            best = sorted((-min(2**63 - 1, max(-2**63, sum(a * b for a, b in zip(v, w)))), i) for i, w in good if i != q and len(v) == len(w))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])]
    return sorted(out)


def top(spark, rows, k=5, **sizes):
    df = spark.createDataFrame([(i, v, -1.0, "x") for i, v in rows], "vec_id long, embedding array<double>, score double, v string")
    found = voronoi.top_k(df, F.col("vec_id") % 50 == 0, k=k, **sizes)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(tuple(r) for r in found.collect())


def test_top_k_equals_brute_force(spark):
    rng = np.random.RandomState(1)
    centres = rng.randn(12, 8)
    rows = [(i, (centres[i % 12] + 0.1 * rng.randn(8)).tolist()) for i in range(1, 700)]
    rows += [(i, rows[5][1]) for i in range(700, 900)] + [rows[49], rows[3]]  # a third are copies; repeated rows
    rows += [(2000, None), (2050, [1.0, None] * 4), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, [1.0] * 8), (2200, [0.0] * 8)]
    rows += [(2250, [1.0, 2.0]), (2300, [2.0, 1.0]), (2301, [-1.0, 0.5]), (2350, []), (2400, [1.7e308] * 8)]
    want = brute_top(rows, 5)
    assert top(spark, rows) == want
    assert top(spark, rows, tile=40, block=4, pivots=10) == want
    assert top(spark, rows, k=1, tile=100) == brute_top(rows, 1)


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(50 * i, [3e13 + i, 1e12, 7.0]) for i in range(6)] + [(51, [1e30, 1.0, 1.0]), (52, [1e200] * 3)]
    assert top(spark, rows) == brute_top(rows, 5)


def test_few_vectors_and_none(spark):
    assert top(spark, []) == []
    assert top(spark, [(50, [1.0])]) == []
    assert top(spark, [(1, [1.0]), (2, [1.0])]) == []
    assert top(spark, [(0, [1.0]), (2, [0.5]), (1, [0.5])]) == [(0, 1, 1, 256 * 128), (0, 2, 2, 256 * 128)]


def test_clusters_spare_work_and_bounds_hold():
    rng = np.random.RandomState(2)
    centres = 20 * rng.randn(30, 16)
    data = np.floor(256 * (centres.repeat(40, 0) + 0.05 * rng.randn(1200, 16)))
    cells = voronoi.Cells(data[::40].copy())
    place, off = cells.nearest(data)
    for c in range(30):
        cells.radius[c] = off[place == c].max()
        cells.longest[c] = np.linalg.norm(data[place == c], axis=1).max()
    cells.witnesses, cells.copies = data[::10], np.ones(120, np.int64)
    queries = data[::7]
    real = queries @ data.T
    bounds, least = cells.bounds(queries), cells.threshold(queries, 6)
    for c in range(30):
        assert (real[:, place == c].max(axis=1) <= bounds[:, c]).all()
    assert (np.sort(real, axis=1)[:, -6] >= least).all()
    assert cells.needed(queries, 6).mean() < 0.2


# --- near copies ---


def random_sets(rng, n):
    """Shingle sets and the pairs of them at 0.8 or more."""
    from dossier.llm import minhash

    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(120)) for _ in range(n)]
    for i in range(0, n, 2):
        words = texts[i].split()
        for at in rng.sample(range(10, 110), 2):
            words[at] = "changed"
        texts[i + 1] = " ".join(words)
    return [minhash.shingles(t) for t in texts]


def test_all_links_of_a_hot_bucket_are_found(spark):
    from dossier.llm import minhash

    rng = random.Random(8)
    sets = random_sets(rng, 200)
    factors = minhash.multipliers()
    rows = [(i, [7] + [1000 * i + b for b in range(23)], s.tobytes(), minhash.sketch(minhash.least(s, factors))) for i, s in enumerate(sets)]
    arrays = spark.createDataFrame(rows, "node long, bands array<long>, hashes binary, sketch binary")
    members = spark.createDataFrame([(0, 7, i) for i in range(200)], "band int, value long, node long")
    for part in (512, 40):
        rooted = {r.node: r.root for r in minhash.links(minhash.shared_buckets(members), arrays, part=part).collect()}
        assert rooted == {i: i - i % 2 for i in range(200)}


def test_shingle_hashes_tell_runs_of_words_apart():
    from dossier.llm import minhash

    rng = random.Random(10)
    words = ["a", "b", "ab", "ba", "é", "字", "A", "x" * 3000]
    hasher, seen = minhash.Hasher(), {}
    for _ in range(300):
        tokens = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        text = "".join(t + rng.choice([" ", "\n", "  \t"]) for t in tokens)
        low = [t.encode().lower() for t in tokens]
        runs = {tuple(low[i:i + 5]) for i in range(max(1, len(low) - 4))} if low else set()
        found = hasher(text)
        assert len(found) == len(runs)
        for run in runs:
            one = hasher(b" ".join(run).decode())
            assert len(one) == 1 and seen.setdefault(int(one[0]), run) == run
            assert len(run) < 5 or one[0] in found
    long = "one two three four five six seven " * 400_000
    assert len(hasher(long)) == 7


def test_near_copies_equal_brute_force_and_edges(spark):
    from dossier.llm import minhash

    rng = random.Random(9)
    template = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(80):  # a hot template in all of them, half of each text
        own = [f"o{i}x{j}" for j in range(60)]
        texts.append(" ".join(template + own))
        if i % 4 == 0:
            own[rng.randrange(60)] = "other"
            texts.append(" ".join(template + own))
    base = [f"b{rng.randrange(9999)}" for _ in range(300)]
    for _ in range(40):
        texts.append(" ".join(base[:-1] + [f"end{rng.random()}"]))
    texts += [None, "", "  ", "one two", "ONE  two", "long " + "word " * 60_000]
    rows = [(i, t, i, "x", 1.0) for i, t in enumerate(texts)] + [(None, texts[0], -1, "y", 2.0), (3, texts[3], 3, "x", 1.0), (None, "only nulls here", 5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kd long, NODE string, kt double")
    sets = [set(minhash.shingles(r[1]).tolist()) for r in rows]
    group = list(range(len(rows)))

    def find(i):
        return i if group[i] == i else find(group[i])

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best.setdefault(find(i), []).append((r[0] is None, r[0] or 0))
    want = sorted(min(v) for v in best.values())
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == want
    assert minhash.keep_one(docs.where("1 = 0")).count() == 0


def test_a_hot_group_of_near_copies_keeps_its_lines(spark):
    import corpus_pipeline

    lines = [f"clean line {i} of this text and some more words" for i in range(20)]
    rows = [(i, "\n".join([*lines, f"its own end {i}"]), "en", "big", 0) for i in range(40)]
    rows += [(200 + i, "Menu\n" + f"own words of {i}", "en", "big", 0) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert found == {i: t.replace("Menu\n", "") for i, t, *_ in rows}


def test_line_sql_counts_repeated_pages_once(spark):
    import duckdb
    import pandas as pd

    from dossier.llm import common, linededup

    hot = "<p>Menu</p><p>clean line</p><p>more of it</p>"
    rows = [(i, "http://a.example/x", hot) for i in range(30)] + [(100 + i, "http://a.example/y", f"<p>Menu</p><p>own {i}</p>") for i in range(40)]
    rows += [(200, "http://a.example/", None), (201, "no host", "<p>Menu</p>"), (202, None, "x"), (203, "http://b.example", "")]
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])  # noqa: F841, read by name
    want = sorted(map(repr, duckdb.sql(linededup.pages_sql()).fetchall()))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    lines = df.select("page_id", common.host_of(F.col("url")).alias("host"), linededup.html_lines(F.col("html")).alias("text"))
    found = linededup.drop_lines(lines, counts=("n_lines", "n_dropped")).collect()
    assert sorted(repr(tuple(r)) for r in found) == want
    texts = {r.page_id: r.text for r in found}
    assert texts[0] == "clean line\nmore of it" and texts[103] == "own 3"


def test_pages_that_share_a_least_line_all_count(spark):
    import corpus_pipeline

    menu = [f"Menu entry {i}" for i in range(30)]
    own = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(60)]
    rows = [(i, "\n".join([*menu, own[i], *menu[:2]]), "en", "big", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert found == {i: (t, len(t)) for i, t in enumerate(own)}


def test_near_copies_by_lines_equal_brute_force(spark):
    from dossier.llm import linededup

    rng = random.Random(4)
    base = [f"base line {i} " + "x" * rng.randrange(40) for i in range(12)]
    texts = [[f"own {i}.{j} " + "y" * rng.randrange(60) for j in range(rng.randrange(1, 6))] + base[:rng.randrange(13)] for i in range(150)]
    texts += [base[:k] + base[k + 1:] for k in range(12)] + [[]]
    sets = [{(t, len(t)) for t in lines} for lines in texts]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sum(n for _, n in sets[i] & sets[j]) >= 0.8 * sum(n for _, n in sets[i] | sets[j]) > 0:
                group = [group[j] if g == group[i] else g for g in group]
    want = sorted(sorted(i for i, g in enumerate(group) if g == k) for k in set(group) if group.count(k) > 1)
    part, linededup.PART = linededup.PART, 16
    try:
        pages = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "node long, host string, keys array<string>")
        found = linededup.near_copies(pages.select("node", "host", linededup._marks(F.col("keys")).alias("marks"))).collect()
    finally:
        linededup.PART = part
    groups = {}
    for r in found:
        groups.setdefault(r.root, []).append(r.node)
    assert sorted(sorted(g) for g in groups.values()) == want and len(want) > 0
