"""The operators of the pipeline against brute force on small tables, and their edge cases."""

import itertools
import os
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from dossier.llm import common, decontam, langid, linededup, packing, simhash

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    docs = {r.doc_id: brute_print(r.text) for r in rows_of(spark, "documents")}
    links = [(a, b) for a, b in itertools.combinations(docs, 2) if (docs[a] ^ docs[b]).bit_count() <= 3]
    root = groups(docs, links)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in entry.queries()["op4_simhash"](spark, SF).collect()}
    assert found == {i: (f"{fp:016x}", root[i]) for i, fp in docs.items()}


@pytest.mark.parametrize("shard", [1, 3, 8, 4096])
def test_links_connect_the_same_at_any_shard_size(spark, shard):
    import random

    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(12)] + [0]
    values = set(seeds)
    for _ in range(150):
        value = rng.choice(sorted(values))
        for _ in range(rng.randint(1, 4)):
            value ^= 1 << rng.randrange(64)
        values.add(value)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(v,) for v in signed.values()], "fp long")
    got = {r.node: r.root for r in common.components(simhash.links(df, shard=shard)).collect()}
    want = groups(signed.values(), [(signed[a], signed[b]) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 3])
    assert {v: got.get(v, v) for v in signed.values()} == want


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (160, 100), (160, 100)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 161)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(5, text, "en", "s", 1), (3, text, "en", "s", 1), (3, text, "en", "s", 1), (None, text, None, None, None),
            (9, "quite another text of some words", "en", "s", 1), (None, None, None, None, None), (12, "", "x", "y", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("KT", F.lit("clash")).withColumn("fp", F.lit(1))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 9, 12]
    assert simhash.keep_one(docs.where("1 = 0")).count() == 0
    alone = simhash.keep_one(docs.where("doc_id is null and text is null")).collect()
    assert len(alone) == 1
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.component_id for r in found if r.doc_id in (3, 5)} == {3}


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_hits(text, items):
    words, hit, found = words_of(text), set(), set()
    for key, item in items:
        parts = words_of(item)
        size = min(13, len(parts))
        for w in range(len(parts) - size + 1) if size else []:
            for at in range(len(words) - size + 1):
                if words[at:at + size] == parts[w:w + size]:
                    hit.update(range(at, at + size))
                    found.add(key)
    return len(words), len(hit), sorted(map(str, found))


def test_decontamination_equals_brute_force(spark):
    bench = [(r.item_id, r.text) for r in rows_of(spark, "benchmark")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000")
    some = docs.orderBy(F.xxhash64("doc_id")).limit(60)
    planted = spark.createDataFrame(
        [(10**6, "Before. " + bench[3][1].upper() + " after it", "en", "s", 0), (10**6 + 1, "plain words only", "en", "s", 0)], DOCS
    )
    docs = some.union(planted)
    want = {r.doc_id: brute_hits(r.text, bench) for r in docs.collect()}
    table = spark.createDataFrame(bench, "item_id long, text string")
    for bound in (10**6, 300):
        got = decontam.find(docs, table, words_per_set=bound)
        assert {r.doc_id: (r.found.n_words, r.found.n_hit, r.found.item_ids) for r in got.collect()} == want
    assert want[10**6][1] >= 13
    kept = {r.doc_id for r in decontam.remove(docs, table).collect()}
    assert kept == {i for i, (n, hit, _) in want.items() if not (hit and 20 * hit >= n)}


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "Short item"), (2, None), (3, "..."), (None, "null owner here"), (1, "Short item")], "item_id long, text string")
    rows = [(1, "a SHORT, item; short item"), (2, None), (3, ""), (4, "null owner here"), (1, "a SHORT, item; short item"), (5, "clean " * 100 + "short item")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1))
    got = decontam.find(docs, bench, out="found")
    assert got.columns == ["doc_id", "text", "found", "found_"]
    want = {1: (5, 4, ["1"]), 2: (0, 0, []), 3: (0, 0, []), 4: (3, 3, []), 5: (102, 2, ["1"])}
    assert {r.doc_id: (r.found_.n_words, r.found_.n_hit, r.found_.item_ids) for r in got.collect()} == want
    assert sorted(r.doc_id for r in decontam.remove(docs, bench).collect()) == [2, 3, 5]
    cut = {r.doc_id: r.text for r in decontam.remove(docs, bench, mode="spans").collect()}
    assert cut[1] == "a " and cut[5].endswith("short item") and cut[2] is None
    assert decontam.find(docs, bench.where("1 = 0")).where("found_.n_hit > 0").count() == 0
    assert decontam.find(docs.where("1 = 0"), bench).count() == 0


def exact_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [encoder.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def check_packing(spark, docs, packed, capacity=2048):
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = dict(zip(texts, exact_ids(texts.values())))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packed.collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for key, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            part = ids[key][at:at + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))
            assert r.piece == 0 or r.length == capacity
            at += r.length
        assert at == len(ids[key])
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), -(-sum(map(len, ids.values())) // capacity)


def test_packing_is_complete_and_tight(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made, least = check_packing(spark, docs, entry.queries()["op9_best_fit_packing"](spark, SF))
    assert made <= 1.05 * least + 2


def test_packing_edges(spark):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> as text"), (4, "a" * 5000 + " " * 5000 + "b"), (None, "no id"),
            (6, "𝔘nicode é ü ​ ß " * 40), (2**60 + 1, "large id"), (8, "x " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit(1)).withColumn("piece", F.lit("p"))
    pieces = packing.tokenise(docs, capacity=2048)
    check_packing(spark, docs, packing.pack(common.materialise(pieces.drop("ids"))))
    assert packing.pack(packing.tokenise(docs.where("1 = 0"))).count() == 0
    held = packing.pack(common.materialise(pieces)).collect()
    assert all(len(r.ids) == r.length for r in held)
    repeated = docs.where("doc_id = 2").union(docs.where("doc_id = 2"))
    assert packing.pack(packing.tokenise(repeated)).count() == 2


@pytest.mark.parametrize("limits", [{"max_documents": 2}, {"max_attention": 900}, {"max_documents": 3, "max_attention": 1200}])
def test_packing_holds_every_capacity(spark, limits):
    pieces = spark.createDataFrame([(i, (i * 7) % 30 + 1) for i in range(200)], "doc_id long, length long")
    got = packing.pack(pieces, capacity=64, group=60, **limits)
    sums = got.groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count("*").alias("n"), F.sum(F.col("length") ** 2).alias("c"))
    for r in sums.collect():
        assert r.t <= 64 and r.n <= limits.get("max_documents", 64) and r.c <= limits.get("max_attention", 64 * 64)
    assert got.count() == 200
    with pytest.raises(Exception):
        packing.pack(spark.createDataFrame([(1, 65)], "doc_id long, length long"), capacity=64).collect()


def test_language_of_held_out_documents(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    got = entry.queries()["op3_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id")
    assert got.where("held_out").count() > 100
    right = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double"))).first()[0]
    assert right >= 0.97
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    held = {r.doc_id: r.held_out for r in got.collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in held}


def greedy(text, training):
    phrases = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and any(text[at:at + size + 1] in t for t in training):
            size += 1
        phrases, at = phrases + 1, at + size
    return phrases


def test_parsing_equals_greedy_longest_matches():
    excerpts = {"a": ["the cat sat on the mat", "a hat"], "b": ["der hund und die katze", "ein hut"]}
    model = langid.Model(excerpts)
    texts = ["the hat sat", "die katze und", "xyz qq", "cat", "", "the the the zat "]
    counts = model.phrases([model.symbols(t) for t in texts])
    for text, row in zip(texts, counts):
        assert [int(c) for c in row] == [greedy(text, excerpts[name]) for name in model.langs]


def test_parsing_with_any_number_of_letters_equals_greedy_matches(monkeypatch):
    import random

    rng = random.Random(3)
    han = [chr(0x4E00 + i) for i in range(700)]
    excerpts = {"zh": ["".join(rng.choices(han, k=150)) for _ in range(8)], "en": ["the cat sat on the mat", "a hat"]}
    texts = [excerpts["zh"][2][20:90] + excerpts["zh"][5][:40], "the hat sat", "".join(rng.choices(han, k=80)), "", excerpts["zh"][0][:30] + " cat"]
    for dense in (0, langid.DENSE, 10**6):
        monkeypatch.setattr(langid, "DENSE", dense)
        model = langid.Model(excerpts)
        assert model.sparse == (dense < 10**6)
        for text, row in zip(texts, model.phrases([model.symbols(t) for t in texts])):
            assert [int(c) for c in row] == [greedy(text, excerpts[name]) for name in model.langs]


def test_a_language_of_many_letters_is_kept(spark):
    import random

    rng = random.Random(5)
    words = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(2)) for _ in range(1500)]
    rows = [(i, "".join(rng.choices(words, k=120)), "zh") for i in range(120)]
    rows += [(1000 + i, "the cat and the dog of the house " * (i + 2), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where(langid.training_rows(docs)))
    kept = {r.doc_id for r in langid.keep_identified(docs, model).collect()}
    assert kept == {r[0] for r in rows}
    assert langid.identify(docs, model).where("language.lang <> lang").count() == 0


def test_language_edges(spark):
    rows = [(1, "the cat and the dog of the house", "en"), (2, "la maison et le chat de la rue", "fr"), (3, None, "en"), (4, "", None),
            (5, "123 --- 456", "en"), (None, "the dog", "en"), (6, "the cat", None), (1, "the cat and the dog of the house", "en"), (7, "the cat " * 9000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("language", F.lit("x"))
    model = langid.fit(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r.language_.lang for r in got}
    assert found[1] == found[6] == found[7] == "en" and found[2] == "fr" and found[3] == found[4] == found[5] == "und"
    kept = langid.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2, 6, 7, None}
    none = langid.fit(docs.where("1 = 0"))
    assert {r.language_.lang for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.where("1 = 0"), model).count() == 0


def test_lines_of_a_site(spark):
    rows = [(i, "big", f"Menu  HOME\nown line {i}\n\nmenu home ") for i in range(10)]
    rows += [(20, "big", "menu home again\nrare"), (21, "small", "Menu home"), (22, None, "Menu home"), (23, "big", None), (24, "big", "")]
    pages = spark.createDataFrame(rows, "page_id long, host string, text string").withColumn("hashes", F.lit(1)).withColumn("rule_host", F.lit(2))
    got = linededup.drop_lines(pages, counts=("n_lines", "n_dropped"))
    assert got.columns == [*pages.columns, "n_lines", "n_dropped"]
    found = {r.page_id: (r.text, r.n_lines, r.n_dropped) for r in got.collect()}
    assert found[3] == ("own line 3\n", 4, 2)
    assert found[20] == ("menu home again\nrare", 2, 0) and found[21] == ("Menu home", 1, 0) and found[22] == ("Menu home", 1, 0)
    assert found[23] == (None, 0, 0) and found[24] == ("", 1, 0)
    assert linededup.drop_lines(pages.where("1 = 0")).count() == 0
    assert linededup.drop_lines(pages, ratio=0.99).where("text like 'own%'").count() == 0


def test_copies_of_a_text_do_not_empty_it(spark):
    hot = "\n".join(f"clean line {i}" for i in range(6))
    rows = [(i, hot, "en", "big", 0) for i in range(40)] + [(100 + i, hot.upper(), "en", "few", 0) for i in range(5)]
    rows += [(200 + i, f"Menu\nown words of {i}", "en", "big", 0) for i in range(80)] + [(300, "other", "en", "few", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    found = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, SF).collect()}
    assert found[0] == found[39] == hot and found[100] == found[104] == hot.upper() and found[207] == "own words of 7"
    kept = {r.text for r in corpus_pipeline.near_duplicates(spark, corpus_pipeline.lines(spark, docs, SF), SF).collect()}
    assert kept & {hot, hot.upper()} and "" not in kept
    # A host of one page in many copies has no line that its pages share.
    pages = docs.where("source = 'few' and doc_id < 300").select("doc_id", F.col("source").alias("host"), "text")
    assert linededup.drop_lines(pages, counts=("n", "dropped")).where("dropped > 0").count() == 0


def jaccard(a, b):
    a, b = ({tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_at_a_similarity_of_0_8_go(spark):
    import random

    rng = random.Random(11)
    texts = {}
    for i in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts[i] = " ".join(words)
        for at in (rng.sample(range(10, 190, 20), 4) if i % 2 else range(10, 190, 20)):  # J 0.81 or more, and far below 0.8
            words[at] = "changed"
        texts[100 + i] = " ".join(words)
    alike = {i for i in range(30) if jaccard(texts[i], texts[100 + i]) >= 0.8}
    assert alike == set(range(1, 30, 2))
    # One group of near copies larger than a bucket.
    texts.update({1000 + i: texts[1] + f" end{i}" for i in range(40)})
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], DOCS)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert kept == set(range(30)) | {100 + i for i in range(30) if i not in alike}


def test_pipeline_runs_and_each_stage_keeps_its_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, SF))
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.collect()}
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", None, 0), (2, "a b", None, "s", None)]
    odd = spark.createDataFrame(rows, DOCS).withColumn("FP", F.lit(1))
    for sample in (odd, odd.where("1 = 0")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, sample, SF).columns == odd.columns
            stage(spark, sample, SF).count()
        corpus_pipeline.sequences(spark, sample, SF).count()


def test_near_copies_are_linked_by_fingerprints_too(spark):
    import random

    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(40)]
    # Fingerprints within the radius, but a Jaccard similarity over five-word shingles of less than 0.8.
    first, found = " ".join(words), None
    for at in range(5, 35):
        other = " ".join([*words[:at], "changed", *words[at + 1:]])
        bits = (simhash.fingerprint(first) ^ simhash.fingerprint(other)) & 0xFFFFFFFFFFFFFFFF
        if bits.bit_count() <= simhash.RADIUS and jaccard(first, other) < 0.8:
            found = other
    assert found
    rows = [(5, first), (6, found), (7, "quite another text of a few words")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()} == {5, 7}


def test_shuffle_files_go_with_their_job(spark, monkeypatch):
    import time

    local = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {name for folder in local for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}

    def grouped(spark, docs, sf):
        return common.materialise(docs.groupBy("lang").agg(F.max("doc_id").alias("doc_id")))

    before, setting = files(), spark.conf.get(corpus_pipeline.CLEANUP, None)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", grouped), ("two", grouped)])
    rows = corpus_pipeline.run(spark, SF).count()
    assert rows == spark.read.parquet(f"{SF}/documents.parquet").select("lang").distinct().count()
    with corpus_pipeline.shuffles_removed(spark):
        common.materialise(spark.range(100).groupBy("id").count())
    assert spark.conf.get(corpus_pipeline.CLEANUP, None) == setting
    made = files() - before
    for _ in range(50):  # files are removed in the background
        if len(files() - before) <= 6:  # those of the two counts above, outside the block
            break
        time.sleep(0.2)
    assert len(files() - before) <= 6, made


def test_near_duplicate_stage_leaves_no_shuffle_files(spark):
    import time

    local = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def files():
        return {name for folder in local for _, _, names in os.walk(folder) for name in names if name.startswith("shuffle_")}

    docs = spark.createDataFrame([(i, f"some words of the text number {i // 2} and a few more", "en", "s", 1) for i in range(20)], DOCS)
    before = files()
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)  # its jobs have run, the stage's own rows are still lazy
    for _ in range(50):  # files are removed in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before
    assert 0 < kept.count() <= 10
