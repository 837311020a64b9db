"""Personal data, shards and vectors against brute force, and their edge cases."""

import hashlib
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from dossier.llm import pii, sharding, vectors

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def brute_base(text):
    found = []
    text = text or ""
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def test_base_spans_of_all_documents(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = entry.queries()["op1_pii"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % s for s in base).encode()).hexdigest()
        counts = Counter(s[0] for s in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in pii.KINDS)
        assert {"%s:%d:%d" % s for s in base} <= set(r.spans.split(",")) | {""}


PIECES = ["a", "b.c", "@", "@x.y", ".", "1", "12", "256", "255.1", "1.2.3.4", " ", "-", "+", "+1", "(55)", "4111111111111111", "4111 1111 1111 1111", "é", "_", "%", "dot", " at ", "zero", "one", "[at]", "аl"]


def test_base_spans_of_random_texts():
    import random

    rng, detector = random.Random(3), pii.Detector()
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14)))
        base, added = detector.detect(text)
        assert base == brute_base(text), text
        for kind, a, b in added:
            assert 0 <= a < b <= len(text) and kind in pii.KINDS


@pytest.mark.parametrize("text, kind, found", [
    ("é jоhn@exаmple.com x", "email", "jоhn@exаmple.com"),
    ("to john [at] mail (dot) example dot com!", "email", "john [at] mail (dot) example dot com"),
    ("mail bob at corp dot example dot org now", "email", "bob at corp dot example dot org"),
    ("one nine two dot one six eight dot zero dot one.", "ip", "one nine two dot one six eight dot zero dot one"),
    ("call plus one five five five zero one two three four", "phone", "plus one five five five zero one two three four"),
    ("no. ４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ("411​1 1111 1111 1111", "card", "411​1 1111 1111 1111"),
    ("+٤٤ 20 7946 0958 is", "phone", "+٤٤ 20 7946 0958"),
    ("ann.46 at mail8.example.com is", "email", "ann.46 at mail8.example.com"),
    ("ann&#64;mail&period;com", "email", "ann&#64;mail&period;com"),
    ("from 1O1.2.3.4", "ip", "1O1.2.3.4"),
    ("no. four one one one one one one one one one one one one one one one", "card", "four one one one one one one one one one one one one one one one"),
    ("x @ example.com", "email", "x @ example.com"),
])
def test_disguises_map_back_to_the_source(text, kind, found):
    _, added = pii.Detector().detect(text)
    assert [(k, text[a:b]) for k, a, b in added] == [(kind, found)]


def test_pii_edges(spark):
    texts = [None, "", "a@b.cd", "a@b.cd", "look at example.com dot", "x" * 200_000 + "@", "1" * 200_000, "+1" * 50_000, "a@b.c " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii", F.lit(1))
    got = {r.doc_id: r.pii_ for r in pii.detect(docs).collect()}
    assert [len(got[i].base) for i in range(9)] == [0, 0, 1, 1, 0, 0, 0, 0, 20_000]
    assert not any(got[i].added for i in range(9))
    assert pii.redact(docs.where("doc_id in (0, 2)")).select("text").orderBy("doc_id").collect() == [(None,), ("<email>",)]
    assert pii.detect(docs.where("1 = 0")).count() == 0


@pytest.mark.parametrize("bucket", [10_000, 1 << 25])
def test_shards_hold_every_record_once(spark, bucket):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("Bucket", F.lit("clash")).withColumn("shard", F.lit("own"))
    docs = docs.union(docs.where("doc_id < 5")).union(docs.where("doc_id < 5").withColumn("text", F.lit(None)).withColumn("doc_id", F.lit(None)))
    got = sharding.shard(docs, sharding.scratch(spark, "t"), bucket_bytes=bucket)
    assert got.columns == [*docs.columns, "shard_", "slot"]
    rows = got.collect()
    assert Counter(tuple(r)[:-2] for r in rows) == Counter(map(tuple, docs.collect()))
    slots = {}
    for r in rows:
        slots.setdefault(r.shard_, []).append(r.slot)
    assert set(slots) == set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(docs, sharding.scratch(spark, "t"), bucket_bytes=bucket).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    other = sharding.shard(docs, sharding.scratch(spark, "t"), bucket_bytes=bucket, seed=5).collect()
    assert sorted(map(str, rows)) != sorted(map(str, other))


def test_shards_of_nothing_and_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert sharding.shard(docs.where("1 = 0"), sharding.scratch(spark, "t")).count() == 0
    got = {r.doc_id: r for r in entry.queries()["op2_sharding"](spark, SF).collect()}
    for r in docs.collect():
        data = r.text.encode()
        assert (got[r.doc_id].size, got[r.doc_id].text_crc32, got[r.doc_id].law) == (len(data) + 1, zlib.crc32(data), "rows")
    # Neighbours in the input are spread: their shards look random.
    near = [got[i].shard == got[i + 1].shard for i in range(len(got) - 1)]
    assert 0.02 < np.mean(near) < 0.3


def brute_vectors(rows, threshold=0.9):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _ in rows}
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for p, (i, a) in enumerate(good):
        for j, b in good[p + 1:]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (links[i], find(i), find(i) == i) for i, _ in rows}


@pytest.mark.parametrize("tile", [40, 4096])
def test_vectors_equal_brute_force(spark, tile):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    nan, inf = float("nan"), float("inf")
    odd = [(10**6, None), (10**6 + 1, [0.0] * 64), (10**6 + 2, [nan] * 64), (10**6 + 3, [1.0, None]), (10**6 + 4, [inf, 1.0]), (10**6 + 5, []),
           (10**6 + 6, [1.0, 0.0]), (10**6 + 7, [2.0, 0.1]), (10**6 + 8, rows[3][1]), (10**6 + 9, rows[3][1]), (10**6 + 10, [-x for x in rows[3][1]])]
    odd += [(10**6 + 20 + k, [x + 0.002 * ((k * 7 + i) % 5) for i, x in enumerate(rows[9][1])]) for k in range(60)]
    some = rows[:300] + odd
    df = spark.createDataFrame(some, table.select("vec_id", "embedding").schema).withColumn("n_links", F.lit(1)).withColumn("v", F.lit("x"))
    exact = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df, tile=tile).collect()}
    assert got == brute_vectors(exact)
    if tile == 4096:
        assert vectors.near_duplicates(df.where("1 = 0")).count() == 0
        null = vectors.near_duplicates(df.where("vec_id = 3").withColumn("vec_id", F.lit(None).cast("long"))).collect()
        assert [(r.n_links, r.component_id, r.kept) for r in null] == [(0, None, False)]
