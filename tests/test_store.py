"""The table store: manifests, crashes, growth, sorted buckets."""

import os

import pytest
from pyspark.sql import functions as F

from dossier import schemas
from dossier.sources.tables import TableStore

COMPANIES = schemas.COMPANIES + ", n int"


def companies(spark, numbers, name, n=1):
    return spark.createDataFrame([(f"{i:010d}", f"T{i}", f"{name} {i}", None, None, None, n) for i in numbers], COMPANIES)


def files_of(store, name):
    return {b: {path for path, _ in files} for b, files in store.manifest(name)["files"].items()}


def test_a_write_replaces_only_its_buckets(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), buckets=8)
    store.upsert("companies", companies(spark, range(400), "name"), ["n"])
    before = files_of(store, "companies")
    change = companies(spark, [3], "zebra", 1).union(companies(spark, [3], "ant", 2))
    store.upsert("companies", change, ["n"])
    after = files_of(store, "companies")
    assert sum(before[b] != after[b] for b in before) == 1
    written = sum(size for files in store.manifest("companies")["files"].values() for path, size in files if not any(path in v for v in before.values()))
    total = sum(size for files in store.manifest("companies")["files"].values() for _, size in files)
    assert written < total / 4
    assert store.read("companies").count() == 400 and store.read("companies", cik="0000000003").first().name == "ant 3"
    chunks = spark.createDataFrame([("a", 1), ("b", 2)], "accession_number string, n int")
    store.replace("chunks", chunks, chunks.select("accession_number"))
    store.replace("chunks", chunks.where("1 = 0"), chunks.where("accession_number = 'a'").select("accession_number"))
    assert [tuple(r) for r in store.read("chunks").select("accession_number", "n").collect()] == [("b", 2)]
    store.replace("chunks", chunks.where("1 = 0"), chunks.select("accession_number"))
    assert store.read("chunks").count() == 0 and store.read("chunks").columns == ["accession_number", "n"]
    with pytest.raises(FileNotFoundError):
        store.read("nothing")
    assert store.read("filings").count() == 0


def test_a_write_that_stops_halfway_leaves_the_table_whole(spark, tmp_path, monkeypatch):
    store = TableStore(spark, str(tmp_path), buckets=4)
    store.upsert("companies", companies(spark, range(40), "old"), ["n"])
    opened = store.read("companies")

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    with monkeypatch.context() as patch:
        patch.setattr(TableStore, "_commit", crash)
        with pytest.raises(Crash):
            store.upsert("companies", companies(spark, range(40), "new"), ["n"])
    names = {r.name.split()[0] for r in TableStore(spark, str(tmp_path)).read("companies").collect()}
    assert names == {"old"} and store.read("companies").count() == 40
    assert len(store.sweep("companies")) == 1 and store.read("companies").count() == 40
    # The write is repeated; a reader that opened the table before still sees the rows of then.
    store.upsert("companies", companies(spark, range(40), "new"), ["n"])
    assert {r.name.split()[0] for r in opened.collect()} == {"old"}
    assert {r.name.split()[0] for r in store.read("companies").collect()} == {"new"}
    # The write after the next one removes what nobody reads any more.
    store.upsert("companies", companies(spark, range(40), "third"), ["n"])
    live = {os.path.join("companies", p) for files in files_of(store, "companies").values() for p in files}
    stale = {os.path.join("companies", p) for p in store.manifest("companies")["stale"]}
    found = {os.path.relpath(os.path.join(d, f), tmp_path) for d, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".parquet")}
    assert found == live | stale and len(stale) > 0


def test_buckets_double_as_a_table_grows(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), buckets=1, bucket_bytes=4000)
    for step in range(3):
        store.upsert("companies", companies(spark, range(step * 500, step * 500 + 700), f"step{step}"), ["n"])
        manifest = store.manifest("companies")
        sizes = [sum(size for _, size in files) for files in manifest["files"].values()]
        assert sum(sizes) <= 2 * manifest["buckets"] * 4000
        assert {r.name.split()[0] for r in store.read("companies", cik=f"{step * 500 + 5:010d}").collect()} == {f"step{step}"}
    assert 2 <= manifest["buckets"] <= 64 and store.read("companies").count() == 1700
    keys = companies(spark, [7, 1650], "")
    assert store.read_for("companies", keys).join(keys, "cik", "left_semi").count() == 2


def test_a_lookup_by_the_second_key_opens_one_row_group(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("parquet.block.size", "65536")
    try:
        store = TableStore(spark, str(tmp_path), buckets=2)
        key = F.sha2(F.col("id").cast("string"), 256)
        values = [F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schemas.FACTS).schema]
        rows = spark.range(60_000).select("id", *values)
        rows = rows.withColumns({
            "source_key": key, "cik": F.lpad((F.col("id") % 50).cast("string"), 10, "0"), "concept": F.format_string("Concept%02d", F.col("id") % 40),
            "ingest_seq": F.array("id"), "label": F.sha2(key, 512),
        })
        store.upsert("facts", rows.drop("id"), ["ingest_seq"])
    finally:
        conf.unset("parquet.block.size")
    wanted = rows.where("id = 12345").first()

    def scanned(found):
        assert found.count() == 1
        got = found.select("label")
        assert got.collect()[0].label == wanted.label
        leaves = got._jdf.queryExecution().executedPlan().collectLeaves()
        return leaves.apply(0).metrics().apply("numOutputRows").value()

    assert scanned(store.read("facts", source_key=wanted.source_key)) < 6000
    assert scanned(store.read("facts", cik=wanted.cik, concept=wanted.concept, source_key=wanted.source_key)) < 3000
    assert store.read("facts", concept="Concept07").count() == 1500
