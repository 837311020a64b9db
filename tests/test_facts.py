import datetime as dt
import random
import time
from decimal import Decimal

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.operators import facts as FA
from dossier.plans import service
from dossier.schemas import FACTS, FILINGS
from dossier.sources.tables import TableStore

CONCEPTS = {k: c for k, _, c, _ in K.METRICS}


def py_lookup(question, filing, facts):
    metric = {"revenue": "revenue", "assets": "assets"}.get(question)
    if metric is None:
        return None
    year = question_year if (question_year := filing["q_year"]) else filing["fiscal_year"]
    quarter = filing["q_quarter"] if filing["q_quarter"] is not None else filing["fiscal_quarter"]
    form = filing["form_type"]
    period = "FY" if form == "10-K" else (f"Q{quarter}" if quarter is not None else None)

    def find(**wanted):
        return [f for f in facts if f["cik"] == filing["cik"] and f["concept"] in CONCEPTS[metric]
                and all(v is None or f[k] == v for k, v in wanted.items())]

    for tier, wanted in enumerate((
        dict(fiscal_year=year, fiscal_quarter=quarter, fiscal_period=period, form_type=form, accession_number=filing["accession_number"]),
        dict(fiscal_year=year, fiscal_quarter=quarter, fiscal_period=period, form_type=form),
        dict(fiscal_year=year, fiscal_quarter=quarter),
    ), 1):
        found = find(**wanted)
        if found:
            best = min(found, key=lambda f: (CONCEPTS[metric].index(f["concept"]), -(f["filed_date"].toordinal() if f["filed_date"] else 0), -f["ingest_seq"][-1]))
            return tier, best["source_key"]
    return None


def test_tiered_lookup_matches_nested_loops(spark):
    rng = random.Random(11)
    filings, facts, questions = [], [], []
    for i in range(60):
        form = rng.choice(["10-K", "10-Q", "8-K"])
        filings.append(dict(accession_number=f"a{i}", cik=rng.choice("xy"), form_type=form, fiscal_year=rng.choice([2023, 2024, None]),
                            fiscal_quarter=rng.choice([1, 2, None]) if form != "10-K" else None, q_year=rng.choice([None, 0, 2024]), q_quarter=rng.choice([None, None, 1])))
    for n in range(400):
        facts.append(dict(source_key=f"k{n}", cik=rng.choice("xy"), accession_number=rng.choice([None, f"a{rng.randrange(60)}"]),
                          concept=rng.choice(CONCEPTS["revenue"] + CONCEPTS["assets"]), label="l", unit="USD", value=Decimal(n),
                          fiscal_period=rng.choice(["FY", "Q1", "Q2", None]), fiscal_year=rng.choice([2023, 2024, None]), fiscal_quarter=rng.choice([1, 2, None]),
                          form_type=rng.choice(["10-K", "10-Q", None]), filed_date=rng.choice([None, dt.date(2024, 1, rng.randint(1, 20))]), frame=None, ingest_seq=[1, 0, 0, 0, n], filing_accession=None))
    expected = {}
    for i, filing in enumerate(filings):
        question = rng.choice(["revenue", "assets", "weather"])
        questions.append((f"q{i}", question, filing["accession_number"], None, filing["q_year"], filing["q_quarter"]))
        expected[f"q{i}"] = py_lookup(question, filing, facts)
    rows = [(f["accession_number"], f["cik"], f["form_type"], None, None, f["fiscal_year"], f["fiscal_quarter"], None, None) for f in filings]
    filings_df = spark.createDataFrame(rows, FILINGS)
    order = [c.strip().split()[0] for c in FACTS.replace("decimal(38,6)", "d").split(",")]
    facts_df = spark.createDataFrame([tuple(f[c] for c in order) for f in facts], FACTS)
    asked = spark.createDataFrame(questions, "question_id string, question string, accession_number string, form_type string, fiscal_year int, fiscal_quarter int")
    got = {r.question_id: (r.tier, r.fact.source_key) if r.fact else None for r in FA.lookup(asked, filings_df, facts_df).collect()}
    assert got == expected

    # The kept table gives the same: built at once, and over loads in which facts come late and come again.
    def kept(best):
        return {r.question_id: (r.tier, r.fact.source_key) if r.fact else None for r in FA.lookup(asked, filings_df, best).collect()}

    assert kept(FA.best_facts(facts_df)) == expected
    late = F.crc32("source_key") % 2 == 0
    best = FA.best_facts(facts_df.where(late))
    assert kept(FA.merge_best(best, facts_df.where(~late | (F.crc32("source_key") % 3 == 0)))) == expected
    assert any(v and v[0] == 2 for v in expected.values()) and any(v and v[0] == 3 for v in expected.values())


def test_a_late_older_fact_does_not_replace_a_newer_one(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    order = [c.strip().split()[0] for c in FACTS.replace("decimal(38,6)", "d").split(",")]

    def load(*facts):
        base = dict(cik="x", accession_number=None, concept=CONCEPTS["assets"][0], label="l", unit="USD", fiscal_period="FY", fiscal_year=2024,
                    fiscal_quarter=None, form_type="10-K", frame=None, filing_accession=None)
        rows = [{**base, "source_key": k, "value": Decimal(v), "filed_date": dt.date(2024, 1, day), "ingest_seq": [n], **more} for k, v, day, n, more in facts]
        service.store_facts(store, spark.createDataFrame([tuple(r[c] for c in order) for r in rows], FACTS))

    def newest():
        return {(r.newest.source, r.fact.label) for r in store.read("best_facts", cik="x").collect()}

    load(("new", 2, 9, 1, {}))
    load(("old", 1, 3, 2, {}))
    assert newest() == {("new", "l")}
    load(("tie", 3, 9, 3, {}))
    assert newest() == {("tie", "l")}
    load(("new", 2, 9, 4, {"label": "again"}))  # re-delivered: it keeps its first place
    assert newest() == {("tie", "l")}
    load(("tie", 3, 9, 5, {"label": "renamed"}))
    assert newest() == {("tie", "renamed")}
    assert store.read("facts").count() == 3


def test_a_request_is_decided_among_the_keys_of_its_company_only(spark, monkeypatch):
    """One row a fact is moved, whatever the number of keys it answers to; nulls on either side meet nothing."""
    order = [c.strip().split()[0] for c in FACTS.replace("decimal(38,6)", "d").split(",")]
    base = dict(cik="x", accession_number="a1", concept="Assets", label="l", unit="USD", value=Decimal(1), fiscal_period="FY", fiscal_year=2024,
                fiscal_quarter=None, form_type="10-K", filed_date=dt.date(2024, 1, 1), frame=None, filing_accession=None, ingest_seq=[1])
    changes = [{}, {"filed_date": None, "ingest_seq": [9]}, {"accession_number": "a2", "form_type": None, "fiscal_year": 2020, "fiscal_quarter": 3},
               {"cik": None}, {"accession_number": "a2", "form_type": "10-Q", "fiscal_year": 2021, "fiscal_quarter": 2, "fiscal_period": "Q2"}]
    facts = spark.createDataFrame([tuple({**base, "source_key": f"k{i}", **c}[n] for n in order) for i, c in enumerate(changes)], FACTS)
    filed = [("a1", "x", "10-K", 2024, None), ("a2", "x", "10-Q", 2021, 2), ("a3", "x", "8-K", 2020, 3), ("a4", None, "10-K", 2024, None), ("a5", "x", None, 2021, None)]
    filings = spark.createDataFrame([(a, c, t, None, None, y, q, None, None) for a, c, t, y, q in filed], FILINGS)
    asked = [(f"q{a}", "assets", a, None, None, None) for a, *_ in filed] + [("none", "weather", "a1", None, None, None), ("open", "assets", "a3", None, 2021, None)]
    asked = spark.createDataFrame([*asked, asked[0]], "question_id string, question string, accession_number string, form_type string, fiscal_year int, fiscal_quarter int")
    moved = []
    explode = FA.F.explode
    monkeypatch.setattr(FA.F, "explode", lambda c: (moved.append(str(c)), explode(c))[1])
    got = {r.question_id: (r.tier, r.fact.source_key if r.fact else None, r.reason) for r in FA.lookup(asked, filings, facts).collect()}
    assert got == {
        "qa1": (1, "k0", None), "qa2": (1, "k4", None), "qa3": (3, "k2", None), "qa4": (None, None, "fact_not_found"), "qa5": (3, "k4", None),
        "none": (None, None, "no_metric_match"), "open": (None, None, "fact_not_found"),
    }
    assert len(moved) == 2 and all("asks" in m for m in moved)  # facts themselves are not spread over their keys


def test_the_kept_table_has_no_more_rows_than_there_are_facts(spark, tmp_path):
    """A fact is kept once, not under every key it answers to; a table kept in another form is made anew."""
    order = [c.strip().split()[0] for c in FACTS.replace("decimal(38,6)", "d").split(",")]
    base = dict(cik="x", accession_number="a1", concept="Assets", label="l", unit="USD", value=Decimal(1), fiscal_period="FY", fiscal_year=2024,
                fiscal_quarter=1, form_type="10-K", filed_date=dt.date(2024, 1, 1), frame=None, filing_accession=None, ingest_seq=[1])
    changes = [{}, {"accession_number": "a2"}, {"form_type": None}, {"fiscal_year": None, "cik": None}, {"ingest_seq": [2], "label": "newer"}, {"concept": "other"}]
    facts = spark.createDataFrame([tuple({**base, "source_key": f"k{i}", **c}[n] for n in order) for i, c in enumerate(changes)], FACTS)
    assert {r.newest.source for r in FA.best_facts(facts).collect()} == {"k1", "k2", "k3", "k4"}
    assert FA.best_facts(facts).count() == 4 and FA.merge_best(FA.best_facts(facts), facts).count() == 4
    store = TableStore(spark, str(tmp_path))
    store.update("best_facts", facts.select("cik"), lambda _: spark.sql("select 'x' cik, 'Assets' concept, '1' lookup_key, 1 fact_fiscal_year"))
    assert "newest" not in service.known_facts(store, facts).columns
    service.store_facts(store, facts)
    kept = service.known_facts(store, facts.where("cik = 'x'"))
    assert sorted((r.newest.source, r.fact.label) for r in kept.collect() if r.cik) == [("k1", "l"), ("k2", "l"), ("k4", "newer")]


def test_only_facts_of_companies_that_are_asked_about_are_moved(spark, monkeypatch):
    """With few companies the others' facts leave before the shuffle; with many all are moved. Both give the same."""
    order = [c.strip().split()[0] for c in FACTS.replace("decimal(38,6)", "d").split(",")]
    base = dict(accession_number="a1", concept="Assets", label="l", unit="USD", value=Decimal(1), fiscal_period="FY", fiscal_year=2024, fiscal_quarter=None,
                form_type="10-K", filed_date=dt.date(2024, 1, 1), frame=None, filing_accession=None, ingest_seq=[1])
    facts = spark.createDataFrame([tuple({**base, "source_key": f"k{c}", "cik": c}[n] for n in order) for c in ("x", "y", None)], FACTS)
    filings = spark.createDataFrame([("a1", "x", "10-K", None, None, 2024, None, None, None), ("a2", "y", "10-K", None, None, 2024, None, None, None)], FILINGS)
    asked = spark.createDataFrame([("q1", "assets", "a1", None, None, None), ("q2", "weather", "a2", None, None, None)],
                                  "question_id string, question string, accession_number string, form_type string, fiscal_year int, fiscal_quarter int")

    def run():
        found = FA.lookup(asked, filings, facts)
        return found._jdf.queryExecution().optimizedPlan().toString(), {r.question_id: r.fact and r.fact.source_key for r in found.collect()}

    plan, got = run()
    assert "LeftSemi" in plan and got == {"q1": "kx", "q2": None}
    monkeypatch.setattr(FA, "BROADCAST_COMPANIES", 0)
    plan, got = run()
    assert "LeftSemi" not in plan and got == {"q1": "kx", "q2": None}


def test_source_keys_are_packed_and_come_back(spark):
    digests = ["00" * 32, "0f" * 32, "f0" * 32, "ff" * 32]
    keys = [*digests, None, "", "s1", "FF" * 32, "g" * 64, "é", "a" * 63]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", FA._packed(F.col("k")).alias("p"))
    rows = df.select("k", "p", FA._unpacked(F.col("p")).alias("u")).collect()
    assert [r.u for r in rows] == keys
    packed = {r.k: bytes(r.p) for r in rows if r.k is not None}
    assert sorted(digests, key=packed.get) == digests and all(len(packed[d]) == 33 for d in digests)


def test_no_shuffle_stays_when_a_table_is_written(spark):
    from dossier.session import durable, durable_parts, release

    def held():
        root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(f.getName().startswith("shuffle_") for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(root))

    df = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    before = held()
    whole = durable(df, "t")
    parts = durable_parts([df.where(F.col("k") % 3 == i) for i in range(3)], "t", "zstd")
    deadline = time.time() + 20
    while held() > before and time.time() < deadline:
        time.sleep(0.2)
    assert held() <= before
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect())) and len(whole.collect()) == 7
    release(spark)
