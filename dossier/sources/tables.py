"""The stored tables: parquet files in buckets of their main key, named by a manifest, with idempotent writes.

A table is the set of files that its manifest names. A write puts the rows of the buckets it touches into new files, then
replaces the manifest by one rename: before it every reader sees the old table whole, after it the new one. A reader keeps
the files of the manifest it opened; they are deleted by the write after the next one, so a reader must be done by then. What
a crash leaves behind is never read and ``sweep`` removes it. The manifest holds the schema too, so no footer is read to
find it, and files written before a column was added give nulls for it.

Every table is bucketed by a hash of the key it is looked up by, so a lookup opens the files of one bucket and a write
replaces only the buckets of its keys. Their number doubles as the table grows, so that a bucket keeps its size. Within a
bucket rows are sorted by a second key, whose column index and Bloom filters spare the other row groups.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier import schemas
from dossier.operators.retrieval import filter_by
from dossier.operators.upserts import replace_by_key, upsert
from dossier.session import in_request, intermediates, remove

KEYS = {"companies": ("cik",), "filings": ("accession_number",), "facts": ("source_key",)}
# The column whose hash decides the bucket; equal keys always share it.
BUCKETED_BY = {"companies": "cik", "facts": "cik", "best_facts": "cik"}
# The order within a bucket; the first column, and those of BLOOM, are looked up without the main key.
SORTED_BY = {"companies": ("ticker",), "filings": ("cik", "form_type", "filing_date"), "facts": ("concept", "source_key"), "best_facts": ("concept", "lookup_key")}
BLOOM = {"facts": ("source_key",)}
# Columns that an update leaves as they were first stored.
KEPT = {"facts": ("ingest_seq",)}
BUCKETS = 16
BUCKET_BYTES = 256 << 20
MANIFEST = "MANIFEST"


class TableStore:
    """Parquet tables below one folder; ``buckets`` is the number that a new table starts with."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self.bucket_bytes = bucket_bytes

    # ---- files ----

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self, name: str) -> dict | None:
        """``buckets, schema, files`` (by bucket: path and bytes) and the paths that the last write put out of use."""
        path, files = self._path(name, MANIFEST), self._files()
        if not files.exists(path):
            return None
        stream = files.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, name: str, manifest: dict) -> None:
        """Replace the manifest by one rename."""
        jvm, target, fresh = self.spark._jvm, self._path(name, MANIFEST), self._path(name, f"{MANIFEST}-{uuid.uuid4().hex}")
        out = self._files().create(fresh)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE
        qualified = self._files().makeQualified(target)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._files().makeQualified(fresh), qualified, how)

    def _written(self, name: str, folder: str) -> dict[str, list]:
        """The data files of a finished write, by bucket."""
        found: dict[str, list] = {}
        listing = self._files().listFiles(self._path(name, folder), True)
        while listing.hasNext():
            status = listing.next()
            path = status.getPath()
            bucket = path.getParent().getName().removeprefix("bucket=")
            if path.getName().endswith(".parquet"):
                found.setdefault(bucket, []).append([f"{folder}/bucket={bucket}/{path.getName()}", status.getLen()])
        return found

    def sweep(self, name: str) -> list[str]:
        """Remove the folders of writes that never became part of the table; run it while nobody writes."""
        manifest = self.manifest(name) or {"files": {}, "stale": []}
        live = {path.split("/")[0] for files in manifest["files"].values() for path, _ in files} | {p.split("/")[0] for p in manifest["stale"]}
        gone = []
        if self._files().exists(self._path(name)):
            for status in self._files().listStatus(self._path(name)):
                folder = status.getPath().getName()
                if folder != MANIFEST and not folder.startswith(".") and folder not in live:
                    remove(self.spark, f"{self.root}/{name}/{folder}")
                    gone.append(folder)
        return gone

    # ---- reading ----

    def _key(self, name: str) -> str:
        return BUCKETED_BY.get(name, "accession_number")

    def _empty(self, name: str) -> DataFrame:
        schema = getattr(schemas, name.upper(), None)
        if schema is None:
            raise FileNotFoundError(f"{self.root}/{name}")
        return self.spark.createDataFrame([], schema)

    def _load(self, name: str, manifest: dict, wanted: Iterable[int] | None = None) -> DataFrame:
        """The files of the wanted buckets (all by default), under the table's schema."""
        schema = T.StructType.fromJson(manifest["schema"])
        keys = manifest["files"] if wanted is None else [str(b) for b in wanted]
        paths = [f"{self.root}/{name}/{path}" for b in keys for path, _ in manifest["files"].get(b, [])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths).select(*schema.names)

    def read(self, name: str, **equal: object) -> DataFrame:
        """The table under equality conditions, which reach the parquet scan; one on the main key opens one bucket."""
        manifest = self.manifest(name)
        if manifest is None:
            return filter_by(self._empty(name), **equal)
        value = equal.get(self._key(name))
        wanted = None
        if value is not None:  # a constant, evaluated without a job
            wanted = [self.spark.sql("select 1").select(_bucket(F.lit(value), manifest["buckets"]).alias("b")).first().b]
        return filter_by(self._load(name, manifest, wanted), **equal)

    def read_for(self, name: str, keys: DataFrame) -> DataFrame:
        """The buckets of the table that hold the given keys (at most all of them), for joins with those keys."""
        manifest = self.manifest(name)
        if manifest is None:
            return self._empty(name)
        return self._load(name, manifest, buckets_of(keys, self._key(name), manifest["buckets"]))

    # ---- writing ----

    def _write(self, name: str, rows: DataFrame, buckets: int) -> dict[str, list]:
        """Put rows into new files: gathered by bucket for few files, large buckets split, sorted by the second key."""
        folder = f"data-{uuid.uuid4().hex}"
        key = self._key(name)
        spread = rows.withColumn("bucket", _bucket(F.col(key), buckets)).hint("rebalance", "bucket")
        writer = spread.sortWithinPartitions("bucket", *SORTED_BY.get(name, (key,))).write.partitionBy("bucket")
        for column in BLOOM.get(name, ()):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer.parquet(f"{self.root}/{name}/{folder}")
        return self._written(name, folder)

    def _rewrite(self, name: str, affected: DataFrame, change: Callable[[DataFrame | None], DataFrame]) -> None:
        """Replace the buckets of the affected keys by what ``change`` makes of their rows."""
        old = self.manifest(name)
        buckets = old["buckets"] if old else self.buckets
        touched = buckets_of(affected, self._key(name), buckets)
        with intermediates(self.spark):
            rows = change(self._load(name, old, touched) if old else None)
            fields = {f["name"]: f for f in (old["schema"]["fields"] if old else [])}
            for field in rows.schema.jsonValue()["fields"]:
                fields.setdefault(field["name"], {**field, "nullable": True})
            fresh = self._write(name, rows, buckets)
        kept = {b: files for b, files in (old["files"].items() if old else ()) if int(b) not in touched}
        manifest = {
            "buckets": buckets, "schema": {"type": "struct", "fields": list(fields.values())}, "files": {**kept, **fresh},
            "stale": [path for b, files in (old["files"].items() if old else ()) if int(b) in touched for path, _ in files],
        }
        total = sum(size for files in manifest["files"].values() for _, size in files)
        if total > 2 * buckets * self.bucket_bytes:
            # Outgrown: all rows once more into twice as many buckets, or as often as it takes.
            while total > 2 * buckets * self.bucket_bytes:
                buckets *= 2
            grown = self._write(name, self._load(name, manifest), buckets)
            replaced = [path for files in manifest["files"].values() for path, _ in files]
            manifest = {**manifest, "buckets": buckets, "files": grown, "stale": [*manifest["stale"], *replaced]}
        self._commit(name, manifest)
        for path in old["stale"] if old else ():
            remove(self.spark, f"{self.root}/{name}/{path}")

    def upsert(self, name: str, incoming: DataFrame, order: Sequence[str]) -> None:
        """Insert or overwrite rows by key; the last of ``order`` wins among incoming rows of a key."""
        columns = self.read(name).columns
        extra = [c for c in order if c not in columns]
        rows = incoming.select(*columns, *extra)
        kept = KEPT.get(name, ())

        def change(stored: DataFrame | None) -> DataFrame:
            return upsert(stored if stored is not None else self._empty(name), rows, KEYS[name], order, kept)

        self._rewrite(name, rows, change)

    def replace(self, name: str, incoming: DataFrame, affected: DataFrame) -> None:
        """Delete the affected filings' rows and add the incoming ones; all other filings keep theirs."""

        def change(stored: DataFrame | None) -> DataFrame:
            if stored is None:
                return incoming
            # Columns that only one side has (an index with and without sparse vectors) are null on the other.
            missing = [c for c in incoming.columns if c not in stored.columns]
            stored = stored.withColumns({c: F.lit(None).cast(incoming.schema[c].dataType) for c in missing})
            lacking = [c for c in stored.columns if c not in incoming.columns]
            rows = incoming.withColumns({c: F.lit(None).cast(stored.schema[c].dataType) for c in lacking})
            return replace_by_key(stored, rows, ["accession_number"], affected)

        self._rewrite(name, affected, change)

    def update(self, name: str, affected: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows in the affected keys' buckets by what ``change`` makes of them."""
        self._rewrite(name, affected, lambda stored: change(stored if stored is not None else self._empty(name)))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def buckets_of(keys: DataFrame, column: str, buckets: int) -> list[int]:
    """The buckets that a table's keys fall into: at most ``buckets`` numbers."""
    found = keys.where(F.col(column).isNotNull()).select(_bucket(F.col(column), buckets).alias("bucket"))
    return sorted({row.bucket for row in (found if in_request() else found.distinct()).collect()})


def ordered(df: DataFrame, kind: str) -> DataFrame:
    """Listing order of each kind of row."""
    orders = {
        "companies": [F.asc("name")],
        "filings": [F.desc("filing_date"), F.asc("accession_number")],
        "sections": [F.asc("section_sequence")],
        "chunks": [F.asc("chunk_id")],
        "facts": [F.desc_nulls_last("filed_date"), F.desc("ingest_seq")],
        "questions": [F.asc("question_id")],
        "runs": [F.desc("started_at")],
    }
    return df.orderBy(*orders[kind])


def numbered_filings(filings: DataFrame) -> DataFrame:
    """Position of every filing in its company's list (newest first, accession number on equal dates).

    The position is the number of filings on later days plus the rank within the day, so no task ever orders
    all filings of a company: the running sum handles one row per day.
    """
    later = Window.partitionBy("cik").orderBy(F.desc("filing_date")).rowsBetween(Window.unboundedPreceding, -1)
    days = filings.groupBy("cik", "filing_date").agg(F.count("*").alias("n"))
    before = days.select("cik", "filing_date", F.coalesce(F.sum("n").over(later), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("cik", "filing_date").orderBy("accession_number"))
    return filings.join(before, ["cik", "filing_date"]).withColumn("position", F.col("before") + within).drop("before")


def write_report(path: str, results: Iterable[dict], metrics: list[dict], lines: list[str]) -> None:
    """The report files of a run: JSON with the metrics and every question's prediction and scores, and Markdown.

    ``results`` may be long; it is written row by row.
    """
    with open(path + ".json", "w", encoding="utf-8") as out:
        out.write('{"metrics": ' + json.dumps(metrics, default=str) + ', "results": [')
        for i, row in enumerate(results):
            out.write((",\n" if i else "\n") + json.dumps(row, default=str))
        out.write("\n]}\n")
    with open(path + ".md", "w", encoding="utf-8") as out:
        out.write("\n".join(lines))
