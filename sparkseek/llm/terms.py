"""Term counts by incremental signed deltas over a persistent, partitioned counts table."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.text import normalized
from sparkseek.runtime import commit_file, last_committed, materialize, read_committed

COUNTS = "word string, occurrences long, records long"
TERMS_PER_BUCKET = 250_000


def record_terms(tokens: DataFrame, rec: str = "rec_id", word: str = "word", offset: str = "tok_offset") -> DataFrame:
    """(rec_id, word, tf) in normal form.

    Null words, words without ASCII letters and digits, and rows without a record don't count. Rows with the same record and offset (null
    offsets of a record are the same) count once; should their words differ, the smallest counts. Other columns are not read. A record
    of any size is spread over tasks: nothing is grouped by record alone.
    """
    words = tokens.where(F.col(rec).isNotNull() & F.col(word).isNotNull()).select(F.col(rec).alias("rec_id"), F.col(offset).alias("at"), normalized(F.col(word)).alias("word")).where("word <> ''")
    once = words.groupBy("rec_id", "at").agg(F.min("word").alias("word"))
    return once.groupBy("rec_id", "word").agg(F.count("*").alias("tf"))


def signed_delta(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """(word, occurrences, records): the change that replacing ``before`` by ``after`` (record terms of the touched records) makes."""
    part = lambda df, s: df.select("word", (F.lit(s) * F.col("tf")).alias("o"), F.lit(s).cast("long").alias("r"))
    parts = [part(df, s) for df, s in ((before, -1), (after, 1)) if df is not None]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.groupBy("word").agg(F.sum("o").cast("long").alias("occurrences"), F.sum("r").cast("long").alias("records")).where("occurrences <> 0 or records <> 0")


class LostUpdate(RuntimeError):
    """Someone else updated the counts since the update began: it has to be applied again."""


class TermCounts:
    """Counts per term, hashed into buckets of files under ``path``.

    An update reads only the touched records' terms, before and after; it rewrites only the buckets their words fall in, into a folder of
    its own, and becomes visible at once by a manifest that names the folder of every bucket. A failed update leaves the last version in
    place; of two that started from the same version the second raises ``LostUpdate``. The number of buckets is a power of two that
    doubles as the vocabulary grows, so that merging runs in as many tasks as it needs.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 1, terms_per_bucket: int = TERMS_PER_BUCKET):
        """``buckets``: of an empty store; a power of two."""
        self.spark, self.path, self.buckets, self.terms_per_bucket = spark, path.rstrip("/"), buckets, terms_per_bucket

    def version(self) -> int:
        return last_committed(self.spark, f"{self.path}/manifests")

    def manifest(self, version: int | None = None) -> dict:
        """{"records": number of records with a term, "buckets": their number, "files": {bucket: [folder that has it, its terms]}}."""
        v = self.version() if version is None else version
        return json.loads(read_committed(self.spark, f"{self.path}/manifests", v)) if v else {"records": 0, "buckets": self.buckets, "files": {}}

    def records(self) -> int:
        return self.manifest()["records"]

    def _read(self, files: dict[str, list]) -> DataFrame:
        paths = [f"{self.path}/{folder}/bucket={b}" for b, (folder, _) in sorted(files.items())]
        return self.spark.read.schema(COUNTS).parquet(*paths) if paths else self.spark.createDataFrame([], COUNTS)

    def counts(self) -> DataFrame:
        """(word, occurrences, records) of the last version."""
        return self._read(self.manifest()["files"])

    def update(self, before: DataFrame | None = None, after: DataFrame | None = None) -> int:
        """Apply one increment: ``before``/``after`` are the record terms of the deleted and changed / added and changed records."""
        if before is None and after is None:
            return self.version()
        start = self.version()
        old = self.manifest(start)
        delta = materialize(signed_delta(before, after), "delta")
        terms, buckets = sum(n for _, n in old["files"].values()) + delta.count(), old["buckets"]
        while buckets * self.terms_per_bucket < terms:
            buckets *= 2
        bucket = F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int")
        kept = old["files"]
        if buckets == old["buckets"]:  # else all are split
            touched = {str(r["bucket"]) for r in delta.select(bucket.alias("bucket")).distinct().collect()}
            kept = {b: f for b, f in kept.items() if b in touched}
        merged = self._read(kept).unionByName(delta).groupBy("word").agg(F.sum("occurrences").cast("long").alias("occurrences"), F.sum("records").cast("long").alias("records")).where("records > 0")
        folder = f"data/{uuid.uuid4().hex}"
        merged.withColumn("bucket", bucket).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(COUNTS + ", bucket int").parquet(f"{self.path}/{folder}").groupBy("bucket").agg(F.count("*").alias("n")).collect()
        count = lambda df: 0 if df is None else df.select("rec_id").distinct().count()
        files = {b: f for b, f in old["files"].items() if b not in kept} | {str(r["bucket"]): [folder, r["n"]] for r in written}
        new = {"records": old["records"] + count(after) - count(before), "buckets": buckets, "files": files}
        if not commit_file(self.spark, f"{self.path}/manifests", str(start + 1), json.dumps(new)):
            raise LostUpdate(f"version {start + 1} was written by someone else")
        return start + 1

    def marked(self, rare_below: int = 3, common_above: float = 0.2) -> DataFrame:
        """(word, occurrences, records, mark): ``rare`` in fewer than ``rare_below`` records, ``common`` in more than that share of all, else null."""
        mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_above * self.records(), "common")
        return self.counts().withColumn("mark", mark)
