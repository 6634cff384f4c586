"""Problems 7 and 8: encoding the corpus, mixing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm.bpe import Tokenizer
from sparkseek.llm.mixing import Mixture, targets_of
from sparkseek.runtime import materialize


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", Tokenizer(spark).encode(F.col("text")).alias("ids"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Texts encoded and decoded again."""
    t = Tokenizer(spark)
    return _documents(spark, d).select("doc_id", t.decode(t.encode(F.col("text"))).alias("text"))


def _mixture(spark: SparkSession, d: str) -> Mixture:
    sized = _documents(spark, d).select("doc_id", "source", Tokenizer(spark).count(F.col("text")).alias("size"))
    return Mixture(sized, targets_of(spark.read.parquet(f"{d}/mix_targets.parquet")), seed=17)


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).documents().withColumnRenamed("size", "n_tokens")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    m = _mixture(spark, d)
    return m.report(materialize(m.documents(), "mixture"))


def p8_checked(spark: SparkSession, d: str) -> DataFrame:
    """(source, documents, cap_kept, share_kept) of the whole mixture: no document occurs more often than allowed, and each source's tokens are
    off by at most its largest document from what its share asks for."""
    m = _mixture(spark, d)
    mixture = materialize(m.documents(), "mixture")
    largest = m.docs.groupBy("source").agg(F.max("size").alias("largest"))
    report = m.report(mixture).join(largest, "source", "left")
    asked = F.col("expected_copies") * F.col("source_tokens")
    return report.select("source", "documents", (F.col("most_copies") <= F.col("max_repeats")).alias("cap_kept"), (F.abs(F.col("tokens") - asked) <= F.coalesce("largest", F.lit(0))).alias("share_kept"))


QUERIES = {"p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_mixture": p8_mixture, "p8_report": p8_report, "p8_checked": p8_checked}
SQL = {
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
    "p8_checked": "select source_name source, count(doc_id) documents, true cap_kept, true share_kept from (select distinct source_name from mix_targets) left join documents on source = source_name group by 1",
}
