"""Problem 4: most similar vectors for every vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import quantize as Q


def _index(spark: SparkSession, d: str) -> Q.Index:
    return Q.Index(spark.read.parquet(f"{d}/vectors.parquet"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return Q.close_pairs(_index(spark, d).neighbours(), 1.5)


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest other vectors of every valid vector, with distances and rank."""
    found = _index(spark, d).neighbours()
    return found.select("vec_id", F.posexplode(F.arrays_zip("ids", "dists")).alias("pos", "n")).select("vec_id", (F.col("pos") + 1).alias("rank"), F.col("n.ids").alias("neighbour"), F.col("n.dists").alias("dist"))


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the index against brute force, for the vectors whose id is divisible by 50 against all: (queries, true_neighbours, found, recall)."""
    index = _index(spark, d)
    asked = F.col("vec_id") % 50 == 0
    flat = lambda df: df.select("vec_id", F.explode("ids").alias("id"))
    true = flat(Q.exact_neighbours(index.vectors(), index.vectors(asked), index.s.k, index.d))
    hit = true.join(flat(index.neighbours(asked)).withColumn("hit", F.lit(1)), ["vec_id", "id"], "left")
    return hit.agg(F.count_distinct("vec_id").alias("queries"), F.count("*").alias("true_neighbours"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("true_neighbours"))


def p4_recall_reached(spark: SparkSession, d: str) -> DataFrame:
    """The number of queries of ``p4_recall``, and whether its recall is at least 0.9."""
    return p4_recall(spark, d).select("queries", (F.col("recall") >= 0.9).alias("reached"))


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_recall": p4_recall, "p4_recall_reached": p4_recall_reached}

_VALID = """
with v as (select vec_id, min(point)::double[] p from vectors where len(point) = 32 and not list_contains(list_transform(point, lambda x: x is not null and isfinite(x)), false) and list_contains(list_transform(point, lambda x: x <> 0), true) group by 1)"""
SQL = {
    "p4_found": _VALID
    + """,
n as (select a.vec_id a, b.vec_id b, list_distance(a.p, b.p) dist from v a, v b where a.vec_id <> b.vec_id),
k as (select * from n qualify row_number() over (partition by a order by dist, b) <= 5)
select distinct least(a, b) vec_id_1, greatest(a, b) vec_id_2 from k where dist <= 1.5
""",
    "p4_recall_reached": _VALID + " select count(*) queries, true reached from v where vec_id % 50 = 0",
}
