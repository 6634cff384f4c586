"""Nearest neighbours of query vectors: exact, and approximate by locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.runtime import materialize

QUERY_BLOCK = 20_000


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance in double; vectors of different size give an error."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, d: s + d))).otherwise(F.raise_error(F.lit("vectors of different size")).cast("double"))


def check_dimension(v: Column, d: int) -> Column:
    """The vector if it has d numbers, else an error."""
    return F.when(v.isNull() | (F.size(v) == d), v).otherwise(F.raise_error(F.concat(F.lit(f"expected {d} dimensions, got "), F.size(v).cast("string"))).cast("array<float>"))


def literal_vector(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def knn(vectors: DataFrame, query, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, dist) of the k nearest vectors to one query vector, ties by id: a scan and a top-k, no shuffle of the table."""
    return vectors.where(F.col(vector_col).isNotNull()).select(id_col, l2(F.col(vector_col), literal_vector(query)).alias("dist")).orderBy("dist", id_col).limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, dist, rank) of the k nearest vectors to each query of a stated set (query_id, query); ids are whole numbers, ties go by id.

    Queries travel to the vectors as matrices of ``block`` rows, one pass over the vectors for each; a task keeps its k best per query, and
    only these are shuffled. Null vectors, queries and ids take no part; vectors of different size are an error.
    """
    asked = materialize(queries.where(F.col("query_id").isNotNull() & F.col("query").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query")), "queries")
    parts = max(1, -(-asked.count() // block))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    hits = None
    for i in range(parts):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).toArrow()  # about ``block`` rows
        shared = vectors.sparkSession.sparkContext.broadcast((part.column("query_id").to_numpy(), _matrix(part.column("query").combine_chunks())))
        found = rows.mapInArrow(_nearest(shared, k), "query_id long, id long, dist double")
        hits = found if hits is None else hits.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id"))
    kept = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    return kept.select(F.col("query_id").cast(queries.schema["query_id"].dataType), F.col("id").cast(vectors.schema[id_col].dataType).alias(id_col), "dist", "rank")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Rows of equal size as a matrix."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = set(lists.value_lengths().to_pylist())
    if len(sizes) > 1:
        raise ValueError(f"vectors of different size: {sorted(sizes)[:5]}")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), sizes.pop() if sizes else 0)


def _nearest(shared, k: int, chunk: int = 512, spare: int = 8):
    """Each task's k nearest of its rows for all queries of a block: distances by matrix product pick k + ``spare``, exact ones rank them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = shared.value
        best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        norms = (q**2).sum(1)
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            if x.shape[1] != q.shape[1]:
                raise ValueError(f"vectors of different size: {x.shape[1]}, {q.shape[1]}")
            take, squares = min(k + spare, len(x)), (x**2).sum(1)
            for i in range(0, len(q), chunk):
                part = slice(i, i + chunk)
                rough = norms[part, None] - 2 * q[part] @ x.T + squares
                near = np.argpartition(rough, take - 1, axis=1)[:, :take]
                exact = np.sqrt(((x[near] - q[part, None, :]) ** 2).sum(2))
                d, n = np.concatenate((best_d[part], exact), 1), np.concatenate((best_i[part], ids[near]), 1)
                order = np.lexsort((n, d), axis=1)[:, :k]
                best_d[part], best_i[part] = np.take_along_axis(d, order, 1), np.take_along_axis(n, order, 1)
        good = np.isfinite(best_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, good.sum(1)), pa.int64()), pa.array(best_i[good], pa.int64()), pa.array(best_d[good])], ["query_id", "id", "dist"])

    return run


def recall(found: DataFrame, true: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(queries, recall): the share of ``true`` (query_id, id) pairs that ``found`` has."""
    pairs = true.select("query_id", id_col).join(found.select("query_id", id_col).distinct().withColumn("hit", F.lit(1)), ["query_id", id_col], "left")
    return pairs.agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))


def knn_lsh(vectors: DataFrame, query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", bucket: float = 1.0, tables: int = 8, seed: int = 7) -> DataFrame:
    """Approximate k nearest by bucketed random projections; may find fewer than k."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    rows = vectors.where(F.col(vector_col).isNotNull()).select(id_col, array_to_vector(vector_col).alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(rows)
    found = model.approxNearestNeighbors(rows, Vectors.dense([float(x) for x in query]), k, distCol="dist")
    return found.select(id_col, "dist").orderBy("dist", id_col)
