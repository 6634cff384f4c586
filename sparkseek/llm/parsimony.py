"""How distinctive a term is for its record: parsimonious language models.

Expectation-maximization per record separates the record's own term mass from the background P(t) = cf / N:

    E: e_t = tf * a p_t / ((1 - a) P(t) + a p_t)      M: p_t = e_t / sum(e)

The converged p_t ranks terms. As probabilities of a record they add up to 1, so long records are not favoured.

An EM step needs the other terms of a record only through sum(e), and that depends on how many terms share a (tf, cf). So a record is
condensed to its histogram of (tf, cf), EM runs on histograms, many records at a time, and each term replays the sums on its own row: no
task ever holds all terms of a large record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from sparkseek.runtime import materialize

SPECIFIC = 0.1
STEPS = 40
TOLERANCE = 1e-4


def em_sums(sizes: np.ndarray, tf: np.ndarray, background: np.ndarray, n: np.ndarray, specific: float, steps: int, tolerance: float) -> list[np.ndarray]:
    """sum(e) of each EM step per record; records' histogram rows stand one after another, ``sizes`` rows each (at least 1).

    A record stops once its sum changes by less than ``tolerance`` of itself.
    """
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    of = np.repeat(np.arange(len(sizes)), sizes)
    p = tf / np.add.reduceat(tf * n, starts)[of]
    sums = np.full((len(sizes), steps), np.nan)
    active = np.ones(len(sizes), bool)
    for k in range(steps):
        e = tf * specific * p / ((1 - specific) * background + specific * p)
        s = np.add.reduceat(e * n, starts)
        sums[active, k] = s[active]
        p = np.where(active[of], e / s[of], p)
        if k:
            active &= np.abs(sums[:, k] - sums[:, k - 1]) > tolerance * s
        if not active.any():
            break
    return [row[~np.isnan(row)] for row in sums]


def _em(total: float, specific: float, steps: int, tolerance: float):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            flat = lists.flatten()
            tf, cf, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(float) for i in range(3))
            sums = em_sums(lists.value_lengths().to_numpy(zero_copy_only=False), tf, cf / total, n, specific, steps, tolerance) if len(lists) else []
            yield pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))

    return arrow_udf(run, "array<double>")


def scores(terms: DataFrame, specific: float = SPECIFIC, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """(rec_id, word, tf, df, record_words, background, score) of record terms (rec_id, word, tf); ties have equal scores.

    Frequent words sit in many records: the join with the word statistics is broadcast where those turn out small, otherwise shuffled
    with AQE splitting hot words. An empty table gives no rows.
    """
    terms = materialize(terms, "terms")
    stats = terms.groupBy("word").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    total = float(terms.agg(F.coalesce(F.sum("tf"), F.lit(1))).first()[0])
    rows = materialize(terms.join(stats, "word"), "terms-stats")
    bars = rows.groupBy("rec_id", "tf", "cf").agg(F.count("*").alias("n"))
    bins = bars.groupBy("rec_id").agg(F.sum(F.col("tf") * F.col("n")).alias("record_words"), F.sort_array(F.collect_list(F.struct("tf", "cf", "n"))).alias("bins"))
    sums = bins.select("rec_id", "record_words", _em(total, specific, steps, tolerance)(F.col("bins")).alias("sums"))
    b = F.col("cf") / F.lit(total)
    step = lambda p, s: F.col("tf") * specific * p / ((1 - specific) * F.col("background") + specific * p) / s
    joined = rows.join(sums, "rec_id").withColumn("background", b)
    return joined.select("rec_id", "word", "tf", "df", "record_words", "background", F.aggregate("sums", F.col("tf") / F.col("record_words"), step).alias("score"))
