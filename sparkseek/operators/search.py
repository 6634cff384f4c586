"""Ranked n-gram search: postings, document frequencies, scores.

score(d) = sum over query grams g of qtf(g) * ln((N - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2), without length normalization; the
logarithm may be negative. Only documents with at least one gram are scored; ties go by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions.columns import once
from sparkseek.functions.text import kept_characters, ngrams, ngrams_between
from sparkseek.runtime import materialize

K1 = 1.2


def query_grams(like: str, low: int, high: int) -> dict[str, int]:
    """Grams of a query with their multiplicity; the same rules as for documents, evaluated on the driver."""
    import re

    found: dict[str, int] = {}
    kept = re.sub(r"[^a-zA-Z0-9 \t\n\r]", "", like).lower()
    for n in range(low, high + 1):
        for w in re.split(r"[ \t\n\r]+", kept):
            for i in range(len(w) - n + 1):
                found[w[i : i + n]] = found.get(w[i : i + n], 0) + 1
    return found


def postings(docs: DataFrame, n: int | None = None, low: int = 1, high: int = 3, only: list[str] | None = None, normalize: str = "ascii") -> DataFrame:
    """(doc, gram, tf) of ``docs`` (doc, text). ``only``: grams to keep; they are filtered before anything is shuffled."""
    grams: Column = ngrams(F.col("text"), n, normalize) if n else ngrams_between(F.col("text"), low, high, normalize)
    if only is not None:
        wanted = F.array(*map(F.lit, only)) if only else F.array().cast("array<string>")
        grams = F.filter(grams, lambda g: F.array_contains(wanted, g))
    return docs.select("doc", F.explode(grams).alias("gram")).groupBy("doc", "gram").agg(F.count("*").alias("tf"))


def document_frequency(p: DataFrame) -> DataFrame:
    """(gram, df) of postings."""
    return p.groupBy("gram").agg(F.count("*").alias("df"))


def term_score(n: Column, df: Column, tf: Column) -> Column:
    n, df, tf = n.cast("double"), df.cast("double"), tf.cast("double")
    return F.ln((n - df + 0.5) / (df + 0.5)) * (tf * (K1 + 1)) / (tf + K1)


def search(docs: DataFrame, like: str, low: int = 1, high: int = 2, within: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """(doc, score), best first. ``within``: documents that may be returned; the statistics are those of all documents.

    Each document counts its own query grams in an expression, so scoring needs no posting shuffle. Texts are read once: the counts of
    documents with any gram are written, an aggregation over these gives the document frequencies (one row; a query has few grams), and
    scores come from both.
    """
    grams = query_grams(like, low, high)
    if not grams:
        return docs.select("doc", F.lit(0.0).alias("score")).limit(0)
    names = sorted(grams)
    seen = docs.select("doc", once(kept_characters(F.coalesce("text", F.lit("")))).alias("kept"))
    # overlapping occurrences; grams have no blanks, so none crosses words
    counted = seen.select("doc", once(F.array(*(F.regexp_count("kept", F.lit(f"(?={g})")) for g in names))).alias("tf"))
    rows = materialize(counted.where(F.exists("tf", lambda x: x > 0)), "hits")
    stats = rows.agg(F.lit(docs.count()).alias("n"), F.array(*(F.count(F.when(F.get("tf", F.lit(i)) > 0, 1)) for i in range(len(names)))).alias("df"))
    score = F.lit(0.0)
    for i, g in enumerate(names):
        tf = F.get("tf", F.lit(i))
        score = score + F.lit(float(grams[g])) * F.when(tf > 0, term_score(F.col("n"), F.get("df", F.lit(i)), tf)).otherwise(0.0)
    if within is not None:
        rows = rows.join(within, "doc", "left_semi")
    scored = rows.crossJoin(F.broadcast(stats)).select("doc", score.alias("score"))  # stats: one row
    ordered = scored.orderBy(F.col("score").desc(), "doc")
    return ordered if limit is None else ordered.limit(limit)


def search_postings(p: DataFrame, n_docs: int, like: str, low: int = 1, high: int = 2, within: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The same scores from a stored postings table (doc, gram, tf), sorted by gram so that only the query's grams are read."""
    grams = query_grams(like, low, high)
    rows = p.where(F.col("gram").isin(list(grams)))
    weights = F.create_map(*(F.lit(x) for g, c in grams.items() for x in (g, float(c)))) if grams else F.create_map().cast("map<string,double>")
    frequency = F.broadcast(document_frequency(rows))  # a row per gram of the query
    kept = rows if within is None else rows.join(within, "doc", "left_semi")
    ordered = (
        kept.join(frequency, "gram")
        .withColumn("s", F.element_at(weights, F.col("gram")) * term_score(F.lit(n_docs), F.col("df"), F.col("tf")))
        .groupBy("doc")
        .agg(F.sum("s").alias("score"))
        .orderBy(F.col("score").desc(), "doc")
    )
    return ordered if limit is None else ordered.limit(limit)


def write_postings(p: DataFrame, path: str) -> None:
    """Store postings so that min/max statistics prune by gram. They are written before they are ranged: the ranges' sampling would compute them again."""
    materialize(p, "postings").repartitionByRange("gram", "doc").sortWithinPartitions("gram", "doc").write.mode("overwrite").parquet(path)
