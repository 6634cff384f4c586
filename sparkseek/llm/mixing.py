"""Mixing sources to target weights by systematic sampling.

Every document of a source gets the same expected number of copies r. Documents are lined up by size within their source; the prefix sum
of r, shifted by one random offset per source, crosses whole numbers, and a document is emitted once for each number it crosses. So a
document occurs floor(r) or ceil(r) times, and every stretch of sizes is represented in proportion: the source's size is off by about
one document at most.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.runtime import broadcast_if_small, materialize

MAX_SOURCES = 10_000
ROWS_PER_STRETCH = 1_000_000
BAND_BITS = 10


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    repeats: int
    documents: int
    size: int
    wanted: float  # share among the sources that have anything
    copies: float  # expected copies of each document


def _offset(source: str, seed: int) -> float:
    return int.from_bytes(hashlib.sha256(f"{seed}:{source}".encode()).digest()[:6], "big") / 2**48


def plan(sizes: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> list[Share]:
    """Expected copies per source. sizes: source -> (documents, size); targets: source -> (share, most repeats).

    Shares of sources without any size go to the others in proportion. The mixture is as large as the scarcest source allows at its
    share; a given ``total`` above that is lowered to it, so the shares hold and no cap is passed.
    """
    there = {s for s, (share, repeats) in targets.items() if share > 0 and repeats > 0 and sizes.get(s, (0, 0))[1] > 0}
    whole = sum(targets[s][0] for s in there)
    wanted = {s: targets[s][0] / whole for s in there}
    most = min((sizes[s][1] * targets[s][1] / wanted[s] for s in there), default=0.0)
    goal = most if total is None else min(float(total), most)
    out = []
    for s in sorted(targets):
        share, repeats = targets[s]
        documents, size = sizes.get(s, (0, 0))
        r = min(goal * wanted[s] / size, float(repeats)) if s in there else 0.0
        if abs(r - round(r)) < 1e-9:
            r = float(round(r))
        out.append(Share(s, share, repeats, documents, size, wanted.get(s, 0.0), r))
    return out


def targets_of(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """source -> (share, most repeats). Rows without a name are left out, null shares and repeats count as 0; a repeated name: shares add, the smaller cap."""
    rows = targets.where("source_name is not null").groupBy("source_name").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.min(F.coalesce("max_repeats", F.lit(0))).alias("repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    return {r["source_name"]: (max(r["share"], 0.0), max(r["repeats"], 0)) for r in rows}


class Mixture:
    """``docs`` (doc_id, source, size): sizes may be 0; documents of other sources, or without one, are no part of the mixture."""

    def __init__(self, docs: DataFrame, targets: dict[str, tuple[float, int]], seed: int = 0, total: int | None = None, stretch: int = ROWS_PER_STRETCH):
        """``stretch``: about the most documents of a source and size that are numbered in one task."""
        self.targets, self.seed, self.stretch = targets, seed, stretch
        self.docs = materialize(docs.where(F.col("source").isin(sorted(targets))).select("doc_id", "source", F.col("size").cast("long").alias("size")), "sized")
        totals = self.docs.groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).collect()  # at most MAX_SOURCES rows
        self.shares = plan({r["source"]: (r["n"], r["size"]) for r in totals}, targets, total)

    def _table(self) -> DataFrame:
        rows = [(s.source, s.target, s.repeats, s.documents, s.size, s.wanted, s.copies, _offset(s.source, self.seed)) for s in self.shares]
        return self.docs.sparkSession.createDataFrame(rows, "source string, target_share double, max_repeats int, documents long, source_tokens long, wanted_share double, r double, u double")

    def documents(self) -> DataFrame:
        """(doc_id, source, size, copies) of the documents that occur; copies from 1 to the source's cap.

        Ranks come in three levels: bands of sizes and the sizes of a band are counted and summed up, and rows are numbered inside a
        stretch of equal size, which is split by a hash where it is large. No source or size, however common, is ordered in one task.
        """
        rows, salt = self.docs, F.lit(0).cast("long")
        stretches = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("c")), "stretches")
        large = materialize(stretches.where(F.col("c") > self.stretch).select("source", "size", F.ceil(F.col("c") / self.stretch).alias("salts")), "large")
        if not large.isEmpty():
            rows = rows.join(broadcast_if_small(large), ["source", "size"], "left")
            salt = F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.coalesce("salts", F.lit(1)))
        rows = rows.select("doc_id", "source", "size", salt.alias("salt"))
        if not large.isEmpty():
            stretches = materialize(rows.groupBy("source", "size", "salt").agg(F.count("*").alias("c")), "salted")
        else:
            stretches = stretches.withColumn("salt", salt)
        banded = stretches.withColumn("band", F.shiftright("size", BAND_BITS))
        bands = banded.groupBy("source", "band").agg(F.sum("c").alias("n"))
        lower = bands.select("source", "band", (F.sum("n").over(Window.partitionBy("source").orderBy("band")) - F.col("n")).alias("lower"))
        upto = F.sum("c").over(Window.partitionBy("source", "band").orderBy("size", "salt"))
        before = banded.withColumn("upto", upto).join(broadcast_if_small(lower), ["source", "band"]).select("source", "size", "salt", (F.col("lower") + F.col("upto") - F.col("c")).alias("before"))
        inside = Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit(self.seed)), "doc_id")
        rank = rows.withColumn("rank", F.row_number().over(inside)).join(broadcast_if_small(before), ["source", "size", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
        crossed = lambda k: F.floor(k * F.col("r") + F.col("u"))
        placed = rank.join(F.broadcast(self._table().select("source", "r", "u")), "source")  # at most MAX_SOURCES rows
        return placed.withColumn("copies", (crossed(F.col("rank")) - crossed(F.col("rank") - 1)).cast("int")).where("copies > 0").select("doc_id", "source", "size", "copies")

    def report(self, documents: DataFrame | None = None) -> DataFrame:
        """One row per target: sizes, expected copies, and what the mixture reached."""
        got = (self.documents() if documents is None else documents).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.count("*").alias("used"), F.max("copies").alias("most"))
        table = self._table().join(got, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        every = table.agg(F.sum("tokens").alias("all_tokens"))
        return table.crossJoin(F.broadcast(every)).select(  # one row
            "source",
            "target_share",
            "wanted_share",
            "max_repeats",
            "documents",
            "source_tokens",
            F.col("r").alias("expected_copies"),
            F.coalesce("used", F.lit(0)).alias("documents_used"),
            F.coalesce("most", F.lit(0)).alias("most_copies"),
            F.col("tokens").cast("long").alias("tokens"),
            F.when(F.col("all_tokens") > 0, F.col("tokens") / F.col("all_tokens")).otherwise(0.0).alias("actual_share"),
        )
