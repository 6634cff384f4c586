"""Processing only new or changed records: processed sequence numbers as disjoint intervals.

``ledger``    DataFrame (key, lo, hi, as_of): positions lo <= x < hi of ``key`` were read by a run that saw the data as of ``as_of``.
``gaps``      the available ranges minus the processed intervals.
``pending``   the records in the gaps, late ones included, and those rewritten after the ``as_of`` of the interval that covers them.
``LedgerStore`` keeps ledger and output together: both become visible with one atomic rename, so a run that breaks off leaves no trace
and is repeated in full, and a run that committed is never repeated.

Intervals meet each other and the records per block of positions. A block's width follows from the greatest position at hand, so that no
key has more than BLOCKS of them; a hot key is spread over as many groups, and arrays hold one block's intervals only.
"""

from __future__ import annotations

import datetime as dt
import heapq
import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.runtime import broadcast_if_small, commit_file, last_committed, materialize, read_committed

MAX_POSITION = 2**63 - 1
LEAST_BITS = 18
BLOCKS = 1 << 16

LEDGER_SCHEMA = T.StructType([T.StructField("key", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("as_of", T.TimestampNTZType())])


def latest_success(log: DataFrame) -> DataFrame:
    """One row per file with a succeeded run: (file_id, run_id, read_offset, entries, as_of) of the one with the highest run_id.

    Of a run's rows the one with the greatest logged_at counts (ties: the greatest row, so repeated rows change nothing); it succeeded with
    status ``ok`` in any letter case and a finished_at. Rows without run_id or file_id are no runs. Empty log: no rows.
    """
    last = (
        log.where(F.col("run_id").isNotNull() & F.col("file_id").isNotNull())
        .groupBy("file_id", "run_id")
        .agg(F.max(F.struct("logged_at", "finished_at", F.lower(F.trim("status")).alias("status"), "read_offset", "entries", "as_of")).alias("r"))
    )
    return (
        last.where((F.col("r.status") == "ok") & F.col("r.finished_at").isNotNull())
        .groupBy("file_id")
        .agg(F.max(F.struct("run_id", "r.read_offset", "r.entries", "r.as_of")).alias("r"))
        .select("file_id", "r.run_id", "r.read_offset", "r.entries", "r.as_of")
    )


def nth_position(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, position) of the n-th distinct position of each key, for ``wanted`` (key, n); keys with fewer positions are left out.

    Two levels, so that no key's records ever meet in one task: count per block of positions, find the block by a running sum over
    blocks, rank only inside that block.
    """
    found = records.join(broadcast_if_small(wanted), "key").select("key", "position", "n").distinct()
    found = materialize(found, "found")  # read three times
    found = found.withColumn("block", F.shiftright("position", _bits(found, "position")))
    blocks = found.groupBy("key", "n", "block").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("key").orderBy("block")
    pick = (
        blocks.withColumn("upto", F.sum("c").over(upto))
        .where((F.col("upto") >= F.col("n")) & (F.col("upto") - F.col("c") < F.col("n")))
        .select("key", "block", (F.col("n") - F.col("upto") + F.col("c")).alias("need"))
    )
    inside = found.select("key", "block", "position").join(broadcast_if_small(pick), ["key", "block"])
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy("key", "block").orderBy("position")))
    return ranked.where(F.col("rank") == F.col("need")).select("key", "position")


def ledger_from_log(log: DataFrame, records: DataFrame) -> DataFrame:
    """Processed intervals of a run log: [0, read_offset), or up to the record after the first ``entries`` where read_offset is null.

    ``records``: (key, position). A null ``entries`` counts as 0. A file whose run read every record has the interval [0, MAX_POSITION].
    """
    runs = latest_success(log)
    known = runs.where(F.col("read_offset").isNotNull()).select(F.col("file_id").alias("key"), F.lit(0).cast("long").alias("lo"), F.col("read_offset").alias("hi"), "as_of")
    counted = runs.where(F.col("read_offset").isNull()).select(F.col("file_id").alias("key"), (F.coalesce("entries", F.lit(0)) + 1).alias("n"), "as_of")
    bound = nth_position(records, counted.where("n > 1").select("key", "n"))
    by_count = counted.join(bound, "key", "left").select(
        "key",
        F.lit(0).cast("long").alias("lo"),
        F.when(F.col("n") <= 1, F.lit(0)).otherwise(F.coalesce("position", F.lit(MAX_POSITION))).cast("long").alias("hi"),
        "as_of",
    )
    return known.unionByName(by_count)


def _bits(df: DataFrame, position: str = "hi") -> int:
    """Bits of a block's width: at most BLOCKS blocks up to the greatest position (or interval end, MAX_POSITION apart)."""
    top = df.where(F.col(position) < MAX_POSITION).agg(F.max(position)).first()[0] or 0
    return max(LEAST_BITS, (max(top, 0) // BLOCKS).bit_length())


def in_blocks(intervals: DataFrame, bits: int) -> DataFrame:
    """The intervals cut at the borders of blocks, with a column ``block``; whatever lies past the last block is one more block."""
    last = F.lit(BLOCKS).cast("long")
    number = lambda c: F.least(F.shiftright(c, bits), last)
    cut = intervals.where("hi > lo").withColumn("block", F.explode(F.sequence(number(F.col("lo")), number(F.col("hi") - 1))))
    end = F.when(F.col("block") == last, F.col("hi")).otherwise(F.least("hi", F.shiftleft(F.col("block") + 1, bits)))
    return cut.withColumn("hi", end).withColumn("lo", F.greatest("lo", F.shiftleft("block", bits)))


def _islands(df: DataFrame, *by: str) -> DataFrame:
    """Touching and overlapping intervals of equal ``by`` as one."""
    order = Window.partitionBy(*by).orderBy("lo", "hi")
    starts = df.withColumn("new", F.when(F.col("lo") <= F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    return starts.withColumn("island", F.sum("new").over(order)).groupBy(*by, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def _across(df: DataFrame, bits: int, *by: str) -> DataFrame:
    """Pieces of blocks put together again. Only those that end at a border can touch one of another block: at most two a block and key."""
    inside = lambda c: F.col(c).bitwiseAND(F.lit((1 << bits) - 1)) != 0
    alone = inside("lo") & inside("hi")
    names = [*by, "lo", "hi"]
    return df.where(alone).select(*names).unionByName(_islands(df.where(~alone).select(*names), *by))


def gaps(records: DataFrame, ledger: DataFrame) -> DataFrame:
    """(key, lo, hi): what of each key's available range, from its first to its last position in ``records`` (key, position), isn't processed."""
    available = records.where("key is not null and position is not null").groupBy("key").agg(F.min("position").alias("lo"), (F.max("position") + 1).alias("hi"))
    return subtract_intervals(materialize(available, "available"), ledger)


def pending(records: DataFrame, ledger: DataFrame, key: str, position: str, revised: Column, written_at: str) -> DataFrame:
    """Distinct (key, position) of the records that lie in a gap of the ledger, or that were rewritten after the run that read them.

    ``revised``: whether the row is a rewrite. Rows whose key or position is null name no record and are left out. Records meet the gaps
    of their key and block, rewrites the processed intervals there: in broadcast joins where those tables are small, otherwise in shuffle
    joins whose hot keys AQE splits. Only rows that are pending are shuffled for the distinct.
    """
    rows = records.select(F.col(key).alias("key"), F.col(position).alias("position"), F.coalesce(revised, F.lit(False)).alias("_rev"), F.col(written_at).alias("_w")).where("key is not null and position is not null")
    open_ = materialize(gaps(rows, ledger), "gaps")
    spans = rows.where("_rev").groupBy("key").agg(F.min("position").alias("s_lo"), F.max("position").alias("s_hi"))
    read = ledger.join(broadcast_if_small(spans), "key").select("key", F.greatest("lo", "s_lo").alias("lo"), F.least("hi", F.col("s_hi") + 1).alias("hi"), "as_of")
    read = materialize(read, "read")
    bits = max(_bits(open_), _bits(read))
    block = F.least(F.shiftright("position", bits), F.lit(BLOCKS).cast("long"))
    here = lambda df, *cols: broadcast_if_small(in_blocks(df, bits).groupBy("key", "block").agg(F.collect_list(F.struct("lo", "hi", *cols)).alias("at")))
    holds = lambda i: (i.lo <= F.col("position")) & (F.col("position") < i.hi)
    fresh = rows.withColumn("block", block).join(here(open_), ["key", "block"]).where(F.exists("at", holds))
    older = lambda i: ~F.coalesce(F.col("_w") > i.as_of, F.lit(False))
    again = rows.where("_rev").withColumn("block", block).join(here(read, "as_of"), ["key", "block"]).where(F.exists("at", holds) & ~F.exists("at", lambda i: holds(i) & older(i)))
    return fresh.select("key", "position").unionByName(again.select("key", "position")).distinct().select(F.col("key").alias(key), F.col("position").alias(position))


def _latest(pieces: pa.Table) -> pa.Table:
    """Overlapping intervals of one key as disjoint ones: every position has the latest as_of of those that cover it (null is the latest)."""
    rows = sorted(pieces.select(["lo", "hi", "as_of"]).to_pylist(), key=lambda r: r["lo"])
    cuts = sorted({r["lo"] for r in rows} | {r["hi"] for r in rows})
    open_, out, i = [], [], 0
    for a, b in zip(cuts, cuts[1:]):
        while i < len(rows) and rows[i]["lo"] <= a:
            age = dt.datetime.max - (rows[i]["as_of"] or dt.datetime.max)
            heapq.heappush(open_, (age, rows[i]["hi"], i))
            i += 1
        while open_ and open_[0][1] <= a:
            heapq.heappop(open_)
        if not open_:
            continue
        seen = rows[open_[0][2]]["as_of"]
        if out and out[-1][1] == a and out[-1][2] == seen:
            out[-1][1] = b
        else:
            out.append([a, b, seen])
    key = pieces.column("key")[0].as_py()
    schema = pa.schema([("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("as_of", pa.timestamp("us"))])
    return pa.table([[key] * len(out), *([o[j] for o in out] for j in range(3))], schema=schema)


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Disjoint intervals covering the same positions: touching and overlapping ones of a key and an as_of become one.

    Where intervals of different as_of overlap, the latest holds. Everything but the joining of whole blocks happens per block; only
    intervals that overlap with others of another as_of go to Python.
    """
    rows = intervals.where("hi > lo").select("key", "lo", "hi", "as_of")
    bits = _bits(rows)
    local = _islands(in_blocks(rows, bits), "key", "as_of", "block")
    order = Window.partitionBy("key", "block").orderBy("lo", "hi")
    starts = local.withColumn("new", F.when(F.col("lo") < F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1))
    islands = starts.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.count("*").over(Window.partitionBy("key", "block", "island")))
    alone = islands.where("n = 1").select("key", "lo", "hi", "as_of")
    overlapping = islands.where("n > 1").select("key", "block", "island", "lo", "hi", "as_of")
    return _across(alone.unionByName(overlapping.groupBy("key", "block", "island").applyInArrow(_latest, LEDGER_SCHEMA)), bits, "key", "as_of").select("key", "lo", "hi", "as_of")


def subtract_intervals(available: DataFrame, processed: DataFrame, *keep: str) -> DataFrame:
    """The gaps: (key, lo, hi, and ``keep`` of ``available``) that ``processed`` leaves open. Each of the two is disjoint.

    Only where the two overlap are they cut into blocks; the rest of ``available`` passes as it is.
    """
    available, done = available.where("hi > lo"), processed.where("hi > lo").select("key", "lo", "hi")
    ends = lambda df, p: df.groupBy("key").agg(F.min("lo").alias(f"{p}_lo"), F.max("hi").alias(f"{p}_hi"))
    both = ends(available, "a").join(ends(done, "p"), "key").select("key", F.greatest("a_lo", "p_lo").alias("s_lo"), F.least("a_hi", "p_hi").alias("s_hi")).where("s_hi > s_lo")
    both = materialize(both, "spans")
    bits = _bits(both, "s_hi")
    side = broadcast_if_small(both)
    rows = available.join(side, "key", "left")
    left = rows.select("key", "lo", F.least("hi", F.coalesce("s_lo", "hi")).alias("hi"), *keep)
    right = rows.where("s_hi is not null").select("key", F.greatest("lo", "s_hi").alias("lo"), "hi", *keep)
    clip = lambda df, *cols: in_blocks(df.select("key", F.greatest("lo", "s_lo").alias("lo"), F.least("hi", "s_hi").alias("hi"), *cols), bits)
    cuts = clip(done.join(side, "key")).groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("done"))
    inner = clip(rows.where("s_hi is not null"), *keep).join(cuts, ["key", "block"], "left")
    cut = F.filter(F.coalesce("done", F.array().cast("array<struct<lo:bigint,hi:bigint>>")), lambda d: (d.hi > F.col("lo")) & (d.lo < F.col("hi")))
    edges = inner.withColumn("cut", cut).select(
        "key",
        *keep,
        F.explode(
            F.zip_with(
                F.concat(F.array("lo"), F.transform("cut", lambda d: d.hi)),
                F.concat(F.transform("cut", lambda d: d.lo), F.array("hi")),
                lambda a, b: F.struct(a.alias("lo"), b.alias("hi")),
            )
        ).alias("gap"),
    )
    open_ = edges.select("key", "gap.lo", "gap.hi", *keep)
    outside = left.unionByName(right).where("hi > lo")
    # parts of a row that the span's ends cut off touch what is left inside: they are joined again with it
    touching = outside.join(side, "key", "left").withColumn("edge", F.coalesce((F.col("hi") == F.col("s_lo")) | (F.col("lo") == F.col("s_hi")), F.lit(False)))
    joined = _islands(open_.where("hi > lo").unionByName(touching.where("edge").select("key", "lo", "hi", *keep)).join(side, "key").where(_on_border(bits)).select("key", "lo", "hi", *keep), "key", *keep)
    inside = open_.where("hi > lo").join(side, "key").where(~_on_border(bits)).select("key", "lo", "hi", *keep)
    return touching.where("not edge").select("key", "lo", "hi", *keep).unionByName(joined).unionByName(inside).select("key", "lo", "hi", *keep)


def _on_border(bits: int) -> Column:
    """Whether an interval ends at a border of blocks or of its key's span."""
    at = lambda c: (F.col(c).bitwiseAND(F.lit((1 << bits) - 1)) == 0) | (F.col(c) == F.col("s_lo")) | (F.col(c) == F.col("s_hi"))
    return at("lo") | at("hi")


class LedgerStore:
    """A ledger and the output it stands for, committed together under one folder.

    Every run writes its ledger and output to a folder of its own, which nobody else touches; the commit file ``commits/N`` names the
    folders, and comes into being at once. Of two runs that started from the same version only one gets the number: the other raises
    ``LostRace`` and leaves the committed files as they are. A run that breaks off before leaves an unnamed folder, which counts nowhere.
    """

    def __init__(self, spark: SparkSession, path: str, initial: DataFrame | None = None):
        """``initial``: the (disjoint) ledger of what was processed before the store began; the first commit takes it in."""
        self.spark, self.path, self.initial = spark, path.rstrip("/"), initial

    def version(self) -> int:
        """The last committed run, 0 if none."""
        return last_committed(self.spark, f"{self.path}/commits")

    def _commit(self, version: int) -> dict:
        return json.loads(read_committed(self.spark, f"{self.path}/commits", version))

    def ledger(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        if v:
            return self.spark.read.schema(LEDGER_SCHEMA).parquet(f"{self.path}/{self._commit(v)['run']}/ledger")
        return self.spark.createDataFrame([], LEDGER_SCHEMA) if self.initial is None else self.initial.select("key", "lo", "hi", "as_of")

    def output(self) -> DataFrame | None:
        """All committed output in one read; None before the first commit."""
        v = self.version()
        if not v:
            return None
        paths = [f"{self.path}/{run}/output" for run in self._commit(v)["runs"]]
        return self.spark.read.schema(self.spark.read.parquet(paths[0]).schema).parquet(*paths)

    def prepare(self, processed: DataFrame, output: DataFrame) -> Run:
        """Write a run's ledger and output, without any effect yet.

        A newer interval replaces the older ones' as_of where it covers them: the older intervals keep only what it leaves open.
        """
        before, folder = self.version(), f"runs/{uuid.uuid4().hex}"
        new = materialize(merge_intervals(processed), "new")
        output.write.parquet(f"{self.path}/{folder}/output")
        subtract_intervals(self.ledger(before), new, "as_of").unionByName(new).write.parquet(f"{self.path}/{folder}/ledger")
        return Run(self, before, folder)

    def commit(self, processed: DataFrame, output: DataFrame) -> int:
        """Add ``processed`` (key, lo, hi, as_of) and ``output`` as one run; gives its number."""
        return self.prepare(processed, output).commit()


class LostRace(RuntimeError):
    """Someone else committed since the run began: what is pending has to be found anew."""


@dataclass(frozen=True)
class Run:
    """A prepared run of a store."""

    store: LedgerStore
    before: int
    folder: str

    def commit(self) -> int:
        """Make the run count; LostRace if its number is taken."""
        s = self.store
        runs = (s._commit(self.before)["runs"] if self.before else []) + [self.folder]
        if not commit_file(s.spark, f"{s.path}/commits", str(self.before + 1), json.dumps({"run": self.folder, "runs": runs})):
            raise LostRace(f"run {self.before + 1} was committed by someone else")
        return self.before + 1
