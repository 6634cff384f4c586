"""Problem 6: the records that the next run has to process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.operators import intervals as I
from sparkseek.runtime import fresh_path, materialize


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trips, their (key, position), the ledger of the run log)."""
    trips = spark.read.parquet(f"{d}/trips.parquet")
    places = trips.select(F.col("file_id").alias("key"), F.col("rec_offset").alias("position"))
    return trips, places, materialize(I.ledger_from_log(spark.read.parquet(f"{d}/file_meta.parquet"), places), "log_ledger")


def _pending(trips: DataFrame, ledger: DataFrame) -> DataFrame:
    return I.pending(trips, ledger, "file_id", "rec_offset", F.col("revision") > 1, "written_at")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    trips, _, ledger = _tables(spark, d)
    return _pending(trips, ledger)


def p6_method(spark: SparkSession, d: str) -> DataFrame:
    """The gaps of every file: its available range minus the processed intervals."""
    _, places, ledger = _tables(spark, d)
    return I.gaps(places, ledger).withColumnRenamed("key", "file_id")


def commit_pending(spark: SparkSession, d: str) -> tuple[I.LedgerStore, int, int]:
    """The store after a run that breaks off before its commit and two that race, how many of these lost, and how many records are pending then.

    The ledger of the run log is committed with the new intervals, so that the store alone says what is processed.
    """
    trips, _, ledger = _tables(spark, d)
    todo = materialize(_pending(trips, ledger), "todo")  # read several times
    store = I.LedgerStore(spark, fresh_path(spark, "ledger"), ledger)
    size = trips.groupBy("file_id", "rec_offset").agg(F.max("rec_length").alias("len"))
    seen = trips.agg(F.max("written_at").alias("as_of"))  # one row: the run's snapshot time, so that its records become few intervals
    end = F.col("rec_offset") + F.coalesce("len", F.lit(0)) + 1
    read = size.join(todo, ["file_id", "rec_offset"]).crossJoin(F.broadcast(seen)).select(F.col("file_id").alias("key"), F.col("rec_offset").alias("lo"), end.alias("hi"), "as_of")
    read = materialize(read, "read")
    store.prepare(read, todo)  # breaks off here
    first, second = store.prepare(read, todo), store.prepare(read, todo)
    second.commit()
    try:
        first.commit()
        lost = 0
    except I.LostRace:
        lost = 1
    return store, lost, _pending(trips, store.ledger()).count()


def p6_commit(spark: SparkSession, d: str) -> DataFrame:
    """A run breaks off before its commit, two race for it: what is committed counts once, and nothing is left to process."""
    store, lost, left = commit_pending(spark, d)
    counted = store.output().agg(F.count("*").alias("records"), F.count_distinct("file_id").alias("files"))
    return counted.withColumns({"runs": F.lit(store.version()), "lost": F.lit(lost), "pending": F.lit(left).cast("long")})


QUERIES = {"p6_method": p6_method, "p6_found": p6_found, "p6_commit": p6_commit}

_FOUND = """
with last as (select * from (select *, row_number() over (partition by file_id, run_id order by logged_at desc nulls last) n from file_meta) where n = 1),
ok as (select * from (select *, row_number() over (partition by file_id order by run_id desc) m from last where lower(trim(status)) = 'ok' and finished_at is not null) where m = 1),
rec as (select file_id, rec_offset, row_number() over (partition by file_id order by rec_offset) pos, late
        from (select t.file_id, t.rec_offset, bool_or(t.revision > 1 and t.written_at > o.as_of) late from trips t left join ok o using (file_id) group by 1, 2))
select r.file_id, r.rec_offset from rec r left join ok o using (file_id)
where o.run_id is null or coalesce(r.late, false) or (o.read_offset is not null and r.rec_offset >= o.read_offset) or (o.read_offset is null and r.pos > coalesce(o.entries, 0))
"""
_GAPS = """
with last as (select * from (select *, row_number() over (partition by file_id, run_id order by logged_at desc nulls last) n from file_meta) where n = 1),
ok as (select * from (select *, row_number() over (partition by file_id order by run_id desc) m from last where lower(trim(status)) = 'ok' and finished_at is not null) where m = 1),
rec as (select file_id, rec_offset, row_number() over (partition by file_id order by rec_offset) - 1 place from (select distinct file_id, rec_offset from trips)),
ends as (select file_id, min(rec_offset) a, max(rec_offset) + 1 b from rec group by 1),
upto as (select e.*, case when o.run_id is null then 0 when o.read_offset is not null then o.read_offset else coalesce((select r.rec_offset from rec r where r.file_id = e.file_id and r.place = coalesce(o.entries, 0)), b) end u
         from ends e left join ok o using (file_id))
select file_id, greatest(a, u) lo, b hi from upto where greatest(a, u) < b
"""
SQL = {
    "p6_method": _GAPS,
    "p6_found": _FOUND,
    "p6_commit": f"select count(*) records, count(distinct file_id) files, 1::int runs, 1::int lost, 0::bigint pending from ({_FOUND})",
}
