import datetime as dt
import random

import helpers
import pytest
from pyspark.sql import functions as F

from sparkseek.operators import intervals as I
from sparkseek.queries.intervals import commit_pending

T0 = dt.datetime(2024, 1, 1)
LOG = "run_id long, file_id long, read_offset long, entries long, status string, as_of timestamp_ntz, finished_at timestamp_ntz, logged_at timestamp_ntz, key string"
REC = "file_id long, rec_offset long, revision int, written_at timestamp_ntz, key string, lo int"


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def pend(spark, log, records):
    log = spark.createDataFrame([(r, f, o, e, s, at(a), at(x), at(g), "clash") for r, f, o, e, s, a, x, g in log], LOG)
    rec = spark.createDataFrame([(f, o, v, at(w), "clash", 1) for f, o, v, w in records], REC)
    ledger = I.ledger_from_log(log, rec.select(F.col("file_id").alias("key"), F.col("rec_offset").alias("position")))
    return sorted(tuple(r) for r in I.pending(rec, ledger, "file_id", "rec_offset", F.col("revision") > 1, "written_at").collect())


def test_cases(spark):
    log = [
        (1, 1, 100, 2, "OK", 1, 2, 2),
        (1, 1, 100, 2, "OK", 1, 2, 2),
        (2, 1, 300, 2, "ok", 1, None, 3),
        (3, 1, 300, 2, "ok", 1, 2, 4),
        (3, 1, 300, 2, "rolled_back", 1, 2, 5),
        (4, 2, None, 2, "Ok", 5, 6, 7),
        (5, 3, None, 9, "ok", 5, 6, 7),
        (6, 4, None, 0, "ok", 5, 6, 7),
        (7, 5, None, None, "ok", 5, 6, 7),
        (8, 7, 0, 1, "ok", 5, 6, 7),
        (None, 8, 10, 1, "ok", 5, 6, 7),
    ]
    records = [(1, 0, 1, 0), (1, 99, 2, 0), (1, 50, 2, 3), (1, 50, 1, 0), (1, 100, 1, 0), (1, 100, 1, 0), (1, None, 1, 0), (None, 5, 1, 0)]
    records += [(f, o, 1, 9) for f in (2, 3, 4, 5, 6, 7, 8) for o in (10, 20, 20, 30)] + [(2, 10, None, None), (3, 10, 3, 5)]
    every = lambda f: [(f, 10), (f, 20), (f, 30)]
    assert pend(spark, log, records) == sorted([(1, 50), (1, 100), (2, 30), *every(4), *every(5), *every(6), *every(7), *every(8)])


def test_empty(spark):
    assert pend(spark, [], []) == [] and pend(spark, [], [(1, 5, 1, 0)]) == [(1, 5)] and pend(spark, [(1, 1, 5, 1, "ok", 1, 2, 3)], []) == []


def test_random_runs_against_brute_force(spark):
    rng = random.Random(5)
    records = [(f, rng.randrange(0, 2_000_000), rng.choice([1, 1, 1, 2]), rng.randrange(10)) for f in range(12) for _ in range(60)]
    records += records[:100]
    log = [(r, rng.randrange(14), rng.choice([None, rng.randrange(2_000_000)]), rng.randrange(70), rng.choice(["ok", "OK", "failed"]), rng.randrange(10), rng.choice([5, None, 5]), rng.randrange(10)) for r in range(40)]
    best = {}
    for r in sorted(log, key=lambda r: r[0]):
        if r[4].lower() == "ok" and r[6] is not None:
            best[r[1]] = r
    want = set()
    for f, o, v, w in records:
        if f not in best:
            want.add((f, o))
            continue
        _, _, upto, entries, _, seen, _, _ = best[f]
        place = sorted({x[1] for x in records if x[0] == f}).index(o)
        if (o >= upto if upto is not None else place >= entries) or (v > 1 and w > seen):
            want.add((f, o))
    assert pend(spark, log, records) == sorted(want)


def frame(spark, rows):
    return spark.createDataFrame([(k, a, b, T0) for k, a, b in rows], I.LEDGER_SCHEMA)


def test_merge_and_subtract(spark):
    rows = [(1, 0, 5), (1, 5, 9), (1, 12, 20), (1, 13, 14), (1, 30, 30), (2, 0, 1 << 20), (2, 1 << 19, 1 << 21)]
    merged = sorted((r["key"], r["lo"], r["hi"]) for r in I.merge_intervals(frame(spark, rows)).collect())
    assert merged == [(1, 0, 9), (1, 12, 20), (2, 0, 1 << 21)]
    gaps = sorted(tuple(r) for r in I.subtract_intervals(frame(spark, [(1, 3, 40), (3, 0, 2)]), I.merge_intervals(frame(spark, rows))).collect())
    assert gaps == [(1, 9, 12), (1, 20, 40), (3, 0, 2)]


def test_store_survives_a_broken_run(spark, tmp_path):
    store = I.LedgerStore(spark, f"file://{tmp_path}/ledger")
    out = spark.createDataFrame([(1, 5)], "file_id long, rec_offset long")
    assert store.version() == 0 and store.ledger().count() == 0 and store.output() is None
    store.prepare(frame(spark, [(1, 0, 10)]), out)  # and then it breaks off
    assert store.version() == 0 and store.output() is None
    assert store.commit(frame(spark, [(1, 0, 10)]), out) == 1
    assert store.commit(frame(spark, [(1, 10, 12), (1, 4, 6), (2, 0, 1)]), out) == 2
    got = sorted((r["key"], r["lo"], r["hi"]) for r in store.ledger().collect())
    assert got == [(1, 0, 4), (1, 4, 6), (1, 6, 10), (1, 10, 12), (2, 0, 1)] and store.output().count() == 2


def test_pending_filters_before_the_shuffle(spark):
    rec = spark.createDataFrame([(1, 5, 1, T0, "x", 1)], REC)
    ledger = frame(spark, [(1, 0, 10)])
    plan = I.pending(rec, ledger, "file_id", "rec_offset", F.col("revision") > 1, "written_at")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.index("Exchange hashpartitioning(key") < plan.index("BroadcastHashJoin")


def test_merge_keeps_each_as_of(spark):
    rows = [(1, 0, 5, 3), (1, 5, 9, 3), (1, 9, 12, 4), (1, 20, 30, 1), (1, 22, 25, 2), (2, 0, 4, 7), (2, 2, 6, 5), (2, 3, 8, None), (3, 1, 2, None), (3, 2, 4, None)]
    got = sorted(tuple(r) for r in I.merge_intervals(spark.createDataFrame([(k, a, b, at(h)) for k, a, b, h in rows], I.LEDGER_SCHEMA)).collect())
    want = [(1, 0, 9, 3), (1, 9, 12, 4), (1, 20, 22, 1), (1, 22, 25, 2), (1, 25, 30, 1), (2, 0, 3, 7), (2, 3, 8, None), (3, 1, 4, None)]
    assert got == [(k, a, b, at(h)) for k, a, b, h in want]


def test_first_commit_takes_in_the_initial_ledger(spark, tmp_path):
    initial = frame(spark, [(1, 0, 10), (2, 0, I.MAX_POSITION)])
    store = I.LedgerStore(spark, f"file://{tmp_path}/ledger", initial)
    store.commit(spark.createDataFrame([(1, 4, 6, at(2)), (1, 10, 12, at(1))], I.LEDGER_SCHEMA), spark.createDataFrame([(1, 4)], "file_id long, rec_offset long"))
    got = sorted(tuple(r) for r in store.ledger().collect())
    assert got == [(1, 0, 4, T0), (1, 4, 6, at(2)), (1, 6, 10, T0), (1, 10, 12, at(1)), (2, 0, I.MAX_POSITION, T0)]


def test_nothing_is_pending_after_the_commit(spark):
    store, lost, left = commit_pending(spark, helpers.DATA)
    assert (left, lost, store.version()) == (0, 1, 1) and store.output().count() > 0
    assert store.ledger().count() < store.output().count()  # touching records of a run are one interval


def test_of_two_racing_runs_one_commits(spark, tmp_path):
    store = I.LedgerStore(spark, f"file://{tmp_path}/ledger")
    out = lambda i: spark.createDataFrame([(i, i)], "file_id long, rec_offset long")
    a, b = store.prepare(frame(spark, [(1, 0, 5)]), out(1)), store.prepare(frame(spark, [(1, 0, 9)]), out(2))
    assert b.commit() == 1
    with pytest.raises(I.LostRace):
        a.commit()
    assert [tuple(r)[:3] for r in store.ledger().collect()] == [(1, 0, 9)] and [tuple(r) for r in store.output().collect()] == [(2, 2)]


def test_late_records_are_in_a_gap(spark, tmp_path):
    store = I.LedgerStore(spark, f"file://{tmp_path}/ledger")
    store.commit(frame(spark, [(1, 0, 10), (1, 20, 30)]), spark.createDataFrame([(1, 0)], "file_id long, rec_offset long"))
    rec = spark.createDataFrame([(1, p, 1, T0, "x", 1) for p in (0, 9, 10, 15, 20, 30)] + [(2, 3, 1, T0, "x", 1)], REC)
    todo = I.pending(rec, store.ledger(), "file_id", "rec_offset", F.col("revision") > 1, "written_at")
    assert sorted(tuple(r) for r in todo.collect()) == [(1, 10), (1, 15), (1, 30), (2, 3)]


def test_intervals_against_sets_of_positions(spark):
    """Random intervals over many blocks, in both operators, against plain sets."""
    rng = random.Random(9)
    unit = 1 << (I.LEAST_BITS - 2)
    for _ in range(3):
        draw = lambda n: [(k, a * unit, (a + rng.randint(1, 9)) * unit) for k, a in ((rng.randrange(3), rng.randrange(60)) for _ in range(n))]
        cells = lambda rows: {(k, i) for k, a, b in rows for i in range(a // unit, b // unit)}
        have, done = I.merge_intervals(frame(spark, draw(25))), I.merge_intervals(frame(spark, draw(12)))
        plain = lambda df: [tuple(r)[:3] for r in df.collect()]
        a, b = plain(have), plain(done)
        assert sum(y - x for _, x, y in a) == unit * len(cells(a))
        got = [tuple(r)[:3] for r in I.subtract_intervals(have, done).select("key", "lo", "hi").collect()]
        assert cells(got) == cells(a) - cells(b) and sum(y - x for _, x, y in got) == unit * len(cells(got))
        assert not {(k, x) for k, x, _ in a} & {(k, y) for k, _, y in a}  # none touch
