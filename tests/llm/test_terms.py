import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.functions.text import normal_form
from sparkseek.llm import parsimony as P
from sparkseek.llm.terms import LostUpdate, TermCounts, record_terms, signed_delta

TOKENS = "rec_id long, word string, tok_offset int, tf long, at string"


def tokens(spark, rows):
    return spark.createDataFrame([(r, w, o, 9, "clash") for r, w, o in rows], TOKENS)


def terms(spark, rows):
    return spark.createDataFrame(rows, "rec_id long, word string, tf long")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_record_terms(spark):
    rows = [(1, "The", 0), (1, "thé", 4), (1, "thé", 4), (1, None, 9), (1, "…", 11), (1, "", 12), (2, "ＴＨＥ", 0), (2, "x" * 100_000, 4), (None, "lost", 0), (3, "b", None), (3, "a", None), (4, "zz", 5), (4, "aa", 5)]
    assert as_set(record_terms(tokens(spark, rows))) == {(1, "the", 2), (2, "the", 1), (2, "x" * 100_000, 1), (3, "a", 1), (4, "aa", 1)}
    assert record_terms(tokens(spark, [])).count() == 0


def test_signed_delta(spark):
    before, after = terms(spark, [(1, "a", 3), (1, "b", 1)]), terms(spark, [(1, "a", 2), (1, "c", 1), (2, "a", 1)])
    assert as_set(signed_delta(before, after)) == {("b", -1, -1), ("c", 1, 1), ("a", 0, 1)}
    assert as_set(signed_delta(after, after)) == set()


def full(records):
    occ, docs = Counter(), Counter()
    for words in records.values():
        for w, n in words.items():
            occ[w] += n
            docs[w] += 1
    return {(w, occ[w], docs[w]) for w in occ}


def test_increments_equal_a_full_count(spark, tmp_path):
    rng = random.Random(1)
    store, state = TermCounts(spark, f"file://{tmp_path}/counts", buckets=4), {}
    assert store.counts().count() == 0 and store.update() == 0
    for step in range(4):
        before, after = [], []
        for r in range(12):
            if rng.random() < 0.6:
                old = state.pop(r, {})
                new = {rng.choice("abcdefgh"): rng.randint(1, 3) for _ in range(rng.randint(0, 4))} if rng.random() < 0.75 else {}
                before += [(r, w, n) for w, n in old.items()]
                after += [(r, w, n) for w, n in new.items()]
                if new:
                    state[r] = new
        store.update(terms(spark, before), terms(spark, after))
        assert as_set(store.counts()) == full(state) and store.records() == len(state) and store.version() == step + 1


def test_failed_update_changes_nothing(spark, tmp_path):
    store = TermCounts(spark, f"file://{tmp_path}/counts", buckets=2)
    store.update(after=terms(spark, [(1, "a", 1)]))
    broken = terms(spark, [(2, "b", 1)]).withColumn("word", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.update(after=broken)
    assert store.version() == 1 and as_set(store.counts()) == {("a", 1, 1)}
    store.update(after=terms(spark, [(2, "a", 2)]))
    assert as_set(store.counts()) == {("a", 3, 2)}


def test_marks(spark, tmp_path):
    store = TermCounts(spark, f"file://{tmp_path}/counts", buckets=2)
    store.update(after=terms(spark, [(r, "all", 1) for r in range(10)] + [(r, "some", 2) for r in range(3)] + [(r, "fifth", 1) for r in range(2)] + [(1, "once", 1)]))
    assert {r["word"]: r["mark"] for r in store.marked().collect()} == {"all": "common", "some": "common", "fifth": "rare", "once": "rare"}


def slow_em(tf, pc, a, steps, tolerance):
    p, last = [t / sum(tf) for t in tf], None
    for k in range(steps):
        e = [t * a * x / ((1 - a) * c + a * x) for t, x, c in zip(tf, p, pc)]
        s = sum(e)
        p = [x / s for x in e]
        if k and abs(s - last) <= tolerance * s:
            break
        last = s
    return p


def test_em_against_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(r, f"w{w}", rng.randint(1, 5)) for r in range(30) for w in {int(rng.random() ** 3 * 60) for _ in range(rng.randint(1, 20))}]
    cf, total = Counter(), 0
    for _, w, n in rows:
        cf[w] += n
        total += n
    got = {(r["rec_id"], r["word"]): r for r in P.scores(terms(spark, rows)).collect()}
    assert len(got) == len(rows)
    for rec in range(30):
        mine = [(w, n) for r, w, n in rows if r == rec]
        want = slow_em([n for _, n in mine], [cf[w] / total for w, _ in mine], P.SPECIFIC, P.STEPS, P.TOLERANCE)
        for (w, n), p in zip(mine, want):
            assert got[rec, w]["score"] == pytest.approx(p, rel=1e-9) and got[rec, w]["record_words"] == sum(x for _, x in mine)
        assert sum(got[rec, w]["score"] for w, _ in mine) == pytest.approx(1)


def test_rare_shared_terms_win_and_length_does_not(spark):
    rows = [(r, "the", 5) for r in range(50)] + [(0, "rare", 2), (1, "rare", 2)] + [(2, f"filler{i}", 1) for i in range(200)] + [(2, "rare", 2)]
    s = {(r["rec_id"], r["word"]): r["score"] for r in P.scores(terms(spark, rows)).collect()}
    assert s[0, "rare"] > s[0, "the"] and s[0, "rare"] == s[1, "rare"] and s[2, "rare"] < s[0, "rare"]


def test_no_records(spark):
    assert P.scores(terms(spark, [])).count() == 0


def test_sums_of_one_record_do_not_depend_on_others():
    a = (np.array([2]), np.array([1.0, 3.0]), np.array([0.2, 0.01]), np.array([4.0, 1.0]))
    b = (np.array([2, 1]), np.array([1.0, 3.0, 2.0]), np.array([0.2, 0.01, 0.5]), np.array([4.0, 1.0, 7.0]))
    assert P.em_sums(*a, 0.1, 40, 1e-4)[0].tolist() == P.em_sums(*b, 0.1, 40, 1e-4)[0].tolist()


def test_normal_form_is_idempotent():
    for w in ("Ünïcode", "ﬁ№", "A-b"):
        assert normal_form(normal_form(w)) == normal_form(w)


def test_buckets_follow_the_vocabulary(spark, tmp_path):
    store = TermCounts(spark, f"file://{tmp_path}/counts", terms_per_bucket=10)
    store.update(after=terms(spark, [(1, f"w{i}", 1) for i in range(8)]))
    assert store.manifest()["buckets"] == 1
    store.update(after=terms(spark, [(2, f"w{i}", 2) for i in range(60)]))
    assert store.manifest()["buckets"] == 8 and store.records() == 2
    assert as_set(store.counts()) == {(f"w{i}", 3 if i < 8 else 2, 2 if i < 8 else 1) for i in range(60)}
    store.update(before=terms(spark, [(2, "w3", 2)]))
    assert {r[0]: tuple(r[1:]) for r in store.counts().collect()}["w3"] == (1, 1)


def test_of_two_racing_updates_one_counts(spark, tmp_path, monkeypatch):
    a, b = (TermCounts(spark, f"file://{tmp_path}/counts") for _ in range(2))
    a.update(after=terms(spark, [(1, "x", 1)]))
    monkeypatch.setattr(b, "version", lambda: 0)  # began before a's update
    with pytest.raises(LostUpdate):
        b.update(after=terms(spark, [(2, "y", 5)]))
    assert as_set(a.counts()) == {("x", 1, 1)}
