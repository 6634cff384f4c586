"""Queries of the llm subpackage against their SQL on the smallest tables; those without SQL against what else is known of their results."""

import helpers
import numpy as np
import pytest
import tiktoken

from sparkseek.llm import bpe as B
from sparkseek.llm import queries as llm


@pytest.fixture(scope="module")
def con():
    return helpers.oracle()


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    helpers.same(spark, con, llm.queries()[name], llm.oracle_sql()[name])


def test_queries_without_sql_have_their_own_test():
    assert set(llm.queries()) - set(llm.oracle_sql()) == {"p3_method", "p4_neighbours", "p4_recall", "p7_ids", "p8_mixture", "p8_report", "p9_found", "p9_method", "p9_scores"}


def run(spark, name):
    return llm.queries()[name](spark, helpers.DATA)


def test_scores_are_shares_of_a_record(spark):
    scores = run(spark, "p3_method").toPandas()
    assert (scores.groupby("rec_id")["score"].sum() - 1).abs().max() < 1e-6 and (scores["score"] > 0).all()
    pairs = set(zip(scores["rec_id"], scores["word"]))
    assert len(pairs) == len(scores) and {tuple(r) for r in run(spark, "p3_found").collect()} <= pairs


def test_neighbours_against_all_distances(spark, con):
    points = con.execute("select vec_id, min(point)::double[] from vectors where len(point) = 32 and not list_contains(list_transform(point, lambda x: x is not null and isfinite(x)), false) and list_contains(list_transform(point, lambda x: x <> 0), true) group by 1 order by 1").fetchall()
    ids, x = np.array([i for i, _ in points]), np.array([p for _, p in points])
    dist = np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ x.T + (x**2).sum(1), 0))
    np.fill_diagonal(dist, np.inf)
    want = {ids[q]: set(ids[np.lexsort((ids, dist[q]))[:5]].tolist()) for q in range(len(ids))}
    got = run(spark, "p4_neighbours").toPandas()
    at = {v: i for i, v in enumerate(ids.tolist())}
    assert all(abs(dist[at[r.vec_id], at[r.neighbour]] - r.dist) < 1e-4 for r in got.itertuples())
    assert sum(r.neighbour in want[r.vec_id] for r in got.itertuples()) >= 0.9 * 5 * len(ids)
    assert run(spark, "p4_recall").first()["recall"] >= 0.9


def theirs():
    ranks = B.read_ranks(open(B.vocabulary_path(), "rb").read())
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_of_all_documents(spark, con):
    encode = theirs().encode_ordinary
    want = {i: encode(t) if t else [] for i, t in con.execute("select doc_id, text from documents").fetchall()}
    assert {r["doc_id"]: list(r["ids"]) for r in run(spark, "p7_ids").collect()} == want


def test_mixture_by_the_tokens_of_another_library(spark, con):
    encode = theirs().encode_ordinary
    docs = {i: (s, len(encode(t)) if t else 0) for i, s, t in con.execute("select doc_id, source, text from documents").fetchall()}
    targets = {s: (share, most) for s, share, most in con.execute("select * from mix_targets").fetchall()}
    rows = run(spark, "p8_mixture").collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) > 0
    assert all((r["source"], r["n_tokens"]) == docs[r["doc_id"]] and 1 <= r["copies"] <= targets[r["source"]][1] for r in rows)
    tokens = {s: sum(r["n_tokens"] * r["copies"] for r in rows if r["source"] == s) for s in targets}
    there = {s for s in targets if any(d == (s, n) and n for d in docs.values() for n in [d[1]])}
    report = {r["source"]: r for r in run(spark, "p8_report").collect()}
    assert set(report) == set(targets) and all(report[s]["tokens"] == tokens[s] for s in targets)
    whole = sum(targets[s][0] for s in there)
    for s in there:
        asked = targets[s][0] / whole * sum(tokens.values())
        assert abs(tokens[s] - asked) <= len(there) * max(n for x, n in docs.values() if x in there)
        assert report[s]["actual_share"] == pytest.approx(tokens[s] / sum(tokens.values()))


def test_stuffed_pages_are_outliers(spark, con):
    scores = {r["doc_id"]: r for r in run(spark, "p9_scores").collect()}
    outliers = {r["doc_id"] for r in run(spark, "p9_method").collect()}
    found = {r["doc_id"] for r in run(spark, "p9_found").collect()}
    assert set(scores) == {r[0] for r in con.execute("select doc_id from documents").fetchall()}
    assert found and found <= outliers == {i for i, r in scores.items() if r["outlier"]}
    assert found == {i for i in outliers if scores[i]["length"] >= 60 and scores[i]["sentences"] < 0.5}


def test_registered(spark):
    import __spark_entry__ as e

    assert set(llm.queries()) <= set(e.queries())
