"""Every core query against its SQL on the smallest tables."""

import helpers
import pytest

from sparkseek import queries as core


@pytest.fixture(scope="module")
def con():
    return helpers.oracle()


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    helpers.same(spark, con, core.queries()[name], core.oracle_sql()[name])


def test_queries_without_sql_have_their_own_test():
    assert set(core.queries()) - set(core.oracle_sql()) == {"knn_lsh", "knn_hnsw", "p1_rejects", "p2_method", "p2_unified"}


def run(spark, name):
    return core.queries()[name](spark, helpers.DATA)


def test_approximate_neighbours_have_exact_distances(spark, con):
    vectors = dict(con.execute("select vec_id, embedding::double[] from embeddings").fetchall())
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(vectors[a], vectors[b])) ** 0.5
    near = run(spark, "knn_hnsw").collect()
    assert {r["query_id"] for r in near} == {i for i in vectors if i % 50 == 0} and all(abs(r["dist"] - away(r["query_id"], r["id"])) < 1e-5 for r in near)
    assert len({(r["query_id"], r["id"]) for r in near}) == len(near) and all(r["rank"] <= 5 for r in near)
    hashed = run(spark, "knn_lsh").collect()
    assert hashed[0]["vec_id"] == 0 and all(abs(r["dist"] - away(0, r["vec_id"])) < 1e-5 for r in hashed)


def test_rejects_are_the_lines_found_with_text_and_reason(spark, con):
    got = {r["line_id"]: (r["raw"], r["reason"]) for r in run(spark, "p1_rejects").collect()}
    assert set(got) == {r["line_id"] for r in run(spark, "p1_found").collect()} and all(reason for _, reason in got.values())
    assert {i: raw for i, (raw, _) in got.items()} == dict(x for x in con.execute("select line_id, raw_line from index_dump").fetchall() if x[0] in got)


def test_unified_table_has_each_record_once(spark, con):
    table = run(spark, "p2_unified")
    assert sorted(r["rec_id"] for r in table.select("rec_id").collect()) == [r[0] for r in con.execute("select distinct rec_id from permits order by 1").fetchall()]
    assert len({c.lower() for c in table.columns}) == len(table.columns)


def test_matched_fields_are_matched_once(spark, con):
    rows = run(spark, "p2_method").collect()
    assert rows and all(0.5 <= r["weight"] <= 1 for r in rows)
    for end in ("gone", "new"):
        assert len({(r["file_id"], r[end]) for r in rows}) == len(rows)


def test_entry_has_every_query(spark):
    import __spark_entry__ as e

    assert set(core.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 20
