import pytest
from pyspark.sql import functions as F

from sparkseek.functions import text as T
from sparkseek.operators import knn as K
from sparkseek.operators import search as S


def grams(spark, phrase, low, high, normalize="ascii"):
    return spark.createDataFrame([(phrase,)], "t string").select(T.ngrams_between(F.col("t"), low, high, normalize)).first()[0]


@pytest.mark.parametrize(
    "phrase, low, high, want",
    [
        ("wakemeup", 1, 2, "w a k e m e u p wa ak ke em me eu up"),
        ("I can't wake up", 1, 2, "i c a n t w a k e u p ca an nt wa ak ke up"),
        ("wakemeup", 3, 3, "wak ake kem eme meu eup"),
        ("I can't wake up", 3, 3, "can ant wak ake"),
    ],
)
def test_ngrams(spark, phrase, low, high, want):
    assert grams(spark, phrase, low, high) == want.split()
    counted = S.query_grams(phrase, low, high)
    assert sum(counted.values()) == len(want.split()) and set(counted) == set(want.split())


def test_ngrams_nfkd_and_odd_input(spark):
    assert grams(spark, "café", 3, 3, "nfkd") == ["caf", "afe"]
    assert grams(spark, "ｆｏｏ", 3, 3, "nfkd") == ["foo"]
    assert grams(spark, "", 1, 3) == [] and grams(spark, None, 1, 3) is None and grams(spark, " \t\n", 1, 3) == []
    assert len(grams(spark, "ab" * 100_000, 3, 3)) == 199_998


@pytest.mark.parametrize(
    "phrase, n, want",
    [
        ("h do", 1, [("h", 0), ("d", 2), ("o", 3)]),
        ("howdydo", 3, [("how", 0), ("owd", 1), ("wdy", 2), ("dyd", 3), ("ydo", 4)]),
        ("h∫owd*y)__do ", 1, [("h", 0), ("o", 2), ("w", 3), ("d", 4), ("y", 6), ("d", 10), ("o", 11)]),
    ],
)
def test_gram_positions(phrase, n, want):
    assert [(g, o) for g, o, _ in T.gram_positions(phrase, n)] == want


def test_gram_spans():
    assert T.gram_positions("h∫owd*y)__do ", 2) == [("ho", 0, 3), ("ow", 2, 2), ("wd", 3, 2), ("dy", 4, 3), ("yd", 6, 5), ("do", 10, 2)]
    assert T.gram_positions("h∫owd∫y dow ", 3) == [("how", 0, 4), ("owd", 2, 3), ("wdy", 3, 4), ("dow", 8, 3)]
    assert [g for g, _, _ in T.gram_positions("café", 1)] == list("cafe")


def test_normal_form():
    assert [T.normal_form(w) for w in ("Sigñ", "ｆａｍ", "in-stall", "№5", "…", "ﬁre", "inst’all", "İ")] == ["sign", "fam", "install", "no5", "", "fire", "install", "i"]


def test_every_trigram_is_found(spark):
    docs = spark.createDataFrame([(0, "howdy do how yall doing"), (1, "how dyd oh owyal ldoing"), (2, None), (3, "")], "doc long, text string")
    p = S.postings(docs, 3)
    hits = {r["doc"] for r in p.where(F.col("gram").isin("how", "owd", "wdy")).collect()}
    assert hits == {0, 1}
    assert [r["doc"] for r in S.search(docs, "howdy", 3, 3).collect()] == [0, 1]  # in two of four documents, "how" weighs nothing
    assert S.search(docs, "!!", 1, 2).count() == 0
    assert S.search(docs.limit(0), "howdy", 1, 2).count() == 0


def test_search_equals_stored_postings(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} common tail{i % 3}") for i in range(60)], "doc long, text string")
    S.write_postings(S.postings(docs, low=1, high=3), str(tmp_path / "p"))
    a = S.search(docs, "word3 tail1", 1, 3).collect()
    b = S.search_postings(spark.read.parquet(str(tmp_path / "p")), 60, "word3 tail1", 1, 3).collect()
    assert {r["doc"]: round(r["score"], 9) for r in a} == {r["doc"]: round(r["score"], 9) for r in b} and len(a) == 60


POINTS = [(3, 3), (4, 4), (5, 5)]


def test_distances(spark):
    pairs = [([5.0, 3.0, 0.0], [2.0, -2.0, 2**0.5], 6.0), ([1.0, 0.0, -5.0], [-3.0, 2.0, -1.0], 6.0), ([1.0, 3.0], [5.0, 2.0], 17**0.5), ([0.0, 1.0, 4.0], [2.0, 9.0, 1.0], 77**0.5), ([0.0], [0.0], 0.0)]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>, d double")
    assert all(abs(r["x"] - r["d"]) < 1e-6 for r in df.select("d", K.l2(df.a, df.b).alias("x")).collect())


def vectors(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "vec_id long, embedding array<float>")


def test_knn_small(spark):
    v = vectors(spark, [(0, 0), *POINTS])
    assert [r["vec_id"] for r in K.knn(v, (5, 5), 3).collect()] == [3, 2, 1]
    line = vectors(spark, [(0, 0), *((i, i + 1) for i in range(1, 9))])
    assert [r["vec_id"] for r in K.knn(line, (0, 0), 10).collect()] == list(range(9))


def test_knn_batch_and_lsh(spark):
    v = vectors(spark, [(i % 10, i // 10) for i in range(100)])
    queries = v.where("vec_id in (0, 55)").selectExpr("vec_id as query_id", "embedding as query")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in K.knn_batch(v, queries, 3).collect()}
    assert got == {(0, 1): 0, (0, 2): 1, (0, 3): 10, (55, 1): 55, (55, 2): 45, (55, 3): 54}
    assert {(r["query_id"], r["rank"]): r["vec_id"] for r in K.knn_batch(v, queries, 3, block=1).collect()} == got
    assert K.knn_lsh(v, (0.0, 0.0), 5, bucket=4.0).count() == 5


def test_wrong_dimension(spark):
    v = vectors(spark, [(1, 2), (1, 2, 3)])
    with pytest.raises(Exception, match="expected 2 dimensions"):
        v.select(K.check_dimension(v.embedding, 2)).collect()
