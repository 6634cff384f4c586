import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.llm import quantize as Q


def frame(spark, points):
    return spark.createDataFrame([(i, p, "clash", 1) for i, p in points], "vec_id long, point array<float>, x string, cell int")


def clusters(n, d=8, k=6, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(k, d))[rng.integers(k, size=n)] * 10 + rng.normal(size=(n, d))).astype(np.float32)


def brute(x, k):
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return [sorted(zip(row, range(len(x))))[:k] for row in d.tolist()]


def test_valid_vectors(spark):
    bad = [(1, None), (2, []), (3, [1.0]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, None]), (None, [1.0, 2.0]), (8, [1.0, 2.0, 3.0])]
    good = [(9, [0.0, -1.0]), (9, [0.0, -1.0]), (10, [3.0, 1.0]), (10, [2.0, 1.0])]
    got = {r["vec_id"]: list(r["point"]) for r in Q.valid_vectors(frame(spark, bad + good), "vec_id", "point", 2).collect()}
    assert got == {9: [0.0, -1.0], 10: [2.0, 1.0]}


def test_beam_search_improves_and_reconstructs():
    x = clusters(2000)
    s = Q.Settings(books=4, words=32, sample_rows=2000)
    b = Q.Codebooks.train(x, 4, s)
    residual = x - b.center(b.visits(x, 1)[0][:, 0])
    errors = []
    for beam in (1, 4, 8):
        codes, rest = b.encode(residual, beam)
        assert np.allclose(rest, sum(b.fine[m][codes[:, m]] for m in range(4)), atol=1e-4)
        errors.append(((residual - rest) ** 2).sum(1).mean())
    assert errors[2] <= errors[1] * 1.001 < errors[0] * 1.001 and errors[2] < (residual**2).sum(1).mean() / 3


@pytest.mark.parametrize("settings", [Q.Settings(cell_rows=100, words=32, books=3, probes=6, rerank=40), Q.Settings(cell_rows=400, block_rows=50, block_queries=70, words=16, books=2, probes=4, rerank=50)])
def test_recall_and_exact_distances(spark, settings):
    x = clusters(600)
    index = Q.Index(frame(spark, [(i, [float(v) for v in p]) for i, p in enumerate(x)]), d=8, settings=settings)
    got = {r["vec_id"]: list(zip(r["dists"], r["ids"])) for r in index.neighbours().collect()}
    want = brute(x, 5)
    assert set(got) == set(range(600)) and all(len(v) == 5 and v == sorted(v) for v in got.values())
    found = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in got)
    assert found / 3000 > 0.95
    true = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(2))
    assert all(abs(d - true[q, i]) < 1e-9 and i != q for q, v in got.items() for d, i in v)


def test_exact_neighbours_is_exact(spark):
    x = clusters(200)
    index = Q.Index(frame(spark, [(i, [float(v) for v in p]) for i, p in enumerate(x)]), d=8, settings=Q.Settings(words=16, books=1))
    got = {r["vec_id"]: r["ids"] for r in Q.exact_neighbours(index.rows.repartition(3), index.vectors(F.col("vec_id") % 50 == 0), 5, 8).collect()}
    want = brute(x, 5)
    assert got == {q: [i for _, i in want[q]] for q in (0, 50, 100, 150)}
    with pytest.raises(ValueError):
        Q.exact_neighbours(index.rows, index.rows, 5, 8, most=10)


def test_ties_copies_and_few_points(spark):
    index = Q.Index(frame(spark, [(i, [1.0, 2.0]) for i in range(9)] + [(20, [5.0, 5.0]), (21, None)]), d=2, settings=Q.Settings(words=4, books=1))
    got = {r["vec_id"]: r["ids"] for r in index.neighbours().collect()}
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and len(got[20]) == 5
    pairs = {tuple(r) for r in Q.close_pairs(index.neighbours(), 1.5).collect()}
    assert (0, 1) in pairs and all(a < b for a, b in pairs) and not any(20 in p for p in pairs)
    one = Q.Index(frame(spark, [(1, [1.0, 2.0])]), d=2, settings=Q.Settings(words=4, books=1))
    assert one.neighbours().select(F.size("ids")).collect()[0][0] == 0
    none = Q.Index(frame(spark, [(1, None)]), d=2, settings=Q.Settings(words=4, books=1))
    assert none.neighbours().count() == 0


def test_queries_subset(spark):
    x = clusters(300)
    index = Q.Index(frame(spark, [(i, [float(v) for v in p]) for i, p in enumerate(x)]), d=8, settings=Q.Settings(words=16, books=2))
    part = index.neighbours(F.col("vec_id") % 50 == 0).collect()
    assert {r["vec_id"] for r in part} == {0, 50, 100, 150, 200, 250}


def test_large_group_of_copies(spark):
    """Copies are spread over, not compared: 400 ids of one point, some near it, ties by id everywhere."""
    rng = np.random.default_rng(3)
    points = [(i, [1.0, 1.0]) for i in range(0, 800, 2)] + [(i, [float(v) for v in rng.normal(size=2)]) for i in range(1, 60, 2)] + [(901, [1.0, 1.5]), (903, [1.0, 1.5])]
    index = Q.Index(frame(spark, points), d=2, settings=Q.Settings(words=8, books=2))
    assert index.n == 32 and index.members().count() == len(points) == index.vectors().count()
    got = {r["vec_id"]: list(zip(r["dists"], r["ids"])) for r in index.neighbours().collect()}
    x, ids = np.array([p for _, p in points], np.float32).astype(float), np.array([i for i, _ in points])
    assert set(got) == set(ids.tolist())
    for q, v in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = sorted((a, i) for a, i in zip(d.tolist(), ids.tolist()) if i != q)[:5]
        assert [i for _, i in v] == [i for _, i in want] and np.allclose([a for a, _ in v], [a for a, _ in want])
    assert {r["vec_id"] for r in index.neighbours(F.col("vec_id") < 3).collect()} == {0, 1, 2}


def test_isolated_points_have_all_their_neighbours(spark):
    """Far points that are alone in their cells: none comes out with fewer than k neighbours, and theirs are the true ones."""
    far = np.eye(8, dtype=np.float32)[np.arange(24) % 8] * (1000.0 + 700 * np.arange(24, dtype=np.float32))[:, None]
    x = np.concatenate((clusters(96), far))
    index = Q.Index(frame(spark, [(i, [float(v) for v in p]) for i, p in enumerate(x)]), d=8, settings=Q.Settings(cell_rows=3, words=16, books=2, probes=2))
    got = {r["vec_id"]: r["ids"] for r in index.neighbours().collect()}
    assert set(got) == set(range(120)) and all(len(v) == 5 for v in got.values())
    members = {r["cell"]: r["n"] for r in index.rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    short = {r["vec_id"] for r in index.rows.collect() if sum(members.get(c, 0) for c in r["visit"]) < 6}
    want = brute(x, 5)
    assert short and all(got[q] == [i for _, i in want[q]] for q in short)


def test_radius_of_a_cell_with_one_sampled_member_is_unknown():
    x = np.concatenate((clusters(50), np.full((1, 8), 1e4, np.float32)))
    b = Q.Codebooks.train(x, 40, Q.Settings(books=1, words=8))
    assert (np.bincount(Q._nearest(x, b.coarse[0])[:, 0], minlength=40) == 1).any() and (b.radius > 0).all()


def test_level_sizes():
    assert Q.level_sizes(1, 4096) == [1] and Q.level_sizes(4096, 4096) == [4096] and Q.level_sizes(4097, 4096) == [65, 65] and Q.level_sizes(500, 8) == [8, 8, 8]


@pytest.mark.parametrize("level_words", [8, 4])
def test_several_coarse_levels(spark, level_words):
    """Two and three levels of codewords make the cells: recall and exact distances hold, and cells stay as small as with one level."""
    x = clusters(1500)
    index = Q.Index(frame(spark, [(i, [float(v) for v in p]) for i, p in enumerate(x)]), d=8, settings=Q.Settings(cell_rows=30, level_words=level_words, words=32, books=3, probes=10, rerank=40))
    b = index.books.value
    assert len(b.coarse) == (2 if level_words == 8 else 3) and max(map(len, b.coarse)) <= level_words
    cells, _ = b.visits(x, 10)
    away = lambda c: np.sqrt(((x - b.center(c)) ** 2).sum(1))
    assert (away(cells[:, 0]) <= away(cells[:, 1]) + 1e-4).all() and len(set(cells[0])) == 10
    got, want = {r["vec_id"]: r["ids"] for r in index.neighbours().collect()}, brute(x, 5)
    assert set(got) == set(range(1500)) and sum(len(set(got[q]) & {i for _, i in want[q]}) for q in got) / 7500 > 0.9


def test_refit_lowers_the_error():
    x = clusters(3000, k=30)
    s = Q.Settings(books=4, words=32)
    rng = np.random.default_rng(1)
    plain = Q.Codebooks((x.mean(0)[None],), np.ones(1), np.stack([Q.kmeans(x - x.mean(0), 32, rng) / 2**m for m in range(4)]))
    residual = x - x.mean(0)
    error = lambda b: ((residual - b.encode(residual, s.beam)[1]) ** 2).sum(1).mean()
    assert error(plain.refit(residual, s.beam)) < 0.9 * error(plain)
