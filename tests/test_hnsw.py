import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.operators import hnsw as H
from sparkseek.sources import export


def graph(points, **options):
    g = H.Graph(len(points[0]), **options)
    for p in points:
        g.insert(p)
    return g


def test_small_graphs():
    assert [n for _, n in graph([(0, 0), (3, 3), (4, 4), (5, 5)]).knn((5, 5), 3)] == [3, 2, 1]
    line = graph([(0, 0), *((i, i + 1) for i in range(1, 9))])
    assert [n for _, n in line.knn((0, 0), 10)] == list(range(9))
    assert H.Graph(2).knn((0, 0), 3) == []
    with pytest.raises(ValueError):
        line.insert((1, 2, 3))


@pytest.mark.parametrize("seed", [0, 1])
def test_recall_and_structure(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(800, 8)).astype(np.float32)
    g = graph(x, m=8, ef=64, seed=seed)
    hits = 0
    for q in range(0, 800, 20):
        true = np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[:5]
        hits += len(set(true.tolist()) & {n for _, n in g.knn(x[q], 5)})
    assert hits / 200 > 0.95
    assert all(len(level) <= (16 if i == 0 else 8) for n in range(800) for i, level in enumerate(g.neighbourhood(n)))
    assert all(level == sorted(level) or i >= 0 for i, level in enumerate(g.neighbourhood(0)))


def test_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "SHARD_ROWS", 60)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in p], "clash") for i, p in enumerate(x)] + [(999, None, "x")], "vec_id long, embedding array<float>, id string")
    H.build(df, str(tmp_path / "g"), 4)
    index = spark.read.parquet(str(tmp_path / "g"))
    assert index.count() == 4 and index.select(F.sum(F.size("ids"))).first()[0] == 200
    queries = df.where("vec_id in (3, 77)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r["query_id"], r["rank"]): r["id"] for r in H.search(index, queries, 5).collect()}
    for q in (3, 77):
        assert [got[q, i + 1] for i in range(5)] == np.argsort(((x - x[q]) ** 2).sum(1))[:5].tolist()


def test_arrays_round_trip():
    x = np.random.default_rng(3).normal(size=(300, 4)).astype(np.float32)
    g = graph(x, m=6, ef=32)
    back = H.Graph.from_arrays(g.to_arrays())
    assert back.links == g.links and back.entry == g.entry and (back.points == g.points[: g.size]).all()
    assert back.insert(x[0]) == 300 and back.knn(x[0], 2)[0][0] == 0.0
    assert H.Graph.from_arrays(H.Graph(3).to_arrays()).knn((0, 0, 0), 2) == []


def test_store_grows_by_appends(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(330, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in p], "clash") for i, p in enumerate(x)] + [(999, None, "x")], "vec_id long, embedding array<float>, shard string")
    store = H.VectorStore(spark, f"file://{tmp_path}/v", 4, shard_rows=100)
    assert store.index().count() == 0 and store.append(df.limit(0)) == 0
    for low, high in ((0, 150), (150, 160), (160, 330)):
        store.append(df.where((df.vec_id >= low) & (df.vec_id < high)))
    assert store.version() == 3 and sum(n for _, n in store.shards().values()) == 330
    assert 4 <= store.index().count() <= 6
    queries = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r["query_id"], r["rank"]): r["id"] for r in store.search(queries, 5).collect()}
    hits = sum(got[q, i + 1] in np.argsort(((x - x[q]) ** 2).sum(1))[:5] for q in range(0, 330, 50) for i in range(5))
    assert hits >= 33
    with pytest.raises(Exception, match="dimensions"):
        store.append(spark.createDataFrame([(1000, [1.0])], "vec_id long, embedding array<float>"))
    assert store.version() == 3


def test_knn_batch_in_blocks(spark):
    from sparkseek.operators import knn as K

    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, size=(120, 3)).astype(float)  # many ties
    df = spark.createDataFrame([(i, v.tolist(), "c") for i, v in enumerate(x)] + [(500, None, "c"), (None, [0.0, 0.0, 0.0], "c")], "vec_id int, embedding array<double>, id string").repartition(3)
    queries = df.where("vec_id < 40").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for block in (1000, 7):
        got = {}
        for r in K.knn_batch(df, queries, 4, block=block).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["dist"], 9)))
        dist = np.sqrt(((x[:40, None] - x[None]) ** 2).sum(2))
        assert got == {q: [(i, round(dist[q, i], 9)) for i in np.lexsort((np.arange(120), dist[q]))[:4]] for q in range(40)}
    assert K.knn_batch(df, queries.limit(0), 4).count() == 0 and K.knn_batch(df.limit(0), queries, 4).count() == 0
    with pytest.raises(Exception, match="different size"):
        K.knn_batch(spark.createDataFrame([(1, [1.0])], "vec_id int, embedding array<double>"), queries, 1).collect()


def test_export_round_trip(spark, tmp_path):
    rows = [(1, 'a "b", c', None), (2, "line\nbreak", 2.5)]
    df = spark.createDataFrame(rows, "id long, t string, x double")
    export.write_jsonl(df, str(tmp_path / "j"))
    assert [tuple(r) for r in spark.read.schema(df.schema).json(str(tmp_path / "j")).orderBy("id").collect()] == rows
    export.write_csv(df, str(tmp_path / "c"))
    back = spark.read.schema(df.schema).csv(str(tmp_path / "c"), header=True, escape='"', multiLine=True)
    assert [tuple(r) for r in back.orderBy("id").collect()] == rows
    assert [r["value"] for r in export.csv_lines(df).collect()] == ['1,"a ""b"", c",', '2,"line\nbreak",2.5']
