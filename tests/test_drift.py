import itertools
import random

import helpers
from pyspark.sql import functions as F

from sparkseek.functions import variants as V
from sparkseek.operators import drift as D
from sparkseek.queries import drift as queries

TYPES = [(0, "String", "str"), (3, "Float64", "num"), (7, "Null", "nil"), (10, "Unigram", "g1"), (4, "Object", "obj")]


def catalog(spark, files):
    """files: file_id -> [(name, type, ...)] in order; types as names, codes or tags."""
    rows = [(f, i, name, t) for f, fields in files.items() for i, (name, *types) in enumerate(fields) for t in types]
    meta = spark.createDataFrame(rows * 2, "file_id long, field_pos int, field_name string, field_type string").withColumn("type", F.lit("clash"))
    return D.type_catalog(meta, spark.createDataFrame(TYPES, "type_code int, type_name string, type_tag string"))


def changes(spark, files, values=None):
    versions = spark.createDataFrame([(f, "s", i * 2) for i, f in enumerate(files)], "file_id long, series string, seq int")
    return {(r["file_id"], r["field_name"], r["drift"]) for r in D.Drift(catalog(spark, files), versions, values).changes().collect()}


def test_matching_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        a, b = "abcd"[: rng.randint(1, 4)], "wxyz"[: rng.randint(1, 4)]
        w = {(i, j): rng.choice([0.1, 0.3, 0.5, 0.9, 1.0]) for i in a for j in b if rng.random() < 0.7}
        best = max(sum(w.get(p, 0) for p in zip(x, y)) for x in itertools.permutations(list(a) + [None] * 4, 4) for y in [list(b) + [None] * (4 - len(b))])
        got = D.best_matching(w)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and all(p in w for p in got)
        assert abs(sum(w[p] for p in got) - best) < 1e-9
    assert D.best_matching({}) == []


def test_changes(spark):
    files = {
        1: [("a", "String"), ("b", "Float64", "Null"), ("c", "String"), ("d", "Object"), ("d.x", "String")],
        2: [("$.a", "str"), ("$.b2", "num"), ("$.c", "num"), ("$.d", "obj"), ("$.d.y", "str")],  # b renamed, c retyped, d.x renamed
        3: [("a", "0", "10"), ("c", "3"), ("d", "4"), ("d.y", "0"), ("e", "0")],  # b2 gone, e new
        4: [("z", "0"), ("q", "0"), ("d", "4"), ("d.y", "0"), ("e", "0")],  # two neighbours change at once
    }
    assert changes(spark, files) == {
        (2, "b2", "renamed"),
        (2, "c", "retyped"),
        (2, "d.y", "renamed"),
        (3, "b2", "removed"),
        (3, "e", "added"),
        (4, "a", "removed"),
        (4, "c", "removed"),
        (4, "z", "added"),
        (4, "q", "added"),
    }


def test_first_file_single_file_and_empty(spark):
    assert changes(spark, {1: [("a", "String")]}) == set()
    assert changes(spark, {1: [("a", "String")], 2: [("b", "String")]}) == {(2, "b", "renamed")}
    c = catalog(spark, {1: [("a", "String")]}).limit(0)
    versions = spark.createDataFrame([], "file_id long, series string, seq int")
    assert D.Drift(c, versions).changes().count() == 0


def test_value_sketches_pair_renames_where_place_does_not(spark):
    lines = [(1, '{"id":%d,"city":"town %d","n":%d}' % (i, i % 5, i)) for i in range(30)] + [(2, '{"n":%d,"town":"town %d","count":%d}' % (i, i % 5, i + 7)) for i in range(30)] + [(2, None), (2, "[1]"), (2, '{"n":null}')]
    permits = V.with_variant(spark.createDataFrame(lines, "file_id long, j string"), "j", "v")
    values = V.flatten(permits, "v", ["file_id"])
    files = {1: [("id", "Float64"), ("city", "String"), ("n", "Float64")], 2: [("n", "Float64"), ("town", "String"), ("count", "Float64")]}
    versions = spark.createDataFrame([(1, "s", 1), (2, "s", 2)], "file_id long, series string, seq int")
    got = {(r["gone"], r["new"]) for r in D.Drift(catalog(spark, files), versions, values, anchored=False, least=0.3).renames().collect()}
    assert ("city", "town") in got


def test_unified_table(spark):
    lines = [(1, 1, '{"a":1,"o":{"x":"s"}}'), (2, 2, '{"b":2.5,"o":{"x":5},"A":null}'), (3, 2, None), (4, 1, '{"a":"text","t":true}')]
    df = V.with_variant(spark.createDataFrame(lines, "rec_id long, file_id long, j string"), "j", "v")
    names = {"a": ["a", "b"], "o": ["o"], "o.x": ["o.x"], "A": ["A"], "rec_id": ["rec_id"], "t": ["t"]}
    types = {"a": {"Float64"}, "o": {"Object"}, "o.x": {"String", "Float64"}, "A": {"Null"}, "rec_id": {"String"}, "t": {"Boolean", "Null"}}
    out = D.unify(df, "v", names, types, ["rec_id", "file_id"])
    assert out.columns == ["rec_id", "file_id", "a", "o__x", "A_", "rec_id_", "t"]
    assert [tuple(r)[2:4] for r in out.orderBy("rec_id").collect()] == [(1.0, "s"), (2.5, "5"), (None, None), (None, None)]


def test_canonical_names(spark):
    files = {1: [("a", "String")], 2: [("b", "String")], 3: [("b", "String"), ("c", "String")]}
    renames = spark.createDataFrame([(2, "a", "b"), (3, "a", "c")], "file_id long, gone string, new string")
    assert D.canonical_names(catalog(spark, files), renames) == {"b": ["b", "a"], "c": ["c"]}


def test_certain_renames_come_first(spark):
    files = {1: [("a", "String")], 2: [("b", "String"), ("x", "String")], 3: [("c", "String"), ("b", "String")]}
    likely = spark.createDataFrame([(2, "a", "c"), (3, "a", "c"), (3, "x", "c")], "file_id long, gone string, new string")
    certain = spark.createDataFrame([(2, "a", "b")], "file_id long, gone string, new string")
    assert D.canonical_names(catalog(spark, files), likely, certain) == {"b": ["b", "a"], "c": ["c", "x"]}


def test_renames_leave_settled_fields(spark):
    files = {1: [("a", "String"), ("k", "Float64"), ("c", "String")], 2: [("a_new", "String"), ("k", "Float64"), ("c_new", "String")]}
    versions = spark.createDataFrame([(1, "s", 1), (2, "s", 2)], "file_id long, series string, seq int")
    settled = spark.createDataFrame([(2, "a", "a_new")], "file_id long, gone string, new string")
    got = D.Drift(catalog(spark, files), versions, anchored=False, least=0.0).renames(settled).collect()
    assert [tuple(r) for r in got] == [(2, "c", "c_new")]


def test_anchored_rename_with_nothing_alike_shares_a_column(spark):
    files = {1: [("id", "Float64"), ("sqft", "String"), ("z", "Float64")], 2: [("id", "Float64"), ("area", "String"), ("z", "Float64")]}
    lines = [(f, '{"id":%d,"%s":"%s","z":1}' % (i, n, i * m)) for f, n, m in ((1, "sqft", 7), (2, "area", 1000003)) for i in range(1, 20)]
    permits = V.with_variant(spark.createDataFrame(lines, "file_id long, j string"), "j", "v")
    versions = spark.createDataFrame([(1, "s", 1), (2, "s", 2)], "file_id long, series string, seq int")
    assert queries.unified_names(catalog(spark, files), versions, permits)["area"] == ["area", "sqft"]


def test_every_rename_found_shares_a_column(spark):
    c, versions, permits = queries._inputs(spark, helpers.DATA.replace("sf0.001", "sf0.01"))
    found = {(r["gone"], r["new"]) for r in D.Drift(c, versions, queries._values(permits), anchored=True).renames().collect()}
    in_file = {}
    for r in c.select("file_id", "field_name").collect():
        in_file.setdefault(r["file_id"], set()).add(r["field_name"])
    of = {n: k for k, all_names in queries.unified_names(c, versions, permits).items() for n in all_names}
    apart = [p for p in found if not any(set(p) <= names for names in in_file.values())]
    assert apart and [p for p in apart if of[p[0]] != of[p[1]]] == []


def test_long_chains_of_renames_are_one_column(spark):
    n = 1200
    files = {1: [(f"f{i:04d}", "String") for i in range(n)]}
    c = catalog(spark, {i: [(f"f{i:04d}", "String"), ("id", "Float64")] for i in range(n)})
    renames = spark.createDataFrame([(i, f"f{i - 1:04d}", f"f{i:04d}") for i in range(1, n)], "file_id long, gone string, new string")
    got = D.canonical_names(c, renames)
    assert set(got) == {"f0000", "id"} and len(got["f0000"]) == n
    assert len(D.canonical_names(catalog(spark, files), renames)) == n  # all of them side by side in one file


def test_place_alone_is_a_stated_rename_but_no_likely_one(spark):
    files = {1: [("id", "Float64"), ("cost", "String"), ("z", "Float64")], 2: [("id", "Float64"), ("kind", "String"), ("z", "Float64")]}
    versions = spark.createDataFrame([(1, "s", 1), (2, "s", 2)], "file_id long, series string, seq int")
    drift = lambda anchored: D.Drift(catalog(spark, files), versions, anchored=anchored)
    assert [tuple(r)[1:] for r in drift(True).renames().collect()] == [("cost", "kind")] and drift(False).renames().count() == 0
    assert [tuple(r)[1:4] for r in drift(False).matched().collect()] == [("cost", "kind", True)]


def test_nesting(spark):
    from sparkseek.functions import variants as V

    deep = lambda *lines: V.levels(V.with_variant(spark.createDataFrame([(x,) for x in lines], "j string"), "j", "v"), "v")
    assert deep('{"a":1,"b":{"c":[{"d":"s"}]}}') == 2 and deep('{"x<y":null,"OBJECT<":1,"a`b{":2}') == 1 and deep(None, "[1]") == 1
    assert deep('{"a":"text"}', '{"a":{"b":1}}', '{"a":[{"b":{"c":1}}],"d":{"e":{"f":{"g":1}}}}', '{"a":{}}') == 4
