import json

import pytest
from pyspark.sql import functions as F

import sparkseek
from sparkseek import cli
from sparkseek.functions.types import FieldType as T
from sparkseek.sources import store

LINES = [
    {"id": 1, "a": {"b": {"c": {"d": {"e": {"f": 5}}}}}, "t": "heat pump"},
    {"id": 2, "a": None, "t": "pump house", "x.y": True},
    {"id": 3, "t": 7, "a": "text"},
    {"id": 4, "t": "Heat, heat"},
]


def grow(path, rows, tail=""):
    with open(path, "a") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
        f.write(tail)


@pytest.fixture
def files(tmp_path):
    return str(tmp_path / "data.jsonl"), f"file://{tmp_path}/table"


def offsets(df):
    return [r["_offset"] for r in df.collect()]


def test_sync_equals_reading_the_file(spark, files):
    data, table = files
    grow(data, LINES[:2], json.dumps(LINES[2])[:9])
    first = store.sync(spark, data, table, search_fields=("t",))
    assert first["entries"] == 2 and store.sync(spark, data, table) == first  # nothing new, an open line held back
    grow(data, [], json.dumps(LINES[2])[9:] + "\n")
    grow(data, LINES[3:])
    state = store.sync(spark, data, table)
    assert (state["number"], state["entries"], len(state["parts"])) == (2, 4, 2)
    db, plain = sparkseek.open(table, spark), sparkseek.open(data, spark, search_fields=("t",))
    assert {f: set(t) for f, t in db.fields().items()} == {f: set(t) for f, t in plain.fields().items()} and list(db.fields()) == list(plain.fields())
    assert T.Float64 in db.fields()["a.b.c.d.e.f"]
    assert db.metadata() == {"version": 1, "format": "jsonl", "entries": 4, "read_offset": sum(len(json.dumps(r)) + 1 for r in LINES)}
    for w in (("id", ">=", 2), ("t", "==", "heat pump"), ("t", "<", 8), ("a", "==", None), ("x.y", "==", True), ("a.b.c.d.e.f", ">", 4), ("a", "==", "text")):
        assert offsets(db.where(*w).get()) == offsets(plain.where(*w).get()) != []
    assert [r["value"] for r in db.where("id", ">", 1).select(["t", "a"]).json().collect()] == [r["value"] for r in plain.where("id", ">", 1).select(["t", "a"]).json().collect()]
    hits = lambda d: [(json.loads(r["data"])["id"], round(r["score"], 9)) for r in d.search("t", "heat pump", 1, 3).collect()]
    assert hits(db) == hits(plain) != []
    index = lambda d: {(r["field_name"], r["field_type"], r["entries"], r["total_field_value_length"]) for r in d.index_meta().collect()}
    assert index(db) == index(plain)


def test_filters_prune_and_searches_read_no_text(spark, files):
    data, table = files
    grow(data, [{"n": i, "s": f"word{i % 7}"} for i in range(200)])
    store.sync(spark, data, table, search_fields=("s",), sort_by="n")
    db = sparkseek.open(table, spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    number = store.column(db.source.state, "n", T.Float64)
    p = plan(db.where("n", ">", 150).ordered(False).select(["n"]).get())
    assert f"PushedFilters: [IsNotNull({number}), GreaterThan({number},150.0)]" in p
    p = plan(db.source.postings("s").where(F.col("gram").isin("wor", "ord")))
    assert "In(gram, [ord,wor])" in p or "In(gram, [wor,ord])" in p
    assert sorted(r["n"] for r in db.where("n", ">", 195).get().select(db.source.typed("n", T.Float64).alias("n")).collect()) == [196.0, 197.0, 198.0, 199.0]


def test_version_format_and_definition_are_checked(spark, files, tmp_path):
    data, table = files
    grow(data, LINES)
    store.sync(spark, data, table, search_fields=("t",))
    for wrong in (lambda: sparkseek.open(table, spark, format="csv"), lambda: store.sync(spark, data, table, "csv"), lambda: store.sync(spark, data, table, search_fields=("a",)), lambda: store.load(spark, f"{table}x"), lambda: store.sync(spark, data, f"{table}y", "xml")):
        with pytest.raises(store.FormatError):
            wrong()
    commits = tmp_path / "table" / "commits"
    (commits / "2").write_text(json.dumps(json.loads((commits / "1").read_text()) | {"version": 9}))
    with pytest.raises(store.FormatError, match="version 9"):
        sparkseek.open(table, spark)


def test_cut_files_and_malformed_lines_leave_the_table(spark, files):
    data, table = files
    grow(data, LINES)
    store.sync(spark, data, table)
    grow(data, [], "[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        store.sync(spark, data, table)
    assert sparkseek.open(table, spark).entries() == 4
    assert store.sync(spark, data, table, mode="permissive")["entries"] == 5
    with open(data, "w") as f:
        f.write("{}\n")
    with pytest.raises(ValueError, match="cut or replaced"):
        store.sync(spark, data, table)


def test_csv_table(spark, tmp_path):
    data, table = str(tmp_path / "d.csv"), f"file://{tmp_path}/t"
    with open(data, "w") as f:
        f.write("b,a,b2\n1,x,\n2.5,TRUE,nul\n")
    store.sync(spark, data, table, "csv")
    with open(data, "a") as f:
        f.write('3,"q, r",7\n')
    store.sync(spark, data, table, "csv")
    db, plain = sparkseek.open(table, spark), sparkseek.open(data, spark)
    assert set(db.fields()) == set(plain.fields()) and list(plain.fields()) == ["b", "a", "b2"]
    for w in (("b", ">=", 2), ("a", "==", True), ("a", "==", "q, r"), ("b2", "==", None)):
        assert offsets(db.where(*w).get()) == offsets(plain.where(*w).get()) != []


def test_invalid_utf8(spark, tmp_path):
    data = str(tmp_path / "bad.jsonl")
    with open(data, "wb") as f:
        f.write(b'{"a":"x"}\n{"a":"\xff"}\n')
    with pytest.raises(Exception, match="not UTF-8 in the line at byte 10"):
        sparkseek.open(data, spark).fields()
    assert [r["value"] for r in sparkseek.open(data, spark, mode="permissive").select(["a"]).json().collect()] == ['{"a":"x"}', '{"a":"\ufffd"}']


def test_cli_keeps_a_table(spark, files, tmp_path, capsys):
    data, table = files
    grow(data, LINES)
    assert cli.main(["-jsonl", "-i", table, "-s", "t", "-t", "-b", str(tmp_path / "trace"), "-pprof", str(tmp_path / "profile"), data]) == 0
    assert "t String, Float64, Trigram, Bigram, Unigram" in capsys.readouterr().out
    assert json.loads((tmp_path / "trace").read_text())["entries"] == 4 and (tmp_path / "profile").stat().st_size > 0
    assert sparkseek.open(table, spark).entries() == 4


def test_pages_are_pulled(spark):
    db = sparkseek.open(spark.range(25).toDF("n"), order=["n"])
    pages = db.where("n", ">=", 2).orderBy("n", "DESC").pull(10)
    assert [[r["n"] for r in p] for p in pages] == [list(range(24, 14, -1)), list(range(14, 4, -1)), [4, 3, 2]]


def test_times_are_pruned_like_text(spark):
    rows = [(i, f"2024-01-{d:02d} {h:02d}:30:00") for i, (d, h) in enumerate([(9, 23), (10, 0), (10, 12), (11, 0)])]
    df = spark.createDataFrame(rows, "id int, s string").selectExpr("id", "cast(s as timestamp_ntz) t", "cast(s as timestamp) z", "cast(s as date) d")
    db = sparkseek.open(df, order=["id"])
    text = {"t": [r["s"] for r in df.selectExpr("date_format(t, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") s").collect()], "d": [r["s"] for r in df.selectExpr("cast(d as string) s").collect()]}
    text["z"] = text["t"]
    import operator as o

    for field in "tzd":
        for value in ("2024-01-10", "2024", "2024-01-1", "2024-01-10T12", "2024-01-10T12:30:00.000000", "2024-01-10T12:30:00.0", "x", "", "2024-13-01", "2024-01-10 12", "2024-02-30"):
            for op, f in ((">", o.gt), (">=", o.ge), ("<", o.lt), ("<=", o.le), ("==", o.eq)):
                got = {r["id"] for r in db.where(field, op, value).get().collect()}
                assert got == {i for i, s in enumerate(text[field]) if f(s, value)}, (field, op, value)
    plan = db.where("t", ">=", "2024-01-10").ordered(False).get()._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" not in plan
