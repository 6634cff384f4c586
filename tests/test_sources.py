import json

import pytest
from pyspark.errors import PySparkException

from sparkseek.functions.types import FieldType as T
from sparkseek.plans.database import Database
from sparkseek.sources import csv as C
from sparkseek.sources.tail import complete_end, read_lines
from sparkseek.streaming.ingest import ingest, on_snapshot

GRAMS = {T.Unigram, T.Bigram, T.Trigram}


def make(tmp_path, text, name="a.jsonl", **options):
    p = tmp_path / name
    p.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(p)


def jdb(spark, tmp_path, text, **options):
    return Database.open(make(tmp_path, text), spark=spark, **options)


def offsets(df):
    return [(r["_offset"], r["_length"]) for r in df.collect()]


@pytest.mark.parametrize(
    "text, fields",
    [
        ('{"test":"test1"}\n', {"test": {T.String}}),
        ('{"test":"test1"}\n{"test":123}\n', {"test": {T.String, T.Float64}}),
        ('{"test":"test1"}\n{"test2":{"a":1,"b":"2"}}\n', {"test": {T.String}, "test2": {T.Object}, "test2.a": {T.Float64}, "test2.b": {T.String}}),
        ('{"test":"test1"}\n{"test":{"a":1,"b":"2"}}\n', {"test": {T.String, T.Object}, "test.a": {T.Float64}, "test.b": {T.String}}),
        ('{"test":"test1"}\n{"test2":[[1,2,3],4]}\n', {"test": {T.String}, "test2": {T.Array}}),
        ('{"test":"test1"}\n{"test":null}\n', {"test": {T.String, T.Null}}),
        ('{"nullheader":null}\n{"nullheader":null}\n', {"nullheader": {T.Null}}),
    ],
)
def test_fields_by_value(spark, tmp_path, text, fields):
    db = jdb(spark, tmp_path, text)
    assert {f: set(t) for f, t in db.fields().items()} == fields


def test_search_fields_have_grams(spark, tmp_path):
    db = jdb(spark, tmp_path, '{"test":"test1"}\n', search_fields=("test",))
    assert set(db.fields()["test"]) == {T.String} | GRAMS
    assert {r["field_type"]: (r["width"], r["entries"]) for r in db.index_meta().collect()} == {"String": (0, 1), "Unigram": (2, 5), "Bigram": (3, 4), "Trigram": (4, 3)}


def test_offsets_and_equality(spark, tmp_path):
    db = jdb(spark, tmp_path, '{"test":"test1"}\n{"test":"test3"}\n{"test":1234}\n{"test":1234}\n')
    assert offsets(db.where("test", "==", "test3").get()) == [(17, 16)]
    assert offsets(db.where("test", "==", 1234).get()) == [(34, 13), (48, 13)]
    assert offsets(db.where("test", "==", 1234).orderBy("test", "DESC").get()) == [(48, 13), (34, 13)]


def test_types_are_never_coerced(spark, tmp_path):
    db = jdb(spark, tmp_path, '{"a":"5"}\n{"a":true}\n{"a":5}\n{"a":{"b":5}}\n{"a":1.25}\n{"a":null}\n{"b":1}\n')
    assert [n for _, n in offsets(db.where("a", ">", 0).get())] == [10, 7]
    assert len(offsets(db.where("a", "==", "5").get())) == 1
    assert len(offsets(db.where("a", "==", True).get())) == 1
    assert len(offsets(db.where("a", "==", None).get())) == 1
    assert len(offsets(db.where("a.b", "==", 5).get())) == 1


def test_literal_and_nested_dots_and_projection(spark, tmp_path):
    db = jdb(spark, tmp_path, '{"a":{"b":1},"c":null}\n{"a.b":2}\n{"d":3}\n')
    rows = [json.loads(r["value"]) for r in db.builder().select(["a.b", "c"]).json().collect()]
    assert rows == [{"a.b": 1, "c": None}, {"a.b": 2}, {}]
    assert [json.loads(r["value"]) for r in db.query_json({}).collect()][2] == {"d": 3}


def test_duplicate_keys_last_wins_and_mixed_order(spark, tmp_path):
    db = jdb(spark, tmp_path, '{"a":1,"a":2}\n{"a":"x"}\n{"a":false}\n{"a":null}\n{"b":1}\n')
    assert len(offsets(db.where("a", "==", 2).get())) == 1
    assert [json.loads(r["value"]).get("a", "missing") for r in db.orderBy("a").json().collect()] == [None, False, 2, "x", "missing"]


def test_incomplete_last_line_is_held_back(spark, tmp_path):
    p = make(tmp_path, '{"a":1}\n{"a":2}')
    assert offsets(read_lines(spark, p)) == [(0, 7)]
    assert complete_end(p) == 8
    assert read_lines(spark, make(tmp_path, "", "empty.jsonl")).count() == 0


@pytest.mark.parametrize("split", [1, 3, 7, 1000])
def test_splits_read_each_line_once(spark, tmp_path, split):
    lines = [f'{{"n":{i},"t":"{"x" * (i % 9)}é"}}' for i in range(40)]
    p = make(tmp_path, "\n".join(lines) + "\n")
    rows = read_lines(spark, p, split=split).orderBy("_offset").collect() if split > 1 else read_lines(spark, p, split=31).orderBy("_offset").collect()
    assert [r["value"] for r in rows] == lines
    assert all(r["_length"] == len(r["value"].encode()) for r in rows)


def test_malformed_lines(spark, tmp_path):
    text = '{"a":1}\n[1]\n\nnope\n{"a":2}\n'
    with pytest.raises(PySparkException):
        jdb(spark, tmp_path, text).where("a", ">", 0).get().collect()
    db = jdb(spark, tmp_path, text, mode="permissive")
    assert len(offsets(db.where("a", ">", 0).get())) == 2
    assert db.df().where("_corrupt").count() == 3


def test_strict_search_field(spark, tmp_path):
    text = '{"a":"abc"}\n{"a":5}\n'
    db = jdb(spark, tmp_path, text, search_fields=("a",))
    assert db.search("a", "abc", 3, 3).count() == 1
    with pytest.raises(PySparkException):
        jdb(spark, tmp_path, text, search_fields=("a",), strict_search=True).search("a", "abc", 3, 3).collect()


CELLS = {
    "Null": [""],
    "Float64": ["1", "-7", "+3", "007", "1.5", "1e3", ".5", "5.", "NaN", "inf", "-Infinity", "0x1p-2", "9223372036854775808"],
    "Boolean": ["true", "TRUE", "True", "t", "T", "false", "FALSE", "False", "f", "F"],
    "String": ["TrUe", "yes", "no", "y", "n", " 1 ", "1d", "1f", "1e400", "0x10", "1_000", "12abc", "1.2.3", "e5"],
}


def test_cell_types(spark):
    rows = [(c, k) for k, cells in CELLS.items() for c in cells]
    df = spark.createDataFrame(rows, "c string, k string")
    wrong = [(r["c"], r["got"]) for r in df.select("c", "k", C.infer(df.c).alias("got")).collect() if r["got"] != r["k"]]
    assert wrong == []
    values = {r["c"]: r["v"] for r in df.select("c", C.number(df.c).alias("v")).collect()}
    assert values["0x1p-2"] == 0.25 and values["-Infinity"] == float("-inf") and values["007"] == 7.0


def test_csv_offsets_and_types(spark, tmp_path):
    db = Database.open(make(tmp_path, "test\ntest1\ntest2\n123\n", "a.csv"), spark=spark)
    assert set(db.fields()["test"]) == {T.String, T.Float64}
    assert offsets(db.where("test", "==", "test2").get()) == [(11, 5)]
    assert offsets(db.where("test", "==", 123).get()) == [(17, 3)]
    db = Database.open(make(tmp_path, "nullheader,header1\n,wef\n,howdy\n", "b.csv"), spark=spark)
    assert {f: set(t) for f, t in db.fields().items()} == {"nullheader": {T.Null}, "header1": {T.String}}


def test_csv_equals_jsonl(spark, tmp_path):
    a = Database.open(make(tmp_path, "h1,h2\ntest1,37.3\ntest3,4\n", "a.csv"), spark=spark)
    b = jdb(spark, tmp_path, '{"h1":"test1", "h2":37.3}\n{"h1":"test3", "h2":4}\n')
    assert {f: set(t) for f, t in a.fields().items()} == {f: set(t) for f, t in b.fields().items()}
    for q in ({"where": [{"key": "h2", "operation": ">", "value": 4}], "select": ["h1"]}, {"where": [{"key": "h1", "operation": "<", "value": "test3"}], "select": ["h1"]}):
        assert [json.loads(r["value"]) for r in a.query_json(q).collect()] == [json.loads(r["value"]) for r in b.query_json(q).collect()]


def test_csv_short_and_long_records(spark, tmp_path):
    text = 'a,b\n1\n1,2,3\n"x, y","say ""hi"""\n'
    with pytest.raises(PySparkException):
        Database.open(make(tmp_path, text, "a.csv"), spark=spark).query({"where": [{"key": "a", "operation": ">", "value": 0}]}).collect()
    db = Database.open(make(tmp_path, text, "a.csv"), spark=spark, mode="permissive")
    rows = db.df().orderBy("_offset").collect()
    assert [r["cells"] for r in rows] == [{"a": "1"}, None, {"a": "x, y", "b": 'say "hi"'}]


def test_ingest_in_steps_equals_one_shot(spark, tmp_path):
    p, parts = tmp_path / "grow.jsonl", [b'{"a":1}\n{"a":2}\n{"a"', b":3}\n", b"", b'{"b":"late field"}\n']
    for part in parts:
        with open(p, "ab") as f:
            f.write(part)
        ingest(spark, str(p), str(tmp_path / "table"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "table")).select("_offset", "_length", "value").orderBy("_offset").collect()
    assert got == read_lines(spark, str(p)).orderBy("_offset").collect() and len(got) == 4


def test_shortened_file_is_noticed(tmp_path):
    p = make(tmp_path, "a\nb\n")
    with pytest.raises(ValueError):
        complete_end(p, 100)


def test_snapshot_callback(spark, tmp_path):
    p, seen = make(tmp_path, '{"a":1}\n'), []
    on_snapshot(spark, p, str(tmp_path / "t"), str(tmp_path / "c"), lambda df: seen.append(df.count()), once=True).awaitTermination()
    assert seen == [1]


def test_schema_ddl_and_cli(spark, tmp_path, capsys):
    from sparkseek import cli

    db = jdb(spark, tmp_path, '{"a":1,"b":"x","c":[1],"d":null}\n')
    assert db.schema_ddl() == "`a` DOUBLE, `b` STRING, `c` VARIANT, `d` VOID"
    assert not db.is_empty() and db.entries() == 1 and set(db.field_names()) == {"a", "b", "c", "d"}
    p = make(tmp_path, '{"a":1}\n{"b":[2]}\n', "x.jsonl")
    assert cli.main(["-f", p]) == 0
    assert json.load(open(p[:-1])) == [{"a": 1}, {"b": [2]}]
