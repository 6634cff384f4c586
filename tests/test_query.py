import pytest

from sparkseek.functions.types import FieldType
from sparkseek.plans.database import Database
from sparkseek.plans.query import Query, QueryBuilder, QueryError, Search, Where, validate, validate_search

HEADERS = {"VendorID": [FieldType.String], "store_and_fwd_flag": [FieldType.Boolean], "fare_amount": [FieldType.Float64], "payment_type": [FieldType.Float64, FieldType.String]}
SEARCHABLE = {n: [FieldType.Unigram, FieldType.Bigram, FieldType.Trigram] for n in ("Pollo", "Bife", "Cerdo")}


def w(key, op, value):
    return {"where": [{"key": key, "operation": op, "value": value}]}


@pytest.mark.parametrize(
    "q",
    [
        w("VendorID", "==", ""),
        w("fare_amount", "<", 10) | {"orderBy": [{"key": "fare_amount", "direction": "ASC"}]},
        w("payment_type", ">=", 300) | {"orderBy": [{"key": "payment_type", "direction": "DESC"}], "select": ["payment_type", "fare_amount"]},
        w("store_and_fwd_flag", "==", False) | {"select": ["fare_amount", "payment_type"]},
        w("fare_amount", "<", 10) | {"orderBy": [{"key": "VendorID", "direction": "ASC"}]},
    ],
)
def test_accepted(q):
    validate(Query.of(q), HEADERS)


@pytest.mark.parametrize(
    "q",
    [
        w("vendorid", "==", ""),
        w("store_and_fwd_flag", "==", 10),
        w("payment_type", "<", False),
        w("VendorID", "==", None),
        w("fare_amount", "!=", 1),
        w("fare_amount", "<", [1]),
        w("fare_amount", "<", 1) | {"select": ["paymet_type"]},
        w("fare_amount", "<", 1) | {"select": []},
        w("fare_amount", "<", 1) | {"orderBy": [{"key": "unknown", "direction": "ASC"}]},
        w("fare_amount", "<", 1) | {"orderBy": [{"key": "fare_amount", "direction": "UP"}]},
        {"where": []},
        {"where": "x"},
        {"where": [{"key": "fare_amount", "operation": "<"}]},
        {"limit": -1},
        {"limit": True},
        {"groupBy": []},
    ],
)
def test_rejected(q):
    with pytest.raises(QueryError):
        validate(Query.of(q), HEADERS)


def test_search_validation():
    validate_search(Search("Pollo", "x"), SEARCHABLE)
    assert (Search("Pollo", "x").min_gram, Search("Pollo", "x").max_gram) == (1, 2)
    for bad in (Search("Atun", "x"), Search("Pollo", "x", 2, 1), Search("Pollo", "x", 0, 1), Search("Pollo", "x", 1, 4)):
        with pytest.raises(QueryError):
            validate_search(bad, SEARCHABLE)
    with pytest.raises(QueryError):
        validate_search(Search("VendorID", "x"), HEADERS)


def test_builder_is_immutable():
    q0 = QueryBuilder(None)
    q1 = q0.where("a", "<", 1)
    q2 = q1.orderBy("a", "DESC").select(["a"]).limit(3)
    assert q0.toQuery() == Query()
    assert q1.toQuery() == Query(where=(Where("a", "<", 1),))
    assert q2.toQuery().limit == 3 and q1.toQuery().limit is None
    assert q1.where("b", "==", 2).toQuery().where == (Where("a", "<", 1), Where("b", "==", 2))


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, float(v) if v is not None else None, s) for i, (v, s) in enumerate([(3, "b"), (1, "a"), (None, "c"), (3, "B"), (-2, None), (3, "é"), (-5, "")])]
    return Database.open(spark.createDataFrame(rows, "id long, v double, s string"), order=["id"])


def ids(df):
    return [r["id"] for r in df.collect()]


@pytest.mark.parametrize("value", [-5, -2, 0, 1, 3, 9])
def test_operations_partition_the_rows(table, value):
    parts = [ids(table.where("v", op, value).get()) for op in ("<", "==", ">")]
    assert sorted(sum(parts, [])) == [0, 1, 3, 4, 5, 6]
    assert sorted(ids(table.where("v", "<=", value).get())) == sorted(parts[0] + parts[1])
    assert sorted(ids(table.where("v", ">=", value).get())) == sorted(parts[1] + parts[2])


def test_desc_is_asc_reversed_with_ties(table):
    up = ids(table.where("v", ">=", -10).orderBy("v", "ASC").get())
    assert up == [6, 4, 1, 0, 3, 5]
    assert ids(table.where("v", ">=", -10).orderBy("v", "DESC").get()) == up[::-1]


def test_default_order_is_the_where_key(table):
    assert ids(table.where("v", "<", 5).get()) == [6, 4, 1, 0, 3, 5]
    assert sorted(ids(table.where("v", "<", 5).ordered(False).get())) == [0, 1, 3, 4, 5, 6]


def test_strings_compare_by_bytes(table):
    assert ids(table.where("s", ">=", "").orderBy("s").get()) == [6, 3, 1, 0, 2, 5]


def test_null_limit_and_select(table):
    assert ids(table.where("v", "==", None).get()) == [2]
    assert table.where("v", ">", 0).select(["s"]).limit(2).get().columns == ["s"]
    assert table.where("v", ">", 0).limit(0).get().count() == 0
    assert table.query({}).count() == 7


def test_number_order_of_bytes(table):
    q = {"where": [{"key": "v", "operation": "<", "value": 9}], "orderBy": [{"key": "v"}], "number_order": "bytes"}
    assert ids(table.query(q)) == [1, 0, 3, 5, 4, 6]


def test_topk_plan_has_no_full_sort(table):
    plan = table.where("v", ">", 0).orderBy("v").limit(3).get()._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


def test_filters_reach_the_scan(spark):
    import helpers

    db = Database.open(spark.read.parquet(f"{helpers.DATA}/lineitem.parquet"), order=["l_orderkey"])
    plan = db.where("l_quantity", ">=", 10).select(["l_orderkey"]).ordered(False).get()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan and "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
