"""Queries over the driver's tables for the engine's own operators: filters, orders, projections, search, vectors, catalog, ingest."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.types import FieldType
from sparkseek.operators import knn as K
from sparkseek.operators import search as S
from sparkseek.plans.database import Database
from sparkseek.sources import csv as C
from sparkseek.sources import jsonl as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            SQL[name or fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _db(spark: SparkSession, d: str, name: str, order: list[str], **options) -> Database:
    return Database.open(_table(spark, d, name), order=order, **options)


# filters: every operation in both directions

_LINE = ["l_orderkey", "l_linenumber"]
_LINE_COLS = [*_LINE, "l_quantity", "l_shipdate"]


def _where_lines(op: str):
    return lambda spark, d: _db(spark, d, "lineitem", _LINE).where("l_quantity", op, 25).select(_LINE_COLS).get()


for _name, _op, _sql in (("gt", ">", ">"), ("gte", ">=", ">="), ("eq", "==", "="), ("lte", "<=", "<="), ("lt", "<", "<")):
    _query(f"select {', '.join(_LINE_COLS)} from lineitem where l_quantity {_sql} 25", f"where_{_name}{'' if _name == 'eq' else '_asc'}")(_where_lines(_op))


def _topk_orders(op: str, value: float):
    return lambda spark, d: _db(spark, d, "orders", ["o_orderkey"]).where("o_totalprice", op, value).orderBy("o_totalprice", "DESC").select(["o_orderkey", "o_totalprice", "o_orderpriority"]).limit(50).get()


for _name, _op in (("gt", ">"), ("gte", ">="), ("lte", "<="), ("lt", "<")):
    _query(f"select o_orderkey, o_totalprice, o_orderpriority from orders where o_totalprice {_op} 150000 order by o_totalprice desc, o_orderkey desc limit 50", f"where_{_name}_desc_topk")(_topk_orders(_op, 150000))


@_query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem where l_quantity >= 10 order by l_quantity, l_orderkey, l_linenumber limit 20")
def where_gte_asc_topk(spark, d):
    return _db(spark, d, "lineitem", _LINE).where("l_quantity", ">=", 10).orderBy("l_quantity", "ASC").select(["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]).limit(20).get()


@_query("select c_custkey, c_name, c_mktsegment from customer where c_mktsegment = 'BUILDING'")
def where_string_eq(spark, d):
    return _db(spark, d, "customer", ["c_custkey"]).where("c_mktsegment", "==", "BUILDING").select(["c_custkey", "c_name", "c_mktsegment"]).get()


@_query("select p_partkey, p_name from part where p_name >= 'm'")
def where_string_range(spark, d):
    return _db(spark, d, "part", ["p_partkey"]).where("p_name", ">=", "m").select(["p_partkey", "p_name"]).get()


@_query("select event_id, user_id from events where strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') >= '2024-01-10'")
def where_iso_timestamp_range(spark, d):
    return _db(spark, d, "events", ["event_id"]).where("ts", ">=", "2024-01-10").select(["event_id", "user_id"]).get()


@_query("select p_partkey, p_size from part where p_size > 20.5")
def where_int_as_double(spark, d):
    return _db(spark, d, "part", ["p_partkey"]).where("p_size", ">", 20.5).select(["p_partkey", "p_size"]).get()


@_query("select c_custkey, c_acctbal from customer where c_acctbal < 0 order by c_acctbal, c_custkey limit 30")
def where_negative_numbers(spark, d):
    return _db(spark, d, "customer", ["c_custkey"]).where("c_acctbal", "<", 0).orderBy("c_acctbal").select(["c_custkey", "c_acctbal"]).limit(30).get()


@_query("select c_custkey, c_acctbal from customer where c_acctbal >= -500 order by c_acctbal < 0, abs(c_acctbal), c_custkey limit 40")
def byte_order_floats(spark, d):
    db = _db(spark, d, "customer", ["c_custkey"])
    return db.query({"where": [{"key": "c_acctbal", "operation": ">=", "value": -500}], "orderBy": [{"key": "c_acctbal", "direction": "ASC"}], "select": ["c_custkey", "c_acctbal"], "limit": 40, "number_order": "bytes"})


@_query("select l_orderkey, l_linenumber, l_discount from lineitem where l_quantity > 40 and l_discount <= 0.02 and l_returnflag = 'R'")
def where_and_two_fields(spark, d):
    return _db(spark, d, "lineitem", _LINE).where("l_quantity", ">", 40).where("l_discount", "<=", 0.02).where("l_returnflag", "==", "R").select([*_LINE, "l_discount"]).get()


@_query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity >= 10 and l_quantity < 12")
def where_and_same_field(spark, d):
    return _db(spark, d, "lineitem", _LINE).where("l_quantity", ">=", 10).where("l_quantity", "<", 12).select([*_LINE, "l_quantity"]).get()


@_query("select doc_id, source from documents where lang is null")
def where_null(spark, d):
    return _db(spark, d, "documents", ["doc_id"]).where("lang", "==", None).select(["doc_id", "source"]).get()


@_query("select file_id, rec_offset, vendor_id from trips where store_and_fwd_flag = true and trip_distance >= 15")
def where_boolean(spark, d):
    return _db(spark, d, "trips", ["file_id", "rec_offset", "revision", "arrived_at"]).where("store_and_fwd_flag", "==", True).where("trip_distance", ">=", 15).select(["file_id", "rec_offset", "vendor_id"]).get()


# order, limit, projection


@_query("select event_id, value from events order by value desc, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), event_id limit 20")
def order_multi_key_topk(spark, d):
    return _db(spark, d, "events", ["event_id"]).orderBy("value", "DESC").orderBy("ts", "ASC").select(["event_id", "value"]).limit(20).get()


@_query("select o_orderkey, o_orderstatus from orders")
def select_subset(spark, d):
    return _db(spark, d, "orders", ["o_orderkey"]).select(["o_orderkey", "o_orderstatus"]).get()


@_query("select * from nation")
def select_all(spark, d):
    return _db(spark, d, "nation", ["n_nationkey"]).query({})


@_query("select r_regionkey, r_name, row_number() over (order by r_regionkey desc) as n from region")
def paging_keyset(spark, d):
    """Pages of two by keyset: each page goes on after the last key of the one before."""
    db, pages, last, n = _db(spark, d, "region", ["r_regionkey"]), [], None, 0
    while True:
        q = db.builder() if last is None else db.where("r_regionkey", "<", last)
        page = q.orderBy("r_regionkey", "DESC").limit(2).get().collect()
        if not page:
            break
        pages += [(r["r_regionkey"], r["r_name"], n + i + 1) for i, r in enumerate(page)]
        last, n = page[-1]["r_regionkey"], n + len(page)
    return spark.createDataFrame(pages, "r_regionkey int, r_name string, n long")


# JSON: permits' lines and events' properties as VARIANT


def _permits(spark: SparkSession, d: str) -> Database:
    lines = _table(spark, d, "permits").select(F.col("rec_id").alias("_offset"), F.col("rec_length").alias("_length"), F.col("json_line").alias("value"), "arrived_at")
    return Database(J.JsonSource(J.bronze(lines, "permissive")))


def _events(spark: SparkSession, d: str) -> Database:
    lines = _table(spark, d, "events").select(F.col("event_id").alias("_offset"), F.length("props").alias("_length"), F.col("props").alias("value"))
    return Database(J.JsonSource(J.bronze(lines)))


@_query("select event_id, (props->>'$.k')::double k from events where (props->>'$.k')::double > 50")
def json_where_number(spark, d):
    db = _events(spark, d)
    rows = db.where("k", ">", 50).ordered(False).get()
    return rows.select(F.col("_offset").alias("event_id"), db.source.typed("k", FieldType.Float64).alias("k"))


@_query("select event_id, (props->>'$.k')::double k, event_type from events where (props->>'$.k')::double >= 50 and event_type <> 'view'")
def json_select_nested(spark, d):
    """Events wrapped two levels deep, addressed by dotted fields."""
    nested = F.concat(F.lit('{"event":{"type":'), F.to_json(F.struct("event_type")), F.lit(',"props":'), F.col("props"), F.lit("}}"))
    lines = _table(spark, d, "events").select(F.col("event_id").alias("_offset"), F.length(nested).alias("_length"), nested.alias("value"))
    db = Database(J.JsonSource(J.bronze(lines)))
    kind = db.source.typed("event.type.event_type", FieldType.String)
    rows = db.where("event.props.k", ">=", 50).ordered(False).get().where(kind != "view")
    return rows.select(F.col("_offset").alias("event_id"), db.source.typed("event.props.k", FieldType.Float64).alias("k"), kind.alias("event_type"))


@_query("select 'a.b.c.d.e.k' as field, count(*) n, round(sum((props->>'$.k')::double), 6) total from events where (props->>'$.k')::double >= 50")
def json_where_deep(spark, d):
    """Events' properties wrapped six levels deep: the catalog names the field, and where reaches it."""
    wrapped = F.concat(F.lit('{"a":{"b":{"c":{"d":{"e":'), F.col("props"), F.lit("}}}}}"))
    db = Database(J.JsonSource(J.bronze(_table(spark, d, "events").select(F.col("event_id").alias("_offset"), F.length(wrapped).alias("_length"), wrapped.alias("value")))))
    field = max(db.field_names(), key=lambda f: f.count("."))
    rows = db.where(field, ">=", 50).ordered(False).get()
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(db.source.typed(field, FieldType.Float64)), 6).alias("total")).withColumn("field", F.lit(field))


@_query("select json_type(json_line, '$.parcel') is null missing, coalesce(json_type(json_line, '$.parcel') = 'NULL', false) is_null, count(*) n from permits group by all")
def json_null_vs_missing(spark, d):
    db = _permits(spark, d)
    return db.df().groupBy(db.source.at("parcel").isNull().alias("missing"), db.source.typed("parcel", FieldType.Null).alias("is_null")).agg(F.count("*").alias("n"))


_SQL_TYPE = "case when {t} = 'VARCHAR' then 'String' when {t} in ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') then 'Float64' when {t} = 'BOOLEAN' then 'Boolean' when {t} = 'NULL' then 'Null' when {t} = 'OBJECT' then 'Object' when {t} = 'ARRAY' then 'Array' end"


@_query(f"select {_SQL_TYPE.format(t='t')} as type, count(*) n from (select json_type(json_line, '$.inspector') t from permits) where t is not null group by 1")
def json_mixed_types(spark, d):
    from sparkseek.functions.variants import type_name

    db = _permits(spark, d)
    return db.df().select(type_name(db.source.at("inspector")).alias("type")).where("type is not null").groupBy("type").agg(F.count("*").alias("n"))


@_query(
    f"""with k as (select json_line j, unnest(json_keys(json_line)) k from permits),
    t as (select k field, json_extract(j, '$."' || k || '"') v, json_type(j, '$."' || k || '"') t from k),
    n as (select field || '.' || x field, json_type(v, '$."' || x || '"') t from (select field, v, unnest(json_keys(v)) x from t where t = 'OBJECT'))
    select field, {_SQL_TYPE.format(t='t')} as type, count(*) entries from (select field, t from t union all select field, t from n) group by all"""
)
def catalog_fields(spark, d):
    return _permits(spark, d).source.field_rows().select("field", "type", "entries")


@_query(
    "select * from (select 'o_orderkey' field_name, 'Float64' field_type, 9 width, count(o_orderkey) entries from orders union all select 'o_custkey', 'Float64', 9, count(o_custkey) from orders union all select 'o_orderstatus', 'String', 0, count(o_orderstatus) from orders "
    "union all select 'o_totalprice', 'Float64', 9, count(o_totalprice) from orders union all select 'o_orderdate', 'String', 0, count(o_orderdate) from orders union all select 'o_orderpriority', 'String', 0, count(o_orderpriority) from orders)"
)
def catalog_index_meta(spark, d):
    return _db(spark, d, "orders", ["o_orderkey"]).index_meta().select("field_name", "field_type", F.col("width"), "entries")


@_query("select count(*) entries, sum(length(json_line)) total_length from permits")
def catalog_file_meta(spark, d):
    db = _permits(spark, d)
    return db.df().agg(F.count("*").alias("entries"), F.sum(F.length("value")).alias("total_length"))


@_query("select rec_id, json_object('permitNumber', json_extract(json_line, '$.permitNumber'), 'zone', json_extract(json_line, '$.zone'))::varchar as \"value\" from permits where json_type(json_line, '$.permitNumber') is not null and json_type(json_line, '$.zone') is not null")
def json_select_text(spark, d):
    db = _permits(spark, d)
    rows = db.df().where(db.source.at("permitNumber").isNotNull() & db.source.at("zone").isNotNull())
    return rows.select(F.col("_offset").alias("rec_id"), db.source.json(["permitNumber", "zone"]).alias("value"))


# CSV

_CELL_TYPE = r"""case when c = '' then 'Null' when regexp_full_match(c, '[+-]?[0-9]+') or (regexp_full_match(c, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and abs(try_cast(c as double)) < 1e309) then 'Float64'
 when c in ('t', 'T', 'TRUE', 'true', 'True', 'f', 'F', 'FALSE', 'false', 'False') then 'Boolean' else 'String' end"""


@_query(f"select c cell, {_CELL_TYPE} as type, count(*) n from (select payment_type c from trips union all select store_and_fwd_flag::varchar from trips union all select passenger_count::varchar from trips) where c is not null group by all")
def csv_infer(spark, d):
    trips = _table(spark, d, "trips")
    cells = trips.select(F.explode(F.array("payment_type", F.col("store_and_fwd_flag").cast("string"), F.col("passenger_count").cast("string"))).alias("cell")).where("cell is not null")
    return cells.groupBy("cell").agg(F.count("*").alias("n")).select("cell", C.infer(F.col("cell")).alias("type"), "n")


@_query("select count(*) n, sum(trip_distance) total from trips where trip_distance >= 10")
def csv_where(spark, d):
    """Trips written as CSV text and queried as such: cells keep their own types."""
    trips = _table(spark, d, "trips").where("trip_distance is not null")
    header = ["vendor_id", "trip_distance", "store_and_fwd_flag"]
    line = F.concat_ws(",", F.coalesce("vendor_id", F.lit("")), F.col("trip_distance").cast("string"), F.coalesce(F.col("store_and_fwd_flag").cast("string"), F.lit("")))
    lines = trips.select(F.col("rec_offset") + 1, line.alias("value")).toDF("_offset", "value").withColumn("_length", F.length("value"))
    db = Database(C.CsvSource(C.bronze(lines, header), header))
    rows = db.where("trip_distance", ">=", 10).ordered(False).get()
    return rows.agg(F.count("*").alias("n"), F.round(F.sum(db.source.typed("trip_distance", FieldType.Float64)), 6).alias("total"))


SQL["csv_where"] = "select count(*) n, round(sum(trip_distance), 6) total from trips where trip_distance >= 10"


def _file(spark: SparkSession, *lines: DataFrame) -> str:
    """The lines (one column each, in this order) as one text file in the shared folder, written by one task: a file is what these queries open."""
    from sparkseek.runtime import fresh_path, hadoop_path

    path, rows = fresh_path(spark, "file"), lines[0]
    for more in lines[1:]:
        rows = rows.union(more)
    rows.coalesce(1).write.text(path)
    fs, folder = hadoop_path(spark, path)
    return next(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))


@_query("select file_id, vendor_id, count(*) n, round(sum(trip_distance), 6) total from trips where trip_distance >= 10 and store_and_fwd_flag group by all")
def csv_file_where(spark, d):
    """Trips as a CSV file, opened and queried: cells keep their own types, empty ones are no numbers."""
    from sparkseek.sources.export import csv_lines

    header = ["file_id", "vendor_id", "trip_distance", "store_and_fwd_flag"]
    path = _file(spark, spark.createDataFrame([(",".join(header),)], "value string"), csv_lines(_table(spark, d, "trips").select(header)))
    db = Database.open(path, spark, format="csv")
    rows = db.where("trip_distance", ">=", 10).where("store_and_fwd_flag", "==", True).ordered(False).get()
    number = lambda f: db.source.typed(f, FieldType.Float64)
    vendor = F.nullif(db.source.cell("vendor_id"), F.lit(""))
    return rows.groupBy(number("file_id").cast("long").alias("file_id"), vendor.alias("vendor_id")).agg(F.count("*").alias("n"), F.round(F.sum(number("trip_distance")), 6).alias("total"))


# stored tables: read once, then filtered by typed columns and searched by postings


def _stored(spark: SparkSession, lines: DataFrame, **options) -> Database:
    from sparkseek.runtime import fresh_path
    from sparkseek.sources import store

    path = fresh_path(spark, "stored")
    store.sync(spark, _file(spark, lines), path, **options)
    return Database.open(path, spark)


@_query("select event_id, value, event_type from events where value >= 20 and event_type = 'view'")
def stored_where(spark, d):
    db = _stored(spark, _table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", "value"))), sort_by="value")
    rows = db.where("value", ">=", 20).where("event_type", "==", "view").ordered(False).get()
    number = lambda f: db.source.typed(f, FieldType.Float64)
    return rows.select(number("event_id").cast("long").alias("event_id"), number("value").alias("value"), db.source.typed("event_type", FieldType.String).alias("event_type"))


@_query("select 1 as version, 'jsonl' as format, count(*) entries, sum(strlen(json_line))::bigint + count(*) read_offset from permits")
def stored_metadata(spark, d):
    """Version, format, entries and read offset of a stored table."""
    db = _stored(spark, _table(spark, d, "permits").where("json_line is not null").select("json_line"), mode="permissive")
    return spark.createDataFrame([db.metadata()], "version int, format string, entries long, read_offset long")


@_query(SQL["catalog_fields"])
def stored_catalog(spark, d):
    """The catalog of a stored table, without a look at its records."""
    db = _stored(spark, _table(spark, d, "permits").where("json_line is not null").select("json_line"), mode="permissive")
    return db.source.field_rows().select("field", "type", "entries")


@_query(
    "select 'o_orderkey' field_name, sum(length(o_orderkey::varchar))::bigint total_field_value_length from orders union all select 'o_custkey', sum(length(o_custkey::varchar))::bigint from orders "
    "union all select 'o_orderstatus', sum(length(o_orderstatus) + 2)::bigint from orders union all select 'o_orderpriority', sum(length(o_orderpriority) + 2)::bigint from orders"
)
def catalog_total_length(spark, d):
    """Total lengths of field values, strings with their quotes."""
    rows = _db(spark, d, "orders", ["o_orderkey"]).index_meta()
    return rows.where(F.col("field_name").isin("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")).select("field_name", "total_field_value_length")


@_query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey desc) as n from orders qualify n <= 250")
def paging_pull(spark, d):
    """Five pages of fifty, pulled one after another."""
    pages = _db(spark, d, "orders", ["o_orderkey"]).orderBy("o_totalprice", "DESC").select(["o_orderkey"]).limit(250).pull(50)
    rows = [(r["o_orderkey"], p * 50 + i + 1) for p, page in enumerate(pages) for i, r in enumerate(page)]
    return spark.createDataFrame(rows, "o_orderkey long, n long")


# n-grams and search

_WORDS = r"string_split(trim(regexp_replace(lower(regexp_replace(text, '[^a-zA-Z0-9 \t\n\r]', '', 'g')), '[ \t\n\r]+', ' ', 'g')), ' ')"


def _sql_grams(n: int, key: str = "doc_id") -> str:
    return f"select {key} doc, w[i:i+{n - 1}] gram from (select {key}, w, unnest(range(1, length(w) - {n - 2})) i from (select {key}, unnest({_WORDS}) w from documents) where length(w) >= {n})"


def _grams(n: int):
    return lambda spark, d: S.postings(_table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), n).withColumnRenamed("doc", "doc_id")


for _n in (1, 2, 3):
    _query(f"select doc doc_id, gram, count(*) tf from ({_sql_grams(_n)}) group by all", f"ngram_tokens_{_n}")(_grams(_n))


@_query(f"select gram, count(distinct doc) df from ({_sql_grams(3)}) group by 1")
def ngram_df(spark, d):
    return S.document_frequency(S.postings(_table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), 3))


@_query(f"select doc doc_id, count(*) tf from ({_sql_grams(3)}) where gram = 'qua' group by 1")
def postings_term_lookup(spark, d):
    return S.postings(_table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text"), 3, only=["qua"]).select(F.col("doc").alias("doc_id"), "tf")


def _sql_search(like: str, low: int, high: int, where: str = "true", top: int | None = 20) -> str:
    weights = S.query_grams(like, low, high)
    q = ", ".join(f"('{g}', {c})" for g, c in weights.items())
    grams = " union all ".join(f"({_sql_grams(n)})" for n in range(low, high + 1))
    limit = f"order by score desc, doc_id limit {top}" if top else ""
    return f"""with q(gram, qtf) as (values {q}), tf as (select doc, gram, count(*)::double tf from ({grams}) where gram in (select gram from q) group by all),
    df as (select gram, count(*)::double df from tf group by 1), n as (select count(*)::double n from documents)
    select doc doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2)), 6) score from tf join df using (gram) join q using (gram), n
    where doc in (select doc_id from documents where {where}) group by 1 {limit}"""


def _search(spark, d, like: str, low: int, high: int, where: list | None = None, limit: int | None = 20) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text", "lang", "rating")
    found = Database.open(docs, order=["doc_id"], search_fields=("text",)).query({"search": {"key": "text", "like": like, "config": {"minGram": low, "maxGram": high}}, "where": where, "limit": limit})
    return found.select(F.get_json_object("data", "$.doc_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))


@_query(_sql_search("sturdy handle", 3, 3))
def search_trigram_topk(spark, d):
    return _search(spark, d, "sturdy handle", 3, 3)


@_query(_sql_search("kettle lid", 1, 2))
def search_12gram_topk(spark, d):
    return _search(spark, d, "kettle lid", 1, 2)


@_query(_sql_search("weather", 3, 3, top=None))
def search_all(spark, d):
    return _search(spark, d, "weather", 3, 3, limit=None)


@_query(_sql_search("battery", 3, 3, "rating >= 4 and lang = 'en'"))
def search_then_where(spark, d):
    return _search(spark, d, "battery", 3, 3, [{"key": "rating", "operation": ">=", "value": 4}, {"key": "lang", "operation": "==", "value": "en"}])


@_query(_sql_search("battery", 3, 3, top=None))
def search_stored_postings(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    found = S.search_postings(S.postings(docs, 3), docs.count(), "battery", 3, 3)
    return found.select(F.col("doc").alias("doc_id"), F.round("score", 6).alias("score"))


@_query(_sql_search("battery", 3, 3, "rating >= 4 and lang = 'en'"))
def stored_search(spark, d):
    """Search of a stored table: the postings of the query's grams are read, no text is."""
    db = _stored(spark, _table(spark, d, "documents").select(F.to_json(F.struct("doc_id", "text", "lang", "rating"))), search_fields=("text",))
    found = db.query({"search": {"key": "text", "like": "battery", "config": {"minGram": 3, "maxGram": 3}}, "where": [{"key": "rating", "operation": ">=", "value": 4}, {"key": "lang", "operation": "==", "value": "en"}]})
    best = found.select(F.get_json_object("data", "$.doc_id").cast("long").alias("doc_id"), F.round("score", 6).alias("score"))
    return best.orderBy(F.col("score").desc(), "doc_id").limit(20)  # ties of the file order go by doc_id here


# vectors

_QUERY_VECTOR = "(select embedding::double[] from embeddings where vec_id = 0)"


def _vector(spark: SparkSession, d: str, vec_id: int = 0) -> list[float]:
    return _table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


@_query(f"select vec_id, round(list_distance(embedding::double[], {_QUERY_VECTOR}), 6) dist from embeddings")
def l2_distance(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", F.round(K.l2(F.col("embedding"), K.literal_vector(_vector(spark, d))), 6).alias("dist"))


@_query(f"select vec_id, round(list_distance(embedding::double[], {_QUERY_VECTOR}), 6) dist from embeddings order by list_distance(embedding::double[], {_QUERY_VECTOR}), vec_id limit 10")
def knn_exact_topk(spark, d):
    return K.knn(_table(spark, d, "embeddings"), _vector(spark, d), 10).select("vec_id", F.round("dist", 6).alias("dist"))


@_query("select q.vec_id query_id, e.vec_id, round(list_distance(e.embedding::double[], q.embedding::double[]), 6) dist, row_number() over (partition by q.vec_id order by list_distance(e.embedding::double[], q.embedding::double[]), e.vec_id)::int rank from embeddings e, (select * from embeddings where vec_id % 50 = 0) q qualify rank <= 5")
def knn_batch_join(spark, d):
    e = _table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return K.knn_batch(e, queries, 5).withColumn("dist", F.round("dist", 6))


@_query("select vec_id, embedding from embeddings where vec_id = 42")
def vector_point_lookup(spark, d):
    return _table(spark, d, "embeddings").where("vec_id = 42").select("vec_id", "embedding")


@_query()
def knn_lsh(spark, d):
    return K.knn_lsh(_table(spark, d, "embeddings"), _vector(spark, d), 10)


@_query()
def knn_hnsw(spark, d):
    """Approximate neighbours of the vectors whose id is divisible by 50, from small-world graphs."""
    from sparkseek.operators import hnsw
    from sparkseek.runtime import fresh_path

    e, path = _table(spark, d, "embeddings"), fresh_path(spark, "hnsw")
    hnsw.build(e, path, 64)
    return hnsw.search(spark.read.parquet(path), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 5)


def _reached(found: DataFrame, true: DataFrame) -> DataFrame:
    return K.recall(found, true).select("queries", (F.col("recall") >= 0.9).alias("reached"))


@_query("select count(*) queries, true as reached from embeddings where vec_id % 50 = 0 and embedding is not null")
def knn_hnsw_recall(spark, d):
    """Whether the graphs' recall, against exact search, is at least 0.9."""
    e = _table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return _reached(knn_hnsw(spark, d).withColumnRenamed("id", "vec_id"), K.knn_batch(e, queries, 5))


@_query("select 1::bigint queries, true as reached")
def knn_lsh_recall(spark, d):
    """Whether the hashed search finds at least 0.9 of the ten nearest to the first vector."""
    e, q = _table(spark, d, "embeddings"), F.lit(0).cast("long").alias("query_id")
    return _reached(knn_lsh(spark, d).select(q, "vec_id"), K.knn(e, _vector(spark, d), 10).select(q, "vec_id"))


@_query("select count(*) as vectors, true as found from embeddings where embedding is not null")
def vector_store_append(spark, d):
    """Vectors appended to a stored index in three steps, then looked up: how many it has, and whether each of a set of queries finds itself first."""
    from sparkseek.operators import hnsw
    from sparkseek.runtime import fresh_path

    e = _table(spark, d, "embeddings")
    store = hnsw.VectorStore(spark, fresh_path(spark, "vectors"), 64)
    for step in range(3):
        store.append(e.where(F.pmod(F.xxhash64("vec_id"), F.lit(3)) == step))
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    first = store.search(queries, 1).agg((F.avg((F.col("dist") < 1e-6).cast("double")) >= 0.9).alias("found"))
    return first.select(F.lit(sum(n for _, n in store.shards().values())).cast("long").alias("vectors"), "found")


@_query("select r_regionkey || ',' || case when r_name like '%,%' then '\"' || r_name || '\"' else r_name end as \"value\" from region")
def export_csv(spark, d):
    from sparkseek.sources.export import csv_lines

    return csv_lines(_table(spark, d, "region").select("r_regionkey", "r_name"))


@_query("select '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' as \"value\" from nation")
def export_jsonl(spark, d):
    from sparkseek.sources.export import json_lines

    return json_lines(_table(spark, d, "nation").select("n_nationkey", "n_name"))


# incremental ingest


@_query("select count(*) records, count(distinct event_id) distinct_records, min(event_id) first, max(event_id) last, 0::bigint wrong from events")
def incremental_equals_batch(spark, d):
    """Events as a JSONL file that grows in three steps, a record cut in two between them: streamed in, then compared with one-shot reading."""
    from sparkseek.runtime import fresh_path, local_path
    from sparkseek.sources.tail import read_lines
    from sparkseek.streaming.ingest import ingest

    folder = local_path(spark, fresh_path(spark, "ingest"))
    if folder is None:
        raise ValueError("a file that grows needs a shared folder with appends")
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/events.jsonl"
    lines = _table(spark, d, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value")).orderBy("event_id")
    with open(path, "wb") as f:
        for r in lines.toLocalIterator(prefetchPartitions=True):
            f.write((r["value"] + "\n").encode())
    whole = os.path.getsize(path)
    grown = f"{folder}/grown.jsonl"
    with open(path, "rb") as src:
        for share in (0.3, 0.7, 1.0):
            with open(grown, "ab") as f:
                while f.tell() < int(whole * share) and (part := src.read(min(1 << 20, int(whole * share) - f.tell()))):
                    f.write(part)
            ingest(spark, grown, f"{folder}/table", f"{folder}/checkpoint")
    got, want = spark.read.parquet(f"{folder}/table"), read_lines(spark, path)
    wrong = want.join(got, ["_offset", "_length", "value"], "left_anti").agg(F.count("*").alias("wrong"))
    key = F.get_json_object("value", "$.event_id").cast("long")
    return got.agg(F.count("*").alias("records"), F.count_distinct(key).alias("distinct_records"), F.min(key).alias("first"), F.max(key).alias("last")).crossJoin(F.broadcast(wrong))  # two single rows

