"""Queries that show what else the engine promises: checks of queries, mixed types, text normal forms, growth, snapshots, graph structure."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.text import nfkd_ascii
from sparkseek.functions.types import FieldType
from sparkseek.operators import hnsw
from sparkseek.operators import knn as K
from sparkseek.plans.database import Database
from sparkseek.plans.query import QueryError
from sparkseek.queries.reference import SQL as REFERENCE_SQL
from sparkseek.queries.reference import _file, _permits, _table
from sparkseek.runtime import fresh_path, local_path
from sparkseek.sources import store
from sparkseek.streaming.ingest import on_snapshot

_CHECKS = [
    ("known field", {"where": [{"key": "fare_amount", "operation": ">", "value": 1}]}, True),
    ("unknown field", {"where": [{"key": "fare", "operation": ">", "value": 1}]}, False),
    ("unknown operation", {"where": [{"key": "fare_amount", "operation": "!=", "value": 1}]}, False),
    ("type without values", {"where": [{"key": "fare_amount", "operation": ">", "value": "1"}]}, False),
    ("null where nulls are", {"where": [{"key": "fare_amount", "operation": "==", "value": None}]}, True),
    ("no value", {"where": [{"key": "fare_amount", "operation": ">"}]}, False),
    ("empty where", {"where": []}, False),
    ("empty select", {"select": []}, False),
    ("unknown select", {"select": ["fare_amount", "fare"]}, False),
    ("known select", {"select": ["vendor_id", "fare_amount"]}, True),
    ("unknown order", {"orderBy": [{"key": "fare", "direction": "ASC"}]}, False),
    ("unknown direction", {"orderBy": [{"key": "fare_amount", "direction": "UP"}]}, False),
    ("negative limit", {"limit": -1}, False),
    ("search field", {"search": {"key": "payment_type", "like": "cash"}}, True),
    ("no search field", {"search": {"key": "vendor_id", "like": "cash"}}, False),
    ("gram lengths upside down", {"search": {"key": "payment_type", "like": "cash", "config": {"minGram": 3, "maxGram": 2}}}, False),
    ("gram length 4", {"search": {"key": "payment_type", "like": "cash", "config": {"minGram": 1, "maxGram": 4}}}, False),
]


def query_checks(spark: SparkSession, d: str) -> DataFrame:
    """Which queries a table accepts."""
    db = Database.open(_table(spark, d, "trips"), order=["file_id", "rec_offset"], search_fields=("payment_type",))

    def accepted(q: dict) -> bool:
        try:
            db.query(q)
        except QueryError:
            return False
        return True

    return spark.createDataFrame([(name, accepted(q)) for name, q, _ in _CHECKS], "query string, accepted boolean")


def order_mixed_types(spark: SparkSession, d: str) -> DataFrame:
    """A field with values of several types, in order: null, booleans, numbers, strings."""
    db = _permits(spark, d)
    rows = db.orderBy("inspector").limit(200).get()
    return rows.select(F.col("_offset").alias("rec_id"), db.source.typed("inspector", FieldType.Float64).alias("number"), db.source.typed("inspector", FieldType.String).alias("text"))


def nfkd_texts(spark: SparkSession, d: str) -> DataFrame:
    """Titles in compatibility decomposition, ASCII characters only."""
    return _table(spark, d, "documents").select("doc_id", nfkd_ascii(F.col("title")).alias("title"))


def _nfkd_sql() -> str:
    """Every character beyond ASCII whose decomposition has ASCII characters, with these."""
    found = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if x < "\x80") for r in (range(0xA0, 0xD800), range(0xF900, 0x10000), range(0x1D400, 0x1D800)) for c in r}
    pairs = {c: a for c, a in found.items() if a}
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return f"""with m as (select map([{', '.join(map(quote, pairs))}], [{', '.join(map(quote, pairs.values()))}]) m)
    select doc_id, array_to_string(list_transform(regexp_extract_all(title, '.', 0, 's'), lambda c: case when c < chr(128) then c else coalesce(m.m[c], '') end), '') title from documents, m"""


def json_array(spark: SparkSession, d: str) -> DataFrame:
    """Nations as JSON lines, turned into one JSON array on the driver, read again."""
    from sparkseek.cli import jsonl_to_json

    path = local_path(spark, _file(spark, _table(spark, d, "nation").select(F.to_json(F.struct("*")).alias("value"))))
    if path is None:
        raise ValueError("the conversion writes beside a file that the driver sees")
    return spark.read.json(f"file://{jsonl_to_json(path)}", multiLine=True).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


def table_ddl(spark: SparkSession, d: str) -> DataFrame:
    """Fields in order, with the type each has in a schema made from the catalog, and whether the table is empty."""
    db = Database.open(_table(spark, d, "nation"), order=["n_nationkey"])
    kinds = [part.rsplit(" ", 1)[1] for part in db.schema_ddl().split(", ")]
    return spark.createDataFrame([(i, f, k, db.is_empty()) for i, (f, k) in enumerate(zip(db.field_names(), kinds), 1)], "place int, field string, type string, empty boolean")


def stored_growth(spark: SparkSession, d: str) -> DataFrame:
    """The catalog of a stored table that took in the permits in two steps, fields and types coming with either; and whether a file cut short was refused."""
    lines, path = _table(spark, d, "permits").where("json_line is not null"), fresh_path(spark, "stored")
    early, late = (lines.where(c).select("json_line") for c in (F.col("file_id") % 2 == 0, F.col("file_id") % 2 == 1))
    first = _file(spark, early)
    store.sync(spark, first, path, mode="permissive")
    store.sync(spark, _file(spark, early, late), path, mode="permissive")
    try:
        store.sync(spark, first, path, mode="permissive")
        refused = False
    except ValueError:
        refused = True
    return Database.open(path, spark).source.field_rows().select("field", "type", "entries", F.lit(refused).alias("refused"))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Regions as a file that a live query follows: what its callback saw."""
    seen: list[tuple[int, int]] = []
    lines = _file(spark, _table(spark, d, "region").select(F.to_json(F.struct("*")).alias("value")))

    def look(table: DataFrame) -> None:
        r = table.agg(F.count("*").alias("n"), F.max(F.get_json_object("value", "$.r_regionkey").cast("int")).alias("last")).first()
        seen.append((r["n"], r["last"]))

    on_snapshot(spark, lines, fresh_path(spark, "live"), fresh_path(spark, "checkpoint"), look, once=True).awaitTermination()
    return spark.createDataFrame(seen, "records long, last int")


def _links(batches):
    for batch in batches:
        for row in batch.to_dict("records"):
            g = hnsw.Graph.from_arrays(row)
            near = [(n, links) for n in range(g.size) for links in g.neighbourhood(n)[:1]]
            exact = all(abs(np.linalg.norm(g.points[n].astype(float) - g.points[m].astype(float)) - dist) < 1e-4 for n, links in near for dist, m in links[:3])
            yield pd.DataFrame([(g.size, all(len(links) <= 2 * g.m for _, links in near), exact)], columns=["nodes", "bounded", "exact"])


def graph_links(spark: SparkSession, d: str) -> DataFrame:
    """Neighbourhoods on the ground level of all graphs of the vectors: nodes, whether links stay within their number, and have true distances."""
    path = fresh_path(spark, "hnsw")
    hnsw.build(_table(spark, d, "embeddings"), path, 64)
    rows = spark.read.parquet(path).mapInPandas(_links, "nodes long, bounded boolean, exact boolean")
    return rows.agg(F.sum("nodes").alias("nodes"), F.min("bounded").alias("bounded"), F.min("exact").alias("exact"))


def dimension_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether the dimension check refuses the vectors table, and takes the embeddings."""

    def takes(table: str, column: str, n: int) -> bool:
        try:
            _table(spark, d, table).agg(F.max(F.size(K.check_dimension(F.col(column), n)))).collect()
        except PySparkException:
            return False
        return True

    return spark.createDataFrame([("vectors", takes("vectors", "point", 32)), ("embeddings", takes("embeddings", "embedding", 64))], "name string, taken boolean")


QUERIES = {f.__name__: f for f in (query_checks, order_mixed_types, nfkd_texts, json_array, table_ddl, stored_growth, snapshots, graph_links, dimension_check)}

_KIND = "json_type(json_line, '$.inspector')"
SQL = {
    "query_checks": "select * from (values " + ", ".join(f"('{name}', {str(ok).lower()})" for name, _, ok in _CHECKS) + ") t(query, accepted)",
    "order_mixed_types": f"""select rec_id, case when r = 2 then (json_line->>'$.inspector')::double end number, case when r = 3 then json_line->>'$.inspector' end as "text"
from (select rec_id, json_line, case when {_KIND} = 'NULL' then 0 when {_KIND} = 'BOOLEAN' then 1 when {_KIND} = 'VARCHAR' then 3 when {_KIND} in ('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') then 2 end r from permits)
order by r nulls last, number nulls last, "text" nulls last, rec_id limit 200""",
    "nfkd_texts": _nfkd_sql(),
    "json_array": "select n_nationkey, n_name from nation",
    "table_ddl": "select column_index + 1 as place, column_name field, case when data_type like '%INT%' then 'DOUBLE' else 'STRING' end as type, (select count(*) = 0 from nation) as empty from (select row_number() over () - 1 column_index, column_name, column_type data_type from (describe nation))",
    "stored_growth": f"select *, true refused from ({REFERENCE_SQL['catalog_fields']})",
    "snapshots": "select count(*) records, max(r_regionkey)::int \"last\" from region",
    "graph_links": "select count(*) nodes, true bounded, true exact from embeddings where embedding is not null",
    "dimension_check": "select 'vectors' as name, coalesce(max(abs(len(point) - 32)), 0) = 0 taken from vectors union all select 'embeddings', coalesce(max(abs(len(embedding) - 64)), 0) = 0 from embeddings",
}
