"""Stored tables: an append-only file read once, kept with its catalog, typed columns and n-gram postings.

``sync`` appends what a JSONL or CSV file completed since the last call as a new part:

    parts/ID/records       raw lines by byte offset, and per field and type a typed column; sorted by a field if one is named
    parts/ID/postings/I    (doc, gram, tf) of search field I, sorted by gram
    commits/N              the table's N-th state: version, format, read offset, entries, catalog, parts

A commit file makes a part count at once; a sync that breaks off leaves an unnamed folder behind, and of two that race the second fails.
Queries then need neither the catalog pass nor JSON parsing to filter: predicates are on typed columns, which Parquet's statistics prune,
and a search reads the row groups of its grams.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.functions.types import GRAMS, FieldType
from sparkseek.operators import search as S
from sparkseek.runtime import commit_file, last_committed, materialize, read_committed
from sparkseek.sources import csv as C
from sparkseek.sources import jsonl as J
from sparkseek.sources import tail
from sparkseek.sources.base import CATALOG, Source

#: The layout above; tables of another version are refused.
VERSION = 1
FORMATS = ("jsonl", "csv")
#: Letters of the typed columns and their Spark types. A Null column says whether the value is an explicit null.
COLUMNS = {FieldType.String: ("s", T.StringType()), FieldType.Float64: ("n", T.DoubleType()), FieldType.Boolean: ("b", T.BooleanType()), FieldType.Null: ("z", T.BooleanType())}
RAW = [T.StructField("_offset", T.LongType()), T.StructField("_length", T.IntegerType()), T.StructField("value", T.StringType())]


class FormatError(ValueError):
    """A table of another version, format or definition than asked for."""


def is_table(spark: SparkSession, path: str) -> bool:
    return last_committed(spark, f"{path.rstrip('/')}/commits") > 0


def load(spark: SparkSession, path: str, format: str | None = None) -> dict:  # noqa: A002
    """The table's last state, checked: FormatError if its version is not VERSION, or its format not the one asked for."""
    n = last_committed(spark, f"{path}/commits")
    if not n:
        raise FormatError(f"{path} is no table")
    state = json.loads(read_committed(spark, f"{path}/commits", n))
    if state.get("version") != VERSION:
        raise FormatError(f"{path} has version {state.get('version')}, not {VERSION}")
    if state.get("format") not in FORMATS or format not in (None, state["format"]):
        raise FormatError(f"{path} has format {state.get('format')}, not {format or ' or '.join(FORMATS)}")
    return state | {"number": n}


def column(state: dict, field: str, t: FieldType) -> str:
    """Name of a typed column; fields are numbered, so that any name will do."""
    return f"{COLUMNS[t][0]}{state['ids'][field]}"


def _source(lines: DataFrame, state: dict, mode: str) -> Source:
    search = tuple(state["search_fields"])
    if state["format"] == "csv":
        return C.CsvSource(C.bronze(lines, state["header"], mode), state["header"], search)
    return J.JsonSource(J.bronze(lines, mode), search)


def sync(spark: SparkSession, data: str, path: str, format: str = "jsonl", search_fields: tuple[str, ...] = (), sort_by: str | None = None, mode: str = "failfast", split: int | None = None) -> dict:  # noqa: A002
    """Append the lines of ``data`` that were completed since the last sync; gives the table's state. Nothing new changes nothing.

    ``search_fields`` and ``sort_by`` (a field; rows of a part are sorted by its numbers, then its strings) are fixed by the first sync. A
    malformed line fails the sync as a whole, or (``permissive``) is kept as a record without fields.
    """
    path = path.rstrip("/")
    began = time.time()
    if is_table(spark, path):
        state = load(spark, path, format)
        if search_fields and list(search_fields) != state["search_fields"]:
            raise FormatError(f"{path} has the search fields {state['search_fields']}")
    elif format not in FORMATS:
        raise FormatError(f"format must be one of {FORMATS}")
    else:
        state = {"number": 0, "version": VERSION, "format": format, "read_offset": 0, "entries": 0, "header": None, "search_fields": list(search_fields), "sort_by": sort_by, "ids": {}, "fields": {}, "parts": []}
    end = tail.complete_end(data, state["read_offset"])
    if end == state["read_offset"]:
        return state
    if format == "csv" and state["header"] is None:
        from sparkseek.plans.database import csv_header

        state["header"] = csv_header(spark, data)
    lines = materialize(tail.read_lines(spark, data, start=state["read_offset"], end=end, split=split, invalid="error" if mode == "failfast" else "replace"), "lines")
    source = _source(lines, state, mode)
    found = source.field_rows().collect()  # one row per field and type
    for r in sorted(found, key=lambda r: (r["first"], r["field"])):
        state["ids"].setdefault(r["field"], len(state["ids"]))
        known = state["fields"].setdefault(r["field"], {}).setdefault(r["type"], [r["first"], 0, 0])
        known[1] += r["entries"]
        known[2] += r["total_length"]
    folder = f"parts/{uuid.uuid4().hex}"
    kinds = [(r["field"], FieldType[r["type"]]) for r in found if FieldType[r["type"]] in COLUMNS]
    rows = source.df.select("_offset", "_length", "value", *(source.typed(f, t).alias(column(state, f, t)) for f, t in kinds))
    order = [column(state, f, t) for t in (FieldType.Float64, FieldType.String) for f, k in kinds if f == state["sort_by"] and k is t]
    if order:
        rows = rows.repartitionByRange(*order, "_offset").sortWithinPartitions(*order, "_offset")
    rows.write.parquet(f"{path}/{folder}/records")
    for i, f in enumerate(state["search_fields"]):
        docs = source.df.select(F.col("_offset").alias("doc"), source.typed(f, FieldType.String).alias("text"))
        S.write_postings(S.postings(docs, low=min(GRAMS), high=max(GRAMS)), f"{path}/{folder}/postings/{i}")
    entries = source.df.count()
    state["entries"] += entries
    number = state.pop("number") + 1
    state["parts"].append({"folder": folder, "start": state["read_offset"], "bytes": end - state["read_offset"], "entries": entries, "seconds": round(time.time() - began, 3)})
    state["read_offset"] = end
    if not commit_file(spark, f"{path}/commits", str(number), json.dumps(state)):
        raise RuntimeError(f"state {number} of {path} was committed by someone else")
    return state | {"number": number}


class StoredSource(Source):
    """A stored table: its catalog comes from the commit, filters from typed columns, searches from postings."""

    def __init__(self, spark: SparkSession, path: str, format: str | None = None):  # noqa: A002
        self.spark, self.path = spark, path.rstrip("/")
        self.state = load(spark, self.path, format)
        self.search_fields, self.order = tuple(self.state["search_fields"]), ["_offset"]
        typed = [T.StructField(column(self.state, f, FieldType[t]), COLUMNS[FieldType[t]][1]) for f, kinds in self.state["fields"].items() for t in kinds if FieldType[t] in COLUMNS]
        records = spark.read.schema(T.StructType(RAW + typed)).parquet(*(f"{self.path}/{p['folder']}/records" for p in self.state["parts"]))
        self.inner = _source(records, self.state, "permissive")
        self.df = self.inner.df

    def metadata(self) -> dict:
        return {k: self.state[k] for k in ("version", "format", "read_offset", "entries")}

    def entries(self) -> int:
        return self.state["entries"]

    def field_rows(self) -> DataFrame:
        rows = [(f, t, *numbers) for f, kinds in self.state["fields"].items() for t, numbers in kinds.items()]
        return self.spark.createDataFrame(rows, CATALOG)

    def headers(self) -> dict[str, list[FieldType]]:
        grams = [FieldType.Trigram, FieldType.Bigram, FieldType.Unigram]
        return {f: [FieldType[t] for t, _ in sorted(kinds.items(), key=lambda x: (x[1][0], x[0]))] + (grams if f in self.search_fields else []) for f, kinds in self.state["fields"].items()}

    def typed(self, field: str, t: FieldType) -> Column:
        if t not in COLUMNS or t.name not in self.state["fields"].get(field, {}):
            return F.lit(False) if t is FieldType.Null else F.lit(None)
        col = F.col(column(self.state, field, t))
        return F.coalesce(col, F.lit(False)) if t is FieldType.Null else col

    def projected(self, field: str) -> Column:
        return self.inner.projected(field)

    def json(self, fields: list[str] | None) -> Column:
        return self.inner.json(fields)

    def postings(self, field: str) -> DataFrame:
        """(doc, gram, tf) of a search field."""
        i = self.state["search_fields"].index(field)
        return self.spark.read.schema("doc long, gram string, tf long").parquet(*(f"{self.path}/{p['folder']}/postings/{i}" for p in self.state["parts"]))
