"""The database: a source plus queries, planned as DataFrames for Catalyst."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions.types import FieldType, literal_type, literal_value
from sparkseek.operators import search as S
from sparkseek.plans.query import Query, QueryBuilder, QueryError, Search, Where, validate
from sparkseek.sources.base import Source

MAX_HITS_SENT = 10_000
COMPARE = {"<": "__lt__", "<=": "__le__", "==": "__eq__", ">=": "__ge__", ">": "__gt__"}


class Database:
    """Queries over one source. Results are DataFrames; nothing runs until they are used, but for the field catalog of JSON and CSV."""

    def __init__(self, source: Source):
        self.source = source

    @classmethod
    def open(cls, source, spark: SparkSession | None = None, format: str | None = None, search_fields: tuple[str, ...] = (), order: list[str] | None = None, mode: str = "failfast", strict_search: bool = False, split: int | None = None) -> Database:  # noqa: A002
        """A DataFrame, a Source, a stored table's folder (``sparkseek.sources.store``), or the path of a .jsonl, .csv or Parquet file
        (``format`` overrides the suffix; for a stored table it is checked). In ``permissive`` mode broken lines stay, with broken UTF-8 replaced."""
        from sparkseek.sources.tabular import TabularSource

        if isinstance(source, Source):
            return cls(source)
        if isinstance(source, DataFrame):
            return cls(TabularSource(source, order, search_fields))
        spark = spark or SparkSession.getActiveSession()
        from sparkseek.sources import store

        if format == "table" or (format in (None, *store.FORMATS) and store.is_table(spark, source)):
            return cls(store.StoredSource(spark, source, None if format == "table" else format))
        invalid = "error" if mode == "failfast" else "replace"
        kind = format or source.rsplit(".", 1)[-1].lower()
        if kind in ("jsonl", "ndjson", "json"):
            from sparkseek.sources import jsonl, tail

            return cls(jsonl.JsonSource(jsonl.bronze(tail.read_lines(spark, source, split=split, invalid=invalid), mode), search_fields, strict_search))
        if kind == "csv":
            from sparkseek.sources import csv, tail

            lines = tail.read_lines(spark, source, split=split, invalid=invalid)
            return cls(csv.CsvSource(csv.bronze(lines, csv_header(spark, source), mode), csv_header(spark, source), search_fields))
        return cls(TabularSource(spark.read.format(kind).load(source), order, search_fields))

    # catalog

    def fields(self) -> dict[str, list[FieldType]]:
        return self.source.headers()

    def index_meta(self) -> DataFrame:
        return self.source.index_meta()

    def field_names(self) -> list[str]:
        return list(self.fields())

    def entries(self) -> int:
        return self.source.entries()

    def metadata(self) -> dict:
        """{version, format, read_offset, entries}: all of them for a stored table, else the entries."""
        return self.source.metadata()

    def is_empty(self) -> bool:
        return self.source.df.isEmpty()

    def schema_ddl(self) -> str:
        return self.source.ddl()

    def df(self) -> DataFrame:
        return self.source.df

    # queries

    def builder(self) -> QueryBuilder:
        return QueryBuilder(self)

    def where(self, key: str, operation: str, value) -> QueryBuilder:
        return self.builder().where(key, operation, value)

    def orderBy(self, key: str, direction: str = "ASC") -> QueryBuilder:  # noqa: N802
        return self.builder().orderBy(key, direction)

    def select(self, keys) -> QueryBuilder:
        return self.builder().select(keys)

    def search(self, key: str, like: str, min_gram: int = 1, max_gram: int = 2) -> DataFrame:
        return self.query(Query(search=Search(key, like, min_gram, max_gram)))

    def query(self, q: Query | dict) -> DataFrame:
        """The rows: selected fields, or all columns. With ``search``: (data, score), best first."""
        q = Query.of(q)
        validate(q, self.fields())
        if q.search is not None:
            return self._search(q)
        rows = self._ordered(self._filtered(q), q)
        return rows.select(*(self.source.projected(k) for k in q.select)) if q.select else rows

    def pull(self, q: Query | dict, size: int = 1000) -> Iterator[list[Row]]:
        """The rows in pages of ``size``, in order, one after another as they are asked for; the driver holds one partition of the result at a time."""
        rest = self.query(q).toLocalIterator()
        while page := list(itertools.islice(rest, size)):
            yield page

    def query_json(self, q: Query | dict) -> DataFrame:
        """The rows as JSON text in ``value``: selected keys that a record lacks are left out, explicit nulls stay."""
        q = Query.of(q)
        validate(q, self.fields())
        if q.search is not None:
            return self._search(q)
        rows = self._ordered(self._filtered(q), q)
        return rows.select(self.source.json(list(q.select) if q.select else None).alias("value"))

    def _predicate(self, w: Where) -> Column:
        kind = literal_type(w.value)
        pruned = self.source.compare(w.key, w.operation, literal_value(w.value))
        if pruned is not None:
            return pruned
        col = self.source.typed(w.key, kind)
        if kind is FieldType.Null:
            return col if w.operation in ("==", "<=", ">=") else F.lit(False)
        return getattr(col, COMPARE[w.operation])(F.lit(literal_value(w.value)))

    def _filtered(self, q: Query) -> DataFrame:
        rows = self.source.df
        for w in q.where or ():
            rows = rows.where(self._predicate(w))
        return rows

    def _sort_keys(self, key: str, descending: bool, q: Query) -> list[Column]:
        """Values of one type compare as such; a field with several types sorts null, boolean, number, string; what is missing comes last."""
        types = self.fields()[key]
        wanted = {literal_type(w.value) for w in q.where or () if w.key == key} or set(types)
        columns: list[Column] = []
        kinds = [t for t in (FieldType.Boolean, FieldType.Float64, FieldType.String) if t in wanted and t in types]
        if len(kinds) > 1:
            place = F.when(self.source.typed(key, FieldType.Null), 0)
            for i, t in enumerate(kinds, 1):
                place = place.when(self.source.typed(key, t).isNotNull(), i)
            columns.append(place)
        for t in kinds:
            value = self.source.typed(key, t)
            if t is FieldType.Float64 and q.number_order == "bytes":
                columns.append((value < 0) | (value.cast("string") == "-0.0"))
                value = F.abs(value)
            columns.append(value)
        return [c.desc_nulls_last() if descending else c.asc_nulls_last() for c in columns]

    def _keys(self, q: Query) -> list[Column]:
        """What the result is sorted by: ``orderBy``, else the first where key; a limit alone takes the file order."""
        keys, down = [], False
        if q.order_by:
            for o in q.order_by:
                down = o.direction == "DESC"
                keys += self._sort_keys(o.key, down, q)
        elif q.where and q.ordered:
            keys = self._sort_keys(q.where[0].key, False, q)
        if q.order_by or (q.ordered and (q.where or q.limit is not None)):
            keys += [F.col(c).desc() if down else F.col(c).asc() for c in self.source.order]
        return keys

    def _ordered(self, rows: DataFrame, q: Query) -> DataFrame:
        keys = self._keys(q)
        if keys:
            rows = rows.orderBy(*keys)
        return rows if q.limit is None else rows.limit(q.limit)

    def _search(self, q: Query) -> DataFrame:
        if not self.source.order:
            raise QueryError("search needs a source with an order column (order=[...]) that identifies records")
        s = q.search
        doc = self.source.order[0]
        text = self.source.typed(s.key, FieldType.String)
        allowed = self._filtered(q).select(F.col(doc).alias("doc")) if q.where else None
        stored = self.source.postings(s.key)
        if stored is not None:
            scored = S.search_postings(stored, self.source.entries(), s.like, s.min_gram, s.max_gram, within=allowed, limit=q.limit)
        else:
            docs = self.source.df.select(F.col(doc).alias("doc"), text.alias("text"))
            scored = S.search(docs, s.like, s.min_gram, s.max_gram, within=allowed, limit=q.limit)
        hits = scored.select(F.col("doc").alias("_doc"), F.col("score").alias("_score"))
        if q.limit is not None and q.limit <= MAX_HITS_SENT:
            hits = F.broadcast(hits)
        rows = self.source.df.join(hits, F.col(doc) == F.col("_doc")).orderBy(F.col("_score").desc(), "_doc")
        return rows.select(self.source.json(None).alias("data"), F.col("_score").alias("score"))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The header line of a CSV file."""
    import csv as text_csv
    import io

    from sparkseek.sources.tail import _open

    with _open(path) as f:
        line = f.readline().decode("utf-8", "replace").rstrip("\r\n")
    return next(text_csv.reader(io.StringIO(line)), [])
