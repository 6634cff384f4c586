"""Queries as plain data: an immutable builder and the checks made before anything runs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from sparkseek.functions.types import GRAMS, NUMBERS, FieldType, literal_type

OPERATIONS = ("<", "<=", "==", ">=", ">")
DIRECTIONS = ("ASC", "DESC")


class QueryError(ValueError):
    """A query that doesn't fit the data's fields and types."""


@dataclass(frozen=True)
class Where:
    key: str
    operation: str
    value: object


@dataclass(frozen=True)
class OrderBy:
    key: str
    direction: str = "ASC"


@dataclass(frozen=True)
class Search:
    key: str
    like: str
    min_gram: int = 1
    max_gram: int = 2


@dataclass(frozen=True)
class Query:
    where: tuple[Where, ...] | None = None
    order_by: tuple[OrderBy, ...] | None = None
    select: tuple[str, ...] | None = None
    search: Search | None = None
    limit: int | None = None
    ordered: bool = True
    number_order: str = "natural"

    @classmethod
    def of(cls, q: Query | dict) -> Query:
        """From a dict with where, orderBy, select, search and limit as lists of dicts."""
        if isinstance(q, Query):
            return q
        unknown = set(q) - {"where", "orderBy", "select", "search", "limit", "ordered", "number_order"}
        if unknown:
            raise QueryError(f"unknown parts of a query: {sorted(unknown)}")
        listed = lambda name, make: None if q.get(name) is None else tuple(make(x) for x in _list(q[name], name))
        search = q.get("search")
        if search is not None:
            c = search.get("config") or {}
            search = Search(search["key"], search["like"], c.get("minGram", 1), c.get("maxGram", 2))
        missing = object()

        def where(w: dict) -> Where:
            value = w.get("value", missing)
            if value is missing:
                raise QueryError("a where node has no value")
            return Where(w.get("key"), w.get("operation"), value)

        return cls(listed("where", where), listed("orderBy", lambda o: OrderBy(o.get("key"), o.get("direction", "ASC"))), listed("select", lambda s: s), search, q.get("limit"), q.get("ordered", True), q.get("number_order", "natural"))


def _list(x, name: str) -> Iterable:
    if not isinstance(x, (list, tuple)):
        raise QueryError(f"{name} must be a list")
    return x


@dataclass(frozen=True)
class QueryBuilder:
    """Each call gives a new builder; the one it was called on stays as it is."""

    database: object
    query: Query = field(default_factory=Query)

    def where(self, key: str, operation: str, value) -> QueryBuilder:
        return replace(self, query=replace(self.query, where=(*(self.query.where or ()), Where(key, operation, value))))

    def orderBy(self, key: str, direction: str = "ASC") -> QueryBuilder:  # noqa: N802
        return replace(self, query=replace(self.query, order_by=(*(self.query.order_by or ()), OrderBy(key, direction))))

    order_by = orderBy

    def select(self, keys: Iterable[str]) -> QueryBuilder:
        return replace(self, query=replace(self.query, select=tuple(keys)))

    def limit(self, n: int) -> QueryBuilder:
        return replace(self, query=replace(self.query, limit=n))

    def search(self, key: str, like: str, min_gram: int = 1, max_gram: int = 2) -> QueryBuilder:
        return replace(self, query=replace(self.query, search=Search(key, like, min_gram, max_gram)))

    def ordered(self, on: bool) -> QueryBuilder:
        """Switch off the implicit order by the first where key, which saves the sort."""
        return replace(self, query=replace(self.query, ordered=on))

    def toQuery(self) -> Query:  # noqa: N802
        return self.query

    to_query = toQuery

    def get(self):
        return self.database.query(self.query)

    def pull(self, size: int = 1000):
        """The rows in pages, as they are asked for."""
        return self.database.pull(self.query, size)

    def json(self):
        return self.database.query_json(self.query)


def validate(q: Query, headers: dict[str, list[FieldType]]) -> None:
    """Raise QueryError unless every part fits ``headers``."""
    if q.where is not None:
        _where(q.where, headers)
    for o in q.order_by or ():
        if o.direction not in DIRECTIONS:
            raise QueryError(f"order direction must be ASC or DESC, not {o.direction}")
        if o.key not in headers:
            raise QueryError(f"order key {o.key!r} is not a field")
    if q.order_by is not None and not q.order_by:
        raise QueryError("orderBy is empty")
    if q.select is not None:
        if not q.select:
            raise QueryError("select is empty")
        for s in q.select:
            if s not in headers:
                raise QueryError(f"selected {s!r} is not a field")
    if q.search is not None:
        validate_search(q.search, headers)
    if q.limit is not None and (isinstance(q.limit, bool) or not isinstance(q.limit, int) or q.limit < 0):
        raise QueryError("limit must be a whole number from 0")
    if q.number_order not in ("natural", "bytes"):
        raise QueryError("number_order must be natural or bytes")


def _where(nodes: tuple[Where, ...], headers: dict[str, list[FieldType]]) -> None:
    if not nodes:
        raise QueryError("where is empty")
    for w in nodes:
        if w.operation not in OPERATIONS:
            raise QueryError(f"unknown operation {w.operation!r}")
        if not isinstance(w.key, str):
            raise QueryError("a where key must be a string")
        if w.key not in headers:
            raise QueryError(f"where key {w.key!r} is not a field")
        try:
            kind = literal_type(w.value)
        except TypeError as e:
            raise QueryError(str(e)) from None
        if not (NUMBERS if kind is FieldType.Float64 else {kind}) & set(headers[w.key]):
            raise QueryError(f"{w.key!r} has no values of type {kind.name}")


def validate_search(s: Search, headers: dict[str, list[FieldType]]) -> None:
    if s.key not in headers:
        raise QueryError(f"search key {s.key!r} is not a field")
    if missing := [t.name for t in GRAMS.values() if t not in headers[s.key]]:
        raise QueryError(f"{s.key!r} is not a search field: no {', '.join(missing)}")
    if not 1 <= s.min_gram <= s.max_gram <= 3:
        raise QueryError(f"n-gram lengths must satisfy 1 <= min <= max <= 3, not {s.min_gram} and {s.max_gram}")
