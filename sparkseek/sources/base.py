"""What a database needs from its source: rows with an order, typed access to fields, a catalog."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions.types import GRAMS, WIDTH, FieldType, ddl_of

CATALOG = "field string, type string, first long, entries long, total_length long"


class Source(ABC):
    """Rows of one file or table. ``order``: columns that give the file order and break ties."""

    df: DataFrame
    order: list[str]
    search_fields: tuple[str, ...] = ()
    _headers: dict[str, list[FieldType]] | None = None

    @abstractmethod
    def field_rows(self) -> DataFrame:
        """(field, type name, first, entries, total_length), one row per field and type."""

    @abstractmethod
    def typed(self, field: str, t: FieldType) -> Column:
        """The field as a value of that type; null where it has another type or is missing. Null: whether it is an explicit null."""

    @abstractmethod
    def projected(self, field: str) -> Column:
        """The field as it comes out of a select."""

    @abstractmethod
    def json(self, fields: list[str] | None) -> Column:
        """The record, or the listed fields that it has, as JSON text."""

    def index_meta(self) -> DataFrame:
        """Catalog: (field_name, field_type, width, entries, total_field_value_length, first), n-gram rows for search fields included."""
        rows = self.field_rows()
        width = F.create_map(*(F.lit(x) for t in FieldType for x in (t.name, WIDTH.get(t, 0))))
        base = rows.select(F.col("field").alias("field_name"), F.col("type").alias("field_type"), F.element_at(width, F.col("type")).alias("width"), "entries", F.col("total_length").alias("total_field_value_length"), "first")
        if not self.search_fields:
            return base
        from sparkseek.functions.text import ngrams

        text = [F.struct(F.lit(f).alias("f"), F.lit(n).alias("n"), F.lit(t.name).alias("t"), ngrams(self.typed(f, FieldType.String), n).alias("g")) for f in self.search_fields for n, t in GRAMS.items()]
        first = F.col(self.order[0]).cast("long") if self.order else F.lit(0).cast("long")
        each = self.df.select(first.alias("first"), F.explode(F.array(*text)).alias("x")).where("size(x.g) > 0")
        grams = each.groupBy("x.f", "x.t").agg(F.sum(F.size("x.g")).alias("entries"), F.sum(F.size("x.g") * F.col("x.n")).alias("total"), F.min("first").alias("first"))
        return base.unionByName(grams.select(F.col("f").alias("field_name"), F.col("t").alias("field_type"), F.element_at(width, F.col("t")).alias("width"), "entries", F.col("total").alias("total_field_value_length"), "first"))

    def headers(self) -> dict[str, list[FieldType]]:
        """field -> its types in the order they first appear; kept after the first call. Field names are bounded by the schema."""
        if self._headers is None:
            found: dict[str, list[FieldType]] = {}
            for r in sorted(self.field_rows().collect(), key=lambda r: (r["first"], r["field"], r["type"])):
                found.setdefault(r["field"], []).append(FieldType[r["type"]])
            for f in self.search_fields:
                if f in found:
                    found[f] += [t for t in (FieldType.Trigram, FieldType.Bigram, FieldType.Unigram) if t not in found[f]]
            self._headers = found
        return self._headers

    def ddl(self) -> str:
        """A schema for the fields, from the catalog."""
        return ", ".join(f"`{f}` {ddl_of(ts)}" for f, ts in self.headers().items() if "." not in f)

    def entries(self) -> int:
        return self.df.count()

    def metadata(self) -> dict:
        """{version, format, read_offset, entries}; None where the source has no such thing."""
        return {"version": None, "format": None, "read_offset": None, "entries": self.entries()}

    def compare(self, field: str, operation: str, value) -> Column | None:
        """A predicate that the scan can take over, if the source knows a better one than comparing ``typed``."""
        return None

    def postings(self, field: str) -> DataFrame | None:
        """Stored (doc, gram, tf) of a search field, if there are any."""
        return None
