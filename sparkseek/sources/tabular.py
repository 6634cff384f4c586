"""Any DataFrame as a source: its columns are the fields, its schema gives their types.

SQL NULL is what ``== None`` matches here, since a table can't tell null from missing. Times are ISO-8601 text, numbers doubles.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkseek.functions.types import FieldType, of_spark
from sparkseek.sources.base import CATALOG, Source

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


class TabularSource(Source):
    def __init__(self, df: DataFrame, order: list[str] | None = None, search_fields: tuple[str, ...] = ()):
        self.df, self.order, self.search_fields = df, list(order or []), tuple(search_fields)
        self._types: dict[str, T.DataType] = {}
        self._walk(df.schema, "")

    def _walk(self, schema: T.StructType, prefix: str) -> None:
        for f in schema.fields:
            self._types[prefix + f.name] = f.dataType
            if isinstance(f.dataType, T.StructType):
                self._walk(f.dataType, f"{prefix}{f.name}.")

    def raw(self, field: str) -> Column:
        return F.col(f"`{field}`" if field in self.df.columns else ".".join(f"`{p}`" for p in field.split(".")))

    def headers(self) -> dict[str, list[FieldType]]:
        grams = [FieldType.Trigram, FieldType.Bigram, FieldType.Unigram]
        return {f: [of_spark(t), *([FieldType.Null] if self._nullable(f) else []), *(grams if f in self.search_fields else [])] for f, t in self._types.items()}

    def _nullable(self, field: str) -> bool:
        schema, parts = self.df.schema, [field] if field in self.df.columns else field.split(".")
        for i, p in enumerate(parts):
            f = schema[p]
            if f.nullable:
                return True
            schema = f.dataType if i + 1 < len(parts) else None
        return False

    def field_rows(self) -> DataFrame:
        """Counted in one pass over the table."""
        aggs = []
        for i, (f, t) in enumerate(self._types.items()):
            col, kind = self.raw(f), of_spark(t)
            size = F.length(self.typed(f, kind)) + 2 if kind is FieldType.String else F.length(col.cast("string")) if kind is FieldType.Float64 else F.lit(1) if kind is FieldType.Boolean else F.lit(0)
            aggs += [F.count(col).alias(f"n{i}"), F.count(F.when(col.isNull(), 1)).alias(f"z{i}"), F.coalesce(F.sum(size.cast("long")), F.lit(0).cast("long")).alias(f"l{i}")]
        zero = F.lit(0).cast("long")
        rows = [
            F.struct(F.lit(f).alias("field"), F.lit(k).alias("type"), F.lit(i).cast("long").alias("first"), F.col(c).alias("entries"), (F.col(f"l{i}") if c[0] == "n" else zero).alias("total_length"))
            for i, (f, t) in enumerate(self._types.items())
            for k, c in ((of_spark(t).name, f"n{i}"), ("Null", f"z{i}"))
        ]
        one = self.df.agg(*aggs)
        return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("entries > 0")

    def typed(self, field: str, t: FieldType) -> Column:
        col, spark_type = self.raw(field), self._types[field]
        if t is FieldType.Null:
            return col.isNull()
        if of_spark(spark_type) is not t:
            return F.lit(None)
        if t is FieldType.Float64:
            return col if isinstance(spark_type, T.DoubleType) else col.cast("double")
        if t is FieldType.String and isinstance(spark_type, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(col, ISO)
        return col.cast("string") if t is FieldType.String and not isinstance(spark_type, T.StringType) else col

    def compare(self, field: str, operation: str, value) -> Column | None:
        """Times and dates against ISO text, as times and dates: text of the same order, but the scan can prune by it.

        A text that breaks off after a whole part (``2024-01-10``) is less than every time it begins; anything else that isn't a time stays text.
        """
        kind = self._types[field]
        zoned = isinstance(kind, T.TimestampType)
        if not isinstance(value, str) or not (zoned or isinstance(kind, (T.TimestampNTZType, T.DateType))):
            return None
        if zoned and self.df.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "GMT"):
            return None  # where clocks are set back, text is out of order
        col, whole, shape = self.raw(field), 10 if isinstance(kind, T.DateType) else 26, "0001-01-01T00:00:00.000000"
        full = value + shape[len(value) :]
        try:
            start = dt.datetime.strptime(full, "%Y-%m-%dT%H:%M:%S.%f")
        except ValueError:
            return None
        if len(value) > whole or len(value) in (0, 1, 2, 3, 6, 9, 12, 15, 18) or start.strftime("%Y-%m-%dT%H:%M:%S.%f") != full:
            return None
        literal = F.lit(full[:whole].replace("T", " ")).cast(kind)
        if len(value) == whole:
            return {"<": col < literal, "<=": col <= literal, "==": col == literal, ">=": col >= literal, ">": col > literal}[operation]
        return {"<": col < literal, "<=": col < literal, "==": F.lit(False), ">=": col >= literal, ">": col >= literal}[operation]

    def projected(self, field: str) -> Column:
        return self.raw(field).alias(field)

    def json(self, fields: list[str] | None) -> Column:
        names = fields or self.df.columns
        return F.to_json(F.struct(*(self.raw(f).alias(f) for f in names)))


__all__ = ["CATALOG", "TabularSource"]
