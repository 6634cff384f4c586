"""JSON Lines: one object per line, every value keeps its own type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions import variants as V
from sparkseek.functions.types import FieldType
from sparkseek.sources.base import Source

KIND = {FieldType.String: "string", FieldType.Float64: "double", FieldType.Boolean: "boolean"}


def bronze(lines: DataFrame, mode: str = "failfast") -> DataFrame:
    """(_offset, _length, value) plus ``v``, the record as VARIANT.

    A line that is no JSON object ends the read (``failfast``), or stays with a null ``v`` and ``_corrupt`` true (``permissive``).
    """
    parsed = V.with_variant(lines, "value", "v")
    if mode == "permissive":
        return parsed.withColumn("_corrupt", F.col("v").isNull())
    if mode != "failfast":
        raise ValueError(f"mode must be failfast or permissive, not {mode}")
    wrong = F.raise_error(F.concat(F.lit("not a JSON object at byte "), F.col("_offset").cast("string")))
    return parsed.withColumn("v", F.when(F.col("v").isNull(), wrong.cast("variant")).otherwise(F.col("v")))


class JsonSource(Source):
    """Records in bronze form; the catalog walks nested objects to the last level."""

    def __init__(self, df: DataFrame, search_fields: tuple[str, ...] = (), strict_search: bool = False):
        self.df, self.order, self.search_fields, self.strict_search = df, ["_offset"], tuple(search_fields), strict_search

    def field_rows(self) -> DataFrame:
        flat = V.flatten(self.df.where("v is not null"), "v", ["_offset"])
        kind = V.type_name(F.col("value"))
        size = F.when(kind.isin("String", "Float64"), F.length(F.to_json("value"))).when(kind == "Boolean", 1).otherwise(0)
        return flat.groupBy("field", kind.alias("type")).agg(F.min("_offset").alias("first"), F.count("*").alias("entries"), F.sum(size.cast("long")).alias("total_length")).where("type is not null")

    def at(self, field: str) -> Column:
        return V.at(F.col("v"), field)

    def typed(self, field: str, t: FieldType) -> Column:
        value = self.at(field)
        if t is FieldType.Null:
            return F.coalesce(F.is_variant_null(value), F.lit(False))
        if t not in KIND:
            return F.lit(None)
        if self.strict_search and field in self.search_fields and t is FieldType.String:
            wrong = F.raise_error(F.lit(f"expected string in search field {field}")).cast("string")
            return F.when(value.isNull() | F.is_variant_null(value) | (V.tag(value) == "STRING"), V.read_as(value, "string")).otherwise(wrong)
        return V.read_as(value, KIND[t])

    def projected(self, field: str) -> Column:
        return self.at(field).alias(field)

    def json(self, fields: list[str] | None) -> Column:
        if not fields:
            return F.to_json("v")
        parts = [F.when(self.at(f).isNotNull(), F.concat(F.lit(_key(f)), F.to_json(self.at(f)))) for f in fields]
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _key(field: str) -> str:
    import json

    return json.dumps(field, ensure_ascii=False) + ":"
