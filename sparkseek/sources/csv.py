"""CSV under the same query surface: each cell has its own type.

A cell is Null if empty, Float64 if it is a whole number or a float, Boolean for the usual short and long spellings, otherwise String.
Blanks around a value make it a String; a number out of range too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions.columns import once
from sparkseek.functions.types import FieldType
from sparkseek.sources.base import Source

WHOLE = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
HEX_FLOAT = r"^([+-]?)0[xX]([0-9a-fA-F]*)\.?([0-9a-fA-F]*)[pP]([+-]?[0-9]+)$"
INFINITE = r"^[+-]?(?i:inf|infinity)$"
NAN = r"^(?i:nan)$"

#: Spellings of booleans (fixed values; 1 and 0 are numbers before).
TRUE, FALSE = ("t", "T", "TRUE", "true", "True"), ("f", "F", "FALSE", "false", "False")


def _hex_float(cell: Column) -> Column:
    sign, whole, part, power = (F.regexp_extract(cell, HEX_FLOAT, i) for i in range(1, 5))
    digits = F.try_to_number(F.conv(F.concat(whole, part), 16, 10), F.lit("9" * 20)).cast("double")
    value = digits * F.pow(F.lit(2.0), power.try_cast("double") - 4 * F.length(part))
    return F.when(sign == "-", -value).otherwise(value)


def number(cell: Column) -> Column:
    """The cell as a double if it is a number, else null."""
    plain = F.when(cell.rlike(WHOLE) | cell.rlike(FLOAT), cell.try_cast("double"))
    in_range = F.when(F.abs(plain) != F.lit(float("inf")), plain)
    infinite = F.when(cell.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(~cell.rlike("^[-+.0-9iInN]"), None).when(cell.rlike(WHOLE), in_range).when(cell.rlike(INFINITE), infinite).when(cell.rlike(NAN), F.lit(float("nan"))).when(cell.rlike(HEX_FLOAT), _hex_float(cell)).otherwise(in_range)


def infer(cell: Column) -> Column:
    """Name of the cell's type; a null cell (missing) has none."""
    return (
        F.when(cell.isNull(), None)
        .when(cell == "", "Null")
        .when(number(cell).isNotNull(), "Float64")
        .when(cell.isin(*TRUE, *FALSE), "Boolean")
        .otherwise("String")
    )


def bronze(lines: DataFrame, header: list[str], mode: str = "failfast") -> DataFrame:
    """(_offset, _length, value) plus ``cells``, a map from header to text; the header line itself (offset 0) is left out.

    A record may have fewer cells than the header (the rest is missing); with more it ends the read, or (``permissive``) is ``_corrupt``.
    A repeated header name takes the last of its cells.
    """
    width = len(header)
    fields = ", ".join(f"c{i} string" for i in range(width))
    bare = F.regexp_replace("value", '"[^"]*"', "")  # quoted parts hold no separators
    n = F.length(bare) - F.length(F.regexp_replace(bare, ",", "")) + 1
    rows = lines.where("_offset > 0").withColumn("_c", F.from_csv("value", fields, {"mode": "PERMISSIVE", "escape": '"', "emptyValue": ""})).withColumn("_n", n)
    places: dict[str, list[int]] = {}
    for i, h in enumerate(header):
        places.setdefault(h, []).insert(0, i)
    cell = lambda i: F.when(F.col("_n") > i, F.coalesce(F.col(f"_c.c{i}"), F.lit("")))
    every = F.map_from_arrays(F.array(*map(F.lit, places)), F.array(*(F.coalesce(*map(cell, at)) for at in places.values())))
    out = rows.withColumn("_over", F.col("_n") > width)
    if mode == "failfast":
        wrong = F.raise_error(F.concat(F.lit("more cells than headers at byte "), F.col("_offset").cast("string")))
        out = out.withColumn("_over", F.when(F.col("_over"), wrong.cast("boolean")).otherwise(F.lit(False)))
    return out.withColumn("cells", F.when(~F.col("_over"), F.map_filter(every, lambda _, c: c.isNotNull()))).withColumn("_corrupt", F.col("_over")).drop("_c", "_n", "_over")


class CsvSource(Source):
    def __init__(self, df: DataFrame, header: list[str], search_fields: tuple[str, ...] = ()):
        self.df, self.header, self.order, self.search_fields = df, list(header), ["_offset"], tuple(search_fields)

    def cell(self, field: str) -> Column:
        return F.try_element_at("cells", F.lit(field))

    def field_rows(self) -> DataFrame:
        each = self.df.where("cells is not null").select("_offset", F.explode("cells").alias("field", "cell"))
        each = each.select("*", once(infer(F.col("cell"))).alias("type"))
        size = F.when(F.col("type").isin("String", "Float64"), F.length("cell")).when(F.col("type") == "Boolean", 1).otherwise(0)
        return each.groupBy("field", "type").agg(F.min("_offset").alias("first"), F.count("*").alias("entries"), F.sum(size.cast("long")).alias("total_length"))

    def headers(self) -> dict[str, list[FieldType]]:
        """Fields in the order of the header line."""
        place = {h: i for i, h in reversed(list(enumerate(self.header)))}
        return dict(sorted(super().headers().items(), key=lambda x: place[x[0]]))

    def typed(self, field: str, t: FieldType) -> Column:
        cell = self.cell(field)
        if t is FieldType.Null:
            return F.coalesce(cell == "", F.lit(False))
        if t is FieldType.Float64:
            return number(cell)
        if t is FieldType.Boolean:
            return F.when(cell.isin(*TRUE), True).when(cell.isin(*FALSE), False)
        return F.when(infer(cell) == "String", cell) if t is FieldType.String else F.lit(None)

    def projected(self, field: str) -> Column:
        return self.cell(field).alias(field)

    def json(self, fields: list[str] | None) -> Column:
        from sparkseek.sources.jsonl import _key

        parts = []
        for f in fields or self.header:
            cell = self.cell(f)
            kind = infer(cell)
            value = F.when(kind == "Null", "null").when(kind == "Boolean", self.typed(f, FieldType.Boolean).cast("string")).when((kind == "Float64") & cell.rlike(FLOAT), number(cell).cast("string")).otherwise(_quoted(cell))
            parts.append(F.when(cell.isNotNull(), F.concat(F.lit(_key(f)), value)))
        return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _quoted(text: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'^\{"x":(.*)\}$', 1)
