"""VARIANT helpers: parsing, type tags, guarded reads, flattening of nested objects."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseek.functions.columns import once

NUMBER_TAGS = ("BIGINT", "DOUBLE", "FLOAT")


def with_variant(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name``: the text as a VARIANT if it is one JSON object, else null.

    Where an object repeats a key the last value wins; Spark reads that setting when a query is planned, so it is switched on for the session.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    out = df.withColumn(name, once(F.try_parse_json(F.col(text))))
    return out.withColumn(name, F.when(F.col(text).rlike(r"^\s*\{"), F.col(name)))


def path_of(field: str, literal: bool = False) -> str:
    """The variant path of a dotted field: nested, or (``literal``) one key that contains dots."""
    quote = lambda k: "['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return "$" + (quote(field) if literal else "".join(quote(k) for k in field.split(".")))


def at(v: Column, field: str) -> Column:
    """The value of a dotted field: the nested path, else the key that is literally so named. SQL NULL: missing."""
    nested = F.try_variant_get(v, path_of(field), "variant")
    return F.coalesce(nested, F.try_variant_get(v, path_of(field, literal=True), "variant")) if "." in field else nested


def tag(value: Column) -> Column:
    return F.schema_of_variant(value)


def is_number(t: Column) -> Column:
    return t.isin(*NUMBER_TAGS) | t.startswith("DECIMAL")


def type_name(value: Column) -> Column:
    """String, Float64, Boolean, Null, Object or Array; null where the value is missing."""
    t = tag(value)
    return (
        F.when(value.isNull(), None)
        .when(t == "VOID", "Null")
        .when(t == "STRING", "String")
        .when(is_number(t), "Float64")
        .when(t == "BOOLEAN", "Boolean")
        .when(t.startswith("OBJECT"), "Object")
        .when(t.startswith("ARRAY"), "Array")
    )


def read_as(value: Column, kind: str) -> Column:
    """The value if it has exactly that type (never coerced), else null. kind: string, double or boolean."""
    t = tag(value)
    right = {"string": t == "STRING", "double": is_number(t), "boolean": t == "BOOLEAN"}[kind]
    return F.when(right, F.try_variant_get(value, "$", kind))


def _brackets(schema: Column) -> Column:
    """A schema string's brackets alone: ``{`` and ``[`` open an object and an array, ``>`` closes either. Quoted names may hold any character."""
    bare = F.regexp_replace(schema, "`[^`]*`", "")
    return F.regexp_replace(F.replace(F.replace(bare, F.lit("OBJECT<"), F.lit("{")), F.lit("ARRAY<"), F.lit("[")), r"[^{\[>]", "")


def nesting(brackets: str) -> int:
    """Levels of objects; objects inside arrays don't count."""
    deepest, open_ = 0, ""
    for c in brackets:
        open_ = open_[:-1] if c == ">" else open_ + c
        if "[" not in open_:
            deepest = max(deepest, len(open_))
    return deepest


def _deepest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([max((nesting(s) for b in batches for s in b.column(0).to_pylist() if s), default=0)], pa.int32())], ["levels"])


def levels(df: DataFrame, v: str) -> int:
    """Levels of nested objects in the column, 1 for flat ones. Each distinct nesting is looked at once."""
    shapes = df.select(_brackets(F.schema_of_variant(v)).alias("s")).distinct()
    return max(1, shapes.mapInArrow(_deepest, "levels int").agg(F.max("levels")).first()[0] or 0)


def flatten(df: DataFrame, v: str, keep: list[str], depth: int | None = None) -> DataFrame:
    """One row per field of each record: (keep..., field, value); nested objects are walked to the last level, their parents are rows too.

    One lateral explode per level; how many there are is asked of the data first unless ``depth`` says so.
    """
    level = df.select(*keep, F.lit("").alias("_prefix"), F.col(v).alias("_v"))
    out = None
    for _ in range(levels(df, v) if depth is None else depth):
        rows = level.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_v").outer())).where("key is not null").select(*keep, F.concat("_prefix", "key").alias("field"), "value")
        out = rows if out is None else out.unionByName(rows)
        level = rows.where(F.schema_of_variant("value").startswith("OBJECT")).select(*keep, F.concat("field", F.lit(".")).alias("_prefix"), F.col("value").alias("_v"))
    return out
