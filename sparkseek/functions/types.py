"""Field types: one per value, not per column."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal
from enum import IntEnum

from pyspark.sql import types as T


class FieldType(IntEnum):
    # The codes of the file format.
    String = 0
    Int64 = 1
    Uint64 = 2
    Float64 = 3
    Object = 4
    Array = 5
    Boolean = 6
    Null = 7
    Trigram = 8
    Bigram = 9
    Unigram = 10
    Vector = 11


NUMBERS = frozenset({FieldType.Float64, FieldType.Int64, FieldType.Uint64})
GRAMS = {1: FieldType.Unigram, 2: FieldType.Bigram, 3: FieldType.Trigram}

#: Bytes of an index key by type, 0 where it varies (fixed values).
WIDTH = {FieldType.Int64: 9, FieldType.Uint64: 9, FieldType.Float64: 9, FieldType.Boolean: 2, FieldType.Null: 1, FieldType.Trigram: 4, FieldType.Bigram: 3, FieldType.Unigram: 2}


def field_type_name(t: FieldType) -> str:
    return FieldType(t).name


def literal_type(value) -> FieldType:
    """The type a literal is compared as; every number is a Float64, times are ISO strings."""
    if value is None:
        return FieldType.Null
    if isinstance(value, bool):
        return FieldType.Boolean
    if isinstance(value, (int, float, Decimal)):
        return FieldType.Float64
    if isinstance(value, (str, dt.date, dt.datetime)):
        return FieldType.String
    raise TypeError(f"a literal of type {type(value).__name__} can't be compared with any field")


def literal_value(value):
    """The literal as Spark compares it: numbers as double, times as ISO-8601 text."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%S.%f")
    if isinstance(value, dt.date):
        return value.isoformat()
    return float(value)


def of_spark(t: T.DataType) -> FieldType:
    """The field type of a Spark column."""
    if isinstance(t, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)):
        return FieldType.String
    if isinstance(t, T.NumericType):
        return FieldType.Float64
    if isinstance(t, T.BooleanType):
        return FieldType.Boolean
    if isinstance(t, (T.StructType, T.MapType, T.VariantType)):
        return FieldType.Object
    if isinstance(t, T.ArrayType):
        return FieldType.Vector if isinstance(t.elementType, (T.FloatType, T.DoubleType)) else FieldType.Array
    return FieldType.Null


#: DDL of a field type where a schema is wanted.
DDL = {FieldType.String: "STRING", FieldType.Int64: "BIGINT", FieldType.Uint64: "DECIMAL(20,0)", FieldType.Float64: "DOUBLE", FieldType.Object: "VARIANT", FieldType.Array: "VARIANT", FieldType.Boolean: "BOOLEAN", FieldType.Null: "VOID", FieldType.Vector: "ARRAY<FLOAT>"}


def ddl_of(types: list[FieldType]) -> str:
    """DDL type of a field with these types: the one value type it has, else VARIANT; n-gram types and Null don't count."""
    real = {t for t in types if t not in GRAMS.values() and t is not FieldType.Null}
    return DDL[real.pop()] if len(real) == 1 else "VARIANT" if real else "VOID"
