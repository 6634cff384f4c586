"""Problem 1: rows that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.sources import rejects as R


def _load(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return R.load(spark.read.parquet(f"{d}/index_dump.parquet"), "line_id", "raw_line", R.DUMP_SHAPES)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _load(spark, d)[1].select("line_id")


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines with raw text and the reason."""
    return _load(spark, d)[1]


#: Reasons that don't come from the CSV reader.
PLAIN_REASONS = ("null line", "blank line", "unbalanced quotes")


def p1_reject_classes(spark: SparkSession, d: str) -> DataFrame:
    """Rejected lines with raw text and the class of the reason; all that the reader or the grammar rejects is ``malformed``."""
    reason = F.col("reason")
    return _load(spark, d)[1].select("line_id", "raw", F.when(reason.isin(*PLAIN_REASONS), reason).otherwise("malformed").alias("class"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    """Typed rows of all valid lines."""
    return _load(spark, d)[0]


QUERIES = {"p1_found": p1_found, "p1_records": p1_records, "p1_rejects": p1_rejects, "p1_reject_classes": p1_reject_classes}

_TEXT, _WHOLE = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)', r'(?:[0-9]+|"[0-9]+")'
_META = ",".join(['(?:M|"M")', *[_WHOLE] * 5])
_POINTER = ",".join(['(?:P|"P")', _WHOLE, _TEXT, _WHOLE, _WHOLE, _WHOLE, _TEXT])
_CAPTURE_P = ",".join(['(?:P|"P")', f"({_WHOLE})", f"({_TEXT})", f"({_WHOLE})", f"({_WHOLE})", f"({_WHOLE})", f"({_TEXT})"])


def _num(x: str) -> str:
    return f"try_cast(replace({x}, '\"', '') as hugeint)"


def _unquote(x: str) -> str:
    return f"case when starts_with({x}, '\"') then replace({x}[2:-2], '\"\"', '\"') else {x} end"


_VALID = f"""
with l as (select line_id, case when raw_line like '%' || chr(13) then raw_line[1:-2] else raw_line end r from index_dump),
m as (select line_id, string_split(replace(r, '"', ''), ',') f from l where regexp_full_match(r, '{_META}')),
p as (select line_id, regexp_extract(r, '^{_CAPTURE_P}$', ['a', 'b', 'c', 'd', 'e', 'g'], 's') f from l where regexp_full_match(r, '{_POINTER}', 's')),
valid as (
  select line_id, 'M' kind, {_num("f[2]")} file_id, {_num("f[3]")} version, {_num("f[4]")} format, {_num("f[5]")} read_offset, {_num("f[6]")} entries,
         null::varchar field_name, null::hugeint field_type, null::hugeint "offset", null::hugeint length, null::varchar "value" from m
  union all
  select line_id, 'P', {_num("f['a']")}, null, null, null, null, {_unquote("f['b']")}, {_num("f['c']")}, {_num("f['d']")}, {_num("f['e']")}, {_unquote("f['g']")} from p),
good as (select * from valid where file_id <= 18446744073709551615 and (kind = 'P' or (version <= 255 and format <= 1 and read_offset <= 18446744073709551615 and entries <= 18446744073709551615))
  and (kind = 'M' or (field_type <= 11 and "offset" <= 18446744073709551615 and length between 1 and 4294967295)))
"""
SQL = {
    "p1_found": _VALID + " select line_id from index_dump where line_id not in (select line_id from good)",
    "p1_records": _VALID + " select line_id, kind, file_id::decimal(20,0) file_id, version::int version, format::int format, read_offset::decimal(20,0) read_offset, entries::decimal(20,0) entries, field_name, field_type::int field_type, \"offset\"::decimal(20,0) \"offset\", length::bigint length, \"value\" from good",
    "p1_reject_classes": _VALID
    + """ select line_id, raw_line raw, case when raw_line is null then 'null line' when regexp_full_match(r, '\\s*', 's') then 'blank line'
    when length(replace(r, '"', '')) % 2 <> length(r) % 2 then 'unbalanced quotes' else 'malformed' end as "class"
    from index_dump join l using (line_id) where line_id not in (select line_id from good)""",
}
