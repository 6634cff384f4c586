"""Problem 2: schemas that drift between files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.functions import variants as V
from sparkseek.operators import drift as D
from sparkseek.runtime import materialize


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    read = lambda t: spark.read.parquet(f"{d}/{t}.parquet")
    catalog = materialize(D.type_catalog(read("index_meta"), read("field_types")), "catalog")
    versions = read("data_files").where(F.col("series").startswith("permits-")).select("file_id", "series", "seq")
    return catalog, versions, V.with_variant(read("permits"), "json_line", "v")


def _values(permits: DataFrame) -> DataFrame:
    return V.flatten(permits, "v", ["file_id"])


def p2_method(spark: SparkSession, d: str) -> DataFrame:
    """The matching by profiles over all files, no rule on places: (file_id, gone, new, weight, stated); ``stated``: whether the rule of ``p2_found`` holds too."""
    catalog, versions, permits = _inputs(spark, d)
    drift = D.Drift(catalog, versions, _values(permits), anchored=False)
    return drift.matched().where(F.col("weight") >= drift.least).select("file_id", "gone", "new", "weight", "stated")


def p2_quality(spark: SparkSession, d: str) -> DataFrame:
    """How well ``p2_method`` finds the stated renames: their number, and whether recall and precision reach 0.95."""
    catalog, versions, permits = _inputs(spark, d)
    drift = D.Drift(catalog, versions, _values(permits), anchored=False)
    found = drift.matched().where(F.col("weight") >= drift.least).agg(F.count("*").alias("found"), F.count(F.when(F.col("stated"), 1)).alias("hit"))
    stated = drift.edges().agg(F.count(F.when(F.col("stated"), 1)).alias("stated"))
    return stated.crossJoin(F.broadcast(found)).select("stated", (F.col("hit") >= 0.95 * F.col("stated")).alias("recall_reached"), (F.col("hit") >= 0.95 * F.col("found")).alias("precision_reached"))  # two single rows


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    catalog, versions, permits = _inputs(spark, d)
    return D.Drift(catalog, versions, _values(permits), anchored=True).changes().select("file_id", "field_name", "drift")


def unified_names(catalog: DataFrame, versions: DataFrame, permits: DataFrame) -> dict[str, list[str]]:
    """canonical name -> its names: the renames of ``p2_found`` for certain, and what content matches among the fields they leave."""
    likely = D.Drift(catalog, versions, _values(permits), anchored=False)
    certain = materialize(likely.edges().where("stated").select("file_id", "gone", "new"), "certain")  # at most one a field: they are their own matching
    return D.canonical_names(catalog, likely.renames(certain), certain)


def p2_columns(spark: SparkSession, d: str) -> DataFrame:
    """Every stated rename: (file_id, gone, new, one_column), whether both names fill one column of the unified table."""
    catalog, versions, permits = _inputs(spark, d)
    of = {n: c for c, names in unified_names(catalog, versions, permits).items() for n in names}
    table = F.broadcast(spark.createDataFrame(sorted(of.items()), "name string, col string"))  # at most D.MAX_NAMES rows
    stated = D.Drift(catalog, versions, anchored=True).renames()
    both = stated.join(table.toDF("gone", "gone_col"), "gone").join(table.toDF("new", "new_col"), "new")
    return both.select("file_id", "gone", "new", (F.col("gone_col") == F.col("new_col")).alias("one_column"))


def p2_filled(spark: SparkSession, d: str) -> DataFrame:
    """(rec_id, filled): how many columns of the unified table each record fills; no value of a record may get lost."""
    table = p2_unified(spark, d)
    mine = [c for c in table.columns if c not in ("rec_id", "file_id", "rec_offset")]
    filled = F.lit(0)
    for c in mine:
        filled = filled + F.col(f"`{c}`").isNotNull().cast("int")
    return table.select("rec_id", filled.cast("long").alias("filled"))


def p2_unified(spark: SparkSession, d: str) -> DataFrame:
    """All records as one consistent table: each record once (rows delivered twice: the first arrival), renamed fields in one column."""
    catalog, versions, permits = _inputs(spark, d)
    names = unified_names(catalog, versions, permits)
    of = {n: c for c, all_names in names.items() for n in all_names}
    kinds = catalog.select("field_name", F.explode("types").alias("t")).distinct().collect()
    types: dict[str, set] = {}
    for r in kinds:
        types.setdefault(of[r["field_name"]], set()).add(r["t"])
    raw = spark.read.parquet(f"{d}/permits.parquet").groupBy("rec_id").agg(F.min_by(F.struct("file_id", "rec_offset", "json_line"), F.struct("arrived_at", "file_id", "rec_offset")).alias("r")).select("rec_id", "r.*")
    return D.unify(V.with_variant(raw, "json_line", "v"), "v", names, types, ["rec_id", "file_id", "rec_offset"])


QUERIES = {"p2_method": p2_method, "p2_found": p2_found, "p2_unified": p2_unified, "p2_quality": p2_quality, "p2_columns": p2_columns, "p2_filled": p2_filled}

_RENAMED = """
with n as (select type_code::varchar k, type_name from field_types union select type_name, type_name from field_types union select type_tag, type_name from field_types),
f as (select file_id, regexp_replace(field_name, '^\\$\\.', '') name, min(field_pos) pos,
             list_sort(list(distinct coalesce(n.type_name, field_type)) filter (coalesce(n.type_name, field_type) not in ('Null', 'Unigram', 'Bigram', 'Trigram'))) types
      from index_meta left join n on n.k = field_type group by 1, 2),
g as (select *, coalesce(types, []) t, lag(name) over w l, lead(name) over w r from f window w as (partition by file_id order by pos, name)),
s as (select file_id, lag(file_id) over (partition by series order by seq) prev from data_files where series like 'permits-%'),
now as (select s.file_id, prev, name, t, l, r from s join g using (file_id) where prev is not null),
was as (select s.file_id, prev, name, t, l, r from s join g on g.file_id = s.prev),
new as (select * from now where not exists (select 1 from was where was.file_id = now.file_id and was.name = now.name)),
gone as (select * from was where not exists (select 1 from now where now.file_id = was.file_id and now.name = was.name)),
ren as (select new.file_id, new.name a, gone.name b from new join gone using (file_id, t)
        where new.l is not distinct from gone.l and new.r is not distinct from gone.r
          and (new.l is null or exists (select 1 from was where was.file_id = new.file_id and was.name = new.l) and exists (select 1 from now where now.file_id = new.file_id and now.name = new.l))
          and (new.r is null or exists (select 1 from was where was.file_id = new.file_id and was.name = new.r) and exists (select 1 from now where now.file_id = new.file_id and now.name = new.r)))
"""
SQL = {
    "p2_found": _RENAMED
    + """
select now.file_id, now.name field_name, 'retyped' drift from now join was using (file_id, name) where now.t <> was.t
union all select file_id, a, 'renamed' from ren
union all select file_id, name, 'added' from new where (file_id, name) not in (select file_id, a from ren)
union all select file_id, name, 'removed' from gone where (file_id, name) not in (select file_id, b from ren)
""",
    "p2_quality": _RENAMED + "select count(*) stated, true recall_reached, true precision_reached from ren",
    "p2_columns": _RENAMED
    + """, apart as (select distinct x.name a, y.name b from f x join f y using (file_id))
select file_id, b gone, a as "new", (a, b) not in (select a, b from apart) one_column from ren""",
    "p2_filled": """
with r as (select rec_id, json_line j from permits qualify row_number() over (partition by rec_id order by arrived_at, file_id, rec_offset) = 1),
k as (select rec_id, '$."' || k || '"' p, j from (select rec_id, j, unnest(json_keys(j)) k from r where json_type(j) = 'OBJECT')),
t as (select rec_id, p, j, json_type(j, p) t from k),
n as (select rec_id, json_type(j, p || '."' || x || '"') t from (select rec_id, p, j, unnest(json_keys(j, p)) x from t where t = 'OBJECT'))
select r.rec_id, count(*) filter (t not in ('NULL', 'OBJECT')) filled from r left join (select rec_id, t from t union all select rec_id, t from n) u using (rec_id) group by 1""",
}
