"""Problems 3 and 5: distinctive terms, term frequencies."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import parsimony as P
from sparkseek.llm.terms import TermCounts, record_terms
from sparkseek.runtime import fresh_path, materialize


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/tokens.parquet")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return P.scores(record_terms(_tokens(spark, d)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms with specific mass left after EM; then the exact check of the counts."""
    return _scores(spark, d).where("score > 0").where("tf >= 2 and 10 * tf >= record_words and df between 2 and 12").select("rec_id", "word")


def p3_method(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every record with its score, by EM over the whole table."""
    return _scores(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    store = TermCounts(spark, fresh_path(spark, "term-counts"))
    store.update(after=materialize(record_terms(_tokens(spark, d)), "terms"))
    return store.marked().where("mark is not null").select("word", "mark")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """All counts after three increments: most records, some of them in an older state, and some that don't belong; the changes and the late records; the removals."""
    tokens = _tokens(spark, d)
    store = TermCounts(spark, fresh_path(spark, "term-counts"))
    now = materialize(record_terms(tokens), "terms")
    changed, late, wrong = F.col("rec_id") % 5 == 0, F.col("rec_id") % 7 == 0, F.col("rec_id") % 11 == 0
    older = materialize(record_terms(tokens.where(changed & ~late & (F.col("tok_offset") < 40))), "terms-older")
    alien = materialize(now.where(wrong).withColumn("rec_id", -F.col("rec_id") - 1), "terms-alien")
    store.update(after=now.where(~changed & ~late).unionByName(older).unionByName(alien))
    store.update(before=older, after=now.where(changed | late))
    store.update(before=alien)
    return store.marked()


QUERIES = {"p3_method": p3_method, "p3_found": p3_found, "p5_found": p5_found, "p5_counts": p5_counts}


def _ascii_of() -> dict[str, str]:
    """Characters beyond ASCII whose compatibility decomposition has ASCII letters or digits, with these."""
    found = ((chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if x.isascii() and x.isalnum())) for r in (range(0xA0, 0xD800), range(0xF900, 0x10000), range(0x1D400, 0x1D800)) for c in r)
    return {c: a for c, a in found if a}


def _terms_sql() -> str:
    table = _ascii_of()
    pairs = f"map([{', '.join(repr(c) for c in table)}], [{', '.join(repr(a) for a in table.values())}])"
    return f"""with m as (select {pairs} m),
    w as (select distinct word from tokens where word is not null),
    n as (select word raw, lower(regexp_replace(case when regexp_full_match(word, '[\\x00-\\x7f]*', 's') then word else array_to_string(list_transform(string_split(word, ''), lambda c: coalesce(m.m[c], c)), '') end, '[^A-Za-z0-9]', '', 'g')) word from w, m),
    o as (select rec_id, tok_offset, min(n.word) word from tokens t join n on t.word = n.raw where n.word <> '' and rec_id is not null group by all),
    t as (select rec_id, word, count(*) tf from o group by all),
    s as (select word, sum(tf)::bigint occurrences, count(*) records from t group by 1),
    l as (select rec_id, sum(tf) len from t group by 1), r as (select count(*) n from l),
    c as (select word, occurrences, records, case when records < 3 then 'rare' when records > 0.2 * r.n then 'common' end mark from s, r)
    """


SQL = {
    "p3_found": _terms_sql() + "select rec_id, word from t join s using (word) join l using (rec_id) where tf >= 2 and 10 * tf >= len and records between 2 and 12",
    "p5_found": _terms_sql() + "select word, mark from c where mark is not null",
    "p5_counts": _terms_sql() + "select word, occurrences, records, mark from c",
}
