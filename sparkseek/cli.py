"""Command line: ``sparkseek (-jsonl | -csv) [-i TABLE] [-s FIELD]... [-sort FIELD] [-t] [-b FILE] [-pprof FILE] [-debug] DATA`` or ``-f FILE.jsonl``.

Prints a file's fields with their types; ``-i``: keeps it as a stored table, to which each call adds only what is new; ``-s``: search fields,
whose n-gram postings are stored too; ``-sort``: a field to sort the table's parts by; ``-t``: print timings; ``-b``: write the table's parts
with rows, bytes and seconds as JSON lines; ``-pprof``: write a profile of the driver; ``-debug``: log all of Spark and explain the plan;
``-f``: turn a JSONL file into one pretty JSON array beside it.
"""

from __future__ import annotations

import argparse
import cProfile
import json
import sys
import time

from pyspark.sql import SparkSession

from sparkseek.plans.database import Database
from sparkseek.sources import store


def jsonl_to_json(path: str) -> str:
    """Write a JSONL file as one JSON array, streaming line by line; gives the new path."""
    out = path.removesuffix(".jsonl") + ".json"
    with open(path, encoding="utf-8") as src, open(out, "w", encoding="utf-8") as dst:
        dst.write("[")
        for i, line in enumerate(x for x in src if x.strip()):
            text = json.dumps(json.loads(line), indent=2, ensure_ascii=False).replace("\n", "\n  ")
            dst.write(("," if i else "") + "\n  " + text)
        dst.write("\n]\n")
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sparkseek", description=__doc__)
    kind = p.add_mutually_exclusive_group(required=True)
    kind.add_argument("-jsonl", action="store_true")
    kind.add_argument("-csv", action="store_true")
    kind.add_argument("-f", metavar="FILE.jsonl")
    p.add_argument("-i", metavar="TABLE")
    p.add_argument("-s", metavar="FIELD", action="append", default=[])
    p.add_argument("-sort", metavar="FIELD")
    p.add_argument("-t", action="store_true")
    p.add_argument("-b", metavar="FILE")
    p.add_argument("-pprof", metavar="FILE")
    p.add_argument("-debug", action="store_true")
    p.add_argument("data", nargs="?")
    a = p.parse_args(argv)
    if a.f:
        print(jsonl_to_json(a.f))
        return 0
    if not a.data:
        p.error("DATA is missing")
    if a.b and not a.i:
        p.error("-b needs a table (-i)")
    profile = cProfile.Profile()
    began = time.time()
    if a.pprof:
        profile.enable()
    run(a)
    if a.pprof:
        profile.disable()
        profile.dump_stats(a.pprof)
    if a.t:
        print(f"{time.time() - began:.1f} s", file=sys.stderr)
    return 0


def run(a: argparse.Namespace) -> None:
    spark = SparkSession.builder.appName("sparkseek").getOrCreate()
    if a.debug:
        spark.sparkContext.setLogLevel("DEBUG")
    kind = "jsonl" if a.jsonl else "csv"
    if a.i:
        state = store.sync(spark, a.data, a.i, kind, tuple(a.s), a.sort)
        if a.b:
            with open(a.b, "w") as f:
                f.writelines(json.dumps(part) + "\n" for part in state["parts"])
    db = Database.open(a.i or a.data, spark=spark, format=kind, search_fields=tuple(a.s))
    if a.debug:
        db.df().explain("formatted")
    for field, types in db.fields().items():
        print(field, ", ".join(t.name for t in types))


if __name__ == "__main__":
    sys.exit(main())
