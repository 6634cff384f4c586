"""Schemas that drift between files: profiles, matching between versions, change rows, one unified table.

``catalog``   (file_id, field_name, field_pos, types): the fields of each file, names dotted, types in canonical names.
``versions``  (file_id, series, seq).

Each file is compared with the one before it in its series. Fields whose names are in both are the same field; among the others, gone
and new names are matched: an edge needs equal types, its weight comes from value profiles, name similarity and place, and a maximum
weight bipartite matching per pair of files picks the renames.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseek.functions import variants as V
from sparkseek.runtime import broadcast_if_small, materialize

#: Types that say nothing about a field's content (fixed values).
UNTYPED = ("Null", "Unigram", "Bigram", "Trigram")
SKETCH_LOG_ENTRIES = 9
MAX_NAMES = 200_000
#: Weights of an edge (they add up to 1 with BASE): the smallest weight counts as sure of nothing but the types.
BASE, PLACE, NAME, VALUE = 0.05, 0.35, 0.3, 0.3
#: Matched edges below it are no renames: place alone with a trace of likeness suffices, a likeness of name or values alone does not.
LEAST = 0.5


def type_catalog(index_meta: DataFrame, field_types: DataFrame) -> DataFrame:
    """Catalog of an index-meta log whatever its notation (code, name or tag of the type; ``$.`` before names). Repeated rows count once.

    Rows without file, name or position are left out; unknown types stay as written.
    """
    names = field_types.select(F.explode(F.array(F.col("type_code").cast("string"), "type_name", "type_tag")).alias("field_type"), F.col("type_name").alias("_type")).distinct()
    rows = index_meta.where("file_id is not null and field_name is not null and field_pos is not null").select("file_id", F.regexp_replace("field_name", r"^\$\.", "").alias("field_name"), "field_pos", "field_type")
    typed = rows.join(broadcast_if_small(names), "field_type", "left").select("file_id", "field_name", "field_pos", F.coalesce("_type", "field_type").alias("t"))
    return typed.groupBy("file_id", "field_name").agg(F.min("field_pos").alias("field_pos"), F.array_sort(F.collect_set(F.when(~F.col("t").isin(*UNTYPED), F.col("t")))).alias("types"))


def _names_similar(a: Column, b: Column) -> Column:
    """0 to 1: edit similarity of the last name parts in lower case without separators, or containment."""
    x, y = (F.regexp_replace(F.lower(F.element_at(F.split(c, r"\."), -1)), "[^a-z0-9]", "") for c in (a, b))
    longest = F.greatest(F.length(x), F.length(y), F.lit(1))
    return F.greatest(1 - F.levenshtein(x, y) / longest, F.when(x.contains(y) | y.contains(x), F.least(F.length(x), F.length(y)) / longest).otherwise(0.0))


def best_matching(weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """Maximum-weight bipartite matching of (gone, new) -> weight > 0 by successive best augmenting paths; ties fall to the smaller names."""
    left, right = sorted({a for a, _ in weights}), sorted({b for _, b in weights})
    n = max(len(left), len(right))
    cost = [[-weights.get((left[i], right[j]), 0.0) if i < len(left) and j < len(right) else 0.0 for j in range(n)] for i in range(n)]
    u, v, owner = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)  # column n is the free start column, row n none
    for i in range(n):
        owner[n], j = i, n
        slack, back, seen = [float("inf")] * n, [n] * n, [False] * (n + 1)
        while True:
            seen[j], row = True, owner[j]
            for k in range(n):
                if not seen[k] and (gap := cost[row][k] - u[row] - v[k]) < slack[k]:
                    slack[k], back[k] = gap, j
            step, nxt = min((slack[k], k) for k in range(n) if not seen[k])
            for k in range(n + 1):
                if seen[k]:
                    u[owner[k]] += step
                    v[k] -= step
                elif k < n:
                    slack[k] -= step
            j = nxt
            if owner[j] == n:
                break
        while j != n:
            owner[j], j = owner[back[j]], back[j]
    return sorted((left[owner[j]], right[j]) for j in range(len(right)) if owner[j] < len(left) and (left[owner[j]], right[j]) in weights)


def _match_group(edges: pd.DataFrame) -> pd.DataFrame:
    pairs = best_matching({(a, b): w for a, b, w in zip(edges["gone"], edges["new"], edges["weight"])})
    return pd.DataFrame({"file_id": [edges["file_id"].iloc[0]] * len(pairs), "gone": [a for a, _ in pairs], "new": [b for _, b in pairs]})


def _profiles(values: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file_id, field, sketch, shapes, len, log): distinct values and distinct shapes (digits and letters of each value without regard to
    which) as theta sketches, mean length, mean logarithm of numbers."""
    text = F.lower(F.to_json("value"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\d", "9"), r"\p{L}", "a"), r"(.)\1{2,}", "$1$1+")
    number = V.read_as(F.col("value"), "double")
    rows = values.join(broadcast_if_small(wanted), ["file_id", "field"]).where(~F.is_variant_null("value"))
    return rows.groupBy("file_id", "field").agg(
        F.theta_sketch_agg(text, F.lit(SKETCH_LOG_ENTRIES)).alias("sketch"),
        F.theta_sketch_agg(shape, F.lit(SKETCH_LOG_ENTRIES)).alias("shapes"),
        F.avg(F.length(text)).alias("len"),
        F.avg(F.log1p(F.abs(number))).alias("log"),
    )


class Drift:
    """The comparison of every file with the one before it.

    ``values`` (file_id, field, value VARIANT), if given, adds value profiles to the weights. ``stated`` edges are those between the same
    two neighbours (or file edges), both present in both files. ``anchored``: each of them outweighs any two others (a field has at most
    one), and only they are renames; without it place is one weight among others, and a rename needs ``least`` in all.
    """

    def __init__(self, catalog: DataFrame, versions: DataFrame, values: DataFrame | None = None, anchored: bool = True, least: float = LEAST):
        self.values, self.anchored, self.least = values, anchored, least
        place = Window.partitionBy("file_id").orderBy("field_pos", "field_name")
        fields = catalog.withColumns({"left": F.lag("field_name").over(place), "right": F.lead("field_name").over(place)})
        order = Window.partitionBy("series").orderBy("seq", "file_id")
        steps = versions.where("file_id is not null and series is not null and seq is not null").withColumn("before", F.lag("file_id").over(order)).where("before is not null").select("file_id", "before")
        names = fields.groupBy("file_id").agg(F.collect_set("field_name").alias("names"))
        here = fields.join(steps, "file_id").select("file_id", "field_name", F.struct("types", "left", "right").alias("now"))
        back = steps.join(fields.withColumnRenamed("file_id", "before"), "before").select("file_id", "field_name", F.struct("types", "left", "right").alias("was"))
        self.compared = materialize(here.join(back, ["file_id", "field_name"], "full"), "compared")  # read several times
        self.names = steps.join(names, "file_id", "left").join(names.select(F.col("file_id").alias("before"), F.col("names").alias("old_names")), "before", "left")
        self._edges: DataFrame | None = None

    def edges(self) -> DataFrame:
        """(file_id, before, gone, new, stated, weight) of all pairs of a gone and a new field with the same types."""
        if self._edges is None:
            self._edges = materialize(self._weighed(), "edges")
        return self._edges

    def _weighed(self) -> DataFrame:
        one = self.compared.where("was is null or now is null")
        gone = one.where("now is null").select("file_id", F.col("field_name").alias("gone"), F.col("was.types").alias("types"), F.col("was.left").alias("gl"), F.col("was.right").alias("gr"))
        new = one.where("was is null").select("file_id", F.col("field_name").alias("new"), F.col("now.types").alias("types"), F.col("now.left").alias("nl"), F.col("now.right").alias("nr"))
        pairs = gone.join(new, ["file_id", "types"]).join(self.names, "file_id")
        both = lambda c: F.col(c).isNull() | (F.array_contains("names", F.col(c)) & F.array_contains("old_names", F.col(c)))
        left, right = F.col("gl").eqNullSafe(F.col("nl")) & both("gl"), F.col("gr").eqNullSafe(F.col("nr")) & both("gr")
        pairs = pairs.select("file_id", "before", "gone", "new", (left & right).alias("stated"), ((left.cast("double") + right.cast("double")) / 2).alias("place"), _names_similar(F.col("gone"), F.col("new")).alias("name"))
        if self.values is None:
            value = F.lit(0.0)
        else:
            pairs = materialize(pairs, "pairs")
            wanted = pairs.select(F.col("before").alias("file_id"), F.col("gone").alias("field")).union(pairs.select("file_id", F.col("new").alias("field"))).distinct()
            profiles = materialize(_profiles(self.values, wanted), "profiles")
            of = lambda p, f, k: profiles.select(F.col("file_id").alias(f), F.col("field").alias(k), *(F.col(c).alias(f"{p}_{c}") for c in ("sketch", "shapes", "len", "log")))
            pairs = pairs.join(broadcast_if_small(of("g", "before", "gone")), ["before", "gone"], "left").join(broadcast_if_small(of("n", "file_id", "new")), ["file_id", "new"], "left")
            size = F.theta_sketch_estimate
            shared = lambda c: size(F.theta_intersection(f"g_{c}", f"n_{c}")) / F.greatest(F.least(size(f"g_{c}"), size(f"n_{c}")), F.lit(1))
            near = lambda c: F.least(f"g_{c}", f"n_{c}") / F.greatest(f"g_{c}", f"n_{c}", F.lit(1e-9))
            value = F.coalesce((shared("sketch") + shared("shapes") + F.coalesce((near("len") + near("log")) / 2, near("len"))) / 3, F.lit(0.0))
        weight = BASE + PLACE * F.col("place") + NAME * F.col("name") + VALUE * value
        return pairs.select("file_id", "before", "gone", "new", "stated", weight.alias("weight"))

    def matched(self, settled: DataFrame | None = None) -> DataFrame:
        """(file_id, gone, new, stated, weight): the matching. Groups are the candidate edges of one pair of files, bounded by the files' own widths.

        ``settled`` (file_id, gone, new): renames that stand already; neither of their fields is matched again.
        """
        edges = self.edges()
        if settled is not None:
            for end in ("gone", "new"):
                edges = edges.join(broadcast_if_small(settled.select("file_id", end)), ["file_id", end], "left_anti")
        rank = F.col("weight") + F.when(F.col("stated"), F.lit(2.0 if self.anchored else 0.0)).otherwise(0.0)
        pairs = edges.select("file_id", "gone", "new", rank.alias("weight")).groupBy("file_id").applyInPandas(_match_group, "file_id long, gone string, new string")
        return pairs.join(edges, ["file_id", "gone", "new"]).select("file_id", "gone", "new", "stated", "weight")

    def renames(self, settled: DataFrame | None = None) -> DataFrame:
        """(file_id, gone, new): matched edges that are stated (``anchored``), or weigh at least ``least``."""
        return materialize(self.matched(settled).where("stated" if self.anchored else F.col("weight") >= self.least).select("file_id", "gone", "new"), "renames")

    def changes(self) -> DataFrame:
        """(file_id, field_name, drift, old_name): retyped, renamed, added and removed fields of every file that has one before it."""
        renames = self.renames()
        new = renames.select("file_id", F.col("new").alias("field_name"), F.col("gone").alias("old_name"))
        old = renames.select("file_id", F.col("gone").alias("field_name"), F.lit(True).alias("moved"))
        kind = (
            F.when(F.col("was").isNull(), F.when(F.col("old_name").isNotNull(), "renamed").otherwise("added"))
            .when(F.col("now").isNull(), F.when(F.col("moved").isNull(), "removed"))
            .when(F.col("was.types") != F.col("now.types"), "retyped")
        )
        changed = self.compared.where("was is null or now is null or was.types != now.types")
        return changed.join(broadcast_if_small(new), ["file_id", "field_name"], "left").join(broadcast_if_small(old), ["file_id", "field_name"], "left").withColumn("drift", kind).where("drift is not null").select("file_id", "field_name", "drift", "old_name")


def _together(catalog: DataFrame, names: set[str]) -> dict[str, set[str]]:
    """Of ``names``, those that occur with each one in some file. Files repeat few layouts: what reaches the driver is each distinct set of names once."""
    wanted = F.broadcast(catalog.sparkSession.createDataFrame([(n,) for n in sorted(names)], "field_name string"))  # at most MAX_NAMES
    layouts = catalog.join(wanted, "field_name").groupBy("file_id").agg(F.array_sort(F.collect_set("field_name")).alias("names")).select("names").distinct()
    beside: dict[str, set[str]] = {}
    for r in layouts.toLocalIterator():
        for n in r["names"]:
            beside.setdefault(n, set()).update(r["names"])
    for n, others in beside.items():
        others.discard(n)
    return beside


def canonical_names(catalog: DataFrame, renames: DataFrame, certain: DataFrame | None = None) -> dict[str, list[str]]:
    """canonical name -> its names, most used first. Names that renames connect are one column, unless a file has both.

    The renames of ``certain`` connect first, so that none of ``renames`` stands in their way. Works on distinct names, not on files: a
    table has one column for each, so a schema with more than MAX_NAMES of them is an error.
    """
    uses = {r["field_name"]: r["n"] for r in catalog.groupBy("field_name").agg(F.count("*").alias("n")).limit(MAX_NAMES + 1).collect()}
    if len(uses) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} distinct field names: not one table")
    every = renames.select("gone", "new", F.lit(False).alias("sure"))
    if certain is not None:
        every = every.union(certain.select("gone", "new", F.lit(True)))
    pairs = every.groupBy("gone", "new").agg(F.max("sure").alias("sure"), F.count("*").alias("n")).toLocalIterator()
    ordered = [(a, b) for _, _, a, b in sorted((not r["sure"], -r["n"], *sorted((r["gone"], r["new"]))) for r in pairs)]
    beside = _together(catalog, {n for p in ordered for n in p}) if ordered else {}
    group = {n: {n} for n in uses}
    apart = {n: set(beside.get(n, ())) for n in uses}  # names no group with n may take in
    for a, b in ordered:
        x, y = group.get(a), group.get(b)
        if x is None or y is None or x is y or not apart[a].isdisjoint(y):
            continue
        if len(x) < len(y):
            x, y = y, x
        stay = apart[next(iter(x))]
        stay |= apart[next(iter(y))]
        x |= y
        for n in x:
            group[n], apart[n] = x, stay
    done: dict[str, list[str]] = {}
    for names in {id(g): g for g in group.values()}.values():
        ranked = sorted(names, key=lambda n: (-uses[n], n))
        done[ranked[0]] = ranked
    return dict(sorted(done.items()))


def unify(records: DataFrame, v: str, names: dict[str, list[str]], types: dict[str, Iterable[str]], keep: list[str]) -> DataFrame:
    """One typed column per canonical name, filled from whichever of its names a record has; a projection without any shuffle.

    A column is double or boolean where every file says so, otherwise string: text as it is, anything else as JSON text. Objects are
    left out, since their fields are columns of their own; dots become ``__``; a name that clashes with ``keep`` gets a trailing ``_``.
    """
    cols = []
    for canonical, alternatives in names.items():
        kinds = set(types.get(canonical, ())) - set(UNTYPED)
        if kinds == {"Object"}:
            continue
        value = F.coalesce(*(V.at(F.col(v), n) for n in alternatives))
        if kinds == {"Float64"}:
            col = V.read_as(value, "double")
        elif kinds == {"Boolean"}:
            col = V.read_as(value, "boolean")
        else:
            col = F.when(value.isNull() | F.is_variant_null(value), None).when(V.tag(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
        name = canonical.replace(".", "__")
        while name.lower() in {n.lower() for n in [*keep, *(n for _, n in cols)]}:
            name += "_"
        cols.append((col, name))
    return records.select(*keep, *(c.alias(n) for c, n in cols))
