"""Lookups with rules of their own: ids by exact match or unique prefix, notes' paths without collisions, orders with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def resolved(requests: DataFrame, request: str, known: DataFrame, least_prefix: int = 4) -> DataFrame:
    """request, id, source, problem: an id that matches exactly (of several sources the first), else the only one that
    the request is a prefix of; `ambiguous` or `unknown` otherwise. known: id, source, rank of the source.

    Prefixes are met by equality on the first characters, so this is no cross join.
    """
    first = lambda c: F.substring(c, 1, least_prefix)
    asked = requests.select(F.col(request).alias("q")).distinct().withColumn("head", first("q"))
    near = asked.join(known.withColumn("head", first("id")), "head").where(F.col("id").startswith(F.col("q")))
    exact = F.min(F.when(F.col("id") == F.col("q"), F.struct("rank", "source", "id")))
    found = near.groupBy("q").agg(exact.alias("e"), F.count_distinct("id").alias("n"), F.min(F.struct("rank", "source", "id")).alias("p"))
    one = F.coalesce("e", F.when(F.col("n") == 1, F.col("p")))
    out = asked.join(found, "q", "left")
    problem = F.when(one.isNotNull(), None).when(F.col("n") > 1, "ambiguous").otherwise("unknown")
    return out.select(F.col("q").alias(request), one["id"].alias("id"), one["source"].alias("source"), problem.alias("problem"))


def note_paths(notes: DataFrame, title: str, folder: str, order: list[str]) -> DataFrame:
    """notes with path: folder and slug; the second of one name ends in -1, and so on, in order."""
    named = notes.withColumn("__slug", T.slug(F.col(title)))
    n = F.row_number().over(Window.partitionBy(folder, "__slug").orderBy(*order)) - 1
    suffix = F.when(F.col("__n") > 0, F.concat(F.lit("-"), F.col("__n").cast("string"))).otherwise("")
    return named.withColumn("__n", n).withColumn("path", F.concat_ws("/", folder, F.concat("__slug", suffix, F.lit(".md")))).drop("__slug", "__n")


SEVERITY = {"hard": 0, "soft": 1, "info": 2}


def ordered_violations(violations: Column) -> Column:
    """Violations by severity, then the greatest penalty first; equal ones in the order of the rules."""
    rank = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    keyed = F.transform(violations, lambda v, i: F.struct(rank[v["severity"]].alias("s"), (-v["penalty"]).alias("p"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda k: k["v"])


def filled(template: str, **values: Column) -> Column:
    """A template with each {{NAME}} replaced; one that is left stops the job."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return F.when(out.rlike(r"\{\{[A-Z_]+\}\}"), F.raise_error(F.concat(F.lit("unfilled: "), F.regexp_extract(out, r"\{\{[A-Z_]+\}\}", 0))).cast("string")).otherwise(out)


def repaired(pending: DataFrame, sidecars: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables reduced to the ids that are pending and have a sidecar."""
    both = pending.select(key).intersect(sidecars.select(key))
    return tuple(t.join(both, key, "left_semi") for t in (pending, sidecars, decisions))
