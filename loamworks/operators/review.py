"""Review queues, outcomes, run metrics, receipts, and upserts of small histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: last write wins. order: columns, the later the greater."""
    by = Window.partitionBy(*key).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("__r", F.row_number().over(by)).where("__r = 1").drop("__r")


def upserted(history: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """history without the keys of new, and new, in order. Written elsewhere and swapped, never over what is read."""
    return history.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True).orderBy(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order))


def queued(queue: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """queue and the rows of new whose key it lacks (of several with one key any one)."""
    return queue.unionByName(new.dropDuplicates(key).join(queue.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after where a value is new, gone or another."""
    b, a = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    return b.join(a, key, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))


def outcomes(df: DataFrame, dims: list[str], outcome: str) -> DataFrame:
    """dimension, value, outcome, n: counts by each dimension on its own, in one pass over the rows."""
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims)))
    return df.select(each.alias("d"), F.col(outcome).alias("outcome")).groupBy("d.dimension", "d.value", "outcome").agg(F.count("*").alias("n"))


def reject_rates(counts: DataFrame, rejected: str) -> DataFrame:
    out = counts.groupBy("dimension", "value").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("outcome") == rejected, F.col("n"))), F.lit(0)).alias("rejected"))
    return out.withColumn("reject_rate", F.round(F.coalesce(F.try_divide("rejected", "n"), F.lit(0.0)), 4))


def totals(df: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """Sums for each group and level of by, and of all rows (null: all)."""
    return df.rollup(*by).agg(*(F.sum(c).alias(n) for n, c in sums.items()), F.grouping_id().cast("long").alias("level"))


def disposition(cards: DataFrame, key: str, tables: list[tuple[str, DataFrame]], otherwise: Column) -> DataFrame:
    """cards with disposition: the name of the first table that has the key, else otherwise."""
    out, chosen = cards, F.lit(None).cast("string")
    for name, table in tables:
        out = out.join(table.select(key).distinct().withColumn(f"__{name}", F.lit(True)), key, "left")
        chosen = F.coalesce(chosen, F.when(F.col(f"__{name}"), name))
    return out.select(*(F.col(c) for c in cards.columns), F.coalesce(chosen, otherwise).alias("disposition"))


def cohort_counts(df: DataFrame, outcome: str, **cohorts: Column) -> DataFrame:
    """cohort, outcome, n; a row counts in each cohort it belongs to."""
    named = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in cohorts.items())))
    return df.select(F.explode(named).alias("cohort"), F.col(outcome).alias("outcome")).groupBy("cohort", "outcome").agg(F.count("*").alias("n"))


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def asserted_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """df, or a failing job if a key is there twice."""
    n = F.count("*").over(Window.partitionBy(*key))
    return df.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*key)))).cast("boolean")).otherwise(True)).drop("__n")


def receipt(df: DataFrame, sections: dict[str, Column], line: Column, most: int = 10) -> DataFrame:
    """section, n, lines: how many rows belong to each section, and the first of their lines in order."""
    each = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in sections.items()))))
    rows = df.select(each.alias("section"), line.alias("line"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("section").orderBy("line"))).where(F.col("r") <= most)
    counts = rows.groupBy("section").agg(F.count("*").alias("n"))
    return counts.join(ranked.groupBy("section").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines")), "section")


def alerts(**conditions: tuple[Column, str]) -> Column:
    """The messages whose condition holds."""
    return F.array_compact(F.array(*(F.when(c, F.lit(m)) for c, m in conditions.values()), F.lit(None).cast("string")))


def unit_metrics(df: DataFrame, kind: str, size: str, found: str, source: str) -> DataFrame:
    """kind, units, bytes, candidates, zero_yield and the most units of one source."""
    per_source = df.groupBy(kind, source).agg(F.count("*").alias("u"), F.sum(size).alias("b"), F.sum(found).alias("c"), F.count_if(F.col(found) == 0).alias("z"))
    return per_source.groupBy(kind).agg(F.sum("u").alias("units"), F.sum("b").alias("bytes"), F.sum("c").alias("candidates"), F.sum("z").alias("zero_yield"), F.max("u").alias("most_units_of_a_source"))


def usage(df: DataFrame, phase: str, amount: Column, model: str, at: str) -> DataFrame:
    """phase, amount, distinct models, and seconds from its first to its last row."""
    return df.groupBy(phase).agg(F.round(F.sum(amount), 4).alias("amount"), F.array_join(F.array_sort(F.collect_set(model)), ",").alias("models"), ((F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))) / 1e6).alias("wall_seconds"))


def unseen(tasks: DataFrame, done: DataFrame, parts: list[str]) -> DataFrame:
    """tasks with their fingerprint, but for those done before with the same one."""
    mark = F.sha2(F.concat_ws("\0", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts)), 256)
    return tasks.withColumn("fingerprint", mark).join(done.select("fingerprint").distinct(), "fingerprint", "left_anti")


def identity(df: DataFrame, keys: list[str], prefix: str = "c-", length: int = 20) -> DataFrame:
    """df with candidate_id: a hash of the canonical JSON of these columns (by name; nulls as absent keys)."""
    text = F.to_json(F.struct(*sorted(keys)))
    return df.withColumn("candidate_id", F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length)))
