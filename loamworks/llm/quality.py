"""Quality rules with adaptive thresholds, in DataFrame operations only.

For each measure and each language and source a mergeable quantile sketch is kept: counts of logarithmic buckets (of a
fixed relative width, so sketches merge by adding counts, in any order, and quantiles have a bounded relative error). They
hold the texts that the base rule passes. A text is outside if a measure lies further beyond the group's upper quantile
than REACH times that quantile's distance from the median (word lengths: the lower one, too). Where that quantile is zero, as
nearly all of a group's texts have none of something, the threshold is the lower quartile of those that have some, divided by
1 + REACH: a stray symbol passes, what is like most of the few that have any doesn't. So no cutoff is a constant. Groups of
few rows use the merged sketch of their language, or of all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stored

SYMBOLS = r"[#*$%&|<>]"
#: Upper quantile of each measure that its threshold starts from (the lower one is as far from the other end).
LEVEL = {"symbol_ratio": 0.9, "dup_line_ratio": 0.99, "repeat_ratio": 0.99, "mean_word_length": 0.9}
#: Measures of which too low a value counts as well.
TWO_SIDED = ("mean_word_length",)
#: How far beyond that quantile, as a multiple of its distance from the median, a threshold lies.
REACH = 2.0
#: Relative error of a sketch's quantiles.
ERROR = 0.01
#: Rows from which a group has thresholds of its own.
LEAST_ROWS = 200
LEAST_WORDS = 50
#: Bucket of zero, below that of any other value.
ZERO = -100_000
GAMMA = (1 + ERROR) / (1 - ERROR)


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each row.

    Windows are compared by a 64-bit hash within one text. A null text has no words, lines or symbols.
    """
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{source_col}`").alias("source"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    rows = rows.select(
        "doc_id", "lang", "source",
        F.array_remove(F.split("text", SPACE + "+"), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id", "lang", "source", "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    windows = F.expr(
        "slice(zip_with(zip_with(hashes, slice(hashes, 2, size(hashes)), (a, b) -> xxhash64(a, b)),"
        " slice(hashes, 3, size(hashes)), (x, c) -> xxhash64(x, c)), 1, greatest(size(hashes) - 2, 0))"
    )
    keep = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    rows = rows.select(*keep, windows.alias("windows"))
    # Only where a window repeats are windows sorted, with their places, to find which.
    placed = F.expr("if(size(array_distinct(windows)) < size(windows), sort_array(zip_with(windows, sequence(1, size(windows)), (w, i) -> struct(w, i))), NULL)")
    rows = rows.select(*keep, placed.alias("placed"))
    twice = F.expr("sort_array(array_distinct(flatten(filter(zip_with(placed, slice(placed, 2, size(placed)), (x, y) -> if(x.w = y.w, array(x.i, y.i), NULL)), p -> p IS NOT NULL))))")
    rows = rows.select(*keep, twice.alias("at"))
    covered = F.expr("aggregate(zip_with(at, slice(at, 2, size(at)), (i, j) -> least(3, coalesce(j - i, 3))), 0L, (sum, n) -> sum + n)")
    return rows.select(*keep, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


VALUES = {
    "symbol_ratio": ("n_symbols", "word_chars"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "mean_word_length": ("word_chars", "n_words"),
}


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: the bucket counts of each group; adding counts merges sketches."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), ratio(a, b).alias("value")) for m, (a, b) in VALUES.items())))
    long = rows.select("lang", "source", each.alias("m")).select("lang", "source", "m.measure", "m.value")
    bucket = F.when(F.col("value") <= 0, ZERO).otherwise(F.ceil(F.log("value") / F.lit(math.log(GAMMA)))).cast("int")
    return long.groupBy("lang", "source", "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def thresholds_of(sketch: DataFrame, by: list[str]) -> DataFrame:
    """One row for each group of sketches merged by these columns: rows, and low_ and high_ of each measure."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "measure")
    none = F.sum(F.when(F.col("bucket") == ZERO, F.col("n")).otherwise(0)).over(group)
    upto = merged.select("*", F.sum("n").over(group.orderBy("bucket")).alias("upto"), F.sum("n").over(group).alias("rows"), none.alias("none"))
    level = F.create_map(*(F.lit(x) for kv in LEVEL.items() for x in kv))[F.col("measure")]
    # Buckets rise with their values, so the least bucket past a rank has the quantile.
    first = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("bucket")))
    some = F.min(F.when((F.col("bucket") > ZERO) & (F.col("upto") - F.col("none") >= 0.25 * (F.col("rows") - F.col("none"))), F.col("bucket")))
    table = upto.groupBy(*by, "measure").agg(F.max("rows").alias("rows"), first(1 - level).alias("least"), first(F.lit(0.5)).alias("middle"), first(level).alias("most"), some.alias("some"))
    # A bucket's values lie between these two ends, so a group of equal values is inside its own thresholds.
    upper = lambda c: F.when(F.col(c) == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col(c)))
    lower = lambda c: F.when(F.col(c) == ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col(c) - 1))
    high, low = upper("most") + REACH * (upper("most") - upper("middle")), lower("least") - REACH * (lower("middle") - lower("least"))
    few = F.when(F.col("most") == ZERO, F.coalesce(F.pow(F.lit(GAMMA), F.col("some")) / (1 + REACH), F.lit(0.0))).otherwise(high)
    table = table.select(*by, "measure", "rows", low.alias("low"), few.alias("high"))
    at = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    return table.groupBy(*by).agg(F.max("rows").alias("rows"), *(at(m, c).alias(f"{c}_{m}") for m in VALUES for c in ("low", "high")))


def thresholds(rows: DataFrame, least_rows: int = LEAST_ROWS) -> DataFrame:
    """of_lang, of_source and the thresholds that hold for that group: its own, its language's or those of all rows."""
    sketch = stored(sketches(rows))
    names = [f"{c}_{m}" for m in VALUES for c in ("low", "high")]
    own = thresholds_of(sketch, ["lang", "source"])
    lang = thresholds_of(sketch, ["lang"]).select(F.col("lang").alias("of"), F.col("rows").alias("lang_rows"), *(F.col(n).alias(f"lang_{n}") for n in names))
    every = thresholds_of(sketch.withColumn("one", F.lit(1)), ["one"]).select(*(F.col(n).alias(f"all_{n}") for n in names), "one")
    wide = own.join(lang, F.col("lang").eqNullSafe(F.col("of")), "left").withColumn("one", F.lit(1)).join(every, "one", "left")
    held = lambda n: F.when(F.col("rows") >= least_rows, F.col(n)).when(F.col("lang_rows") >= least_rows, F.col(f"lang_{n}")).otherwise(F.col(f"all_{n}"))
    return wide.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), *(held(n).alias(n) for n in names))


def base_failed() -> Column:
    """Too short, or mostly repeated."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_rows: int = LEAST_ROWS) -> DataFrame:
    """The counts of measures(), base_failed (too short, or mostly repeated) and kept, for each row of df.

    Null languages and sources are groups of their own; groups of fewer than least_rows rows that pass the base have the
    thresholds of their language, or of all. Empty texts fail. Repeated rows are judged alike. No rows: no rows.
    """
    rows = stored(measures(df, id_col, text_col, lang_col, source_col))
    table = thresholds(rows.where(~base_failed()), least_rows)
    same = F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source"))
    outside = F.lit(False)
    for m, (a, b) in VALUES.items():
        outside = outside | (ratio(a, b) > F.col(f"high_{m}"))
        if m in TWO_SIDED:
            outside = outside | (ratio(a, b) < F.col(f"low_{m}"))
    judged = rows.join(table, same, "left")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~F.coalesce(outside, F.lit(False))).alias("kept"))
