"""Corpus profiles: sentence lengths, vocabulary, rates, top n-grams."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Bins of sentence lengths: lowest and highest count of words.
BINS = ((1, 5), (6, 10), (11, 15), (16, 20), (21, 30), (31, None))


def sentence_lengths(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """by, words, opener, asks, exclaims: one row for each sentence."""
    each = df.select(*by, F.explode(T.sentences(F.col(text))).alias("sentence"))
    return each.select(*by, T.word_count(F.col("sentence")).alias("words"), F.array_join(F.slice(T.tokens(F.col("sentence")), 1, 2), " ").alias("opener"), F.endswith("sentence", F.lit("?")).alias("asks"), F.endswith("sentence", F.lit("!")).alias("exclaims"))


def sentence_stats(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Mean, median, p10, p90 and population deviation of sentence lengths, and how many ask or exclaim."""
    at = lambda p: F.round(F.percentile("words", F.lit(p)), 6)
    return sentence_lengths(df, by, text).groupBy(*by).agg(
        F.count("*").alias("n_sentences"), F.sum("words").alias("n_words"), F.round(F.avg("words"), 6).alias("mean"), at(0.5).alias("median"), at(0.1).alias("p10"), at(0.9).alias("p90"),
        F.round(F.stddev_pop("words"), 6).alias("pstdev"), F.round(F.avg(F.col("asks").cast("int")), 6).alias("question_rate"), F.round(F.avg(F.col("exclaims").cast("int")), 6).alias("exclamation_rate"),
    )


def vocabulary(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Tokens, distinct tokens and their ratio. Counted by word first, so no group's words meet in one task."""
    counts = df.select(*by, F.explode(T.tokens(F.col(text))).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_types")).withColumn("type_token_ratio", F.round(F.col("n_types") / F.col("n_tokens"), 6))


def length_histogram(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """How many sentences fall in each bin, empty bins too; sentences without a word fall in none."""
    inside = lambda lo, hi: (F.col("words") >= lo) & (F.lit(True) if hi is None else F.col("words") <= hi)
    name = lambda lo, hi: f"{lo}+" if hi is None else f"{lo}-{hi}"
    counts = sentence_lengths(df, by, text).groupBy(*by).agg(*(F.count_if(inside(*b)).alias(name(*b)) for b in BINS))
    return counts.unpivot(by, [name(*b) for b in BINS], "bin", "n")


def kept_grams(df: DataFrame, n: int, by: list[str], stop: tuple[str, ...], text: str = "text") -> DataFrame:
    """by, gram: the n-grams of texts, but for those of stop words only; single words have two letters or more.

    The words are zipped with themselves moved by one, two ..., and made rows before they are looked at or joined, so nothing is
    called for each run."""
    if n == 1:
        each = df.select(*by, F.explode(T.tokens(F.col(text))).alias("gram"))
        return each.where(~F.col("gram").isin(*stop) & (F.length("gram") > 1))
    names = [f"w{k}" for k in range(n)]
    words = df.select(*by, T.tokens(F.col(text)).alias("words")).where(F.size("words") >= n)
    runs = F.arrays_zip(*(F.slice("words", k + 1, F.size("words")).alias(w) for k, w in enumerate(names)))
    each = words.select(*by, F.explode(runs).alias("z")).select(*by, *(F.col(f"z.{w}").alias(w) for w in names))
    kept = each.where(F.col(names[-1]).isNotNull() & reduce(operator.or_, (~F.col(w).isin(*stop) for w in names)))
    return kept.select(*by, F.concat_ws(" ", *names).alias("gram"))


def top_grams(df: DataFrame, n: int, k: int, by: list[str], stop: tuple[str, ...], text: str = "text") -> DataFrame:
    """The k most frequent n-grams of each group (ties by the gram), but for those of stop words only; single words have
    two letters or more. N-grams don't cross texts."""
    counts = kept_grams(df, n, by, stop, text).groupBy(*by, "gram").agg(F.count("*").alias("n"))
    return ranked(counts, by, k)


def ranked(counts: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k rows of the greatest n in each group, ties by the gram, with their rank."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram")).cast("long")).where(F.col("rank") <= k)


def first_seen_top(df: DataFrame, by: list[str], order: list[str], k: int, text: str = "text") -> DataFrame:
    """by, gram, n, first, rank: the k most frequent words of each group, ties by where a word first stands (order, then its
    place in the text). Only a count and the first place of each word are kept in a task."""
    each = df.select(*by, F.struct(*order).alias("of"), F.posexplode(T.tokens(F.col(text))).alias("at", "gram"))
    counts = each.groupBy(*by, "gram").agg(F.count("*").alias("n"), F.min(F.struct("of", "at")).alias("first"))
    best = Window.partitionBy(*by).orderBy(F.desc("n"), "first")
    return counts.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def phrase_rates(df: DataFrame, lists: dict[str, tuple[str, ...]], by: list[str], text: str = "text") -> DataFrame:
    """by, lexicon, n, per_1k: how often a list's phrases occur, and for every thousand words."""
    total = lambda ps: sum((T.phrase_count(F.col(text), p) for p in ps), F.lit(0))
    sums = df.select(*by, T.word_count(F.col(text)).alias("words"), *(total(ps).alias(name) for name, ps in lists.items())).groupBy(*by).agg(F.sum("words").alias("words"), *(F.sum(n).alias(n) for n in lists))
    return sums.unpivot([*by, "words"], list(lists), "lexicon", "n").select(*by, "lexicon", "n", F.round(T.rate(F.col("n"), F.col("words")), 6).alias("per_1k"))


def punctuation_rates(df: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    marks = T.punctuation(F.col(text))
    sums = df.select(*by, T.word_count(F.col(text)).alias("words"), *(c.alias(n) for n, c in marks.items())).groupBy(*by).agg(F.sum("words").alias("words"), *(F.sum(n).alias(n) for n in marks))
    return sums.unpivot([*by, "words"], list(marks), "mark", "n").select(*by, "mark", "n", F.round(T.rate(F.col("n"), F.col("words")), 6).alias("per_1k"))


def paired_deltas(df: DataFrame, key: str, kind: str, spoken: str, polished: str, fillers: tuple[str, ...], order: str, text: str = "text") -> DataFrame:
    """For each key that has both kinds (of several rows the last): how many fillers went, and the ratio of lengths."""
    last = lambda k: F.max_by(F.when(F.col(kind) == k, F.col(text)), F.when(F.col(kind) == k, F.col(order)))
    both = df.groupBy(key).agg(last(spoken).alias("spoken"), last(polished).alias("polished")).where("spoken IS NOT NULL AND polished IS NOT NULL")
    count = lambda c: sum((T.phrase_count(F.col(c), p) for p in fillers), F.lit(0))
    return both.select(key, (count("spoken") - count("polished")).alias("filler_removed"), F.round(F.try_divide(T.word_count(F.col("polished")), T.word_count(F.col("spoken"))), 6).alias("length_ratio"))
