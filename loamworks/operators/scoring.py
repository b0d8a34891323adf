"""Draft scores from transparent rules, and how well a score tells two classes apart."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T


@dataclass(frozen=True)
class Rules:
    """Lists, weights and the band of mean sentence lengths that a draft is held against."""

    corporate: tuple[str, ...] = L.CORPORATE
    ai_tells: tuple[str, ...] = L.AI_TELLS
    filler: tuple[str, ...] = L.FILLER
    inflated: tuple[str, ...] = L.INFLATED
    hedges: tuple[str, ...] = L.HEDGES
    expandable: tuple[str, ...] = L.EXPANDABLE
    band: tuple[float, float] = (8.0, 16.0)
    em_dash_allowed: bool = False
    weights: dict[str, int] = field(default_factory=lambda: dict(L.WEIGHTS))
    units: dict[str, int] = field(default_factory=lambda: dict(L.UNITS))

    @property
    def phrase_rules(self) -> tuple[tuple[str, str, tuple[str, ...]], ...]:
        return (("corporate_word", "soft", self.corporate), ("ai_tell", "soft", self.ai_tells), ("filler_in_writing", "soft", self.filler), ("inflated_claim", "soft", self.inflated), ("hedge", "info", self.hedges))


def signals(df: DataFrame, rules: Rules, text: str = "text") -> DataFrame:
    """The columns of df and what the rules look at: counts, sentence rhythm, matched phrases."""
    t = F.col(text)
    # A column of its own: a lambda's argument isn't shared, so array_compact() would make the lower case again for each phrase.
    lower = F.col("__lower")
    out = df.withColumn("__lower", F.lower(t))
    out = out.withColumns({"n_words": T.word_count(t), "lengths": T.sentence_lengths(t), "em_dash": T.occurrences(t, "—"), "contractions": T.contractions(t, lower), "expandable": sum((T.phrase_count(t, p, lower) for p in rules.expandable), F.lit(0))})
    out = out.withColumns({f"matched_{name}": T.matched_phrases(t, phrases, lower) for name, _, phrases in rules.phrase_rules}).drop("__lower")
    n = F.size("lengths").cast("long")
    mean = F.coalesce(F.try_divide(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x), n), F.lit(0.0))
    out = out.withColumns({"n_sentences": n, "sentence_len_mean": mean})
    squares = F.aggregate(F.transform("lengths", lambda x: (x * x).cast("double")), F.lit(0.0), lambda a, x: a + x)
    variance = F.greatest(F.coalesce(F.try_divide(squares, F.col("n_sentences")), F.lit(0.0)) - F.col("sentence_len_mean") ** 2, F.lit(0.0))
    return out.withColumn("sentence_len_stdev", F.sqrt(variance)).drop("lengths")


def _violation(rule: str, severity: str, count: Column, penalty: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), count.cast("double").alias("count"), penalty.cast("long").alias("penalty"))


def violations(rules: Rules) -> Column:
    """The rules that a row of signals() breaks, in their order."""
    w, none = rules.weights, F.lit(None)
    found = [F.when((F.col("em_dash") > 0) & F.lit(not rules.em_dash_allowed), _violation("em_dash_banned", "hard", F.col("em_dash"), w["em_dash"] + 3 * (F.col("em_dash") - 1)))]
    for name, severity, _ in rules.phrase_rules:
        n = F.size(f"matched_{name}")
        found.append(F.when(n > 0, _violation(name, severity, n, w[name] * F.least(n, F.lit(rules.units[name])))))
    found.append(F.when((F.col("expandable") > 0) & (F.col("contractions") == 0), _violation("no_contractions", "soft", F.col("expandable"), F.lit(w["no_contractions"]))))
    mean, high = F.col("sentence_len_mean"), rules.band[1]
    uniform = (F.col("n_sentences") > 3) & (F.col("sentence_len_stdev") < 1.0) & (mean > 8)
    found.append(F.when(uniform, _violation("uniform_rhythm", "soft", F.col("n_sentences"), F.lit(w["uniform_rhythm"]))))
    over = (mean - high * 1.5) / max(high, 1.0)
    drift = F.least(F.lit(w["sentence_len_drift"]), F.floor(6 + over * w["sentence_len_drift"]))
    found.append(F.when((F.col("n_sentences") > 0) & F.lit(high > 0) & (mean > high * 1.5), _violation("sentence_too_long", "soft", F.round(mean, 1), drift)))
    return F.array_compact(F.array(*(F.coalesce(f, none) for f in found)))


def scored(df: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """signals() with violations and score: 100 less all penalties, 60 at most after a hard one, and from 0 to 100."""
    out = signals(df, rules, text).withColumn("violations", violations(rules))
    total = F.aggregate("violations", F.lit(0).cast("long"), lambda a, v: a + v["penalty"])
    hard = F.exists("violations", lambda v: v["severity"] == "hard")
    capped = F.when(hard, F.least(100 - total, F.lit(60))).otherwise(100 - total)
    return out.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), capped)).cast("long"))


def voice_matches(rules: Rules = Rules()) -> Column:
    """The traits of the profile that a row of signals() shows."""
    low, high = rules.band
    trait = lambda name, when: F.when(when, F.lit(name))
    return F.array_compact(F.array(
        trait("sentence rhythm", (F.col("n_sentences") > 0) & F.col("sentence_len_mean").between(low, max(high * 1.5, high + 4))),
        trait("contractions", F.col("contractions") > 0),
        trait("punctuation", (F.col("em_dash") == 0) & F.lit(not rules.em_dash_allowed)),
        trait("plain language", (F.size("matched_corporate_word") == 0) & (F.size("matched_ai_tell") == 0)),
    ))


def roc_auc(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """by, n_pos, n_neg, auc: the chance that a positive row scores above a negative one, ties half; 0.5 if a class is empty.

    Counted over distinct scores, so ranks are running sums of a table as long as there are scores.
    """
    counts = df.groupBy(*by, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    below = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    wins = counts.withColumn("won", F.col("p") * (F.coalesce(F.sum("n").over(below), F.lit(0)) + F.col("n") / 2))
    sums = wins.groupBy(*by).agg(F.sum("p").alias("n_pos"), F.sum("n").alias("n_neg"), F.sum("won").alias("won"))
    return sums.select(*by, "n_pos", "n_neg", F.round(F.coalesce(F.try_divide("won", F.col("n_pos") * F.col("n_neg")), F.lit(0.5)), 9).alias("auc"))


def best_threshold(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """by, threshold, accuracy: calling a row positive if its score is the threshold or more; the lowest of equally good
    thresholds, which are the scores and half a point above them."""
    counts = df.groupBy(*by, score).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    group = Window.partitionBy(*by)
    below = group.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.withColumns({"p_below": F.coalesce(F.sum("p").over(below), F.lit(0)), "n_below": F.coalesce(F.sum("n").over(below), F.lit(0)), "all_p": F.sum("p").over(group), "all_n": F.sum("n").over(group)})
    at = F.struct(F.col(score).cast("double").alias("threshold"), (F.col("all_p") - F.col("p_below") + F.col("n_below")).alias("right"))
    above = F.struct((F.col(score) + 0.5).alias("threshold"), (F.col("all_p") - F.col("p_below") - F.col("p") + F.col("n_below") + F.col("n")).alias("right"))
    each = parts.select(*by, F.explode(F.array(at, above)).alias("t"), (F.col("all_p") + F.col("all_n")).alias("n"))
    best = each.groupBy(*by).agg(F.max_by(F.struct("t.threshold", "t.right", "n"), F.struct("t.right", -F.col("t.threshold"))).alias("b"))
    return best.select(*by, "b.threshold", F.round(F.col("b.right") / F.col("b.n"), 9).alias("accuracy"))


def discrimination(df: DataFrame, score: str, positive: str, by: list[str]) -> DataFrame:
    """by and, of positive and negative rows, mean, least and greatest score, and the means' gap."""
    of = lambda c, f: f(F.when(c, F.col(score)))
    p, n = F.col(positive), ~F.col(positive)
    out = df.groupBy(*by).agg(F.round(of(p, F.avg), 6).alias("pos_mean"), F.round(of(n, F.avg), 6).alias("neg_mean"), of(p, F.min).alias("pos_min"), of(n, F.max).alias("neg_max"), F.round(of(p, F.avg) - of(n, F.avg), 6).alias("gap"))
    return out


def hash_split(df: DataFrame, key: str, seed: str, share: float) -> DataFrame:
    """df with held_out: a fixed share of rows chosen by a seeded hash of their key, the same in every run."""
    return df.withColumn("held_out", F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") < int(share * 2**32))
