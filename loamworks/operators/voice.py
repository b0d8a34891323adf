"""From a corpus to a writing profile, its rules, audits of drafts, rewrites and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from . import profile, scoring

#: What an audit advises for each rule.
FIXES = {
    "em_dash_banned": "use commas or full stops for dashes", "corporate_word": "say it in everyday words", "ai_tell": "drop stock phrases", "filler_in_writing": "cut spoken filler",
    "inflated_claim": "claim what you can show", "hedge": "say it or leave it out", "no_contractions": "contract where you would when speaking", "uniform_rhythm": "vary sentence lengths", "sentence_too_long": "split long sentences",
}
SEVERITIES = ("hard", "soft", "info")


def classed(df: DataFrame, kind: str, written: tuple[str, ...], spoken: str) -> DataFrame:
    """df with class: writing, speech or other, by a row's kind."""
    return df.withColumn("class", F.when(F.col(kind).isin(*written), "writing").when(F.col(kind) == spoken, "speech").otherwise("other"))


def class_stats(df: DataFrame, by: list[str], fillers: tuple[str, ...], text: str = "text") -> DataFrame:
    """by, of (writing, speech, other, overall) and their sentence lengths and rates. df: classed()."""
    filler = sum((T.phrase_count(F.col(text), p) for p in fillers), F.lit(0))
    told = df.select(*by, "class", T.sentence_lengths(F.col(text)).alias("lengths"), T.word_count(F.col(text)).alias("w"), filler.alias("f"), T.contractions(F.col(text)).alias("c"), T.occurrences(F.col(text), "—").alias("d"))
    sums = told.groupBy(*by, "class").agg(*(F.sum(c).alias(c) for c in "wfc"), F.max("d").alias("d"))
    # How often each length occurs, by class; texts are read for a class and not once more for all of them.
    counts = told.select(*by, "class", F.explode("lengths").alias("n")).groupBy(*by, "class", "n").agg(F.count("*").alias("times"))
    both = F.explode(F.array("class", F.lit("overall"))).alias("of")
    at = lambda p: F.percentile("n", F.lit(p), F.col("times")).alias(f"p{round(100 * p)}")
    lengths = counts.select(*by, both, "n", "times").groupBy(*by, "of").agg(F.sum("times").alias("n_sentences"), at(0.1), at(0.9), (F.sum(F.col("n") * F.col("times")) / F.sum("times")).alias("mean"))
    body = sums.select(*by, both, *"wfcd").groupBy(*by, "of").agg(F.sum("w").alias("n_words"), F.sum("f").alias("f"), F.sum("c").alias("c"), (F.max("d") > 0).alias("em_dash_present"))
    rates = body.select(*by, "of", "n_words", T.rate(F.col("f"), F.col("n_words")).alias("filler_per_1k"), T.rate(F.col("c"), F.col("n_words")).alias("contraction_per_1k"), "em_dash_present")
    return rates.join(lengths, [*by, "of"], "left")


def written_targets(stats: DataFrame, by: list[str], least_words: int = 50) -> DataFrame:
    """by and the target of written drafts: from writing if there are least_words of it, else from speech (or all, without
    any), when no spoken filler is expected and dashes are allowed only if what writing there is has one. Also spoken_of and
    the spoken band."""
    at = lambda of, c: F.max(F.when(F.col("of") == of, F.col(c)))
    columns = ("p10", "p90", "mean", "filler_per_1k", "contraction_per_1k", "em_dash_present", "n_words")
    wide = stats.groupBy(*by).agg(*(at(of, c).alias(f"{of}_{c}") for of in ("writing", "speech", "overall") for c in columns))
    writing = F.coalesce(F.col("writing_n_words"), F.lit(0)) >= least_words
    speech = F.col("speech_n_words").isNotNull()
    spoken = lambda c: F.when(speech, F.col(f"speech_{c}")).otherwise(F.col(f"overall_{c}"))
    held = lambda c: F.when(writing, F.col(f"writing_{c}")).otherwise(spoken(c))
    spoken_of = F.when(speech, "speech").otherwise("overall")
    return wide.select(
        *by, F.when(writing, "writing").otherwise("speech").alias("derived_from"), F.when(writing, "writing").otherwise(spoken_of).alias("source_of"), spoken_of.alias("spoken_of"),
        F.round(held("p10"), 1).alias("band_low"), F.round(held("p90"), 1).alias("band_high"), F.round(held("mean"), 6).alias("mean"), F.when(writing, F.round(F.col("writing_filler_per_1k"), 3)).otherwise(0.0).alias("filler_per_1k"),
        F.round(held("contraction_per_1k"), 6).alias("contraction_per_1k"), F.coalesce("writing_em_dash_present", F.lit(False)).alias("em_dash_allowed"), F.round(spoken("p10"), 6).alias("spoken_low"), F.round(spoken("p90"), 6).alias("spoken_high"),
    )


def anchors(df: DataFrame, targets: DataFrame, by: list[str], of: str, name: str, k: int, stop: tuple[str, ...], openers: bool = False, text: str = "text") -> DataFrame:
    """by and the k most frequent words (or sentence openers) of the texts that a target's column `of` names."""
    # Counted by class first, so that texts never move by their group: only the first k of each class meet the targets.
    if openers:
        grams = profile.sentence_lengths(df, [*by, "class"], text).where("opener <> ''").withColumnRenamed("opener", "gram")
    else:
        grams = profile.kept_grams(df, 1, [*by, "class"], stop, text)
    counts = grams.groupBy(*by, "class", "gram").agg(F.count("*").alias("n"))
    overall = counts.groupBy(*by, "gram").agg(F.sum("n").alias("n")).select(*by, F.lit("overall").alias(of), "gram", "n")
    every = counts.where(F.col("class") != "overall").select(*by, F.col("class").alias(of), "gram", "n").unionAll(overall)
    top = profile.ranked(every, [*by, of], k).join(targets.select(*by, of), [*by, of])
    return top.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "gram"))), lambda x: x["gram"]).alias(name))


def build_profile(df: DataFrame, by: list[str], kind: str, written: tuple[str, ...], spoken: str, fillers: tuple[str, ...] = L.FILLER, stop: tuple[str, ...] = L.STOP_WORDS, least_words: int = 50, text: str = "text") -> DataFrame:
    """One row for each group: written_targets() with vocab_anchors, opener_anchors and spoken_vocab.

    Rows of null kind are of class other. A group without sentences has null lengths, and empty anchors.
    """
    rows = classed(df, kind, written, spoken)
    out = targets = written_targets(class_stats(rows, by, fillers, text), by, least_words)
    for of, name, k, openers in (("source_of", "vocab_anchors", 20, False), ("source_of", "opener_anchors", 10, True), ("spoken_of", "spoken_vocab", 15, False)):
        out = out.join(anchors(rows, targets, by, of, name, k, stop, openers, text), by, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def to_rules(profiles: DataFrame, by: list[str], rules: scoring.Rules = scoring.Rules()) -> DataFrame:
    """by and one rules struct: what a profile says, with the lists (sorted) and the weights."""
    listed = {"filler_phrases": rules.filler, "corporate_blacklist": rules.corporate, "ai_tells": rules.ai_tells, "inflated_phrases": rules.inflated, "hedges": rules.hedges}
    weights = F.create_map(*(F.lit(x) for kv in rules.weights.items() for x in kv))
    return profiles.select(*by, F.struct(
        "derived_from", *(F.array(*map(F.lit, sorted(ps))).alias(n) for n, ps in listed.items()), "em_dash_allowed", F.array("band_low", "band_high").alias("sentence_len_band"), F.col("mean").alias("sentence_len_mean"),
        F.col("contraction_per_1k").alias("contraction_rate_target"), F.col("filler_per_1k").alias("filler_target_per_1k"), "opener_anchors", "vocab_anchors", weights.alias("score_weights"),
    ).alias("rules"))


def profile_summary() -> Column:
    """A row of build_profile() told in a few lines, in this engine's own form."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    words = F.array_join(F.slice("vocab_anchors", 1, 12), " ")
    return F.concat_ws(
        "\n", F.concat(F.lit("target taken from "), "derived_from"), F.concat(F.lit("mean sentence "), told("mean"), F.lit(", usual "), told("band_low"), F.lit(" to "), told("band_high")),
        F.when(F.col("em_dash_allowed"), "long dashes occur").otherwise("no long dashes"), F.concat(F.lit("short forms per thousand: "), told("contraction_per_1k")), F.concat(F.lit("typical words: "), F.when(words == "", "none").otherwise(words)),
    )


def ordered_violations(by_severity: bool) -> Column:
    """The violations of a row of scored(): the largest penalty first (by severity before that), in the rules' order if equal."""
    at = lambda v: F.array_position(F.array(*map(F.lit, SEVERITIES)), v["severity"]) if by_severity else F.lit(0)
    keyed = F.transform("violations", lambda v, i: F.struct(at(v).alias("s"), (-v["penalty"]).alias("p"), i.alias("i"), v.alias("v")))
    return F.transform(F.array_sort(keyed), lambda x: x["v"])


def audited(df: DataFrame, rules: scoring.Rules = scoring.Rules(), text: str = "text") -> DataFrame:
    """scored() with matches, plan (the fixes, largest penalty first), breakdown (points by rule) and report (a text)."""
    out = scoring.scored(df, rules, text).withColumn("matches", scoring.voice_matches(rules))
    fix = F.create_map(*(F.lit(x) for kv in FIXES.items() for x in kv))
    out = out.withColumns({"plan": F.transform(ordered_violations(False), lambda v: fix[v["rule"]]), "breakdown": F.map_from_entries(F.transform("violations", lambda v: F.struct(v["rule"], v["penalty"])))})
    found = F.transform(ordered_violations(True), lambda v: F.concat(v["severity"], F.lit(" "), v["rule"], F.lit(" costs "), v["penalty"].cast("string"), F.lit(": "), fix[v["rule"]]))
    part = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.lit(title), F.array_join(lines, "\n")))
    head = F.concat(F.lit("draft scores "), F.col("score").cast("string"), F.lit(" of 100 "), T.score_bar(F.col("score")))
    steps = F.transform("plan", lambda p, i: F.concat((i + 1).cast("string"), F.lit(") "), p))
    return out.withColumn("report", F.concat_ws("\n\n", head, part("# against the profile\n", found), part("# like the profile\n", F.col("matches")), part("# to do, in this order\n", steps)))


def stilted(c: Column, expansions: dict[str, str], grand: dict[str, str], opening: str = "Consequently, ") -> Column:
    """A text made to read like generic prose: contractions written out, plain words swapped for grand ones, the first comma
    (or full stop) a dash, and a connector before it all."""
    for old, new in (*expansions.items(), *grand.items()):
        c = F.regexp_replace(c, rf"(?i)\b{old}\b", new)
    dashed = F.when(F.contains(c, F.lit(", ")), F.concat(F.substring_index(c, ", ", 1), F.lit(" — "), F.substr(c, F.instr(c, F.lit(", ")) + 2)))
    dashed = dashed.when(F.contains(c, F.lit(". ")), F.concat(F.substring_index(c, ". ", 1), F.lit(" — "), F.substr(c, F.instr(c, F.lit(". ")) + 2))).otherwise(c)
    return F.concat(F.lit(opening), F.lower(F.substring(dashed, 1, 1)), F.substr(dashed, F.lit(2)))


def rewrite_demo(df: DataFrame, keys: list[str], rules: scoring.Rules = scoring.Rules(), swaps: dict[str, str] = L.SWAPS, connectors: tuple[str, ...] = L.CONNECTORS, text: str = "text") -> DataFrame:
    """keys, before_score, after_score, delta: each text scored as it is and after the mechanical rewrite."""
    score = lambda d, name: scoring.scored(d, rules, text).withColumnRenamed("score", name)
    before = score(df, "before_score").select(*keys, text, "before_score")
    after = score(before.withColumn(text, T.rewritten(F.col(text), swaps, connectors, rules.filler)), "after_score")
    return after.select(*keys, "before_score", "after_score", (F.col("after_score") - F.col("before_score")).alias("delta"))


def evaluation_report(summary: DataFrame, by: list[str], least_auc: float) -> DataFrame:
    """by, passed, report: a few lines of figures. summary: by, auc, threshold, accuracy, pos_mean, neg_mean, gap, n_pos, n_neg."""
    line = lambda form, *cs: F.format_string(form, *map(F.col, cs))
    passed = F.col("auc") >= least_auc
    auc = F.concat(line("AUC %.3f: ", "auc"), F.when(passed, "pass").otherwise("below target"))
    return summary.select(*by, passed.alias("passed"), F.concat_ws("\n", auc, line("accuracy %.3f at %.1f", "accuracy", "threshold"), line("mean %.2f and %.2f, gap %.2f", "pos_mean", "neg_mean", "gap"), line("%d positive, %d negative", "n_pos", "n_neg")).alias("report"))
