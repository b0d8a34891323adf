"""Queries over documents and labels: writing profiles, rules, audits, rewrites and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import profile, scoring, voice
from .corpus import RULES, SENT, STOP, TOK, _hits, _sig_sql, docs, in_list, judged_drafts
from .registry import query

WRITTEN, SPOKEN, LEAST = ("src0", "src1"), "src2", 12_000
_CLASS = f"CASE WHEN source IN ({in_list(WRITTEN)}) THEN 'writing' WHEN source = '{SPOKEN}' THEN 'speech' ELSE 'other' END"
_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"
_CONTRACTIONS = r"len(regexp_extract_all(lower(text), '[a-z]''(?:t|s|re|ve|ll|d|m)\b'))"
_TARGETS = rf"""{SENT}, x AS (SELECT lang, {_CLASS} AS of, words FROM words UNION ALL SELECT lang, 'overall', words FROM words),
l AS (SELECT lang, of, quantile_cont(words, 0.1) AS p10, quantile_cont(words, 0.9) AS p90, avg(words) AS mean FROM x GROUP BY ALL),
y AS (SELECT lang, {_CLASS} AS of, {_WORDS} AS w, {_hits('text', ('the',))} AS f, {_CONTRACTIONS} AS c, contains(text, '—') AS d FROM documents),
b AS (SELECT lang, of, sum(w) AS n_words, sum(f) * 1000 / sum(w) AS f, sum(c) * 1000 / sum(w) AS c, bool_or(d) AS d FROM (SELECT * FROM y UNION ALL SELECT lang, 'overall', w, f, c, d FROM y) GROUP BY ALL),
s AS (SELECT b.*, p10, p90, mean FROM b LEFT JOIN l USING (lang, of)), g AS (SELECT DISTINCT lang FROM documents),
k AS (SELECT lang, coalesce(w.n_words, 0) >= {LEAST} AS wr, p.lang IS NOT NULL AS sp FROM g LEFT JOIN (SELECT * FROM s WHERE of = 'writing') w USING (lang) LEFT JOIN (SELECT * FROM s WHERE of = 'speech') p USING (lang)),
k2 AS (SELECT *, CASE WHEN sp THEN 'speech' ELSE 'overall' END AS spoken_of, CASE WHEN wr THEN 'writing' WHEN sp THEN 'speech' ELSE 'overall' END AS source_of FROM k),
targets AS (SELECT k2.lang, CASE WHEN wr THEN 'writing' ELSE 'speech' END AS derived_from, source_of, spoken_of, round(a.p10, 1) AS band_low, round(a.p90, 1) AS band_high, round(a.mean, 6) AS mean, CASE WHEN wr THEN round(a.f, 3) ELSE 0 END AS filler_per_1k,
  round(a.c, 6) AS contraction_per_1k, coalesce(w.d, false) AS em_dash_allowed, round(p.p10, 6) AS spoken_low, round(p.p90, 6) AS spoken_high
  FROM k2 JOIN s a ON a.lang = k2.lang AND a.of = source_of JOIN s p ON p.lang = k2.lang AND p.of = spoken_of LEFT JOIN s w ON w.lang = k2.lang AND w.of = 'writing')"""


def _anchors(of: str, name: str, k: int, grams: str) -> str:
    return f"""{name} AS (SELECT lang, list(gram ORDER BY n DESC, gram) AS {name} FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM
  (SELECT lang, gram, count(*) AS n FROM (SELECT d.lang, d.class, gram FROM {grams} d) q JOIN targets t USING (lang) WHERE t.{of} = 'overall' OR t.{of} = q.class GROUP BY ALL)) WHERE r <= {k} GROUP BY lang)"""


_UNI = f"(SELECT lang, {_CLASS} AS class, gram FROM (SELECT lang, source, unnest({TOK.format('text')}) AS gram FROM documents) WHERE gram NOT IN ({in_list(STOP)}) AND length(gram) > 1)"
_OPEN = f"(SELECT lang, {_CLASS} AS class, array_to_string({TOK.format('sentence')}[1:2], ' ') AS gram FROM words WHERE array_to_string({TOK.format('sentence')}[1:2], ' ') <> '')"
_PROFILES = f"WITH {_TARGETS}, {_anchors('source_of', 'vocab_anchors', 20, _UNI)}, {_anchors('source_of', 'opener_anchors', 10, _OPEN)}, {_anchors('spoken_of', 'spoken_vocab', 15, _UNI)} "


def profiles(spark, sf_dir):
    return voice.build_profile(docs(spark, sf_dir), ["lang"], "source", WRITTEN, SPOKEN, ("the",), STOP, LEAST)


@query(_PROFILES + "SELECT * FROM targets JOIN vocab_anchors USING (lang) JOIN opener_anchors USING (lang) JOIN spoken_vocab USING (lang)")
def voice_profiles(spark, sf_dir):
    return profiles(spark, sf_dir)


@query(_PROFILES + f"""SELECT lang, derived_from, em_dash_allowed, [band_low, band_high] AS sentence_len_band, filler_per_1k AS filler_target_per_1k, vocab_anchors, {len(RULES.weights)} AS n_weights, {len(RULES.corporate)} AS n_corporate,
'{sorted(RULES.ai_tells)[0]}' AS first_tell FROM targets JOIN vocab_anchors USING (lang)""")
def voice_rules(spark, sf_dir):
    out = voice.to_rules(profiles(spark, sf_dir), ["lang"], RULES)
    return out.select("lang", "rules.derived_from", "rules.em_dash_allowed", "rules.sentence_len_band", "rules.filler_target_per_1k", "rules.vocab_anchors", F.size("rules.score_weights").alias("n_weights"), F.size("rules.corporate_blacklist").alias("n_corporate"), F.element_at("rules.ai_tells", 1).alias("first_tell"))


@query(_PROFILES + """SELECT lang, 'target taken from ' || derived_from AS first_line, 'typical words: ' || array_to_string(vocab_anchors[1:12], ' ') AS last_line FROM targets JOIN vocab_anchors USING (lang)""")
def profile_summaries(spark, sf_dir):
    text = profiles(spark, sf_dir).select("lang", F.split(voice.profile_summary(), "\n").alias("lines"))
    return text.select("lang", F.element_at("lines", 1).alias("first_line"), F.element_at("lines", -1).alias("last_line"))


_VIOLATIONS = """, v2 AS (SELECT doc_id, score, unnest([{'i': 0, 'rule': 'em_dash_banned', 's': 1, 'p': p_em}, {'i': 1, 'rule': 'corporate_word', 's': 2, 'p': 8 * least(corporate_word, 3)}, {'i': 2, 'rule': 'ai_tell', 's': 2, 'p': 8 * least(ai_tell, 4)},
{'i': 3, 'rule': 'filler_in_writing', 's': 2, 'p': 6 * least(filler_in_writing, 3)}, {'i': 4, 'rule': 'inflated_claim', 's': 2, 'p': 6 * least(inflated_claim, 3)}, {'i': 5, 'rule': 'hedge', 's': 3, 'p': 3 * least(hedge, 3)}, {'i': 6, 'rule': 'no_contractions', 's': 2, 'p': p_con},
{'i': 7, 'rule': 'uniform_rhythm', 's': 2, 'p': p_uni}, {'i': 8, 'rule': 'sentence_too_long', 's': 2, 'p': p_drift}]) AS v FROM scored), v3 AS (SELECT doc_id, score, v.i, v.rule, v.s, v.p FROM v2 WHERE v.p > 0)"""


@query(_sig_sql() + _VIOLATIONS + """ SELECT scored.doc_id, scored.score, count(v3.rule) AS n_violations, coalesce(string_agg(v3.rule, ',' ORDER BY v3.p DESC, v3.i), '') AS by_penalty, coalesce(string_agg(v3.rule, ',' ORDER BY v3.s, v3.p DESC, v3.i), '') AS by_severity,
'draft scores ' || scored.score || ' of 100 ' || rpad(repeat('#', scored.score // 5), 20, '-') AS head FROM scored LEFT JOIN v3 ON v3.doc_id = scored.doc_id GROUP BY ALL""")
def draft_audits(spark, sf_dir):
    out = voice.audited(docs(spark, sf_dir), RULES)
    rules = lambda ordered: F.array_join(F.transform(ordered, lambda v: v["rule"]), ",")
    return out.select("doc_id", "score", F.size("violations").cast("long").alias("n_violations"), rules(voice.ordered_violations(False)).alias("by_penalty"), rules(voice.ordered_violations(True)).alias("by_severity"), F.element_at(F.split("report", "\n"), 1).alias("head"))


@query(r"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\bthe\b', 'thee', 'g'), '(?i)\bof\b', 'pertaining to', 'g') AS t FROM documents),
d AS (SELECT doc_id, CASE WHEN contains(t, ', ') THEN regexp_replace(t, ', ', ' — ') WHEN contains(t, '. ') THEN regexp_replace(t, '\. ', ' — ') ELSE t END AS t FROM r)
SELECT doc_id, sha256('Consequently, ' || lower(substr(t, 1, 1)) || substr(t, 2)) AS body FROM d""")
def stilted_documents(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.sha2(voice.stilted(F.col("text"), {"the": "thee"}, {"of": "pertaining to"}), 256).alias("body"))


@query()
def rewrite_demo(spark, sf_dir):
    """Scores before and after the rewrite; SQL has no look-behind for it, so tests hold it against scores of rewritten texts."""
    return voice.rewrite_demo(docs(spark, sf_dir), ["doc_id"], RULES, {"license": "permit"}, ("the and",))


@query(_sig_sql() + """, j AS (SELECT lang, score, quality = 1 AS good FROM scored JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS rk FROM j),
a AS (SELECT lang, count(*) FILTER (good) AS n_pos, count(*) FILTER (NOT good) AS n_neg, round((sum(rk) FILTER (good) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2) / (count(*) FILTER (good) * count(*) FILTER (NOT good)), 9) AS auc FROM r GROUP BY lang)
SELECT lang, auc >= 0.5 AS passed, CASE WHEN auc >= 0.5 THEN 'pass' ELSE 'below target' END AS verdict, n_pos || ' positive, ' || n_neg || ' negative' AS last_line FROM a""")
def evaluation_reports(spark, sf_dir):
    drafts = judged_drafts(spark, sf_dir)
    summary = scoring.roc_auc(drafts, "score", "good", ["lang"]).join(scoring.best_threshold(drafts, "score", "good", ["lang"]), "lang").join(scoring.discrimination(drafts, "score", "good", ["lang"]), "lang")
    lines = voice.evaluation_report(summary, ["lang"], 0.5).withColumn("lines", F.split("report", "\n"))
    return lines.select("lang", "passed", F.element_at(F.split(F.element_at("lines", 1), ": "), 2).alias("verdict"), F.element_at("lines", -1).alias("last_line"))


@query(_sig_sql() + """ SELECT lang, list_sort(list_distinct(flatten(list([CASE WHEN n_sentences > 0 AND mean >= 4 AND mean <= 10 THEN 'sentence rhythm' END, CASE WHEN contractions > 0 THEN 'contractions' END, CASE WHEN em = 0 THEN 'punctuation' END,
CASE WHEN corporate_word = 0 AND ai_tell = 0 THEN 'plain language' END])))) AS traits, sum((n_sentences > 0 AND mean >= 4 AND mean <= 10)::INT)::BIGINT AS rhythm, sum((contractions > 0)::INT)::BIGINT AS contracted FROM scored GROUP BY lang""")
def voice_traits(spark, sf_dir):
    found = scoring.signals(docs(spark, sf_dir), RULES).select("lang", scoring.voice_matches(RULES).alias("m"))
    has = lambda t: F.count_if(F.array_contains("m", t))
    return found.groupBy("lang").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("m")))).alias("traits"), has("sentence rhythm").alias("rhythm"), has("contractions").alias("contracted"))


@query(f"""WITH t AS (SELECT lang, doc_id, w[i] AS gram, i FROM (SELECT lang, doc_id, {TOK.format('text')} AS w, unnest(range(1, len({TOK.format('text')}) + 1)) AS i FROM documents)), c AS (SELECT lang, gram, count(*) AS n, min(doc_id * 1000000 + i) AS f FROM t GROUP BY ALL)
SELECT lang, gram, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS rank FROM c) WHERE rank <= 40""")
def counter_top_k(spark, sf_dir):
    return profile.first_seen_top(docs(spark, sf_dir), ["lang"], ["doc_id"], 40).select("lang", "gram", "n", "rank")


@query("SELECT doc_id, n_chars % 101 AS score, rpad(repeat('#', ((n_chars % 101) * 20 // 100)::INT), 20, '-') AS bar, '[[' || source || '/' || lang || ']]' AS link FROM documents")
def score_bars(spark, sf_dir):
    score = F.col("n_chars") % 101
    return docs(spark, sf_dir).select("doc_id", score.alias("score"), T.score_bar(score).alias("bar"), T.wikilink(F.concat_ws("/", "source", F.concat("lang", F.lit(".md")))).alias("link"))


