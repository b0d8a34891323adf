"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, exact_dedup, langid, packing, periodic, quality, secrets, sharding, suffix_dedup, toxicity, wrappers
from . import simhash as sim
from .common import NOT_SPACE, documents, labels, pages

SHARDS = 24


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = sim.near_components(sim.simhash(documents(spark, sf_dir), shingle=3), distance=2, blocks=4)
    return linked.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.span_text(secrets.BASE), 256).alias("base_sha256"), secrets.span_text().alias("spans"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(documents(spark, sf_dir), least=50)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), packing.Capacity(tokens=1024), end=2)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(documents(spark, sf_dir), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity.train(docs, labels(spark, sf_dir)))
    return scored.select("doc_id", (toxicity.fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", (langid.fold() == 2).alias("held_out"), "lang_pred", "score")


def with_cycles(docs: DataFrame) -> DataFrame:
    """Documents of which each tenth (by a checksum of the id) goes on repeating some of its words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"{NOT_SPACE}+"), F.lit(0))
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(cycle, F.lit(1), n - a)), " ")
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").rlike(NOT_SPACE), changed).otherwise(F.col("text")))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_cycles(documents(spark, sf_dir).select("doc_id", "text")), least=6, exponent=4)
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(pages(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), least=30, words=4, top=2000)


OP9_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM t
"""

def _op8_sql() -> str:
    """The counts, the buckets and the thresholds of quality.py in SQL."""
    values = " UNION ALL ".join(f"SELECT doc_id, lang, source, base_failed, '{m}' AS measure, {quality.LEVEL[m]}::DOUBLE AS level, CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} ELSE 0 END AS value FROM c" for m, (a, b) in quality.VALUES.items())
    gamma = f"{quality.GAMMA!r}::DOUBLE"
    end = lambda c, less: f"CASE WHEN {c} = {quality.ZERO} THEN 0 ELSE pow({gamma}, {c} - {less}) END"
    high = f"CASE WHEN most = {quality.ZERO} THEN coalesce(pow({gamma}, few) / (1 + {quality.REACH}), 0) ELSE {end('most', 0)} + {quality.REACH} * ({end('most', 0)} - {end('middle', 0)}) END"
    low = f"{end('least', 1)} - {quality.REACH} * ({end('middle', 1)} - {end('least', 1)})"
    held = lambda n: f"CASE WHEN a.total >= {quality.LEAST_ROWS} THEN a.{n} WHEN b.total >= {quality.LEAST_ROWS} THEN b.{n} ELSE e.{n} END"
    return rf"""
WITH m AS (SELECT doc_id, lang, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l,
  length(text) - length(regexp_replace(text, '{quality.SYMBOLS}', '', 'g')) AS symbols FROM documents),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM m)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1) GROUP BY doc_id),
n AS (SELECT m.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, coalesce(symbols, 0)::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM m LEFT JOIN cov USING (doc_id)),
c AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n),
r AS ({values}),
s AS (SELECT lang, source, measure, level AS p, CASE WHEN value <= 0 THEN {quality.ZERO} ELSE ceil(ln(value) / ln({gamma}))::INT END AS bucket, count(*) AS n FROM r WHERE NOT base_failed GROUP BY ALL),
u AS (SELECT 1 AS level, * FROM s UNION ALL SELECT 2, lang, NULL, measure, p, bucket, sum(n) FROM s GROUP BY ALL UNION ALL SELECT 3, NULL, NULL, measure, p, bucket, sum(n) FROM s GROUP BY ALL),
k AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total, coalesce(sum(n) FILTER (bucket = {quality.ZERO}) OVER (PARTITION BY level, lang, source, measure), 0) AS without FROM u),
q AS (SELECT level, lang, source, measure, max(total) AS total, min(bucket) FILTER (upto >= (1 - p) * total) AS least, min(bucket) FILTER (upto >= 0.5 * total) AS middle, min(bucket) FILTER (upto >= p * total) AS most,
  min(bucket) FILTER (bucket > {quality.ZERO} AND upto - without >= 0.25 * (total - without)) AS few FROM k GROUP BY ALL),
f AS (SELECT level, lang, source, measure, total, {low} AS low, {high} AS high FROM q),
o AS (SELECT r.doc_id, bool_or(value > {held("high")} OR (r.measure IN ({", ".join(f"'{x}'" for x in quality.TWO_SIDED)}) AND value < {held("low")})) AS outside
  FROM r JOIN f a ON a.level = 1 AND a.measure = r.measure AND a.lang IS NOT DISTINCT FROM r.lang AND a.source IS NOT DISTINCT FROM r.source
  JOIN f b ON b.level = 2 AND b.measure = r.measure AND b.lang IS NOT DISTINCT FROM r.lang JOIN f e ON e.level = 3 AND e.measure = r.measure GROUP BY r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(outside, FALSE) AS kept FROM c LEFT JOIN o USING (doc_id)
"""


#: The pages of the tables mark their article as such; SQL reads that mark and splits at the tags of blocks.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(html, '<article[^>]*>(.*?)(</article>|$)', 1, 's') AS inner_html FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(inner_html, '</?(p|h1|article|div|ul|li)[^>]*>'), lambda x:
  trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&amp;?', chr(1), 'g'), '&quot;', '"'), '&lt;', '<'), chr(1), '&'), '\s+', ' ', 'g'))) AS blocks FROM a),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(blocks, lambda x: x <> ''), chr(10) || chr(10)), '') AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t
"""

OP13_SQL = r"""
WITH p AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
c AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
f AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE a >= 30),
u AS (SELECT f.lang, f.k, f.phrase, f.a, cut, x.a AS l, y.a AS r, (2000000::HUGEINT * f.a) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM f WHERE k > 1) f
  JOIN (SELECT lang, phrase, a FROM f) x ON x.lang = f.lang JOIN (SELECT lang, phrase, a FROM f) y ON y.lang = f.lang
  AND x.phrase = array_to_string(f.w[1 : cut], ' ') AND y.phrase = array_to_string(f.w[cut + 1 : k], ' ')),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT DISTINCT f.lang, array_to_string(f.w[s : s + m - 1], ' ') AS phrase, f.a AS more FROM f, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS s) WHERE m < f.k AND s + m - 1 <= f.k),
d AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.more >= 80 * b.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM d)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o JOIN t USING (lang) WHERE rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_secrets": op3_secrets,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_langid": op10_langid,
    "op11_runs": op11_runs,
    "op12_pages": op12_pages,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {"op8_quality": _op8_sql(), "op9_exact_dedup": OP9_SQL, "op12_pages": OP12_SQL, "op13_collocations": OP13_SQL}
