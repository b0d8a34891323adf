import random
import re
from collections import Counter

from pyspark.sql import functions as F

from loamworks.llm.quality import measures, quality_rules, sketches

from .conftest import ODD


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_counts(odd, sample, docs):
    more = [(50, "a b c a b c"), (51, "a a a a"), (52, "x\nx\n\n \nx "), (53, "# $ a|b <c> & * %"), (54, "a b"), (55, "p q r s p q r t p q r")]
    for df, rows in ((odd, ODD), (docs(more), more), (sample[0], [r[:2] for r in sample[1]])):
        got = sorted((str(r.doc_id), *(r[n] for n in NAMES)) for r in measures(df).collect())
        assert got == sorted((str(d), *plain(t)) for d, t in rows)


def test_verdicts_follow_the_quality_label(spark):
    base = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{base}/documents.parquet")
    marked = quality_rules(df).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r for r in marked if r.quality == 1], [r for r in marked if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in bad) <= 0.1 * len(bad)


def test_odd_rows(odd, docs):
    rows = quality_rules(odd).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows)
    assert quality_rules(docs([])).count() == 0
    text = " ".join(f"word{i}" for i in range(60))
    df = docs([(1, text, None, None, 1), (2, text, "en", None, 1)]).withColumn("bucket", F.lit(1)).withColumn("rows", F.lit(2))
    assert [r.kept for r in quality_rules(df).collect()] == [True, True]


def test_groups_have_cutoffs_of_their_own(docs):
    """The same text is kept where its like is common and dropped where it isn't; a group of equal values keeps itself."""
    rng = random.Random(5)
    plain_text = lambda: [f"w{rng.randrange(10**6):06d}" for _ in range(80)]
    marked = lambda n: " ".join(w + "#" * (i < n) for i, w in enumerate(plain_text()))
    rows = [(k, marked(rng.randrange(5, 30)), "en", "code", 0) for k in range(100)]
    rows += [(100 + k, marked(0), "en", "prose", 0) for k in range(100)] + [(200 + k, marked(7), "de", "equal", 0) for k in range(60)]
    rows += [(900, marked(20), "en", "code", 0), (901, marked(20), "en", "prose", 0), (902, marked(79), "en", "code", 0)]
    kept = {r.doc_id: r.kept for r in quality_rules(docs(rows), least_rows=50).collect()}
    assert kept[900] and not kept[901] and sum(kept[k] for k in range(100)) >= 99 and all(kept[k] for k in range(100, 260))
    # Groups of too few rows have the thresholds of their language.
    few = {r.doc_id: r.kept for r in quality_rules(docs(rows), least_rows=150).collect()}
    assert few[900] == few[901]


def test_sketches_merge(spark, sample):
    rows = measures(sample[0])
    halves = sketches(rows.where("doc_id % 2 = 0")).union(sketches(rows.where("doc_id % 2 = 1")))
    merged = halves.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))
    assert sorted(map(str, merged.collect())) == sorted(map(str, sketches(rows).collect()))


def test_where_nearly_all_have_none(docs):
    """The upper quantile is zero: a stray symbol passes, what is like most that have any doesn't; without any, none is drawn."""
    rng = random.Random(6)
    marked = lambda n: " ".join(f"w{rng.randrange(10**6):06d}" + "#" * (i < n) for i in range(80))
    rows = [(k, marked(0), "en", "s", 0) for k in range(400)] + [(1000 + k, marked(rng.randrange(50, 80)), "en", "s", 0) for k in range(20)]
    rows += [(2000 + k, marked(1), "en", "s", 0) for k in range(4)] + [(3000 + k, marked(0), "de", "s", 0) for k in range(60)]
    kept = {r.doc_id: r.kept for r in quality_rules(docs(rows), least_rows=50).collect()}
    assert not any(kept[1000 + k] for k in range(20)) and all(v for k, v in kept.items() if not 1000 <= k < 2000)
