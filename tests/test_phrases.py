"""Phrase lists of any length in one pass: as the pattern of each phrase counts them, and in time that the list's length doesn't set."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loamworks.functions import text as T
from loamworks.operators import phrases


def table(spark, rows):
    return spark.createDataFrame(rows, "lexicon string, phrase string")


def test_as_the_patterns_count(spark):
    rng = random.Random(2)
    words = ["a", "b", "so", "Yeah", "ß", "don't", "1"]
    listed = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(60)} | {"so  yeah", "A b"})
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", ", ", "-", "", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "so yeah"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {(r.k, r.phrase): r.n for r in phrases.phrase_matches(df, "k", "t", table(spark, [("x", p) for p in listed])).collect()}
    wide = df.select("k", *(T.phrase_count(F.col("t"), p).alias(str(i)) for i, p in enumerate(listed))).collect()
    assert got == {(r.k, p): r[i + 1] for r in wide for i, p in enumerate(listed) if r[i + 1]}
    assert len(got) > 100


def test_lists_and_odd_phrases(spark):
    df = spark.createDataFrame([(1, "so yeah so Yeah"), (1, "so"), (2, None)], "phrase int, lexicon string")
    listed = table(spark, [("x", "so yeah"), ("y", "so yeah"), ("x", "so yeah"), ("x", "SO YEAH"), ("x", " "), ("x", ""), ("x", None), ("y", "yeah so")])
    got = sorted(tuple(r) for r in phrases.phrase_matches(df.toDF("k", "t"), "k", "t", listed).collect())
    assert got == [(1, "x", "SO YEAH", 2), (1, "x", "so yeah", 2), (1, "y", "so yeah", 2), (1, "y", "yeah so", 1)]
    assert phrases.phrase_matches(df.toDF("k", "t"), "k", "t", listed.limit(0)).count() == 0
    with pytest.raises(ValueError, match="more than 3"):
        phrases.phrase_matches(df.toDF("k", "t"), "k", "t", listed, most=3)


def test_time_of_many_phrases():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts = [" ".join(word() for _ in range(400)) for _ in range(300)]
    many = sorted({f"{word()} {word()}" for _ in range(520)})[:500]

    def seconds(listed):
        found, best = phrases.automaton(listed), 9.0
        for _ in range(3):
            start = time.perf_counter()
            for t in texts:
                phrases.counts_in(t, found)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(many) < 2 * seconds(many[:5]) + 0.05


def test_found_phrases_go_out_by_slices(spark, monkeypatch):
    """A task has what is found in a few texts at once, not in a whole batch; results are those of all rows."""
    monkeypatch.setattr(phrases, "SLICE_ROWS", 3)
    df = spark.range(100).select("id", F.lit("red ring and a red bolt").alias("t")).coalesce(1)
    found = phrases.phrase_matches(df, "id", "t", table(spark, [("x", "red"), ("y", "a red bolt")]))
    assert {tuple(r) for r in found.collect()} == {(i, *x) for i in range(100) for x in (("x", "red", 2), ("y", "a red bolt", 1))}


def test_ends_that_are_no_letters():
    listed = ["-x", "x-", "--", "_a", "a_", "é²", "x"]
    found = phrases.automaton(listed)
    plain = lambda t, p: len(re.findall(rf"(?<![^\W_]){re.escape(p)}(?![^\W_])", t))
    for t in ("-x a-x --x x-- x-x -x-x", "_a a_ _a_ b_a ---- é² aé² x²", "-", "x"):
        assert phrases.counts_in(t, found) == {k: n for k, p in enumerate(listed) if (n := plain(t, p))}


def test_more_phrases_than_an_automaton_holds(spark, monkeypatch):
    """Very long lists take several passes and are not refused; each phrase is found once, and totals are the same."""
    monkeypatch.setattr(phrases, "MOST_PHRASES", 7)
    listed = table(spark, [(f"l{i % 3}", f"w{i}") for i in range(40)] + [("l0", "W1"), ("l2", "w1"), ("l1", "w1 w2"), ("l1", None)])
    df = spark.createDataFrame([(i, "en" if i % 2 else "de", f"w{i} w1 w2, w{i + 1} w1") for i in range(30)] + [(1, "en", None)], "id int, lang string, t string")
    got = sorted(map(tuple, phrases.phrase_matches(df, "id", "t", listed).collect()))
    totals = sorted(map(tuple, phrases.phrase_totals(df, "id", "t", listed, ["lang"]).collect()))
    monkeypatch.setattr(phrases, "MOST_PHRASES", 1000)
    assert got == sorted(map(tuple, phrases.phrase_matches(df, "id", "t", listed).collect())) and len(got) > 150
    want = {}
    for i, lexicon, _, n in got:
        want.setdefault(("en" if i % 2 else "de", lexicon), []).append((i, n))
    assert totals == sorted((*k, sum(n for _, n in v), len({i for i, _ in v})) for k, v in want.items())


def test_hundreds_of_thousands_of_phrases(spark):
    """They were refused: openings of some hundred thousand conversations are as many phrases."""
    listed = spark.range(200_001).select(F.lit("x").alias("lexicon"), F.concat(F.lit("p"), "id").alias("phrase"))
    df = spark.createDataFrame([(1, "en", "P1 p200000 p200001, p5 p5"), (2, "de", "none")], "id int, lang string, t string")
    assert [tuple(r) for r in phrases.phrase_totals(df, "id", "t", listed, ["lang"]).collect()] == [("en", "x", 4, 1)]
