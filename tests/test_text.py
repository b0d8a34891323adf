import pytest
from pyspark.sql import functions as F

from loamworks.functions import lexicon as L
from loamworks.functions import text as T
from loamworks.operators import scoring, segments


@pytest.fixture(scope="module")
def value(spark):
    def get(make, *texts):
        names = [f"c{i}" for i in range(len(texts))]
        df = spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names))
        return df.select(make(*map(F.col, names)).alias("v")).first().v

    return get


def test_sentences_and_tokens(value):
    assert value(T.sentences, "Dr. Who paid 3.14 euros.  Then? Left!\nno end") == ["Dr. Who paid 3.14 euros.", "Then?", "Left!", "no end"]
    assert value(T.sentences, "") == [] and value(T.sentences, " \n ") == []
    assert value(T.tokens, "It's 2 O'Clock — Étre") == ["it's", "2", "o'clock", "tre"]
    assert value(lambda c: T.ngrams(T.tokens(c), 2), "a b c") == ["a b", "b c"] and value(lambda c: T.ngrams(T.tokens(c), 2), "a") == []
    assert value(T.contractions, "don't it's we're rock'n") == 3
    assert value(T.paragraphs, "a\n\n \nb\nc\n\n") == ["a", "b\nc"]
    assert value(T.index_tokens, "a bc c++ D-e_f 9") == ["bc", "c++", "d-e_f"]


def test_phrases(value):
    count = lambda p: lambda c: T.phrase_count(c, p)
    assert value(count("at all"), "At  all, at\nall; flat all at allé") == 2
    assert value(lambda c: T.matched_phrases(c, ("b", "a c", "z")), "A  C b") == ["b", "a c"]


def test_small_functions(value):
    assert value(lambda c: T.cue_time(c.cast("double")), "3661.0019") == "01:01:01,001"
    assert value(lambda c: T.cue_time(c.cast("double"), "."), "359999.999") == "99:59:59.999"
    assert value(T.slug, "  Ünïted — Привет! ") == "united-привет" and value(T.slug, "…") == "untitled"
    assert value(T.wikilink, "a/b.md") == "[[a/b]]"
    assert value(lambda c: T.score_bar(c.cast("int"), 10), "35") == "###-------"
    assert value(T.first_non_blank, " ", "x") == "x" and value(T.normalised, " A\t b ") == "a b"
    assert value(T.redacted, "MY_TOKEN=abc; Bearer abcdefghijklmnopqrst. my_token=abc") == "[redacted] [redacted] my_token=abc"
    assert value(T.key_name, " Some-Key 1 ") == "some_key_1"


def test_rewrite(value):
    make = lambda c: T.rewritten(c, L.SWAPS, L.CONNECTORS, L.FILLER)
    once = value(make, "Accordingly, we Purchase it — so yeah, to help.  Consequently go !")
    assert once == "we Buy it to help. go!" and value(make, once) == once


def test_scores(spark):
    rules = scoring.Rules()
    texts = ["", "We groundbreaking — onboarding. It is presumably so.", "It's fine. " * 3]
    rows = scoring.scored(spark.createDataFrame([(t,) for t in texts], "text string"), rules).collect()
    assert [r.score for r in rows] == [100, 43, 100]
    assert [v.rule for v in rows[1].violations] == ["em_dash_banned", "corporate_word", "inflated_claim", "hedge", "no_contractions"]
    uniform = spark.createDataFrame([(" ".join(["One two three four five six seven eight nine."] * 5),), ("word " * 60 + ".",)], "text string")
    assert [[v.rule for v in r.violations] for r in scoring.scored(uniform, rules).collect()] == [["uniform_rhythm"], ["sentence_too_long"]]
    traits = scoring.scored(spark.createDataFrame([("It's plain.",)], "text string"), rules).select(scoring.voice_matches(rules).alias("v")).first().v
    assert traits == ["contractions", "punctuation", "plain language"]


def test_auc_and_threshold(spark):
    rows = [("perfect", s, s > 2) for s in range(5)] + [("reversed", s, s < 2) for s in range(5)] + [("tied", 1, b) for b in (True, False, True)] + [("one", 3, True)]
    df = spark.createDataFrame(rows, "g string, s int, good boolean")
    assert {r.g: r.auc for r in scoring.roc_auc(df, "s", "good", ["g"]).collect()} == {"perfect": 1.0, "reversed": 0.0, "tied": 0.5, "one": 0.5}
    best = {r.g: (r.threshold, r.accuracy) for r in scoring.best_threshold(df, "s", "good", ["g"]).collect()}
    assert best["perfect"] == (2.5, 1.0) and best["one"] == (3.0, 1.0) and best["reversed"] == (4.5, 0.6)


def test_subtitles(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 1.5, " hi "), ("a", 2, 1.5, 2.0, "you")], "f string, n int, s double, e double, t string")
    srt, vtt = (segments.cues(df, ["f"], ["n"], "s", "e", "t", k).first().body for k in ("srt", "vtt"))
    assert srt == "1\n00:00:00,000 --> 00:00:01,500\nhi\n\n2\n00:00:01,500 --> 00:00:02,000\nyou"
    assert vtt.startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.500\nhi")
