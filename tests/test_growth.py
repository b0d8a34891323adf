"""Queries whose work must not grow faster than their tables."""

import random
import time

from pyspark.sql import functions as F

from loamworks.functions import text as T
from loamworks.operators import grid, profile, retrieval, similarity, voice
from loamworks.operators.pages import fold_edits
from loamworks.plans import corpus, edits


def test_boost_totals_are_those_of_the_pairs(spark):
    pages = spark.createDataFrame([(i, ("red ring", "ring", "", None)[i % 4]) for i in range(60)], "key int, title string")
    asked = spark.createDataFrame([(i, "a red ring and a ring" if i % 3 else "one ring") for i in range(30)] + [(99, None), (98, "none")], "q int, t string")
    want = {(r.q, r.n, r.s) for r in retrieval.boosts(asked, "q", "t", pages, "key", "title").groupBy("q").agg(F.count("*").alias("n"), F.sum("boost").alias("s")).collect()}
    assert {(r.q, r.pages, r.boost) for r in retrieval.boost_totals(asked, "q", "t", pages, "key", "title").collect()} == want and len(want) == 30


def test_queries_that_no_page_tells_apart_are_scored_once(spark, monkeypatch):
    pages = spark.createDataFrame([("v", f"wiki/p{i}.md", "red ring" if i % 2 else "blue bolt", ["small"], "on metal", f"about {i}") for i in range(9)], "vault string, page string, title string, headings array<string>, purpose string, overview string")
    texts = ["red ring metal", "ring red metal", "red ring metal metal", "red ring metal, says a friend", "nothing", None]
    asked = spark.createDataFrame([(i, t if t is None else f"{t} unknown{i}") for i, t in enumerate(texts * 4)], "q int, t string")
    scored, bm25 = [], retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda queries, *a: scored.append(queries.count()) or bm25(queries, *a))
    got = sorted(map(tuple, retrieval.search_pages(asked, "q", "t", pages, 3).select("q", "vault", "page", "score", "rank").collect()))
    assert scored == [5]
    alone = [tuple(r) for q in range(6) for r in retrieval.search_pages(asked.where(F.col("q") == q), "q", "t", pages, 3).select("q", "vault", "page", "score", "rank").collect()]
    assert got == sorted((q + 6 * n, *rest) for q, *rest in alone for n in range(4))


def test_very_many_appends_to_one_page_take_time_in_proportion():
    edit = lambda seq, action, content, **more: dict.fromkeys(("section", "old_content", "previous_line", "next_line")) | {"seq": seq, "action": action, "section": "In", "content": content} | more
    many = [edit(i, "append", f"line {i}") for i in range(100_000)]
    begun = time.monotonic()
    lines, fault, seq = fold_edits(["# Inbox", "## In", "a", " ", "## Out", "b"], many)
    assert time.monotonic() - begun < 10 and fault is None and seq is None
    assert lines[:4] == ["# Inbox", "## In", "a", "line 0"] and lines[-4:] == ["line 99999", " ", "## Out", "b"] and len(lines) == 100_006
    # A blank line and a heading move the place; another section, an edit and a fault end a run.
    mixed = [edit(0, "append", "x"), edit(1, "append", "\t"), edit(2, "append", "y"), edit(3, "append", "# z"), edit(4, "append", "u"), edit(5, "append", "v", section="New"), edit(6, "append", "w", section="New"), edit(7, "remove", "y"), edit(8, "append", "q"), edit(9, "append", "q"), edit(10, "append", "r")]
    assert fold_edits(["## In"], mixed) == (["## In", "x", "u", "q", "# z", "\t", "", "## New", "v", "w"], "line is there already", 9)


def test_profiles_join_no_texts(spark, monkeypatch):
    """Only counts meet the targets of a group: texts joined by it would all of a language come to one task."""
    rows = [(i, "en" if i % 5 else "de", f"s{i % 4}", f"The long word{i % 7} is here. Is it? " * 6) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, lang string, source string, text string")
    joined, join = [], type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, other, *a: joined.append({*self.columns, *other.columns}) or join(self, other, *a))
    profile = voice.build_profile(df, ["lang"], "source", ("s0",), "s2", ("the",), ("the", "is"))
    assert joined and not any("text" in columns for columns in joined)
    assert sorted((r.lang, r.derived_from, r.vocab_anchors[0]) for r in profile.collect()) == [("de", "writing", "here"), ("en", "writing", "here")]


def test_lines_are_counted_without_a_lambda(spark):
    """A lambda over the lines of a text would split it again for each line."""
    df = spark.createDataFrame([("a\nb\na", "a"), ("a\nb", "c"), ("", ""), ("a", None)], "t string, x string").select(edits.times(F.split("t", "\n"), F.col("x")).alias("n"))
    assert [r.n for r in df.collect()] == [2, 0, 1, None] and "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_met_by_blocks_are_those_of_all_rows(spark, monkeypatch):
    """Many small blocks, copies too: all pairs, each once, and no row for a pair and a term."""
    monkeypatch.setattr(grid, "MOST_ROWS", 40)
    monkeypatch.setattr(grid, "SCORES", 100)
    monkeypatch.setattr(grid, "LOOKED_UP", 50)
    rng = random.Random(5)
    rows = [(i, [f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randrange(0, 9))]) for i in range(120)]
    rows += [(200 + i, rng.choice(rows)[1][::-1]) for i in range(40)] + [(300, None), (301, [])]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    vectors = {}
    for w in similarity.tfidf(df, "k", "tokens").collect():
        vectors.setdefault(w.k, {})[w.term] = w.weight
    product = lambda a, b: sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items())
    want = {(a, b): (round(product(a, b), 9), len(vectors[a].keys() & vectors[b].keys())) for a in vectors for b in vectors if a < b and product(a, b) >= 0.6}
    pairs = similarity.row_pairs(df, "k", "tokens", 0.6)
    assert "[term" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    got = [(r.a, r.b, round(r.similarity, 9), r.shared) for r in pairs.collect()]
    assert sorted(got) == sorted((*k, *v) for k, v in want.items()) and len(want) > 100
    plain = similarity.clusters(spark.createDataFrame(list(want), "a int, b int"), df, "k")
    assert sorted(map(tuple, similarity.row_clusters(df, "k", "tokens", 0.6).collect())) == sorted(map(tuple, plain.collect()))


def test_near_pairs_move_no_row_for_a_block(spark, monkeypatch):
    """Blocks are broadcast: a row repeated for each block it meets took disk with the square of the table."""
    monkeypatch.setattr(grid, "MOST_ROWS", 5)
    rows = [(i, ["to", "fro"][i % 2] if i % 7 else None, [f"w{i % 4}", f"w{i % 3}", "x"][: 3 - (i == 8)]) for i in range(40)]
    df = spark.createDataFrame(rows, "k int, target string, tokens array<string>")
    for found in (similarity.row_pairs(df, "k", "tokens", 0.5), similarity.conflicts(df, "k", "target", "tokens", 0.5)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and not any(x in plan for x in ("Generate", "Repartition", "FlatMapGroups"))
    plain = similarity.row_pairs(df, "k", "tokens", 0.5).where("shared >= 2")
    to = lambda c: df.select(F.col("k").alias(c), F.col("target").alias(f"{c}_target"))
    want = plain.join(to("a"), "a").join(to("b"), "b").where("a_target <> b_target")
    cut = lambda d: sorted((r.a, r.b, round(r.similarity, 9), r.shared, r.a_target, r.b_target) for r in d.collect())
    assert cut(similarity.conflicts(df, "k", "target", "tokens", 0.5)) == cut(want) and want.count() > 100


def test_best_lines_by_blocks(spark, monkeypatch):
    """A section of many blocks, ties too: the lines are those of a plain count; a task's products give no rows."""
    monkeypatch.setattr(grid, "MOST_LINES", 50)
    monkeypatch.setattr(grid, "LEAST_LINES", 1)
    monkeypatch.setattr(grid, "MOST_FACTS", 7)
    monkeypatch.setattr(grid, "SCORES", 300)
    rng = random.Random(6)
    text = lambda n: " ".join(f"word{int(rng.expovariate(0.05))}" for _ in range(rng.randrange(n)))
    lines = [(rng.choice("abbbbb"), i, text(12)) for i in range(700)] + [("b", 1000 + i, "word1 word2") for i in range(60)] + [(None, 2000, "word1"), ("b", 2001, None)]
    facts = [(rng.choice("abbbc"), i, text(40)) for i in range(40)] + [(None, 90, "word1"), ("b", 91, None)]
    frame = lambda rows, key: spark.createDataFrame(rows, f"section string, {key} int, t string")
    want = []
    for s, f, t in facts:
        shared = [(-len({*t.split()} & {*u.split()}), n) for r, n, u in lines if t and u and s and r == s]
        want += [(f, n, -o, rank) for rank, (o, n) in enumerate(sorted(x for x in shared if x[0])[:5], 1)]
    got = retrieval.lexical_matches(frame(lines, "line_no"), "section", "line_no", "t", frame(facts, "fact"), "fact", "t", 5)
    assert "[section, term" not in got._jdf.queryExecution().optimizedPlan().toString() and "Join Inner" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.fact, r.line_no, r.overlap, r["rank"]) for r in got.collect()) == sorted(want) and len(want) > 100


def test_grams_are_made_without_a_lambda(spark):
    """A lambda for each run of words took most of the time; results are those of a plain count."""
    df = spark.createDataFrame([("x", "The end of the end. A b"), ("x", "of the"), ("y", "one"), ("y", None), (None, "a b c")], "g string, text string")
    grams = profile.kept_grams(df, 2, ["g"], ("of", "the"))
    assert "lambda" not in grams._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.g or "", r.gram) for r in grams.collect()) == [("", "a b"), ("", "b c"), ("x", "a b"), ("x", "end a"), ("x", "end of"), ("x", "the end"), ("x", "the end")]


def test_rules_are_looked_at_once(spark, monkeypatch):
    """explode() brings a filter that holds all rules again; counts of texts that break none stay out."""
    df = corpus.score_breakdown(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= len([p for _, _, ps in corpus.RULES.phrase_rules for p in ps])
    assert df.where("component IS NULL").count() == 0


def test_best_pages_without_rows_for_pairs(spark, monkeypatch):
    """Tasks, groups of queries and small matrices, ties and repeated keys: the pages are those of bm25() over all pairs."""
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 7)
    monkeypatch.setattr(retrieval, "PAGE_TERMS", 400)
    monkeypatch.setattr(retrieval, "HELD", 60)
    rng = random.Random(8)
    text = lambda n: " ".join(f"W{int(rng.expovariate(0.1))}{rng.choice(['', '-x', ', I', 'é', '_'])}" for _ in range(rng.randrange(n)))
    pages = [(i, text(30), rng.choice("ab") + "b") for i in range(150)] + [(1000 + i, "W1 w2 w3", "bb") for i in range(9)] + [(3, "w1 w9", "ab"), (2000, None, None), (None, "w1 w2", "ab")]
    df = spark.createDataFrame(pages, "k int, t string, s string").repartition(5)
    asked = spark.createDataFrame([(i, text(12)) for i in range(20)] + [(90, "w1 w2 W3"), (91, None), (92, "none")], "q int, t string")
    fields = {"t": 1, "s": 5}
    pairs = retrieval.bm25(asked, "q", "t", retrieval.postings(df, "k", fields), "k").select("q", "k", F.round("bm25", 6).alias("score"))
    want = retrieval.top_k(pairs, "q", [F.desc("score"), F.asc("k")], 4)
    got = retrieval.search(asked, "q", "t", df, "k", fields, 4)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.select("q", "k", "score", "rank").collect())) == sorted(map(tuple, want.select("q", "k", "score", "rank").collect())) and want.count() > 60


def test_sentences_are_not_split_one_by_one(spark):
    """Words of all sentences are counted in the whole text: only the text is split, by its ends of sentences."""
    texts = ["One two. Dr. A\tb!  C? d", "", None, " . ! ? ", "a\u00a0b c.\nd", "x. \x01y z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.sentence_lengths(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [[2, 3, 1, 1], [], None, [1, 1, 1], [2, 1], [1, 2]]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "array_remove" not in plan


def test_rewrites_look_only_in_texts_that_have_the_words(spark):
    rows = ["Purchase it — so, of the TERMINATE.", "terminate  x ; Accordingly, y. accordingly z", "none", "", None, "OF THE end,of the,x"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    out = df.select(T.rewritten(F.col("t"), {"purchase": "buy", "terminate": "end"}, ("accordingly",), ("of the",)).alias("t"))
    assert [r.t for r in out.collect()] == ["Buy it, so TERMINATE.", "end x; Accordingly, y. z", "none", "", None, "endx"]
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("contains(") == 7


def test_texts_are_lowered_once(spark):
    """A lambda's argument isn't shared: each phrase made the lower case of the whole text again."""
    plan = corpus.score_breakdown(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("regexp_replace(") == 2
    texts = ["Dr. Who? Mr. X met  Mrs.\nY!\n\n(etc.) no. Amr. b", " \t ", ".\x01 \x01a", "a.b c .", "é. ÀMR. x MR. y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(T.sentence_lengths(F.col("t")).alias("n")).collect()]
    assert got == [[2, 5, 2, 1, 1], [], [1, 1], [3], [1, 1, 3]]
    split = df.select(F.transform(T.sentences(F.col("t")), T.word_count).alias("n"))
    assert [r.n for r in split.collect()][::2] == got[::2]
