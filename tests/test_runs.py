"""Profiles, contexts, configurations and copies that SQL over the given tables doesn't show."""

import pytest
from pyspark.sql import functions as F

from loamworks.functions import lexicon as L
from loamworks.functions import text as T
from loamworks.operators import profile, reconcile, routing, runs, scoring, voice


def test_rewrite_demo_is_two_scores(spark):
    rows = [(1, "Accordingly, we Purchase it — so yeah, it is groundbreaking."), (2, "It's fine."), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: (r.before_score, r.after_score, r.delta) for r in voice.rewrite_demo(df, ["id"]).collect()}
    before = {r.id: r.score for r in scoring.scored(df).collect()}
    after = {r.id: r.score for r in scoring.scored(df.withColumn("text", T.rewritten(F.col("text"), L.SWAPS, L.CONNECTORS, L.FILLER))).collect()}
    assert got == {i: (before[i], after[i], None if before[i] is None else after[i] - before[i]) for i in before}
    assert got[1][1] > got[1][0] and got[2][2] == 0


def test_profile_falls_back_to_speech(spark):
    rows = [("a", "speech", "so yeah I'm here. We talk now. You know it."), ("a", "note", "One — two."), ("b", "polished", "Short — one."), ("b", "note", "Other words here. More of them."), ("c", None, "")]
    df = spark.createDataFrame(rows, "g string, kind string, text string")
    out = {r.g: r for r in voice.build_profile(df, ["g"], "kind", ("polished",), "speech").collect()}
    assert (out["a"].derived_from, out["a"].source_of, out["a"].filler_per_1k, out["a"].em_dash_allowed, out["a"].mean) == ("speech", "speech", 0.0, False, pytest.approx(10 / 3, abs=1e-6))
    assert (out["b"].source_of, out["b"].em_dash_allowed) == ("overall", True) and "talk" in out["a"].vocab_anchors and out["c"].vocab_anchors == []
    written = voice.build_profile(df, ["g"], "kind", ("polished",), "speech", least_words=2).where("g = 'b'").first()
    assert (written.derived_from, written.mean) == ("writing", 3.0)
    rules = voice.to_rules(voice.build_profile(df, ["g"], "kind", ("polished",), "speech"), ["g"]).first().rules
    assert rules.score_weights == L.WEIGHTS and rules.hedges == sorted(L.HEDGES)


def test_audit_report(spark):
    df = spark.createDataFrame([("It is groundbreaking — presumably.",), ("It's fine.",)], "text string")
    bad, good = voice.audited(df).collect()
    assert [v.rule for v in bad.violations] == ["em_dash_banned", "inflated_claim", "hedge", "no_contractions"]
    lines = bad.report.split("\n")
    assert lines[0].startswith(f"draft scores {bad.score} of 100 ") and lines[2] == "# against the profile" and lines[3].startswith("hard em_dash_banned costs 30: ") and "# to do, in this order" in lines
    assert bad.breakdown == {"em_dash_banned": 30, "inflated_claim": 6, "hedge": 3, "no_contractions": 10} and good.plan == [] and "# to do" not in good.report


def test_page_context_with_sections(spark):
    page = ["intro", "## A", "a one", "a two", "## B", "zebra stripes here", "nothing", "# no", "## C", "zebra"]
    lines = spark.createDataFrame([("p", i, x) for i, x in enumerate(page)] + [("q", 0, "alone")], "page string, pos int, line string")
    wanted = spark.createDataFrame([("p", "A")], "page string, section string")
    facts = spark.createDataFrame([("p", 1, "zebra stripes"), ("q", 2, "x")], "page string, fact int, content string")
    out = {r.page: r for r in reconcile.page_contexts(lines, wanted, facts, 1000).collect()}
    assert out["p"].lines == ["intro", "## A", "a one", "a two", "zebra stripes here", "zebra"] and out["q"].lines == ["alone"]
    tight = {r.page: r for r in reconcile.page_contexts(lines, wanted, facts, 12).collect()}
    assert tight["p"].lines == ["intro", "## A"] and tight["p"].used == 11


def test_spans_and_rosters(spark):
    raw = spark.createDataFrame([('Ann "Annie" Lee (boss)',), ("Bo `x` ★",), ("",)], "raw string")
    assert [tuple(r.s) for r in raw.select(routing.clean_span(F.col("raw")).alias("s")).collect()] == [("Ann Lee", "Annie"), ("Bo", None), ("", None)]
    lines = spark.createDataFrame([("v", "people.md", 0, "**Zed**"), ("v", "people.md", 1, "## Team"), ("v", "people.md", 2, "- **Ann Lee** and **Zed** and **12**")], "vault string, page string, pos int, line string")
    assert {(r.name, r.section) for r in routing.roster_index(lines).collect()} == {("zed", "People"), ("ann lee", "Team")}


def test_configuration_lookup_and_copies(spark, tmp_path):
    rows = runs.vault_config(spark, '[vaults.a]\nroot = "/a"\nroute_exclude = ["/x/", 3]\n[vaults.b]\nroot = 1\n').collect()
    assert [tuple(r) for r in rows] == [("a", "/a", "", False, [], ["x"])]
    assert runs.vault_config(spark, "x = 1").count() == 0
    cache, wanted = spark.createDataFrame([(1, "x")], "k long, v string"), spark.createDataFrame([(1,)], "k long")
    assert runs.cached_lookup(cache, wanted, "k", lambda: pytest.fail("built anew")).first().v == "x"
    at = f"file://{tmp_path}/t"
    cache.write.parquet(at)
    assert runs.backed_up(spark, at, at + "-copy") == 1
    with pytest.raises(Exception):
        runs.backed_up(spark, at, at + "-copy")


def test_ties_by_first_place(spark):
    df = spark.createDataFrame([("g", 2, "b a"), ("g", 1, "c b a c")], "g string, n int, text string")
    assert [(r.gram, r.n) for r in profile.first_seen_top(df, ["g"], ["n"], 9).orderBy("rank").collect()] == [("c", 2), ("b", 2), ("a", 2)]
