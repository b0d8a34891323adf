import json
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from loamworks.operators import contracts, gates, graph, pages, reconcile, retrieval, review, routing, similarity, units
from loamworks.sources import readers
from loamworks.streaming import incremental


def test_components_of_all_lines(spark):
    """The registered query against a union-find over every line."""
    base = "/root/testdata/sf0.001"
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for r in spark.read.parquet(f"{base}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey").collect():
        a, b = sorted((find(r[0]), find(1_000_000_000 + r[1] * 100 + r[2])))
        root[b] = a
    assert dict(queries()["order_components"](spark, base).select("node", "component").collect()) == {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(graph.components(spark.createDataFrame(edges, "a int, b int")).collect()) == label
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_components_of_many_chunks(spark, monkeypatch, chunk):
    """Stars of few edges, more turns than one; paths, hubs, loops, nulls, names and pairs as nodes."""
    monkeypatch.setattr(graph, "CHUNK", chunk)
    rng = random.Random(3)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(40)] + [(i + 1, i) for i in range(100, 160)] + [(300, i) for i in range(301, 340)] + [(400, 400)]
    label = {x: x for e in edges for x in e}
    for _ in range(len(label)):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame([*edges, (None, 5), (500, None)], "a int, b int").repartition(3)
    assert dict(graph.components(df).collect()) == label
    if chunk > 1:
        names = df.select(*(F.format_string("n%04d", c).alias(c) for c in df.columns)).where("a <> 'nnull' AND b <> 'nnull'")
        assert dict(graph.components(names).collect()) == {f"n{x:04d}": f"n{y:04d}" for x, y in label.items()}
        pairs = df.where("a IS NOT NULL AND b IS NOT NULL").select(F.struct(F.col("a").alias("x")).alias("a"), F.struct(F.col("b").alias("x")).alias("b"))
        assert {r.node.x: r.component.x for r in graph.components(pairs).collect()} == label


def test_components_move_few_rows(spark):
    """Of repeated edges and of those within a task's star nothing moves but a row for each node."""
    df = spark.range(200_000).select((F.col("id") % 500).alias("a"), (F.col("id") % 499).alias("b"))
    assert graph._stars(df.coalesce(2), 0).count() <= 2 * 500


def test_cosine_pairs_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [f"w{int(rng.expovariate(0.1))}" for _ in range(rng.randrange(1, 12))]) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    weights = similarity.tfidf(df, "k", "tokens").collect()
    vectors = {}
    for w in weights:
        vectors.setdefault(w.k, {})[w.term] = w.weight
    want = {}
    for a in vectors:
        for b in vectors:
            s = sum(x * vectors[b].get(t, 0) for t, x in vectors[a].items())
            if a < b and s >= 0.6:
                want[a, b] = round(s, 9)
    got = {(r.a, r.b): round(r.similarity, 9) for r in similarity.cosine_pairs(similarity.tfidf(df, "k", "tokens"), "k", 0.6).collect()}
    assert got == want and want


def test_chunks():
    rng = random.Random(3)
    for _ in range(200):
        lines = ["x" * rng.randrange(0, 30) for _ in range(rng.randrange(1, 40))]
        cap, overlap = rng.randrange(10, 60), rng.randrange(0, 10)
        spans = units.chunk_lines(lines, cap, overlap)
        assert spans[0][0] == 0 and spans[-1][1] == len(lines)
        for (a, b), (c, d) in zip(spans, spans[1:]):
            assert a < c <= b <= d
        assert all(b - a == 1 or len("\n".join(lines[a:b]).encode()) <= cap for a, b in spans)


def test_bundles(spark):
    assert units.first_fit([5, 4, 6, 4, 1], 10) == [1, 0, 0, 1, 1]
    assert units.next_fit([5, 4, 6, 4, 1], 10, 2) == [0, 0, 1, 1, 2]
    df = spark.createDataFrame([(i, i % 2, 3 + i % 5) for i in range(40)], "k long, g long, s long")
    rows = units.bundles(df, "k", "s", 10, "g").collect()
    used = {}
    for r in rows:
        used[r.g, r.bundle] = used.get((r.g, r.bundle), 0) + r.s
    assert len(rows) == 40 and max(used.values()) <= 10


def numbered(sizes):
    """Of each item, the how manieth it is of its size."""
    seen = {}
    return [seen.setdefault(s, []).append(0) or len(seen[s]) - 1 for s in sizes]


def test_plan_of_first_fit():
    """By counts of sizes the same bundles as item by item; items larger than a bundle and empty ones included."""
    rng = random.Random(1)
    for _ in range(400):
        cap = rng.choice([7, 10, 50, 100])
        sizes = [rng.choice([0, 1, 2, 3, 5, rng.randint(1, cap + 5)]) for _ in range(rng.randint(0, 120))]
        plan = units.first_fit_plan({s: sizes.count(s) for s in sizes}, cap)
        of = lambda s, n: next(b + (n - first) // per for size, first, m, b, per in plan if size == s and first <= n < first + m)
        assert [of(s, n) for s, n in zip(sizes, numbered(sizes))] == units.first_fit(sizes, cap)


def test_first_fit_over_the_whole_table(spark, monkeypatch):
    rng = random.Random(5)
    sizes = [rng.choice([900, 900, 1, 0, None, rng.randint(0, 1100)]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "k long, s long").repartition(9)
    monkeypatch.setattr(units, "STRETCH", 16)
    got = {r.k: r.bundle for r in units.first_fit_all(df, "k", "s", 1000).collect()}
    assert [got[k] for k in range(3000)] == units.first_fit([s or 0 for s in sizes], 1000)
    assert units.first_fit_all(df.limit(0), "k", "s", 10).count() == 0


def test_all_documents_in_bundles(spark):
    base = "/root/testdata/sf0.01"
    got = queries()["ffd_whole"](spark, base).orderBy("doc_id").collect()
    assert [r.bundle for r in got] == units.first_fit([r["size"] for r in got], 85_000)


def test_boost_without_a_shared_word(spark):
    """A page about people is found by a relation alone; ties by vault and page, no more than k."""
    rows = [("v", f"people/{n}.md", n, [], "", "") for n in ("ann", "bob", "cy")] + [("v", "wiki/x.md", "steel", [], "rings", "steel"), ("w", "wiki/red-ring.md", "none", None, None, None)]
    pages_ = spark.createDataFrame(rows, "vault string, page string, title string, headings array<string>, purpose string, overview string")
    asked = spark.createDataFrame([(1, "My MENTOR said so"), (2, "a mentor of steel rings"), (3, "the red ring"), (4, "")], "q int, t string")
    got = [(r.q, r.page, r["rank"]) for r in retrieval.search_pages(asked, "q", "t", pages_, 2).orderBy("q", "rank").collect()]
    assert got == [(1, "people/ann.md", 1), (1, "people/bob.md", 2), (2, "wiki/x.md", 1), (2, "people/ann.md", 2), (3, "wiki/red-ring.md", 1)]
    scores = {r.page: r.score for r in retrieval.search_pages(asked.where("q = 1"), "q", "t", pages_, 9).collect()}
    assert scores == {"people/ann.md": 12.0, "people/bob.md": 12.0, "people/cy.md": 12.0}


PAGE = "---\nKind: chat\nstatus: active\nstatus: Archived\nupdated: 2020-01-01\n---\n# Title\nSome prose here.\n\n```\n# not a title\n## no heading\n```\n## First\n- a\n\n## Second\n- [[Other|x]] and [[That#y]]\n"


def test_page_parsing(spark):
    row = readers.page_table(spark.createDataFrame([("p.md", PAGE), ("e.md", "")], "page string, text string")).orderBy("page").collect()
    assert (row[1].title, row[1].headings, row[1].overview, row[1].status, row[1].links) == ("Title", ["First", "Second"], "Some prose here.", "Archived", ["Other", "That"])
    assert (row[0].title, row[0].headings, row[0].status) == ("", [], "")


def test_page_edits_and_undo(spark):
    lines = ["# T", "## A", "- one", "", "## B", "- two"]
    page = spark.createDataFrame([("p", lines), ("q", ["x"])], "page string, lines array<string>")
    log = spark.createDataFrame(
        [("p", 1, "append", "A", "- new", None), ("p", 2, "replace", "B", "- 2", "- two"), ("p", 3, "append", "C", "- c", None), ("p", 4, "remove", "A", "- one", None), ("p", 5, "append", "A", "- new", None)],
        "page string, seq int, action string, section string, content string, old_content string",
    )
    after = {r.page: r.lines for r in pages.applied(page, log).collect()}
    assert after["p"] == ["# T", "## A", "- new", "", "## B", "- 2", "", "## C", "- c"] and after["q"] == ["x"]
    back = {r.page: r.lines for r in pages.undone(pages.applied(page, log.where("seq < 5")), log.where("seq < 5")).collect()}
    assert back["p"] == ["# T", "## A", "- one", "", "## B", "- two", "", "## C"]
    fresh = lambda x: page.select(pages.freshened(F.array(*map(F.lit, x)), F.lit("2024-01-01")).alias("l")).first().l
    assert fresh(["---", "updated: x", "---", "updated: y"]) == ["---", "updated: 2024-01-01", "---", "updated: y"]
    assert fresh(["---", "a: b", "---"]) == ["---", "a: b", "updated: 2024-01-01", "---"] and fresh(["a"]) == ["a"]


DECISION = {"action": "new", "mode": "append", "vault": "v", "page": "p", "section": "S", "target_vault": "v", "target_page": "p", "target_section": "S", "confidence": "high", "candidate_confidence": "high", "needs_review": False, "rationale": "r", "content": "c", "old_content": None, "lines": ["old", "- b", "| t |", "# h", "twice", "twice"]}
REPLACED = DECISION | {"action": "supersede", "mode": "replace", "needs_review": True, "old_content": "old"}
DECISION_SCHEMA = ", ".join(f"{k} {'boolean' if k == 'needs_review' else 'array<string>' if k == 'lines' else 'string'}" for k in DECISION)


@pytest.mark.parametrize(
    "row,reason",
    [
        (DECISION, None), (REPLACED, None), (REPLACED | {"action": "contradict"}, None), (DECISION | {"action": "duplicate", "mode": "none", "content": ""}, None), (REPLACED | {"old_content": "- b", "content": "- c"}, None),
        (REPLACED | {"old_content": "| t |", "content": "| u | "}, None), (DECISION | {"confidence": "low", "candidate_confidence": "low", "needs_review": True}, None),
        (DECISION | {"action": "split"}, "invalid action"), (DECISION | {"action": None}, "invalid action"), (DECISION | {"mode": "replace"}, "mode does not fit the action"), (DECISION | {"page": "q"}, "other target than the batch"),
        (DECISION | {"section": None}, "other section than routed"), (DECISION | {"confidence": "sure"}, "invalid confidence"), (DECISION | {"candidate_confidence": "low"}, "confidence is not the candidate's"),
        (REPLACED | {"needs_review": False}, "needs_review does not follow"), (DECISION | {"needs_review": None}, "needs_review does not follow"), (DECISION | {"needs_review": True}, "needs_review does not follow"), (DECISION | {"rationale": " "}, "no rationale"),
        (REPLACED | {"old_content": None}, "nothing to replace is named"), (DECISION | {"old_content": "old"}, "old_content without a replacement"), (DECISION | {"content": " "}, "content does not fit the action"),
        (DECISION | {"action": "duplicate", "mode": "none"}, "content does not fit the action"), (DECISION | {"content": "a\nb"}, "content of several lines"), (DECISION | {"content": "- c"}, "new content has a bullet"),
        (REPLACED | {"old_content": "old\rx"}, "old_content of several lines"), (REPLACED | {"old_content": "twice"}, "old_content is not one line of the page"), (REPLACED | {"old_content": "gone"}, "old_content is not one line of the page"),
        (REPLACED | {"old_content": "# h"}, "a heading may not be replaced"), (REPLACED | {"old_content": "- b"}, "the bullet is lost"), (REPLACED | {"old_content": "| t |", "content": "| u"}, "the table row is lost"),
    ],
)
def test_decisions(spark, row, reason):
    df = spark.createDataFrame([tuple(row.values())], DECISION_SCHEMA)
    assert contracts.judged(df, contracts.decision_checks()).first().reason == reason


def test_canonical_decisions_keep_the_contract(spark):
    """What is derived for each action passes the rules."""
    given = [(k, a, old, "- new" if old == "- b" else "new") for k, (a, old) in enumerate([("new", None), ("duplicate", None), ("supersede", "old"), ("contradict", "old"), ("contradict", "- b"), ("supersede", "- b")])]
    decisions = spark.createDataFrame(given, "k int, action string, old_content string, content string")
    facts = spark.createDataFrame([(k, "fact", ("high", "medium")[k % 2]) for k in range(6)], "k int, candidate_content string, confidence string")
    sections = spark.createDataFrame([(k, "S") for k in range(6)], "k int, section string")
    out = reconcile.canonical_decisions(decisions, facts, sections, "k").join(facts.select("k", F.col("confidence").alias("candidate_confidence")), "k")
    rest = {"vault": "v", "page": "p", "target_vault": "v", "target_page": "p", "target_section": "S", "rationale": "r"}
    out = out.withColumns({n: F.lit(v) for n, v in rest.items()}).withColumn("lines", F.array(F.lit("old"), F.lit("- b")))
    assert [r.reason for r in contracts.judged(out, contracts.decision_checks()).collect()] == [None] * 6


def test_new_persons(spark):
    facts = ["Implementing Google Calendar now", "Met Sarah Chen", '"Sam Roe" asked', "Ana Lee's tea", "- Ana Lee asked", "Ana Lee", "Blue Sky works", "Ben Blue came", "Ana Roe came", "Jo  Poe Moe Foe", "Müller Hans", "x Sam Roe", "", None, "Sam Roeé x"]
    df = spark.createDataFrame(list(enumerate(facts)), "k int, t string")
    index = spark.createDataFrame([("ana lee", "v", "p.md", "S"), ("ana lee", "a", "z.md", "T")], "name string, vault string, page string, section string")
    terms = spark.createDataFrame([("blue",), ("ben blue",)], "term string")
    got = {r.k: (r.status, r.detected, r.vault) for r in routing.partitioned(df, "k", "t", index, terms, ("Ana",), "v").collect()}
    assert {k: v[1] for k, v in got.items() if v[0] == "new_person"} == {2: "Sam Roe", 9: "Jo  Poe Moe"}
    assert {k: v[2] for k, v in got.items() if v[0] == "pre_routed"} == {4: "v", 5: "v"} and len(got) == len(facts)


def test_policies(spark):
    rows = [(1, "Tool-Choice", "PR 12: tests passed on branch fix/x", "current"), (2, None, None, "current"), (3, "git state", "", "stable"), (4, "odd", "a test of ideas that passed by", "stable"), (5, "skill", "learning", None)]
    got = {r.k: (r.fact_class, r.policy_reasons, r.policy_review_only) for r in gates.with_policy(spark.createDataFrame(rows, "k int, kind string, content string, tier string"), "kind", "content", "tier").collect()}
    assert got[1] == ("preference", ["pull_request_state", "branch_state", "test_receipt"], True) and got[2] == ("active_state", [], False)
    assert got[3] == ("audit_telemetry", ["audit_telemetry"], True) and got[4][0] == "other" and got[5] == ("identity", [], False)
    one = lambda kind, tier: spark.range(1).select(reconcile.fallback_class(F.lit(kind), F.lit(tier)).alias("c")).first().c
    assert (one("Project Blocker", None), one("liked", None), one(None, "current"), one("Debug-State", "current")) == ("active_state", "other", "active_state", "audit_telemetry")


def test_gates(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    lit = F.lit
    assert one(gates.path_allowed(lit("a/b/c.md"), ["a/b"], ["a/b/d"])) and not one(gates.path_allowed(lit("a/bc.md"), ["a/b"], []))
    assert one(gates.exclusion_reason(lit("x/_Archive/p.md"), lit(""))) == "directory: archive"
    assert one(gates.exclusion_reason(lit("x/old draft.md"), lit(""))) == "page type: draft" and one(gates.exclusion_reason(lit("x/p.md"), lit(" Completed "))) == "status: completed"
    assert one(gates.exclusion_reason(lit("x/p.md"), lit("active"))) is None
    assert one(gates.safe_path(lit("a/b"))) and not one(gates.safe_path(lit("a/../b"))) and not one(gates.safe_path(lit("/a")))
    assert one(gates.person_span(lit("Ada Lovelace wrote"), ["Monday"])) == "Ada Lovelace" and one(gates.person_span(lit("Monday Morning came"), ["Monday"])) is None
    with pytest.raises(Exception, match="unknown tier"):
        one(gates.tier(lit("odd")))


def test_roster(spark):
    facts = spark.createDataFrame([(1, "Ann Lee moved"), (2, "Ann's cat"), (3, "Ann moved"), (4, "Bob"), (5, "")], "k int, t string")
    names = spark.createDataFrame([("ann", "v2"), ("Ann", "v1"), ("Ann Lee", "v3")], "name string, vault string")
    assert {r.k: r.vault for r in gates.roster_match(facts, "k", "t", names).collect()} == {1: "v3", 3: "v1"}


def test_unique(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    assert review.asserted_unique(df, ["k"]).count() == 2
    with pytest.raises(Exception, match="repeated key"):
        review.asserted_unique(df.union(df), ["k"]).collect()


def test_readers(spark, tmp_path):
    (tmp_path / "speech").mkdir()
    (tmp_path / "speech" / "a.txt").write_text("hello")
    (tmp_path / "b.chat.txt").write_text("there")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "README.txt").write_text("no")
    (tmp_path / "c.md").write_text(PAGE)
    lines = ['{"transcript_id": "t1", "asr_text": "um a", "edited_text": "a"}', "not json", "[1]", '{"body": "b", "kind": "notes", "timestamp": "2024"}', '{"text": " "}', '{"id": 7, "message": "m"}']
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    (tmp_path / "e.csv").write_text('kind,text\nnotes,"two\nlines"\nodd,x\n,\n')
    path = f"file://{tmp_path}"
    assert sorted((r.kind, r.text) for r in readers.text_files(spark, path).collect()) == [("chat", "there"), ("speech", "hello")]
    assert [r.kind for r in readers.markdown_files(spark, path).collect()] == ["chat"]
    rows = readers.json_lines(spark, path).collect()
    assert sorted((r.row_id.split("/")[-1], r.kind, r.text) for r in rows) == [("7", "unknown", "m"), ("d.jsonl:4", "notes", "b"), ("t1", "speech", "um a"), ("t1", "writing", "a")]
    assert sorted((r.kind, r.text) for r in readers.csv_files(spark, path).collect()) == [("notes", "two\nlines"), ("unknown", "x")]


def test_transcripts(spark, tmp_path):
    events = [
        {"role": "user", "content": "hi <system-reminder>x</system-reminder>"},
        {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": " a "}, {"type": "thinking", "text": "t"}, {"type": "text", "text": "b"}]}},
        "broken",
        {"payload": {"type": "user_message", "message": "pause this chat"}},
        {"type": "user", "isMeta": True, "message": {"role": "user", "content": "meta"}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "content": "r"}]}},
        {"role": "system", "content": "s"},
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events))
    (tmp_path / "empty.jsonl").write_text("")
    found = readers.transcript_events(spark, f"file://{tmp_path}")
    assert [(r.event_no, r.role, r.text, r.toggle) for r in found.orderBy("event_no").collect()] == [(1, "user", "hi", None), (2, "assistant", "a\nb", None), (4, "user", "pause this chat", "off")]
    assert readers.recorded(found).count() == 0


def test_review_blocks(spark):
    text = "intro\n### One\n**Source Chat:** c1\n> quoted\n> more\n### Two\n**Source Chat:** c2\n"
    rows = readers.marked_blocks(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", ["Source Chat"]).orderBy("block_no").collect()
    assert [(r.heading, r.source_chat, r.quote) for r in rows] == [("One", "c1", "quoted\nmore"), ("Two", "c2", "")]


def test_stream_takes_what_is_new(spark, tmp_path):
    src, out, check = (f"file://{tmp_path}/{n}" for n in ("in", "out", "check"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    each = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    df.write.mode("append").parquet(src)
    incremental.available(spark, src, df.schema, each, check)
    df.selectExpr("k + 10 AS k", "v").write.mode("append").parquet(src)
    incremental.available(spark, src, df.schema, each, check)
    incremental.available(spark, src, df.schema, each, check)
    assert sorted((r.k, r.batch) for r in spark.read.parquet(out).collect()) == [(1, 0), (2, 0), (11, 1), (12, 1)]


def test_cursors(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    rows = spark.createDataFrame([("1704067200",), ("2024-01-05T00:00:00",), ("odd",), (None,)], "m string")
    assert [str(r.t) for r in rows.select(incremental.cursor_time(F.col("m"), now).alias("t")).collect()] == ["2024-01-01 00:00:00", "2024-01-05 00:00:00", "2024-01-25 00:00:00", "2024-01-25 00:00:00"]
