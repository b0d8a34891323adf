"""Archives of applied batches, their index, and the states of stages."""

import json

from loamworks.operators import archive, runs
from loamworks.sources import readers


def test_archive_of_batches(spark, tmp_path):
    def put(folder, **documents):
        (tmp_path / folder).mkdir()
        for name, content in documents.items():
            (tmp_path / folder / f"{name.replace('_', '-')}.json").write_text(content if isinstance(content, str) else json.dumps(content))

    entry = lambda i, **k: {"id": i, "vault": "v", "target_file": "p.md", "signal": "stale", **k}
    put("one", cleanup_queue={"batch_id": "2026-01-02-a", "generated_at": "g", "entries": [entry("1", diff={"verb": "REMOVE"}), entry("2", proposed_action="move"), entry("3"), entry("5")]},
        decisions={"1": "approve", "2": "reject", "3": "maybe", "4": "approve", "5": "approve"}, apply_summary={"applied_ids": ["1", "2", "1"], "manual": [{"id": "3"}], "noop": [], "failures": None})
    put("two", cleanup_queue={"entries": [entry("1", signal=None)]}, decisions="not json", apply_summary={"applied_ids": []})
    entries, decisions, results = archive.read_archive(spark, f"file://{tmp_path}")
    assert {(r.batch, r.id, r.signal, r.verb) for r in entries.collect()} == {("2026-01-02-a", "1", "stale", "REMOVE"), ("2026-01-02-a", "2", "stale", "move"), ("2026-01-02-a", "3", "stale", "change"), ("2026-01-02-a", "5", "stale", "change"), ("two", "1", "unknown", "change")}
    got = {(r.batch[-1], r.id): (r.decision, r.outcome, r.fault) for r in archive.outcomes_of(entries, decisions, results).collect()}
    assert got == {
        ("a", "1"): ("approve", "applied", "carried out twice"), ("a", "2"): ("reject", "applied", "applied without approval"), ("a", "3"): ("maybe", "manual", "unknown decision"),
        ("a", "4"): ("approve", "none", "not queued"), ("a", "5"): ("approve", "none", "approved without outcome"), ("o", "1"): ("undecided", "none", None),
    }
    counts = {r.batch: r for r in archive.batch_counts(archive.outcomes_of(entries, decisions, results)).collect()}
    assert (counts["2026-01-02-a"].reviewed, counts["2026-01-02-a"].approve, counts["2026-01-02-a"].applied, counts["2026-01-02-a"].faults) == (5, 3, 2, 5) and counts["two"].undecided == 1


def test_index_has_one_line_a_batch(spark):
    rows = lambda *given: spark.createDataFrame(list(given), "batch string, day string, line string")
    index = archive.indexed(rows(("a", "2026-01-02", "first")).limit(0), rows(("a", "2026-01-02", "first"), ("b", "2026-01-02", "other")))
    again = archive.indexed(index, rows(("a", "2026-01-02", "second"), ("c", None, "x")))
    assert {(r.batch, r.line) for r in again.collect()} == {("a", "second"), ("b", "other"), ("c", "x")}
    assert {(r.batch, r.line) for r in archive.indexed(again, rows(("a", "2026-01-02", "second"))).collect()} == {("a", "second"), ("b", "other"), ("c", "x")}


def test_inbox_blocks(spark):
    text = "# Inbox\nlead\n## 2026-01-02 03:04\none\n### more\ntwo\n\n## Other\nthree\n## 2026-13-02 03:04\nnever\n## 2026-01-03 00:00  \n\n## 2026-01-03 00:00 late\nx"
    rows = readers.inbox_blocks(spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "k string, t string"), "k", "t").collect()
    assert [(r.k, str(r["at"]), r.body) for r in rows] == [("a", "2026-01-02 03:04:00", "one\n### more\ntwo\n\n## Other\nthree"), ("a", "2026-01-03 00:00:00", "## 2026-01-03 00:00 late\nx")]


def test_states_of_a_stage(spark):
    rows = [(1, "s", 1, "running"), (1, "s", 2, "running"), (1, "s", 3, "failed"), (1, "s", 4, "done"), (1, "s", 5, "running"), (1, "s", 6, "done"), (1, "s", 7, "failed"), (1, "t", 1, "done"), (1, "t", 2, "skipped"), (2, "s", 1, None), (2, "s", 2, "odd")]
    got = {(r.run, r.stage): r for r in runs.stage_history(spark.createDataFrame(rows, "run int, stage string, seq int, status string").repartition(5), "run", "stage", "seq").collect()}
    s = got[1, "s"]
    assert (s.status, s.accepted, [tuple(x) for x in s.rejected]) == ("done", 4, [(2, "running", "repeated"), (4, "done", "after failed"), (7, "failed", "after done")])
    assert (got[1, "t"].status, [x.reason for x in got[1, "t"].rejected]) == ("skipped", ["after pending"])
    assert (got[2, "s"].status, got[2, "s"].accepted, [x.reason for x in got[2, "s"].rejected]) == ("pending", 0, ["unknown status"] * 2)
