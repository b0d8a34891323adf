"""Listings, exclusions and cursors over files with times of their own; batches gated by their stages."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from loamworks.sources import discovery, readers
from loamworks.streaming import incremental

NOW = datetime.datetime(2026, 3, 20, 12, tzinfo=datetime.UTC)
ID = "0a1b2c3d-0000-4000-8000-00000000000"


def days_ago(n):
    return NOW - datetime.timedelta(days=n)


@pytest.fixture
def home(tmp_path):
    def put(name, age, lines=None):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(lines or [json.dumps({"type": "user", "message": {"role": "user", "content": f"from {name}"}})]) + "\n")
        os.utime(path, (days_ago(age).timestamp(),) * 2)

    mark = json.dumps({"type": "session_meta", "payload": {"thread_source": "subagent"}})
    put(f"one/p/{ID}1.jsonl", 1)
    put(f"one/p/{ID}2.jsonl", 9)
    put("one/p/subagents/x.jsonl", 1)
    put("one/p/subagents/w/y.jsonl", 1)
    put("one/p/note.txt", 1)
    put(f"two/2026/03/{ID}3.jsonl", 2)
    put("two/2026/03/robot.jsonl", 2, [mark, "{}"])
    put("two/2026/03/late-mark.jsonl", 2, ["{}"] * 19 + [mark])
    put("two/2026/03/too-late.jsonl", 2, ["{}"] * 20 + [mark])
    put("two/old.jsonl", 30)
    put("two/future.jsonl", -1)
    return tmp_path, {"one": f"file://{tmp_path}/one", "two": f"file://{tmp_path}/two", "three": f"file://{tmp_path}/three"}


def names(df):
    return sorted(r.path.rsplit("/", 1)[-1] for r in df.collect())


def test_listing_leaves_out_and_opens_nothing(spark, home):
    _, roots = home
    files = discovery.listing(spark, roots)
    assert names(files) == sorted([f"{ID}1.jsonl", f"{ID}2.jsonl", f"{ID}3.jsonl", "robot.jsonl", "late-mark.jsonl", "too-late.jsonl", "old.jsonl", "future.jsonl"])
    assert {r.source for r in files.collect()} == {"one", "two"}
    assert "content#" not in files._jdf.queryExecution().executedPlan().toString()


def test_each_source_from_its_marker(spark, home):
    _, roots = home
    markers = {"one": f"{days_ago(10):%Y-%m-%d}", "two": str(int(days_ago(3).timestamp()))}
    found = discovery.discovered(spark, roots, markers, NOW, headed=("two",))
    assert names(found) == [f"{ID}1.jsonl", f"{ID}2.jsonl", f"{ID}3.jsonl", "too-late.jsonl"]
    batch = {r.path[-7:-6]: r.batch_no for r in found.collect()}
    assert batch["2"] == 0 and batch["1"] == batch["3"] == 1
    assert names(discovery.discovered(spark, roots, {"one": "soon"}, NOW, headed=("two",))) == [f"{ID}1.jsonl", f"{ID}3.jsonl", "too-late.jsonl"]


def test_since_and_all(spark, home):
    _, roots = home
    assert names(discovery.discovered(spark, {"two": roots["two"]}, {}, NOW, since="all")) == [f"{ID}3.jsonl", "late-mark.jsonl", "old.jsonl", "robot.jsonl", "too-late.jsonl"]
    first = discovery.discovered(spark, {"two": roots["two"]}, {}, NOW, since="all").orderBy("modified").first()
    assert first.batch_no == 0 and first.window_start == first.modified
    assert names(discovery.discovered(spark, roots, {}, NOW, since=days_ago(1.5))) == [f"{ID}1.jsonl"]
    assert discovery.discovered(spark, {"three": roots["three"]}, {}, NOW, since="all").count() == 0


def test_markers():
    at = lambda text: discovery.window_start({"s": text}, "s", NOW)
    assert at(" 2026-03-01\n") == datetime.datetime(2026, 3, 1, tzinfo=datetime.UTC)
    assert at("1700000000").timestamp() == 1_700_000_000
    assert at("yesterday") == at(None) == at("") == at("2026-99-01") == at("9" * 40) == days_ago(7)


def test_files_before_the_cursor_are_not_opened(spark, home):
    _, roots = home
    events = readers.transcript_events(spark, roots["one"], since=days_ago(5))
    got = events.collect()
    assert [r.text for r in got] == [f"from one/p/{ID}1.jsonl"]
    metrics = {}

    def walk(plan):
        values = plan.metrics()
        if values.contains("numFiles"):
            metrics["files"] = values.apply("numFiles").value()
        if plan.nodeName() == "AdaptiveSparkPlan":
            walk(plan.executedPlan())
        children = plan.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(events._jdf.queryExecution().executedPlan())
    assert metrics["files"] == 1  # of the four below the root: neither the older one nor those in `subagents`


def test_discovered_files_are_read(spark, home):
    _, roots = home
    found = discovery.discovered(spark, roots, {"one": "2026-03-01"}, NOW, headed=("two",))
    events = readers.transcript_events(spark, [r.path for r in found.where("source = 'one'").collect()])
    assert sorted(r.text[-7] for r in events.collect()) == ["1", "2"]


def test_sessions_of_several_roots(spark, home):
    tmp, roots = home
    again = tmp / "other" / "deep" / f"{ID}1.jsonl"
    again.parent.mkdir(parents=True)
    again.write_text("{}\n")
    os.utime(again, (days_ago(0).timestamp(),) * 2)
    (tmp / "other/a/b/c/d/e/f/g").mkdir(parents=True)
    (tmp / f"other/a/b/c/d/e/f/g/{ID}9.jsonl").write_text("{}\n")
    rows = discovery.session_files(spark, [roots["one"], roots["two"], f"file://{tmp}/other", f"file://{tmp}/gone", roots["one"]]).collect()
    assert {r.id[-1]: r.path.split("/")[-3] for r in rows} == {"1": "other", "2": "one", "3": "2026"}


def test_cursor_moves_when_all_stages_are_done(spark, tmp_path):
    source, base, checkpoint = f"{tmp_path}/in", f"file://{tmp_path}/state", f"{tmp_path}/ck"
    schema = "k long, at timestamp"
    rows = lambda ks: spark.createDataFrame([(k, datetime.datetime(2026, 1, 1 + k)) for k in ks], schema)
    written, fails = [], {"on": True}

    def first(batch, number):
        written.append(("first", number, sorted(r.k for r in batch.collect())))

    def second(batch, number):
        if fails["on"]:
            raise RuntimeError("stage is down")
        written.append(("second", number, sorted(r.k for r in batch.collect())))

    def run():
        incremental.staged(spark, source, spark.createDataFrame([], schema).schema, [("first", first), ("second", second)], base, checkpoint, "at")

    rows([1, 2]).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="stage is down"):
        run()
    assert incremental.cursor_of(spark, base) is None and [w[0] for w in written] == ["first"]
    with pytest.raises(Exception, match="stage is down"):
        run()
    assert [w[0] for w in written] == ["first"]
    fails["on"] = False
    run()
    assert written == [("first", 0, [1, 2]), ("second", 0, [1, 2])]
    moved = incremental.cursor_of(spark, base)
    rows([0]).coalesce(1).write.mode("append").parquet(source)
    run()
    assert written[2:] == [("first", 1, [0]), ("second", 1, [0])] and incremental.cursor_of(spark, base) == moved
    run()
    assert len(written) == 4


def test_counts_of_files_by_source(spark, home):
    """What a run's discovery leaves out, as the share of all transcripts."""
    tmp, roots = home
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load([roots["one"], roots["two"]])
    assert every.count() - discovery.listing(spark, roots).agg(F.count("*")).first()[0] == 2
