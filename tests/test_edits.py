"""Generations of tables, cleanup manifests as transactions, undo logs, backups."""

import pytest
from pyspark.sql import functions as F

from loamworks.operators import pages, reconcile
from loamworks.sources import generations

PAGES = [("a.md", ["# A", "## S", "- one", "- two", "", "## T", "- three"]), ("b.md", ["## In", "- old"]), ("c.md", [])]
MANIFEST = "index bigint, action string, confidence string, page string, section string, content string, new_content string, target_page string, target_section string, depends_on array<bigint>"
GOOD = [
    (1, "remove", "high", "a.md", "S", "one", None, None, None, []),
    (2, "move", "high", "a.md", "T", "three", None, "b.md", "In", [1]),
    (3, "rewrite", "high", "a.md", "S", "two", "2", None, None, [1, 2]),
]


@pytest.fixture
def base(spark, tmp_path):
    at = f"file://{tmp_path}/pages"
    assert generations.commit(spark, spark.createDataFrame(PAGES, "page string, lines array<string>"), at, None) == 1
    return at


def rows(spark, at, generation=None):
    return {r.page: r.lines for r in generations.read(spark, at, generation).collect()}


def manifest(spark, given):
    return spark.createDataFrame(given, MANIFEST)


def test_manifest_is_applied_whole(spark, base):
    assert reconcile.apply_cleanup(spark, base, manifest(spark, GOOD), "r1") == 2
    assert rows(spark, base) == {"a.md": ["# A", "## S", "- 2", "", "## T"], "b.md": ["## In", "- old", "- three"], "c.md": []}
    assert rows(spark, base, 1) == dict(PAGES)
    assert generations.entry(spark, base)["actions"] == {"remove": 1, "move": 1, "rewrite": 1}
    assert generations.roll_back(spark, base, 1) == 3 and rows(spark, base) == dict(PAGES)


@pytest.mark.parametrize(
    "at,change,reason",
    [
        (0, {2: "low"}, "not of high confidence"), (0, {5: "gone"}, "not there exactly once"), (0, {3: "x.md"}, "no such page"), (0, {3: "../a.md"}, "unsafe page"), (0, {5: "a\nb"}, "no page, section or single line"), (0, {1: "burn"}, "unknown action"),
        (1, {7: "zz.md"}, "no such target"), (1, {8: " "}, "no such target"), (1, {5: "two"}, "in the manifest twice"), (2, {6: None}, "no single line to write"), (2, {6: "one"}, "there already"), (2, {0: 2}, "index is not unique"), (1, {9: [3]}, "comes before"), (2, {9: [7]}, "comes before"),
    ],
)
def test_one_fault_rejects_the_manifest(spark, base, at, change, reason):
    given = [list(r) for r in GOOD]
    for k, v in change.items():
        given[at][k] = v
    with pytest.raises(ValueError, match=reason):
        reconcile.apply_cleanup(spark, base, manifest(spark, given), "r1")
    assert generations.latest(spark, base) == 1 and rows(spark, base) == dict(PAGES)


def test_edits_that_no_longer_fit_in_turn(spark, base):
    """Each row alone is right; one after the other they aren't."""
    twice = [(1, "rewrite", "high", "a.md", "S", "one", "same", None, None, []), (2, "rewrite", "high", "a.md", "S", "two", "same", None, None, [])]
    with pytest.raises(ValueError, match="line is there already"):
        reconcile.apply_cleanup(spark, base, manifest(spark, twice), "r1")
    assert rows(spark, base) == dict(PAGES)


def test_failure_half_way_leaves_the_old_generation(spark, base):
    fails = generations.read(spark, base).withColumn("lines", F.when(F.col("page") == "b.md", F.raise_error("torn").cast("array<string>")).otherwise(F.col("lines")))
    with pytest.raises(Exception, match="torn"):
        generations.commit(spark, fails, base, 1)
    assert generations.latest(spark, base) == 1 and rows(spark, base) == dict(PAGES)
    fs = spark._jvm.org.apache.hadoop.fs.Path(base)
    names = [s.getPath().getName() for s in fs.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(fs)]
    assert len([n for n in names if n.startswith("rows-")]) == 1


def test_of_two_writers_one_fails(spark, base):
    table = generations.read(spark, base)
    assert generations.commit(spark, table.where("page = 'a.md'"), base, 1) == 2
    with pytest.raises(FileExistsError):
        generations.commit(spark, table.where("page = 'b.md'"), base, 1)
    assert set(rows(spark, base)) == {"a.md"}


def edits(spark, given):
    return spark.createDataFrame(given, "page string, " + pages.EDIT)


def test_undo_returns_lines_to_their_places(spark):
    start = spark.createDataFrame(PAGES, "page string, lines array<string>")
    log = edits(spark, [
        ("a.md", 1, "remove", "S", "- one", None, "## S", "- two"), ("a.md", 2, "replace", "S", "- 2", "- two", None, None), ("a.md", 3, "append", "T", "- four", None, None, None),
        ("a.md", 4, "remove", "T", "- three", None, "gone", ""), ("b.md", 5, "append", "In", "- new", None, None, None), ("b.md", 6, "remove", "In", "- old", None, "", None),
    ])
    after = pages.whole(start, pages.edited_strictly(start, log))
    assert {r.page: r.lines for r in after.collect()} == {"a.md": ["# A", "## S", "- 2", "", "## T", "- four"], "b.md": ["## In", "- new"], "c.md": []}
    # Of the lines without a neighbour left, the heading is the place to return to.
    assert {r.page: r.lines for r in pages.replayed_back(after, log).collect()} == {"a.md": PAGES[0][1][:6] + ["- three"], "b.md": ["## In", "- old"], "c.md": []}


@pytest.mark.parametrize(
    "event,fault",
    [
        (("b.md", 2, "append", "In", "- not there", None, None, None), "line is gone"), (("b.md", 2, "append", "In", "- twice", None, None, None), "line stands more than once"), (("b.md", 2, "remove", "In", "- old", None, None, None), "line is there already"),
        (("b.md", 2, "remove", "No", "- x", None, "gone", "gone"), "no place to return to"), (("b.md", 2, "remove", "In", "- x", None, None, "- twice"), "no place to return to"), (("b.md", 2, "replace", "In", "- new", "- old", None, None), "line is gone"),
        (("b.md", 2, "replace", "In", "- old", "- twice", None, None), "line is there already"), (("b.md", 2, "burn", "In", "- x", None, None, None), "unknown action"), (("b.md", 2, None, "In", "- x", None, None, None), "unknown action"),
        (("b.md", 2, "append", "In", None, None, None, None), "incomplete edit"), (("b.md", 2, "replace", "In", "- old", None, None, None), "incomplete edit"), (("z.md", 2, "append", "In", "- x", None, None, None), "no such page"),
    ],
)
def test_one_faulty_event_leaves_all_pages(spark, event, fault):
    now = spark.createDataFrame([("a.md", ["## S", "- one"]), ("b.md", ["## In", "- old", "- twice", "- twice"])], "page string, lines array<string>")
    log = edits(spark, [("a.md", 1, "append", "S", "- one", None, None, None), event])
    found = pages.edited_strictly(now, pages.reversed_edits(log)).where("fault IS NOT NULL").collect()
    assert [(r.page, r.fault, r.seq) for r in found] == [(event[0], fault, -2)]
    assert sorted(map(tuple, pages.replayed_back(now, log).collect())) == sorted(map(tuple, now.collect()))
    assert [r.lines for r in pages.replayed_back(now, log.where("seq = 1")).where("page = 'a.md'").collect()] == [["## S"]]


def test_backups(spark, tmp_path):
    base, df = f"file://{tmp_path}/kept", spark.createDataFrame([(1, "x"), (2, None), (2, None)], "k int, t string")
    name = generations.back_up(spark, df, base, "r1")
    assert generations.back_up(spark, df.repartition(3), base, "r2") == name != generations.digest(df.distinct())
    with pytest.raises(FileExistsError):
        generations.back_up(spark, df, base, "r1")
    assert sorted(map(str, generations.restored(spark, base, "r1").collect())) == sorted(map(str, df.collect()))
    generations.retire(spark, base, "r1")
    with pytest.raises(FileExistsError):
        generations.retire(spark, base, "r1")
    with pytest.raises(FileNotFoundError):
        generations.restored(spark, base, "r1")
    assert generations.restored(spark, base, "r2").count() == 3
    with pytest.raises(Exception):
        generations.retire(spark, base, "never")
