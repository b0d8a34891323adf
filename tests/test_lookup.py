import pytest
from pyspark.sql import functions as F

from loamworks.operators import lookup
from loamworks.sources import writers


def test_session_ids(spark):
    known = spark.createDataFrame([("abcd1", "x", 0), ("abcd1", "y", 1), ("abcd12", "y", 1), ("efgh9", "y", 1), ("zzzz1", "x", 0), ("zzzz2", "x", 0)], "id string, source string, rank int")
    asked = spark.createDataFrame([("abcd1",), ("efgh",), ("zzzz",), ("none1",)], "q string")
    got = {r.q: (r.id, r.source, r.problem) for r in lookup.resolved(asked, "q", known).collect()}
    assert got == {"abcd1": ("abcd1", "x", None), "efgh": ("efgh9", "y", None), "zzzz": (None, None, "ambiguous"), "none1": (None, None, "unknown")}


def test_note_paths(spark):
    df = spark.createDataFrame([("n", "A b", 2), ("n", "a-B!", 1), ("m", "A b", 3), ("n", None, 4)], "f string, t string, k int")
    got = {r.k: r.path for r in lookup.note_paths(df, "t", "f", ["k"]).collect()}
    assert got == {1: "n/a-b.md", 2: "n/a-b-1.md", 3: "m/a-b.md", 4: got[4]}


def test_orders_and_templates(spark):
    v = [("r1", "soft", 1), ("r2", "hard", 5), ("r3", "soft", 9), ("r4", "soft", 9)]
    df = spark.createDataFrame([([dict(zip(("rule", "severity", "penalty"), x)) for x in v],)], "v array<struct<rule:string,severity:string,penalty:int>>")
    assert [r.rule for r in df.select(lookup.ordered_violations(F.col("v")).alias("o")).first().o] == ["r2", "r3", "r4", "r1"]
    one = spark.range(1)
    assert one.select(lookup.filled("a {{X}} {{Y}}", X=F.lit(1), Y=F.lit(None)).alias("t")).first().t == "a 1 "
    with pytest.raises(Exception, match="unfilled: ..Z"):
        one.select(lookup.filled("{{Z}}")).collect()


def test_repair(spark):
    t = lambda *ids: spark.createDataFrame([(i,) for i in ids], "k int")
    assert [sorted(r.k for r in x.collect()) for x in lookup.repaired(t(1, 2, 3), t(2, 3, 4), t(1, 3), "k")] == [[2, 3], [2, 3], [3]]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k int, v string")
    assert writers.markdown_table(df, "T", ["k"]).first().text == "# T\n\n| k | v |\n|---|---|\n| 1 |  |\n| 2 | b |"
    writers.json_document(df, f"file://{tmp_path}/j")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/j").collect()) == ['{"k":1}', '{"k":2,"v":"b"}']
    writers.unit_files(df.na.fill("x"), "k", "v", f"file://{tmp_path}/u")
    assert spark.read.text(f"file://{tmp_path}/u").count() == 2
    path = f"file://{tmp_path}/t"
    writers.swapped(spark, df, path)
    writers.swapped(spark, spark.read.parquet(path).where("k = 1"), path)
    assert spark.read.parquet(path).count() == 1
