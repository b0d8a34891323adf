"""Exact dedup: a tree-merge of sorted digest runs, in DataFrame operations only.

Rows are dealt into runs. A run is sorted by digest and holds, for each one, the row of the smallest id and a count, so
copies in one run collapse before anything is exchanged. In each binomial round `fan` neighbouring runs are merged: the
tasks that hold them exchange parts, so that each gets one range of digests of all of them, merges these sorted parts and
retains the smallest identifier and the summed count. Runs get fewer and their parts more, so tasks stay as many and as
large as before; after the last round there is one sorted run, over all tasks. A group of copies, however large, is at no
level more than one row of each run that is merged. A digest counts as equal only if SHA-256, the length and an
independent 64-bit hash of the normalised text all agree; for two different texts among 2^40 to agree has a probability
below 2^-176 by SHA-256 alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, keyed_text, stored

#: The fewest runs; with more shuffle partitions there are as many runs as the next power of two.
LEAST_RUNS = 64
FAN = 8
KEY = ["digest", "length", "check"]


def runs_for(partitions: int) -> int:
    return max(LEAST_RUNS, 1 << (partitions - 1).bit_length())


def normalised(text: Column) -> Column:
    """Each run of white space as one space. Most runs are one space already: only others are replaced."""
    return F.regexp_replace(text, r"[\x09-\x0D]" + SPACE + r"*|\x20" + SPACE + "+", " ")


def digests(df: DataFrame, id_col: str, text_col: str, runs: int) -> DataFrame:
    """doc_id, row (a number of its own), run and the digest columns of each row's normalised text (null: empty).

    The run depends on the input's partition too, so rows that repeat an id are spread.
    """
    rows = keyed_text(df, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("text"))
    rows = rows.select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.length("text").alias("length"), F.xxhash64("text").alias("check"))
    run = F.pmod(F.xxhash64("doc_id", "check", F.spark_partition_id()), F.lit(runs)).cast("int")
    return rows.select("doc_id", F.monotonically_increasing_id().alias("row"), run.alias("run"), *KEY)


def merged(rows: DataFrame, runs: int, fan: int = FAN) -> DataFrame:
    """The one sorted run that is left: digest, least (id and row of the smallest id) and the number of rows."""
    tasks, parts = runs, 1
    # Null ids come after all others.
    level = rows.select("run", *KEY, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row").alias("least"), F.lit(1).cast("long").alias("rows"))
    while True:
        part = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int") * F.lit(parts), 16)
        dealt = level.withColumn("part", part).repartition(tasks, "run", "part").sortWithinPartitions("run", "part", *KEY)
        level = dealt.groupBy("run", "part", *KEY).agg(F.min("least").alias("least"), F.sum("rows").alias("rows"))
        if runs == 1:
            return level.drop("run", "part")
        level = level.withColumn("run", (F.col("run") / fan).cast("int"))
        runs, parts = -(-runs // fan), min(parts * fan, tasks)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = FAN) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each input row.

    Texts are equal if identical once each run of white space is one space; null counts as empty. keep_id is the
    smallest id of the group (nulls count only if there is nothing else). One row of a group is kept: of several with that
    id any one, as in drop_copies().
    """
    runs = runs_for(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Texts are read and digested once; what follows reads some 70 bytes a row.
    rows = stored(digests(df, id_col, text_col, runs))
    last = merged(rows, runs, fan).select(*KEY, F.col("least.id").alias("keep_id"), F.col("least.row").alias("keep_row"), F.col("rows").alias("group_size"))
    # Down the tree again: what survived meets the runs' rows, at most one for each run and digest, and these the documents.
    # So no document is dealt by its digest alone.
    first = rows.select("run", *KEY).distinct().join(last, KEY)
    kept = (F.col("row") == F.col("keep_row")).alias("kept")
    return rows.join(first, ["run", *KEY]).select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, all columns: of equal texts one row, that with the smallest id.

    Of rows repeated with the same id and text one stays (any, if other columns differ).
    """
    groups = stored(exact_groups(df, id_col, text_col))
    ids = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
    # An id of a row of its own decides for that row; for ids that repeat, the text decides too.
    if ids.where("n > 1").isEmpty():
        gone = ids.where(~F.col("kept")).select(F.col("doc_id").alias("__gone"))
        return df.join(gone, df[f"`{id_col}`"].eqNullSafe(gone["__gone"]), "left_anti")
    marked = df.withColumn("__sha", F.sha2(normalised(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), 256))
    stay = groups.where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__key")).distinct()
    alone = marked.join(stay, marked[f"`{id_col}`"].eqNullSafe(stay["__id"]) & (marked["__sha"] == stay["__key"]), "left_semi")
    return alone.dropDuplicates(["__sha"]).drop("__sha")
