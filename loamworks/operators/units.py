"""Work units: chunks of long texts with replayed lines, and bundles of short ones.

Chunks, and bundles within groups, are folds in order, so they run in Python over one text or one bounded group at a time.
First fit over a whole table is planned over counts of sizes: the driver sees a row for each size there is, never an item.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared


def chunk_lines(lines: list[str], cap: int, overlap: int) -> list[tuple[int, int]]:
    """First and past-the-last line of each chunk of at most cap bytes (one line may be more).

    The next chunk begins with as many of the last one's lines as make `overlap` bytes, but never with its first one.
    """
    sizes, out, first = [len(x.encode()) for x in lines], [], 0
    while first < len(lines):
        end, used = first, -1
        while end < len(lines) and (end == first or used + 1 + sizes[end] <= cap):
            used += 1 + sizes[end]
            end += 1
        out.append((first, end))
        if end == len(lines):
            break
        back, replayed = end, 0
        while back > first + 1 and replayed < overlap:
            back -= 1
            replayed += sizes[back]
        first = back
    return out


def chunks(df: DataFrame, key: str, text: str, cap: int, overlap: int) -> DataFrame:
    """key, part, of, first_line, end_line, bytes: the chunks of each text with anything but white space."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, t in zip(part["k"], part["t"]):
                lines = t.split("\n")
                spans = chunk_lines(lines, cap, overlap)
                rows += [(k, i + 1, len(spans), a, b, len("\n".join(lines[a:b]).encode())) for i, (a, b) in enumerate(spans)]
            yield pd.DataFrame(rows, columns=["k", "part", "of", "first_line", "end_line", "bytes"])

    read = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").rlike(r"\S"))
    kind = read.schema["k"].dataType.simpleString()
    return read.mapInPandas(run, f"k {kind}, part long, of long, first_line long, end_line long, bytes long").withColumnRenamed("k", key)


def first_fit(sizes: list[int], cap: int) -> list[int]:
    """The bundle (from 0) of each item, largest first (equal ones in order), in the first bundle with room."""
    where, free = [0] * len(sizes), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = next((b for b, room in enumerate(free) if sizes[i] <= room), len(free))
        if at == len(free):
            free.append(cap)
        free[at] -= sizes[i]
        where[i] = at
    return where


def next_fit(sizes: list[int], cap: int, most: int) -> list[int]:
    """The bundle of each item in order: a new one when the last is full in size or number."""
    where, bundle, used, n = [], -1, 0, 0
    for s in sizes:
        if bundle < 0 or used + s > cap or n >= most:
            bundle, used, n = bundle + 1, 0, 0
        where.append(bundle)
        used, n = used + s, n + 1
    return where


def bundles(df: DataFrame, key: str, size: str, cap: int, group: str, rule: str = "first_fit", most: int = 1_000_000) -> DataFrame:
    """key, group, size, bundle: packing within each group, which is what bounds the rows of one task (a day, a batch …)."""
    schema = f"k {df.schema[key].dataType.simpleString()}, g {df.schema[group].dataType.simpleString()}, s long, bundle long"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k", kind="stable")
        sizes = part["s"].astype(int).tolist()
        part["bundle"] = first_fit(sizes, cap) if rule == "first_fit" else next_fit(sizes, cap, most)
        return part[["k", "g", "s", "bundle"]]

    read = df.select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(size).cast("long").alias("s"))
    return read.groupBy("g").applyInPandas(run, schema).toDF(key, group, size, "bundle")


class OpenBundles:
    """Runs of neighbouring bundles with the same room, in order, so that the first one with enough of it is found fast.

    The runs lie in blocks, each with the most room of any of its runs; a block that grows too long is split.
    """

    LONGEST = 512

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int, int]]] = []  # first bundle, how many, room
        self.most: list[int] = []
        self.n = 0

    def first(self, room: int) -> tuple[int, int] | None:
        for b, most in enumerate(self.most):
            if most >= room:
                return b, next(i for i, run in enumerate(self.blocks[b]) if run[2] >= room)
        return None

    def add(self, count: int, room: int) -> None:
        if not self.blocks:
            self.blocks, self.most = [[]], [0]
        self.blocks[-1].append((self.n, count, room))
        self.n += count
        self._changed(len(self.blocks) - 1)

    def replace(self, at: tuple[int, int], runs: list[tuple[int, int, int]]) -> None:
        b, i = at
        self.blocks[b][i : i + 1] = runs
        self._changed(b)

    def _changed(self, b: int) -> None:
        block = self.blocks[b]
        if len(block) > self.LONGEST:
            half = len(block) // 2
            self.blocks[b : b + 1] = [block[:half], block[half:]]
            self.most[b : b + 1] = [max(r[2] for r in block[:half]), max(r[2] for r in block[half:])]
        else:
            self.most[b] = max(r[2] for r in block)


def first_fit_plan(counts: dict[int, int], cap: int) -> list[tuple[int, int, int, int, int]]:
    """size, first, n, bundle, per: of the items of a size (numbered from 0 in their order) the n from `first` on go into
    bundles from `bundle` on, `per` into each. The same bundles as first_fit() fills, without an item being touched.

    counts: how many items have each size. Items larger than cap have bundles of their own.
    """
    open_, out = OpenBundles(), []
    for size in sorted(counts, reverse=True):
        first, left = 0, counts[size]
        while left:
            if size > cap:
                out.append((size, first, left, open_.n, 1))
                open_.add(left, cap - size)
                break
            at = open_.first(size)
            if at is None:
                open_.add(-(-left // (cap // size)) if size > 0 else 1, cap)
                continue
            bundle, count, room = open_.blocks[at[0]][at[1]]
            per = room // size if size > 0 else left
            full = min(count, left // per)
            rest = left - full * per if full < count else 0
            out.append((size, first, full * per + rest, bundle, per))
            runs = [(bundle, full, room - per * size), (bundle + full, 1, room - rest * size), (bundle + full + 1, count - full - 1, room)]
            open_.replace(at, [r for r in (runs if rest else [runs[0], (bundle + full, count - full, room)]) if r[1] > 0])
            first, left = first + full * per + rest, left - full * per - rest
    return out


#: Numbers of one size are met with the plan in stretches of so many.
STRETCH = 4096


def numbered_by_size(df: DataFrame, key: str, size: str, cap: int) -> DataFrame:
    """k, s, number: the items of each size numbered from 0 in order of key. Those larger than cap are one size, cap + 1, the
    largest first.

    Items are sorted by range of (size, key) and numbered within their task, behind those of the tasks before it; so a size
    that very many items have is spread over tasks.
    """
    own = F.col(size).cast("long")
    read = df.select(F.col(key).alias("k"), F.least(own, F.lit(cap + 1)).alias("s"), F.when(own > cap, -own).otherwise(F.lit(0)).alias("o"))
    ranged = read.repartitionByRange("s", "o", "k").sortWithinPartitions("s", "o", "k").drop("o").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    placed = shared.written(ranged)
    firsts = placed.groupBy("s", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("s").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = firsts.select("s", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"))
    return placed.join(offsets, ["s", "part"]).select("k", "s", (F.col("at") + F.col("offset")).alias("number"))


def first_fit_all(df: DataFrame, key: str, size: str, cap: int) -> DataFrame:
    """key, size, bundle: first fit, largest items first (equal ones by key), over the whole table, as first_fit() does it.

    The plan is made on the driver from the counts of sizes (sizes up to cap are at most as many as cap; larger ones count as
    one size there). Keys are unique; a null size counts as zero.
    """
    items = df.select(F.col(key), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias(size))
    numbered = shared.written(numbered_by_size(items, key, size, cap))
    counts = {r.s: r.n for r in numbered.groupBy("s").agg(F.count("*").alias("n")).collect()}
    plan = df.sparkSession.createDataFrame(first_fit_plan(counts, cap), "s long, first long, n long, bundle long, per long")
    stretches = plan.withColumn("stretch", F.explode(F.sequence(F.expr(f"first div {STRETCH}"), F.expr(f"(first + n - 1) div {STRETCH}"))))
    met = numbered.withColumn("stretch", F.expr(f"number div {STRETCH}")).join(stretches, ["s", "stretch"]).where((F.col("number") >= F.col("first")) & (F.col("number") < F.col("first") + F.col("n")))
    placed = met.select(F.col("k").alias(key), (F.col("bundle") + F.expr("(number - first) div per")).alias("bundle"))
    return items.join(placed, key)
