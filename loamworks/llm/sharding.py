"""Sharding through fixed virtual slots, in DataFrame operations only.

Records are hashed into a fixed number of slots, bytes are summed for each slot, and a map says which shard holds which
slot. Each version of the map is stored; balancing or adding a shard edits the map before it, so that only the rows of
the slots that it moves go elsewhere. The map has as many rows as there are slots, whatever the input's size: it alone
is edited on the driver and broadcast. Rows alike in id and text are numbered, and each has a slot of its own, so a row that
stands very often fills many slots evenly.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keyed_text, shared_dir, stored

#: Slots of a map; a bound of what the driver sees and what is broadcast.
SLOTS = 8192
SLOT_MAP = "virtual_slot int, shard int"


def sized(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and overhead), text_crc32, alike (a hash of these), part (the task that read it)."""
    rows = keyed_text(df, id_col, text_col).select("doc_id", (F.octet_length("text") + F.lit(overhead)).cast("long").alias("size"), F.crc32("text").alias("text_crc32"))
    return rows.withColumn("alike", F.xxhash64("doc_id", "text_crc32", "size")).withColumn("part", F.spark_partition_id())


def copy_numbers(rows: DataFrame) -> DataFrame:
    """rows (stored, of sized()) with copy: rows that are alike numbered from 0.

    They are counted for each part of the input and numbered within it, behind those of the parts before, so no group of
    them is one task's. Only rows that have another like them are numbered.
    """
    counts = rows.groupBy("alike", "part").agg(F.count("*").alias("n"))
    by = Window.partitionBy("alike")
    before = F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    repeated = stored(counts.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("all", F.sum("n").over(by)).where("all > 1").select("alike", "part", "before"))
    if repeated.isEmpty():
        return rows.withColumn("copy", F.lit(0).cast("long"))
    at = F.row_number().over(Window.partitionBy("alike", "part").orderBy("doc_id"))
    numbered = rows.join(repeated, ["alike", "part"], "left")
    several = numbered.where(F.col("before").isNotNull()).withColumn("copy", F.col("before") + at - 1)
    return several.unionByName(numbered.where(F.col("before").isNull()).withColumn("copy", F.lit(0).cast("long"))).drop("before")


def slotted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, overhead: int = 8) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and overhead), text_crc32, virtual_slot of each row; a null text has no bytes.

    The slot depends on id, text and the row's number among those alike in both, so rows that repeat an id, or a whole row,
    spread over slots. Which of equal rows has which number can't be told, so results don't depend on the order of rows.
    """
    rows = copy_numbers(stored(sized(df, id_col, text_col, overhead)))
    return rows.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots)).cast("int").alias("virtual_slot"))


def even_map(slots: int, shards: int) -> list[int]:
    """The first version: as many neighbouring slots for each shard."""
    return [slot * shards // slots for slot in range(slots)]


def balanced_map(shard_of: list[int], load: dict[int, int], shards: int) -> list[int]:
    """The map after slots were moved or swapped between the fullest and the emptiest shard while that narrows their gap."""
    shard_of = list(shard_of)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        if load.get(slot, 0):
            insort(held[shard], (load[slot], slot))
    total = [sum(n for n, _ in h) for h in held]
    while True:
        full, thin = max(range(shards), key=total.__getitem__), min(range(shards), key=total.__getitem__)
        gap, best = total[full] - total[thin], (0, None, None)
        for n, slot in held[full]:
            at = bisect_left(held[thin], (n - gap / 2, -1))
            for m, other in (*held[thin][max(0, at - 1) : at + 1], (0, -1)):
                if 0 < n - m < gap and (gain := min(n - m, gap - n + m)) > best[0]:
                    best = (gain, (n, slot), (m, other))
        if best[1] is None:
            return shard_of
        (n, slot), (m, other) = best[1], best[2]
        held[full].remove((n, slot))
        insort(held[thin], (n, slot))
        shard_of[slot] = thin
        if other >= 0:
            held[thin].remove((m, other))
            insort(held[full], (m, other))
            shard_of[other] = full
        total[full], total[thin] = total[full] - n + m, total[thin] + n - m


def grown_map(shard_of: list[int], load: dict[int, int], shards: int) -> list[int]:
    """The map for one shard more, which takes slots from the fullest ones until it is as full as the mean; none else move."""
    shard_of, total = list(shard_of), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(shard_of):
        total[shard] += load.get(slot, 0)
        insort(held[shard], (load.get(slot, 0), slot))
    mean, new = sum(total) / (shards + 1), 0
    while True:
        full = max(range(shards), key=total.__getitem__)
        at = bisect_left(held[full], (mean - new + 1, -1)) - 1
        if at < 0 or held[full][at][0] == 0:
            return shard_of
        n, slot = held[full].pop(at)
        shard_of[slot], total[full], new = shards, total[full] - n, new + n


def map_table(spark: SparkSession, shard_of: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(shard_of)), SLOT_MAP)


def store_map(table: DataFrame, path: str, version: int) -> None:
    """Write a version of the map; a version that is there already is never written over."""
    table.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, by default the latest."""
    versions = spark.read.option("basePath", path).parquet(path)
    if version is None:
        version = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == version).select("virtual_slot", "shard")


def slot_loads(rows: DataFrame) -> DataFrame:
    """virtual_slot, bytes, rows: at most as many rows as there are slots."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def shard_by_bytes(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot: every row in a shard, the shards' bytes nearly equal.

    slot numbers the rows of a shard from 0 without gaps: its virtual slots one after the other, by id within one. Two
    versions of the map are stored under path (by default a new shared folder): the even one, and that edited by bytes.
    Repeated rows each have a place of their own. No rows: no rows.
    """
    spark = df.sparkSession
    rows = stored(slotted(df, id_col, text_col, slots))
    loads = stored(slot_loads(rows))
    path = path or shared_dir(spark)
    first = even_map(slots, shards)
    store_map(map_table(spark, first), path, 0)
    store_map(map_table(spark, balanced_map(first, {r.virtual_slot: r.bytes for r in loads.collect()}, shards)), path, 1)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = load_map(spark, path).join(loads, "virtual_slot").withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    within = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(within))
    return numbered.join(F.broadcast(placed.select("virtual_slot", "shard", "before")), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("before") + F.col("at") - 1).alias("slot")
    )
