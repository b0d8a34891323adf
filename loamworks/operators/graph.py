"""Connected components by stars that tasks make of their edges, and checks of a link graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from .shared import deleted, written

#: Edges that a task links at once; a graph that has become so small is linked by one task.
CHUNK = 1 << 20

#: A key is hot if it has more than so many rows and more than one of so many parts of all rows: fewer than HOT_PARTS keys can be.
HOT_ROWS, HOT_PARTS = 256, 1024


def spread_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows joined with table (one row a key) on key, a hot key's rows dealt over as many parts as bring each below the limit.

    rows is a written table. Fewer than HOT_PARTS keys can be hot; only these are broadcast.
    """
    limit = max(HOT_ROWS, rows.count() // HOT_PARTS)
    hot = rows.groupBy(key).count().where(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).cast("int").alias("parts")).collect()
    if not hot:
        return rows.join(table, key)
    parts = F.broadcast(rows.sparkSession.createDataFrame(hot, rows.select(key, F.lit(1).alias("parts")).schema))
    dealt = rows.join(parts, key, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), "parts"), F.lit(0)).cast("int")).drop("parts")
    repeated = table.join(parts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(repeated, [key, "part"]).drop("part")


def least_reachable(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The least number reachable from each of n numbers over the edges x, y."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(x, y), np.maximum(x, y)
        low, high = low[linked := low != high], high[linked]
        if not len(low):
            return root
        np.minimum.at(root, high, low)
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[low], root[high]


def _chunk_stars(edges: pa.Table) -> pa.RecordBatch:
    """a, b: each node of these edges (a, b, and their hashes if any) with the first one reachable, by hash or else by value."""
    coded = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]).combine_chunks().dictionary_encode()
    codes, nodes = coded.indices.to_numpy(), coded.dictionary
    order = pc.sort_indices(nodes).to_numpy()
    if edges.num_columns > 2:
        hashes = np.empty(len(nodes), np.int64)
        hashes[codes] = np.concatenate([edges[c].to_numpy() for c in ("ha", "hb")])
        order = order[np.argsort(hashes[order], kind="stable")]
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    root, nodes = least_reachable(*place[codes].reshape(2, -1), len(nodes)), nodes.take(pa.array(order))
    return pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], ["a", "b"])


def _stars(edges: DataFrame, turn: int | None = None) -> DataFrame:
    """a, b: the nodes of each CHUNK edges of a task with the first one there that they reach: by a hash of this turn, or by value."""
    size = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            if (rows := rows + batch.num_rows) >= size:
                yield _chunk_stars(pa.Table.from_batches(held))
                held, rows = [], 0
        if rows:
            yield _chunk_stars(pa.Table.from_batches(held))

    given = edges if turn is None else edges.select("a", "b", F.xxhash64(F.lit(turn), "a").alias("ha"), F.xxhash64(F.lit(turn), "b").alias("hb"))
    return given.mapInArrow(run, edges.schema)


def _least_named(rows: DataFrame) -> DataFrame:
    """node, component of rows (node, component) whose component is any name: the least of its nodes instead."""
    rows = written(rows)
    least = rows.groupBy("component").agg(F.min("node").alias("least"))
    out = written(spread_join(rows, least, "component").select("node", F.col("least").alias("component")))
    deleted(rows)
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of an edge. edges: two columns of one orderable type; direction
    and repeats don't matter, an edge with a null is none, a loop makes its node a component.

    Each task makes stars of its edges, so few rows move: a node comes once from a chunk. Nodes then take the first of their
    stars' centres, in an order by hash that is another one in each turn, and the graph of centres goes on, which has a part of
    the nodes. Once it has CHUNK rows at most, one task links them. Only counts come to the driver.
    """
    a, b = edges.columns
    kind = edges.select(F.array(a, b).alias("n")).schema["n"].dataType.elementType
    given = edges.select(F.col(a).cast(kind).alias("a"), F.col(b).cast(kind).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    if not isinstance(kind, (IntegralType, StringType)):
        given = written(given)
        nodes = written(given.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("id", F.monotonically_increasing_id()))
        named = lambda c: nodes.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
        found = components(given.join(named("a"), "a").join(named("b"), "b").select("a_id", "b_id"))
        return _least_named(nodes.join(found.withColumnRenamed("node", "id"), "id").select("node", "component"))
    now, levels = written(_stars(given, 0)), []
    while now.count() > CHUNK:
        centres = now.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit(len(levels)), "b").alias("h"), "b")).alias("m"), F.collect_set("b").alias("centres"))
        levels.append(written(centres.select("a", F.col("m.b").alias("m"), "centres")))
        deleted(now)
        met = levels[-1].select("m", F.explode("centres").alias("a")).distinct()
        linked = met.join(levels[-1].select("a", F.col("m").alias("b")), "a").where("m <> b").select(F.col("m").alias("a"), "b")
        now = written(_stars(linked, len(levels)))
    found = written(_stars(now.coalesce(1)).toDF("node", "component"))
    deleted(now)
    if not levels:
        return found
    for level in reversed(levels):
        rows = level.select(F.col("a").alias("node"), "m")
        table = rows.select("m").distinct().join(found.withColumnRenamed("node", "m"), "m", "left").select("m", F.coalesce("component", "m").alias("component"))
        found = written(spread_join(rows, table, "m").select("node", "component"))
        deleted(level)
    return _least_named(found)


def link_audit(pages: DataFrame, links: DataFrame, index: DataFrame) -> DataFrame:
    """signal, subject, detail: broken links (no such page), orphans (no page links to them), pages that the index lacks and
    index lines without a page. pages, index: name; links: src, dst."""
    broken = links.join(pages, links.dst == pages.name, "left_anti").select(F.lit("broken_link").alias("signal"), F.col("src").alias("subject"), F.col("dst").alias("detail"))
    linked = links.where("src <> dst").select(F.col("dst").alias("name"))
    none = F.lit(None).cast("string").alias("detail")
    orphan = pages.join(linked, "name", "left_anti").select(F.lit("orphan").alias("signal"), F.col("name").alias("subject"), none)
    missing = pages.join(index, "name", "left_anti").select(F.lit("not_in_index").alias("signal"), F.col("name").alias("subject"), none)
    stale = index.join(pages, "name", "left_anti").select(F.lit("stale_index").alias("signal"), F.col("name").alias("subject"), none)
    return broken.unionAll(orphan).unionAll(missing).unionAll(stale).distinct()


def carried_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """Findings of a new scan: first_seen and deferrals of those that were open before go on; vanished ones are gone.

    old: signal, file, first_seen, deferred; new: signal, file, seen.
    """
    before = old.select("signal", "file", "first_seen", "deferred")
    return new.join(before, ["signal", "file"], "left").select("signal", "file", F.coalesce("first_seen", "seen").alias("first_seen"), F.when(F.col("first_seen").isNull(), 0).otherwise(F.col("deferred") + 1).cast("long").alias("deferred"))
