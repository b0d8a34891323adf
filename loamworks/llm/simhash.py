"""SimHash fingerprints of word shingles, linked through pigeonhole blocks.

Two fingerprints that differ in at most d bits agree in all but d of b > d blocks. So each is filed under every choice
of b - d blocks, fingerprints filed alike are compared, and the Hamming distance is verified. A block that many
fingerprints share isn't compared pair by pair: there each is filed under itself and every fingerprint one bit away
(those that share such a point are at most two bits apart, and at most 65 can share it), which finds every link, in
proportion to the block's size.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_slices, keyed_text, spread_join, stored
from .components import connected_components

BITS = 64
SEED = 42
#: Fingerprints of a block that are compared pair by pair; larger blocks are linked through neighbouring points.
PAIRED = 64


def lower_words(text: str) -> list[bytes]:
    """The words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of `size` words (fewer words: of the whole sequence; none: nothing), repeats included."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    runs = words if size == 1 else map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.fromiter((digest(x, SEED) for x in runs), np.uint64, len(words) - size + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits; in steps, so that a very long text takes little memory."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.ascontiguousarray(hashes[at : at + (1 << 15)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return counts


def simhash(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint long: a bit is 1 if more than half of the shingles' hashes have it.

    One row for each input row. A null text, or one without a word, has fingerprint 0.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.zeros((batch.num_rows, BITS), np.uint8)
        for i, text in enumerate(batch.column(1).to_pylist()):
            hashes = shingle_hashes(lower_words(text), shingle)
            bits[i] = 2 * bit_counts(hashes) > len(hashes)
        packed = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.int64())], ["doc_id", "fingerprint"])

    bounded_batches(df.sparkSession)
    read = keyed_text(df, id_col, text_col)
    return read.mapInArrow(by_slices(each), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def masks(distance: int, blocks: int) -> list[int]:
    """The bits of each choice of blocks - distance blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    each = [sum(1 << b for b in range(x, y)) for x, y in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(each, blocks - distance)]


def filed(values: DataFrame, distance: int, blocks: int) -> DataFrame:
    """table, key, value: each value under what every choice of blocks has of it."""
    keys = [F.struct(F.lit(i).alias("table"), F.col("value").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks(distance, blocks))]
    return values.select("value", F.explode(F.array(*keys)).alias("f")).select("f.table", "f.key", "value")


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_links(values: DataFrame, distance: int = 2, blocks: int = 4, paired: int = PAIRED) -> DataFrame:
    """Links a, b between distinct values (one long column, no repeats) at most `distance` bits apart.

    Every pair that is close is joined by links, though not each such pair has a link of its own. In blocks of more
    than `paired` values, for a distance of 2 or less, the links are between values that share a point one bit away
    (distance 2), half as far (distance 1: the values themselves) or none. Greater distances take pairs everywhere.
    """
    rows = filed(values.toDF("value"), distance, blocks)
    shared = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    # Few fingerprints share a block with another one; these are stored, so that the joins below read little.
    rows = stored(rows.join(shared, ["table", "key"]))
    small = rows.where(F.col("n") <= paired) if distance <= 2 else rows
    other = small.select("table", "key", F.col("value").alias("b"))
    pairs = small.join(other, ["table", "key"]).where((F.col("value") < F.col("b")) & (differing(F.col("value"), F.col("b")) <= distance)).select(F.col("value").alias("a"), "b")
    if distance > 2:
        return pairs.distinct()
    large = rows.where(F.col("n") > paired).select("value").distinct()
    if distance == 2:
        points = [F.col("value"), *(F.col("value").bitwiseXOR(F.lit(signed(1 << i))) for i in range(BITS))]
    elif distance == 1:
        # Values one bit apart share the lower of the two ends of their edge.
        points = [F.struct(F.col("value").bitwiseAND(F.lit(signed(~(1 << i) & (2**64 - 1)))).alias("end"), F.lit(i).alias("bit")) for i in range(BITS)]
    else:
        return pairs.distinct()
    at = large.select("value", F.explode(F.array(*points)).alias("point"))
    stars = at.groupBy("point").agg(F.min("value").alias("a"), F.collect_set("value").alias("v")).where(F.size("v") > 1)
    return pairs.union(stars.select("a", F.explode("v").alias("b")).where("a <> b")).distinct()


def near_components(prints: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """The rows of prints (doc_id, fingerprint) with component_id: the smallest doc_id reachable over near links.

    Rows with the same fingerprint are linked. Null ids count as none when the smallest is sought; a component of null
    ids alone has component_id null. Repeated rows stay, each with its component.
    """
    prints = stored(prints)
    values = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    links = near_links(values.select("fingerprint"), distance, blocks)
    nodes = connected_components(links).select(F.col("node").alias("fingerprint"), "component")
    placed = values.join(nodes, "fingerprint", "left").select("fingerprint", "least", F.coalesce("component", "fingerprint").alias("component"))
    placed = stored(placed)
    smallest = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = spread_join(placed, smallest, "component").select("fingerprint", "component_id")
    return spread_join(prints, named, "fingerprint").select("doc_id", "fingerprint", "component_id")
