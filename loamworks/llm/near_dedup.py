"""Near-dedup of texts at a similarity of word shingles: every two texts that are as similar meet, and are verified.

Texts meet by SimHash first, as in operator 2: those whose fingerprints are linked are verified by the similarity of their
shingles. SimHash alone misses texts at the threshold, so an exact join on first shingles finds the links that are left.

Two sets of shingles whose Jaccard similarity is t or more have one of their first shingles in common, in any order that all
texts use, if of n shingles the first n - ceil(t n) + 1 are taken. Each text is filed under these; the order puts shingles
that a sample often has last, and before them those that would crowd a block, so few texts share a block. Lengths and places
in the order rule out most other pairs. A block with few texts is compared pair by pair. In a crowded one each text is compared with the block's centre first (the text that
has the most texts in its blocks, as an original has among its copies). Texts that are then in the centre's component need no
link among each other; the others, the strays, are compared with all texts of the centre's blocks (its crowd). A crowd meets by
parts, in which a task has the shingles of two parts and multiplies them as sparse vectors: it finds every link exactly, makes no
row for a pair, and gives back one row at most for each text, the components that its links join. So components are exact; the
rows of a crowd grow with its texts, the products in tasks with its texts times its strays.

Little moves before a pair is known to be worth it. Shingles are sorted once, by range, and only those that two texts have go
on. A pair first meets with two bitmaps of the texts' shingles: of those that set a bit which the other text's map lacks, none
is in both, which bounds the similarity from above. Only texts of pairs that this leaves are moved and compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import least_reachable
from ..operators.grid import Vectors, scores
from .common import bounded_batches, by_slices, hot_keys, keyed_text, spread_join, stored
from .components import connected_components
from .simhash import lower_words, near_links, shingle_hashes, simhash

#: Texts of a block that are compared pair by pair.
PAIRED = 16
#: Shingles are counted in one of so many texts at most, or in about so many texts; those seen so often there come last in the order.
SAMPLE_STEP, SAMPLE_ROWS, OFTEN = 16, 16_384, 4
#: The most shingles whose counts are broadcast (the most frequent ones).
COUNTED = 1 << 16
#: Bits of the map of shingles that would crowd a block, however many there are; and how often it is added to, at most.
CROWD_BITS, CROWD_TURNS = 1 << 26, 2
#: Hash buckets of ids; a table of those that some ids fall into has no more rows than these, so it may always be broadcast.
BUCKETS = 1 << 20
#: Texts of a crowd's part: at most (about), and at least where there are tasks for more parts; and its shingles at most (about).
MOST_TEXTS, LEAST_TEXTS, MOST_SHINGLES = 4096, 512, 1 << 20


def often(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample have, in order, and how often, as a power of two. Any answer leaves results the same."""
    step = max(1, min(SAMPLE_STEP, texts.count() // SAMPLE_ROWS))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(shingle_hashes(lower_words(t), shingle)) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["key"])

    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    counts = sample.mapInArrow(by_slices(each), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    table = counts.orderBy(F.desc("n"), "key").limit(COUNTED).toArrow()
    keys, n = table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    order = np.argsort(keys)
    return keys[order], np.log2(n[order]).astype(np.int8)


def first_shingles(hashes: np.ndarray, similarity: float, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Of a text's distinct shingles, in order, those of which two similar texts share one. known: those of often(), and crowding()."""
    keys, level, crowds = known
    slot = hashes & np.uint64(CROWD_BITS - 1)
    rank = ((crowds[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(np.int8) - 1
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        rank = np.where(keys[at] == hashes, level[at], rank)
    return hashes[np.lexsort((hashes, rank))[: len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1]]


def crowding(texts: DataFrame, shingle: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """often(), and a map of the shingles that would be filed for more than PAIRED texts, which a sample doesn't show.

    Those come after the ones that few texts have, so texts that only share a phrase don't meet in blocks. Where there are more
    of them than texts, what is filed instead is looked at once more. Shingles that share a bit with one of them come late too,
    which leaves results the same.
    """
    known, total = (*often(texts, shingle), np.zeros(CROWD_BITS // 64, np.uint64)), texts.count()
    for _ in range(CROWD_TURNS):
        shared = texts.sparkSession.sparkContext.broadcast(known)

        def each(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            found = [first_shingles(np.unique(shingle_hashes(lower_words(t), shingle)), similarity, shared.value) for t in batch.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], ["key"])

        filed = texts.select("text").mapInArrow(by_slices(each), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PAIRED)
        slot = F.col("key").bitwiseAND(F.lit(CROWD_BITS - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
        words = filed.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits"), F.sum("n").alias("n")).toArrow()
        shared.unpersist()
        crowds = known[2].copy()
        crowds[words["word"].to_numpy()] |= words["bits"].to_numpy().view(np.uint64)
        known = (*known[:2], crowds)
        if (pc.sum(words["n"]).as_py() or 0) <= total:
            break
    return known


def same_words(words: list[bytes]) -> bytes:
    """128 bits by which texts of the same lower-cased words are known."""
    return xxhash.xxh3_128_digest(b" ".join(words))


def shingle_map(hashes: np.ndarray) -> bytes:
    """How many distinct shingles a text has, and a bitmap of them with two to four bits for each (64-bit numbers)."""
    width = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(hashes >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.uint64(len(hashes)).tobytes() + np.packbits(bits, bitorder="little").tobytes()


def most_alike(x: bytes, y: bytes) -> float:
    """The greatest Jaccard similarity that two sets with these maps may have."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    (n, m), x, y = (int(x[0]), int(y[0])), x[1:], y[1:]
    if len(x) > len(y):  # the wider map folded to the other's width
        x = np.bitwise_or.reduce(x.reshape(-1, len(y)))
    elif len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)))
    common = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
    return common / (n + m - common)


def signatures(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """doc_id, same (of same_words()), size (distinct shingles), keys, map (shingle_map()) of each text that has a word."""
    shared = texts.sparkSession.sparkContext.broadcast(crowding(texts, shingle, similarity))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, same, sizes, keys, maps = [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            if words := lower_words(text):
                hashes = np.unique(shingle_hashes(words, shingle))
                rows.append(i)
                same.append(same_words(words))
                sizes.append(len(hashes))
                keys.append(first_shingles(hashes, similarity, shared.value).view(np.int64))
                maps.append(shingle_map(hashes))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(same, pa.binary()), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.binary())], ["doc_id", "same", "size", "keys", "map"])

    return texts.mapInArrow(by_slices(each), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, same binary, size int, keys array<long>, map binary")


def with_equal_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's rows, sorted by their first column, those with a neighbour like them there; and the first and last ones, whose
    neighbours may be another task's."""
    held = None  # the last row so far, and whether it has gone out
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        same = key[1:] == key[:-1]
        out = np.r_[False, same] | np.r_[same, False]
        if held is None:
            out[0] = True
        elif held[0] == key[0]:
            out[0] = True
            if not held[1]:
                yield held[2]
        yield batch.filter(pa.array(out))
        held = int(key[-1]), bool(out[-1]), batch.slice(batch.num_rows - 1)
    if held and not held[1]:
        yield held[2]


def jaccard(a: str, b: str, shingle: int) -> float:
    """Of the sets of lower-cased word shingles (fewer words: the whole sequence)."""
    x, y = ({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} for w in (lower_words(a), lower_words(b)))
    return len(x & y) / len(x | y)


def bucket(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS))


def bucketed(ids: DataFrame) -> DataFrame:
    """__bucket of these ids (one column), to be broadcast: at most BUCKETS numbers."""
    return F.broadcast(ids.select(bucket(F.col(ids.columns[0])).alias("__bucket")).distinct())


def perhaps(df: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The rows of df whose key may be one of the ids: all of those, and few others. Nothing of df moves."""
    return df.withColumn("__bucket", bucket(key)).join(bucketed(ids), "__bucket", "left_semi").drop("__bucket")


def surely_not(df: DataFrame, key: Column, ids: DataFrame) -> DataFrame:
    """The other rows of df, null keys included."""
    return df.withColumn("__bucket", bucket(key)).join(bucketed(ids), "__bucket", "left_anti").drop("__bucket")


def with_values(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """a, b, x, y: the stored pairs a < b with the values (doc_id, value) of both (x, y in any order).

    Pairs of an id that has very many (a hub) get its value by id and part, all others by id. A value moves only if a pair has it.
    """
    named = lambda rows, id_, value: perhaps(table, F.col("doc_id"), rows.select(id_)).select(F.col("doc_id").alias(id_), F.col("value").alias(value))
    both = lambda rows: rows.join(named(rows, "a", "x"), "a").join(named(rows, "b", "y"), "b").select("a", "b", "x", "y")
    hot = hot_keys(pairs.select(F.col("a").alias("hub")).union(pairs.select("b")), "hub")
    if hot is None:
        return both(pairs)
    as_a, as_b = (F.broadcast(hot.withColumnRenamed("hub", c)) for c in ("a", "b"))
    cool = pairs.join(as_a, "a", "left_anti")
    # Of two hubs the first one counts as the hub, so no other end has more pairs than there are hubs, or than the limit.
    rows = pairs.join(as_a, "a").select(F.col("a").alias("hub"), F.col("b").alias("leaf"), "__parts")
    rows = rows.union(cool.join(as_b, "b").select(F.col("b").alias("hub"), F.col("a").alias("leaf"), "__parts"))
    rows = stored(rows.select("hub", "leaf", F.pmod(F.xxhash64("leaf"), "__parts").cast("int").alias("part")))
    hubs = named(hot, "hub", "x").join(hot, "hub").select("hub", "x", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("part"))
    spread = rows.join(named(rows, "leaf", "y"), "leaf").join(hubs, ["hub", "part"])
    spread = spread.select(F.least("hub", "leaf").alias("a"), F.greatest("hub", "leaf").alias("b"), "x", "y")
    return spread.union(both(cool.join(as_b, "b", "left_anti")))


def compared(pairs: DataFrame, texts: DataFrame, maps: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The pairs a < b: those whose maps leave it open whether they are near, with their similarity (alike); and the others,
    with the greatest it may be (most). maps: doc_id, value (shingle_map())."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def measured(measure, name: str):
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            return batch.select([0, 1]).append_column(name, pa.array([measure(s, t) for s, t in zip(x, y)], pa.float64()))

        return by_slices(each, 64), f"a {kind}, b {kind}, {name} double"

    bounds = stored(with_values(stored(pairs), maps).mapInArrow(*measured(most_alike, "most")))
    open_ = F.col("most") >= similarity - 1e-9
    values = with_values(bounds.where(open_).select("a", "b"), texts.select("doc_id", F.col("text").alias("value")))
    return values.mapInArrow(*measured(lambda s, t: jaccard(s, t, shingle), "alike")), bounds.where(~open_)


def may_be_near(similarity: float) -> Column:
    """Whether the texts (size, at) and (b_size, b_at) can be as similar, if no shingle before these places is in both."""
    size, other = F.col("size"), F.col("b_size")
    left = F.least(size - F.col("at"), other - F.col("b_at"))
    return (F.least(size, other) >= similarity * F.greatest(size, other) - 1e-6) & (left >= similarity / (1 + similarity) * (size + other) - 1e-6)


def block_centres(placed: DataFrame) -> DataFrame:
    """key, centre: of each block the text of the greatest weight. Maxima are made in each task before rows meet by block."""
    return placed.groupBy("key").agg(F.max(F.struct("weight", "id")).alias("m")).select("key", F.col("m.id").alias("centre"))


def stray_pairs(crowded: DataFrame, centres: DataFrame, stars: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """a, b: the strays of crowded blocks, each with the block's texts of other components that may be near it.

    stars: a, b, near, far (the least and the greatest distance it may have) of the texts that met a centre; nodes: node, component.
    A pair comes from one block only, that of the first crowded shingle that both have: where a shingle before it is in both, its
    block is small and the pair was compared there.
    """
    keys = crowded.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("k")).select("id", F.col("k.key").alias("keys"))
    component = lambda c: nodes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    away = stars.select(F.col("a").alias("id"), F.col("b").alias("centre"), "near", "far").union(stars.select("b", "a", "near", "far"))
    placed = crowded.join(centres, "key").join(component("id"), "id", "left").join(component("centre"), "centre", "left").join(away, ["id", "centre"], "left").join(keys, "id")
    own, hub = F.coalesce("id_component", "id"), F.coalesce("centre_component", "centre")
    distance = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("near", "far")]
    placed = stored(placed.select("key", "id", "size", "at", "keys", own.alias("component"), (own != hub).alias("stray"), *distance))
    strays = placed.where("stray").drop("stray")
    others = placed.select("key", *(F.col(c).alias(f"b_{c}") for c in ("id", "size", "at", "keys", "component", "stray", "near", "far")))
    apart = (F.col("component") != F.col("b_component")) & (~F.col("b_stray") | (F.col("id") < F.col("b_id")))
    reach = 1 - similarity + 1e-9
    near = (F.col("near") - F.col("b_far") <= reach) & (F.col("b_near") - F.col("far") <= reach)
    first = F.element_at(F.array_intersect("keys", "b_keys"), 1) == F.col("key")
    found = strays.join(others, "key").where(apart & near & may_be_near(similarity) & first)
    return found.select(F.least("id", "b_id").alias("a"), F.greatest("id", "b_id").alias("b")).distinct()


def shingled(texts: DataFrame, shingle: int) -> DataFrame:
    """id, shingles (distinct, in order) of each text."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(shingle_hashes(lower_words(t), shingle)).view(np.int64) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(by_slices(each), f"id {texts.schema['doc_id'].dataType.simpleString()}, shingles array<long>")


def stray_links(crowd: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b: components that are joined by links between strays and other texts of a centre's crowd, as stars of each task.

    crowd: centre, id, size, a stored table of the texts that share a crowded block with this centre, itself included; nodes:
    node, component. Strays are dealt over some parts, all texts of the crowd over others; every two parts meet in one task.
    """
    component = lambda c: nodes.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component"))
    hubs = crowd.select("centre").distinct().join(component("centre"), "centre", "left").select("centre", F.coalesce("centre_component", "centre").alias("hub"))
    own = F.coalesce("id_component", "id")
    placed = spread_join(crowd, hubs, "centre").join(component("id"), "id", "left")
    placed = stored(placed.select("centre", "id", "size", own.alias("component"), (own != F.col("hub")).alias("stray")))
    parallel = crowd.sparkSession.sparkContext.defaultParallelism
    most = min(MOST_TEXTS, max(LEAST_TEXTS, placed.count() // (4 * parallel)))
    parts = lambda of: F.greatest(F.ceil(F.count_if(of) / most), F.ceil(F.sum(F.when(of, F.col("size"))) / MOST_SHINGLES)).cast("int")
    crowds = placed.groupBy("centre").agg(parts(F.lit(True)).alias("of_all"), parts(F.col("stray")).alias("of_strays")).where("of_strays > 0")
    placed = spread_join(placed, crowds, "centre")
    at = lambda of: F.pmod(F.xxhash64("id"), of).cast("int")
    meets = lambda one, of, place: F.transform(F.sequence(F.lit(0), F.col(of) - 1), lambda k: F.struct(F.lit(one).alias("one"), *(c.alias(n) for c, n in zip(place(k), "ij"))))
    as_stray, as_other = meets(True, "of_all", lambda j: (at("of_strays"), j)), meets(False, "of_strays", lambda i: (i, at("of_all")))
    met = placed.join(shingled(perhaps(texts, F.col("doc_id"), placed.select("id")), shingle), "id")
    met = met.select("centre", "component", F.to_json(F.struct("component")).alias("name"), "shingles", F.explode(F.when(F.col("stray"), F.concat(as_stray, as_other)).otherwise(as_other)).alias("m"))
    kind = crowd.schema["id"].dataType.simpleString()

    def compare(table: pa.Table) -> pa.Table:
        names = table["name"].combine_chunks().dictionary_encode()
        code, row = names.indices.to_numpy(), np.zeros(len(names.dictionary), np.int64)
        row[code] = np.arange(len(code))
        lists = table["shingles"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        known, term = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        every, one = Vectors(size, term, np.ones(len(term)), len(known)), table["one"].to_numpy()
        x, y = np.flatnonzero(one), np.flatnonzero(~one)
        root = np.arange(len(row))
        for start, common in scores(every.part(x), every.part(y)):
            mine = x[start : start + len(common)]
            common = common.astype(np.float64)
            a, b = np.nonzero(common / (size[mine][:, None] + size[y] - common) >= similarity)
            root = least_reachable(root[code[mine[a]]], root[code[y[b]]], len(row))[root]
        joined = np.flatnonzero(root != np.arange(len(row)))
        named = lambda of: table["component"].take(pa.array(row[of]))
        return pa.table([named(root[joined]), named(joined)], ["a", "b"])

    met = met.select("centre", "m.*", "component", "name", "shingles").repartition(8 * parallel, "centre", "i", "j")
    return met.groupBy("centre", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")


def print_pairs(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """a, b: the texts of these ids (doc_id) that SimHash links: those of one fingerprint, and the first ones of near fingerprints."""
    prints = stored(simhash(texts).join(ids, "doc_id", "left_semi"))
    first = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    named = lambda c: first.select(F.col("fingerprint").alias(c), F.col("least").alias(f"{c}_doc"))
    links = near_links(first.select("fingerprint")).join(named("a"), "a").join(named("b"), "b").select(F.col("a_doc").alias("a"), F.col("b_doc").alias("b"))
    alike = prints.join(first.where("n > 1"), "fingerprint").where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    return links.union(alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def with_same(df: DataFrame, text_col: str) -> DataFrame:
    """df with the column __same: same_words() of its texts, null for those without a word."""
    at = df.columns.index(text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [lower_words(t or "") for t in batch.column(at).to_pylist()]
        return batch.append_column("__same", pa.array([same_words(w) if w else None for w in words], pa.binary()))

    return df.mapInArrow(by_slices(each), T.StructType([*df.schema.fields, T.StructField("__same", T.BinaryType())]))


def linked(texts: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, bool]:
    """doc, component of each document that is near another one; whether ids repeat over different words.

    texts: doc_id, text. A document is an id, or, where ids repeat over different words, an id and same_words().
    """
    bounded_batches(texts.sparkSession)
    signed = stored(signatures(texts, shingle, similarity))
    repeated = not signed.groupBy("doc_id").agg(F.min("same").alias("x"), F.max("same").alias("y")).where("x <> y").isEmpty()
    if repeated:
        document = lambda same: F.struct("doc_id", F.col(same).alias("same"))
        texts = with_same(texts, "text").where("__same IS NOT NULL").select(document("__same").alias("doc_id"), "text")
        signed = signed.withColumn("doc_id", document("same"))
    # Rows that repeat a document have the same words: any one's text will do.
    if not signed.groupBy("doc_id").count().where("count > 1").isEmpty():
        texts = texts.groupBy("doc_id").agg(F.max("text").alias("text"))
        signed = signed.dropDuplicates(["doc_id"])
    # Texts with the same words are one from here on: that of the smallest id.
    alike = signed.groupBy("same").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").select("same", "b")
    twins = stored(signed.select("same", "doc_id").join(alike, "same").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b"))
    others = twins.select(F.col("a").alias("doc_id"))
    ones = surely_not(signed, F.col("doc_id"), others).union(perhaps(signed, F.col("doc_id"), others).join(others, "doc_id", "left_anti").select(signed.columns))
    maps = ones.select("doc_id", F.col("map").alias("value"))
    rows = ones.select(F.posexplode("keys").alias("at", "key"), F.col("doc_id").alias("id"), "size").select("key", "id", "size", "at")
    printed = stored(compared(print_pairs(texts, ones.select("doc_id")), texts, maps, shingle, similarity)[0].where(F.col("alike") >= similarity).select("a", "b"))
    # Most shingles are one text's alone; they move once, sorted by range, and go no further.
    rows = stored(rows.repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(with_equal_key, rows.schema))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(rows.join(shared, "key"))
    few = members.where(F.col("n") <= PAIRED).drop("n")
    other = few.select("key", *(F.col(c).alias(f"b_{c}") for c in ("id", "size", "at")))
    pairs = few.join(other, "key").where((F.col("id") < F.col("b_id")) & may_be_near(similarity)).select(F.col("id").alias("a"), F.col("b_id").alias("b")).distinct()
    crowded = members.where(F.col("n") > PAIRED)
    weight = crowded.groupBy("id").agg(F.sum("n").alias("weight"))
    centres = stored(block_centres(crowded.select("key", "id").join(weight, "id")))
    crowd = stored(crowded.select("key", "id", "size").join(centres, "key").select("centre", "id", "size").distinct())
    stars = crowd.where("id <> centre").select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    near = F.col("alike") >= similarity
    met = compared(stars, texts, maps, shingle, similarity)[0].where(near).select("a", "b")
    found = twins.union(printed).union(compared(pairs, texts, maps, shingle, similarity)[0].where(near).select("a", "b")).union(met)
    nodes = stored(connected_components(found))
    late = stored(stray_links(crowd, texts, nodes, shingle, similarity))
    if late.limit(1).count():
        nodes = connected_components(nodes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(late))
    return nodes.select(F.col("node").alias("doc"), "component"), repeated


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id for each document whose text is near another's: the smallest id reachable over near texts.

    Texts without a word, and rows without an id, are near nothing. Rows that repeat an id and its words (case and white
    space aside) are one document; where they repeat an id with other words, each text is a document, and the id has a row
    for each that is near another. Ids may be of any orderable type. No rows: no rows.
    """
    found, repeated = linked(keyed_text(df, id_col, text_col).where("doc_id IS NOT NULL"), shingle, similarity)
    return found.select("doc.doc_id", F.col("component.doc_id").alias("component_id")) if repeated else found.select(F.col("doc").alias("doc_id"), F.col("component").alias("component_id"))


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """df without the rows whose document is in a group of near texts and isn't its first one; all columns stay.

    Documents and groups are those of near_groups(); the first of a group is that of the smallest id (of several with it:
    any one). Rows of one document stay or go together; rows without an id, and texts without a word, stay.
    """
    found, repeated = linked(keyed_text(df, id_col, text_col).where("doc_id IS NOT NULL"), shingle, similarity)
    gone = stored(found.where("doc <> component").select("doc"))
    if not repeated:
        gone = gone.select(F.col("doc").alias("__gone"))
        left = perhaps(df, F.col(f"`{id_col}`"), gone)
        return surely_not(df, F.col(f"`{id_col}`"), gone).union(left.join(gone, left[f"`{id_col}`"] == gone["__gone"], "left_anti"))
    marked, gone = with_same(df, text_col), gone.select(F.col("doc.doc_id").alias("__gone"), F.col("doc.same").alias("__words"))
    return marked.join(gone, (marked[f"`{id_col}`"] == gone["__gone"]) & (marked["__same"] == gone["__words"]), "left_anti").drop("__same")
