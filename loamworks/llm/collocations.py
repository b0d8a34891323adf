"""Phrases of two to four words that stand together more often than their parts do alone.

Level by level: a phrase of k words is a pair of phrases of k - 1 words, all but its last and all but its first word; where
both are frequent (Apriori) it may be. The texts are read twice, to count words and to write them down as the numbers of
frequent words; each level reads the numbers of the last one.

1. Candidates: tasks emit the pairs they see, with counts that stop at the threshold; pairs whose sum reaches it are
   candidates, so none that is frequent is lost. Their counts aren't known yet.
2. A minimal perfect hash is built over the candidates, in shards of keys, each in a task of its own; the key of each slot is
   stored, and a pair has that slot only if it is that key. The number of a phrase is its slot.
3. Mappers write the slot of each place, and count slots with bincount in one array; arrays are cut into blocks and summed as
   a tree, eight at a time.
4. The cuts of a phrase are read by slot: those of its first and last k - 1 words, and their own.

Tables of slots reach the tasks by groups of at most GROUP_SLOTS; beyond that another pass over the numbers takes the next
group, so memory is bounded whatever the corpus holds.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import spread_join, stored

LEAST, WORDS, TOP = 30, 4, 2000
#: A candidate goes if a longer one around it has this part of its occurrences (in hundredths); the factor of scores.
COVERED, SCALE = 80, 2_000_000
SHARD_KEYS, GROUP_SLOTS, BLOCK, FAN = 1 << 18, 1 << 22, 1 << 14, 8
HELD_KEYS, HELD_WORDS = 1 << 21, 1 << 18
PIECES = re.compile(rb"[.,;:!?\x0A-\x0D]+")
BREAK = b"."


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinimalHash:
    """A bijection of distinct 64-bit keys to 0 .. n - 1.

    Each level is an array of bits, twice as many as keys are left; a key alone at its bit has it, the others go on to the
    next level. A key's slot is the number of set bits before its own.
    """

    LEVELS = 24

    def __init__(self, keys: np.ndarray):
        left, self.bits, self.before, placed, upto = keys, [], [], [], 0
        while len(left) and len(self.bits) < self.LEVELS:
            size = -(-2 * len(left) // 64) * 64
            at = self._at(left, len(self.bits), size)
            alone = np.bincount(at, minlength=size) == 1
            own = alone[at]
            self.bits.append(np.packbits(alone, bitorder="little").view(np.uint64))
            counts = np.bitwise_count(self.bits[-1]).astype(np.int64)
            self.before.append((np.cumsum(counts) - counts + upto).astype(np.int32))
            placed.append(left[own][np.argsort(at[own])])
            upto += int(own.sum())
            left = left[~own]
        self.rest = np.sort(left)
        self.keys = np.concatenate([np.zeros(0, np.uint64), *placed, self.rest])

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(keys + np.uint64((level * 2 + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where the slot's stored key is another."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.bits, self.before)):
            at = self._at(keys[left], level, 64 * len(bits))
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            has = (bits[word] >> bit) & np.uint64(1) == 1
            word, bit, found = word[has], bit[has], left[has]
            out[found] = before[word] + np.bitwise_count(bits[word] & ((np.uint64(1) << bit) - np.uint64(1)))
            left = left[~has]
        if len(self.rest) and len(left):
            out[left] = len(self.keys) - len(self.rest) + np.minimum(np.searchsorted(self.rest, keys[left]), len(self.rest) - 1)
        known = out >= 0
        out[known] = np.where(self.keys[out[known]] == keys[known], out[known], -1)
        return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(shards)).astype(np.int32)


class Table:
    """Some shards of the hashes over all candidates: shard -> (its first slot, its hash)."""

    def __init__(self, shards: int, held: dict[int, tuple[int, bytes]]):
        self.shards, self.held = shards, held
        self.loaded: dict[int, tuple[int, MinimalHash]] = {}

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys that are candidates of these shards, else -1."""
        if not self.loaded:
            self.loaded = {s: (first, pickle.loads(blob)) for s, (first, blob) in self.held.items()}
            self.held = {}
        out, of = np.full(len(keys), -1, np.int64), shard_of(keys, self.shards)
        order = np.argsort(of, kind="stable") if self.shards > 1 else np.arange(len(keys))
        ends = np.cumsum(np.bincount(of, minlength=self.shards))
        for shard, (first, hashed) in self.loaded.items():
            at = order[ends[shard - 1] if shard else 0 : ends[shard]]
            slots = hashed.slots(keys[at])
            out[at] = np.where(slots >= 0, slots + first, -1)
        return out


class Hashed:
    """The minimal perfect hashes over a table of candidates: as broadcast groups, and as rows slot, key."""

    def __init__(self, candidates: DataFrame):
        """candidates: a stored table with the column key (long), no key twice."""
        spark = candidates.sparkSession
        self.n = candidates.count()
        shards = max(1, -(-self.n // SHARD_KEYS))

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(b.column(0).to_numpy().view(np.uint64), shards)), b.column(0)], ["shard", "key"])

        def built(key: tuple, rows: pa.Table) -> pa.Table:
            hashed = MinimalHash(np.sort(rows.column("key").to_numpy().view(np.uint64)))
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(hashed.keys)], pa.int64()), "blob": pa.array([pickle.dumps(hashed)], pa.binary())})

        self.built = stored(candidates.select("key").mapInArrow(dealt, "shard int, key long").groupBy("shard").applyInArrow(built, "shard int, n long, blob binary"))
        sizes = sorted((r.shard, r.n) for r in self.built.select("shard", "n").collect())
        self.firsts, upto = {}, 0
        for shard, n in sizes:
            self.firsts[shard] = upto
            upto += n
        self.groups: list[tuple[int, int, object]] = []  # first slot, end, broadcast table
        members: list[int] = []
        for k, (shard, n) in enumerate(sizes):
            members.append(shard)
            end = self.firsts[shard] + n
            if k + 1 == len(sizes) or end + sizes[k + 1][1] - self.firsts[members[0]] > GROUP_SLOTS:
                blobs = self.built.where(F.col("shard").isin(members)).select("shard", "blob").collect()
                held = {r.shard: (self.firsts[r.shard], bytes(r.blob)) for r in blobs}
                self.groups.append((self.firsts[members[0]], end, spark.sparkContext.broadcast(Table(shards, held))))
                members = []

    def keys(self) -> DataFrame:
        """slot, key of all candidates."""
        firsts = self.firsts

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    keys = pickle.loads(blob).keys
                    yield pa.RecordBatch.from_arrays([pa.array(firsts[shard] + np.arange(len(keys))), pa.array(keys.view(np.int64))], ["slot", "key"])

        return self.built.select("shard", "blob").mapInArrow(each, "slot long, key long")


def pieces(text: str) -> list[bytes]:
    """The words of a text, BREAK between pieces."""
    return PIECES.sub(b" . ", text.encode("utf-8", "surrogatepass").lower()).split()


def word_counts(texts: DataFrame) -> DataFrame:
    """lang, word, n."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            flat = [(lang, w, n) for lang, counts in held.items() for w, n in counts.items() if w != BREAK]
            held.clear()
            lang, word, n = zip(*flat) if flat else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                held.setdefault(lang.as_py(), Counter()).update(pieces(text.as_py()))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield rows()
        yield rows()

    return texts.mapInArrow(each, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_key(salt: int, lang: str) -> Callable[[bytes], int]:
    prefix = f"{salt}\0{lang}\0".encode()
    return lambda word: xxhash.xxh64_intdigest(prefix + word, 42)


def keyed_words(counts: DataFrame) -> tuple[DataFrame, int]:
    """counts with key, a hash of lang and word that no two of them share, and the salt with which that is so."""
    n, salt = counts.count(), 0
    while True:
        # Equal to word_key(): the hash of a string with Spark's seed of 42.
        keyed = counts.withColumn("key", F.xxhash64(F.concat(F.lit(f"{salt}\0".encode()), F.col("lang").cast("binary"), F.lit(b"\0"), F.col("word"))))
        if keyed.select("key").distinct().count() == n:
            return keyed, salt
        salt += 1


def closed(ids: np.ndarray) -> np.ndarray:
    """Of several -1 in a row one."""
    return ids[np.r_[True, (ids[1:] >= 0) | (ids[:-1] >= 0)]] if len(ids) else ids


def word_stream(texts: DataFrame, hashed: Hashed, salt: int) -> DataFrame:
    """ids (32 bits each): the slots of words in order, -1 between pieces and for words that aren't candidates."""

    def lookup(group, first: bool):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, known = group.value, {}
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part, out = batch.slice(at, 256), []
                    if sum(map(len, known.values())) > HELD_WORDS:
                        known.clear()
                    several = list(map(pieces, part.column(1).to_pylist()))
                    langs = part.column(0).to_pylist()
                    for lang in set(langs):
                        have, key = known.setdefault(lang, {BREAK: -1}), word_key(salt, lang)
                        new = [w for w in set().union(*(ws for x, ws in zip(langs, several) if x == lang)) if w not in have]
                        keys = np.fromiter(map(key, new), np.uint64, len(new))
                        have.update(zip(new, table.slots(keys).tolist()))
                    for lang, words in zip(langs, several):
                        out += [np.fromiter(map(known[lang].__getitem__, words), np.int32, len(words)), np.full(1, -1, np.int32)]
                    ids = np.concatenate([np.zeros(0, np.int32), *out])
                    yield pa.RecordBatch.from_arrays([pa.array([(closed(ids) if first else ids).tobytes()], pa.binary())], ["ids"])

        return each

    if len(hashed.groups) == 1:
        return stored(texts.mapInArrow(lookup(hashed.groups[0][2], True), "ids binary"), codec="zstd")

    # More words than one table: the words' keys are written once, then looked up group by group.
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for lang, text in zip(batch.column(0)[at : at + 256].to_pylist(), batch.column(1)[at : at + 256].to_pylist()):
                    key, words = word_key(salt, lang), pieces(text)
                    of = {w: key(w) for w in set(words)}
                    out += [np.fromiter(map(of.__getitem__, words), np.uint64, len(words)), np.zeros(1, np.uint64)]
                    out[-2][[w == BREAK for w in words]] = 0
                out = np.concatenate([np.zeros(0, np.uint64), *out])
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([np.full(len(out), -1, np.int32).tobytes()], pa.binary())], ["keys", "ids"])

    return found_by_groups(texts.mapInArrow(keys, "keys binary, ids binary"), hashed)


def found_by_groups(rows: DataFrame, hashed: Hashed) -> DataFrame:
    """ids: of keys (64 bits each; 0: none) the slots, one pass a group."""

    def lookup(group):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for keys, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    keys, ids = np.frombuffer(keys, np.uint64), np.frombuffer(ids, np.int32)
                    slots = np.where(keys != 0, group.value.slots(keys), -1)
                    out.append(np.where(slots >= 0, slots, ids).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["keys", "ids"])

        return each

    for _, _, group in hashed.groups:
        rows = stored(rows.mapInArrow(lookup(group), "keys binary, ids binary"), codec="zstd")
    return rows.select("ids")


def pair_keys(ids: np.ndarray) -> np.ndarray:
    """Of each place the key of the phrases there and one place on; 0 where one of them isn't (slots count from 1 in keys)."""
    a, b = ids[:-1], ids[1:]
    return np.where((a >= 0) & (b >= 0), (a.astype(np.uint64) + np.uint64(1)) << np.uint64(32) | (b.astype(np.uint64) + np.uint64(1)), np.uint64(0))


def candidates(stream: DataFrame, least: int) -> DataFrame:
    """key: pairs of neighbouring phrases that stand `least` times or more. Counts stop at `least` in each task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def rows() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.minimum(times, least).astype(np.int32))], ["key", "seen"])

        for batch in batches:
            for ids in batch.column(0).to_pylist():
                keys = pair_keys(np.frombuffer(ids, np.int32))
                held.append(keys[keys != 0])
                n += len(held[-1])
                if n > HELD_KEYS:
                    yield rows()
                    n = 0
        yield rows()

    seen = stream.mapInArrow(each, "key long, seen int").groupBy("key").agg(F.sum("seen").alias("seen"))
    return stored(seen.where(F.col("seen") >= least).select("key"))


def pair_stream(stream: DataFrame, hashed: Hashed) -> DataFrame:
    """ids: the slots of pairs of neighbours, -1 where they are no candidate."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = hashed_group.value
        for batch in batches:
            out = []
            for ids in batch.column(0).to_pylist():
                keys = pair_keys(np.frombuffer(ids, np.int32))
                slots, at = np.full(len(keys), -1, np.int32), np.nonzero(keys)[0]
                slots[at] = table.slots(keys[at])
                out.append(closed(slots).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [pair_keys(np.frombuffer(ids, np.int32)) for ids in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in out], pa.binary()), pa.array([np.full(len(k), -1, np.int32).tobytes() for k in out], pa.binary())], ["keys", "ids"])

    if len(hashed.groups) == 1:
        hashed_group = hashed.groups[0][2]
        return stored(stream.mapInArrow(each, "ids binary"), codec="zstd")
    return found_by_groups(stream.mapInArrow(keys, "keys binary, ids binary"), hashed)


def tree_sum(blocks: DataFrame, parts: int) -> DataFrame:
    """block, counts: the sums of blocks (block, part, counts: 64 bits each), FAN parts at a time."""

    def each(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in rows.column("counts").to_pylist())
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    while parts > 1:
        blocks = blocks.withColumn("part", F.expr(f"cast(part div {FAN} as int)")).groupBy("block", "part").applyInArrow(each, "block long, part int, counts binary")
        parts = -(-parts // FAN)
    return blocks.select("block", "counts")


def slot_counts(stream: DataFrame, hashed: Hashed) -> DataFrame:
    """slot, n: how often each slot stands in the stream."""

    def counted(first: int, end: int):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = -(-(end - first) // BLOCK) * BLOCK
            total = np.zeros(size, np.int64)
            for batch in batches:
                ids = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32) for x in batch.column(0).to_pylist())])
                ids = ids[(ids >= first) & (ids < end)] - first
                if len(ids) * 8 > size:
                    total += np.bincount(ids, minlength=size)
                else:
                    np.add.at(total, ids, 1)
            part = TaskContext.get().partitionId()
            for at in range(0, size, BLOCK):
                if total[at : at + BLOCK].any():
                    yield pa.RecordBatch.from_arrays([pa.array([first + at], pa.int64()), pa.array([part], pa.int32()), pa.array([total[at : at + BLOCK].tobytes()], pa.binary())], ["block", "part", "counts"])

        return each

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts = np.frombuffer(counts, np.int64)
                at = np.nonzero(counts)[0]
                yield pa.RecordBatch.from_arrays([pa.array(first + at), pa.array(counts[at])], ["slot", "n"])

    out, parts = None, stream.rdd.getNumPartitions()
    for first, end, _ in hashed.groups:
        rows = tree_sum(stream.mapInArrow(counted(first, end), "block long, part int, counts binary"), parts).mapInArrow(spread, "slot long, n long")
        out = rows if out is None else out.union(rows)
    return out


def longer(pairs: DataFrame, below: DataFrame) -> DataFrame:
    """Phrases one word longer than those below: slot, lang, phrase, n, first and last word, heads and tails (counts of the
    first and last 1, 2, ... words), before and after (slots of all but the last, all but the first word)."""
    pairs = pairs.withColumn("before", F.shiftrightunsigned("key", 32) - 1).withColumn("after", F.col("key").bitwiseAND(0xFFFFFFFF) - 1).drop("key")
    left = below.select(F.col("slot").alias("before"), "lang", "phrase", "heads")
    right = below.select(F.col("slot").alias("after"), "last", "tails")
    met = spread_join(stored(spread_join(pairs, left, "before")), right, "after")
    return stored(
        met.select(
            "slot", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "n", "last",
            F.concat("heads", F.array("n")).alias("heads"), F.concat("tails", F.array("n")).alias("tails"), "before", "after",
        )
    )


def collocations(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, words: int = WORDS, top: int = TOP, covered: int = COVERED, scale: int = SCALE
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `top` phrases by score, then a, then the phrase's bytes.

    Texts are lower-cased (A-Z), split into pieces at punctuation and line ends, and these into words at spaces and tabs. A
    candidate is a phrase of 2 to `words` words of one piece with a, all its occurrences, `least` or more. Each cut of it into
    two gives l and r, the occurrences of its parts, and the score floor(scale * a / (l + r)), exact at any size; the least
    score counts, of equal ones that with the shorter first part. Candidates inside a longer one that has `covered` hundredths
    of their occurrences are left out. n: all words of the language. A null text is empty, a null language `und`. No texts, or
    no candidates: an empty table. Repeated rows count as often as they stand; other columns don't matter.
    """
    if words < 2 or least < 1:
        raise ValueError("phrases have two words at least, and stand once at least")
    texts = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    spark = df.sparkSession
    counts, salt = keyed_words(stored(word_counts(texts)))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("words"))
    frequent = stored(counts.where(F.col("n") >= least))
    hashed, levels = Hashed(frequent), []
    if hashed.n:
        word = F.col("word").cast("string")
        below = hashed.keys().join(frequent, "key").select("slot", "lang", word.alias("phrase"), "n", word.alias("last"), F.array("n").alias("heads"), F.array("n").alias("tails"))
        below, stream = stored(below), word_stream(texts, hashed, salt)
        for _ in range(2, words + 1):
            hashed = Hashed(candidates(stream, least))
            if not hashed.n:
                break
            stream = pair_stream(stream, hashed)
            below = longer(hashed.keys().join(slot_counts(stream, hashed), "slot"), below)
            levels.append(below)
    if not levels:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    kept = []
    for k, level in enumerate(levels):
        if k + 1 < len(levels):  # one word longer is enough: what a still longer one covers, that between covers too
            up = levels[k + 1].select(F.explode(F.array("before", "after")).alias("slot"), F.col("n").alias("most")).groupBy("slot").agg(F.max("most").alias("most"))
            level = level.join(up, "slot", "left").where(F.col("most").isNull() | (F.col("most").cast("decimal(38,0)") * 100 < F.col("n").cast("decimal(38,0)") * covered))
        kept.append(level.select("lang", "phrase", "n", "heads", "tails"))
    rows = kept[0]
    for level in kept[1:]:
        rows = rows.union(level)
    score = f"cast({scale} as decimal(20,0)) * cast(n as decimal(18,0)) div cast(heads[c - 1] + tails[size(heads) - c - 1] as decimal(20,0))"
    cuts = F.expr(f"array_min(transform(sequence(1, size(heads) - 1), c -> struct({score} as score, c as cut)))")
    scored = rows.withColumn("best", cuts).select(
        "lang", "phrase", F.col("n").alias("a"), F.expr("heads[best.cut - 1]").alias("l"), F.expr("tails[size(heads) - best.cut - 1]").alias("r"), F.col("best.score").cast("long").alias("score")
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # The first `top` of each part of a language, then of these the first.
    parts = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
