"""Repeated passages through a sparse suffix array.

Of each text only the suffixes at minimisers are retained: places whose run of SEED words has the least hash among
neighbouring runs, so the content selects them, and any two passages alike in `least` words retain the same place. A retained
suffix is known by a run of words that spans its place and half of what a passage has left, to the right or to the left (one
of the two lies inside the passage). All suffixes are sorted as suffixes are, by their first word, then the second, the next
two, the next four and the rest of the run (words in an order of their own, that of their hashes), by range, so that those
which very many texts share are spread over tasks, and neighbours are compared. Suffixes that are as a neighbour are extended to the left and
right: each of the places where `least` words that hold the run can begin is compared with the same place of the suffixes
of smaller documents. So a document has every passage of `least` words that a smaller one has, whoever else shares a part.
Runs and passages are known by independent 64-bit hashes of their words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, by_slices, dropped, keyed_text, stored

#: Words of the run whose hash selects a place.
SEED = 16
LEAST = 50
WORD = re.compile(SPACE.replace("[", "[^") + "+")
#: Odd, so that it has an inverse among 64-bit numbers.
FACTOR = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(FACTOR, -1, 1 << 64)


def powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[0:1] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser, so that runs are ordered at random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Runs:
    """Hashes of any runs of a text's words, by prefix sums of powers; of two kinds, which are independent."""

    up, down = powers(FACTOR, 1 << 12), powers(INVERSE, 1 << 12)

    def __init__(self, words: list[bytes]):
        n = len(words)
        if len(Runs.up) <= n:
            Runs.up, Runs.down = powers(FACTOR, 2 * n + 1), powers(INVERSE, 2 * n + 1)
        digest = xxhash.xxh64_intdigest
        each = np.fromiter((digest(w, 0) for w in words), np.uint64, n)
        self.sums = [np.r_[np.uint64(0), np.add.accumulate(x * Runs.up[:n])] for x in (each, mixed(each))]

    def of(self, start: np.ndarray, end: np.ndarray, kind: int = 0) -> np.ndarray:
        return mixed((self.sums[kind][end] - self.sums[kind][start]) * Runs.down[start])


def run_words(least: int, seed: int) -> int:
    """Words of the run by which a suffix is known."""
    return seed + (least - seed + 1) // 2


def retained(words: list[bytes], least: int = LEAST, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, start (in words) and order of the suffixes kept of a text: two runs of words for each minimiser at most."""
    n, window = len(words), least - seed + 1
    if n < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    runs = Runs(words)
    at = np.arange(n - seed + 1)
    hashes = runs.of(at, at + seed)
    chosen = []
    for a in range(0, len(hashes) - window + 1, 1 << 14):  # in steps, for very long texts
        view = np.lib.stride_tricks.sliding_window_view(hashes[a : a + (1 << 14) + window - 1], window)
        chosen.append(np.unique(view.argmin(1) + np.arange(len(view))) + a)
    places, run = np.unique(np.concatenate(chosen)), run_words(least, seed)
    starts = np.unique(np.r_[places, places - (run - seed)])
    starts = starts[(starts >= 0) & (starts + run <= n)]
    return runs.of(starts, starts + run).view(np.int64), starts.astype(np.int32), suffix_order(runs, starts, run)


def suffix_order(runs: Runs, starts: np.ndarray, run: int) -> np.ndarray:
    """64 bits by which suffixes are in order: 16 each of the hashes of word 1, word 2, words 3 and 4, words 5 to 8."""
    order = np.zeros(len(starts), np.uint64)
    for a, b in ((0, 1), (1, 2), (2, 4), (4, 8)):
        order = order << np.uint64(16) | runs.of(starts + min(a, run), starts + min(b, run)) >> np.uint64(48)
    return (order ^ np.uint64(1 << 63)).view(np.int64)


def suffixes(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """key, doc, start, order of every retained suffix."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [retained(t.encode().split(), least, seed) for t in batch.column(1).to_pylist()]
        of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        cat = lambda k, kind: np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind)
        return pa.RecordBatch.from_arrays([pa.array(cat(0, np.int64)), batch.column(0).take(pa.array(of)), pa.array(cat(1, np.int32)), pa.array(cat(2, np.int64))], ["key", "doc", "start", "order"])

    return texts.mapInArrow(by_slices(each), f"key long, doc {kind_of(texts)}, start int, order long")


def kind_of(texts: DataFrame) -> str:
    return texts.schema["doc"].dataType.simpleString()


def with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, start of a task's sorted suffixes that have a neighbour's key; the task's first and last, too, as their
    neighbours may be in other tasks."""
    held = None  # the last row so far, and whether it has gone out
    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        out = np.r_[False, same] | np.r_[same, False]
        if held is None:
            out[0] = True
        elif held[0] == key[0]:
            out[0] = True
            if not held[1]:
                yield held[2]
        yield batch.filter(pa.array(out)).select([1, 2])
        held = int(key[-1]), bool(out[-1]), batch.slice(len(key) - 1).select([1, 2])
    if held and not held[1]:
        yield held[2]


def repeated_suffixes(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """doc, start of the suffixes whose run another suffix has (and a few others, at the ends of tasks)."""
    kept, order = stored(suffixes(texts, least, seed)), ["order", "key", "doc", "start"]
    ranged = kept.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ranged.select("key", "doc", "start").mapInArrow(with_neighbours, f"doc {kind_of(texts)}, start int"))
    dropped(texts.sparkSession, kept)
    return found


def surroundings(words: list[bytes], starts: np.ndarray, least: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the suffixes that start there, and of each the hashes of the `least` words that begin at the run's start or up
    to so many words before it that they still hold the run (0: where the text has no such words)."""
    runs, run = Runs(words), run_words(least, seed)
    begin = starts[:, None] - np.arange(least - run, -1, -1)
    inside = (begin >= 0) & (begin + least <= len(words))
    begin = np.where(inside, begin, 0)
    return runs.of(starts, starts + run), np.where(inside, runs.of(begin, begin + least, 1) | np.uint64(1), np.uint64(0))


def extended(found: DataFrame, texts: DataFrame, least: int, seed: int) -> DataFrame:
    """key, doc, start, around (surroundings(), 64 bits each) of these suffixes."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, keys, at, around = [], [], [], []
        for i, (text, starts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            starts = np.unique(np.array(starts, np.int64))
            key, hashes = surroundings(text.encode().split(), starts, least, seed)
            data, width = hashes.astype("<u8").tobytes(), 8 * hashes.shape[1]
            of += [i] * len(starts)
            keys.append(key.view(np.int64))
            at.append(starts.astype(np.int32))
            around += [data[k : k + width] for k in range(0, len(data), width)]
        cat = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        return pa.RecordBatch.from_arrays([pa.array(cat(keys, np.int64)), batch.column(0).take(pa.array(of, pa.int64())), pa.array(cat(at, np.int32)), pa.array(around, pa.binary())], ["key", "doc", "start", "around"])

    places = found.groupBy("doc").agg(F.collect_list("start").alias("starts"))
    return texts.join(places, "doc").select("doc", "text", "starts").mapInArrow(by_slices(each), f"key long, doc {kind_of(texts)}, start int, around binary")


def matched(least: int, shift: int):
    """A function for mapInArrow over sorted suffixes (key, doc, start, around): the words [start, end) of row that other
    has too; repeat: other is smaller. Of the first and last key of a task, which others may go on with, also each hash's
    smallest document (key, hash, other; start: where its words begin). shift: words before a run where `around` begins."""

    def stretches(begins: list[tuple[int, object]]) -> Iterator[tuple[int, int, object]]:
        """Of places in order, each with the document that has its words, those that follow one another as one."""
        at = 0
        for i in range(1, len(begins) + 1):
            if i == len(begins) or begins[i][0] != begins[i - 1][0] + 1 or begins[i][1] != begins[at][1]:
                yield begins[at][0], begins[i - 1][0] + least, begins[at][1]
                at = i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, smallest, answered, ends = None, None, {}, {}, []
        for batch in batches:
            rows: list[tuple] = []
            for k, doc, start, around in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if k != key:
                    rows += [(y, a, b, x, False, None, None) for y, places in answered.values() for a, b, x in stretches(sorted(places.items()))]
                    if key is not None and key == first:
                        ends.append((key, smallest))
                    first = k if first is None else first
                    key, smallest, answered = k, {}, {}
                mine = []
                for place, h in enumerate(np.frombuffer(around, "<u8").tolist(), start - shift):
                    if not h:
                        continue
                    y = smallest.setdefault(h, (doc, place))
                    if y[0] != doc:
                        mine.append((place, y[0]))
                        answered.setdefault(str(y[0]), (y[0], {}))[1].setdefault(y[1], doc)
                rows += [(doc, a, b, x, True, None, None) for a, b, x in stretches(mine)]
            yield batch_of(rows, batch.schema.field(1).type)
            kind = batch.schema.field(1).type
        if key is not None:
            rows = [(y, a, b, x, False, None, None) for y, places in answered.values() for a, b, x in stretches(sorted(places.items()))]
            for k, held in [*ends, (key, smallest)]:
                rows += [(None, place, None, doc, None, k, h - (1 << 64) if h >> 63 else h) for h, (doc, place) in held.items()]
            yield batch_of(rows, kind)

    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        types = [kind, pa.int32(), pa.int32(), kind, pa.bool_(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 7, types)], ["row", "start", "end", "other", "repeat", "key", "hash"])

    return run


def stretches_of(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """row, other, start, end, repeat: words of row that other has too; repeat: other is smaller."""
    around = extended(repeated_suffixes(texts, least, seed), texts, least, seed)
    order, kind = ["key", "doc", "start"], kind_of(texts)
    ranged = around.repartitionByRange(*order).sortWithinPartitions(*order)
    found = stored(ranged.mapInArrow(matched(least, least - run_words(least, seed)), f"row {kind}, start int, end int, other {kind}, repeat boolean, key long, hash long"))
    # Keys that go on in the next task: what each task had as the smallest meets the smallest of all.
    ends = found.where("key IS NOT NULL").select("key", "hash", F.col("other").alias("row"), "start")
    whole = ends.groupBy("key", "hash").agg(F.min("row").alias("least"), F.max("row").alias("most")).where("least <> most")
    across = ends.join(whole, ["key", "hash"]).select("row", F.when(F.col("row") == F.col("least"), F.col("most")).otherwise(F.col("least")).alias("other"), "start", (F.col("start") + least).alias("end"), (F.col("row") != F.col("least")).alias("repeat"))
    return found.where("key IS NULL").select("row", "other", "start", "end", "repeat").union(across)


def with_characters(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """spans (row, other, start, end, repeat) with the code points where their words start and end.

    A document's spans are one row, so its text meets them once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = pa.RecordBatch.from_struct_array(batch.column(2).slice(k, 1).flatten())
                places = np.array([m.span() for m in WORD.finditer(batch.column(1)[k].as_py())], np.int32)
                start, end = found.column("start").to_numpy(), found.column("end").to_numpy()
                row = batch.column(0).take(pa.array(np.full(len(start), k)))
                columns = [row, found.column("other"), found.column("start"), found.column("end"), found.column("repeat"), pa.array(places[start, 0]), pa.array(places[end - 1, 1])]
                yield pa.RecordBatch.from_arrays(columns, ["row", "other", "start", "end", "repeat", "start_char", "end_char"])

    kind = kind_of(texts)
    listed = spans.groupBy("row").agg(F.collect_list(F.struct("other", "start", "end", "repeat")).alias("spans"))
    met = listed.join(texts.select(F.col("doc").alias("row"), "text"), "row").select("row", "text", "spans")
    return met.mapInArrow(run, f"row {kind}, other {kind}, start int, end int, repeat boolean, start_char int, end_char int")


def joined_spans(spans: DataFrame, by: list[str], overlap: int = 0) -> DataFrame:
    """Spans of the same columns `by` that overlap in so many words or more (0: or touch) as one."""
    spans = spans.select(*by, "start", "end").distinct()
    window = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(window.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce((F.col("start") > before - overlap).cast("int"), F.lit(1)))
    islands = marked.withColumn("island", F.sum("new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def documents_of(df: DataFrame, id_col: str, text_col: str, least: int) -> tuple[DataFrame, bool]:
    """doc, text of the texts that may hold a passage; whether a document is more than its id.

    Where ids are null or repeat, a document is an id and a text (known by a hash), those without an id last.
    """
    texts = keyed_text(df, id_col, text_col).where(F.length("text") >= 2 * least - 1)
    plain = texts.where("doc_id IS NULL").isEmpty() and texts.groupBy("doc_id").count().where("count > 1").isEmpty()
    if plain:
        return texts.select(F.col("doc_id").alias("doc"), "text"), False
    several = texts.select(document(F.col("doc_id"), F.col("text")).alias("doc"), "text")
    return several.groupBy("doc").agg(F.first("text").alias("text")), True


def document(id: Column, text: Column) -> Column:
    return F.struct(id.isNull().alias("none"), id.alias("doc_id"), F.xxhash64(text).alias("hash"))


def passages(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """row, start, end, start_char, end_char, other, repeat; row and other are documents (doc of texts)."""
    return with_characters(joined_spans(stretches_of(texts, least, seed), ["row", "other", "repeat"], least - 1), texts)


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id, start, end (words), start_char, end_char (code points), other_doc_id, repeat: passages of at least `least`
    words that stand in another document too, one row for each document that a passage is shared with.

    repeat: other_doc_id, a smaller id, has every stretch of `least` words of it, so it may go; else a greater one has them.
    Of the documents that have a stretch, that of the smallest id is the other one of all others, and one of these is its
    own; so each document but the smallest has its whole share in rows with repeat, and the smallest has rows without.
    Stretches that begin at one word after the other in a document, and are shared with the same other one, are one row, also
    where that one has them apart; rows may overlap. Words are what white space separates, compared as they are.
    Null and short texts have none. Ids may be of any orderable type. Rows that repeat an id and a text are one document;
    other texts of the same id are documents of their own, and so are texts without an id, which come last.
    """
    texts, several = documents_of(df, id_col, text_col, least)
    found = passages(texts, least, seed)
    name = lambda c: F.col(f"{c}.doc_id") if several else F.col(c)
    return found.select(name("row").alias("doc_id"), "start", "end", "start_char", "end_char", name("other").alias("other_doc_id"), "repeat")


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """df with the passages that a smaller document has cut out of its texts; all rows and other columns stay.

    Where ids are null or repeat, a row's own text decides what is cut from it; rows equal in both are cut alike.
    """
    texts, several = documents_of(df, id_col, text_col, least)
    found = passages(texts, least, SEED).where("repeat")
    found = joined_spans(found.select("row", F.col("start_char").alias("start"), F.col("end_char").alias("end")), ["row"]).select("row", F.col("start").alias("start_char"), F.col("end").alias("end_char"))
    cuts = found.groupBy(F.col("row").alias("__of")).agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias("__cuts"))
    text = F.col(f"`{text_col}`")
    # What stands between the cuts: from each one's end (first: the text's start) to the next one's start.
    ends = F.concat(F.array(F.lit(0)), F.transform("__cuts", lambda c: c["end_char"]))
    starts = F.concat(F.transform("__cuts", lambda c: c["start_char"]), F.array(F.length(text)))
    left = F.array_join(F.transform(F.arrays_zip(ends.alias("e"), starts.alias("s")), lambda p: F.substring(text, p["e"] + 1, p["s"] - p["e"])), "")
    own = F.col(f"`{id_col}`")
    joined = df.join(cuts, document(own, F.coalesce(text, F.lit(""))) == F.col("__of") if several else own == F.col("__of"), "left")
    return joined.select(*(F.when(F.col("__cuts").isNotNull(), left).otherwise(text).alias(text_col) if c == text_col else df[f"`{c}`"] for c in df.columns))
