"""Vector best-fit packing of documents into sequences.

A piece demands tokens, one place and attention (its length squared); a sequence has a capacity of each. Pieces of one
length are alike, and so are sequences filled alike. So best fit works on counts: longest pieces first, each goes where
it fits under every capacity and leaves the residual of least weighted norm (or has the largest weighted dot product
with what is free), for all sequences filled alike in one step. What the driver plans with is a count for each length,
at most as many as a sequence has tokens, however many documents there are. The plan comes back as ranges of ranks: the
r-th piece of a length has a sequence and an offset. Ranks are counted in salted groups, so that a length which many
pieces have is shared out.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import byte_characters
from .common import bounded_batches, by_slices, keyed_text, stored

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts go through the tokenizers library itself: the faster encoder's pattern can't backtrack so far.
LONG = 400_000
LEAST_SALTS = 64


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds: tokens, documents (places) and attention (the sum of the pieces' squared lengths).

    By default the last two can't be smaller without more sequences: as many places as tokens, for corpora of empty texts,
    and attention for one whole piece. Their residuals select sequences all the same.
    """

    tokens: int = 1024
    places: int = 1024
    attention: int = 1024 * 1024
    #: Weights of the three residuals, each measured as a share of its capacity.
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0)
    #: "norm": least weighted norm of the residual; "dot": largest weighted dot product of demand and what is free.
    rule: str = "norm"


class ByteBpe:
    """Ids as the tokenizers library has them for a byte-level vocabulary file, special tokens in a text included."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        back = {c: b for b, c in enumerate(byte_characters())}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.own = Tokenizer.from_str(vocabulary)
        self.own.no_padding()
        self.own.no_truncation()

    def encode(self, text: str) -> np.ndarray:
        if len(text) > LONG:
            return np.array(self.own.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32, copy=False)


_BUILT: dict[int, ByteBpe] = {}


def _coder(vocabulary) -> ByteBpe:
    key = hash(vocabulary.value)
    if key not in _BUILT:
        _BUILT[key] = ByteBpe(vocabulary.value)
    return _BUILT[key]


def pieces(df: DataFrame, path: str, size: int = 1024, end: int | None = 2, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and with ids: ids): each document's tokens and the end token, cut at most.

    Only documents of more than `size` tokens are cut, into pieces of that size; the first is shorter if need be. A null
    text is empty: the end token alone, or without one no piece. Repeated rows are documents of their own.
    """
    with open(path, encoding="utf-8") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = _coder(vocabulary)
        of, piece, start, length, crc, lists = [], [], [], [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            tokens = coder.encode(text)
            tokens = tokens if end is None else np.append(tokens, np.uint32(end))
            first = len(tokens) % size
            edges = [*([0] * bool(first)), *range(first, len(tokens) + 1, size)]
            data = tokens.astype("<u4").tobytes()
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                of.append(row)
                piece.append(k)
                start.append(a)
                length.append(b - a)
                crc.append(zlib.crc32(data[4 * a : 4 * b]))
                if ids:
                    lists.append(tokens[a:b].tolist())
        arrays = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        arrays += [pa.array(lists, pa.list_(pa.int32()))] if ids else []
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    read = keyed_text(df, id_col, text_col)
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(by_slices(each), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids)


class _Bins:
    """Sequences filled alike, as rows of arrays: how many, what is free, and the runs of pieces they hold."""

    def __init__(self, capacity: Capacity):
        self.whole = np.array([capacity.tokens, capacity.places, capacity.attention], np.float64)
        self.weights, self.rule = np.array(capacity.weights), capacity.rule
        self.free = np.zeros((0, 3))
        self.many: list[int] = []
        self.held: list[tuple[tuple[int, int], ...]] = []
        self.closed: list[tuple[int, tuple[tuple[int, int], ...]]] = []

    def best(self, demand: np.ndarray) -> int | None:
        fits = np.flatnonzero((self.free >= demand).all(1))
        if not len(fits):
            return None
        free = self.free[fits] / self.whole
        if self.rule == "dot":
            score = -(free * (demand / self.whole) * self.weights).sum(1)
        else:
            score = (self.weights * (free - demand / self.whole) ** 2).sum(1)
        return int(fits[np.argmin(score)])

    def add(self, many: int, free: np.ndarray, held: tuple[tuple[int, int], ...]) -> None:
        if many:
            self.free = np.vstack([self.free, free])
            self.many.append(many)
            self.held.append(held)

    def take(self, i: int) -> tuple[int, np.ndarray, tuple[tuple[int, int], ...]]:
        row = self.many.pop(i), self.free[i], self.held.pop(i)
        self.free = np.delete(self.free, i, 0)
        return row

    def close(self, least: np.ndarray) -> None:
        """Put away what can't take the smallest demand that is still to come."""
        for i in np.flatnonzero(~(self.free >= least).all(1))[::-1]:
            many, _, held = self.take(int(i))
            self.closed.append((many, held))


def plan(counts: dict[int, int], capacity: Capacity) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """How many sequences hold which (length, copies), for so many pieces of each length."""
    bins = _Bins(capacity)
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    for at, length in enumerate(lengths):
        demand, left = np.array([length, 1, length * length], np.float64), counts[length]
        if (demand > bins.whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacity")
        while left:
            i = bins.best(demand)
            many, free, held = (left, bins.whole, ()) if i is None else bins.take(i)
            # With the norm a sequence just added to is the tightest, so it takes copies as long as they fit.
            copies = int(min(left, (free // demand).min())) if bins.rule == "norm" else 1
            full = min(many, left // copies)
            bins.add(full, free - copies * demand, (*held, (length, copies)))
            left, rest = left - full * copies, many - full
            if left and rest and left < copies:
                bins.add(1, free - left * demand, (*held, (length, left)))
                left, rest = 0, rest - 1
            if i is not None:
                bins.add(rest, free, held)
        shorter = lengths[at + 1] if at + 1 < len(lengths) else None
        least = bins.whole + 1 if shorter is None else np.array([lengths[-1], 1, lengths[-1] ** 2], np.float64)
        bins.close(least)
    return bins.closed


RANGES = "length long, from_rank long, to_rank long, copies long, first_sequence long, first_offset long"


def ranges(planned: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """For each length the ranges of ranks that the planned sequences take, in the columns of RANGES."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for many, held in planned:
        offset = 0
        for length, copies in held:
            at = used.get(length, 0)
            used[length] = at + many * copies
            out.append((length, at, used[length], copies, sequence, offset))
            offset += length * copies
        sequence += many
    return out


def place(cut: DataFrame, capacity: Capacity) -> DataFrame:
    """The pieces with sequence_id and offset. cut: what pieces() returns, stored (it is read more than once).

    Repeated rows each get a place; no pieces: no rows. A piece that no sequence can hold raises ValueError.
    """
    spark = cut.sparkSession
    salts = max(LEAST_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = stored(cut.groupBy("length", "salt").agg(F.count("*").alias("n")))
    # At most as many rows as a sequence has tokens come to the driver.
    by_length = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    planned = spark.createDataFrame(ranges(plan(by_length, capacity)), RANGES)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("at", F.row_number().over(within) - 1).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("at"))
    # The ranges are some thousands, as there are that few ways to fill sequences alike.
    r = F.broadcast(planned)
    found = ranked.join(r, (ranked["length"] == r["length"]) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))).drop(r["length"])
    local = F.col("rank") - F.col("from_rank")
    return found.select(
        *(c for c in cut.columns if c != "salt"),
        (F.col("first_sequence") + F.floor(local / F.col("copies"))).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(local, F.col("copies")) * F.col("length")).alias("offset"),
    )


def pack(df: DataFrame, path: str, capacity: Capacity = Capacity(), end: int | None = 2, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """The pieces of all documents, as pieces() has them, with sequence_id and offset (gapless from 0 in each sequence)."""
    bounded_batches(df.sparkSession)
    return place(stored(pieces(df, path, capacity.tokens, end, id_col, text_col, ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, lengths of each sequence; packed: pieces with their ids."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids", "doc_id", "length"))).alias("p"))
    return held.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
