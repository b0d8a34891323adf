"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters' n-grams (one to three, word ends marked) are hashed into buckets; a text's value of a bucket is its share of
the text's n-grams times the inverse document frequency, which is counted over every document that may be learnt from.
Weights come from follow-the-regularised-leader with elastic-net penalties over a bounded sample for each language;
a temperature fitted to rows left out of that calibrates the probabilities. Values are linear in words, so a worker
scores each word once and adds.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, by_slices, keyed_text

#: Sample for each language, at most, and the longest text in it (bytes): bounds of what the driver holds.
PER_LANGUAGE = 1200
LONGEST = 100_000
#: Buckets that n-grams are hashed into, as a power of two.
BITS = 14
BUCKETS = 1 << BITS
FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Makes shares of n-grams into values of about one.
SCALE = 100.0
#: Runs of letters, and of numbers such as superscripts or Roman numerals, at which Words cuts them.
WORD = re.compile(r"[^\W\d_]+")
STORE_WORDS = 200_000
UNDETERMINED = "und"


def buckets_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words' n-grams, word by word, and how many each word has."""
    code = np.frombuffer("".join(f"_{w}_" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(code))  # characters of the word from here on
    hashes, x = np.empty((len(code), 3), np.uint64), np.zeros(len(code), np.uint64)
    for n in range(3):
        x[: len(code) - n] = x[: len(code) - n] * FACTOR + code[n:] + np.uint64(1)
        hashes[:, n] = x
    hashes = (hashes ^ (hashes >> np.uint64(31))) * FACTOR
    inside = left[:, None] > np.arange(3)
    return (hashes >> np.uint64(64 - BITS))[inside].astype("<u2"), 3 * lengths - 3


def grams(words: list[str]) -> list[bytes]:
    """The buckets of each word's n-grams, as bytes of 16-bit numbers."""
    buckets, counts = buckets_of(words)
    data, ends = buckets.tobytes(), (2 * np.cumsum(counts)).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class Words:
    """The runs of letters of texts, lower-cased, and a bounded store of what make() says of each."""

    def __init__(self, make: Callable[[list[str]], list[bytes]]):
        self.known: dict[str, bytes] = {}
        self.make = make

    def of(self, texts: list[str]) -> list[list[str]]:
        if len(self.known) > STORE_WORDS:
            self.known = {}
        lists = [WORD.findall(t.lower()) for t in texts]
        new = set().union(*lists).difference(self.known)
        if odd := {w for w in new if not w.isalpha()}:
            parts = lambda w: "".join(c if c.isalpha() else " " for c in w).split()
            lists = [words if odd.isdisjoint(words) else [x for w in words for x in parts(w)] for words in lists]
            new = set().union(*lists).difference(self.known)
        if new:
            self.known.update(zip(new, self.make(list(new))))
        return lists

    def joined(self, words: Iterable[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, words))


def document_frequency(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and of each bucket the documents that have it. texts: one column; every row counts.

    Each task sends a count for each bucket, which are summed by bucket: what the driver gets has the buckets' number.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, seen, rows = Words(grams), np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for words in store.of([t or "" for t in batch.slice(at, SLICE_ROWS).column(0).to_pylist()]):
                    there = np.zeros(BUCKETS, bool)
                    there[np.frombuffer(store.joined(set(words)), "<u2")] = True
                    seen += there
                    rows += 1
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[used, -1], pa.int32()), pa.array(np.r_[seen[used], rows], pa.int64())], ["bucket", "n"])

    sums = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total, seen = 0, np.zeros(BUCKETS, np.int64)
    for r in sums:
        if r.bucket < 0:
            total = r.n
        else:
            seen[r.bucket] = r.n
    return total, seen


@dataclass
class Model:
    """languages; weights (buckets by languages, inverse document frequency included); bias; temperature."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, languages=np.array(self.languages, dtype=str), weights=self.weights.astype(np.float32), bias=self.bias, temperature=self.temperature)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        f = np.load(io.BytesIO(data))
        return Model(f["languages"].tolist(), f["weights"], f["bias"], float(f["temperature"]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def temperature_for(logits: np.ndarray, of: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section over its logarithm."""
    if not len(of):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(of)), of], 1e-12)).mean()
    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        x, y = b - g * (b - a), a + g * (b - a)
        a, b = (a, y) if loss(x) <= loss(y) else (x, b)
    return float(np.exp((a + b) / 2))


class Leader:
    """Follow-the-regularised-leader with elastic-net penalties: weights (inputs by classes), and a step by a batch."""

    def __init__(self, inputs: int, classes: int, alpha: float, beta: float, l1: float, l2: float):
        self.z, self.n, self.w = (np.zeros((inputs, classes), np.float32) for _ in range(3))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def step(self, x: np.ndarray, of: np.ndarray) -> None:
        """One step by the mean gradient of the log loss over rows x of classes `of`."""
        p = softmax(x @ self.w)
        p[np.arange(len(x)), of] -= 1
        g = x.T @ p / max(1, len(x))
        sigma = (np.sqrt(self.n + g * g) - np.sqrt(self.n)) / self.alpha
        self.z += g - sigma * self.w
        self.n += g * g
        kept = np.abs(self.z) > self.l1
        self.w = np.where(kept, (np.sign(self.z) * self.l1 - self.z) / ((self.beta + np.sqrt(self.n)) / self.alpha + self.l2), 0).astype(np.float32)


def fit(texts: list[str], langs: list[str], inverse: np.ndarray, alpha: float = 0.5, beta: float = 0.01, l1: float = 2e-4, l2: float = 2e-4, epochs: int = 4) -> Model:
    """Follow-the-regularised-leader over small batches; every fifth text is left out and sets the temperature."""
    languages = sorted(set(langs))
    of, rows = np.array([languages.index(x) for x in langs], np.int64), []
    for at in range(0, len(texts), SLICE_ROWS):
        store = Words(grams)
        rows += [np.unique(np.frombuffer(store.joined(w), "<u2"), return_counts=True) for w in store.of(texts[at : at + SLICE_ROWS])]

    def values(chosen: np.ndarray) -> np.ndarray:
        x = np.zeros((len(chosen), BUCKETS + 1), np.float32)
        x[:, BUCKETS] = 1
        for k, i in enumerate(chosen):
            buckets, counts = rows[i]
            x[k, buckets] = SCALE * counts / max(1, counts.sum()) * inverse[buckets]
        return x

    left_out = np.arange(len(rows)) % 5 == 4
    rng, k = np.random.default_rng(0), len(languages)
    leader = Leader(BUCKETS + 1, k, alpha, beta, l1, l2)
    for _ in range(epochs if k > 1 else 0):
        for chosen in np.array_split(rng.permutation(np.flatnonzero(~left_out)), max(1, len(rows) // 64)):
            leader.step(values(chosen), of[chosen])
    check, w = np.flatnonzero(left_out), leader.w
    logits = np.concatenate([values(c) @ w for c in np.array_split(check, max(1, len(check) // 64))]) if len(check) and k else np.zeros((0, k))
    return Model(languages, w[:BUCKETS] * inverse[:, None].astype(np.float32), w[BUCKETS], temperature_for(logits, of[check]) if k > 1 else 1.0)


def fold(id_col: str = "doc_id"):
    """The fold of a row: 2 is held out."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 4


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """The model from the rows outside the held-out fold that have a language.

    Document frequencies count all of these; weights are fitted to at most per_language rows of each language, those of
    the least hash of their id. The ids are chosen first, and broadcast (bounded); documents aren't shuffled.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.where((fold() != 2) & F.col("lang").isNotNull())
    total, seen = document_frequency(rows.select("text"))
    inverse = np.log((1 + total) / (1 + seen)) + 1
    at = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    # Of a language's rows those of small hashes are ranked: somewhat more than are wanted, however many there are.
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), (1.2 * per_language + 300) / F.count("*")).alias("share")).withColumnRenamed("lang", "l")
    few = rows.select("doc_id", "lang").join(F.broadcast(share), F.col("lang") == F.col("l")).where(F.xxhash64("doc_id") <= F.col("share") * 2.0**64 - 2.0**63)
    chosen = few.select("doc_id", "lang", at.alias("at")).where(F.col("at") <= per_language).select(F.col("doc_id").alias("of"), F.col("lang").alias("of_lang")).distinct()
    short = rows.where(F.octet_length("text") <= LONGEST)
    picked = short.join(F.broadcast(chosen), (F.col("doc_id") == F.col("of")) & (F.col("lang") == F.col("of_lang")))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    table = picked.select("doc_id", "text", "lang", F.row_number().over(order).alias("at")).where(F.col("at") <= per_language).orderBy("lang", "at").collect()
    return fit([r.text for r in table], [r.lang for r in table], inverse)


class Scorer:
    def __init__(self, data: bytes):
        self.model = Model.load(data)
        self.words = Words(self.sums)

    def sums(self, words: list[str]) -> list[bytes]:
        """Of each word the sum of the weights of its n-grams, and their number."""
        buckets, counts = buckets_of(words)
        starts = np.cumsum(counts) - counts
        sums = np.add.reduceat(self.model.weights[buckets].astype(np.float64), starts)
        data, width = np.column_stack([sums, counts]).astype("<f8").tobytes(), 8 * (len(self.model.languages) + 1)
        return [data[at : at + width] for at in range(0, len(data), width)]

    def logits(self, texts: list[str]) -> np.ndarray:
        """One row for each text; all NaN if it has no letter."""
        k = len(self.model.languages)
        out = np.full((len(texts), k), np.nan)
        for i, words in enumerate(self.words.of(texts)):
            if words:
                sums = np.frombuffer(self.words.joined(words), "<f8").reshape(-1, k + 1).sum(0)
                out[i] = SCALE * sums[:k] / sums[k] + self.model.bias
        return out / self.model.temperature


_BUILT: dict[int, Scorer] = {}


def _scorer(model) -> Scorer:
    key = hash(model.value)
    if key not in _BUILT:
        _BUILT.clear()  # a worker that outlives a job keeps one model
        _BUILT[key] = Scorer(model.value)
    return _BUILT[key]


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the calibrated probability): one row for each input row.

    A text without a letter, or null, is `und` with score 0; so is every text if no language was learnt.
    """
    shared = df.sparkSession.sparkContext.broadcast(model.dump())

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = _scorer(shared)
        names, logits = scorer.model.languages, scorer.logits(batch.column(1).to_pylist())
        known = ~np.isnan(logits).any(1) if names else np.zeros(batch.num_rows, bool)
        lang, prob = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
        if known.any():
            p = softmax(logits[known])
            prob[known] = p.max(1)
            for i, j in zip(np.flatnonzero(known), p.argmax(1)):
                lang[i] = names[j]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(prob, pa.float64())], ["doc_id", "lang_pred", "score"])

    read = keyed_text(df, id_col, text_col)
    return read.mapInArrow(by_slices(each), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
