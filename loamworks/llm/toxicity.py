"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals make document scores and offsets.

Labels say which documents are toxic, not which words. So the words of the sample's toxic documents that tell them from
the others (log-likelihood ratio over documents, near copies counted once) are tagged as toxic there, all other words as
clean, and the field is fitted to these tagged tokens: hashed features of a word and its ends, and transitions.
Forward-backward gives the probability of each token's tag and of each pair of successive tags, and with these the exact
gradient of the tags' likelihood. A small logistic model over the largest and the summed odds, fitted to
the document labels, makes the document's score.
"""

from __future__ import annotations

import io
import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_slices, keyed_text

#: Labelled documents that the model is fitted to, at most, and the longest of them in bytes: bounds of what the driver holds.
SAMPLE = 4000
LONGEST = 20_000
#: A word tells toxic documents if its log-likelihood ratio is at least this and so many of its documents are toxic.
LEAST_RATIO, LEAST_SHARE = 25.0, 0.9
BUCKETS = 1 << 18
WORD = re.compile(r"\w+")
#: Tokens of a training sequence; longer documents are several sequences there. Scoring takes whole documents.
WINDOW = 128
STORE_WORDS = 60_000


def names(word: str) -> tuple[str, str, str]:
    """The word, its first and its last four letters, as features."""
    return f"w:{word}", f"p:{word[:4]}", f"s:{word[-4:]}"


def bucket(name: str) -> int:
    return zlib.crc32(name.encode()) % BUCKETS


def features(word: str) -> tuple[int, ...]:
    return tuple(map(bucket, names(word)))


@dataclass
class Model:
    """weights: of a token's features, toxic against clean; change[a, b]: of tag b after a; first: of a sequence's first
    tag, toxic against clean; document: of bias, largest and summed log odds."""

    weights: np.ndarray
    change: np.ndarray
    first: float
    document: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        used = np.flatnonzero(self.weights)
        np.savez(out, used=used, weights=self.weights[used], change=self.change, first=self.first, document=self.document)
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Model:
        f = np.load(io.BytesIO(data))
        weights = np.zeros(BUCKETS)
        weights[f["used"]] = f["weights"]
        return Model(weights, f["change"], float(f["first"]), f["document"])


def marginals(emissions: list[np.ndarray], change: np.ndarray, first: float) -> list[np.ndarray]:
    """The probability of the toxic tag at each token of each sequence."""
    return chain(emissions, change, first)[0]


def chain(emissions: list[np.ndarray], change: np.ndarray, first: float, pairs: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """The probability of the toxic tag at each token of each sequence, by forward-backward over all sequences at once; and
    with pairs: how many of each pair of successive tags are expected, over all sequences."""
    order = sorted(range(len(emissions)), key=lambda i: -len(emissions[i]))
    lengths = np.array([len(emissions[i]) for i in order])
    longest = int(lengths[0]) if len(order) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t, a prefix of the order
    starts = np.r_[0, np.cumsum(active)]
    flat = np.concatenate([emissions[i] for i in order]) if order else np.zeros(0)
    base = np.r_[0, np.cumsum(lengths)][:-1]
    # By time: the emissions of all sequences at t lie together.
    at = np.concatenate([base[:n] + t for t, n in enumerate(active)]) if longest else np.zeros(0, np.int64)
    odds = np.exp(np.clip(flat[at], -30, 30))
    m = np.exp(change)
    forward, backward = np.empty(len(at)), np.ones(len(at))
    for t in range(longest):
        a, b = starts[t], starts[t + 1]
        before = math.exp(first) if t == 0 else forward[starts[t - 1] : starts[t - 1] + b - a]
        forward[a:b] = odds[a:b] * (before if t == 0 else (m[0, 1] + before * m[1, 1]) / (m[0, 0] + before * m[1, 0]))
        np.clip(forward[a:b], 1e-15, 1e15, out=forward[a:b])
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        a, n = starts[t], int(active[t + 1])
        after = backward[starts[t + 1] : starts[t + 1] + n] * odds[starts[t + 1] : starts[t + 1] + n]
        backward[a : a + n] = (m[1, 0] + m[1, 1] * after) / (m[0, 0] + m[0, 1] * after)
        if pairs:
            here = forward[a : a + n]
            each = np.array([[m[0, 0] + 0 * after, m[0, 1] * after], [m[1, 0] * here, m[1, 1] * here * after]])
            expected += (each / each.sum((0, 1))).sum(2)
    ratio = forward * backward
    prob = np.empty(len(at))
    prob[at] = ratio / (1 + ratio)
    out: list[np.ndarray] = [np.zeros(0)] * len(emissions)
    for k, i in enumerate(order):
        out[i] = prob[base[k] : base[k] + lengths[k]]
    return out, expected


def gradient(tags: list[np.ndarray], emissions: list[np.ndarray], change: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the tags' log-likelihood: by each token's emission (one after the other), by the transitions, by the first tag."""
    probs, expected = chain(emissions, change, first, pairs=True)
    seen = np.zeros((2, 2))
    for t in tags:
        both = np.array([~t, t], float)
        seen += both[:, :-1] @ both[:, 1:].T
    tokens = np.concatenate(tags).astype(float) - np.concatenate(probs)
    return tokens, seen - expected, sum(float(t[0]) - float(p[0]) for t, p in zip(tags, probs) if len(t))


def telling_words(docs: list[np.ndarray], marks: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Of each word of the vocabulary, whether its documents are toxic far beyond the share of toxic ones.

    docs: each one's distinct words, as numbers; marks: a hash of each word. Documents whose three least marks are the same
    (alike but for a few words) count once.
    """
    seen: set[tuple[int, ...]] = set()
    bad, good, n_bad, n_good = np.zeros(len(marks)), np.zeros(len(marks)), 0, 0
    for words, is_toxic in zip(docs, toxic):
        least = tuple(np.sort(marks[words])[:3].tolist())
        if least in seen:
            continue
        seen.add(least)
        n_bad, n_good = n_bad + is_toxic, n_good + (not is_toxic)
        (bad if is_toxic else good)[words] += 1
    share = n_bad / max(1, n_bad + n_good)
    if not 0 < share < 1:
        return np.zeros(len(marks), bool)
    n = np.maximum(bad + good, 1)
    ratio = 2 * (bad * np.log(np.maximum(bad, 1) / (n * share)) + good * np.log(np.maximum(good, 1) / (n * (1 - share))))
    return (bad >= LEAST_SHARE * n) & (bad > 0) & (ratio >= LEAST_RATIO)


def document_features(prob: np.ndarray) -> tuple[float, float, float]:
    if not len(prob):
        return 1.0, -10.0, -10.0
    top, total = float(prob.max()), float(prob.sum())
    return 1.0, max(-10.0, min(10.0, math.log(max(top, 1e-9) / max(1 - top, 1e-9)))), max(-10.0, math.log(max(total, 1e-9)))


def fit(texts: list[str], labels: list[int], epochs: int = 4, rate: float = 0.5, penalty: float = 1e-6) -> Model:
    """The field and the document model, from labelled texts. Without texts, or with one label only, every score is even
    or near that label's share."""
    numbers: dict[str, int] = {}
    docs = [np.array([numbers.setdefault(w, len(numbers)) for w in WORD.findall(t.lower())], np.int32) for t in texts]
    toxic = np.array(labels, bool)
    feature = np.array([features(w) for w in numbers], np.int32).reshape(-1, 3)
    telling = telling_words([np.unique(d) for d in docs], feature[:, 0].astype(np.int64), toxic)
    del numbers
    weights, change, first = np.zeros(BUCKETS), np.zeros((2, 2)), 0.0
    squares, chain_squares = np.full(BUCKETS, 1e-3), np.full(5, 1e-3)
    parts = [(d[at : at + WINDOW], bad) for d, bad in zip(docs, toxic) for at in range(0, len(d), WINDOW)]
    rng = np.random.default_rng(0)
    for _ in range(epochs if telling.any() else 0):
        for batch in np.array_split(rng.permutation(len(parts)), max(1, len(parts) // 512)):
            ids = [parts[i][0] for i in batch]
            tags = [telling[d] & parts[i][1] for d, i in zip(ids, batch)]
            tokens, pairs, begin = gradient(tags, [weights[feature[d]].sum(1) for d in ids], change, first)
            g = np.bincount(feature[np.concatenate(ids)].ravel(), np.repeat(tokens, 3), BUCKETS) - penalty * weights
            squares += g * g
            weights += rate * g / np.sqrt(squares)
            moved = np.r_[pairs.ravel(), begin]
            chain_squares += moved * moved
            moved = 0.1 * rate * moved / np.sqrt(chain_squares)
            change, first = np.clip(change + moved[:4].reshape(2, 2), -4, 4), max(-4.0, min(4.0, first + float(moved[4])))
    word = weights[feature].sum(1)
    x = [document_features(p) for at in range(0, len(docs), 256) for p in marginals([word[d] for d in docs[at : at + 256]], change, first)]
    return Model(weights, change, first, logistic(np.array(x).reshape(-1, 3), toxic.astype(float)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Newton's method with a ridge on all but the bias."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[penalty] * (x.shape[1] - 1)])
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold(id_col: str = "doc_id"):
    """The fold of a row, by which labels are learnt from or held out (0)."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The model fitted to at most `sample` labelled rows outside the held-out fold, those of the least hash of their id.

    Only their ids are chosen first (a bounded table, broadcast); documents aren't shuffled.
    """
    known = labels.select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("toxic")).where((fold("of") != 0) & F.col("toxic").isNotNull())
    chosen = known.groupBy("of").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("of"), "of").limit(sample)
    rows = keyed_text(docs, id_col, text_col).where(F.octet_length("text") <= LONGEST)
    picked = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).select("doc_id", "text", "toxic")
    # Ids that many rows repeat don't make the sample longer.
    table = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).collect()
    return fit([r.text for r in table], [r.toxic for r in table])


class Scorer:
    def __init__(self, data: bytes):
        self.model = Model.load(data)
        self.known: dict[str, float] = {}
        # Many words share their ends; these have few values.
        self.ends: dict[str, float] = {}

    def end(self, name: str) -> float:
        if name not in self.ends:
            self.ends[name] = float(self.model.weights[bucket(name)])
        return self.ends[name]

    def emission(self, word: str) -> float:
        whole, *ends = names(word)
        value = self.known[word] = float(self.model.weights[bucket(whole)]) + sum(map(self.end, ends))
        return value

    def score(self, texts: list[str]) -> tuple[list[float], list[np.ndarray]]:
        if len(self.known) > STORE_WORDS:
            self.known, self.ends = {}, {}
        known = self.known
        words = [WORD.findall(t.lower()) for t in texts]
        for w in set().union(*words).difference(known):
            self.emission(w)
        probs = marginals([np.fromiter(map(known.__getitem__, d), np.float64, len(d)) for d in words], self.model.change, self.model.first)
        x = np.array([document_features(p) for p in probs]).reshape(-1, 3)
        return (1 / (1 + np.exp(-np.clip(x @ self.model.document, -30, 30)))).tolist(), probs


_BUILT: dict[int, Scorer] = {}


def _scorer(model) -> Scorer:
    key = hash(model.value)
    if key not in _BUILT:
        _BUILT.clear()  # a worker that outlives a job keeps one model
        _BUILT[key] = Scorer(model.value)
    return _BUILT[key]


def offending(text: str, prob: np.ndarray, least: float = 0.5) -> list[dict]:
    """Start and end (code points) of the runs of tokens whose probability is at least this."""
    out: list[dict] = []
    if not len(prob) or prob.max() < least:
        return out
    lower = text.lower()
    # Few letters grow when lower-cased (U+0130); their offsets are traced back.
    back = None
    if len(lower) != len(text):
        back = [i for i, c in enumerate(text) for _ in c.lower()] + [len(text)]
        lower = "".join(c.lower() for c in text)
    last = -2
    for k, m in enumerate(WORD.finditer(lower)):
        if k < len(prob) and prob[k] >= least:
            start, end = (back[m.start()], back[m.end()]) if back else m.span()
            if last == k - 1 and out:
                out[-1]["end"] = end
            else:
                out.append({"start": start, "end": end})
            last = k
    return out


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, spans array<struct<start, end>>: one row for each input row; null and empty texts have a score too.

    Nothing but the text is an input of a score.
    """
    shared = df.sparkSession.sparkContext.broadcast(model.dump())

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        scores, probs = _scorer(shared).score(texts)
        spans = [offending(t, p) for t, p in zip(texts, probs)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, SPANS)], ["doc_id", "score", "spans"])

    read = keyed_text(df, id_col, text_col)
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(by_slices(each), f"doc_id {kind}, score double, spans array<struct<start:int,end:int>>")


def drop_toxic(df: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of df whose text scores below `least`, all columns as they are.

    A null text is scored as an empty one. Repeated rows and ids are rows of their own: equal texts stay or go alike.
    """
    bounded_batches(df.sparkSession)
    shared, at = df.sparkSession.sparkContext.broadcast(model.dump()), df.columns.index(text_col)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, _ = _scorer(shared).score([t or "" for t in batch.column(at).to_pylist()])
        return batch.filter(pa.array([s < least for s in scores], pa.bool_()))

    return df.mapInArrow(by_slices(each), df.schema)
