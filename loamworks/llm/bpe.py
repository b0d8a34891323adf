"""BPE encoding and decoding with a given vocabulary: batched numpy merge rounds.

The words that a batch adds to what a worker knows lie as symbols in one flat array. In each round the pairs of
neighbouring symbols are looked up by binary search over the sorted pair keys, and in each word every place of its
lowest-ranked pair is merged, until no word has a known pair. Words met before come from a bounded store.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import by_slices, keyed_text

#: How a byte-level vocabulary writes each byte as one printable character.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: White space as the vocabulary's normaliser counts it (Unicode's White_Space).
_WHITE = r"[\t-\r\x20\x85\xa0  -     　]"
#: Words kept by a worker; beyond that it starts anew (about 150 bytes each).
STORE_WORDS = 400_000


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else the next free one from U+0100 on."""
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in set(_PRINTABLE) else chr(next(free)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a vocabulary file with NFC, lower case, a split pattern and a word-end suffix.

    Ids equal those of the tokenizers library for the same file with add_special_tokens=False: special tokens written
    out in a text are recognised before normalisation. Decoding joins the tokens of the ids with one space, as that
    library does for a file without a decoder. Unknown ids decode to nothing.
    """

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]"))
        self.white = regex.compile(_WHITE + "+")
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in (*vocab.items(), *self.special.items()):
            self.tokens[i] = token
        chars = byte_characters()
        self.plain = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(left * size + right, kind="stable")
        self.size = size
        self.keys, self.ranks, self.made = (left * size + right)[order], order.astype(np.int32), made[order]
        self.known: dict[str, bytes] = {}

    def split(self, text: str) -> Iterable[str]:
        """The words of a text, special tokens among them as they are."""
        if self.special_split is None or "<|" not in text:
            return self.words.findall(self.normalise(text))
        out: list[str] = []
        for part in self.special_split.split(text):
            out += [part] if part in self.special else self.words.findall(self.normalise(part))
        return out

    def normalise(self, text: str) -> str:
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        # Lower case letter by letter: a sigma at a word's end has no form of its own here.
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes of 32-bit numbers."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.plain[flat]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(raw)), sizes)
        done_symbols, done_words = [], []
        none = np.int32(2**31 - 1)
        while len(symbols):
            key = symbols[:-1].astype(np.int64) * self.size + symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.full(len(symbols), none)
            rank[:-1] = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], none)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(word)])
            lowest_at = np.repeat(lowest, lengths)
            over = lowest_at == none
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                keep = ~over
                symbols, word, rank, lowest_at = symbols[keep], word[keep], rank[keep], lowest_at[keep]
                at = np.r_[at, 0][keep]
                if not len(symbols):
                    break
            chosen = np.flatnonzero(rank == lowest_at)
            # Of places that overlap (a pair of one symbol with itself) every second one from the left is merged.
            touching = np.r_[False, np.diff(chosen) == 1]
            if touching.any():
                first = np.maximum.accumulate(np.where(touching, 0, np.arange(len(chosen))))
                chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            symbols[chosen] = self.made[at[chosen]]
            keep = np.ones(len(symbols), bool)
            keep[chosen + 1] = False
            symbols, word = symbols[keep], word[keep]
        all_words = np.concatenate(done_words) if done_words else np.zeros(0, np.int64)
        order = np.argsort(all_words, kind="stable")
        ids = np.concatenate(done_symbols)[order] if done_symbols else np.zeros(0, np.int32)
        bounds = np.r_[0, np.cumsum(np.bincount(all_words, minlength=len(words)))] * 4
        data = ids.astype("<i4").tobytes()
        bounds = bounds.tolist()
        return [data[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text's begin and end."""
        split = [self.split(t) for t in texts]
        if len(self.known) > STORE_WORDS:
            self.known = {}
        if not self.known:
            self.known = {w: np.array([i], "<i4").tobytes() for w, i in self.special.items()}
        known = self.known
        fresh = list({w for words in split for w in words if w not in known})
        if fresh:
            known.update(zip(fresh, self.merge(fresh)))
        parts = [b"".join([known[w] for w in words]) for words in split]
        bounds = np.r_[0, np.cumsum([len(p) // 4 for p in parts])].astype(np.int64)
        return np.frombuffer(b"".join(parts), "<i4"), bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each range of ids."""
        tokens, listed, edges = self.tokens, ids.tolist(), bounds.tolist()
        size = self.size
        if listed and (max(listed) >= size or min(listed) < 0):
            return [" ".join([tokens[i] for i in listed[a:b] if 0 <= i < size and tokens[i]]) for a, b in zip(edges, edges[1:])]
        return [" ".join([tokens[i] for i in listed[a:b]]) for a, b in zip(edges, edges[1:])]


_BUILT: dict[int, WordBpe] = {}


def _coder(vocabulary) -> WordBpe:
    """One encoder for each Python worker and vocabulary; vocabulary: a broadcast of the file's text."""
    key = hash(vocabulary.value)
    if key not in _BUILT:
        _BUILT[key] = WordBpe(vocabulary.value)
    return _BUILT[key]


def _shipped(df: DataFrame, path: str):
    """The vocabulary file (one or two MB, whatever the input's size) for every executor."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int> (and with decoded: decoded string, the ids turned back into text).

    path: vocabulary file, read by the driver. One row for each input row, null ids and repeated rows included; a null
    or empty text has no ids and decodes to the empty string.
    """
    vocabulary = _shipped(df, path)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder = _coder(vocabulary)
        ids, bounds = coder.encode(batch.column(1).to_pylist())
        arrays = [batch.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
        if decoded:
            arrays.append(pa.array(coder.decode(ids, bounds), pa.string()))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"][: len(arrays)])

    read = keyed_text(df, id_col, text_col)
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(by_slices(each), f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded string: the text of each row's ids. Null or no ids: the empty string; unknown ids give nothing."""
    vocabulary = _shipped(df, path)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [[i for i in x or [] if i is not None] for x in batch.column(1).to_pylist()]
        bounds = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int64)
        ids = np.fromiter((i for x in lists for i in x), np.int64, int(bounds[-1]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(_coder(vocabulary).decode(ids, bounds), pa.string())], ["doc_id", "decoded"])

    read = df.select(df[f"`{id_col}`"].alias("doc_id"), df[f"`{ids_col}`"].alias("ids"))
    return read.mapInArrow(by_slices(each), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, decoded string")
