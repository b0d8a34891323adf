"""Text functions as Column expressions: nothing here leaves the JVM but slug()."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ABBREVIATIONS

#: Stand-ins inside sentences(): an end of sentence, and a full stop that is none.
END, DOT = "\x01", "\x02"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _marked(c: Column, abbreviations: Iterable[str]) -> Column:
    """A text with END for the white space after a sentence and DOT for an abbreviation's full stop. Only full stops are looked behind."""
    kept = F.regexp_replace(c, rf"\.(?<=(?<!\p{{L}})(?i:{'|'.join(abbreviations)})\.)", DOT)
    return F.regexp_replace(kept, r"([.!?])\s+", f"$1{END}")


def sentence_parts(c: Column, abbreviations: Iterable[str] = ABBREVIATIONS) -> Column:
    """Sentences as they stand, blank ones too; an abbreviation's full stop is DOT."""
    return F.split(_marked(c, abbreviations), END)


def sentences(c: Column, abbreviations: Iterable[str] = ABBREVIATIONS) -> Column:
    """Sentences of a text: ended by . ! ? and white space, but not by an abbreviation's full stop. Blank ones are left out."""
    return F.filter(F.transform(sentence_parts(c, abbreviations), lambda s: strip(F.replace(s, F.lit(DOT), F.lit(".")))), lambda s: s != "")


def sentence_lengths(c: Column, abbreviations: Iterable[str] = ABBREVIATIONS) -> Column:
    """Words of each of the sentences(). Two passes over the whole text, one for ends of sentences, one that leaves a letter of
    each word, so no sentence is split by itself and no full stop is marked."""
    ended = F.regexp_replace(c, rf"([.!?])(?=\s)(?<!(?<!\p{{L}})(?i:{'|'.join(abbreviations)})\.)\s+", f"$1{END}")
    letters = F.regexp_replace(ended, rf"([^\s{END}])[^\s{END}]*+\s*+|\s++", "$1")
    return F.filter(F.transform(F.split(letters, END), lambda s: F.length(s).cast("long")), lambda n: n > 0)


def tokens(c: Column) -> Column:
    """Lower-case word tokens with an inner apostrophe."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+(?:'[a-z]+)?"), F.lit(0))


def index_tokens(c: Column, longer_than: int = 1) -> Column:
    """Lower-case terms for retrieval, with inner _ + -, of more than so many characters."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9][a-z0-9_+-]*"), F.lit(0)), lambda t: F.length(t) > longer_than)


def word_count(c: Column) -> Column:
    return F.size(F.array_remove(F.split(c, r"\s+"), "")).cast("long")


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a space; none if there are fewer.

    The words are zipped with themselves moved by one, two …, so they are made n + 1 times a row and not for each run.
    """
    if n == 1:
        return words
    moved = F.arrays_zip(*(F.slice(words, k + 1, F.greatest(F.size(words), F.lit(0))).alias(f"w{k}") for k in range(n)))
    return F.transform(F.filter(moved, lambda z: z[f"w{n - 1}"].isNotNull()), lambda z: F.concat_ws(" ", *(z[f"w{k}"] for k in range(n))))


def contractions(c: Column, lower: Column | None = None) -> Column:
    """lower: the text in lower case, where a caller has it; else it's made here (as in phrase_count() and matched_phrases())."""
    lower = F.lower(c) if lower is None else lower
    found = F.regexp_count(lower, F.lit(r"(?<=[a-z])'(?:t|s|re|ve|ll|d|m)\b"))
    return F.when(F.contains(lower, F.lit("'")), found).when(lower.isNotNull(), F.lit(0)).cast("long")


def occurrences(c: Column, character: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(character), F.lit("")))).cast("long")


#: The ten marks that are counted, by name.
PUNCTUATION = {"comma": ",", "period": ".", "question": "?", "exclamation": "!", "semicolon": ";", "colon": ":", "em_dash": "—", "open_paren": "(", "close_paren": ")", "quote": '"'}


def punctuation(c: Column) -> dict[str, Column]:
    return {name: occurrences(c, ch) for name, ch in PUNCTUATION.items()}


def paragraphs(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"\n\s*\n"), lambda p: strip(p) != "")


def phrase_pattern(phrase: str) -> str:
    """A phrase at word borders (of any letters), with any white space between its words. What stands before its first word
    is looked at once that word is there."""
    first, *rest = map(re.escape, phrase.lower().split())
    return r"\s+".join([rf"{first}(?<![\p{{L}}\p{{N}}]{first})", *rest]) + r"(?![\p{L}\p{N}])"


def may_have(lower: Column, phrase: str) -> Column:
    """Whether a lower-case text has the phrase's longest word at all: a plain search, before the pattern."""
    return F.contains(lower, F.lit(max(phrase.lower().split(), key=len)))


def phrase_count(c: Column, phrase: str, lower: Column | None = None) -> Column:
    lower = F.lower(c) if lower is None else lower
    return F.when(may_have(lower, phrase), F.regexp_count(lower, F.lit(phrase_pattern(phrase)))).when(lower.isNotNull(), F.lit(0)).cast("long")


def matched_phrases(c: Column, phrases: Iterable[str], lower: Column | None = None) -> Column:
    """The phrases that a text has, in the order of the list."""
    lower = F.lower(c) if lower is None else lower
    return F.array_compact(F.array(*(F.when(may_have(lower, p) & lower.rlike(phrase_pattern(p)), F.lit(p)) for p in phrases), F.lit(None).cast("string")))


def rate(count: Column, words: Column, per: int = 1000) -> Column:
    """count for every `per` words; 0 where there are none."""
    return F.coalesce(F.try_divide(count * per, words), F.lit(0.0)).cast("double")


def stable_id(path: Column, text: Column, length: int = 16) -> Column:
    return F.substring(F.sha1(F.concat(path, F.lit("\0"), text)), 1, length)


def hash_bucket(c: Column, buckets: int = 100) -> Column:
    """The first 32 bits of the SHA-256, modulo buckets."""
    return F.pmod(F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("long")


def normalised(c: Column) -> Column:
    """White space collapsed, ends stripped, lower case."""
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def first_non_blank(*columns: Column) -> Column:
    return F.coalesce(*(F.when(strip(c) != "", c) for c in columns))


def key_name(c: Column) -> Column:
    """Letters and digits in lower case, anything else one underscore."""
    return F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_")


def cue_time(seconds: Column, separator: str = ",") -> Column:
    """HH:MM:SS,mmm of seconds, cut to the millisecond."""
    ms = F.floor(F.round(seconds * 1e6) / 1000).cast("long")
    part = lambda of, n: F.lpad((F.floor(of) % n).cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000).cast("string")
    return F.concat(F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours), F.lit(":"), part(ms / 60_000, 60), F.lit(":"), part(ms / 1000, 60), F.lit(separator), F.lpad((ms % 1000).cast("string"), 3, "0"))


def wikilink(page: Column) -> Column:
    return F.concat(F.lit("[["), F.regexp_replace(page, r"\.md$", ""), F.lit("]]"))


def score_bar(score: Column, width: int = 20) -> Column:
    full = F.floor(F.greatest(F.lit(0), F.least(F.lit(100), score)) * width / 100).cast("int")
    return F.rpad(F.repeat(F.lit("#"), full), width, "-")


#: Fixed shapes of credentials that a log or note may hold; a caller may give others.
SECRETS = {
    "named": r"\b([A-Z][A-Z0-9_]*(?:TOKEN|KEY|SECRET|PASSWORD))\s*[=:]\s*\S+",
    "bearer": r"(?i)\bbearer\s+[a-z0-9._~+/-]{16,}=*",
    "access": r"\bAKIA[A-Z0-9]{16}\b",
    "token": r"\b(?:ghp|gho|xox[abp])[_-][A-Za-z0-9-]{20,}",
    "key": r"\bsk-[A-Za-z0-9_-]{20,}",
    "signed": r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+",
}


def redacted(c: Column, patterns: dict[str, str] = SECRETS, mark: str = "[redacted]") -> Column:
    for pattern in patterns.values():
        c = F.regexp_replace(c, pattern, mark)
    return c


def _replaced(c: Column, words: Iterable[str], pattern: str, new: str) -> Column:
    """c with the pattern replaced, looked for only in texts that have one of its words at all (in lower case)."""
    has = lambda x: reduce(or_, (F.contains(F.lower(x), F.lit(w.lower())) for w in words))
    # A lambda names the text, so that steps on steps don't repeat each other.
    return F.transform(F.array(c), lambda x: F.when(has(x), F.regexp_replace(x, pattern, new)).otherwise(x))[0]


def rewritten(c: Column, swaps: dict[str, str], connectors: Iterable[str], fillers: Iterable[str]) -> Column:
    """A mechanical rewrite: em dashes to commas, plain words for grand ones (a first capital stays), connectors at a
    sentence's start and spoken fillers out, longest first, then spaces and punctuation tidied. The words are taken as they are."""
    c = _replaced(c, "—", r"\s*—\s*", ", ")
    for old, new in swaps.items():
        c = _replaced(c, [old], rf"(?<![\p{{L}}]){old}(?![\p{{L}}])", new)
        c = _replaced(c, [old], rf"(?<![\p{{L}}]){old.capitalize()}(?![\p{{L}}])", new.capitalize())
    if connectors := list(connectors):
        c = _replaced(c, connectors, rf"(?i)(^|[.!?]\s+)(?:{'|'.join(connectors)}),?\s+", "$1")
    for filler in sorted(fillers, key=len, reverse=True):
        c = _replaced(c, [filler], rf"(?i),?\s*(?<![\p{{L}}]){filler}(?![\p{{L}}]),?", "")
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\s+([,.!?;])", "$1"))


def _slugs(names: pd.Series) -> pd.Series:
    def one(name: str | None) -> str | None:
        if name is None:
            return None
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(ch))
        return re.sub("[^a-z0-9Ѐ-ӿ]+", "-", plain).strip("-")[:60].rstrip("-") or "untitled"

    return names.map(one)


def slug(c: Column) -> Column:
    """Compatibility letters, lower case, Latin and Cyrillic letters and digits joined by hyphens, 60 characters at most.

    In Python, in Arrow batches, because Spark has no Unicode normalisation. Null stays null; nothing left gives `untitled`.
    """
    return F.pandas_udf(_slugs, "string")(c)
