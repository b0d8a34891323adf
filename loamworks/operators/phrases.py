"""Long phrase lists: all phrases of any number of lists found by an automaton.

The time doesn't grow with the number of phrases. An occurrence is what functions.text counts: at word borders, any white
space between its words, case aside, from the left and without overlap with one of the same phrase. The lists are collected
and sent to the tasks, in groups if they are very long: each group is an automaton and takes a pass over the texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Phrases (about) that a task's automaton holds; more of them are more passes over the texts.
MOST_PHRASES = 500_000
#: Texts that are Python objects at once, with what is found in them.
SLICE_ROWS = 256
SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
#: Letters and digits that follow each other, and what stands at both ends of them while phrases are looked for; no text has it.
RUNS, MARK = re.compile(r"[^\W_]+"), "\ud800"


def folded(text: str) -> str:
    return SPACES.sub(" ", text.lower())


def marked(text: str) -> str:
    return RUNS.sub(rf"{MARK}\g<0>{MARK}", text)


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """Of phrases as they are in the list, by their folded form. Word borders are marked, so that few places inside words are found."""
    found: dict[str, list[int]] = {}
    for k, phrase in enumerate(phrases):
        found.setdefault(folded(phrase).strip(), []).append(k)
    out = ahocorasick.Automaton()
    for form, which in found.items():
        if form:
            out.add_word(form := marked(form), (len(form), which, form[0] == MARK == form[-1]))
    out.make_automaton()
    return out


def counts_in(text: str, found: ahocorasick.Automaton) -> dict[int, int]:
    """How often each phrase (its place in the list) stands in a text."""
    text, out, ends = marked(folded(text)), {}, {}
    if not len(found):
        return out
    for last, (size, which, words) in found.iter(text):
        start = last - size + 1
        if start < ends.get(which[0], 0):
            continue
        # A letter or digit next to an end that is neither.
        if not words and ((start and text[start] != MARK == text[start - 1]) or (last + 1 < len(text) and text[last] != MARK == text[last + 1])):
            continue
        ends[which[0]] = last + 1
        for k in which:
            out[k] = out.get(k, 0) + 1
    return out


def phrase_matches(df: DataFrame, key: str, text: str, phrases: DataFrame, most: int | None = None) -> DataFrame:
    """key, lexicon, phrase, n: how often each phrase of each list (lexicon, phrase) stands in each text, where it does.

    A null text has none; blank phrases are never found; a phrase that is in several lists, or twice in one, counts for each
    list once. Keys may repeat: each row is told by itself. most: more phrases than this are refused (ValueError); None: any number.
    """
    found = _matches(df, key, text, phrases, most, False)
    return found.select(F.col("k").alias(key), "lexicon", "phrase", "n")


def _matches(df: DataFrame, key: str, text: str, phrases: DataFrame, most: int | None, summed: bool) -> DataFrame:
    """k, lexicon, phrase, n of phrase_matches(). summed: a row for each text and list instead, phrase null, one or more for a text."""
    listed = phrases.where("phrase IS NOT NULL").select("lexicon", "phrase").distinct()
    listed = written(listed if most is None else listed.limit(most + 1))
    n = listed.count()
    if most is not None and n > most:
        raise ValueError(f"more than {most} phrases")
    read = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL")
    kind, size, groups = read.schema["k"].dataType.simpleString(), SLICE_ROWS, max(1, math.ceil(n / MOST_PHRASES))
    # A phrase is counted by itself, whatever others there are, so that groups may be any.
    grouped = listed.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(groups)))

    def found_in(group: int) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(grouped.where(F.col("group") == group).select("lexicon", "phrase").orderBy("lexicon", "phrase").toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # A worker has the same object in all tasks of this group.
            if not hasattr(shared, "automaton"):
                shared.automaton = automaton(shared.value["phrase"].to_pylist())
            found, lists = shared.automaton, [shared.value[c].combine_chunks() for c in ("lexicon", "phrase")]
            names = lists[0].dictionary_encode()
            code, names = names.indices.to_pylist(), names.dictionary
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part, of, which, n = batch.slice(at, size), [], [], []
                    for i, value in enumerate(part.column(1)):
                        told = counts_in(value.as_py(), found)
                        if summed:
                            sums: dict[int, int] = {}
                            for k, m in told.items():
                                sums[code[k]] = sums.get(code[k], 0) + m
                            told = sums
                        of += [i] * len(told)
                        which += told
                        n += told.values()
                    places = pa.array(which, pa.int64())
                    said = [names.take(places), pa.nulls(len(which), pa.string())] if summed else [x.take(places) for x in lists]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of, pa.int64())), *said, pa.array(n, pa.int64())], ["k", "lexicon", "phrase", "n"])

        return read.mapInArrow(run, f"k {kind}, lexicon string, phrase string, n long")

    return reduce(DataFrame.union, map(found_in, range(groups)))


def phrase_totals(df: DataFrame, key: str, text: str, phrases: DataFrame, by: list[str]) -> DataFrame:
    """by, lexicon, n, n_texts: occurrences of all phrases of each list, and texts that have one. by: columns of df."""
    found = _matches(df.select(F.struct(key, *by).alias("k"), text), "k", text, phrases, None, True)
    each = found.groupBy("k", "lexicon").agg(F.sum("n").alias("n"))
    return each.groupBy(*(F.col(f"k.{c}").alias(c) for c in by), "lexicon").agg(F.sum("n").alias("n"), F.count("*").alias("n_texts"))
