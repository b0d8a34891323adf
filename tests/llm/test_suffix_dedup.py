import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from loamworks.llm.suffix_dedup import Runs, repeated_passages, retained, suffix_order, surroundings, without_repeats


def plain(rows, least):
    """Words of each document covered by a run of `least` words that another document has."""
    where = defaultdict(set)
    words = {d: (t or "").encode().split() for d, t in rows if d is not None}
    for d, w in words.items():
        for i in range(len(w) - least + 1):
            where[tuple(w[i : i + least])].add(d)
    out = {}
    for d, w in words.items():
        for repeat in (True, False):
            covered = set()
            for i in range(len(w) - least + 1):
                others = where[tuple(w[i : i + least])] - {d}
                if any(o < d for o in others) if repeat else any(o > d for o in others):
                    covered |= set(range(i, i + least))
            out[d, repeat] = covered
    return {k: v for k, v in out.items() if v}


def got(df, least):
    out = defaultdict(set)
    for r in repeated_passages(df, least=least).collect():
        out[r.doc_id, r.repeat] |= set(range(r.start, r.end))
    return dict(out)


def same(have, want):
    """Repeats of smaller documents' words exactly; and every word that stands in another document, as either kind."""
    both = lambda x: {d: x.get((d, True), set()) | x.get((d, False), set()) for d, _ in x}
    assert {k: v for k, v in have.items() if k[1]} == {k: v for k, v in want.items() if k[1]}
    assert both(have) == both(want)


def made(seed, docs=60, passages=4, least=50, vocabulary=4000):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    shared = [[word() for _ in range(least + 10 * k)] for k in range(passages)]
    rows = []
    for d in range(docs):
        parts = [word() for _ in range(rng.randrange(0, 150))]
        for p in rng.sample(shared, rng.randrange(0, 3)):
            parts += p + [word() for _ in range(rng.randrange(1, 60))]
        rows.append((d, " ".join(parts)))
    return rows


def test_every_word_of_repeats(docs):
    for seed in (1, 2):
        rows = made(seed)
        rows += [(100 + d, t) for d, t in rows[:10]] + [(200, rows[3][1] + " more"), (201, "x " + rows[3][1])]
        same(got(docs(rows), 50), plain(rows, 50))


def test_one_word_less_is_none(docs):
    rng = random.Random(4)
    p = [f"p{i}" for i in range(49)]
    rows = [(d, " ".join([f"a{d}"] * 30 + p + [f"{rng.random()}" for _ in range(40)])) for d in range(5)]
    assert got(docs(rows), 50) == {}
    same(got(docs(rows), 49), plain(rows, 49))


def test_crowd_and_sample(docs, sample):
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(d, f"u{d} v{d} " + passage + f" z{d}") for d in range(400)]
    same(got(docs(rows), 50), plain(rows, 50))
    rows = [r[:2] for r in sample[1]]
    same(got(sample[0], 50), plain(rows, 50))


def test_part_in_a_smaller_document(docs):
    """Passages of exactly 50 words in two documents each, of which a smaller one has 33 to 49 words: none is lost."""
    rng, rows = random.Random(7), []
    word = lambda: f"w{rng.random()}"
    for k in range(150):
        passage, n = [word() for _ in range(50)], rng.randrange(33, 50)
        at = rng.randrange(0, 51 - n)
        around = lambda x: " ".join([word() for _ in range(rng.randrange(0, 40))] + x + [word() for _ in range(rng.randrange(0, 40))])
        rows += [(k, around(passage[at : at + n])), (1000 + 2 * k, around(passage)), (1001 + 2 * k, around(passage))]
    rows += [(5000 + k, " ".join([f"l{i}" for i in range(45)] + [f"c{k % 7}-{i}" for i in range(10)] + [word() for _ in range(30)])) for k in range(80)]
    have = got(docs(rows), 50)
    same(have, plain(rows, 50))
    assert sum((1001 + 2 * k, True) in have for k in range(150)) == 150


def test_keys_that_go_on_in_other_tasks(docs, spark):
    """A passage that all documents have, and parts that few share, over more tasks than keys."""
    rng = random.Random(9)
    line = [f"l{i}" for i in range(40)]
    rows = [(d, " ".join([f"a{d % 5}-{i}" for i in range(12)] + line + [f"b{d % 11}-{i}" for i in range(12)] + [f"{rng.random()}" for _ in range(5)])) for d in range(200)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        same(got(docs(rows), 50), plain(rows, 50))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_texts_and_cutting(odd, docs):
    assert {k for k, _ in got(odd, 50)} <= {8}
    assert got(docs([]), 50) == {}
    p = " ".join(f"p{i}" for i in range(60))
    df = docs([(1, "a " + p + " b"), (2, "ü\n" + p + " d " + p), (3, None), (4, "c")]).withColumnsRenamed({"n_chars": "start", "source": "doc"})
    out = {r.doc_id: r.text for r in without_repeats(df).collect()}
    assert out == {1: "a " + p + " b", 2: "ü\n d ", 3: None, 4: "c"}


def test_repeated_null_and_string_ids(docs):
    """Each text is cut by its own passages; of equal rows both are, and texts without an id come last."""
    p, q, u = (" ".join(f"{c}{i}" for i in range(60)) for c in "pqu")
    rows = [(1, p + " x"), (2, "y " + p), (2, u + " " + q), (2, "y " + p), (3, q + " z"), (None, "n " + u), (None, "m"), (4, None)]
    want = [(1, p + " x"), (2, "y "), (2, u + " " + q), (2, "y "), (3, " z"), (None, "n "), (None, "m"), (4, None)]
    text = lambda rows: sorted((str(d), str(t)) for d, t in rows)
    df = docs(rows)
    assert text((r.doc_id, r.text) for r in without_repeats(df).collect()) == text(want)
    assert {(r.doc_id, r.repeat) for r in repeated_passages(df).collect()} == {(1, False), (2, True), (2, False), (3, True), (None, True)}
    named = docs([r for r in rows[:2]]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id: r.text for r in without_repeats(named).collect()} == {"d1": p + " x", "d2": "y "}


def test_parts():
    assert len(retained([b"w"] * 49)[0]) == 0 and len(retained([b"w"] * 50)[0]) > 0
    words = [str(i).encode() for i in range(70)]
    key, around = surroundings(words, np.array([0, 10, 30]), 50, 16)
    assert around.shape == (3, 18) and key[1] == Runs(words[10:43]).of(np.array([0]), np.array([33]))[0]
    assert [int((a > 0).sum()) for a in around] == [1, 11, 8] and around[1][-1] == Runs(words[10:60]).of(np.array([0]), np.array([50]), 1)[0] | np.uint64(1)


def test_each_partner_of_a_span(docs):
    """A document whose words two smaller ones have in parts names both, each with its own stretch."""
    words = [f"w{i}" for i in range(140)]
    rows = [(1, " ".join(["a"] * 5 + words[10:80])), (2, " ".join(["b"] * 7 + words[50:130])), (3, " ".join(words))]
    got = {(r.doc_id, r.start, r.end, r.other_doc_id, r.repeat) for r in repeated_passages(docs(rows)).collect()}
    assert got == {(3, 10, 80, 1, True), (3, 50, 130, 2, True), (1, 5, 75, 3, False), (2, 7, 87, 3, False)}
    assert {r.doc_id: r.text for r in without_repeats(docs(rows)).collect()}[3] == " ".join(words[:10]) + "  " + " ".join(words[130:])


def test_rows_hold_only_what_the_partner_has(docs):
    """Two stretches side by side, which the partner has apart, are two rows: no run of 50 words across is shared."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, " ".join(b + ["x"] * 9 + a)), (2, " ".join(a + b))]
    got = {(r.doc_id, r.start, r.end, r.other_doc_id) for r in repeated_passages(docs(rows)).collect() if r.repeat}
    assert got == {(2, 0, 60, 1), (2, 60, 120, 1)}


def test_suffixes_are_in_order_of_their_words():
    """By a number for each word: the first word, then the second, then the next two as one, then four."""
    rng = random.Random(2)
    words = [rng.choice([b"x", b"y", b"z"]) for _ in range(400)]
    runs, starts = Runs(words), np.arange(300)
    part = lambda s, a, b: int(runs.of(np.array([s + a]), np.array([s + b]))[0] >> np.uint64(48))
    want = sorted(starts.tolist(), key=lambda s: [part(s, a, b) for a, b in ((0, 1), (1, 2), (2, 4), (4, 8))])
    order = suffix_order(runs, starts, 33)
    assert np.argsort(order, kind="stable").tolist() == want
