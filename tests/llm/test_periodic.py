"""Periodic runs against a plain search for each period."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from loamworks.llm import periodic, queries


def plain_runs(words, least=6, exponent=4):
    """start, length, period: of every period all stretches that equal themselves so many words on."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines.encode()), sha(kept))


def texts(seed):
    rnd, words = random.Random(seed), []
    for _ in range(rnd.randint(0, 25)):
        kind = rnd.random()
        if kind < 0.4:
            words.append(f"w{rnd.randint(0, 3)}")
        elif kind < 0.8:
            words += [f"w{rnd.randint(0, 3)}" for _ in range(rnd.randint(1, 5))] * rnd.randint(1, 7)
        elif words:
            at = rnd.randrange(len(words))
            words += words[at : at + rnd.randint(1, 40)]
    return [w.encode() for w in words]


@pytest.mark.parametrize("exponent,least", [(2, 2), (2, 6), (3, 6), (4, 6), (5, 12)])
def test_all_runs(exponent, least):
    for seed in range(300):
        several = [texts(seed * 10 + k) for k in range(seed % 4)]
        assert periodic.text_runs(several, least, exponent) == [plain_runs(w, least, exponent) for w in several]


def test_runs_inside_a_block_are_copied():
    run = [b"x", b"y"] * 4
    words = [b"p", b"q", *run, b"q", b"p"]
    assert periodic.text_runs([words * 2 + [b"z"] + words])[0] == [(2, 8, 2), (14, 8, 2), (27, 8, 2)] == plain_runs(words * 2 + [b"z"] + words)


def test_long_text():
    words = [b"a"] * 50_000 + [b"b"] + [b"c", b"d", b"e"] * 20_000
    assert periodic.text_runs([words]) == [[(0, 50_000, 1), (50_001, 60_000, 3)]]


def test_strongest():
    assert periodic.strongest([]) is None
    assert periodic.strongest([(0, 8, 2), (3, 9, 2), (20, 18, 4)]) == (3, 9, 2)
    big = 10**17
    assert periodic.strongest([(0, 4 * big + 1, big), (9, 4 * big + 4, big + 1)]) == (0, 4 * big + 1, big)


def test_odd_rows_and_clashing_columns(spark, odd, docs):
    rows = odd.withColumnRenamed("lang", "runs").withColumnRenamed("source", "collapsed")
    got = {(r.doc_id, r.n_words, len(r.runs)) for r in periodic.periodic_runs(rows).collect()}
    assert (1, 0, 0) in got and (8, 12_000, 1) in got and (None, 0, 0) in got
    assert periodic.periodic_runs(rows).count() == odd.count()
    assert periodic.periodic_runs(docs([])).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs([]), exponent=1)


def test_query(spark, sample, tmp_path, docs):
    df, rows = sample
    odd = [(i, " ".join(w.decode() for w in texts(i))) for i in range(1000, 1100)] + [(5, None), (None, "a b"), (7, "w " * 40)] * 2
    df.select("doc_id", "text").union(docs(odd).select("doc_id", "text")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_runs(spark, str(tmp_path)).collect()
    want = [plain_row(i, t) for i, t in [(r[0], r[1]) for r in rows] + odd]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(r.n_runs for r in got) > 50
