"""Collocations against counting everything in plain Python, and against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from loamworks.llm import collocations, queries


def plain(rows, least, words=4, top=2000, covered=80, scale=2_000_000):
    counts, totals, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").encode().lower().decode()):
            ws = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(ws)
            for k in range(1, words + 1):
                counts[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    for lang, f in counts.items():
        found, gone = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, set()
        for p, a in found.items():
            inside = {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}
            gone |= {q for q in inside if 100 * a >= covered * found[q]}
        best = []
        for p, a in found.items():
            if p not in gone:
                score, cut = min((scale * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def texts(seed, n):
    rnd = random.Random(seed)
    fixed = ["New  York City is", "of the", "ÄÖ ß İ", "one two\tthree four five", "日本 語 語 語"]
    return [(rnd.choice(["en", "de", None]), "".join(rnd.choice(fixed + ["a", "b", "C"]) + rnd.choice([" ", " ", " ", ", ", "\n", ".", "\x0b"]) for _ in range(rnd.randint(0, 40)))) for _ in range(n)]


@pytest.fixture(scope="session")
def table(spark):
    return lambda rows: spark.createDataFrame(rows, "lang string, text string")


def result(df, **given):
    return sorted(map(tuple, collocations.collocations(df, **given).collect()))


@pytest.mark.parametrize("least,words,top,covered", [(5, 4, 2000, 80), (2, 3, 5, 50), (3, 5, 100, 100)])
def test_against_plain(table, least, words, top, covered):
    rows = texts(least, 120)
    got = result(table(rows).repartition(11), least=least, words=words, top=top, covered=covered)
    assert got == plain(rows, least, words, top, covered) and len(got) > 8


def test_many_shards_and_groups(table, monkeypatch):
    """More candidates than a shard or a group may hold: the same rows, by more passes."""
    monkeypatch.setattr(collocations, "SHARD_KEYS", 7)
    monkeypatch.setattr(collocations, "GROUP_SLOTS", 11)
    monkeypatch.setattr(collocations, "HELD_WORDS", 10)
    rows = texts(9, 100)
    assert result(table(rows), least=3) == plain(rows, 3)


def test_minimal_perfect_hash():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 1000, 50_000):
        keys = np.unique(rnd.integers(1, 1 << 63, n).astype(np.uint64))
        hashed = collocations.MinimalHash(keys)
        assert sorted(hashed.slots(keys).tolist()) == list(range(len(keys)))
        assert (hashed.keys[hashed.slots(keys)] == keys).all()
        other = np.setdiff1d(rnd.integers(1, 1 << 63, 1000).astype(np.uint64), keys)
        assert (hashed.slots(other) == -1).all()


def test_hash_with_a_rest(monkeypatch):
    monkeypatch.setattr(collocations.MinimalHash, "LEVELS", 2)
    keys = np.arange(1, 500, dtype=np.uint64)
    hashed = collocations.MinimalHash(keys)
    assert len(hashed.rest) and sorted(hashed.slots(keys).tolist()) == list(range(499))
    assert hashed.slots(np.array([0, 500, 1 << 60], np.uint64)).tolist() == [-1, -1, -1]


def test_words_with_equal_hashes_take_another_salt(spark):
    counts = spark.createDataFrame([("en", b"a", 3), ("en", b"b", 4), ("de", b"a", 1)], "lang string, word binary, n long")
    keyed, salt = collocations.keyed_words(counts)
    got = {(r.lang, bytes(r.word)): r.key & (1 << 64) - 1 for r in keyed.collect()}
    assert salt == 0 and got == {(lang, w): collocations.word_key(0, lang)(w) for lang, w in got}


def test_tree_sum(spark):
    rows = [(b, p, np.array([p, b], np.int64).tobytes()) for p in range(77) for b in range(3)]
    got = collocations.tree_sum(spark.createDataFrame(rows, "block long, part int, counts binary"), 77).collect()
    assert {r.block: np.frombuffer(r.counts, np.int64).tolist() for r in got} == {b: [77 * 38, 77 * b] for b in range(3)}


def test_large_counts_stay_exact(spark):
    """The score's product passes 64 bits."""
    n = 9_000_000_000_000_001
    q = f"cast({2_000_000} as decimal(20,0)) * cast({n}L as decimal(18,0)) div cast({n + 3}L as decimal(20,0))"
    assert spark.range(1).selectExpr(f"{q} AS x").first().x == 2_000_000 * n // (n + 3)


def test_odd_rows_and_clashing_columns(spark, odd, table):
    rows = odd.selectExpr("text", "CAST(NULL AS string) AS lang", "1 AS phrase", "2 AS n", "3 AS slot")
    got = result(rows, least=2)
    assert got == plain([(None, r.text) for r in odd.collect()], 2)
    assert result(table([])) == [] and result(table([("en", "a b")] * 3)) == []
    with pytest.raises(ValueError):
        collocations.collocations(rows, words=1)


def test_query(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    got = queries.op13_collocations(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(queries.OP13_SQL).fetchall())
