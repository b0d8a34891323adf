import random

import numpy as np

from loamworks.llm.components import connected_components
from loamworks.llm.common import stored
from loamworks.llm.near_dedup import drop_near_copies, jaccard, most_alike, near_groups, shingle_map, with_values

from .conftest import ODD


def components(rows, similarity=0.8):
    """Smallest id reachable, pair by pair, of texts near another."""
    rows = [(d, t or "") for d, t in rows]
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    near = set()
    for i, (d, s) in enumerate(rows):
        for e, t in rows[:i]:
            if s.split() and t.split() and jaccard(s, t, 5) >= similarity:
                a, b = sorted((find(d), find(e)))
                root[b] = a
                near |= {d, e}
    return {d: find(d) for d in near}


def copies(rng, words, n, edits, first):
    out = []
    for k in range(n):
        w = list(words)
        for i in rng.sample(range(len(w)), edits):
            w[i] = f"e{rng.random()}"
        out.append((first + k, " ".join(w)))
    return out


def test_groups_of_near_copies(docs):
    rng = random.Random(11)
    rows = []
    for g in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 300))]
        rows += copies(rng, words, rng.randrange(1, 5), max(1, len(words) // 100), 10 * g)
    want, have = components(rows), {r.doc_id: r.component_id for r in near_groups(docs(rows)).collect()}
    assert set(have) <= set(want)
    assert sum(have.get(d) == c for d, c in want.items()) >= 0.95 * len(want)


def test_crowd_round_an_original_that_isnt_first(docs):
    """Hundreds of copies, each near the original but hardly near each other."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(230)]
    rows = copies(rng, words, 150, 4, 0) + [(1000, " ".join(words))] + [(2000 + i, " ".join(f"x{rng.random()}" for _ in range(50))) for i in range(20)]
    want = components(rows)
    have = {r.doc_id: r.component_id for r in near_groups(docs(rows)).collect()}
    assert sum(have.get(d) == c for d, c in want.items()) >= 0.99 * len(want) and set(have) <= set(want)


def test_rows_that_stay(docs, odd, sample):
    text = " ".join(f"w{i}" for i in range(100))
    df = docs([(3, text), (1, text.upper()), (2, text + " more"), (None, text), (4, "other words"), (5, None), (6, "")]).withColumnsRenamed({"n_chars": "component_id", "lang": "key", "source": "a"})
    out = drop_near_copies(df)
    assert out.columns == df.columns and sorted(str(r.doc_id) for r in out.collect()) == ["1", "4", "5", "6", "None"]
    # 4 and 5 (twice) have one text, so both rows of 5 go.
    assert drop_near_copies(odd).count() == len(ODD) - 2
    assert near_groups(docs([])).count() == 0
    rows = [r[:2] for r in sample[1]]
    assert {r.doc_id: r.component_id for r in near_groups(sample[0]).collect()} == components(rows)


def test_changes_in_one_place(docs):
    """Ends appended or cut and runs replaced, at a similarity from 0.8 to 0.9."""
    rng, rows = random.Random(13), []
    for g in range(240):
        n = rng.choice((14, 60, 250, 600))
        words = [f"w{rng.random()}" for _ in range(n)]
        k, at = max(1, int((n - 4) * rng.uniform(0.1, 0.24))), rng.randrange(n // 4, n // 2)
        more = [f"m{rng.random()}" for _ in range(k)]
        copy = (words + more, words[:-k], words[:at] + more[: k // 2] + words[at + k // 2 :])[g % 3]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
    want = {d: 2 * (d // 2) for (d, s), (e, t) in zip(rows[::2], rows[1::2]) if jaccard(s, t, 5) >= 0.8 for d in (d, e)}
    assert len(want) > 200
    assert {r.doc_id: r.component_id for r in near_groups(docs(rows)).collect()} == want


def test_crowds_of_copies_of_copies(docs):
    """Each text is a copy of any text before it, far from the first one; with others that share a line with all."""
    rng, line = random.Random(14), [f"l{i}" for i in range(30)]
    for n in (100, 300):
        group = [[f"w{n}-{i}" for i in range(120)] + line]
        while len(group) < n:
            w = list(rng.choice(group))
            for i in rng.sample(range(120), rng.randrange(2, 5)):
                w[i] = f"e{rng.random()}"
            group.append(w)
        rows = [(d, " ".join(w)) for d, w in enumerate(group)] + [(5000 + i, " ".join(line + [f"x{rng.random()}" for _ in range(rng.randrange(1, 20))])) for i in range(40)]
        assert {r.doc_id: r.component_id for r in near_groups(docs(rows)).collect()} == components(rows)


def test_repeated_ids_with_other_texts(docs):
    """(2, near V) goes, (2, U) stays, and so does U's copy of a smaller id; repeated rows of a document go together."""
    rng = random.Random(15)
    text = lambda: [f"w{rng.random()}" for _ in range(100)]
    v, u, w = text(), text(), text()
    rows = [(1, " ".join(v)), (2, " ".join([*v, "x"])), (2, " ".join(u)), (3, " ".join([*u, "y"])), (4, " ".join(w)), (4, " ".join(w).upper()), (5, " ".join(w)), (5, " ".join(w)), (None, " ".join(v)), (6, None), (6, "")]
    df = docs(rows)
    out = drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in out.collect()) == sorted((str(d), t or "") for d, t in (rows[0], rows[2], rows[4], rows[5], rows[8], rows[9], rows[10]))
    assert sorted((r.doc_id, r.component_id) for r in near_groups(df).collect()) == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (5, 4)]


def test_string_ids(docs):
    from pyspark.sql import functions as F

    text = " ".join(f"w{i}" for i in range(60))
    df = docs([(1, text), (2, text + " x"), (3, "other words here")]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert sorted(r.doc_id for r in drop_near_copies(df).collect()) == ["d1", "d3"]


def test_pairs_of_hubs_meet_their_texts(spark):
    """Pairs of ids that have very many get the same texts as by a plain lookup, whichever end the hub is, and none is lost."""
    pairs = [(5, n) for n in range(6, 700)] + [(n, 900) for n in range(1, 600)] + [(1, 2), (3, 4), (701, 702)]
    texts = spark.createDataFrame([(n, f"text {n}") for n in range(1000)], "doc_id long, value string")
    stored_pairs = stored(spark.createDataFrame(pairs, "a long, b long"))
    got = sorted((r.a, r.b, *sorted((r.x, r.y))) for r in with_values(stored_pairs, texts).collect())
    assert got == sorted((a, b, *sorted((f"text {a}", f"text {b}"))) for a, b in pairs)
    assert with_values(stored_pairs.limit(0), texts).count() == 0


def test_maps_bound_the_similarity():
    """The bound is never below the similarity, and near it for sets that differ much."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        n, m = rng.integers(1, 900, 2)
        pool = rng.integers(0, 1 << 63, n + m).astype(np.uint64)
        common = int(rng.integers(0, min(n, m) + 1))
        x, y = np.unique(pool[:n]), np.unique(np.r_[pool[:common], pool[n : n + m - common]])
        exact = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        bound = most_alike(shingle_map(x), shingle_map(y))
        assert exact - 1e-12 <= bound <= 1
        if n == m and n > 100 and exact < 0.5:
            assert bound < 0.8
    few = np.arange(5, dtype=np.uint64) << np.uint64(20)
    assert most_alike(shingle_map(few), shingle_map(few)) == 1 and most_alike(shingle_map(few), shingle_map(few + np.uint64(7 << 20))) == 0


def test_stray_pairs_come_from_one_block(spark):
    """Two families in blocks of three shared shingles: each pair of strays and others once, not for each block."""
    from loamworks.llm.near_dedup import stray_pairs

    ids = list(range(40))
    crowded = spark.createDataFrame([(k, i, 100, at) for i in ids for at, k in enumerate((11, 12, 13))], "key long, id long, size int, at int")
    centres = spark.createDataFrame([(k, 0) for k in (11, 12, 13)], "key long, centre long")
    stars = spark.createDataFrame([(0, i, 0.1 if i < 30 else 0.25, 0.1 if i < 30 else 0.25) for i in ids[1:]], "a long, b long, near double, far double")
    nodes = spark.createDataFrame([(i, 0) for i in range(30)], "node long, component long")
    found = stray_pairs(crowded, centres, stars, nodes, 0.8)
    assert sorted(map(tuple, found.collect())) == sorted((i, j) for i in ids[1:] for j in range(30, 40) if i < j)  # too far from the centre to be near it
    assert "array_intersect" in found._jdf.queryExecution().optimizedPlan().toString()


def test_linked_fingerprints_meet(spark, docs):
    from loamworks.llm.near_dedup import print_pairs

    words = [f"w{i}" for i in range(400)]
    df = docs([(1, " ".join(words)), (2, " ".join(words).upper()), (3, " ".join([*words, "more"])), (4, "other words here"), (5, "")]).select("doc_id", "text")
    got = {tuple(r) for r in print_pairs(df, df.where("doc_id < 5").select("doc_id")).collect()}
    assert (1, 2) in got and not any(4 in p or 5 in p for p in got)


def test_links_take_few_jobs(spark, monkeypatch):
    """Each job leaves plans and code in the driver: few edges are linked in a few jobs, however long their paths are."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, None), (7, 7), (600, 600)], "a int, b int").coalesce(2)
    written, write = [], type(edges.write).parquet
    monkeypatch.setattr(type(edges.write), "parquet", lambda self, *a, **k: written.append(a) or write(self, *a, **k))
    assert connected_components(edges).where("component = 0").count() == 301 and len(written) <= 3
    assert connected_components(edges.where("a > 500")).count() == 0


def test_strays_meet_without_a_row_for_a_pair(docs, monkeypatch):
    """Copies of copies, most too far from the original: pairs that become rows grow with the texts, and components are exact in parts too."""
    from loamworks.llm import near_dedup

    monkeypatch.setattr(near_dedup, "LEAST_TEXTS", 50, raising=False)
    rng, met, compared = random.Random(16), [], near_dedup.compared

    def counted(pairs, *rest):
        pairs = stored(pairs)
        met.append(pairs.count())
        return compared(pairs, *rest)

    monkeypatch.setattr(near_dedup, "compared", counted)
    group = [[f"w{i}" for i in range(150)]]
    while len(group) < 400:
        w = list(rng.choice(group))
        for i in rng.sample(range(150), rng.randrange(3, 6)):
            w[i] = f"e{i}"
        group.append(w)
    rows = [(d, " ".join(w)) for d, w in enumerate(group)]
    want = components(rows)
    assert {r.doc_id: r.component_id for r in near_groups(docs(rows)).collect()} == want and 2 < len(set(want.values()))
    assert sum(met[3:]) < len(rows)  # after the links by fingerprints, with centres and in small blocks


def test_phrases_that_a_sample_misses_crowd_no_block(docs, monkeypatch):
    """Phrases of some twenty texts are seldom in a sample of one in sixteen; texts that share them still meet in no crowded block."""
    from loamworks.llm import near_dedup

    monkeypatch.setattr(near_dedup, "SAMPLE_ROWS", 1)
    crowds, links = [], near_dedup.stray_links
    monkeypatch.setattr(near_dedup, "stray_links", lambda crowd, *rest: crowds.append(crowd.count()) or links(crowd, *rest))
    rng = random.Random(17)
    phrases = [[f"p{k}-{i}" for i in range(9)] for k in range(75)]
    texts = [[w for k in rng.sample(range(75), 5) for w in [*phrases[k], *(f"x{rng.random()}" for _ in range(50))]] for _ in range(300)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)] + [(1000 + i, " ".join(texts[i] + ["more"] * i)) for i in range(20)]
    assert {r.doc_id: r.component_id for r in near_groups(docs(rows)).collect()} == components(rows)
    assert crowds[0] < len(rows) // 4
