import random

import xxhash

from loamworks.llm.common import BATCH_SETTING, spread_join
from loamworks.llm.components import connected_components
from loamworks.llm.queries import op2_simhash
from loamworks.llm.simhash import near_components, near_links, signed, simhash

from .conftest import ODD


def plain(text, size=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, distance):
    """The smallest id reachable from each position, pair by pair."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(prints))]


def linked(spark, prints, **kw):
    df = spark.createDataFrame([(d, signed(f)) for d, f in prints], "doc_id long, fingerprint long")
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in near_components(df, **kw).collect())


def wanted(prints, distance=2):
    return sorted((str(d), signed(f), str(c)) for (d, f), c in zip(prints, groups(prints, distance)))


def test_fingerprints(odd, docs):
    got = sorted((str(r.doc_id), r.fingerprint) for r in simhash(odd).collect())
    assert got == sorted((str(d), signed(plain(t))) for d, t in ODD)
    assert simhash(docs([])).count() == 0


def test_query(spark, sample):
    prints = [(r[0], plain(r[1])) for r in sample[1]]
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in op2_simhash(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted((str(d), f"{f:016x}", str(c)) for (d, f), c in zip(prints, groups(prints, 2)))


def test_chains_and_large_blocks(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(5)]
    prints = [(i, b) for i, b in enumerate(base)] + [(10, 0), (11, 0), (None, 0), (None, base[0] ^ 7 << 40)]
    for k in range(300):  # a crowd round one fingerprint, some of them three or more bits off
        f = base[1]
        for b in rng.sample(range(64), rng.randint(1, 4)):
            f ^= 1 << b
        prints.append((100 + k, f))
    f = base[2]
    for k in range(30):  # a chain
        f ^= 3 << (2 * k)
        prints.append((900 - k, f))
    assert linked(spark, prints) == wanted(prints)
    assert linked(spark, prints[:60], distance=1, blocks=3) == wanted(prints[:60], 1)
    assert linked(spark, prints[:60], distance=3, blocks=5) == wanted(prints[:60], 3)
    assert linked(spark, prints[:20], distance=0, blocks=1) == wanted(prints[:20], 0)
    assert linked(spark, []) == []


def test_links_stay_in_proportion(spark):
    """A crowd in one block makes no pair of every two."""
    values = [(signed(1 << a | 1 << b),) for a in range(64) for b in range(a)]
    links = near_links(spark.createDataFrame(values, "v long"), 2, 4).count()
    assert links < 65 * len(values)


def test_components(spark):
    edges = [(1, 2), (2, 1), (3, 3), (None, 4), (5, 6), (6, 7), (8, 7), (2, 9)]
    got = dict(connected_components(spark.createDataFrame(edges, "x long, y long")).collect())
    assert got == {1: 1, 2: 1, 9: 1, 5: 5, 6: 5, 7: 5, 8: 5}


def test_hot_keys_are_dealt(spark):
    """A star with most of the edges, and rows of one fingerprint: joins of hot keys lose and repeat nothing."""
    edges = [(0, k) for k in range(1, 2000)] + [(5000 + k, 5001 + k) for k in range(5)] + [(1999, 7000)]
    got = dict(connected_components(spark.createDataFrame(edges, "x long, y long")).collect())
    assert got == {**{k: 0 for k in range(2000)}, 7000: 0, **{5000 + k: 5000 for k in range(6)}}
    rows = spark.createDataFrame([(k, 1 if k % 3 else None if k % 2 else k) for k in range(900)] + [(1, 1)] * 5, "id long, key long")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(0, 900)] + [(None, "none")], "key long, of string")
    plain = sorted(rows.join(table, "key").collect())
    assert sorted(spread_join(rows, table, "key", hot_rows=10).collect()) == plain
    assert sorted(spread_join(rows.withColumn("more", rows.id).select("key", "id"), table, "key", rows, hot_rows=50).collect()) == plain
    assert spread_join(rows.limit(0), table, "key").count() == 0


def test_crowd_of_one_fingerprint(spark):
    prints = [(k, 77) for k in range(1000, 3000)] + [(5, 76), (6, 1 << 40)]
    assert linked(spark, prints) == wanted(prints)


def test_batches_of_texts_are_bounded(docs):
    df = docs([(1, "a b c"), (2, None)])
    held = df.sparkSession.conf.get(BATCH_SETTING, None)
    df.sparkSession.conf.unset(BATCH_SETTING)
    try:
        assert simhash(df).count() == 2 and int(df.sparkSession.conf.get(BATCH_SETTING)) <= 1000
    finally:
        df.sparkSession.conf.set(BATCH_SETTING, held) if held else df.sparkSession.conf.unset(BATCH_SETTING)
