import zlib

from loamworks.llm.queries import op6_sharding
from loamworks.llm.sharding import balanced_map, copy_numbers, even_map, grown_map, load_map, map_table, shard_by_bytes, sized, store_map

from .conftest import ODD


def test_query_is_balanced_and_whole(spark, sample):
    rows = op6_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r[0]: (r[1] or "").encode() for r in sample[1]}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "bytes", None)
    loads = {}
    for k in range(24):
        held = sorted(r.slot for r in rows if r.shard == k)
        assert held == list(range(len(held)))
        loads[k] = sum(r["size"] for r in rows if r.shard == k)
    assert max(loads.values()) < 1.05 * min(loads.values())


def test_odd_texts(odd, docs):
    rows = shard_by_bytes(odd, 3).collect()
    assert len(rows) == len(ODD)
    assert sorted((r["size"]) for r in rows) == sorted(len((t or "").encode()) + 8 for _, t in ODD)
    for k in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert shard_by_bytes(docs([]), 3).count() == 0


def test_same_rows_same_places(docs):
    df = docs([(i, "t" * (i % 50)) for i in range(500)]).withColumnsRenamed({"lang": "shard", "source": "virtual_slot", "n_chars": "size"})
    a, b = (sorted(map(tuple, shard_by_bytes(x, 5).collect())) for x in (df, df.repartition(7)))
    assert a == b


def test_map_versions_and_growth(spark, tmp_path):
    path = f"file://{tmp_path}/maps"
    first, load = even_map(64, 4), {s: 10 + s % 7 for s in range(64)}
    grown = grown_map(first, load, 4)
    assert all(b in (a, 4) for a, b in zip(first, grown))
    total = [sum(load[s] for s in load if grown[s] == k) for k in range(5)]
    assert abs(total[4] - sum(load.values()) / 5) <= 17
    store_map(map_table(spark, first), path, 0)
    store_map(map_table(spark, grown), path, 1)
    read = lambda v=None: [r.shard for r in load_map(spark, path, v).orderBy("virtual_slot").collect()]
    assert read() == grown and read(0) == first


def test_repeated_rows_spread(docs):
    """A row that stands 3000 times is no burden of one shard; the copies have places of their own."""
    df = docs([(i, "word " * (i % 90)) for i in range(2000)] + [(7, "x" * 800)] * 3000).repartition(6)
    rows = shard_by_bytes(df, 8).collect()
    loads = [sum(r["size"] for r in rows if r.shard == k) for k in range(8)]
    assert len(rows) == 5000 and max(loads) < 1.05 * min(loads)
    for k in range(8):
        held = sorted(r.slot for r in rows if r.shard == k)
        assert held == list(range(len(held)))
    same = sorted(map(tuple, shard_by_bytes(df.repartition(3), 8).collect()))
    assert sorted(map(tuple, rows)) == same


def test_copies_are_numbered_without_gaps(spark, docs):
    df = docs([(None, None)] * 5 + [(1, "a")] * 40 + [(1, "b")] * 3 + [(2, "a")]).repartition(7)
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/copies")
    sized(spark.read.parquet(path)).write.mode("overwrite").parquet(path + "-sized")
    groups = {}
    for r in copy_numbers(spark.read.parquet(path + "-sized")).collect():
        groups.setdefault((r.doc_id, r.text_crc32), []).append(r.copy)
    assert sorted(map(len, groups.values())) == [1, 3, 5, 40]
    assert all(sorted(c) == list(range(len(c))) for c in groups.values())


def test_map_against_a_plain_one():
    """Moves and swaps between the fullest and the emptiest shard, found by trying every pair."""
    first, load = even_map(24, 3), {s: (s * 7919) % 53 for s in range(24)}
    plain = list(first)
    while True:
        total = [sum(load[s] for s in load if plain[s] == k) for k in range(3)]
        full, thin = total.index(max(total)), total.index(min(total))
        gap, gains = total[full] - total[thin], []
        for s in (s for s in load if plain[s] == full and load[s]):
            for t in [None, *(t for t in load if plain[t] == thin and load[t])]:
                moved = load[s] - (load[t] if t is not None else 0)
                if 0 < moved < gap:
                    gains.append((min(moved, gap - moved), s, t))
        if not gains:
            break
        _, s, t = max(gains, key=lambda g: g[0])
        plain[s] = thin
        if t is not None:
            plain[t] = full
    got = balanced_map(first, load, 3)
    sums = lambda m: sorted(sum(load[s] for s in load if m[s] == k) for k in range(3))
    assert max(sums(got)) - min(sums(got)) <= max(1, max(sums(plain)) - min(sums(plain)))
