import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loamworks.llm.packing import ByteBpe, Capacity, pack, pieces, plan, ranges, sequences
from loamworks.llm.queries import op5_packing

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokens(texts):
    t = Tokenizer.from_file(PATH)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def check(rows, wanted, size=1024):
    """Every token of every document in one place, sequences gapless and none too long."""
    ends = defaultdict(list)
    seen = defaultdict(list)
    for r in rows:
        ends[r.sequence_id].append((r.offset, r.offset + r.length))
        seen[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for spans in ends.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= size and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    for doc, ids in wanted.items():
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(seen[doc])):
            assert (piece, start) == (k, at) and crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            assert length == size or k == 0
            at += length
        assert at == len(ids)
    assert set(seen) == set(wanted)
    return len(ends)


def test_query(spark, sample):
    wanted = dict(zip([r[0] for r in sample[1]], tokens([r[1] for r in sample[1]])))
    used = check(op5_packing(spark, "/root/testdata/sf0.001").collect(), wanted)
    least = -(-sum(map(len, wanted.values())) // 1024)
    assert used <= 1.02 * least + 1


def test_odd_texts(odd, docs):
    df = docs([(k, t) for k, (_, t) in enumerate(ODD)]).withColumnsRenamed({"lang": "piece", "source": "ids", "n_chars": "length"})
    packed = pack(df, PATH, ids=True)
    wanted = dict(enumerate(tokens([t for _, t in ODD])))
    check(packed.collect(), wanted)
    whole = sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == sum(map(len, wanted.values())) and all(len(r.ids) == sum(r.lengths) for r in whole)
    assert pack(odd, PATH).count() >= len(ODD)
    assert pack(docs([]), PATH).count() == 0
    assert pieces(docs([(1, "")]), PATH, end=None).count() == 0


def test_encoders_agree():
    with open(PATH) as f:
        coder = ByteBpe(f.read())
    texts = ["a <|endoftext|> b", "  x  \n\n y  <|endoftext|>", "İ'S can't \x1c\x85 ", "ab" * 5000, "日本 🎉"]
    assert [coder.encode(t).tolist() for t in texts] == [x[:-1] for x in tokens(texts)]


def test_plan_keeps_every_constraint():
    rng = random.Random(3)
    counts = {n: rng.randint(0, 40) for n in range(1, 101)}
    for capacity in (Capacity(100, 100, 10_000), Capacity(100, 3, 10_000), Capacity(100, 10, 3_000 + 7_000), Capacity(100, 5, 10_000, (1, 0.5, 0.5), "dot")):
        planned = plan(counts, capacity)
        held = defaultdict(int)
        for many, lengths in planned:
            assert sum(n * c for n, c in lengths) <= capacity.tokens
            assert sum(c for _, c in lengths) <= capacity.places and sum(n * n * c for n, c in lengths) <= capacity.attention
            for n, c in lengths:
                held[n] += many * c
        assert held == {n: c for n, c in counts.items() if c}
        covered = defaultdict(list)
        for n, a, b, *_ in ranges(planned):
            covered[n].append((a, b))
        for n, spans in covered.items():
            spans.sort()
            assert spans[0][0] == 0 and spans[-1][1] == counts[n] and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
    plain = sum(m for m, _ in plan(counts, Capacity(100, 100, 10_000)))
    assert plain <= 1.05 * sum(n * c for n, c in counts.items()) / 100


def test_plan_is_as_good_as_best_fit_one_by_one():
    rng = random.Random(5)
    items = sorted((rng.randint(1, 64) for _ in range(700)), reverse=True)
    free = []
    for n in items:
        fits = [(f, i) for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits)[1]] -= n
        else:
            free.append(64 - n)
    counts = {n: items.count(n) for n in set(items)}
    assert sum(m for m, _ in plan(counts, Capacity(64, 64, 4096))) == len(free)


def vector_best_fit(items, capacity):
    """Sequences, one piece after the other: of those that hold it under every capacity the one of the least residual norm."""
    whole, free = np.array([capacity.tokens, capacity.places, capacity.attention], float), []
    for n in items:
        demand = np.array([n, 1, n * n], float)
        fits = [(float((np.array(capacity.weights) * ((f - demand) / whole) ** 2).sum()), i) for i, f in enumerate(free) if (f >= demand).all()]
        if fits:
            free[min(fits)[1]] -= demand
        else:
            free.append(whole - demand)
    return free


def test_plan_is_as_good_as_vector_best_fit_one_by_one():
    """With documents and attention binding, too: sequences end for want of each of the three."""
    rng = random.Random(8)
    items = sorted((min(64, int(rng.expovariate(1 / 14)) + 1) for _ in range(900)), reverse=True)
    counts = {n: items.count(n) for n in set(items)}
    for capacity in (Capacity(64, 5, 4096), Capacity(64, 64, 4096), Capacity(64, 6, 4096, (1, 0.2, 3)), Capacity(80, 7, 4200)):
        free, planned = vector_best_fit(items, capacity), plan(counts, capacity)
        assert abs(sum(m for m, _ in planned) - len(free)) <= 0.01 * len(free)
    tight = [h for m, h in plan(counts, Capacity(80, 7, 4200))]
    assert any(sum(c for _, c in h) == 7 for h in tight)
    assert any(sum(n * c for n, c in h) < 80 and sum(n * n * c for n, c in h) > 4200 - 64 for h in tight)
