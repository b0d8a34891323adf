import zlib

import numpy as np

from loamworks.llm.langid import BITS, BUCKETS, FACTOR, SCALE, Leader, Model, Scorer, Words, document_frequency, fit, grams, identify, softmax, temperature_for, train
from loamworks.llm.queries import op10_langid

from .conftest import ODD


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    rows = op10_langid(spark, base).join(spark.read.parquet(f"{base}/documents.parquet"), "doc_id").collect()
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    right = sum(r.lang == r.lang_pred for r in out) / len(out)
    assert right >= 0.98
    assert abs(sum(r.score for r in out) / len(out) - right) < 0.05


def test_document_frequency(odd, docs):
    total, seen = document_frequency(odd.select("text"))
    want = np.zeros(BUCKETS, int)
    for _, t in ODD:
        want[list(set(plain_grams(t or "")))] += 1
    assert total == len(ODD) and (seen == want).all()
    assert document_frequency(docs([]).select("text"))[0] == 0


def test_odd_texts(odd, docs):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("aba bab", "x"), ("cdc dcd", "y"), ("abab ba", "x"), ("dcdc cd", "y")] * 20)]
    df = docs([*rows, (900, None, "x", "s", 0), (901, "aba", None, "s", 0)])
    model = train(df)
    got = {r.doc_id: r for r in identify(df.withColumnRenamed("source", "lang_pred"), model).collect()}
    assert got[0].lang_pred == got[901].lang_pred == "x" and got[1].lang_pred == "y" and got[900].lang_pred == "und" and got[900].score == 0
    out = identify(odd, model).collect()
    assert len(out) == len(ODD) and all(r.lang_pred == "und" for r in out if r.doc_id in (1, 2, 3))
    assert identify(docs([]), model).count() == 0


def test_nothing_to_learn_from(docs, odd):
    none = train(docs([]))
    assert {r.lang_pred for r in identify(odd, none).collect()} == {"und"}
    one = fit(["aa", "ab"], ["x", "x"], np.ones(BUCKETS))
    assert {(r.lang_pred, r.score) for r in identify(docs([(1, "aa")]), one).collect()} == {("x", 1.0)}


def plain_grams(text):
    """Buckets of the n-grams of each run of letters, one by one."""
    out, word, factor, whole = [], "", int(FACTOR), 2**64
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            w = f"_{word}_"
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    x = 0
                    for g in w[i : i + n]:
                        x = (x * factor + ord(g) + 1) % whole
                    out.append((x ^ (x >> 31)) * factor % whole >> (64 - BITS))
            word = ""
    return out


def test_grams_one_by_one(sample):
    texts = [t or "" for _, t in ODD] + [r[1] for r in sample[1][:40]] + ["x² ½ ① Ⅷ a1b_c", "١٢٣ 四 ª"]
    store = Words(grams)
    for t, words in zip(texts, store.of(texts)):
        assert sorted(np.frombuffer(store.joined(words), "<u2").tolist()) == sorted(plain_grams(t))


def test_no_letter_is_undetermined(docs):
    numbers = ["²", "½", "①", "Ⅷ", "٣ 42", "_ #", "\u0301"]
    assert not any(Words(grams).of(numbers))
    model = fit(["aba", "cdc"] * 10, ["x", "y"] * 10, np.ones(BUCKETS))
    rows = identify(docs(list(enumerate([*numbers, "a²"]))), model).collect()
    assert {r.doc_id: r.lang_pred for r in rows} == {**dict.fromkeys(range(len(numbers)), "und"), len(numbers): "x"}


def test_a_step_number_by_number():
    """The update of each weight by its formula, with plain floats."""
    rng = np.random.default_rng(3)
    alpha, beta, l1, l2 = 0.5, 0.1, 0.05, 0.02
    leader = Leader(4, 3, alpha, beta, l1, l2)
    z, n, w = ([[0.0] * 3 for _ in range(4)] for _ in range(3))
    for _ in range(5):
        x, of = rng.normal(size=(6, 4)), rng.integers(0, 3, 6)
        leader.step(x, of)
        g = [[0.0] * 3 for _ in range(4)]
        for row, y in zip(x, of):
            scores = [np.exp(sum(row[i] * w[i][k] for i in range(4))) for k in range(3)]
            for i in range(4):
                for k in range(3):
                    g[i][k] += row[i] * (scores[k] / sum(scores) - (k == y)) / 6
        for i in range(4):
            for k in range(3):
                z[i][k] += g[i][k] - ((n[i][k] + g[i][k] ** 2) ** 0.5 - n[i][k] ** 0.5) / alpha * w[i][k]
                n[i][k] += g[i][k] ** 2
                sign = 1 if z[i][k] > 0 else -1
                w[i][k] = 0.0 if abs(z[i][k]) <= l1 else -(z[i][k] - sign * l1) / ((beta + n[i][k] ** 0.5) / alpha + l2)
        assert np.allclose(leader.w, w, atol=1e-4)


def test_temperature_and_scores():
    rng = np.random.default_rng(4)
    logits = rng.normal(size=(400, 3)) * 6
    of = np.array([rng.choice(3, p=p) for p in softmax(logits / 2.5)])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(400), of]).mean()
    found = temperature_for(logits, of)
    assert all(loss(found) <= loss(t) + 1e-6 for t in np.exp(np.linspace(-2.9, 2.9, 200)))
    model = Model(["x", "y"], rng.normal(size=(BUCKETS, 2)).astype(np.float32), np.array([0.1, -0.2]), 1.7)
    for text in ("abc de abc", "ä"):
        g = plain_grams(text)
        want = (SCALE * sum(model.weights[b].astype(float) for b in g) / len(g) + model.bias) / 1.7
        assert np.allclose(Scorer(model.dump()).logits([text])[0], want, rtol=1e-4)
