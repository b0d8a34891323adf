import itertools
import zlib

import numpy as np

from loamworks.llm.queries import op7_toxicity
from loamworks.llm.toxicity import Scorer, chain, drop_toxic, features, fit, gradient, marginals, offending, score, train

from .conftest import ODD


def brute(emission, change, first):
    """Marginals by every tag sequence."""
    n = len(emission)
    total, hit = 0.0, np.zeros(n)
    for tags in itertools.product((0, 1), repeat=n):
        s = first * tags[0] + sum(e * t for e, t in zip(emission, tags)) + sum(change[a, b] for a, b in zip(tags, tags[1:]))
        total += np.exp(s)
        hit += np.exp(s) * np.array(tags)
    return hit / total


def test_marginals():
    rng = np.random.default_rng(1)
    change = rng.normal(size=(2, 2))
    rows = [rng.normal(size=n) * 2 for n in (5, 0, 1, 9, 5, 2)]
    for got, row in zip(marginals(rows, change, 0.3), rows):
        assert np.allclose(got, brute(row, change, 0.3) if len(row) else [])
    assert marginals([], change, 0.0) == []


def likelihood(tags, emission, change, first):
    """Log-likelihood of tags, by every tag sequence."""
    value = lambda y: first * y[0] + sum(e * t for e, t in zip(emission, y)) + sum(change[a, b] for a, b in zip(y, y[1:]))
    return value(tags) - np.log(sum(np.exp(value(y)) for y in itertools.product((0, 1), repeat=len(tags))))


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(6)
    change, first = rng.normal(size=(2, 2)), 0.4
    rows = [rng.normal(size=n) * 2 for n in (6, 1, 4, 7)]
    tags = [rng.random(len(r)) < 0.5 for r in rows]
    total = lambda rows, change, first: sum(likelihood(t.astype(int).tolist(), r, change, first) for t, r in zip(tags, rows))
    tokens, pairs, begin = gradient([*tags, np.zeros(0, bool)], [*rows, np.zeros(0)], change, first)
    step = 1e-5
    for a, b in itertools.product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[a, b] = step
        assert abs((total(rows, change + d, first) - total(rows, change - d, first)) / (2 * step) - pairs[a, b]) < 1e-5
    assert abs((total(rows, change, first + step) - total(rows, change, first - step)) / (2 * step) - begin) < 1e-5
    at = 0
    for k, r in enumerate(rows):
        for i in range(len(r)):
            moved = [[x.copy() for x in rows] for _ in range(2)]
            moved[0][k][i] += step
            moved[1][k][i] -= step
            assert abs((total(moved[0], change, first) - total(moved[1], change, first)) / (2 * step) - tokens[at]) < 1e-5
            at += 1
    assert abs(chain(rows, change, first, pairs=True)[1].sum() - sum(len(r) - 1 for r in rows)) < 1e-9


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.1"
    rows = op7_toxicity(spark, base).join(spark.read.parquet(f"{base}/labels.parquet"), "doc_id").where("held_out").select("doc_id", "predicted", "toxic", "score").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    bad, good = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in bad) >= 0.8 * len(bad) and sum(r.predicted for r in good) <= 0.02 * len(good)


def small_model():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(50)]
    texts, labels = [], []
    for i in range(200):
        text = list(rng.choice(words, 20))
        if i % 4 == 0:
            text[7] = "nasty"
        texts.append(" ".join(text))
        labels.append(int(i % 4 == 0))
    return fit(texts, labels)


def test_fitted_chain_and_emissions():
    model = small_model()
    assert model.first != 0 and model.change.any()
    assert all(np.isclose(Scorer(model.dump()).emission(w), model.weights[list(features(w))].sum()) for w in ("nasty", "w1", "ä", "other"))


def test_spans_and_filter(docs, odd):
    model = small_model()
    rows = {r.doc_id: r for r in score(docs([(1, "w1 İ Nasty, w2"), (2, "w1 w2"), (3, None)]), model).collect()}
    assert [(s.start, s.end) for s in rows[1].spans] == [(5, 10)] and rows[1].score > 0.5
    assert rows[2].spans == rows[3].spans == [] and rows[2].score < 0.5 and 0 <= rows[3].score <= 1
    df = docs([(1, "w1 nasty"), (2, "w2 w1"), (3, None)]).withColumnRenamed("source", "score")
    assert sorted(r.doc_id for r in drop_toxic(df, model).collect()) == [2, 3] and drop_toxic(df, model).columns == df.columns
    assert score(odd, model).count() == len(ODD) and score(docs([]), model).count() == 0
    assert offending("a b", np.array([0.9, 0.8])) == [{"start": 0, "end": 3}]


def test_no_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = train(docs(ODD), none)
    assert all(0 <= r.score <= 1 for r in score(docs(ODD), model).collect())
    one = spark.createDataFrame([(4, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    assert score(docs(ODD), train(docs(ODD), one)).count() == len(ODD)
