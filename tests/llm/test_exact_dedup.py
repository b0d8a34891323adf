import hashlib
import re

from loamworks.llm.exact_dedup import digests, drop_copies, exact_groups, merged

from .conftest import ODD


def plain(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out, stay = [], set()
    for (doc, _), t in zip(rows, norm):
        same = [d for (d, _), u in zip(rows, norm) if u == t]
        keep = min((d for d in same if d is not None), default=None)
        out.append((str(doc), str(keep), len(same), doc == keep and t not in stay, hashlib.sha256(t.encode()).hexdigest()))
        stay |= {t} if doc == keep else set()
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in exact_groups(df).collect())


def test_odd_texts(odd):
    assert got(odd) == plain(ODD)


def test_white_space_and_ties(docs):
    rows = [(i, t) for i, t in enumerate(["a b", "a  b", "a\tb", "a \n b", " a b", "a b ", "a\x0b\x0cb", "a b", "A b"] * 3)]
    assert got(docs(rows)) == plain(rows)
    assert got(docs([])) == []


def test_rows_that_stay(docs):
    rows = [(3, "x y"), (1, "x  y"), (2, "z"), (2, "z"), (2, "w"), (None, None), (None, ""), (4, "q")]
    kept = sorted((str(r.doc_id), r.text) for r in drop_copies(docs(rows)).collect())
    assert [(i, t or "") for i, t in kept] == [("1", "x  y"), ("2", "w"), ("2", "z"), ("4", "q"), ("None", "")]
    plain_rows = docs([(1, "a"), (2, "a"), (3, None)])
    assert sorted(r.doc_id for r in drop_copies(plain_rows).collect()) == [1, 3]
    assert drop_copies(plain_rows).columns == plain_rows.columns
    assert drop_copies(docs([])).count() == 0


def test_hot_group_and_clashing_names(docs):
    rows = [(i, "same" if i % 3 else f"own {i}") for i in range(600)]
    df = docs(rows).withColumnsRenamed({"n_chars": "run", "lang": "kept", "source": "digest"})
    assert got(df) == plain(rows)


def test_tied_rows_and_hot_ids(docs):
    """Rows that repeat an id and a text count as copies of each other; one id on many rows."""
    rows = [(7, "a b")] * 5 + [(8, "a  b")] * 3 + [(9, f"t{i}") for i in range(300)] + [(None, "z")] * 2
    df = docs(rows)
    assert got(df) == plain(rows)
    kept = {(r.doc_id, r.text) for r in drop_copies(df).collect()}
    assert len(kept) == drop_copies(df).count() == sum(k for *_, k, _ in plain(rows))


def test_every_level_is_sorted(docs, sample):
    """What a task holds after the last round is a stretch of the sorted digests, and the tasks' stretches are in order of parts."""
    for fan in (2, 8):
        rows = digests(sample[0], "doc_id", "text", 16)
        level = merged(rows, 16, fan)
        parts = [[bytes(r.digest) for r in p] for p in level.rdd.glom().collect()]
        assert all(p == sorted(p) for p in parts) and sum(map(len, parts)) == len(set().union(*parts))
    plan = level._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan
