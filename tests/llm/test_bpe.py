import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from loamworks.llm.bpe import WordBpe, bpe_decode, bpe_encode
from loamworks.llm.queries import op1_bpe

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(texts):
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    ids = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def test_odd_texts(odd, spark):
    ids, texts = expected([t for _, t in ODD])
    got = bpe_encode(odd, PATH, decoded=True).collect()
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == sorted((str(i), x, y) for (i, _), x, y in zip(ODD, ids, texts))
    back = bpe_decode(bpe_encode(odd, PATH), PATH).collect()
    assert sorted(r.decoded for r in back) == sorted(texts)


def test_special_and_repeated_symbols():
    with open(PATH) as f:
        coder = WordBpe(f.read())
    texts = ["aaaa aaaaa " + "a" * 999, "<|endoftext|>x<|startoftext|> <|endoftext", "can't WE'LL 'S", "12 ③ ⅻ", "İI", "Σίσυφος ΟΔΟΣ", "\x00\x1c\x85", "abab" * 300]
    ids, decoded = expected(texts)
    flat, bounds = coder.encode(texts)
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == ids
    assert coder.decode(flat, bounds) == decoded
    assert coder.decode(np.array([5, 10**6, -1]), np.array([0, 3])) == [coder.tokens[5]]


def test_query(spark, sample):
    rows = sample[1]
    ids, texts = expected([r[1] for r in rows])
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {r[0]: (len(i), digest(" ".join(map(str, i))), digest(t)) for r, i, t in zip(rows, ids, texts)}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_other_columns_and_no_rows(docs):
    df = docs([(1, "a b")]).withColumnsRenamed({"n_chars": "ids", "lang": "decoded"})
    assert bpe_encode(df, PATH, decoded=True).count() == 1
    assert bpe_encode(docs([]), PATH).collect() == []
