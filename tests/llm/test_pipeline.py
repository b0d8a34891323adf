import re

import corpus_pipeline
from loamworks.llm import secrets

from .test_packing import check, tokens

BASE = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns, toxic = docs.columns, {r.doc_id for r in spark.read.parquet(f"{BASE}/labels.parquet").where("toxic = 1").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, BASE).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns
            after = {r.doc_id: r.text for r in docs.collect()}
        gone = set(before) - set(after)
        if name == "toxicity":
            assert len(gone - toxic) <= 0.02 * len(before)
        elif name == "exact dedup":
            norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t) for d, t in before.items()}
            assert set(after) == {min(d for d in norm if norm[d] == t) for t in set(norm.values())}
        elif name == "near dedup":
            from .test_near_dedup import components

            assert gone == {d for d, c in components(sorted(before.items())).items() if d != c}
        elif name == "secrets":
            assert not gone and after == {d: secrets.without_secrets(t, "[REDACTED]") for d, t in before.items()}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        else:
            check(docs.collect(), dict(zip(before, tokens(before.values()))))


def test_run(spark):
    rows = corpus_pipeline.run(spark, BASE).collect()
    assert rows and all(r.length <= 1024 for r in rows)
