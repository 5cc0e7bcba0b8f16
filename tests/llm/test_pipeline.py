"""The pipeline against plain versions of its stages."""

from collections import Counter

import brute
from test_queries import check_packed

import corpus_pipeline
from feedsift.llm import quality, secrets
from feedsift.llm.scratch import importable


def test_stages(spark, sample_dir, documents):
    importable(spark)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "minhash_dedup", "substring_dedup", "secret_scans", "packing"]
    docs = spark.read.parquet(f"{sample_dir}/documents.parquet")
    columns = docs.columns
    wanted = list(documents)

    def step(n):
        nonlocal docs
        docs = corpus_pipeline.STAGES[n][1](spark, docs, sample_dir)
        if n < 4:
            path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-test-{n}"
            docs.write.mode("overwrite").parquet(path)
            docs = spark.read.parquet(path)
            assert docs.columns == columns
        return [r.asDict() for r in docs.collect()]

    def same(found):
        assert sorted(map(repr, found)) == sorted(repr({c: r[c] for c in columns}) for r in wanted)

    judged = brute.verdicts(wanted, quality.MIN_GROUP_ROWS, quality.FROM_PERCENT, quality.GUARD)
    wanted = [r for r, (_, _, kept) in zip(wanted, judged, strict=True) if kept]
    same(step(0))
    near = brute.near_documents(wanted)
    wanted = [r for r, (_, c) in zip(wanted, near, strict=True) if c == r["doc_id"]]
    same(step(1))
    short = brute.shortened(wanted)
    wanted = [
        r | {"text": kept, "n_chars": len(kept)} if gone else r for r, (_, gone, kept) in zip(wanted, short, strict=True)
    ]
    same(step(2))
    rows = step(3)
    simple = [r for r in wanted if "PRIVATE KEY" not in r["text"]]
    texts = Counter((r["doc_id"], brute.masked(r["text"], brute.secret_spans(r["text"]), secrets.MASK)) for r in simple)
    found = Counter((r["doc_id"], r["text"]) for r in rows)
    assert not texts - found and sum(found.values()) == len(wanted) and len(simple) == len(wanted) - 1
    assert sum(secrets.MASK in r["text"] for r in rows) > 1
    for r in rows:
        assert not brute.secret_spans(r["text"])
        assert secrets.MASK not in r["text"] or r["n_chars"] == len(r["text"])
    wanted = rows
    check_packed(step(4), [r["text"] for r in wanted])
