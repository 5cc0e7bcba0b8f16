"""Factors of the substring parse against plain text work."""

import random

from feedsift.llm import substring
from feedsift.llm.batches import arrow_map
from feedsift.llm.scratch import importable, text_key


def factors(spark, texts):
    importable(spark)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    named = docs.select("doc_id", text_key().alias("text_key"), "text")
    seeded = arrow_map(
        named, substring._seeded, "doc_id bigint, text_key bigint, n_words bigint, whole_sha256 string, seeds array<bigint>"
    )
    rows = substring.duplicate_factors(seeded, named, "bigint").collect()
    return {r["doc_id"]: sorted((f["start"], f["n_words"], f["source_doc"]) for f in r["factors"]) for r in rows}


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def covered(found):
    return {p for start, n, _ in found for p in range(start, start + n)}


def test_factors_are_passages_of_earlier_documents(spark):
    rng = random.Random(3)
    a, b, c = words(rng, 400), words(rng, 60), words(rng, 49)
    cut = a[100:300]
    docs = [
        a, words(rng, 80) + b + words(rng, 30), words(rng, 20) + cut + b + c, c + words(rng, 9) + c, a[350:] + a[:50],
        a[40:139] + ["odd"] + a[140:400], [], a, b[:50], b[:49], ["same"] * 300, ["same"] * 170,
    ]
    texts = [" ".join(d) for d in docs]
    found = factors(spark, texts)
    for doc, its in found.items():
        for start, n, source in its:
            assert n >= substring.WINDOW and source < doc
            assert f" {' '.join(docs[doc][start:start + n])} " in f" {texts[source]} "
    assert covered(found[2]) == set(range(20, 20 + 200 + 60))  # the parse goes from one reference to the next
    assert {source for _, _, source in found[2]} == {0, 1}
    assert covered(found[4]) == set(range(100))  # no factor across the seam
    assert covered(found[5]) == set(range(360)) - {99}
    assert covered(found[7]) == set(range(400)) and {s for _, _, s in found[7]} == {0}
    assert covered(found[8]) == set(range(50)) and covered(found[11]) == set(range(170))
    assert set(found) == {2, 4, 5, 7, 8, 11}


def test_factors_are_greedy_and_equal_runs_are_parsed_once(spark):
    rng = random.Random(4)
    a = words(rng, 300)
    runs = spark.createDataFrame(
        [(1, 0, 9, 5, [1, 2, 3, 4]), (2, 0, 9, 6, [7, 2, 3, 4]), (3, 0, 9, 6, [7, 2, 3, 4]), (4, 0, 9, 8, [3, 4, 7, 2])],
        "doc_id BIGINT, text_key BIGINT, seed BIGINT, run BIGINT, windows ARRAY<BIGINT>",
    )
    parsed = {
        r["run"]: [(f["place"], f["n"], f["holder"], f["source"], f["shift"]) for f in r["phrases"]]
        for r in substring.parsed_runs(runs, "bigint").collect()
    }
    assert parsed == {
        5: [(0, 4, 1, 5, 0)],
        6: [(0, 1, 2, 6, 0), (1, 3, 1, 5, 0)],
        8: [(0, 2, 1, 5, 2), (2, 1, 2, 6, -2), (3, 1, 1, 5, -2)],
    }
    found = factors(spark, [" ".join(a)] + [" ".join(a[50:250])] * 40)
    assert len({tuple(f) for f in found.values()}) == 1
    assert len(found[1]) <= 200 // 10  # one per run, not one per window


def test_neighbouring_short_copies_in_one_batch(spark):
    text = " ".join(words(random.Random(5), 52))
    importable(spark)
    docs = spark.createDataFrame([(n, text) for n in range(30)], "doc_id BIGINT, text STRING").coalesce(1)
    kept = {r["doc_id"]: r["n_removed"] for r in substring.substring_report(docs).collect()}
    assert kept == {0: 0} | {n: 52 for n in range(1, 30)}
