"""Known sentences apart from each other make no licence of several sentences; checked against the SQL too."""

import random

import duckdb

from feedsift.llm import licenses

GPL = [licenses.SENTENCES[n] for n in ("gpl_free", "gpl_hope", "gpl_see")]


def scanned(spark, texts):
    frame = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING"))
    return [(r["sentence_ids"], r["n_sentences"], r["licenses"]) for r in sorted(frame.collect(), key=lambda r: r["doc_id"])]


def by_sql(texts):
    connection = duckdb.connect()
    connection.execute("CREATE TABLE documents (doc_id INT, text VARCHAR)")
    connection.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    rows = connection.execute(f"SELECT sentence_ids, n_sentences, licenses, doc_id FROM ({licenses.oracle()}) ORDER BY doc_id").fetchall()
    return [row[:3] for row in rows]


def test_sentences_far_apart_are_no_header(spark):
    far = " Some other words stand here." * 2000 + " "
    side, apart = scanned(spark, [". ".join(GPL) + ".", f".{far}".join(GPL) + "."])
    assert side[2] == "GPL-3.0-header" and "|" not in side[0]
    assert apart[2] == "GPL-3.0" and apart[0].count("|") == 2 and apart[1] == 3


def test_gaps_as_the_sql_sees_them(spark):
    rng = random.Random(8)
    known = [licenses.SENTENCES[n] for n in licenses.SENTENCES if not licenses.SENTENCES[n].endswith(":")]
    other = ["Other words stand here", "b", "12", "And so on", "---", ""]
    texts = []
    for _ in range(300):
        some = [rng.choice(known if rng.random() < 0.6 else other) for _ in range(rng.randint(0, 9))]
        texts.append("".join(x + rng.choice([". ", ".\n\n", "!\n"]) for x in some))
    for _, parts in licenses.RULES:
        for between in ("", "Other words stand here. "):
            texts.append("".join(licenses.SENTENCES[p] + ". " + between for p in parts))
    texts += ["", "no licence at all", " ".join("Unrelated words again." for _ in range(20_000)) + " " + ". ".join(GPL) + "."]
    tidy = [t for t in texts if ":. " not in t and "v. 2.0" not in t]  # the SQL cuts inside these sentences
    found = scanned(spark, tidy)
    assert sum("|" in ids for ids, _, _ in found) > 50
    assert [(t, f, w) for t, f, w in zip(tidy, found, by_sql(tidy), strict=True) if f != w] == []
