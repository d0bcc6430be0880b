"""Native operators: quality rules, licence scans, fingerprints."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from ampliflow.llm import fingerprints, license_scan, quality_rules

PROSE = "The quick brown fox jumps over the lazy dog again today.\nA second line of plain words ends here."
TEXTS = [
    None, "", "   \n\t", PROSE, PROSE, "one two three four five six one two three four five six seven", "HOME | NEWS | ABOUT | MORE\n" * 4, "word " * 5000, "a\n" * 3000,
    "x# y% z& " * 30, "Café über straße naïve élan vital à la carte, très bien. Oui!", "A BIG SHOUT OF WORDS!! NOW!!\n" * 5 + PROSE,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 4 else 3, t, "qr_kept") for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, qr_kept string")


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)} if len(words) < 500 else set(range(len(words)))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_base_columns(docs):
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want = brute(r["text"])
        assert (r["qr_n_words"], r["qr_word_chars"], r["qr_n_symbols"], r["qr_n_dup_lines"], r["qr_n_repeat_words"]) == want
        assert r["qr_base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    kept = {r["text"] for r in got if r["qr_kept"]}
    assert PROSE in kept and TEXTS[10] in kept and TEXTS[6] not in kept and TEXTS[9] not in kept and None not in kept


def test_rules_oracle_and_empty_table(spark, docs):
    want = duckdb.connect()
    want.register("documents", docs.select("doc_id", "text").toPandas())
    rows = sorted(map(tuple, want.execute(quality_rules.ORACLE).fetchall()))
    assert rows == sorted(map(tuple, quality_rules.op7_query(docs).collect()))
    assert quality_rules.op7_query(docs.where("doc_id < 0")).collect() == []


def test_licences(spark):
    mit = (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the\nSoftware without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\n"
        "The above copyright notice and this permission notice shall be included in all copies\nor substantial portions of the Software."
    )
    texts = [None, "", "Words.\nReleased under the MIT License.\nMore words", mit, "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", "the license of the software", "x " * 100_000 + "\nReleased under the MIT License."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in license_scan.op9_query(df).collect()}
    assert got == {0: "", 1: "", 2: "MIT", 3: "MIT", 4: "GPL-3.0", 5: "Apache-2.0,CC-BY-NC-4.0", 6: "", 7: "MIT"}
    for form in license_scan.SENTENCES.values():
        assert re.search(license_scan.HINT, form)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(con.execute(license_scan.ORACLE).fetchall()) == sorted(map(tuple, license_scan.op9_query(df).collect()))


def test_fingerprints(spark):
    texts = ["alpha beta gamma delta epsilon " * 5, None, "", "alpha beta gamma delta epsilon " * 5, "other words stand in this document, none like before", "tail"]
    df = spark.createDataFrame([(k * 25, t, "x") for k, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, fingerprint string")
    got = sorted(fingerprints.op1_query(df).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in got] == [0, 0, 25, 50, 75, 100, 125]
    rows = {r["doc_id"]: r for r in got}
    full = [t or "" for t in texts]
    for k, t in enumerate(full):
        n = len(t) // 4
        edited = t[: len(t) - n] + full[(k + 1) % len(full)][:n]
        assert rows[k * 25]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert rows[k * 25]["n_chars"] == len(t)
    assert rows[0]["fingerprint"] == rows[75]["fingerprint"] != rows[100]["fingerprint"]
    assert rows[25]["near_next"] == 1.0 and rows[0]["n_within"] == 3 and rows[25]["n_within"] is None
    assert fingerprints.op1_query(df.where("doc_id < 0")).collect() == []


def test_fingerprints_of_rows_without_id(spark, monkeypatch):
    texts = [(None, "a document that has no id of its own"), (None, "another of these, with other words in it"), (None, None), (50, "alpha beta gamma delta"), (60, "the last one of the table")]
    df = spark.createDataFrame([*texts, texts[0], texts[3], texts[3]], "doc_id long, text string").repartition(3)
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["fingerprint"])
    got = sorted(fingerprints.op1_query(df).collect(), key=key)
    assert [(r["doc_id"], r["n_chars"]) for r in got] == [(None, 0), (None, 36), (None, 36), (None, 40), (50, 22), (50, 22), (50, 22), (60, 25)]
    assert [r["n_within"] for r in got] == [None] * 4 + [3] * 3 + [None]
    monkeypatch.setattr(fingerprints, "LANE_TERMS", 2)  # votes in several parts add up to the same
    assert sorted(fingerprints.op1_query(df).collect(), key=key) == got


def test_block_tables_find_all(spark):
    base = spark.range(200).select(F.xxhash64("id").alias("fp_hi"), F.xxhash64("id", F.lit(1)).alias("fp_lo"))
    flips = base.select(F.col("fp_hi").bitwiseXOR(F.lit((1 << 5) | (1 << 40))).alias("fp_hi"), F.col("fp_lo").bitwiseXOR(F.lit(1 << 62)).alias("fp_lo"))
    every = base.union(flips)
    for lead in (1, 2):
        assert fingerprints.search(base, every, 3, lead).where("distance = 3").count() == 200
        assert fingerprints.search(base, every, 3, lead).count() == 400
