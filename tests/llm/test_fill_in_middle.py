"""Rearranged documents against list slicing, and their exact inverse."""

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest

from ampliflow.llm import fill_in_middle as fim

SENTINELS = ("<P>", "<S>", "<M>")


def by_hand(text, doc_id):
    """The contract with plain lists."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def texts(seed):
    rng = random.Random(seed)
    parts = ["word", "a", "é", "\U0001f600", " ", "\n", "<", ">", "S>", "<P", "1", "\x00", "ſ", "KelvinK", "<M", ">"]
    return ["".join(rng.choice(parts) for _ in range(rng.choice((0, 1, 2, 7, 60, 400)))) for _ in range(300)]


@pytest.mark.parametrize("leaf", [1, 3, 16, 1024])
def test_rope_against_lists(leaf):
    for k, text in enumerate(texts(leaf)):
        got = fim.rearrange(text, str(k), leaf=leaf)
        assert got == by_hand(text, str(k))
        assert fim.restored(got[4], got[1], leaf) == text


def test_splits_at_every_rank():
    text = "One two, three\nfour " + "x" * 50 + " é\U0001f600 end"
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    tree = fim.rope(text, 4)
    assert (tree.units, tree.chars, str(tree)) == (len(units), len(text), text)
    for r in range(len(units) + 1):
        a, b = fim.split(tree, r)
        assert (str(a), str(b), a.units, b.units) == ("".join(units[:r]), "".join(units[r:]), r, len(units) - r)
    for r in range(len(text) + 1):
        a, b = fim.split(tree, r, "chars")
        assert (str(a), str(b), a.chars) == (text[:r], text[r:], r)


def test_depth_is_logarithmic():
    def depth(node):
        return 1 if node.left is None else 1 + max(depth(node.left), depth(node.right))

    assert depth(fim.rope("ab " * 100_000)) <= 12


def test_query_against_sql_and_lists(spark):
    rows = [(k, t) for k, t in enumerate(texts(9))] + [(None, "no id"), (7, None), (8, ""), (9, "x" * 300_000), (10, "a b " * 200_000), (1, "twice"), (1, "twice")]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, form string, n int").repartition(3)
    got = fim.op11_query(df).toPandas()
    documents = pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], dtype="Int64"), "text": pd.array([r[1] for r in rows], dtype="string")})
    assert len(documents) == len(got)
    con = duckdb.connect()
    con.register("documents", documents)
    columns = sorted(got.columns)
    want = con.sql(fim.ORACLE).df()
    as_rows = lambda f: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in f[columns].itertuples(index=False))
    assert as_rows(got) == as_rows(want)
    assert fim.op11_query(df.where("doc_id < 0")).collect() == []


def test_operator_keeps_texts_and_columns(spark):
    df = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts(3))], "doc_id long, text string, units string")
    found = fim.fill_in_middle(df, rates=fim.Rates(rearranged=100, suffix_first=50))
    got = found.withColumn("back", fim.restore(found["fim.text"], found["fim.form"])).collect()
    assert all(r["back"] == r["text"] and r["units"] == "kept" for r in got)
    assert {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}
