"""Exact duplicates against grouping by text; fingerprints against Horner's rule."""

import random
from collections import defaultdict

import duckdb
import pytest

from ampliflow.llm import exact_dedup as ed

TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows():
    rng = random.Random(4)
    base = ["", None, "Same", "same", "SAME", "sÀme", "same ", "\x00a", "a", "\x00\x00a", "Éa", "éa", "long " * 400, "Long " * 400, "long " * 399 + "lonG!", "İ", "i̇"]
    out = [(k, rng.choice(base)) for k in range(200)]
    return out + [(None, "same"), (None, "only here"), (None, "only here"), (3, "twice"), (3, "twice"), (3, "other text, same id")] + [(1000 + k, "hot") for k in range(400)]


def by_hand(given):
    groups = defaultdict(list)
    for k, t in given:
        groups[(t or "").translate(TO_LOWER)].append(k)
    return groups


def check(got, given):
    groups = by_hand(given)
    texts = {ed.hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert len(got) == len(given)
    kept = defaultdict(int)
    for r in got:
        ids = groups[texts[r["text_sha256"]]]
        most = max((k for k in ids if k is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (most, len(ids)) and r["doc_id"] in ids
        assert not r["kept"] or r["doc_id"] == most
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


@pytest.mark.parametrize("case", [{}, {"chunk": 7, "huge": 100}, {"chunk": 1 << 20, "huge": 0}, {"modulus": 2, "chunk": 5, "huge": 100}, {"modulus": 3}, {"modulus": 1, "huge": 0, "chunk": 64}])
def test_against_grouping(spark, case):
    """Also with chunks of a few bytes, with all texts as huge ones, and with so small a modulus that most fingerprints are equal."""
    given = rows()
    df = spark.createDataFrame([(*r, "x") for r in given], "doc_id long, text string, sha string").repartition(5)
    check(ed.exact_groups(df, **case).collect(), given)


def test_composition():
    rng = random.Random(1)
    for _ in range(200):
        data = rng.randbytes(rng.randrange(0, 300))
        h = 0
        for b in data:
            h = (h * 256 + b) % ed.MODULUS
        assert ed.fingerprint_of(data, chunk=rng.randrange(1, 50)) == (h, len(data))
        a, b, c = data[:70], data[70:71], data[71:]
        parts = [ed.chunk_hash(x) for x in (a, b, c)]
        assert ed.combined(ed.combined(parts[0], parts[1]), parts[2]) == ed.combined(parts[0], ed.combined(parts[1], parts[2])) == (h, len(data))


def test_fixed_values():
    """The modulus is prime (Fermat, several bases) and no near power of two."""
    assert all(pow(b, ed.MODULUS - 1, ed.MODULUS) == 1 for b in (2, 3, 5, 7, 11, 13)) and ed.MODULUS.bit_length() == 126
    assert bin(ed.MODULUS).count("1") > 40


def test_sql_and_edges(spark, tmp_path):
    given = [(k, t) for k, t in dict(rows()).items() if k is not None]
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", given)
    got = ed.op12_query(df)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({ed.ORACLE})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert ed.op12_query(df.where("doc_id < 0")).collect() == []


def test_rows_that_stay(spark):
    given = rows()
    df = spark.createDataFrame([(*r, "x", "y") for r in given], "doc_id long, text string, text_sha256 string, kept string").repartition(3)
    found = ed.without_copies(df)
    got = found.collect()
    assert found.columns == df.columns and {r["kept"] for r in got} == {"y"}
    assert sorted((r["text"] or "").translate(TO_LOWER) for r in got) == sorted(by_hand(given))
