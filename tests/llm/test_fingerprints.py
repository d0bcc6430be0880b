"""Fingerprints, likenesses and the search against a version that goes bit by bit."""

import math
import random
import re
from hashlib import sha256

import pytest
import xxhash

from ampliflow.llm import fingerprints

SECOND = xxhash.xxh64_intdigest((1).to_bytes(4, "little"), 42)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    weight = [max(min(len(w), 16) - 3, 1) ** 2 for w in words]
    out = 0
    for half, seed in ((0, 42), (1, SECOND)):
        h = [xxhash.xxh64_intdigest(w.encode(), seed) for w in words]
        for b in range(64):
            if 2 * sum(k for k, x in zip(weight, h) if x >> b & 1) > sum(weight):
                out |= 1 << (64 * half + b)
    return out


def expected(rows):
    """The contract: documents in ascending order of id (nulls first, then the hash of the text), repeated rows next to nothing new."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    key = lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), 42)))
    distinct = sorted({(k, t or "") for k, t in rows}, key=key)
    fps = {d: fingerprint(d[1]) for d in distinct}
    out = {}
    for d, after in zip(distinct, distinct[1:] + distinct[:1]):
        n = len(d[1])
        edited = d[1][: n - n // 4] + after[1][: n // 4]
        like = lambda a, b: max(math.cos(math.pi * (a ^ b).bit_count() / 128), 0)
        e = fingerprint(edited)
        within = sum((fps[d] ^ fps[k, t or ""]).bit_count() <= 3 for k, t in rows) if d[0] is not None and d[0] % 50 == 0 else None
        out[d] = (n, sha256(edited.encode()).hexdigest(), f"{fps[d]:032x}", f"{e:032x}", pytest.approx(like(fps[d], e)), pytest.approx(like(fps[d], fps[after])), within)
    return out


def test_fingerprints_are_brute_force(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeé\U0001F600") for _ in range(r.randrange(1, 20)))
    text = lambda n: " ".join(word() for _ in range(n))
    near = text(600)
    rows = [(k, text(r.randrange(0, 60))) for k in range(0, 120, 7)]
    rows += [(50, near), (100, near + " x"), (101, near), (102, near.replace("a", "b", 1)), (None, near), (None, text(9)), (None, None), (3, None), (4, ""), (5, "  \n"), (7, text(5)), (200, "word " * 30_000)]
    rows += [rows[0], rows[0], (None, near), (3, "")]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, fp_lo int").repartition(4)
    want = expected(rows)
    got = fingerprints.op1_query(df).collect()
    assert len(got) == len(rows)
    found = sorted((str(x["doc_id"]), x["fingerprint"], x["edited_sha256"]) for x in got)
    assert found == sorted((str(k), want[k, t or ""][2], want[k, t or ""][1]) for k, t in rows)
    by = {(v[1], v[2], k[0]): v for k, v in want.items()}
    for x in got:
        assert (x["n_chars"], x["edited_sha256"], x["fingerprint"], x["edited_fingerprint"], x["near_edited"], x["near_next"], x["n_within"]) == by[x["edited_sha256"], x["fingerprint"], x["doc_id"]]


def test_votes_of_parts_add_up(spark, monkeypatch):
    """Where the votes of a text are summed in parts, as those of very long texts are, the fingerprint is the same."""
    texts = ["one two three four five six seven eight nine ten " * k for k in (1, 3, 40)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    monkeypatch.setattr(fingerprints, "LANE_TERMS", 7)
    got = {x["k"]: (x["fp_hi"] % (1 << 64)) << 64 | x["fp_lo"] % (1 << 64) for x in fingerprints.fingerprints(df, ["k"], "t").collect()}
    assert got == {k: fingerprint(t) for k, t in enumerate(texts)}


def test_empty_table_and_one_row(spark):
    df = spark.createDataFrame([(1, "alone in here")], "doc_id long, text string")
    assert fingerprints.op1_query(df.where("doc_id > 1")).collect() == []
    only = fingerprints.op1_query(df).first()
    assert only["near_next"] == 1 and only["edited_sha256"] == sha256(b"alone in halo").hexdigest()
