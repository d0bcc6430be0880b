import random
import re
from hashlib import sha256

import numpy as np
import pytest
import xxhash

from ampliflow.llm import components, simhash_dedup, suffix_dedup


def union_find(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def test_components(spark):
    r = random.Random(2)
    links = [(k, k + 1) for k in range(60)] + [(r.randrange(61, 200), r.randrange(61, 200)) for _ in range(120)] + [(5, 5)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()))
    want = union_find(200, links)
    assert all(got.get(k, k) == want[k] for k in range(200))
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_pairs(spark):
    r = np.random.default_rng(1)
    base = r.integers(-(1 << 63), (1 << 63) - 1, 300, np.int64)
    near = base ^ (np.int64(1) << r.integers(0, 63, 300)) ^ (np.int64(1) << r.integers(0, 63, 300)) ^ (np.int64(1) << r.integers(0, 63, 300))
    fps = np.unique(np.r_[base, near, [0, 1, 3, 7, 15]])
    got = sorted(tuple(sorted(x)) for x in simhash_dedup.near_pairs(spark.createDataFrame([(int(x),) for x in fps], "fp long")).collect())
    want = sorted((int(fps[i]), int(fps[j])) for i in range(len(fps)) for j in range(i + 1, len(fps)) if np.bitwise_count(np.uint64(fps[i].view(np.uint64)) ^ np.uint64(fps[j].view(np.uint64))) <= 3)
    assert got == want


def test_simhash_edges(spark):
    texts = [None, "", "one", "One", "a b c d e f g", "a b c d e f g", "x " * 50_000]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(4, texts[4], 1)], "doc_id long, text string, fp int")
    got = {r["doc_id"]: r["component_id"] for r in simhash_dedup.op8_query(df).collect()}
    assert got[1] == got[0] == 0 and got[3] == got[2] == 2 and got[5] == got[4] == 4
    assert simhash_dedup.op8_query(df).count() == 8
    assert simhash_dedup.op8_query(df.where("doc_id < 0")).collect() == []


def simhash(text):
    """Bit by bit, as the contract words it."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_groups_are_brute_force(spark):
    """Fingerprints and components, with near copies, repeated rows, null ids that link others, and null texts."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeFG") for _ in range(4))
    rows = []
    for k in range(60):
        words = [word() for _ in range(r.randrange(1, 400))]
        rows.append((3 * k, " ".join(words)))
        for n in range(r.randrange(4)):
            words[r.randrange(len(words))] = word()
            rows.append((None if n == 1 else 3 * k + 1 + n, " ".join(words)))
    rows += [rows[0], (900, None), (None, ""), (901, "  \n "), (None, "alone " * 50), (2, rows[4][1])]
    fps = [simhash(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    root = union_find(len(rows), links)
    least = {}
    for (k, _), g in zip(rows, root):
        if k is not None:
            least[g] = min(k, least.get(g, k))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(str, ((x["doc_id"], x["fingerprint"], x["component_id"]) for x in simhash_dedup.op8_query(df).collect())))
    assert got == sorted(map(str, ((k, f"{f:016x}", least.get(g)) for (k, _), f, g in zip(rows, fps, root))))
    assert any(k is None for i, j in links for k in (rows[i][0], rows[j][0]))


def brute_force(rows, n=100):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda x: x[0]):
        data = (text or "").encode()
        mark = np.zeros(len(data), bool)
        for s in range(len(data) - n + 1):
            if data[s : s + n] in seen:
                mark[s : s + n] = True
            seen.add(data[s : s + n])
        kept = bytes(b for b, m in zip(data, mark) if not m)
        out[doc] = (len(data), int(mark.sum()), int((np.diff(np.r_[0, mark.astype(int)]) == 1).sum()), sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [20_000, 2, 0])
def test_suffix_dedup(spark, monkeypatch, hot):
    """Also where all frequent anchors are hot, and where their strings are dealt out one by one."""
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    monkeypatch.setattr(suffix_dedup, "HOT", 1024 if hot > 2 else 100)
    monkeypatch.setattr(suffix_dedup, "STRINGS", 30)
    monkeypatch.setattr(suffix_dedup, "PARTS", 3)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(40), text(200)
    rows = [(0, base), (1, base), (2, text(30) + passage + text(30)), (3, None), (4, ""), (5, "short"), (6, "a" * 350), (7, "ab" * 200), (8, "\0" * 250), (9, base[50:400] + text(10) + base[:90])]
    rows += [(k, text(r.randrange(5, 20)) + passage + text(5)) for k in range(10, 40)]
    df = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, n_bytes string").repartition(5)
    got = {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in suffix_dedup.op6_query(df).collect()}
    assert got == brute_force(rows)


def test_suffix_dedup_repeated_rows_and_empty(spark):
    t = "some words that are long enough to make a string of a hundred bytes or more, which is what the rule asks for, and more"
    df = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    got = sorted((str(x["doc_id"]), x["n_removed"]) for x in suffix_dedup.op6_query(df).collect())
    assert got == [("1", len(t)), ("1", len(t)), ("None", 0)]  # a null id comes first
    assert suffix_dedup.op6_query(df.where("doc_id > 5")).collect() == []


@pytest.mark.parametrize("hot", (False, True))
def test_repeated_rows_share_their_spans(spark, monkeypatch, hot):
    """Rows that share id and text are told of once: with the spans of all of them in each, their size would be the square of their number."""
    if hot:
        monkeypatch.setattr(suffix_dedup, "HOT", 10**9)  # every bucket is hot
    r = random.Random(8)
    text = "".join(r.choice("abcdefgh ") for _ in range(400))
    rows = [(1, text)] * 3 + [(2, "x" + text)] * 40 + [(None, text + "y")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    starts = [tuple(x) for x in suffix_dedup.repeated_starts(suffix_dedup.keyed(df)).collect()]
    assert len(starts) == len(set(starts)) and {x[0] for x in starts} == {1, 2}
    got = suffix_dedup.op6_query(df).collect()
    assert sorted((x["doc_id"] or 0, x["n_bytes"], x["n_removed"]) for x in got) == sorted([(1, 400, 400)] * 3 + [(2, 401, 400)] * 40 + [(0, 401, 0)] * 40)


def test_suffix_dedup_repeated_rows_of_different_runs(spark):
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcde") for _ in range(6)) for _ in range(n))
    passage = text(30)
    rows = [(1, text(20) + passage + text(20)), (2, text(20) + passage + text(20)), (3, text(60))]
    df = spark.createDataFrame([*rows, rows[0], rows[0], rows[1]], "doc_id long, text string").repartition(3)
    got = [(x["doc_id"], (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"])) for x in suffix_dedup.op6_query(df).collect()]
    want = brute_force(rows)
    assert sorted(got) == sorted((k, want[k]) for k in (1, 1, 1, 2, 2, 3))


def test_family_levels_are_few(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    family, starts = suffix_dedup.SuffixFamily(), np.arange(50) * 100
    r = np.random.default_rng(0)
    every = []
    for _ in range(64):
        data = r.integers(0, 3, 5000, np.uint8)
        assert not family.add(data, starts).any()
        assert family.add(data, starts).all()
        every += [data[k : k + 100].tobytes() for k in starts]
    assert len(family.levels) <= 8 and sum(map(len, family.levels)) == 64 * 50
    for level in family.levels:
        own = [level.data[k : k + 100].tobytes() for k in level.at]
        assert own == sorted(own) and set(own) <= set(every)


def test_family_is_brute_force():
    r = np.random.default_rng(7)
    family, seen = suffix_dedup.SuffixFamily(), set()
    for _ in range(30):
        data = np.tile(r.integers(0, 2, 130, np.uint8), 3)[: r.integers(100, 390)]
        got = family.add(data, np.arange(len(data) - 99))
        for k, old in enumerate(got):
            x = data[k : k + 100].tobytes()
            assert old == (x in seen)
            seen.add(x)


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    r = random.Random(1)
    text = bytes(r.randrange(97, 123) for _ in range(5000))
    starts = sorted(s for _, first, last, *_ in suffix_dedup.runs_of([text]) for a, b in zip(first, last) for s in range(a, b + 1))
    assert starts == list(range(4901))
