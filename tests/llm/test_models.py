import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from ampliflow.llm import html_extract, line_crf, maxent_lm

PLAIN = "The lake was calm this morning and we walked along it. Nobody else was there, which was nice.\nLater we went home and had some tea."
JUNK = "tea | home | lake\nTEA!! HOME!! LAKE!!\nlake lake lake lake lake lake lake lake lake lake lake lake lake lake"


def test_crf_learns_lines(spark):
    docs = spark.createDataFrame([(k, (PLAIN if k % 3 else JUNK) + f"\nNumber {k} is the last line." * (k % 2)) for k in range(150)] + [(998, None), (999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0), 0) for k in range(150)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in line_crf.op5_query(docs, labels).collect()}
    assert all(got[k]["predicted"] == int(k % 3 > 0) for k in range(150))
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(150))
    assert got[998]["predicted"] == got[999]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert line_crf.op5_query(docs.where("doc_id < 0"), labels).collect() == []
    assert [r["score"] for r in line_crf.op5_query(docs, labels.where("doc_id < 0")).limit(2).collect()] == [0.5, 0.5]


def test_crf_marginals_by_enumeration():
    r = np.random.default_rng(3)
    steps, sizes = r.normal(size=(2, 2)), np.array([3, 1, 4])
    potential = r.normal(size=8)
    got, counts = line_crf._marginals(potential, sizes, steps)
    at, want, total = 0, [], np.zeros((2, 2))
    for n in sizes:
        p = potential[at : at + n]
        at += n
        paths = [[k >> t & 1 for t in range(n)] for k in range(2**n)]
        weight = np.array([math.exp(sum(p[t] * s[t] for t in range(n)) + sum(steps[a, b] for a, b in zip(s, s[1:]))) for s in paths])
        weight /= weight.sum()
        want += [sum(w for w, s in zip(weight, paths) if s[t]) for t in range(n)]
        for w, s in zip(weight, paths):
            for a, b in zip(s, s[1:]):
                total[a, b] += w
    assert got == pytest.approx(want) and counts == pytest.approx(total)


def test_language_model(spark):
    r = np.random.default_rng(5)
    words = {"a": ["the", "of", "sea", "ship", "was", "seen"], "b": ["der", "und", "schiff", "war", "meer", "blau"]}
    texts = [" ".join(r.choice(words["a" if k % 2 else "b"], 60)) for k in range(200)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(500, None, 1), (501, "", 1), (502, "Never SEEN words", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {x["doc_id"]: x for x in maxent_lm.op3_query(df).collect()}
    tokens = lambda t: [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    out = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    c = Counter(w for k, t, _ in rows if not out(k) for w in tokens(t))
    norm = math.log10(c.total() + 0.5 * (len(c) + 1))
    for k, t, _ in rows:
        w = tokens(t)
        assert (got[k]["held_out"], got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (out(k), len(w), sum(x in c for x in w), c.total())
        assert got[k]["base_score"] == pytest.approx(sum(math.log10(c[x] + 0.5) - norm for x in w))
    held = [k for k in range(200) if out(k)]
    assert np.mean([got[k]["score"] > got[k]["base_score"] for k in held]) > 0.9
    assert maxent_lm.op3_query(df.where("doc_id < 0")).collect() == []


def blocks_of(texts, out=None):
    frame = pd.DataFrame({"doc": range(len(texts)), "out": out or [False] * len(texts), "text": texts})
    return pd.concat(list(maxent_lm._tokenised(iter([frame.iloc[:2], frame.iloc[2:]]))))


def plain_members(words):
    h = np.array([maxent_lm.word_hash(w) for w in words])
    return maxent_lm.Members(np.sort(h), np.argsort(h) * 33, np.zeros(0, np.int32), np.zeros(0, np.int64), np.arange(maxent_lm.MEMBERS - 8, maxent_lm.MEMBERS))


def test_every_position_trains():
    texts = ["one two", "", None, "three four five " * 700, "six"]
    words = [b"", b"one", b"two", b"three", b"four", b"five", b"six"]
    members, bits = plain_members(words), 14
    start = np.zeros((maxent_lm.n_rows(bits), maxent_lm.WIDTH), np.float32), np.full(maxent_lm.n_rows(bits), maxent_lm.FIRST, np.float32)
    sent = type("Sent", (), {"value": start})()
    bias, blocks, positions, moved = maxent_lm.biases(np.zeros(maxent_lm.MEMBERS)), blocks_of(texts), set(), np.zeros_like(start[0])
    for turn in range(3):
        for x in maxent_lm._trainer(members, bias, bits, sent, turn, 3)(iter([blocks])):
            positions |= {(turn, n) for n in x["positions"]}
            for s, *packed in zip(x["shard"], x["row"], x["energy"], x["scale"], x["change"]):
                row, _, change = maxent_lm._unpacked(*packed)
                moved[s * maxent_lm.SHARD + row] += change
    assert sum(n for _, n in positions) == sum(len(maxent_lm.tokens(t)) for t in texts)
    for before, after in ((b"one", b"two"), (b"two", b""), (b"six", b"")):  # each pair of a short text leaves its mark
        row = (maxent_lm.word_hash(before) % (1 << 64)) >> (64 - bits)
        assert moved[row].argmax() == words.index(after) * 33 >> 10 and start[0].max() == 0


def test_blocks_hold_all_texts(monkeypatch):
    monkeypatch.setattr(maxent_lm, "BLOCK_CHARS", 40)
    texts = ["The sea, the SEA", None, "blue", "", "the end of the long and winding road to the north", "x"]
    got = blocks_of(texts, [False, False, True, False, False, True])
    assert len(got) > 1
    seen = []
    for row in maxent_lm._rows(iter([got])):
        ids, size = np.frombuffer(row.ids, np.int32), np.frombuffer(row.size_, np.int64)
        word, n, out = np.frombuffer(row.word, np.int64), np.frombuffer(row.n, np.int32), np.frombuffer(row.out, bool)
        assert np.array_equal(n, np.bincount(ids[np.repeat(~out, size)], minlength=len(word)))
        seen += [list(word[x]) for x in np.split(ids, np.cumsum(size)[:-1])]
    assert seen == [[maxent_lm.word_hash(w) for w in maxent_lm.tokens(t)] for t in texts]


def test_members_come_from_all_documents(spark, monkeypatch):
    monkeypatch.setattr(maxent_lm, "BLOCK_CHARS", 3000)
    letters = "bcdfghjklmnpqrstvwxz"
    own = [a + b + c for a in letters for b in letters for c in letters][:3000]  # an ending of its own for each document
    texts = [f"The sea {'was' if k % 3 else 'IS'} x{own[k]}, blue" for k in range(3000)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    monkeypatch.setattr(maxent_lm, "FREQUENT", 8)
    counted = maxent_lm.count_words(maxent_lm.tokenise(df))
    members, landmarks = maxent_lm.frequent_members(counted)
    count = Counter(w for k, t in enumerate(texts) for w in maxent_lm.tokens(t) if zlib.crc32(str(k).encode()) % 5 != 1)
    top = sorted(count.items(), key=lambda x: (-x[1], maxent_lm.word_hash(x[0])))[:8]
    assert list(landmarks) == [maxent_lm.word_hash(w) for w, _ in top]
    assert set(members.endings) == {maxent_lm.ending(w) for w in count if w not in dict(top)}
    n, v = maxent_lm.member_counts(counted, members)
    assert n.sum() == count.total() and v.sum() == len(count)
    word = np.array([maxent_lm.word_hash(w) for w in count])
    mine = members.of(word, np.array([maxent_lm.ending(w) for w in count]))
    assert np.array_equal(np.bincount(mine, list(count.values()), maxent_lm.MEMBERS), n)


def test_row_sums():
    r = np.random.default_rng(4)
    g, rows = r.normal(size=(500, 3)), np.stack([r.integers(0, 4, 500), r.integers(4, 900, 500), np.full(500, 901)])
    used, total = maxent_lm.row_sums(g, rows)
    want = np.zeros((902, 3))
    for line in rows:
        np.add.at(want, line, g)
    assert sorted(used) == sorted(set(rows.ravel())) and total == pytest.approx(want[used])


def test_changes_are_averaged_in_levels(spark):
    r = np.random.default_rng(2)
    width, rows = maxent_lm.WIDTH, []
    for t in range(20):
        for s in range(3):
            row = np.flatnonzero(r.random(50) < 0.3).astype(np.int16)
            rows.append((t, s, 5, row, (r.random(len(row)) + 0.1).astype(np.float32), r.normal(size=(len(row), width)).astype(np.float32)))
    df = spark.createDataFrame([(t, s, n, *(v[0] for v in maxent_lm._packed(row, e, x).values())) for t, s, n, row, e, x in rows], f"trainer int, {maxent_lm.CHANGES}")
    for fan in (3, 256):
        got = {x["shard"]: x for x in maxent_lm.mean_changes(df, 20, fan).collect()}
        for s in range(3):
            share, total = np.zeros(50), np.zeros((50, width))
            for _, k, _, row, e, x in rows:
                if k == s:
                    share[row] += e
                    total[row] += e[:, None] * x.astype(float)
            row, energy, change = maxent_lm._unpacked(*(got[s][k] for k in ("row", "energy", "scale", "change")))
            assert list(row) == list(np.flatnonzero(share)) and got[s]["positions"] == 100
            assert energy == pytest.approx(share[row], rel=1e-4)
            assert change == pytest.approx(total[row] / share[row, None], abs=0.06)


def test_factors_sum_to_one():
    """Over all members, the three factors of one history add up to one."""
    r = np.random.default_rng(1)
    bits, width = 4, maxent_lm.WIDTH
    weights = r.normal(size=(maxent_lm.n_rows(bits), width)).astype(np.float32)
    bias = maxent_lm.biases(r.integers(0, 50, maxent_lm.MEMBERS))
    m = np.arange(maxent_lm.MEMBERS)
    word = r.integers(-(1 << 62), 1 << 62, maxent_lm.MEMBERS)
    history = np.tile([5, 900, 31000], len(m))
    ids = np.empty(4 * len(m), np.int64)
    ids.reshape(-1, 4)[:, :3], ids.reshape(-1, 4)[:, 3] = history.reshape(-1, 3), m
    text = maxent_lm.Text(ids, np.tile(np.arange(4), len(m)), np.full(len(m), 4), word, m.astype(np.int32))
    assert (10 ** maxent_lm.log_factors(text, weights, bias, bits)).reshape(-1, 4)[:, 3].sum() == pytest.approx(1, rel=1e-3)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body><nav class="menu"><a href=x>Home</a></nav>
<header>Site</header><div class="cookie-notice"><p>We use cookies.</p></div><article><h1>The &amp; title</h1><p>First <b>para</b>graph&nbsp;here,\n with   space.</p><p>Second one is short.<p>Third one stands here and goes on for some more words.</p></article>
<div class="comments"><p>Great text, thanks a lot for it!</p></div><aside>More</aside><form><label>Search</label></form><footer>&copy; Site</footer></body></html>"""


def test_extraction(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<div><p>unclosed <article><p>text")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.op2_query(pages).collect()}
    assert got[1]["text"] == "The & title First paragraph here, with space. Second one is short. Third one stands here and goes on for some more words."
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0
    assert html_extract.op2_query(pages.where("page_id < 0")).collect() == []


def test_extraction_on_held_out_layouts():
    pairs = [html_extract.training_nodes(k) for k in range(300)]
    forest = html_extract.boost(np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs]))
    right = total = 0
    for k in range(9000, 9060):
        x, y = html_extract.training_nodes(k)
        nodes = html_extract.parse(html_extract._Composer(k).page().replace(html_extract.MARKS[0], "").replace(html_extract.MARKS[1], ""))
        kept = html_extract.decode(nodes, forest.log_odds(x))
        right += int((kept[1:] == (y[1:] > 0)).sum())
        total += len(y) - 1
        for n, node in enumerate(nodes):
            assert not kept[n] or n == 0 or kept[node.parent]
    assert right / total > 0.97
