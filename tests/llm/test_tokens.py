import itertools
import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

from ampliflow.llm import bpe, packing
from ampliflow.llm.queries import tokenizer_path

ODD = [
    "", "   ", None, "a" * 5000, "aaa aaaa aaaaa", "Hello<|endoftext|>World <|startoftext|>", "ΑΣ ΟΔΟΣ σας", "İstanbul ǅ ﬁ", "é ́x", "a\x1cb\x1dc d\x85e f᠎g​h", "it's we'll I'D 'S ''s",
    "漢字かな 12３ ½", "\U0001f600\U0001f1e9 ok", "tab\tnl\n\r\x0b\x0c", "<|endoftext|", "x<|endoftext|><|endoftext|>y", "﻿bom", "a　b c",
]


def test_bpe_equals_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    r = random.Random(3)
    texts = ODD + ["".join(r.choice("aAbB 'sSlΣé́\n1٣!?<|>\x1f Ωßİ🙂") for _ in range(r.randrange(40))) for _ in range(300)]
    ids = list(own.encode(texts))
    for text, x in zip(texts, ids):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert x == want, repr(text)
        assert own.decode(x) == library.decode(want, skip_special_tokens=False)
    one_by_one = bpe.WordBpe(path)
    one_by_one._all_at_once = False
    assert list(one_by_one.encode([t for t in texts if len(t or "") < 100])) == [x for t, x in zip(texts, ids) if len(t or "") < 100]


def test_bpe_frames(spark):
    path = tokenizer_path("word_bpe_49k.json")
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(3, ODD[3], "x"), (None, "hello", "x")], "doc_id long, text string, n_tokens string")
    library = Tokenizer.from_file(path)
    got = bpe.op4_query(df, path).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        ids = library.encode("hello" if r["doc_id"] is None else ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest())
    there = bpe.bpe_decode(bpe.bpe_encode(df.where("doc_id = 10"), path), path).first()
    assert there["decoded"] == library.decode(list(there["ids"]), skip_special_tokens=False)
    assert bpe.op4_query(df.where("doc_id < 0"), path).collect() == []


def test_fullest_is_optimal():
    r = random.Random(1)
    for _ in range(300):
        room, counts = r.randint(1, 40), {r.randint(1, 20): r.randint(1, 3) for _ in range(4)}
        items = [n for n, k in counts.items() for _ in range(k)]
        best = max(sum(s) for k in range(len(items) + 1) for s in itertools.combinations(items, k) if sum(s) <= room)
        found = packing.fullest(counts, room)
        assert sum(found) == best and all(found.count(n) <= counts[n] for n in found)


def check(rows, size=2048):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def test_packing(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    texts = [None, "", "hi", "hi", "one two three " * 2000, "x", "a<|endoftext|>b", "été " * 300] + ["word " * k for k in range(200)]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(2, "hi", 0), (None, "hi", 0)], "doc_id long, text string, offset int")
    rows = packing.best_fit_packing(df, path).collect()
    library = Tokenizer.from_file(path)
    for k, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == k})
        assert sum(x[2] for x in own) == len(ids)
        assert all(x[3] == zlib.crc32(ids[x[1] : x[1] + x[2]].tobytes()) for x in own)
        assert all(x[2] == 2048 for x in own[1:])
    assert sum(r["doc_id"] == 2 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    total = sum(r["length"] for r in rows)
    assert check(rows) <= -(-total // 2048) + 1
    assert packing.best_fit_packing(df.where("doc_id < 0"), path).collect() == []


def test_packing_of_a_common_length(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    df = spark.createDataFrame([(k % 300, "red " * 700) for k in range(900)] + [(1000 + k, "red " * k) for k in range(90)], "doc_id long, text string")
    rows = packing.best_fit_packing(df, path).collect()
    assert len(rows) == 990 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 990
    assert check(rows) == 450


@pytest.mark.parametrize("n", [1, 2047, 2048, 2049, 5000])
def test_pieces(n):
    got = packing.pieces_of(np.zeros(n))
    assert sum(x for _, x in got) == n and all(x == 2048 for _, x in got[1:]) and got[0][1] <= 2048
