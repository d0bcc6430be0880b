"""The trie of rebuilt conversations against one built node by node."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from ampliflow.llm import conversation_trie as ct

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            pair = (role or "", text or "")
            digest = hashlib.sha256(f"{len(pair[0])}:{pair[0]}{pair[1]}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, digest), pair))
    return {c: [p for _, p in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def nodes(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for prefix, who in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        ends = sorted(c for c in who if len(convs[c]) == len(prefix))
        children = sum(len(p) == len(prefix) + 1 for p in below)
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        parent = min(members[prefix[:-1]]) if prefix else None
        out.add((min(who), len(prefix), parent, len(who), children, leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def conversations(seed, n=60):
    rng = random.Random(seed)
    lines = [("user", "hi"), ("user", "hallo é"), ("assistant", "yes"), ("system", ""), (None, "x"), ("user", None), ("", "")]
    out = []
    for c in rng.sample(range(-150, 420), n) + [0, 100, 1 << 40, (1 << 40) + 1]:
        length = rng.choice((1, 2, 3, 5, 9))
        out += [(c, rng.choice((t, t, t, None)), *rng.choice(lines)) for t in range(length)]
    return out + [(None, 0, "user", "nobody's"), (3, 1, "user", "same"), (3, 1, "user", "same")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_built_trie(spark, seed):
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", depth string, x1 int").repartition(4)
    assert {tuple(r) for r in ct.op13_query(df).collect()} == nodes(rebuilt(ordered(rows)))
    got = ct.conversation_trie(df).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == nodes(ordered(rows))


def test_long_conversations_and_blocks(spark, monkeypatch):
    """Blocks of four turns and segments of two ids, over many ranges of turns."""
    monkeypatch.setattr(ct, "BLOCK_BITS", 2)
    monkeypatch.setattr(ct, "SEGMENT_BITS", 1)
    rows = [(c, t, "user", f"turn {t if t < 30 + c % 4 else (t, c)}") for c in range(5, 25) for t in range(45 if c % 2 else 30)]
    rows += [(c, t, "user", f"turn {t}") for c in range(200, 230) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert {tuple(r) for r in ct.op13_query(df).collect()} == nodes(rebuilt(ordered(rows)))


def test_turnless_members(spark):
    """A conversation that has fewer turns than it would take from an absent first one has none left."""
    short = [c for c in range(1, 400) if zlib.crc32(str(c).encode()) % 6 >= 2][:20]
    rows = [(c, 0, "user", "only") for c in short if c >= 100 or c % 100]
    rows = [r for r in rows if r[0] % 100]
    got = ct.op13_query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {tuple(r) for r in got} == nodes(rebuilt(ordered(rows))) and len(got) == 1


def test_sql_and_empty(spark):
    rows = [r for r in conversations(3) if r[0] is None or r[0] >= 0]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = ct.op13_query(df)
    assert {tuple(r) for r in got.collect()} == set(con.sql(f"SELECT {', '.join(got.columns)} FROM ({ct.ORACLE})").fetchall())
    assert ct.op13_query(df.where("turn > 100")).collect() == []
