"""The Hamming join by shared keys against all pairs: many mismatches, partial reads, ambiguity codes, frequent keys."""

import random
from collections import Counter
from itertools import combinations

import pytest

from ampliflow.operators import simjoin
from ampliflow.operators.simjoin import family, hamming_join, seed_join


def related(seed, n, k, families=6, most=25):
    """Sequences of a few families that differ in up to ``most`` bases."""
    r = random.Random(seed)
    roots = ["".join(r.choice("ACGT") for _ in range(k)) for _ in range(families)]
    out = []
    for _ in range(n):
        s = list(r.choice(roots))
        for p in r.sample(range(k), r.randrange(min(most, k))):
            s[p] = r.choice("ACGT")
        out.append("".join(s))
    return out


def distance(q, kmer):
    return sum(a != b and a != "N" for a, b in zip(q, kmer))


def joined(spark, queries, kmers, d, k, **how):
    q = spark.createDataFrame([(g, s) for g in (0, 1) for s in queries], "region int, q string").repartition(3)
    t = spark.createDataFrame([(n % 2, n, s) for n, s in enumerate(kmers)], "region int, kmer_id long, kmer string").repartition(2)
    if how:
        found = seed_join(q, t, d, k, **how)
    else:
        found = hamming_join(q, t, d, k)
    got = sorted(tuple(r) for r in found.collect())
    want = sorted((n % 2, s, n, mm) for s in queries for n, x in enumerate(kmers) if (mm := distance(s, x)) <= d)
    assert got == want
    return got


@pytest.mark.parametrize("n, d", [(6, 2), (9, 3), (11, 4), (12, 5)])
def test_every_pair_shares_a_key(n, d):
    """Wherever the d mismatches are, some key has none."""
    for sizes in ((1, 1), (1000, 1000), (10**7, 10**7), (10**12, 10**12)):
        found, _ = family(n, d, *sizes)
        for bad in combinations(range(n), d):
            assert any(not set(key) & set(bad) for key in found.keys)
        for key, g in zip(found.keys, found.groups):
            a, b = found.ranges[g]
            assert all(a <= p < b for p in key)


@pytest.mark.parametrize("sizes", [(10, 10), (10**6, 10**6), (10**9, 10**9)])
def test_families_of_real_sizes(sizes):
    r = random.Random(1)
    for k, d in ((160, 2), (160, 3), (160, 12), (160, 20), (150, 20), (96, 20), (16, 2)):
        found, _ = family(k, d, *sizes)
        keys = [set(x) for x in found.keys]
        assert len(keys) <= simjoin.MOST_KEYS
        for _ in range(200):
            bad = set(r.sample(range(k), d))
            assert any(not x & bad for x in keys)
    assert family(5, 5)[0] is None


@pytest.mark.parametrize("d", [3, 7, 12, 20])
@pytest.mark.parametrize("heavy", [1000, 4])
def test_many_mismatches(spark, d, heavy):
    """With ``heavy=4`` nearly all keys of these few families are split by a second one."""
    kmers = related(d, 150, 160)
    found = joined(spark, sorted(set(related(d, 90, 160)[20:] + kmers[:20])), kmers, d, 160, heavy=heavy, scans=False)
    assert len(found) > 100


def test_candidates_are_few():
    """Unrelated sequences hardly meet at 20 mismatches, though a scan compares them all."""
    r = random.Random(8)
    queries, kmers = [["".join(r.choice("ACGT") for _ in range(160)) for _ in range(400)] for _ in range(2)]
    found, _ = family(160, 20, 400, 400)
    candidates = 0
    for key in found.keys:
        seen = Counter(tuple(s[p] for p in key) for s in kmers)
        candidates += sum(seen[tuple(s[p] for p in key)] for s in queries)
    assert candidates < len(queries) * len(kmers) / 20
    found, _ = family(160, 20, 10**6, 10**6)
    assert sum(4.0 ** -len(key) for key in found.keys) < 1e-4


@pytest.mark.parametrize("heavy", [1000, 3])
def test_partial_reads(spark, heavy):
    r = random.Random(4)
    kmers = related(3, 80, 60, most=8)
    queries = {s[: r.choice((20, 31, 32, 33, 47, 48, 59, 60))] for s in related(3, 80, 60, most=8)} | {kmers[0][:17], kmers[1] + "ACG"}
    joined(spark, sorted(queries), kmers, 2, 60, heavy=heavy, scans=False)


def test_reads_of_few_bases(spark):
    """Where no key exists all pairs are compared: these match nearly everything."""
    kmers = related(5, 30, 40)
    joined(spark, ["", "A", "ACG", "NN", "NNNNNNNNNNNNNNNNNNNN", "R", kmers[0], kmers[0][:18]], kmers, 3, 40, heavy=1000, scans=False)


@pytest.mark.parametrize("heavy", [1000, 3])
def test_ambiguous_queries(spark, heavy):
    r = random.Random(6)
    kmers = related(7, 80, 60, most=6)
    queries = set()
    for s in related(7, 80, 60, most=6):
        s = list(s)
        for p in r.sample(range(60), r.randrange(5)):
            s[p] = r.choice("NNNRY")
        queries.add("".join(s)[: r.choice((60, 60, 45))])
    joined(spark, sorted(queries), kmers, 3, 60, heavy=heavy, scans=False)


def test_choice_by_size(spark):
    """At these sizes the default scans some classes and joins others by keys; the result is the same."""
    kmers = related(2, 60, 40, most=10)
    joined(spark, sorted({s[: 40 - (n % 3) * 12] for n, s in enumerate(kmers)}), kmers, 6, 40)
    t = spark.createDataFrame([(0, 0, "A" * 40)], "region int, kmer_id long, kmer string")
    assert hamming_join(spark.createDataFrame([], "region int, q string"), t, 2, 40).collect() == []
    assert hamming_join(spark.createDataFrame([(0, "A" * 40)], "region int, q string"), t.where("kmer_id > 0"), 2, 40).collect() == []


def test_only_kmers_with_a_key_of_a_query_are_shuffled(spark):
    """The keys of queries come first: k-mers without one are left out before the join, and the pairs are all there."""
    import random

    from ampliflow.operators import simjoin

    r = random.Random(3)
    kmers = ["".join(r.choice("ACGT") for _ in range(60)) for _ in range(300)]
    near = kmers[7][:20] + ("A" if kmers[7][20] != "A" else "C") + kmers[7][21:]
    known = spark.createDataFrame([(0, n, s) for n, s in enumerate(kmers)], "region int, kmer_id long, kmer string")
    asked = spark.createDataFrame([(0, near), (0, kmers[5][:30] + "N" + kmers[5][31:])], "region int, q string")
    found = simjoin.seed_join(asked, known, 2, 60, scans=False)
    assert sorted((x["kmer_id"], x["mm"]) for x in found.collect()) == [(5, 0), (7, 1)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
