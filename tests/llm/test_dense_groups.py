"""Dense groups of near fingerprints, hubs, and cells that are cut by a second grid."""

import random
from itertools import combinations

import pytest

from ampliflow.llm import components, simhash_dedup


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def components_of(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def dense(seed):
    """A group of many fingerprints around each of a few, chains that leave them, and unrelated ones."""
    r = random.Random(seed)
    out = set()
    for _ in range(2):
        centre = r.getrandbits(64)
        low = r.sample(range(64), 9)  # all patterns of a few bits: neighbours differ in one
        for k in range(250):
            out.add(centre ^ sum(1 << b for n, b in enumerate(low) if k >> n & 1))
        for _ in range(40):
            x = centre
            for _ in range(6):  # up to three bits a step, at times a gap
                for b in r.sample(range(64), r.choice((1, 2, 3, 3, 4))):
                    x ^= 1 << b
                out.add(x)
    return sorted(signed(x) for x in out | {r.getrandbits(64) for _ in range(150)})


def near(fps, bits=3):
    return [(a, b) for a, b in combinations(fps, 2) if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= bits]


@pytest.mark.parametrize("crowd, fine", [(5, False), (5, True), (1000, True)])
def test_groups_of_linking_pairs(spark, crowd, fine):
    fps = dense(3)
    every = near(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long").repartition(3)
    links = [tuple(r) for r in simhash_dedup.linking_pairs(df, "test", crowd, fine).collect()]
    as_set = {tuple(sorted(x)) for x in links}
    assert as_set <= set(every)
    assert components_of(fps, links) == components_of(fps, every)
    if crowd == 1000:
        assert as_set == set(every) and len(links) == len(every)  # nothing is crowded: all pairs, each once
    else:
        assert len(links) < len(every) / 2


def test_a_dense_group_costs_its_size(spark):
    """All patterns of k bits: pairs grow with the square, links with the number of patterns."""
    counts = []
    for k in (8, 10):
        df = spark.createDataFrame([(n << 20,) for n in range(1 << k)], "fp long")
        counts.append((simhash_dedup.near_pairs(df).count(), simhash_dedup.linking_pairs(df, "test", 20, False).count()))
    (pairs, links), (more_pairs, more_links) = counts
    assert more_links < more_pairs / 4 and more_links / links < 0.75 * more_pairs / pairs


def test_hub(spark):
    links = [(0, k) for k in range(1, 3000)] + [(5000, 5001), (2999, 5001)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert len(got) == 3002 and set(got.values()) == {0}
