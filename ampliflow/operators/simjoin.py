"""Hamming-distance similarity join of read k-mers with the k-mers of a database.

Of s segments of a k-mer at most d hold a mismatch, so s - d are equal. Segments stand in c groups of neighbours; among
(r - 1) c + 1 equal ones some r are in one group. With s = d + (r - 1) c + 1, every pair within d therefore agrees on one of the
keys "these r segments of one group", however large d is: few mismatches take single long segments, many take combinations
of short ones. The family of keys with the least work for the sizes at hand is chosen. Keys that many k-mers share are split by
a second family over the bases outside their group, which must agree too.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliflow.operators.staging import stage

#: A k-mer block of at most so many bytes may be sent to every executor.
SCAN_BYTES = 64 << 20
#: Most keys of a family, and the k-mers of a key from which on it is split.
MOST_KEYS = 2000
HEAVY = 1000
#: Lengths of partial reads are rounded down to a multiple of this, for their keys only.
STEP = 16
#: Work of a candidate pair, and of a pair in a scan, where that of a seed row is 1.
_CANDIDATE, _SCANNED = 0.15, 0.025
#: Bases in one long, two bits each.
_BASES = 31
_ODD = int("01" * _BASES, 2)


@dataclass(frozen=True)
class Family:
    """Keys as tuples of positions, the group of each, and the positions of each group."""

    keys: tuple[tuple[int, ...], ...]
    groups: tuple[int, ...]
    ranges: tuple[tuple[int, int], ...]


def _shape(n: int, d: int, r: int, c: int) -> tuple[int, int, int]:
    """(segments, bases of the shortest key, keys) of a family over n bases."""
    s = d + (r - 1) * c + 1
    sizes = [s * (g + 1) // c - s * g // c for g in range(c)]
    return s, r * (n // s), sum(comb(g, r) for g in sizes)


@cache
def family(n: int, d: int, left: int = 1, right: int = 1) -> tuple[Family | None, float]:
    """The family over n bases with the least work to join ``left`` with ``right`` strings, and that work; None if there is none."""
    best, work = None, float("inf")
    for r in range(1, 9):
        for c in range(1, n + 1):
            s, bases, keys = _shape(n, d, r, c)
            if s > n:
                break
            if keys and keys <= MOST_KEYS and (now := keys * (left + right + _CANDIDATE * left * right / 4.0**bases)) < work:
                best, work = (r, c, s), now
    if best is None:
        return None, work
    r, c, s = best
    edges = [n * k // s for k in range(s + 1)]
    keys, groups, ranges = [], [], []
    for g in range(c):
        own = range(s * g // c, s * (g + 1) // c)
        ranges.append((edges[own.start], edges[own.stop]))
        for chosen in combinations(own, r):
            keys.append(tuple(p for k in chosen for p in range(edges[k], edges[k + 1])))
            groups.append(g)
    return Family(tuple(keys), tuple(groups), tuple(ranges)), work


def _masks(positions, words: int) -> list[int]:
    """Both bits of each position, as the words of ``packed`` have them; ``words`` is the length of the k-mers."""
    out = []
    for a in range(0, words, _BASES):
        width = min(_BASES, words - a)
        out.append(sum(3 << 2 * (width - 1 - (p - a)) for p in positions if a <= p < a + width))
    return out


def _constant(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _pack(bases: Column, k: int, symbols: str, digits: str) -> list[Column]:
    # Each word translates its own bases: the whole k-mer would be translated once for every word.
    return [F.conv(F.translate(F.substring(bases, 1 + a, min(_BASES, k - a)), symbols, digits), 4, 10).cast("long") for a in range(0, k, _BASES)]


def packed(kmer: Column, k: int) -> list[Column]:
    """Two bits a base; distances are bit counts, without leaving the JVM."""
    return _pack(kmer, k, "ACGT", "0123")


def _packed_query(q: Column, k: int) -> dict[str, Column]:
    """Words w of a query, and i and b with the positions that match anything (N, and beyond its end) and nothing (other codes)."""
    plain = F.regexp_replace(q, "[^ACGTN]", "X")
    as_digits = lambda digits, beyond: _pack(F.rpad(plain, k, "-"), k, "ACGTNX-", digits + beyond)
    columns = {"w": as_digits("012300", "0"), "i": as_digits("000030", "3"), "b": as_digits("000003", "0")}
    return {f"q_{name}{n}": c for name, words in columns.items() for n, c in enumerate(words)}


def _and(parts) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def _free(prefix: str, words: int) -> Column:
    """Whether no base of the mask ``m`` is blocked."""
    return _and(F.col(f"{prefix}i{k}").bitwiseOR(F.col(f"{prefix}b{k}")).bitwiseAND(F.get("m", F.lit(k))) == 0 for k in range(words))


def _hashed(prefix: str, words: int, *by: str) -> Column:
    return F.xxhash64(*by, *[F.col(f"{prefix}w{k}").bitwiseAND(F.get("m", F.lit(k))) for k in range(words)])


def _split_heavy(rows: DataFrame, prefix: str, heavy: DataFrame, groups: Column, masks: Column, words: int, blocked: bool) -> DataFrame:
    """Rows of heavy keys once for each key ``n2`` of the second family of their group; other rows have n2 = -1."""
    rows = rows.join(heavy, ["region", "cls", "n", "key"], "left").withColumn("g", F.get(F.get(groups, F.col("cls")), F.col("n")))
    light = rows.where("heavy IS NULL").select("*", F.lit(-1).alias("n2"), F.lit(0).cast("long").alias("key2"))
    more = rows.where("heavy").select("*", F.posexplode(F.get(F.get(masks, F.col("cls")), F.col("g"))).alias("n2", "m"))
    more = more.where(_free(prefix, words)) if blocked else more
    return light.unionByName(more.withColumn("key2", _hashed(prefix, words, "n2")).drop("m")).drop("heavy")


def _keyed_join(queries: DataFrame, kmers: DataFrame, d: int, k: int, classes: list[tuple[int, int, Family]], blocked: bool, heavy: int | None) -> DataFrame:
    """(region, q_no, kmer_id, mm) of queries, whose class ``cls`` is a place in ``classes`` of (length, number of N, family).

    With ``heavy``, keys of more than that many k-mers are split.
    """
    words, on = len(range(0, k, _BASES)), ["region", "cls", "n", "key"]
    of_class = [[_masks(p, k) for p in found.keys] for *_, found in classes]
    masks = _constant(of_class, "array<array<array<bigint>>>")
    q = queries.select("*", F.posexplode(F.get(masks, F.col("cls"))).alias("n", "m"))
    q = (q.where(_free("q_", words)) if blocked else q).withColumn("key", _hashed("q_", words, "cls", "n")).drop("m")
    # K-mers have the keys of every class.
    t = kmers.select("*", F.posexplode(masks).alias("cls", "own")).select("*", F.posexplode("own").alias("n", "m")).drop("own")
    t = t.withColumn("key", _hashed("k_", words, "cls", "n")).drop("m")
    # Only k-mers with a key of a query go on: frequent reads are few beside the k-mers of a large database.
    t = t.join(stage(q.select(*on).distinct(), "query-keys"), on, "left_semi")
    t = t if heavy is None else stage(t, "kmer-keys")  # they are counted and then joined: all k-mers have their keys made once

    apart = [F.col(f"q_w{j}").bitwiseXOR(F.col(f"k_w{j}")) for j in range(words)]
    unlike = [x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(_ODD)) for x in apart]
    counted, unequal = unlike, unlike
    if blocked:
        ignored, bad = [F.col(f"q_i{j}") for j in range(words)], [F.col(f"q_b{j}") for j in range(words)]
        counted = [u.bitwiseAND(F.bitwise_not(i)).bitwiseOR(b.bitwiseAND(F.lit(_ODD))) for u, i, b in zip(unlike, ignored, bad)]
        unequal = [u.bitwiseOR(i).bitwiseOR(b) for u, i, b in zip(unlike, ignored, bad)]
    distance = F.lit(0)
    for u in counted:
        distance = distance + F.bit_count(u)
    # A pair comes from the first key on which it agrees.
    agrees = lambda m: _and(unequal[j].bitwiseAND(F.get(m, F.lit(j))) == 0 for j in range(words))
    first = ~F.exists(F.slice(F.get(masks, F.col("cls")), 1, F.col("n")), agrees)
    if heavy is not None:
        second = []
        for n, ambiguous, found in classes:
            outside = [[p for p in range(n) if not a <= p < b] for a, b in found.ranges]
            rest = [family(len(o), d + ambiguous, heavy, heavy)[0] if o else None for o in outside]
            second.append([[_masks([o[p] for p in key], k) for key in f.keys] if f else [[0] * words] for o, f in zip(outside, rest)])
        masks2, groups = _constant(second, "array<array<array<array<bigint>>>>"), _constant([list(f.groups) for *_, f in classes], "array<array<int>>")
        many = stage(t.groupBy(*on).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > heavy).select(*on, F.lit(True).alias("heavy")), "heavy-keys")
        if not many.isEmpty():
            q, t = _split_heavy(q, "q_", many, groups, masks2, words, blocked), _split_heavy(t, "k_", many, groups, masks2, words, False).drop("g")
            on = [*on, "n2", "key2"]
            own = F.get(F.get(masks2, F.col("cls")), F.col("g"))
            first = first & ((F.col("n2") < 0) | ~F.exists(F.slice(own, 1, F.greatest("n2", F.lit(0))), agrees))
    pairs = q.join(t, on).withColumn("mm", distance.cast("int"))
    return pairs.where(F.col("mm") <= d).where(first).select("region", "q_no", "kmer_id", "mm")


def _classes(queries: DataFrame, k: int) -> DataFrame:
    """Adds the length of the prefix that keys are taken from (``prefix``), the number of N there, and whether a query is not of k plain bases."""
    length = F.least(F.length("q"), F.lit(k))
    n = F.when((length < STEP) | (length == k), length).otherwise(length - length % STEP).cast("int")
    count = F.length(F.regexp_replace(F.left("q", n), "[^N]", ""))
    return queries.select("*", n.alias("prefix"), count.alias("ambiguous"), (~(F.col("q").rlike("^[ACGT]+$") & (length == k))).alias("blocked"))


def seed_join(queries: DataFrame, kmers: DataFrame, d: int, k: int, heavy: int = HEAVY, scans: bool = True) -> DataFrame:
    """(region, q, kmer_id, mm) by keys that pairs within ``d`` must share; ``kmers`` are of ``k`` plain bases.

    Queries are classed by length and number of N. N matches anything, so a key that holds one is left out and d + N mismatches are
    allowed for; other codes match nothing. A class that a scan joins with less work is scanned if ``scans`` is set, as is one without any
    key (reads of no more bases than mismatches, whose result is all pairs).
    """
    rows = stage(_classes(queries.select("region", "q"), k).withColumn("q_no", F.monotonically_increasing_id()), "hamming-queries")
    sizes = rows.groupBy("prefix", "ambiguous").agg(F.count(F.lit(1)).alias("c"), F.max("blocked").alias("blocked")).collect()  # lengths, not queries
    n_kmers = kmers.count()
    classes, left, blocked = [], [], False
    for c in sorted(sizes):
        found, work = family(c["prefix"], d + c["ambiguous"], c["c"], n_kmers)
        if found is None or scans and work > _SCANNED * c["c"] * n_kmers:
            left.append((c["prefix"], c["ambiguous"]))
        else:
            classes.append((c["prefix"], c["ambiguous"], found))
            blocked = blocked or c["blocked"]
    numbers = [x for at, (n, a, _) in enumerate(classes) for x in (F.lit(f"{n},{a}"), F.lit(at))]
    found = []
    name = F.concat_ws(",", F.col("prefix").cast("string"), F.col("ambiguous").cast("string"))
    if classes:
        classed = rows.withColumn("cls", F.element_at(F.create_map(*numbers), name)).where("cls IS NOT NULL")
        asked = {column: value for column, value in _packed_query(F.col("q"), k).items() if blocked or column.startswith("q_w")}
        known = kmers.select("region", "kmer_id", *[w.alias(f"k_w{j}") for j, w in enumerate(packed(F.col("kmer"), k))])
        asked_for = classed.select("region", "q_no", "cls", *[value.alias(column) for column, value in asked.items()])
        pairs = _keyed_join(asked_for, known, d, k, classes, blocked, heavy if n_kmers > heavy else None)
        found.append(pairs.join(rows.select("q_no", "q"), "q_no").select("region", "q", "kmer_id", "mm"))
    if left:
        mine = rows.where(name.isin([f"{n},{a}" for n, a in left]))
        found.append(scan_join(mine.select("region", "q"), kmers, d))
    return reduce(DataFrame.unionByName, found) if found else queries.sparkSession.createDataFrame([], _FOUND)


def _scan_block(regions: np.ndarray, ids: np.ndarray, letters: np.ndarray, queries: pd.DataFrame, d: int) -> pd.DataFrame:
    """Every query against the k-mers of its region; ``letters`` has a row for each k-mer."""
    region_of, q_of, ids_of, mm_of = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    order = np.argsort(regions, kind="stable")
    known, edge = np.unique(regions[order], return_index=True)
    own = {int(r): order[a:b] for r, a, b in zip(known, edge, np.append(edge[1:], len(order)))}
    blocks = {r: (ids[at], letters[at]) for r, at in own.items()}
    for region, q in zip(queries["region"], queries["q"]):
        if region in blocks:
            some, table = blocks[region]
            mine = np.frombuffer(q.encode(), np.uint8)
            n = min(len(mine), table.shape[1])
            mm = ((table[:, :n] != mine[:n]) & (mine[:n] != ord("N"))).sum(axis=1)
            hit = np.flatnonzero(mm <= d)
            region_of += [region] * len(hit)
            q_of += [q] * len(hit)
            ids_of.append(some[hit])
            mm_of.append(mm[hit].astype(np.int32))
    return pd.DataFrame({"region": np.array(region_of, np.int32), "q": pd.Series(q_of, dtype=object), "kmer_id": np.concatenate(ids_of), "mm": np.concatenate(mm_of)})


_FOUND = "region int, q string, kmer_id long, mm int"


def _matrix(kmers) -> np.ndarray:
    return np.frombuffer("".join(kmers).encode(), np.uint8).reshape(len(kmers), -1)


def scan_join(queries: DataFrame, kmers: DataFrame, d: int, limit: int = SCAN_BYTES) -> DataFrame:
    """Every query against the whole k-mer block of its region.

    N in a query matches anything, other ambiguity codes nothing; shorter queries compare with prefixes. K-mers have one
    length. A block of at most ``limit`` bytes goes to the executors as a whole. Beyond it, k-mers and queries are dealt by
    hashes into parts below a quarter of the limit, and each part of the one meets each part of the other in a task of its own.
    """
    size = kmers.agg(F.sum(F.length("kmer") + 12)).first()[0] or 0
    if size <= limit:
        table = kmers.select(F.col("region").cast("int").alias("region"), "kmer_id", "kmer").toArrow()
        block = table["region"].to_numpy(), table["kmer_id"].to_numpy(), _matrix(table["kmer"].to_pylist()) if len(table) else np.zeros((0, 0), np.uint8)
        sent = queries.sparkSession.sparkContext.broadcast(block)

        def scan(frames):
            for frame in frames:
                yield _scan_block(*sent.value, frame, d)

        return queries.select("region", "q").mapInPandas(scan, _FOUND)
    most = max(limit // 4, 1)
    parts = int(size // most) + 1
    shares = int((queries.agg(F.sum(F.length("q") + 12)).first()[0] or 0) // most) + 1

    def dealt(df: DataFrame, key: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        mine = df.withColumn(own, F.pmod(F.xxhash64("region", key), F.lit(n_own)).cast("int"))
        return mine.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))).groupBy("_part", "_share")

    def meet(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        letters = _matrix(known["kmer"].tolist()) if len(known) else np.zeros((0, 0), np.uint8)
        return _scan_block(known["region"].to_numpy(), known["kmer_id"].to_numpy(), letters, asked, d)

    right = dealt(kmers.select("region", "kmer_id", "kmer"), "kmer", "_part", parts, "_share", shares)
    return dealt(queries.select("region", "q"), "q", "_share", shares, "_part", parts).cogroup(right).applyInPandas(meet, _FOUND)


def hamming_join(queries: DataFrame, kmers: DataFrame, d: int, k: int, strategy: str = "auto") -> DataFrame:
    """(region, q, kmer_id, mm) of all pairs of distinct queries (region, q) and k-mers (region, kmer_id, kmer) within ``d``.

    ``k`` is the length of the queries and at most that of the k-mers, which compare by their prefix; shorter queries compare with shorter
    prefixes, N matches anything and other ambiguity codes nothing. "seed" joins by shared keys wherever there are any, "scan" compares all
    pairs, "auto" takes for each class of queries what is less work at its size.
    """
    if strategy == "scan":
        return scan_join(queries, kmers, d)
    prefix = kmers.select("region", "kmer_id", F.left("kmer", F.lit(k)).alias("kmer"))
    return seed_join(queries, prefix, d, k, scans=strategy != "seed")
