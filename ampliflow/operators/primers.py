"""Primer search: the place of the fewest mismatches in references, and near the start of reads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ampliflow.functions.dna import base_bits, bytes_of, match_masks

HIT = StructType([StructField("mm", IntegerType()), StructField("pos", IntegerType())])


#: Symbols of sequences that are scanned at a time; what belongs to them stays in the cache.
_BLOCK = 1 << 17


def _scan(unlike: dict[int, np.ndarray], n: int, begin: np.ndarray, size: np.ndarray, pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mismatches, position) of the leftmost best place of the pattern in each part of ``n`` symbols; -1 where a part is shorter.

    ``unlike`` has for each mask of the pattern a 1 where the symbol doesn't match it.
    """
    plen = len(pattern)
    mm, pos = np.full(len(size), -1, np.int32), np.full(len(size), -1, np.int32)
    fits = np.flatnonzero(size >= plen)
    if not plen or not len(fits):
        return mm, pos
    cost = np.zeros(n - plen + 1, np.uint8)
    for k, mask in enumerate(pattern.tolist()):
        cost += unlike[mask][k : n - plen + 1 + k]
    kind, bits = (np.int32, 22) if n < 1 << 22 else (np.int64, 40)
    key = np.empty(len(cost) + 1, kind)  # the last one ends the last part
    np.left_shift(cost, bits, out=key[:-1], dtype=kind)
    key[:-1] |= np.arange(len(cost), dtype=kind)
    key[-1] = np.iinfo(kind).max
    edges = np.stack([begin[fits], begin[fits] + size[fits] - plen + 1], axis=1).ravel()
    least = np.minimum.reduceat(key, edges)[::2]
    mm[fits], pos[fits] = least >> bits, (least & ((1 << bits) - 1)) - begin[fits]
    return mm, pos


def best_hits_of(sequences: list[str], primers: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mismatches, position) by sequence and primer, for primers shorter than 256; -1 where the sequence is shorter than the primer."""
    masks, bits = match_masks(), base_bits()
    patterns = [masks[bytes_of(p)] for p in primers]
    size = np.fromiter(map(len, sequences), np.int64, len(sequences))
    mm, pos = np.empty((len(sequences), len(primers)), np.int32), np.empty((len(sequences), len(primers)), np.int32)
    part = np.cumsum(size) // _BLOCK
    for edge in np.split(np.arange(len(size)), np.flatnonzero(np.diff(part)) + 1):
        if not len(edge):
            continue
        literal = bits[bytes_of("".join(sequences[edge[0] : edge[-1] + 1]))]
        own = size[edge]
        unlike = {m: ((literal & np.uint8(m)) == 0).view(np.uint8) for m in {m for pattern in patterns for m in pattern.tolist()}}
        for k, pattern in enumerate(patterns):
            mm[edge, k], pos[edge, k] = _scan(unlike, len(literal), np.cumsum(own) - own, own, pattern)
    return mm, pos


def best_hits(primers: list[str]):
    """A function of a sequence column: an array with the hit (mm, pos) of each primer, null where the sequence is shorter.

    Said to be not deterministic, so that a filter on a hit isn't pushed below and the kernel run twice.
    """

    @F.pandas_udf(ArrayType(HIT))
    def hits(sequence: pd.Series) -> pd.Series:
        mm, pos = best_hits_of(sequence.fillna("").tolist(), primers)
        return pd.Series([[None if m < 0 else {"mm": m, "pos": p} for m, p in zip(x, y)] for x, y in zip(mm.tolist(), pos.tolist())], dtype=object)

    return hits.asNondeterministic()


def edge_hits(heads: list[str], sizes: np.ndarray, primer: str, region: int, masks: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cost, offset) for reads of ``sizes`` symbols, as long as the primer or longer, of which ``heads`` are the first region + primer.

    Offsets run from one less than the primer's length before the read up to, but not including, the lesser of ``region``
    and what the read has beyond the primer. Each symbol before the read costs one. The leftmost of the cheapest wins.
    """
    width = region + len(primer)
    block = bits[bytes_of("".join([h[:width].ljust(width) for h in heads]))].reshape(len(heads), width)
    return _edge_costs(np.ascontiguousarray(block.T), sizes, masks[bytes_of(primer)], region)


def _edge_costs(block: np.ndarray, sizes: np.ndarray, pattern: np.ndarray, region: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``edge_hits`` for a block with a column for each read; it has ``region`` + the pattern's length rows or more.

    A step for each symbol of the pattern adds to the costs of all offsets of all reads. Costs fit a byte, as patterns are shorter than 255.
    """
    plen, n = len(pattern), block.shape[1]
    offsets = plen - 1 + region
    padded = np.zeros((offsets + plen - 1, n), np.uint8)  # what lies before a read matches nothing
    padded[plen - 1 :] = block[: offsets]
    cost = np.zeros((offsets, n), np.uint8)
    for k, mask in enumerate(pattern):
        cost += (padded[k : k + offsets] & mask) == 0
    end = np.minimum(region, sizes - plen)  # the first offset that isn't tried
    if len(end) and end.min() < region:
        cost[np.arange(1 - plen, region)[:, None] >= end[None, :]] = 255
    at = cost.argmin(axis=0)
    least = cost[at, np.arange(n)].astype(np.int64)
    return np.where(least == 255, 1 << 20, least), at - (plen - 1)


def edge_ends(pairs: list[tuple[str, str]], most: int, region: int = 20):
    """A function of two read columns: numbers ``fwd<r>`` and ``bwd<r>`` for each pair of primers, where they end in the reads if both fit with ``most`` mismatches or fewer, else 0.

    All primers are compared in one call, only the heads of the reads go to Python, and equal heads of a batch are looked at once.
    """
    width = max((len(p) for pair in pairs for p in pair), default=0) + region

    # Columns of numbers, 0 where a primer doesn't fit: objects for each read would take most of the time.
    @F.pandas_udf(", ".join(f"fwd{r} int, bwd{r} int" for r in range(len(pairs))) or "none int")
    def of(fwd: pd.Series, bwd: pd.Series) -> pd.DataFrame:
        masks, bits = match_masks(), base_bits()
        n = len(fwd)
        out: dict[str, np.ndarray] = {} if pairs else {"none": np.zeros(n, np.int32)}
        sides = []
        for heads in (fwd, bwd):
            number, own = pd.factorize(heads)  # -1 for null
            number, own = np.where(number < 0, len(own), number), [*own, ""]
            block = bits[bytes_of("".join([h.ljust(width) for h in own]))].reshape(len(own), width)
            # A head is as long as primer and region: what a read has beyond it allows no further place.
            sides.append((number, np.ascontiguousarray(block.T), np.array([*map(len, own[:-1]), -1], np.int64)))
        for r, pair in enumerate(pairs):
            fits, ends = np.ones(n, bool), []
            for (number, block, sizes), primer in zip(sides, pair):
                cost, at = _edge_costs(block, sizes, masks[bytes_of(primer)], region)
                fits &= ((cost <= most) & (sizes >= len(primer)))[number]
                ends.append((at + len(primer))[number])  # 1 at least
            for side, end in zip(("fwd", "bwd"), ends):
                out[f"{side}{r}"] = np.where(fits, end, 0).astype(np.int32)
        return pd.DataFrame(out)

    kernel = of.asNondeterministic()

    def ends_in(fwd: str | Column, bwd: str | Column) -> Column:
        fwd, bwd = (F.col(c) if isinstance(c, str) else c for c in (fwd, bwd))
        return kernel(F.left(fwd, F.lit(width)), F.left(bwd, F.lit(width)))

    return ends_in


def by_region(ends: Column, n: int) -> list[Column]:
    """(region, fwd_end, bwd_end) of each of ``n`` pairs of primers in what ``edge_ends`` gives, null where they don't fit."""
    return [F.when(ends[f"fwd{r}"] > 0, F.struct(F.lit(r).alias("region"), ends[f"fwd{r}"].alias("fwd_end"), ends[f"bwd{r}"].alias("bwd_end"))) for r in range(n)]


def edge_regions(pairs: list[tuple[str, str]], most: int, region: int = 20):
    """A function of two read columns: an array of (region, fwd_end, bwd_end) for every pair of primers that both fit with ``most`` mismatches or fewer."""
    ends = edge_ends(pairs, most, region)

    def regions(fwd: str | Column, bwd: str | Column) -> Column:
        def listed(x: Column) -> Column:
            each = by_region(x, len(pairs))
            return F.filter(F.array(*each), lambda h: h.isNotNull()) if each else F.array().cast("array<struct<region:int,fwd_end:int,bwd_end:int>>")

        return F.get(F.transform(F.array(ends(fwd, bwd)), listed), F.lit(0))  # the kernel stands in it once

    return regions


def edge_hit(region: int = 20):
    """A function of (read, primer) columns; reads without an offset to try, and reads shorter than the primer, have no hit.

    Only the heads of the reads go to Python.
    """

    @F.pandas_udf(HIT)
    def hit(head: pd.Series, size: pd.Series, primer: pd.Series) -> pd.DataFrame:
        masks, bits = match_masks(), base_bits()
        mm, pos = np.full(len(head), -1), np.zeros(len(head), np.int64)
        has = head.notna().to_numpy() & primer.notna().to_numpy()
        length = size.fillna(0).to_numpy(np.int64)
        for p in primer[has].unique():
            at = np.flatnonzero(has & (primer == p).to_numpy() & (length >= len(p)))
            if len(at):
                cost, offset = edge_hits(head.iloc[at].tolist(), length[at], p, region, masks, bits)
                found = cost < 1 << 20
                mm[at[found]], pos[at[found]] = cost[found], offset[found]
        none = mm < 0
        return pd.DataFrame({"mm": pd.Series(mm, dtype="Int32").mask(none), "pos": pd.Series(pos, dtype="Int32").mask(none)})

    kernel = hit.asNondeterministic()

    def of(read: str | Column, primer: str | Column) -> Column:
        read, primer = (F.col(c) if isinstance(c, str) else c for c in (read, primer))
        return kernel(F.left(read, F.length(primer) + region), F.length(read), primer)

    return of
