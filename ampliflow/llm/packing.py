"""Best-fit packing by minimum bin slack.

Documents become token counts on the executors. Only the counts of leftover lengths (at most one for each length below the
sequence length) are planned centrally: for each bin, a subset-sum bitset over the lengths that are left finds the fullest
feasible combination, which is removed as often as its lengths allow. The size of the plan depends on the number of
distinct lengths, not on the number of documents. Pieces then find their places through their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampliflow.llm.common import given, id_or_marker, id_or_null, materialize, small_batches

SEQUENCE = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from texts to lists of ids, as the tokenizers library gives for the byte-level BPE file at ``path``.

    The same vocabulary and merges are run by tiktoken, which gives equal ids in less time.
    """
    import json

    import tiktoken

    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode(text, allowed_special="all")


def pieces_of(ids: np.ndarray, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole sequences at its end, what is left over first."""
    n = len(ids)
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def tokenized(path: str, size: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for batch in batches:
            rows, same = [], {}
            for doc_id, text in zip(batch["id"], batch["text"]):
                if text not in same:
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    same[text] = [(k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(pieces_of(ids, size))]
                rows += [(doc_id, *x) for x in same[text]]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"piece": "int32"})

    return run


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, repeats allowed up to their counts, whose sum is the most that ``room`` holds; longer ones are taken first.

    ``reach[k]`` has bit s set if some of the first k lengths add up to s; a length that occurs m times enters as runs of
    1, 2, 4 ... of it, so each step is one shift of the bitset.
    """
    lengths = sorted(counts, reverse=True)
    mask, reach, items = (1 << (room + 1)) - 1, [1], []
    for n in lengths:
        left, run = min(counts[n], room // n), 1
        while left > 0:
            take = min(run, left)
            items.append((n, take))
            reach.append((reach[-1] | reach[-1] << (n * take)) & mask)
            left, run = left - take, 2 * run
        if reach[-1] >> room & 1:
            break
    at, out = reach[-1].bit_length() - 1, []
    for k in range(len(items) - 1, -1, -1):
        if not reach[k] >> at & 1:
            n, take = items[k]
            out += [n] * take
            at -= n * take
    return sorted(out, reverse=True)


def plan(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank + 1, sequence of the first rank, offset) for all pieces of each length.

    Each bin starts with the longest length that is left; the fullest combination for the rest of the bin joins it.
    """
    left, used, places, bins = {n: c for n, c in counts.items() if c > 0}, dict.fromkeys(counts, 0), [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        members = [longest, *fullest({n: c for n, c in rest.items() if c and n <= size - longest}, size - longest)]
        times = min(left[n] // members.count(n) for n in set(members))
        offset = 0
        for n in members:
            places.append((n, used[n], used[n] + times, bins, offset))
            used[n] += times
            left[n] -= times
            offset += n
        left = {n: c for n, c in left.items() if c}
        bins += times
    return places


def best_fit_packing(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece with its sequence and the offset in it; see ``PIECES`` for the other columns.

    Null and empty texts are one end token. Rows of equal id are packed as documents of their own; a null id stays null.
    Only ``id_col`` and ``text_col`` are read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(id_or_marker(id_col).alias("id"), F.col(text_col).alias("text"))
    pieces = materialize(rows.mapInPandas(tokenized(tokenizer, size, end_id), PIECES), "op10-pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    places = plan(counts, size)
    place = given(spark, {c: [x[k] for x in places] for k, c in enumerate(("length", "from_rank", "to_rank", "first_sequence", "offset"))})
    # Ranks are counted in groups within a length. n pieces have about sqrt(n) groups of sqrt(n) pieces, so neither the ranks in
    # a group nor the groups of a length are one large task, however many pieces share a length.
    ways = given(spark, {"length": list(counts), "ways": [isqrt(c) + 1 for c in counts.values()]})
    pieces = pieces.join(F.broadcast(ways), "length").withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.col("ways"))).drop("ways")
    grouped = pieces.groupBy("length", "group").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.select("length", "group", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("inner", inner).join(starts, ["length", "group"]).withColumn("rank", F.col("before") + F.col("inner"))
    # The places of a length as one sorted array of at most a few hundred entries: no range join over the pieces.
    lists = place.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("from_rank", "to_rank", "first_sequence", "offset"))).alias("places"))
    at = F.get(F.filter("places", lambda p: (p["from_rank"] <= F.col("rank")) & (F.col("rank") < p["to_rank"])), F.lit(0))
    found = ranked.join(F.broadcast(lists), "length").withColumn("at", at)
    sequence = F.col("at.first_sequence") + F.col("rank") - F.col("at.from_rank")
    return found.select(id_or_null("doc_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), F.col("at.offset").alias("offset"))
