"""SimHash near-duplicates: fingerprints are embedded as bit counts of segments and joined on a grid.

The counts of a fingerprint's 32 two-bit segments are a point; the Manhattan distance of two points is at most the
Hamming distance of their fingerprints. A pair within distance 3 is within 1 on the left or on the right 16 segments, so
on one of the two grids of unit cells it lies in the same cell or in cells that touch: one side visits its own cell and
those one step up, the other only its own. Pairs that pass the bound on all segments are verified exactly. Of many
fingerprints, cells are cut once more by the quarters of the other half; in crowded cells groups stand in for their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ampliflow.llm.common import materialize, small_batches
from ampliflow.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Fingerprints of a cell from which on it is crowded, and of all from which on cells are cut by a second grid.
CROWD = 1000
FINE_FROM = 20_000_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = 0x5555555555555555


def fingerprint_of(text: str | None) -> int:
    """The 64-bit fingerprint as a signed integer; zero for texts without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - SHINGLE + 1)
    if n == 1:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
        digest, cut = xxhash.xxh64_intdigest, ends[SHINGLE - 1 :].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, cut)]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], np.uint64)
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint_of(x) for x in batch], dtype="int64")


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 segments, each in unary in its own two bits; the Manhattan distance of two is the bit count of their XOR."""
    low, high = fp.bitwiseAND(F.lit(_ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_ODD))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _cells(fps: DataFrame, steps: bool, fine: bool) -> DataFrame:
    """(fp, point, grid, cell, step, quarter, part) and further columns of ``fps``: the cells of the left and right half.

    With ``steps`` also the cells one count higher. With ``fine``, cells are cut by the two quarters of the other half, of which one agrees within
    one count: here those without ``steps`` visit the parts one count lower and higher.
    """
    point = F.col("point")

    def half(shift: int) -> list[Column]:
        own = F.shiftrightunsigned(point, shift).bitwiseAND(F.lit(0xFFFFFFFF))
        cells = [own]
        for k in range(0, 32, 2) if steps else ():
            count = F.shiftright(own, k).bitwiseAND(F.lit(3))
            cells.append(F.when(count == 0, own + (1 << k)).when(count == 1, own + (2 << k)))
        return [F.struct(F.lit(shift).alias("grid"), c.alias("cell"), F.lit(k > 0).alias("step")) for k, c in enumerate(cells)]

    def quarters(shift: int) -> list[Column]:
        out = []
        for q in (0, 1):
            own = F.shiftrightunsigned(point, (32 - shift) + 16 * q).bitwiseAND(F.lit(0xFFFF))
            parts = [own]
            for k in range(0, 16, 2) if not steps else ():
                count = F.shiftright(own, k).bitwiseAND(F.lit(3))  # 0, 1 or 2 in unary: 0, 1, 3
                parts.append(F.when(count == 0, own + (1 << k)).when(count == 1, own + (2 << k)))
                parts.append(F.when(count == 1, own - (1 << k)).when(count == 3, own - (2 << k)))
            out += [F.struct(F.lit(q).alias("quarter"), p.alias("part")) for p in parts]
        return out

    rows = fps.withColumn("point", embedding(F.col("fp")))
    found = None
    for shift in (0, 32):
        own = rows.select("*", F.explode(F.array(*half(shift))).alias("c")).select(*rows.columns, "c.*").where("cell IS NOT NULL")
        if fine:
            own = own.select("*", F.explode(F.array(*quarters(shift))).alias("p")).select(*own.columns, "p.*").where("part IS NOT NULL")
        else:
            own = own.withColumns({"quarter": F.lit(0), "part": F.lit(0).cast("long")})
        found = own if found is None else found.unionByName(own)
    return found


#: Cells; a pair of rows in the same one is compared.
CELL = ["grid", "cell", "quarter", "part"]


def _meet(a: DataFrame, b: DataFrame, radius: int, fine: bool) -> DataFrame:
    """(fp_a, fp_b) within ``radius`` bits from rows of ``_cells`` with and without steps, each pair once."""
    a = a.select(*[F.col(c).alias(f"a_{c}") for c in ("fp", "point", "step", *CELL)])
    apart = F.col("a_point").bitwiseXOR(F.col("point"))
    on = F.lit(True)
    for c in CELL:
        on = on & (F.col(f"a_{c}") == F.col(c))
    once = (F.col("a_step") | (F.col("a_fp") < F.col("fp"))) & ((F.col("grid") == 0) | (F.bit_count(apart.bitwiseAND(F.lit(0xFFFFFFFF))) > 1))
    if fine:
        first = F.when(F.col("grid") == 0, F.shiftrightunsigned(apart, 32)).otherwise(apart).bitwiseAND(F.lit(0xFFFF))
        once = once & ((F.col("quarter") == 0) | (F.bit_count(first) > 1))
    bound = F.bit_count(apart) <= radius
    exact = (F.bit_count(F.col("a_fp").bitwiseXOR(F.col("fp"))) <= radius) & (F.col("a_fp") != F.col("fp"))
    return a.join(b, on & once & bound & exact).select(F.col("a_fp").alias("fp_a"), F.col("fp").alias("fp_b"))


def near_pairs(fps: DataFrame, radius: int = RADIUS, fine: bool = False) -> DataFrame:
    """(fp_a, fp_b) for every pair of the distinct fingerprints ``fp`` within ``radius`` (3 or less) bits, once each."""
    if radius > 3:
        raise ValueError("two grids find pairs within 3 bits")
    return _meet(_cells(fps.select("fp"), True, fine), _cells(fps.select("fp"), False, fine), radius, fine)


def one_bit_links(fps: DataFrame) -> DataFrame:
    """(u, v): every fingerprint is linked with the least of those that differ from it in one given bit only; work in proportion to the rows."""
    masked = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("bit"), F.col("fp").bitwiseAND(F.lit(~(1 << k) if k < 63 else (1 << 63) - 1)).alias("rest")) for k in range(64)])).alias("m"))
    pairs = masked.groupBy("m.bit", "m.rest").agg(F.min("fp").alias("u"), F.max("fp").alias("v"))  # at most two: the bit set or not
    return pairs.where("u <> v").select("u", "v")


def linking_pairs(fps: DataFrame, name: str, crowd: int = CROWD, fine: bool | None = None) -> DataFrame:
    """Pairs (u, v) within ``RADIUS`` bits that join whatever chains of such pairs join; not all pairs of a dense group.

    The fingerprints of crowded cells are first linked where they differ in one bit, which takes linear work. In such a cell those of the
    largest group so found aren't compared with one another, only the others with all; so a dense group costs its size, not the
    square of it. From ``FINE_FROM`` fingerprints on, cells are cut by a second grid, so that fewer unrelated ones meet.
    """
    fine = fps.count() >= FINE_FROM if fine is None else fine
    fps = fps.select("fp")
    sizes = _cells(fps, False, fine).groupBy(*CELL).agg(F.count(F.lit(1)).alias("c"))
    crowded = materialize(sizes.where(F.col("c") > crowd).select(*CELL), f"{name}-crowded")
    if crowded.isEmpty():
        return near_pairs(fps, fine=fine).select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v"))
    inside = _cells(fps, False, fine).join(crowded, CELL, "left_semi")
    links = materialize(one_bit_links(inside.select("fp").distinct()), f"{name}-one-bit")
    group = connected_components(links, f"{name}-one-bit-groups").withColumnRenamed("node", "fp")
    known = materialize(fps.join(group, "fp", "left").select("fp", F.coalesce("component", "fp").alias("own")), f"{name}-own")
    b = _cells(known, False, fine)
    largest = b.join(crowded, CELL, "left_semi").groupBy(*CELL, "own").agg(F.count(F.lit(1)).alias("c")).groupBy(*CELL).agg(F.max_by("own", "c").alias("largest"))
    largest = materialize(largest, f"{name}-largest")
    a, b = [x.join(largest, CELL, "left").withColumn("most", F.coalesce(F.col("own") == F.col("largest"), F.lit(False))) for x in (_cells(known, True, fine), b)]
    found = _meet(a.where(~F.col("most")), b, RADIUS, fine).unionByName(_meet(a.where("most"), b.where(~F.col("most")), RADIUS, fine))
    return found.select(F.col("fp_a").alias("u"), F.col("fp_b").alias("v")).unionByName(links)


def _groups(fps: DataFrame, name: str) -> DataFrame:
    """(fp, group) of distinct fingerprints: those that links of ``RADIUS`` bits or fewer join share a group."""
    found = connected_components(linking_pairs(fps, name), name)
    return fps.join(found, fps["fp"] == found["node"], "left").select(fps["fp"], F.coalesce("component", fps["fp"]).alias("group"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, fp, component_id) for every row; the component is the least id that links of 3 bits or fewer reach.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id keep it and link others, but never
    name a component; where they are alone it is null. Repeated rows give equal results; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = materialize(docs.select(id_col, fingerprint(F.col(text_col)).alias("fp")), "op8-rows")
    fps = materialize(rows.groupBy("fp").agg(F.min(id_col).cast("long").alias("least")), "op8-fps")
    labels = materialize(_groups(fps.select("fp"), "op8-components").join(fps, "fp"), "op8-labels")
    named = labels.join(labels.groupBy("group").agg(F.min("least").alias("component_id")), "group").select("fp", "component_id")
    return rows.join(named, "fp", "left").select(id_col, "fp", "component_id")


def one_of_each_group(docs: DataFrame, columns: list[str]) -> DataFrame:
    """One row of each group of near copies (of doc_id, text and others): that with the least id, nulls last, then the least hash of its text.

    Groups are of fingerprints, so rows without an id and different texts that share one are judged like all others.
    """
    small_batches(docs.sparkSession)
    order = {"_none": F.col("doc_id").isNull(), "_tie": F.xxhash64("text"), "_rest": F.xxhash64(*columns)}
    rows = materialize(docs.select("doc_id", *[v.alias(k) for k, v in order.items()], fingerprint(F.col("text")).alias("fp")), "near-rows")
    groups = _groups(materialize(rows.select("fp").distinct(), "near-fps"), "near-components")
    first = rows.groupBy("fp").agg(F.min(F.struct("_none", "doc_id", "_tie", "_rest")).alias("m"))
    first = first.join(groups, "fp").groupBy(F.col("group").alias("_group")).agg(F.min("m").alias("m"))
    first = first.select("_group", F.col("m.doc_id").alias("_id"), F.col("m._tie").alias("_t"), F.col("m._rest").alias("_r"))
    chosen = docs.select(*columns).withColumns({k: order[k] for k in ("_tie", "_rest")})
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_t")) & (F.col("_rest") == F.col("_r"))
    return chosen.join(first, on).dropDuplicates(["_group"]).select(*columns)  # rows that are still several are equal


def op8_query(docs: DataFrame) -> DataFrame:
    found = simhash_groups(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
