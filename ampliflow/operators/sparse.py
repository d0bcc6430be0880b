"""Sparse algebra on coordinate DataFrames ``(i long, j long, x double)``; absent entries are zero."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliflow.operators.staging import dense_index, join_group, stage


#: Products of one inner index in one task; an index with more is cut into blocks. For entries that don't go by row blocks.
BLOCK_PRODUCTS = 4_000_000
#: Products of a block of rows, entries of ``b`` that a task holds, entries of a row that goes by itself, and products that are made at a time.
ROW_BLOCK, SLICE, LONG_ROW, CHUNK = 60_000_000, 4_000_000, 1_000_000, 2_000_000


def dot(a: DataFrame, b: DataFrame, block: int = BLOCK_PRODUCTS) -> DataFrame:
    """The product ``a @ b``.

    Rows of ``a`` are dealt to blocks, and each block gets the rows of ``b`` that it needs: products are made and summed where they arise, so what is
    shuffled are entries of ``a`` and ``b``, not products. Beyond ``SLICE`` entries ``b`` is also cut by columns. Rows of ``a`` with very many
    entries, matrices most of whose products have an inner index with over ``block`` of them, and matrices with nulls or other types than
    ``(long, long, double)`` go by joins on the inner index.
    """
    right = stage(b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("x").alias("_x")).where("_k IS NOT NULL"), "right")
    left = stage(a.select("i", F.col("j").alias("_k"), "x").where("_k IS NOT NULL"), "left")
    kinds = [t for side in (left, right) for _, t in side.dtypes]
    none = lambda df: F.count_if(F.greatest(*[F.col(c).isNull() for c in df.columns])).alias("none")
    n_left, n_right = [df.agg(F.count(F.lit(1)).alias("n"), none(df)).first() for df in (left, right)]
    if kinds != ["bigint", "bigint", "double"] * 2 or n_left["none"] or n_right["none"]:
        return _by_inner(left, right, block)
    sizes = left.groupBy("_k").agg(F.count(F.lit(1)).alias("_a")).join(right.groupBy("_k").agg(F.count(F.lit(1)).alias("_b")), "_k")
    own = F.col("_a").cast("double") * F.col("_b")
    products, heavy = [int(n or 0) for n in sizes.agg(F.sum(own), F.sum(F.when(own > block, own))).first()]
    if 2 * heavy > products:
        # Dense columns by dense rows: their products hardly meet, so there is little to sum before a shuffle.
        return _by_inner(left, right, block)
    long = stage(left.groupBy("i").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > LONG_ROW).select("i"), "long-rows")
    if long.isEmpty():
        return _by_rows(left, right, products, n_right["n"])
    # A row in ``LONG_ROW`` entries at most: these keys are few.
    mine = left.join(F.broadcast(long), "i", "left_anti")
    return _by_rows(mine, right, products, n_right["n"]).unionByName(_by_inner(left.join(F.broadcast(long), "i", "left_semi"), right, block))


def _by_rows(left: DataFrame, right: DataFrame, products: int, n_right: int) -> DataFrame:
    tasks = left.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, products // ROW_BLOCK, min(tasks, products // CHUNK))
    slices = n_right // SLICE + 1
    each = left.select(F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias("_u"), F.lit(1).alias("_side"), "i", "_k", "x")
    needed = each.select("_u", "_k").distinct().join(right, "_k")
    needed = needed.select("_u", F.pmod(F.xxhash64("_j"), F.lit(slices)).cast("int").alias("_v"), F.lit(0).alias("_side"), F.col("_j").alias("i"), "_k", F.col("_x").alias("x"))
    each = each.withColumn("_v", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(*needed.columns)
    # The entries of ``b`` come first, then those of ``a`` row by row.
    met = needed.unionByName(each).repartition(blocks * slices, "_u", "_v").sortWithinPartitions("_u", "_v", "_side", "i")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, parts, table = None, [], None
        for frame in frames:
            keys = frame[["_u", "_v", "_side"]].to_numpy()
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1), True])
            for start, end in zip(edges[:-1], edges[1:]):
                u, v, side = keys[start]
                if (u, v) != now:
                    if table is not None:
                        yield from table.rest()
                    now, parts, table = (u, v), [], None
                i, k, x = (frame[c].to_numpy()[start:end] for c in ("i", "_k", "x"))
                if side == 0:
                    parts.append((k, i, x))
                    continue
                if table is None:
                    table = _Rows(parts)
                    parts = []
                yield from table.times(i, k, x)
        if table is not None:
            yield from table.rest()

    return met.mapInPandas(run, "i long, j long, x double")


class _Rows:
    """Rows of ``b``, by which entries of ``a`` are multiplied that come row by row."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        k, j, x = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(k, kind="stable")
        self.k, self.begin = np.unique(k[order], return_index=True)
        self.size = np.diff(np.append(self.begin, len(k)))
        self.columns, code = np.unique(j[order], return_inverse=True)
        self.code, self.x = code.astype(np.int32), x[order]
        self.open = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # what the last row has so far

    def times(self, i: np.ndarray, k: np.ndarray, x: np.ndarray) -> Iterator[pd.DataFrame]:
        if not len(self.k):
            return
        at = np.minimum(np.searchsorted(self.k, k), len(self.k) - 1)
        own = np.flatnonzero(self.k[at] == k)
        i, x, at = i[own], x[own], at[own]
        total = np.cumsum(self.size[at])
        a = 0
        while a < len(i):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CHUNK, side="right")))
            yield from self._sum(i[a:b], x[a:b], at[a:b])
            a = b

    def _sum(self, i: np.ndarray, x: np.ndarray, at: np.ndarray) -> Iterator[pd.DataFrame]:
        n = self.size[at]
        place = np.arange(n.sum()) + np.repeat(self.begin[at] - (np.cumsum(n) - n), n)
        before, code_before, sum_before = self.open
        rows, row = np.unique(np.r_[before, i], return_inverse=True)
        row = np.r_[row[: len(before)], np.repeat(row[len(before) :], n)]
        key = row * np.int64(len(self.columns)) + np.r_[code_before, self.code[place]]
        value = np.r_[sum_before, np.repeat(x, n) * self.x[place]]
        if len(rows) * len(self.columns) <= 4 * len(key):
            cells, number = np.bincount(key, value), np.bincount(key)
            key = np.flatnonzero(number)
            value = cells[key]
        else:
            key, which = np.unique(key, return_inverse=True)
            value = np.bincount(which, value)
        row, code = np.divmod(key, len(self.columns))
        last = row == len(rows) - 1
        self.open = rows[row[last]], code[last], value[last]
        if not last.all():
            done = ~last
            yield pd.DataFrame({"i": rows[row[done]], "j": self.columns[code[done]], "x": value[done]})

    def rest(self) -> Iterator[pd.DataFrame]:
        i, code, x = self.open
        if len(i):
            yield pd.DataFrame({"i": i, "j": self.columns[code], "x": x})


def _by_inner(left: DataFrame, right: DataFrame, block: int) -> DataFrame:
    """The product by joins on the inner index.

    An inner index with many entries on both sides would put all its products into one task. Its entries of ``a`` are dealt to p parts and those
    of ``b`` to q, by row and by column, and each of the p x q blocks is a join key of its own, of about ``block`` products.
    """
    sizes = left.groupBy("_k").agg(F.count(F.lit(1)).alias("_a")).join(right.groupBy("_k").agg(F.count(F.lit(1)).alias("_b")), "_k")
    heavy = stage(sizes.where(F.col("_a").cast("double") * F.col("_b") > block), "heavy-inner")
    if heavy.isEmpty():
        return _products(left, right, ["_k"])
    # Parts in proportion to the sides: a thin side isn't cut at all.
    blocks = F.ceil(F.col("_a").cast("double") * F.col("_b") / block)
    p = F.least(F.greatest(F.lit(1.0), F.sqrt(blocks * F.col("_a") / F.col("_b"))), blocks)
    shape = heavy.select("_k", F.ceil(p).cast("int").alias("_p"), F.ceil(blocks / p).cast("int").alias("_q"))

    def dealt(side: DataFrame, key: str, own: str, n_own: str, other: str, n_other: str) -> DataFrame:
        rows = side.join(shape, "_k", "left").withColumn(own, F.coalesce(F.pmod(F.xxhash64(key), n_own), F.lit(0)).cast("int"))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(n_other, F.lit(1)) - 1))).drop("_p", "_q")

    return _products(dealt(left, "i", "_u", "_p", "_v", "_q"), dealt(right, "_j", "_v", "_q", "_u", "_p"), ["_k", "_u", "_v"])


def _products(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on).groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("x") * F.col("_x")).alias("x"))


def matrix_vector(m: DataFrame, v: DataFrame) -> DataFrame:
    """``m @ v`` as (i, x); ``v`` is (i, x)."""
    right = v.select(F.col("i").alias("j"), F.col("x").alias("_v"))
    return m.join(right, "j").groupBy("i").agg(F.sum(F.col("x") * F.col("_v")).alias("x"))


def vector_matrix(v: DataFrame, m: DataFrame) -> DataFrame:
    """``v @ m`` as (j, x)."""
    left = v.select("i", F.col("x").alias("_v"))
    return m.join(left, "i").groupBy("j").agg(F.sum(F.col("x") * F.col("_v")).alias("x"))


def axis_sum(m: DataFrame, axis: str) -> DataFrame:
    """Sums over ``axis``: "rows" gives a value for each column, "columns" one for each row."""
    key = {"rows": "j", "columns": "i"}[axis]
    return m.groupBy(key).agg(F.sum("x").alias("x"))


def nnz(m: DataFrame) -> DataFrame:
    return m.where("x <> 0").agg(F.count(F.lit(1)).alias("nnz"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entry by entry; sums of zero are left out."""
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("x").alias("x")).where("x <> 0")


def vstack(*parts: tuple[DataFrame, int]) -> DataFrame:
    """Matrices with their row counts, one below the other."""
    out, base = None, 0
    for m, rows in parts:
        part = m.select((F.col("i") + base).alias("i"), "j", "x")
        out = part if out is None else out.unionByName(part)
        base += rows
    if out is None:
        raise ValueError("nothing to stack")
    return out


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "x")


def select_columns(m: DataFrame, mapping: DataFrame) -> DataFrame:
    """``mapping`` is (new_j, old_j); a column may be taken more than once."""
    return m.join(mapping, m["j"] == mapping["old_j"]).select("i", F.col("new_j").alias("j"), "x")


def normalized(v: DataFrame, column: str = "x", by: list[str] | None = None) -> DataFrame:
    """``column`` divided by its sum (within ``by``); NaN where the sum is zero."""
    by = by or []
    total = v.groupBy(*by).agg(F.sum(column).alias("_total"))
    joined = v.join(F.broadcast(total), by) if by else v.crossJoin(F.broadcast(total))
    return joined.withColumn(column, F.coalesce(F.try_divide(column, "_total"), F.lit(float("nan")))).drop("_total")


def column_groups(m: DataFrame, columns: DataFrame, by: str | None = None) -> DataFrame:
    """``columns`` (j, and ``by``) with g and rep_j: columns with equal entries share a group.

    Groups are numbered by (number of entries, least j); columns without entries are one group. Columns meet by a 128-bit
    digest of their entries, and each is compared with its group's first column entry by entry; no column is held as a whole.
    Should digests of different columns ever be equal, the query fails. ``columns`` has each column once.
    """
    own = [by] if by else []
    m = m.where("x <> 0").select(*own, "i", "j", (F.col("x") + 0.0).alias("x"))
    digests = [F.bit_xor(F.xxhash64(F.lit(k), "i", "x")).alias(f"_d{k}") for k in (0, 1)]
    found = m.groupBy(*own, "j").agg(F.count(F.lit(1)).alias("_n"), *digests)
    every = stage(columns.select(*own, "j").join(found, [*own, "j"], "left"), "columns")
    # Columns without entries need no join: there may be very many, and their group is the first.
    empty = every.where("_n IS NULL").select(*own, "j")
    first_empty = F.broadcast(empty.groupBy(*own).agg(F.min("j").alias("rep_j")))  # a row for each value of ``by``
    key = [*own, "_n", "_d0", "_d1"]
    filled = every.where("_n IS NOT NULL")
    sizes = stage(filled.groupBy(*key).agg(F.min("j").alias("rep_j"), F.count(F.lit(1)).alias("_size")), "column-groups")
    reps = dense_index(sizes, ["_n", "rep_j"], "g", by=by)
    if by:
        shifted = reps.join(first_empty.select(by, F.lit(1).alias("_shift")), by, "left")
    else:
        shifted = reps.crossJoin(F.broadcast(empty.agg(F.least(F.count(F.lit(1)), F.lit(1)).alias("_shift"))))
    reps = stage(shifted.withColumn("g", F.col("g") + F.coalesce("_shift", F.lit(0))).drop("_shift"), "column-reps")
    groups = stage(join_group(filled, reps, key, "_size").select(*own, "j", "rep_j", "_n", "g"), "column-members")

    followers = groups.where("j <> rep_j").select(*own, "j", "rep_j")
    mine = m.join(followers, [*own, "j"]).select(*own, F.col("rep_j").alias("_r"), "i", "j", "x")
    copied = reps.where("_size > 1").select(*own, F.col("rep_j").alias("j"))
    first = m.join(copied, [*own, "j"]).select(*own, F.col("j").alias("_r"), "i", F.col("x").alias("_x"))
    copies = stage(first.join(reps.select(*own, F.col("rep_j").alias("_r"), "_size"), [*own, "_r"]), "column-copies")
    equal = join_group(mine, copies, [*own, "_r", "i"], "_size").where("x = _x").groupBy(*own, "j").agg(F.count(F.lit(1)).alias("_same"))
    checked = groups.join(equal, [*own, "j"], "left")
    unlike = (F.col("j") != F.col("rep_j")) & (F.coalesce("_same", F.lit(0)) != F.col("_n"))
    g = F.when(unlike, F.raise_error(F.lit("different columns have the same digest")).cast("long")).otherwise(F.col("g"))
    none = empty.join(first_empty, own) if by else empty.crossJoin(first_empty)
    return checked.select(*own, "j", g.alias("g"), "rep_j").unionByName(none.select(*own, "j", F.lit(0).cast("long").alias("g"), "rep_j"))


def duplicate_columns(groups: DataFrame) -> DataFrame:
    return groups.withColumn("duplicate", F.col("j") != F.col("rep_j"))
