"""Intermediate tables in the folder that driver and executors share, and dense numbering without a single task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ampliflow.functions.dna import typed_errors


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; in local mode it may be unset, and one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        base = tempfile.mkdtemp(prefix="ampliflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write and read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with typed_errors():
        df.write.option("compression", "zstd").parquet(path)  # sequences take a third of what the default makes of them
    return spark.read.schema(df.schema).parquet(path)


#: Folders and tables that this application has written, by its id.
_STAGED: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which ``release`` removes."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Removes all intermediate tables of this application, and says how many: when every result that reads them has been written or collected."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        if path.startswith("table:"):
            spark.sql(f"DROP TABLE IF EXISTS {path.removeprefix('table:')}")
            continue
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def bucketed(df: DataFrame, keys: list[str], buckets: int, name: str) -> DataFrame:
    """Written and read again as an external table bucketed by ``keys``: joins and sums by these keys don't shuffle it."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    with typed_errors():
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", new_path(spark, table)).saveAsTable(table)
    _STAGED[spark.sparkContext.applicationId].append(f"table:{table}")
    return spark.table(table)


def dense_index(df: DataFrame, order: list[str], name: str, by: str | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``df`` with 0-based ranks of its rows in ascending ``order``, restarting for each value of ``by``.

    Ranges are sorted side by side; only their sizes meet. Rows with equal ``order`` get ranks in any order. Groups of
    ``by`` are few (regions), rows are not. Rows are shuffled once: their places in the sorted ranges go with them into the files.
    ``finish`` is given the sorted rows before they are numbered and may add columns and, with ``held``, drop rows: what it does is done
    once, while all that ``df`` does is also done for the sample that ranges are made from.
    """
    keys = [*([by] if by else []), *order]
    ranges = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranges = finish(ranges) if finish else ranges
    columns = ranges.columns
    parts = stage(ranges.withColumn("_at", F.monotonically_increasing_id()), f"index-{name}")
    # The upper bits of the place are the number of the range.
    placed = parts.withColumns({"_part": F.shiftright("_at", 33), "_rank": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    return _from_first(placed, name, by).select(*columns, name)


def held(rows: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet the condition, which isn't pushed below the shuffle that they come from: it counts as not deterministic, and as a column it isn't taken apart."""
    return rows.withColumn("_held", F.when(F.monotonically_increasing_id() >= 0, condition)).where("_held").drop("_held")


def dense_ranks(df: DataFrame, key: str, name: str, by: str) -> DataFrame:
    """``df`` with the 0-based rank of ``key`` among the distinct ones of the same ``by``, and whether a row is the ``first`` with its key; neither is null.

    As ``dense_index``, with one shuffle: rows with equal keys are neighbours in a sorted range, so nothing is joined back to the distinct keys.
    """
    keys = [by, key]
    schema = StructType([*df.schema.fields, StructField("_rank", LongType()), StructField("first", BooleanType())])

    def ranked(batches):
        last, rank = None, -1
        for batch in batches:
            n = batch.num_rows
            if n:
                own = [batch.column(batch.schema.get_field_index(c)) for c in keys]
                first = np.ones(n, bool)
                first[0] = [c[0].as_py() for c in own] != last
                first[1:] = np.any([pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in own], axis=0)
                last = [c[n - 1].as_py() for c in own]
                ranks = rank + np.cumsum(first)
                rank = int(ranks[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64()), pa.array(first)], names=schema.names)

    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(ranked, schema).withColumn("_part", F.spark_partition_id())
    return _from_first(stage(rows, f"ranks-{name}"), name, by).select(*df.columns, name, "first")


def _from_first(parts: DataFrame, name: str, by: str | None) -> DataFrame:
    """``parts`` with ``name``: ``_rank``, which counts within ``_part``, counted from the first part of the group on."""
    group: list[Column | str] = [by] if by else []
    sizes = parts.groupBy(*group, "_part").agg(F.min("_rank").alias("_first"), (F.max("_rank") - F.min("_rank") + 1).alias("_n"))  # a row for each range and group
    before = Window.partitionBy(*group, *([] if by else [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = stage(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n"), f"sizes-{name}")
    return parts.join(F.broadcast(sizes), [*([by] if by else []), "_part"]).withColumn(name, F.col("_before") + F.col("_rank") - F.col("_first"))


#: Parts that the rows of a frequent group are dealt to.
SALTS = 64


def join_group(rows: DataFrame, groups: DataFrame, keys: list[str], size: str = "size") -> DataFrame:
    """``rows`` with the columns of their group; ``groups`` has a row for each key (none is null) and its number of rows, ``size``.

    Groups with over a thousandth of all rows are fewer than a thousand: their keys are broadcast, their rows dealt out, and they stand in
    ``groups`` once for each part. Rows without a group go. The join shuffles at every size, so its cost grows in proportion.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    is_hot = F.col(size) > total / 1000
    hot = F.broadcast(groups.where(is_hot).select(*keys, F.lit(True).alias("_hot")))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.floor(F.rand(0) * SALTS).cast("int")).otherwise(0)).drop("_hot")
    each = groups.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(each.hint("merge"), [*keys, "_salt"]).drop("_salt")
