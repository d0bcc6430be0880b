"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampliflow.operators.staging import new_path

#: White space of every word definition in this package: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

#: Stands for a null id where rows pass through pandas, which would make integers with nulls floats.
NO_ID = -(1 << 63)


def id_or_marker(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def id_or_null(col: str) -> Column:
    return F.nullif(col, F.lit(NO_ID))


def small_batches(spark: SparkSession) -> None:
    """Python workers get at most 1000 texts at a time, and 8 MB, unless the session sets bounds of its own."""
    for key, bound in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", "8m")):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, bound)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it again: lineage ends there and survives lost executors. ``staging.release`` removes it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def given(spark: SparkSession, columns: dict[str, list[int]]) -> DataFrame:
    """A few integers of the driver as a table. They go as Arrow: lists of rows would start a second set of Python workers on each executor."""
    return spark.createDataFrame(pa.table({name: pa.array(values, pa.int64()) for name, values in columns.items()}))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once a row however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashed(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the least hashes of ``key``; ties go by the key. A bounded sample that repeats.

    Rows whose hash is far above what is needed leave before the sort, so tasks send few rows however many there are.
    """
    n = rows.count()
    share = min(1.0, (4 * most + 1000) / max(n, 1))
    top = min((1 << 63) - 1, int(-(1 << 63) + share * (1 << 64)))
    return rows.where(F.xxhash64(key) <= F.lit(top)).orderBy(F.xxhash64(key), key).limit(most)
