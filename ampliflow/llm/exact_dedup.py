"""Exact duplicates by polynomial fingerprints that compose.

A text, its A-Z lower-cased, is a string of bytes; read as the digits of a number to the base 256 it is hashed modulo a prime of
126 bits. Two neighbours compose by arithmetic shifted by the length of the second, ``h(ab) = h(a) * 256^len(b) + h(b)``, so the
chunks of a huge text are hashed side by side, on any machine, and put together afterwards. Texts with equal hash and
length then meet chunk by chunk: the least and the greatest content of a chunk must be equal. Copies shrink to one row in the
task that reads them, so a large group costs no more than a small one. Should fingerprints of different texts be equal, their
groups are formed anew from the texts themselves.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampliflow.llm.common import id_or_marker, id_or_null, materialize, small_batches
from ampliflow.operators.staging import join_group

#: A prime drawn at random, without a short form in powers of two, which would let close edits cancel out.
MODULUS = 56214856418151067837448704512816775237
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_LOWER = bytes.maketrans(_UPPER.encode(), _LOWER.encode())

#: Bytes of a chunk, and the bytes from which on a text's chunks are dealt to many tasks.
CHUNK = 1 << 20
HUGE = 16 << 20
KEY = ["hi", "lo", "n"]
_FINGERPRINT = "hi long, lo long, n long"


def chunk_hash(chunk: bytes, modulus: int = MODULUS) -> tuple[int, int]:
    """(hash, length) of a chunk."""
    return int.from_bytes(chunk, "big") % modulus, len(chunk)


def combined(a: tuple[int, int], b: tuple[int, int], modulus: int = MODULUS) -> tuple[int, int]:
    """(hash, length) of two neighbours together."""
    return (a[0] * pow(256, b[1], modulus) + b[0]) % modulus, a[1] + b[1]


def _split(h: int) -> tuple[int, int]:
    return h >> 63, h & ((1 << 63) - 1)


def fingerprint_of(data: bytes, chunk: int = CHUNK, modulus: int = MODULUS) -> tuple[int, int]:
    """(hash, length) of lower-cased bytes, a chunk at a time."""
    whole = (0, 0)
    for at in range(0, len(data), chunk):
        whole = combined(whole, chunk_hash(data[at : at + chunk], modulus), modulus)
    return whole


def _fingerprints(chunk: int, modulus: int, digest: bool):
    """A function of a binary column: hi, lo, n, and the SHA-256 if asked for."""

    @F.pandas_udf(_FINGERPRINT + ", sha string" * digest)
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            data = bytes(text).translate(_TO_LOWER)
            h, n = fingerprint_of(data, chunk, modulus)
            out.append((*_split(h), n, *([hashlib.sha256(data).hexdigest()] if digest else [])))
        return pd.DataFrame(out, columns=KEY + ["sha"] * digest)

    return of


def _composed(modulus: int):
    """A function of an array of (k, hi, lo, n) in ascending k: the fingerprint of the chunks together."""

    @F.pandas_udf(_FINGERPRINT)
    def of(parts: pd.Series) -> pd.DataFrame:
        out = []
        for row in parts:
            whole = (0, 0)
            for p in row:
                whole = combined(whole, ((p["hi"] << 63) | p["lo"], p["n"]), modulus)
            out.append((*_split(whole[0]), whole[1]))
        return pd.DataFrame(out, columns=KEY)

    return of


def normalised(text: Column) -> Column:
    """The bytes that are compared: A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER).cast("binary")


def _chunks(data: Column, chunk: int) -> Column:
    last = F.floor((F.octet_length(data) - 1) / chunk).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.substring(data, k * chunk + 1, F.lit(chunk)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, huge: int = HUGE, modulus: int = MODULUS) -> DataFrame:
    """(``id_col``, keep_id, group_size, kept, text_sha256) of every row: the row with the greatest id of its equal texts stays.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Null ids rank below all others, and of rows that repeat id
    and text one stays. Other columns are not read; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    given = docs.select(id_or_marker(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
    is_huge = F.octet_length("data") > huge
    # The chunks of huge texts are dealt out by (row, k); rows are numbered in the table that is written.
    whole = docs.select(id_or_marker(id_col).alias("id"), normalised(F.col(text_col)).alias("data")).where(is_huge)
    cut = whole.select("id", F.monotonically_increasing_id().alias("text_no"), F.sha2("data", 256).alias("sha"), _chunks(F.col("data"), chunk).alias("c"))
    pieces = materialize(cut.select("id", "text_no", "sha", F.posexplode("c").alias("k", "piece")).repartition("text_no", "k"), "op12-pieces")
    hashed = pieces.select("id", "text_no", "sha", "k", _fingerprints(chunk, modulus, False)("piece").alias("f"))
    parts = hashed.groupBy("id", "text_no", "sha").agg(F.array_sort(F.collect_list(F.struct("k", "f.hi", "f.lo", "f.n"))).alias("parts"))  # 2 GB of a text are 2048 chunks
    of_huge = materialize(parts.select("id", "text_no", "sha", _composed(modulus)("parts").alias("f")).select("id", "text_no", "f.hi", "f.lo", "f.n", "sha"), "op12-huge")
    of_others = given.where(~is_huge).select("id", _fingerprints(chunk, modulus, True)("data").alias("f")).select("id", "f.*")
    rows = materialize(of_others.unionByName(of_huge.drop("text_no")).withColumn("row", F.monotonically_increasing_id()), "op12-rows")

    def keepers(df: DataFrame, key: list[str]) -> DataFrame:
        return df.groupBy(*key).agg(F.max("id").alias("keep"), F.max_by("row", "id").alias("keep_row"), F.count(F.lit(1)).alias("size"))

    groups = materialize(keepers(rows, KEY), "op12-groups")
    repeated = groups.where("size > 1 AND n > 0").select(*KEY, "size")
    again = given.where(~is_huge).select("data", _fingerprints(chunk, modulus, False)("data").alias("f")).select("data", "f.*")
    texts = join_group(again, repeated, KEY).select(*KEY, normalised(F.col("data").cast("string")).alias("data"))
    compared = texts.select(*KEY, F.posexplode(_chunks(F.col("data"), chunk)).alias("k", "piece"))
    long = join_group(of_huge, repeated, KEY).select("text_no", *KEY)
    compared = compared.unionByName(pieces.select("text_no", "k", "piece").join(long, "text_no").select(*KEY, "k", "piece"))
    unlike = compared.groupBy(*KEY, "k").agg(F.min("piece").alias("least"), F.max("piece").alias("most")).where("least <> most")
    unlike = materialize(unlike.select(*KEY).distinct(), "op12-unlike")

    def verdicts(df: DataFrame) -> DataFrame:
        return df.select(id_or_null("id").alias(id_col), id_or_null("keep").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))

    if unlike.isEmpty():
        return verdicts(join_group(rows, groups, KEY))
    # Different texts share these fingerprints: their texts themselves are the key.
    mixed = given.withColumn("f", _fingerprints(chunk, modulus, True)("data")).select("id", "f.*", normalised(F.col("data").cast("string")).alias("text"))
    mixed = join_group(mixed, groups.join(unlike, KEY, "left_semi").select(*KEY, "size"), KEY).drop("size")
    mixed = materialize(mixed.withColumn("row", F.monotonically_increasing_id()), "op12-mixed")
    apart = join_group(mixed, materialize(keepers(mixed, [*KEY, "text"]), "op12-apart"), [*KEY, "text"])
    alike = groups.join(unlike, KEY, "left_anti")
    return verdicts(join_group(rows, alike, KEY)).unionByName(verdicts(apart))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text an arbitrary one."""
    kept = exact_groups(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    on = F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.sha2(normalised(F.col(text_col)), 256) == F.col("_kept_sha"))
    return docs.join(kept, on).dropDuplicates(["_kept_id", "_kept_sha"]).select(*docs.columns)


def op12_query(docs: DataFrame) -> DataFrame:
    return exact_groups(docs)


ORACLE = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS s FROM documents),
g AS (SELECT s, max(doc_id) AS keep_id, count(*) AS group_size, sha256(s) AS text_sha256 FROM t GROUP BY s)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (s)"""
