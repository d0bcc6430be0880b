"""Writers for databases and reports."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampliflow.operators.database import Database
from ampliflow.sources.messagepack import packed, write_lists


#: A task that writes by ``partitionBy`` keeps up to so many files open, so rows aren't sorted by it and stay in their order.
IN_ORDER = {"spark.sql.maxConcurrentOutputFileWriters": "8", "spark.sql.optimizer.plannedWrite.enabled": "false"}
#: Shuffle files go when what was made of them is written. For frames that are executed once.
NO_SHUFFLE_KEPT = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Inside, the session has these settings."""
    old = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in old.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def renamed(spark: SparkSession, old: str, new: str) -> str:
    """The folder ``old`` of a finished write as ``new``."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(old)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(at, hadoop.Path(new)):
        raise OSError(f"{old} can't be renamed to {new}")
    return new


def save_database(db: Database, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Parquet: a folder of tables. JSON and MessagePack: one interchange document, for exchange with other tools only. One task holds the JSON document;
    that of MessagePack is streamed."""
    if format == "parquet":
        for t in Database.TABLES:
            getattr(db, t).write.mode(mode).parquet(f"{path}/{t}")
        db.primers.sparkSession.createDataFrame([(db.k,)], "k int").write.mode(mode).parquet(f"{path}/meta")
    elif format == "json":
        database_json(db).coalesce(1).write.mode(mode).text(path)
    elif format == "messagepack":
        _write_messagepack(db, path, mode)
    else:
        raise ValueError(f"invalid format: {format!r}")


def _write_messagepack(db: Database, path: str, mode: str) -> None:
    """The lists of every region and those of the references, in the order of the document; structures are arrays of their fields."""
    primers = db.primers.select("region", "fwd", "bwd").orderBy("region").collect()  # regions are few
    number = F.create_map(*[x for n, p in enumerate(primers) for x in (F.lit(p["region"]), F.lit(7 * n))]) if primers else F.create_map(F.lit(0), F.lit(0))
    base = F.element_at(number, F.col("region").cast("int"))
    no = {"also": F.lit(0).cast("long"), "a": F.lit(None).cast("long"), "b": F.lit(None).cast("long"), "s": F.lit(None).cast("string"), "x": F.lit(None).cast("double")}

    def listed(df: DataFrame, which, at: str, kind: str, **values) -> DataFrame:
        given = no | values
        return df.select(which.cast("int").alias("list"), F.col(at).cast("long").alias("at"), given["also"].alias("also"), F.lit(kind).alias("kind"), *[given[c].alias(c) for c in ("a", "b", "s", "x")])

    sized = db.pairs.select("region", "h").join(db.m.groupBy("region", "h").agg(F.count(F.lit(1)).alias("n")), ["region", "h"], "left")
    # Entries before each row, and all of them at the end: a running sum over the rows of a region.
    ends = sized.withColumn("end", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("region").orderBy("h")))
    first = db.primers.select("region", F.lit(-1).cast("long").alias("h"), F.lit(0).cast("long").alias("end"))
    integer = lambda c: F.col(c).cast("long")
    sides = [listed(db.kmers.where(F.col("side") == side), base + 1 + n, "kmer_id", "string", s=F.col("kmer")) for n, side in enumerate(("fwd", "bwd"))]
    parts = [
        listed(db.pairs, base, "h", "pair", a=integer("fwd_id"), b=integer("bwd_id")), *sides,
        listed(db.m, base + 3, "h", "float", also=integer("j"), x=F.col("x")), listed(db.m, base + 4, "h", "int", also=integer("j"), a=integer("j")),
        listed(first.unionByName(ends.select("region", "h", "end")), base + 5, "h", "int", a=integer("end")), listed(db.perfect, base + 6, "j", "int", a=F.col("perfect").cast("long")),
        listed(db.refs, F.lit(7 * len(primers)), "j", "string", s=F.col("name")), listed(db.refs, F.lit(7 * len(primers) + 1), "j", "int", a=integer("amplified")),
    ]
    elements = parts[0]
    for part in parts[1:]:
        elements = elements.unionByName(part)
    array = lambda n: packed([None] * n)[:-n] if n else packed([])
    heads = []
    for p in primers:
        # primer, pairs; two lists of k-mers; the matrix with its columns and three lists; perfect matches.
        heads += [array(5) + packed([p["fwd"], p["bwd"]]), array(2), b"", array(4) + packed(db.refs.count()), b"", b"", b""]
    heads = [*heads, b"", b""]
    heads[0] = array(4) + packed(db.k) + array(len(primers)) + heads[0]
    write_lists(elements, heads, path, mode)


def database_json(db: Database) -> DataFrame:
    """A row with the database as a JSON document."""

    def listed(df: DataFrame, order: str, value, name: str) -> DataFrame:
        rows = df.groupBy("region").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))).alias("l"))
        return rows.select("region", F.col("l.v").alias(name))

    def side(s: str) -> DataFrame:
        return listed(db.kmers.where(F.col("side") == s), "kmer_id", F.col("kmer"), s)

    cells = db.m.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("h", "j", "x"))).alias("c"))
    regions = db.primers.join(listed(db.pairs, "h", F.array("fwd_id", "bwd_id"), "unique_pairs"), "region", "left").join(side("fwd").withColumnRenamed("fwd", "fk"), "region", "left").join(side("bwd").withColumnRenamed("bwd", "bk"), "region", "left")
    regions = regions.join(cells, "region", "left").join(listed(db.perfect, "j", F.col("perfect").cast("int"), "perfect_match"), "region", "left")
    cols = db.refs.agg(F.count(F.lit(1)).alias("n_refs"))
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))
    # Entries before each row, and all of them at the end: a running sum over the rows of a region.
    sized = db.pairs.select("region", "h").join(db.m.groupBy("region", "h").agg(F.count(F.lit(1)).alias("n")), ["region", "h"], "left")
    ends = sized.withColumn("end", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("region").orderBy("h")))
    regions = regions.join(listed(ends, "h", F.col("end"), "row_ends"), "region", "left")
    rows = F.concat(F.array(F.lit(0).cast("long")), none("row_ends", "bigint"))
    regions = regions.crossJoin(F.broadcast(cols)).select(
        "region",
        F.struct(
            F.array("fwd", "bwd").alias("primer"), none("unique_pairs", "array<bigint>").alias("unique_pairs"), F.array(none("fk", "string"), none("bk", "string")).alias("unique_kmers"),
            F.struct(F.col("n_refs").alias("cols"), F.coalesce(F.col("c.x"), F.array().cast("array<double>")).alias("data"), F.coalesce(F.col("c.j"), F.array().cast("array<bigint>")).alias("col_index"), rows.alias("row_index")).alias("matrix"),
            none("perfect_match", "int").alias("perfect_match"),
        ).alias("r"),
    )
    regions = regions.agg(F.array_sort(F.collect_list(F.struct("region", "r"))).alias("l")).select(F.col("l.r").alias("regions"))
    refs = db.refs.agg(F.array_sort(F.collect_list(F.struct("j", "name", "amplified"))).alias("l")).select(F.col("l.name").alias("names"), F.col("l.amplified").alias("amplified"))
    return regions.crossJoin(refs).select(F.to_json(F.struct(F.lit(db.k).alias("k"), "regions", "names", "amplified")).alias("value"))


def scientific(x) -> F.Column:
    """As ``1.234000000e-3``: nine digits, the exponent without a plus sign or leading zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.9e", x), r"e\+?(-?)0*(\d)", "e$1$2"), "e-0$", "e0")


def report_lines(report: DataFrame) -> DataFrame:
    """Rows of the report as text columns, in the order of references."""
    return report.orderBy("sample", "j").select("id", "taxonomy", scientific(F.col("proportion")).alias("proportion"), scientific(F.col("frequency")).alias("frequency"), F.col("mapped").cast("string").alias("mapped"))


def write_report(report: DataFrame, path: str, r1: str = "", r2: str = "", reads: int = 0, mapped: int = 0, mode: str = "errorifexists") -> None:
    """Tab-separated, after a comment line with the files and counts. Reports are a row for each reference found."""
    spark = report.sparkSession
    head = spark.createDataFrame([(0, 0, f"#r1={r1} r2={r2} reads={reads} mapped={mapped}"), (1, 0, "id\ttaxonomy\tproportion\tfrequency\tmapped")], "part int, j long, value string")
    cells = [F.coalesce(F.col(c), F.lit("")) for c in ("id", "taxonomy")] + [scientific(F.col("proportion")), scientific(F.col("frequency")), F.col("mapped").cast("string")]
    body = report.select(F.lit(2).alias("part"), "j", F.concat_ws("\t", *cells).alias("value"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("part", "j").select("value").write.mode(mode).text(path)
