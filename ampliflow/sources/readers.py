"""Readers for FASTA, FASTQ, taxonomies and databases. Compressed files are decoded by their extension."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

from ampliflow.operators.database import Database, primer_table
from ampliflow.operators.staging import stage
from ampliflow.sources import sequences
from ampliflow.sources.messagepack import read_values

#: Shape of the interchange file.
DATABASE_JSON = (
    "k bigint, regions array<struct<primer:array<string>, unique_pairs:array<array<bigint>>, unique_kmers:array<array<string>>, "
    "matrix:struct<cols:bigint, data:array<double>, col_index:array<bigint>, row_index:array<bigint>>, perfect_match:array<int>>>, names array<string>, amplified array<int>"
)


_REGISTERED: set[str] = set()


def _source(spark: SparkSession, kind: str, path: str, split_bytes: int) -> DataFrameReader:
    if spark.sparkContext.applicationId not in _REGISTERED:
        sequences.register(spark)
        _REGISTERED.add(spark.sparkContext.applicationId)
    return spark.read.format(kind).option("path", path).option("splitBytes", split_bytes)


def _splits(spark: SparkSession, kind: str, path: str, split_bytes: int) -> DataFrame:
    """(file, split, n, before): the records of each split and those before it; a row for each split."""
    counts = stage(_source(spark, kind, path, split_bytes).option("counts", "true").load(), f"{kind}-counts")
    earlier = Window.partitionBy(F.lit(0)).orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1)  # rows are splits
    return stage(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), f"{kind}-splits")


def _records(spark: SparkSession, kind: str, path: str, number: str, split_bytes: int) -> DataFrame:
    """Records with their 0-based ``number`` in the order of files and lines.

    Two passes: the first one counts the records of each split, the second one makes them; a row for each split is all that is joined.
    Records of compressed files, which are one split each, are dealt out if the files are fewer than the tasks that may run.
    """
    files = sequences.listed(path)
    before = _splits(spark, kind, path, split_bytes).select("file", "split", F.col("before").alias("_before"))
    rows = _source(spark, kind, path, split_bytes).load().join(before, ["file", "split"])
    rows = rows.select((F.col("_before") + F.col("row")).alias(number), *[c for c in rows.columns if c not in ("file", "split", "row", "_before")])
    tasks = spark.sparkContext.defaultParallelism
    return rows.repartition(tasks) if len(files) < tasks and any(sequences.is_compressed(f) for f, _ in files) else rows


def read_fasta(spark: SparkSession, path: str, id_first_token: bool = False, to_dna: bool = False, strip_cr: bool = False, split_bytes: int = sequences.SPLIT_BYTES) -> DataFrame:
    """(seq_no, id, sequence): a record for each header line. The id is the whole header, or its first token.

    Lines of a sequence are joined as they are, so a carriage return stays unless ``strip_cr`` is set. A file whose first line has no ``>``
    takes it as a header all the same.
    """
    raw = _records(spark, "fasta", path, "seq_no", split_bytes)
    sequence = F.translate("sequence", "\r", "") if strip_cr else F.col("sequence")
    sequence = F.translate(sequence, "U", "T") if to_dna else sequence
    return raw.select("seq_no", (F.substring_index("id", " ", 1) if id_first_token else F.col("id")).alias("id"), sequence.alias("sequence"))


def read_fastq(spark: SparkSession, path: str, strip_cr: bool = False, split_bytes: int = sequences.SPLIT_BYTES) -> DataFrame:
    """(read_no, id, sequence, strand, quality) from records of four lines; a truncated record at the end is left out.

    Lines are as they are, so a carriage return stays unless ``strip_cr`` is set.
    """
    raw = _records(spark, "fastq", path, "read_no", split_bytes)
    return raw.select("read_no", *[F.regexp_replace(c, "\r$", "").alias(c) for c in raw.columns[1:]]) if strip_cr else raw


def pair_reads(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(read_no, id, fwd, bwd) by position; reads beyond the shorter file are left out."""
    right = backward.select("read_no", F.col("sequence").alias("bwd"))
    return forward.select("read_no", "id", F.col("sequence").alias("fwd")).join(right, "read_no")


#: Backward records that ``read_pairs`` may read for each that there is.
READ_AGAIN = 4


def read_pairs(spark: SparkSession, forward: str, backward: str, split_bytes: int = sequences.SPLIT_BYTES) -> DataFrame:
    """(read_no, id, fwd, bwd) of two FASTQ paths, as ``pair_reads`` of both.

    A task reads a forward split beside the backward splits that hold its mates, so no read is shuffled. Where the cuts are so unlike that
    backward splits would be read again and again, reads are joined.
    """
    own, other = (_splits(spark, "fastq", path, split_bytes).where("n > 0") for path in (forward, backward))
    overlap = (F.col("o.before") < F.col("f.before") + F.col("f.n")) & (F.col("f.before") < F.col("o.before") + F.col("o.n"))
    met = own.alias("f").join(F.broadcast(other.alias("o")), overlap)
    met = stage(met.groupBy("f.file", "f.split", "f.n", "f.before").agg(F.array_sort(F.collect_list(F.struct("o.before", "o.file", "o.split"))).alias("others"), F.sum("o.n").alias("again")), "fastq-pairs")
    sizes = met.agg(F.count(F.lit(1)).alias("splits"), F.coalesce(F.sum("again"), F.lit(0)).alias("again")).first()
    if sizes["again"] > READ_AGAIN * (other.agg(F.sum("n")).first()[0] or 0):
        return pair_reads(read_fastq(spark, forward, split_bytes=split_bytes), read_fastq(spark, backward, split_bytes=split_bytes))

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = lambda file, at: sequences.Split(file, at, -1 if sequences.is_compressed(file) else at + split_bytes)
        for batch in batches:
            for r in batch.to_pylist():
                yield from sequences.paired_batches(split(r["file"], r["split"]), r["before"], r["n"], [(x["before"], split(x["file"], x["split"])) for x in r["others"]])

    rows = met.repartition(max(sizes["splits"], 1)).mapInArrow(paired, "read_no long, id string, fwd string, bwd string")
    tasks = spark.sparkContext.defaultParallelism
    return rows.repartition(tasks) if sizes["splits"] < tasks and any(sequences.is_compressed(f) for f, _ in sequences.listed(forward)) else rows


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(id, lineage) split at the first tab; of lines with one id the last counts. A line without a tab is an error."""
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(path).select("value", place.alias("n")).where("trim(value) <> ''")
    value = F.rtrim("value")
    row = lines.select("n", F.when(value.contains("\t"), F.split(value, "\t", 2)).otherwise(F.raise_error(F.concat(F.lit("no tab in: "), value))).alias("p"))
    return row.groupBy(F.col("p")[0].alias("id")).agg(F.max_by(F.col("p")[1], "n").alias("lineage"))


def load_database(spark: SparkSession, path: str, format: str = "parquet") -> Database:
    """A database that was written by ``save_database``."""
    if format == "parquet":
        tables = {t: spark.read.parquet(f"{path}/{t}") for t in Database.TABLES}
        k = spark.read.parquet(f"{path}/meta").first()["k"]
        return Database(k=k, **tables)
    if format == "json":
        doc = spark.read.schema(DATABASE_JSON).json(path, multiLine=True)
    elif format == "messagepack":
        return _from_values(spark, path)
    else:
        raise ValueError(f"invalid format: {format!r}")
    first = doc.select("k").first()
    if first is None or first["k"] is None:
        raise EOFError("no database in the file")
    regions = doc.select(F.posexplode("regions").alias("region", "r"))
    given = regions.select("region", "r.primer").orderBy("region").collect()  # regions are few
    primers = primer_table(spark, [tuple(r["primer"]) for r in given])
    refs = doc.select(F.posexplode(F.arrays_zip("names", "amplified")).alias("j", "z")).select(F.col("j").cast("long").alias("j"), F.col("z.names").alias("name"), F.col("z.names").alias("original_name"), F.col("z.amplified").alias("amplified"))
    # Forward k-mers come first, then backward ones; both are sorted, and their order is trusted.
    sides = [regions.select("region", F.lit(side).alias("side"), F.posexplode(F.col("r.unique_kmers")[k]).alias("kmer_id", "kmer")) for k, side in enumerate(("fwd", "bwd"))]
    kmers = sides[0].unionByName(sides[1]).withColumn("kmer_id", F.col("kmer_id").cast("long"))
    pairs = regions.select("region", F.posexplode("r.unique_pairs").alias("h", "p")).select("region", F.col("h").cast("long").alias("h"), F.col("p")[0].alias("fwd_id"), F.col("p")[1].alias("bwd_id"))
    index = regions.select("region", F.col("r.matrix").alias("m"))
    rows = index.select("region", "m", F.posexplode(F.expr("slice(m.row_index, 1, size(m.row_index) - 1)")).alias("h", "begin")).withColumn("end", F.element_at("m.row_index", F.col("h") + 2))
    cells = F.explode(F.expr("transform(slice(m.col_index, cast(begin + 1 as int), cast(end - begin as int)), (j, n) -> struct(j, m.data[cast(begin as int) + n] as x))"))
    m = rows.where("end > begin").select("region", F.col("h").cast("long").alias("h"), cells.alias("c")).select("region", "h", F.col("c.j").alias("j"), F.col("c.x").alias("x"))
    perfect = regions.select("region", F.posexplode("r.perfect_match").alias("j", "p")).select("region", F.col("j").cast("long").alias("j"), (F.col("p") != 0).alias("perfect"))
    return _database(first["k"], primers, refs, kmers, pairs, m, perfect)


def _from_values(spark: SparkSession, path: str) -> Database:
    """The tables of a MessagePack document. Entries of the matrix meet by their place in its lists."""
    values = read_values(spark, path)
    of = lambda *fields: values.where(F.col("field").isin(*fields))
    first = of("k").first()
    if first is None:
        raise EOFError("no database in the file")
    given = of("primer").orderBy("region").collect()  # regions are few
    primers = primer_table(spark, [tuple(json.loads(r["s"])) for r in given])
    names, amplified = of("names").select("at", F.col("s").alias("name")), of("amplified").select("at", F.col("a").cast("int").alias("amplified"))
    refs = names.join(amplified, "at").select(F.col("at").alias("j"), "name", F.col("name").alias("original_name"), "amplified")
    kmers = of("fwd", "bwd").select("region", F.col("field").alias("side"), F.col("at").alias("kmer_id"), F.col("s").alias("kmer"))
    pairs = of("unique_pairs").select("region", F.col("at").alias("h"), F.col("a").alias("fwd_id"), F.col("b").alias("bwd_id"))
    ends = of("row_index").where("at > 0").select("region", (F.col("at") - 1).alias("h"), F.col("a").alias("end"))
    begins = of("row_index").select("region", F.col("at").alias("h"), F.col("a").alias("begin"))
    rows = begins.join(ends, ["region", "h"]).where("end > begin").select("region", "h", F.explode(F.sequence("begin", F.col("end") - 1)).alias("at"))
    cells = of("col_index").select("region", "at", F.col("a").alias("j")).join(of("data").select("region", "at", "x"), ["region", "at"])
    m = rows.join(cells, ["region", "at"]).select("region", "h", "j", "x")
    perfect = of("perfect_match").select("region", F.col("at").alias("j"), (F.col("a") != 0).alias("perfect"))
    return _database(first["a"], primers, refs, kmers, pairs, m, perfect)


def _database(k: int, primers: DataFrame, refs: DataFrame, kmers: DataFrame, pairs: DataFrame, m: DataFrame, perfect: DataFrame) -> Database:
    """Sketches are made of the other tables; how the primers fitted is not in a document."""
    names = refs.where("name <> ''").select("j", "name")
    ids = lambda side: kmers.where(F.col("side") == side).select("region", F.col("kmer_id").alias(f"{side}_id"), F.col("kmer").alias(f"{side}_kmer"))
    zero = F.lit(None).cast("int")
    sketches = m.join(pairs, ["region", "h"]).join(ids("fwd"), ["region", "fwd_id"]).join(ids("bwd"), ["region", "bwd_id"]).join(names, "j").select("region", "j", "name", "fwd_kmer", "bwd_kmer", zero.alias("fwd_mm"), zero.alias("bwd_mm"))
    return Database(k, *[stage(t, "load") for t in (primers, refs, sketches, kmers, pairs, m, perfect)])

