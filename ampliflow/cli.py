"""Profiles a sample: ``spark-submit ampliflow/cli.py --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ampliflow.operators.database import Database, ReferenceBuilder
from ampliflow.operators.estimate import Estimate
from ampliflow.operators.mapper import ReadMapper
from ampliflow.operators.staging import release
from ampliflow.sources.readers import load_database, pair_reads, read_fasta, read_fastq, read_taxonomy
from ampliflow.sources.writers import save_database, write_report


def database(spark: SparkSession, args: argparse.Namespace) -> Database:
    """Loads the database if its folder has one, else builds it and writes it there."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{args.database}/meta")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return load_database(spark, args.database)
    primers = [tuple(p.split(",")) for p in args.primers]
    db = ReferenceBuilder(spark, primers, k=args.k, primer_mismatches=args.primer_mismatches).build(read_fasta(spark, args.references, to_dna=True))
    save_database(db, args.database)
    return db


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Relative abundances from paired amplicon reads.")
    p.add_argument("--references", help="FASTA of reference sequences (to build a database)")
    p.add_argument("--database", required=True, help="folder of the database")
    p.add_argument("--primers", nargs="*", default=[], help="forward,backward primer of each region")
    p.add_argument("--r1", required=True)
    p.add_argument("--r2", required=True)
    p.add_argument("--taxonomy")
    p.add_argument("--report", required=True)
    p.add_argument("--k", type=int, default=160)
    p.add_argument("--primer-mismatches", type=int, default=2)
    p.add_argument("--kmer-mismatches", type=int, default=2)
    p.add_argument("--partial-hits", action="store_true")
    p.add_argument("--steps", type=int, default=10)
    p.add_argument("--show", type=float, default=0.005, help="least frequency of the rows that are printed")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("ampliflow").getOrCreate()
    db = database(spark, args)
    reads = pair_reads(read_fastq(spark, args.r1), read_fastq(spark, args.r2))
    mapper = ReadMapper(db, primer_mismatches=args.primer_mismatches, kmer_mismatches=args.kmer_mismatches, partial_hits=args.partial_hits)
    mapping = mapper.map(reads)
    found = Estimate.start(mapping).refine(args.steps, tol=0.0)
    report = found.report(read_taxonomy(spark, args.taxonomy) if args.taxonomy else None, strict=bool(args.taxonomy))
    mapped = mapping.mapped.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    write_report(report, args.report, args.r1, args.r2, reads.count(), mapped)
    report.where(F.col("frequency") > args.show).orderBy(F.desc("frequency")).show(truncate=False)
    release(spark)


if __name__ == "__main__":
    main()
