"""Paired reads to a sparse matrix of read k-mers by references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampliflow.functions import dna
from ampliflow.operators.database import Database
from ampliflow.operators.primers import by_region, edge_ends
from ampliflow.operators.simjoin import hamming_join
from ampliflow.operators.sparse import column_groups
from ampliflow.operators.staging import dense_index, stage


@dataclass
class Mapping:
    """Of each sample: ``q`` (i, j, x), ``y`` (i, region, n, y), ``groups`` (j, g, rep_j), ``assigned`` and ``mapped`` by region."""

    database: Database
    q: DataFrame
    y: DataFrame
    groups: DataFrame
    assigned: DataFrame
    mapped: DataFrame


class ReadMapper:
    """Maps reads (fwd, bwd, and optionally sample and n) to the k-mers of a database; with primers alone it counts reads.

    ``n`` says how many reads a row stands for, as in files without their copies; rows may still be equal.
    """

    def __init__(
        self, database: Database | None, *, primers: DataFrame | None = None, kmer_length: int | None = None, primer_mismatches: int = 2, kmer_mismatches: int = 2, error_probability: float = 0.005, partial_hits: bool = False,
        primer_region: int = 20, min_read_frequency: float = 1e-4, min_read_count: int = 2, max_ambiguous: int = 0, strategy: str = "auto", invalid: str = "raise",
    ):
        if database is None and (primers is None or kmer_length is None):
            raise ValueError("without a database, primers and kmer_length are needed")
        self.database = database
        self.primers = database.primers if primers is None else primers
        self.kmer_length = database.k if kmer_length is None else kmer_length
        if self.kmer_length <= 0 or database is not None and self.kmer_length > database.k:
            raise dna.InvalidKmerLength(f"invalid k-mer length: {self.kmer_length}")
        if invalid not in ("raise", "reject"):
            raise ValueError(f"invalid is 'raise' or 'reject', not {invalid!r}")
        self.invalid = invalid
        self.primer_mismatches, self.kmer_mismatches, self.error_probability, self.partial_hits = primer_mismatches, kmer_mismatches, error_probability, partial_hits
        self.primer_region, self.min_read_frequency, self.min_read_count, self.max_ambiguous, self.strategy = primer_region, min_read_frequency, min_read_count, max_ambiguous, strategy

    @staticmethod
    def rejected(reads: DataFrame) -> DataFrame:
        """What ``invalid="reject"`` leaves out: the other columns of reads with an invalid symbol, and which mate, where and what it is."""
        return dna.rejected(reads, "fwd", "bwd")

    def distinct(self, reads: DataFrame) -> DataFrame:
        """(sample, fwd, bwd, n): distinct read pairs whose mates have few ambiguity codes; ``sample`` is "" where there is none.

        Reads that come with their number ``n`` are not shuffled to be counted once more: equal pairs of them meet as k-mers.
        """
        # The count keeps the check above the aggregate: once for each distinct pair, not for each read and whatever makes it.
        return self._pairs(reads).where(F.when(F.col("n") > 0, self._few()))

    def _few(self):
        return dna.few_ambiguous(F.col("fwd"), self.max_ambiguous) & dna.few_ambiguous(F.col("bwd"), self.max_ambiguous)

    def _pairs(self, reads: DataFrame) -> DataFrame:
        reads = reads if "sample" in reads.columns else reads.withColumn("sample", F.lit(""))
        reads = dna.accepted(reads, "fwd", "bwd") if self.invalid == "reject" else reads
        mates = [dna.as_dna(F.col(c)).alias(c) for c in ("fwd", "bwd")]
        if "n" in reads.columns:
            return reads.select("sample", *mates, F.col("n").cast("long").alias("n"))
        return reads.select("sample", *mates).groupBy("sample", "fwd", "bwd").agg(F.count(F.lit(1)).alias("n"))

    def assigned_kmers(self, reads: DataFrame) -> DataFrame:
        """(sample, region, fwd, bwd, n): trimmed k-mers of every distinct read pair in every region whose primers both fit."""
        primers = self.primers.select("region", "fwd", "bwd").orderBy("region").collect()  # fewer than 255
        counted = "n" in reads.columns
        found = self._pairs(reads) if counted else self.distinct(reads)
        found = found.withColumn("ends", edge_ends([(p["fwd"], p["bwd"]) for p in primers], self.primer_mismatches, self.primer_region)("fwd", "bwd"))
        # Where no aggregate holds it, the check stays above the kernel, or whatever makes the reads would be run for it once more.
        found = found.where(self._few()) if counted else found
        # A row for each region and then those that fit: a list of these would be made outside the compiled code.
        fits = by_region(F.col("ends"), len(primers)) or [F.lit(None).cast("struct<region:int,fwd_end:int,bwd_end:int>")]
        found = found.select("sample", "fwd", "bwd", "n", F.explode(F.array(*fits)).alias("r")).where("r IS NOT NULL")
        numbers = F.array(*[F.lit(p["region"]) for p in primers])

        def trimmed(side: str):
            return F.substring(side, F.col(f"r.{side}_end") + 1, F.lit(self.kmer_length)).alias(side)

        kmers = found.select("sample", F.get(numbers, "r.region").alias("region"), trimmed("fwd"), trimmed("bwd"), "n")
        return kmers if self.partial_hits else kmers.where((F.length("fwd") == self.kmer_length) & (F.length("bwd") == self.kmer_length))

    def read_counts(self, reads: DataFrame) -> DataFrame:
        return self.assigned_kmers(reads).groupBy("sample", "region", "fwd", "bwd").agg(F.sum("n").alias("n"))

    @staticmethod
    def assigned(counts: DataFrame) -> DataFrame:
        return counts.groupBy("sample", "region").agg(F.sum("n").alias("n"))

    def frequent(self, counts: DataFrame) -> DataFrame:
        total = self.assigned(counts).withColumnRenamed("n", "total")  # a row for each sample and region
        return counts.join(F.broadcast(total), ["sample", "region"]).where(F.col("n") >= dna.threshold(self.min_read_frequency, F.col("total"), self.min_read_count)).drop("total")

    def probabilities(self, frequent: DataFrame) -> DataFrame:
        """(sample, region, fwd, bwd, n, h, ne, p): pairs of read k-mers and database pairs within the errors of both ends."""
        db, d = self.database, self.kmer_mismatches

        def matched(side: str) -> DataFrame:
            queries = frequent.select("region", F.col(side).alias("q")).distinct()
            block = db.kmers.where(F.col("side") == side).select("region", "kmer_id", "kmer")
            found = hamming_join(queries, block, d, self.kmer_length, self.strategy)
            return found.select("region", F.col("q").alias(side), F.col("kmer_id").alias(f"{side}_id"), F.col("mm").alias(f"{side}_mm"))

        # A database pair is reached from its forward k-mer; the backward one then decides.
        both = frequent.join(matched("fwd"), ["region", "fwd"]).join(db.pairs, ["region", "fwd_id"]).join(matched("bwd"), ["region", "bwd", "bwd_id"])
        ne = F.col("fwd_mm") + F.col("bwd_mm")
        length = F.length("fwd") + F.length("bwd")
        found = both.where(ne <= d).select("sample", "region", "fwd", "bwd", "n", "h", ne.alias("ne"), dna.error_probability(ne, length, self.error_probability).alias("p"))
        return found.where("p > 0")

    def map_counts(self, counts: DataFrame, staged: bool = False) -> Mapping:
        """The mapping of counted reads; ``staged`` says that they are in files already."""
        db = self.database
        counts = counts if staged else stage(counts, "read-counts")
        e = stage(self.probabilities(self.frequent(counts)), "probabilities")
        rows = dense_index(e.select("sample", "region", "fwd", "bwd", "n").distinct(), ["region", "fwd", "bwd"], "i", by="sample")
        rows = stage(rows, "rows")
        mapped = rows.groupBy("sample", "region").agg(F.sum("n").alias("n"))
        total = rows.groupBy("sample").agg(F.sum("n").alias("total"))
        y = rows.join(F.broadcast(total), "sample").select("sample", "i", "region", "n", (F.col("n") / F.col("total")).alias("y"))
        ei = e.join(rows.drop("n"), ["sample", "region", "fwd", "bwd"]).select("sample", "i", "region", "h", "p")
        parts = ei.join(db.m, ["region", "h"]).groupBy("sample", "i", "j").agg(F.array_sort(F.collect_list(F.struct("h", (F.col("p") * F.col("x")).alias("v")))).alias("terms"))
        # Summed in ascending h, so that equal columns are equal to the last bit.
        x = F.aggregate("terms", F.lit(0.0), lambda a, t: a + t["v"])
        q = parts.select("sample", "i", "j", x.alias("x")).join(db.refs.select("j", "amplified"), "j").select("sample", "i", "j", (F.col("x") / F.col("amplified")).alias("x"))
        q = stage(q, "q")
        samples = y.select("sample").distinct()
        groups = stage(column_groups(q, db.refs.select("j").crossJoin(F.broadcast(samples)), "sample"), "groups")
        return Mapping(db, q, stage(y, "y"), groups, self.assigned(counts), mapped)

    def map(self, reads: DataFrame) -> Mapping:
        return self.map_counts(self.read_counts(reads))
