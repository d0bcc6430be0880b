"""Reference sequences to a k-mer database: tables keyed by region."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampliflow.functions import dna
from ampliflow.operators.primers import best_hits
from ampliflow.operators.staging import dense_index, dense_ranks, held, stage

MAX_REGIONS = 254


def primer_table(spark: SparkSession, primers: list[tuple[str, str]]) -> DataFrame:
    """(region, fwd, bwd) of primer pairs as given, 5' to 3'."""
    if len(primers) > MAX_REGIONS:
        raise ValueError(f"at most {MAX_REGIONS} regions")
    for pair in primers:
        if len(pair) != 2:
            raise ValueError(f"expected a pair of primers, found {len(pair)}")
        for p in pair:
            dna.checked_primer(p)
    return spark.createDataFrame([(k, f, b) for k, (f, b) in enumerate(primers)], "region int, fwd string, bwd string")


@dataclass
class Database:
    """``refs`` (j, name, original_name, amplified), ``sketches``, ``kmers`` (region, side, kmer_id, kmer), ``pairs``
    (region, h, fwd_id, bwd_id), ``m`` (region, h, j, x), ``perfect`` (region, j, perfect), ``primers`` and k."""

    k: int
    primers: DataFrame
    refs: DataFrame
    sketches: DataFrame
    kmers: DataFrame
    pairs: DataFrame
    m: DataFrame
    perfect: DataFrame

    TABLES = ("primers", "refs", "sketches", "kmers", "pairs", "m", "perfect")

    def names(self) -> DataFrame:
        return self.refs.select("j", "name").orderBy("j")

    def register_views(self, prefix: str = "amplicon_") -> None:
        for t in self.TABLES:
            getattr(self, t).createOrReplaceTempView(prefix + t)


class ReferenceBuilder:
    """Collects primer-defined k-mers of reference sequences."""

    def __init__(self, spark: SparkSession, primers: list[tuple[str, str]], k: int = 160, primer_mismatches: int = 2, max_ambiguous: int = 3, invalid: str = "raise"):
        self.spark, self.k, self.primer_mismatches, self.max_ambiguous = spark, k, primer_mismatches, max_ambiguous
        if k <= 0:
            raise dna.InvalidKmerLength(f"invalid k-mer length: {k}")
        if invalid not in ("raise", "reject"):
            raise ValueError(f"invalid is 'raise' or 'reject', not {invalid!r}")
        self.invalid = invalid
        self.primers, self.pairs = primer_table(spark, primers), [tuple(p) for p in primers]

    @staticmethod
    def rejected(references: DataFrame) -> DataFrame:
        """What ``invalid="reject"`` leaves out: the other columns of references with an invalid symbol, where and what it is."""
        return dna.rejected(references, "sequence")

    def numbered(self, references: DataFrame) -> DataFrame:
        """(j, name, sequence) of references (seq_no, id, sequence) with few ambiguity codes, numbered by seq_no; U becomes T."""
        return self._numbered(references).drop("coded")

    def _numbered(self, references: DataFrame) -> DataFrame:
        """The same with ``coded``: whether there are ambiguity codes. Sequences are looked at once, after they are sorted."""
        references = dna.accepted(references, "sequence") if self.invalid == "reject" else references
        rows = references.select("seq_no", F.col("id").alias("name"), dna.as_dna(F.col("sequence")).alias("sequence"))

        def looked_at(ranges: DataFrame) -> DataFrame:
            return held(ranges, dna.few_ambiguous(F.col("sequence"), self.max_ambiguous)).withColumn("coded", dna.is_coded(F.col("sequence")))

        return dense_index(rows, ["seq_no", "name"], "j", finish=looked_at).drop("seq_no")

    def hits(self, numbered: DataFrame) -> DataFrame:
        """Every expansion of every reference in every region, with the best place of both primers."""
        plain, coded = self._variants(numbered)
        return self._placed(plain.unionByName(coded))

    @staticmethod
    def _variants(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
        """References without ambiguity codes, and the expansions of the others; ``coded`` says which they are if it is there."""
        is_coded = F.col("coded") if "coded" in numbered.columns else dna.is_coded(F.col("sequence"))
        coded = numbered.where(is_coded).select("j", "name", F.col("sequence").alias("coded"))
        return numbered.where(~is_coded).select("j", "name", "sequence"), dna.expanded(coded, "coded", "sequence").drop("coded")

    def _placed(self, variants: DataFrame) -> DataFrame:
        asked = [p for fwd, bwd in self.pairs for p in (fwd, dna.reverse_complement_of(bwd))]
        found = variants.withColumn("h", best_hits(asked)("sequence"))
        each = [F.struct(F.lit(n).alias("region"), F.lit(len(p[0])).alias("fwd_length"), F.get("h", F.lit(2 * n)).alias("f"), F.get("h", F.lit(2 * n + 1)).alias("b")) for n, p in enumerate(self.pairs)]
        found = found.select("j", "name", "sequence", F.explode(F.array(*each)).alias("r"))
        return found.select("r.region", "j", "name", "sequence", "r.fwd_length", F.col("r.f.mm").alias("fwd_mm"), F.col("r.f.pos").alias("fwd_pos"), F.col("r.b.mm").alias("bwd_mm"), F.col("r.b.pos").alias("bwd_pos"))

    def sketches(self, hits: DataFrame) -> DataFrame:
        return self._cut(hits).dropDuplicates()

    def _cut(self, hits: DataFrame) -> DataFrame:
        k, most = self.k, self.primer_mismatches
        start = F.col("fwd_pos") + F.col("fwd_length")
        good = hits.where((F.col("fwd_mm") <= most) & (F.col("bwd_mm") <= most) & (F.col("fwd_pos") < F.col("bwd_pos")) & (start + k <= F.length("sequence")) & (F.col("bwd_pos") >= k))
        fwd = dna.slice_of(F.col("sequence"), start, k)
        bwd = dna.reverse_complement(dna.slice_of(F.col("sequence"), F.col("bwd_pos") - k, k))
        return good.select("region", "j", "name", fwd.alias("fwd_kmer"), bwd.alias("bwd_kmer"), "fwd_mm", "bwd_mm")

    def build(self, references: DataFrame) -> Database:
        return self._merged(None, references)

    def add(self, db: Database, references: DataFrame) -> Database:
        """The database of all references of ``db`` and then these, as if they had been built together.

        Only the new references are searched for primers, and only their columns are normalised. The dictionaries are merged, as ids are ranks; what
        there was keeps its columns and gets the new ids. ``db`` itself stays as it is.
        """
        mine = {(k, f, b) for k, (f, b) in enumerate(self.pairs)}
        if db.k != self.k or {tuple(r) for r in db.primers.select("region", "fwd", "bwd").collect()} != mine:  # primers are few
            raise ValueError("the database has another k or other primers")
        return self._merged(db, references)

    def _merged(self, db: Database | None, references: DataFrame) -> Database:
        with dna.typed_errors():
            return self._merge(db, references)

    def _merge(self, db: Database | None, references: DataFrame) -> Database:
        first = 0 if db is None else db.refs.count()  # every reference has a row, numbered from 0
        numbered = self._numbered(references).select((F.col("j") + first).alias("j"), "name", "sequence", "coded")
        plain, coded = self._variants(numbered)
        # Only expansions of one reference can give equal rows.
        cut = self._cut(self._placed(plain)).unionByName(self.sketches(self._placed(coded)))
        sketches = stage(cut.withColumn("no", F.monotonically_increasing_id()), "sketches")

        none = F.lit(None).cast("long")
        rs = lambda side: (F.col("region") * 2 + side).cast("int")
        # Both ends of a sketch come from one reading of it.
        ends = F.stack(F.lit(2), rs(0), F.col("fwd_kmer"), rs(1), F.col("bwd_kmer")).alias("rs", "kmer")
        sides = sketches.select(ends, "no", "j", none.alias("old"))
        if db is not None:
            sides = sides.unionByName(db.kmers.where(F.col("side").isin("fwd", "bwd")).select(rs(F.when(F.col("side") == "fwd", 0).otherwise(1)).alias("rs"), "kmer", none.alias("no"), none.alias("j"), F.col("kmer_id").alias("old")))
        coded_sides = dense_ranks(sides, "kmer", "kmer_id", by="rs").withColumns({"region": F.shiftright("rs", 1), "side": F.when(F.col("rs") % 2 == 0, "fwd").otherwise("bwd")})
        kmers = coded_sides.where("first").select("region", "side", "kmer_id", "kmer")
        # The two ends of a sketch meet by its number, without their k-mers: the row of the forward one, which comes first, looks at the next. All that is
        # counted of a reference needs its rows together, so they are shuffled once, by ``j``.
        met = coded_sides.where(F.col("no").isNotNull()).select("no", "rs", "region", "j", "kmer_id").repartition("j")
        met = met.withColumn("bwd_id", F.lead("kmer_id").over(Window.partitionBy("j", "no").orderBy("rs"))).where("rs % 2 = 0").withColumnRenamed("kmer_id", "fwd_id")
        equal = Window.partitionBy("j", "region", "fwd_id", "bwd_id").orderBy("no")
        met = met.withColumns({"sketches": F.count(F.lit(1)).over(equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "nth": F.row_number().over(equal)}).where("nth = 1")
        encoded = stage(met.select("region", "j", "fwd_id", "bwd_id", "sketches", F.count(F.lit(1)).over(Window.partitionBy("j", "region")).alias("n")), "encoded")
        sketches = sketches.drop("no")
        known = encoded.select("region", "fwd_id", "bwd_id").distinct()
        if db is not None:
            moved = coded_sides.where(F.col("old").isNotNull()).select("region", "side", "old", "kmer_id")
            now = db.pairs
            for side in ("fwd", "bwd"):
                of = moved.where(F.col("side") == side).select("region", F.col("old").alias(f"{side}_id"), F.col("kmer_id").alias(f"{side}_now"))
                now = now.join(of, ["region", f"{side}_id"])
            old_pairs = stage(now.select("region", F.col("h").alias("old"), F.col("fwd_now").alias("fwd_id"), F.col("bwd_now").alias("bwd_id")), "old-pairs")
            known = known.unionByName(old_pairs.drop("old")).distinct()
        pairs = stage(dense_index(known, ["fwd_id", "bwd_id"], "h", by="region").select("region", "h", "fwd_id", "bwd_id"), "pairs")
        # Each row of ``encoded`` has one pair.
        m = encoded.join(pairs, ["region", "fwd_id", "bwd_id"]).select("region", "h", "j", (1.0 / F.col("n")).alias("x"))
        counted = encoded.groupBy("j").agg(F.sum(F.col("sketches") + 1).cast("int").alias("amplified"))
        refs = numbered.select("j", F.col("name").alias("original_name")).join(counted, "j", "left")
        refs = refs.select("j", F.when(F.col("amplified").isNotNull(), F.col("original_name")).otherwise("").alias("name"), "original_name", F.coalesce("amplified", F.lit(0)).alias("amplified"))
        perfect = sketches.groupBy("region", "j").agg(F.bool_or((F.col("fwd_mm") == 0) & (F.col("bwd_mm") == 0)).alias("perfect"))
        every = refs.select("j").crossJoin(F.broadcast(self.primers.select("region")))
        perfect = every.join(perfect, ["region", "j"], "left").select("region", "j", F.coalesce("perfect", F.lit(False)).alias("perfect"))
        if db is not None:
            ranks = old_pairs.join(pairs, ["region", "fwd_id", "bwd_id"]).select("region", "old", F.col("h").alias("now"))
            m = m.unionByName(db.m.join(ranks, (db.m["region"] == ranks["region"]) & (db.m["h"] == ranks["old"])).select(db.m["region"], F.col("now").alias("h"), "j", "x"))
            sketches, refs, perfect = [getattr(db, t).select(*new.columns).unionByName(new) for t, new in (("sketches", sketches), ("refs", refs), ("perfect", perfect))]
        return Database(self.k, self.primers, stage(refs, "refs"), sketches, kmers, pairs, stage(m, "m"), stage(perfect, "perfect"))
