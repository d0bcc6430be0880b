"""Steps that move and make each row once, whatever ran before."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from ampliflow.operators import simjoin, staging
from ampliflow.operators.database import ReferenceBuilder, primer_table
from ampliflow.operators.mapper import ReadMapper
from ampliflow.operators.staging import dense_index, dense_ranks
from ampliflow.plans import fixture as fx

PRIMERS = [("ACCGTA", "TTGACC"), ("CAGYTG", "GGATTC")]


def test_dense_ranks_are_those_of_distinct_keys(spark):
    rows = [(by, f"k{k * 7 % 50:02d}", n) for by in (0, 1, 3) for k in range(50) for n in range(k % 4)]
    got = {tuple(r) for r in dense_ranks(spark.createDataFrame(rows, "by int, key string, n int").repartition(7), "key", "rank", by="by").select("by", "key", "n", "rank").collect()}
    known = {by: sorted({k for b, k, _ in rows if b == by}) for by in (0, 1, 3)}
    assert got == {(by, k, n, known[by].index(k)) for by, k, n in rows}
    first = dense_ranks(spark.createDataFrame(rows, "by int, key string, n int").repartition(7), "key", "rank", by="by").where("first")
    assert sorted(map(tuple, first.select("by", "key").collect())) == sorted({(by, k) for by, k, _ in rows})


def test_dense_index_shuffles_rows_once(spark):
    rows = dense_index(spark.range(1000).select(F.col("id"), F.rand(3).alias("r"), (F.col("id") % 3).alias("by")), ["r"], "i", by="by")
    assert [r["n"] for r in rows.groupBy("by").agg((F.countDistinct("i") == F.max("i") + 1).alias("n")).collect()] == [True] * 3
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan  # rows only meet the sizes of the ranges


def test_numbered_reads_count_as_often(spark):
    reads = [("ACCGTAAAGGCTGGG", "TTGACCTTGAGACCC", 5), ("TCAGCTGGATAGACC", "GGATTCAGTAAGGG", 2), ("ACCGTAAAGGCTGGA", "TTGACCTTGAGACCA", 3), ("ACCGTANAGGCTGGG", "TTGACCTTGAGACCC", 9)]
    each = spark.createDataFrame([(f, b) for f, b, n in reads for _ in range(n)], "fwd string, bwd string")
    numbered = spark.createDataFrame([(f, b, n) for f, b, n in [*reads, reads[0]]], "fwd string, bwd string, n long")
    more = each.unionByName(spark.createDataFrame([reads[0][:2]] * 5, "fwd string, bwd string"))
    mapper = ReadMapper(None, primers=primer_table(spark, PRIMERS), kmer_length=6, primer_mismatches=0)
    want = sorted(map(tuple, mapper.read_counts(more).collect()))
    assert want and sorted(map(tuple, mapper.read_counts(numbered).collect())) == want


def test_expansions_that_give_equal_sketches_count_once(spark):
    # R is outside both k-mers: its two expansions have the same sketch.
    rows = [(0, "a", "TTTTRACCGTAAAGGCTGGGTCTCAAGGTCAAAA"), (1, "b", "TTTTACCGTAAAGGCTGGGTCTCAAGGTCAAAA")]
    db = ReferenceBuilder(spark, PRIMERS[:1], k=6, primer_mismatches=0).build(spark.createDataFrame(rows, "seq_no long, id string, sequence string"))
    assert sorted((r["j"], r["fwd_kmer"], r["bwd_kmer"]) for r in db.sketches.collect()) == [(0, "AAGGCT", "TTGAGA"), (1, "AAGGCT", "TTGAGA")]
    assert sorted(map(tuple, db.kmers.select("region", "side", "kmer_id", "kmer").collect())) == [(0, "bwd", 0, "TTGAGA"), (0, "fwd", 0, "AAGGCT")]


def test_queries_leave_nothing_to_the_next_one(spark):
    fx.forget()
    entry.queries()["build_amplified"](spark, "/root/testdata/sf0.001")
    assert not fx._BUILT
    fx.database(spark, "/root/testdata/sf0.001")  # asked for by the application: it stays
    given = set(fx._BUILT)
    entry.queries()["read_threshold"](spark, "/root/testdata/sf0.001")
    assert given and set(fx._BUILT) == given
    fx.forget()


def test_packed_words_translate_their_own_bases(spark):
    row = spark.createDataFrame([("ACGT" * 40,)], "kmer string").select(*simjoin.packed(F.col("kmer"), 160))
    digits = "0123" * 40
    assert list(row.first()) == [int(digits[a : a + 31], 4) for a in range(0, 160, 31)]
    words = row._jdf.queryExecution().analyzed().toString()
    assert "translate(substring(" in words and "substring(translate(" not in words  # else each of the six words translates all bases


def test_sequences_are_looked_at_once_after_the_shuffle(spark, monkeypatch):
    seen, write = [], staging.stage
    monkeypatch.setattr(staging, "stage", lambda df, name: seen.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    rows = [(5, "a", "ACGT"), (3, "b", "ACGN"), (9, "c", "NNNNA"), (7, "d", "UUGA")]
    numbered = ReferenceBuilder(spark, PRIMERS, k=6).numbered(spark.createDataFrame(rows, "seq_no long, id string, sequence string"))
    assert sorted(map(tuple, numbered.select("j", "name", "sequence").collect())) == [(0, "b", "ACGN"), (1, "a", "ACGT"), (2, "d", "TTGA")]
    plan = dict(seen)["index-j"]
    assert "RLIKE" in plan and plan.rindex("RLIKE") < plan.index("RepartitionByExpression")  # below it, it would be done for the sample of the ranges too


def test_regions_of_reads_stay_in_compiled_code(spark):
    reads = spark.createDataFrame([("ACCGTAAAGGCTGGG", "TTGACCTTGAGACCC", 5)], "fwd string, bwd string, n long")
    kmers = ReadMapper(None, primers=primer_table(spark, PRIMERS), kmer_length=6, primer_mismatches=0).assigned_kmers(reads)
    assert [tuple(r) for r in kmers.collect()] == [("", 0, "AAGGCT", "TTGAGA", 5)]
    assert "lambda" not in kmers._jdf.queryExecution().optimizedPlan().toString()


def test_windows_are_those_of_column_functions(spark, tmp_path):
    texts = [None, "", "12 .", "Zebra! ñandú ſharp K\n\tx" * 90, "abc" * 800, "Ａa😀b", "y" * 800]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    windows = fx._cut(spark, str(tmp_path))
    got = {}
    for r in windows.orderBy("doc_id", "w").collect():
        got.setdefault(r["doc_id"], []).append(r["dna"])
    dna = {r["doc_id"]: r["dna"] for r in fx.dna(spark, str(tmp_path)).collect()}
    want = {k: [(s[at : at + 800] + "ACGT" * 200)[:800] for at in range(0, max(len(s), 1), 800)] for k, s in dna.items()}
    assert got == want and len(want) == len(texts)
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and "regexp" not in plan  # each letter would be looked up as a string of its own
