import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ampliflow.functions import dna
from ampliflow.operators.database import primer_table


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "s string").select(expr(F.col("s")).alias("x")).first()["x"]


def test_reverse_complement(spark):
    assert one(spark, "AACGTRYN", dna.reverse_complement) == "NRYACGTT"
    assert one(spark, "ACU", dna.reverse_complement) is None
    assert one(spark, "", dna.reverse_complement) == ""


def test_ambiguity_and_validity(spark):
    assert one(spark, "ACGURN", dna.count_ambiguous) == 2
    assert one(spark, "ACGX", dna.count_ambiguous) is None
    assert one(spark, "acg", dna.is_valid) is False
    assert one(spark, "N", dna.is_ambiguous) is True
    with pytest.raises(Exception, match="invalid DNA"):
        one(spark, "ACGX", dna.validated)


def test_mismatch_is_asymmetric_and_s_matches_g_only():
    assert dna.mismatch_count("N", "A") == 0
    assert dna.mismatch_count("A", "N") == 1
    assert dna.mismatch_count("S", "G") == 0
    assert dna.mismatch_count("S", "C") == 1
    assert dna.mismatch_count("S", "C", compat=False) == 0
    assert dna.mismatch_count("ACGT", "AC") == 0


def test_expansions_vary_leftmost_fastest():
    assert dna.expansions("ARYT") == ["AACT", "AGCT", "AATT", "AGTT"]
    assert dna.expansions("ACG") == ["ACG"]


def test_disambiguation_takes_a_batch_together(spark):
    """Arrow batches are expanded as they are; the arrays are those of ``expansions``, also of nulls, repeated and odd texts."""
    texts = ["ARYT", None, "", "ACG", "NNNB", "ARYT", "U-r", "R\u00e9Y\n", None, "N" * 9]
    wanted = [t if t is None else dna.expansions(t) for t in texts]
    assert dna.disambiguate.func(pa.array(texts, pa.string())).to_pylist() == wanted
    assert dna.disambiguate.func(pa.array(texts, pa.string()).slice(1, 4)).to_pylist() == wanted[1:5]
    assert [dna.disambiguate.func(pa.array(x, pa.string())).to_pylist() for x in ([], [None])] == [[], [None]]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, s string")
    assert {r.n: r.v for r in df.select("n", dna.disambiguate("s").alias("v")).collect()} == dict(enumerate(wanted))


def test_kernels_take_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("ARC", "AGC"), (None, "A"), ("A", None)], "p string, s string")
    assert [r[0] for r in df.select(dna.mismatches("p", "s")).collect()] == [0, None, None]
    assert df.where("p = 'none'").select(dna.mismatches("p", "s"), dna.disambiguate("p")).collect() == []


def test_rounding(spark):
    df = spark.createDataFrame([(2.5,), (float("nan"),), (None,), (0.4,)], "x double")
    assert [r[0] for r in df.select(dna.rounded_count(F.col("x"))).collect()] == [3, 0, 0, 0]


def test_primers_are_checked(spark):
    assert primer_table(spark, [("TGGCGAA", "CCGTG")]).count() == 1
    with pytest.raises(TypeError):
        primer_table(spark, [(1, 2)])
    with pytest.raises(ValueError):
        primer_table(spark, [("TGGXGAA", "CCGTG")])
    with pytest.raises(ValueError):
        primer_table(spark, [("TGG",)])
    assert len(dna.pssm("AGGAAGGTGGGGATGACG")) == 18


def test_sql_functions(spark):
    dna.register(spark)
    row = spark.sql("SELECT dna_reverse_complement('AACG') AS a, dna_count_ambiguous('ANR') AS b, dna_mismatches('AN', 'AC') AS c, dna_disambiguate('R') AS d").first()
    assert (row.a, row.b, row.c, row.d) == ("CGTT", 2, 0, ["A", "G"])


def test_pssm_rows(spark):
    """Positions of a primer as ``pssm`` has them; scores of a long primer are taken once."""
    primers = ["AGGRYNBACGTT", "N", "", None, "ACGTRYSWKMBDHVN"]
    df = spark.createDataFrame(list(enumerate(primers)), "n int, p string")
    found = {(r.n, r.k): (r.a, r.c, r.g, r.t) for r in dna.pssm_rows(df, "p").collect()}
    wanted = {(n, k): tuple(odds[b] for b in "ACGT") for n, p in enumerate(primers) if p for k, odds in enumerate(dna.pssm(p) if len(p) < 13 else [])}
    assert {x: v for x, v in found.items() if x[0] != 4}.keys() == wanted.keys()
    assert all(abs(a - b) < 1e-9 for x in wanted for a, b in zip(found[x], wanted[x]))
    long = df.where("n = 4").select(dna.pssm_column(F.col("p")).alias("m")).first()["m"]
    assert all(abs(a - b) < 1e-9 for k, odds in enumerate(long) for a, b in zip(found[4, k], odds))
    rounded = dna.pssm_rows(df.where("n = 0"), "p", digits=9)
    plan = rounded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("round(") > plan.index("Generate")  # below it: a rounding for a primer, not for each position


def test_pssm_rows_look_a_position_up_once(spark):
    """A symbol is found by one lookup, codes of a primer are counted in one pass; odd rows keep their scores."""
    primers = ["ACGTRYSWKMBDHVN", "NNRB", "U", "AuR-N", "R\u00e9A", "234A", "NNRB", "", None]
    df = spark.createDataFrame(list(enumerate(primers)), "n int, p string")
    rows = dna.pssm_rows(df, "p", digits=9)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and " IN (" not in plan and " INSET " not in plan
    bases = {**{b: b for b in "ACGT"}, **dna.IUPAC}
    wanted = {}
    for row, p in enumerate(primers):
        # A symbol outside the alphabet counts as a code of each size, and matches no base.
        number = math.prod(math.prod((2, 3, 4)) if c not in bases else len(bases[c]) for c in p or "")
        for k, c in enumerate(p or ""):
            own = bases.get(c, "")
            wanted[row, k] = tuple(math.log2(((number / len(own) if b in own else 0) + 0.1) / (number + 0.4) / 0.25) for b in "ACGT")
    found = {(r.n, r.k): (r.a, r.c, r.g, r.t) for r in rows.collect()}
    assert found.keys() == wanted.keys()
    assert all(abs(a - b) < 2e-9 for x in wanted for a, b in zip(found[x], wanted[x]))
