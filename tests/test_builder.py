"""Adding references to a database, invalid sequences, expansions as a stream, scores of primers."""

import json
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampliflow.functions import dna
from ampliflow.operators import database
from ampliflow.operators.database import Database, ReferenceBuilder
from ampliflow.operators.mapper import ReadMapper
from ampliflow.operators.staging import stage
from ampliflow.sources.readers import load_database
from ampliflow.sources.writers import save_database
from tests.test_profile import PRIMERS, REFERENCES

SCHEMA = "seq_no long, id string, sequence string"


def references(spark, picks):
    return spark.createDataFrame([(n, f"b{n + 1}", REFERENCES[n]) for n in picks], SCHEMA)


def tables(db):
    return {t: sorted(tuple(r) for r in getattr(db, t).select(*sorted(getattr(db, t).columns)).collect()) for t in Database.TABLES}


@pytest.fixture(scope="module")
def whole(spark):
    return tables(ReferenceBuilder(spark, PRIMERS, k=6, primer_mismatches=0).build(references(spark, range(6))))


@pytest.mark.parametrize("cut", [0, 1, 4, 6])
def test_build_and_add_is_build(spark, whole, cut):
    builder = ReferenceBuilder(spark, PRIMERS, k=6, primer_mismatches=0)
    first = builder.build(references(spark, range(cut)) if cut else references(spark, range(1)).where("seq_no < 0"))
    assert tables(builder.add(first, references(spark, range(cut, 6)) if cut < 6 else references(spark, range(1)).where("seq_no < 0"))) == whole


def test_build_reads_its_tables_once(spark, monkeypatch):
    """Each step reads a table that was written before it once; odd rows and rows that come twice are counted as often as they are there."""
    seen = {}
    monkeypatch.setattr(database, "stage", lambda df, name: seen.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or stage(df, name))
    sequences = [*REFERENCES, REFERENCES[4], None, "", "NNNN" + REFERENCES[0], REFERENCES[0].replace("T", "U")]
    rows = [(n // 2, None if n == 2 else f"b{n}", s) for n, s in enumerate(sequences)]  # numbers and references repeat, a name is null
    db = ReferenceBuilder(spark, PRIMERS, k=6, primer_mismatches=0).build(spark.createDataFrame(rows, "seq_no long, id string, sequence string"))
    # A numbered table is read with the sizes of its parts.
    reads = {name: plan.count("Relation [") for name, plan in seen.items()}
    assert {k: reads[k] for k in ("encoded", "m", "refs", "perfect")} == {"encoded": 2, "m": 2, "refs": 3, "perfect": 3}
    assert seen["encoded"].count("Join") == 1 and "RepartitionByExpression [j#" in seen["encoded"]  # with the sizes; the ends meet without one
    kmers = {(r["region"], r["side"], r["kmer"]): r["kmer_id"] for r in db.kmers.collect()}
    sketches = [r.asDict() for r in db.sketches.collect()]
    coded = {(r["region"], r["j"], kmers[r["region"], "fwd", r["fwd_kmer"]], kmers[r["region"], "bwd", r["bwd_kmer"]]) for r in sketches}
    pairs = {(r["region"], r["fwd_id"], r["bwd_id"]): r["h"] for r in db.pairs.collect()}
    assert set(pairs) == {(region, fwd, bwd) for region, _, fwd, bwd in coded}
    want = sorted((region, pairs[region, fwd, bwd], j, 1 / sum(c[:2] == (region, j) for c in coded)) for region, j, fwd, bwd in coded)
    assert sorted((r["region"], r["h"], r["j"], r["x"]) for r in db.m.collect()) == want
    amplified = {r["j"]: r["amplified"] for r in db.refs.collect()}
    assert amplified == {j: sum(r["j"] == j for r in sketches) + sum(c[1] == j for c in coded) for j in amplified} and len(amplified) == 8


def test_add_one_after_another(spark, whole):
    builder = ReferenceBuilder(spark, PRIMERS, k=6, primer_mismatches=0)
    db = builder.build(references(spark, [0]))
    for some in ([1], [2, 3], [4, 5]):
        db = builder.add(db, references(spark, some))
    assert tables(db) == whole


def test_add_to_a_loaded_database(spark, whole, tmp_path):
    builder = ReferenceBuilder(spark, PRIMERS, k=6, primer_mismatches=0)
    save_database(builder.build(references(spark, range(3))), str(tmp_path / "db"))
    db = builder.add(load_database(spark, str(tmp_path / "db")), references(spark, range(3, 6)))
    assert tables(db) == whole
    with pytest.raises(ValueError, match="another k"):
        ReferenceBuilder(spark, PRIMERS, k=7).add(db, references(spark, [0]))
    with pytest.raises(ValueError, match="other primers"):
        ReferenceBuilder(spark, PRIMERS[:1], k=6).add(db, references(spark, [0]))


def test_invalid_references(spark):
    given = spark.createDataFrame([(0, "good", REFERENCES[0]), (1, "bad", "ACXT"), (2, "none", None), (3, "also good", REFERENCES[1]), (4, "space", " ACGT")], SCHEMA)
    builder = ReferenceBuilder(spark, PRIMERS, k=6, primer_mismatches=0)
    with pytest.raises(dna.InvalidDna, match="invalid DNA: ACXT|invalid DNA: *ACGT"):
        builder.build(given)
    lenient = ReferenceBuilder(spark, PRIMERS, k=6, primer_mismatches=0, invalid="reject")
    assert [r["name"] for r in lenient.build(given).refs.orderBy("j").collect()] == ["good", "also good"]
    rejected = lenient.rejected(given).orderBy("seq_no").collect()
    assert [(r["id"], r["column"], r["place"], r["symbol"], r["reason"]) for r in rejected] == [("bad", "sequence", 2, "X", "invalid symbol"), ("none", "sequence", None, None, "no sequence"), ("space", "sequence", 0, " ", "invalid symbol")]


def test_invalid_reads(spark):
    db = ReferenceBuilder(spark, PRIMERS, k=6, primer_mismatches=0).build(references(spark, range(3)))
    reads = spark.createDataFrame([("r1", "ACCGTAAAGGCTGGG", "TTGACCTTGAGACCC"), ("r2", "ACCGTAAAGGCTGGG", "TTGACC?TGAGACCC"), ("r3", "é", "ACGT")], "id string, fwd string, bwd string")
    with pytest.raises(dna.InvalidDna):
        ReadMapper(db, primer_mismatches=0).map(reads)
    lenient = ReadMapper(db, primer_mismatches=0, invalid="reject")
    assert lenient.read_counts(reads).collect()[0]["n"] == 1
    assert sorted((r["id"], r["column"], r["place"], r["symbol"]) for r in lenient.rejected(reads).collect()) == [("r2", "bwd", 6, "?"), ("r3", "fwd", 0, "é")]
    with pytest.raises(dna.InvalidDna):
        stage(reads.select(dna.validated(F.col("bwd"))), "checked")


def test_other_errors(spark):
    with pytest.raises(dna.InvalidKmerLength):
        ReferenceBuilder(spark, PRIMERS, k=0)
    with pytest.raises(dna.InvalidKmerLength):
        ReadMapper(None, primers=spark.createDataFrame([(0, "A", "C")], "region int, fwd string, bwd string"), kmer_length=-1)
    with pytest.raises(ValueError, match="reject"):
        ReferenceBuilder(spark, PRIMERS, invalid="ignore")
    with pytest.raises(dna.InvalidDimensions):
        dna.mismatch_count("ACG", "AC", strict=True)
    with pytest.raises(ZeroDivisionError), dna.typed_errors():
        1 / 0  # others pass as they are


def test_primers_of_a_document_are_checked(spark, tmp_path):
    db = ReferenceBuilder(spark, PRIMERS, k=6, primer_mismatches=0).build(references(spark, range(3)))
    save_database(db, str(tmp_path / "db"), "json")
    assert tables(load_database(spark, str(tmp_path / "db"), "json"))["primers"] == tables(db)["primers"]
    doc = json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "db")).collect()))
    for bad, error in ((["ACXT", "ACG"], dna.InvalidDna), (["ACG"], ValueError)):
        doc["regions"][0]["primer"] = bad
        (tmp_path / "bad.json").write_text(json.dumps(doc))
        with pytest.raises(error):
            load_database(spark, str(tmp_path / "bad.json"), "json")


def test_expansions_stream(spark):
    rows = [(0, "ACGT"), (1, "RAY"), (2, ""), (3, None), (4, "NBDHV"), (5, "N" * 7)]
    df = spark.createDataFrame(rows, "k int, s string")
    got = {}
    for r in dna.expanded(df, "s", "v").collect():
        got.setdefault(r["k"], []).append(r["v"])
    table = {**{b: b for b in "ACGT"}, **dna.IUPAC}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted("".join(p) for p in product(*(table[c] for c in s))) for k, s in rows if s is not None}
    assert got[1] == dna.expansions("RAY") and len(got[5]) == 4**7
    dna.register(spark)
    df.createOrReplaceTempView("coded")
    assert spark.sql("SELECT k, variant FROM coded, LATERAL dna_expansions(s) WHERE k = 1").count() == 4


def test_expansions_come_in_bounded_pieces(spark, monkeypatch):
    """Expansions of many short sequences are made together, those of one that has very many in pieces, and texts are cut in one pass."""
    import pyarrow as pa

    from ampliflow.plans import registry

    texts = ["RAY", None, "", "N" * 9, "ACGT", "é-R", "BDHV" * 2, "NACGTNRYKM", "S", None]
    batch = pa.RecordBatch.from_pydict({"s": pa.array(["skipped", *texts])}).slice(1)
    for most, size in ((dna.EXPANSIONS, dna.EXPANDED_BYTES), (1000, 1 << 20), (7, 50)):
        monkeypatch.setattr(dna, "EXPANSIONS", most)
        monkeypatch.setattr(dna, "EXPANDED_BYTES", size)
        pieces = [(rows.tolist(), found.to_pylist()) for rows, found in dna.expanded_rows(batch, "s")]
        assert [v for _, found in pieces for v in found] == [v for t in texts if t is not None for v in dna.expansions(t)]
        assert [r for rows, _ in pieces for r in rows] == [k for k, t in enumerate(texts) if t is not None for _ in dna.expansions(t)]
        assert max(len(found) for _, found in pieces) <= 2 * most
    assert len(list(dna.expanded_rows(batch.slice(1, 1), "s"))) == 0
    codes = spark.createDataFrame([("ACGT",), ("RYK",), ("RYKM",), ("RXA",), ("",), (None,), ("ANCNGNTU",)], "s string")
    assert [r["ok"] for r in codes.select(dna.at_most_ambiguous(F.col("s"), 3).alias("ok")).collect()] == [True, True, False, False, True, None, True]
    plan = registry.QUERIES["disambiguate_stream"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "PythonUDTF" not in plan and "substring" not in plan


def test_position_scores(spark):
    primers = ["GTGYCAGCMGCCGCGGTAA", "ACG", "SRN"]
    df = spark.createDataFrame([(p,) for p in primers], "p string").select("p", dna.pssm_column(F.col("p")).alias("m"))
    for r in df.collect():
        want = [[x[b] for b in "ACGT"] for x in dna.pssm(r["p"])]
        assert np.allclose(r["m"], want, rtol=1e-12)


def test_best_scores(spark):
    rng = random.Random(2)
    sequences = ["".join(rng.choice("ACGTN") for _ in range(rng.choice((0, 2, 18, 19, 60, 400)))) for _ in range(40)] + [None]
    primers = ["GTGYCAGCMGCCGCGGTAA", "ACG"]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sequences)], "k int, s string").repartition(3)
    for r in df.select("s", dna.best_scores(primers)("s").alias("h")).collect():
        s = r["s"] or ""
        for p, hit in zip(primers, r["h"]):
            odds = dna.pssm(p)
            scores = [sum(o.get(c, 0.0) for o, c in zip(odds, s[a:])) for a in range(len(s) - len(p) + 1)]
            if not scores:
                assert hit is None
                continue
            best = max(round(x, 9) for x in scores)
            assert hit["score"] == pytest.approx(best, abs=2e-9) and scores[hit["pos"]] == pytest.approx(best, abs=2e-9)


def test_intermediate_tables_are_removed(spark, monkeypatch):
    import os

    from ampliflow.operators import staging

    monkeypatch.setattr(staging, "_STAGED", {})  # those of other tests stay
    kept = stage(spark.range(5), "some")
    cut = staging.bucketed(spark.range(5).withColumnRenamed("id", "k"), ["k"], 2, "cut")
    assert kept.count() == cut.count() == 5
    paths = [p for p in staging._STAGED[spark.sparkContext.applicationId] if not p.startswith("table:")]
    assert len(paths) == 2 and all(os.path.isdir(p) for p in paths)
    assert staging.release(spark) == 3 and not any(os.path.exists(p) for p in paths) and staging.release(spark) == 0
