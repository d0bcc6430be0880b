"""The toy community of FIXTURES.md, whose numbers were worked out by hand."""

import json
import math
import random

import pytest

from ampliflow.operators.database import ReferenceBuilder
from ampliflow.operators import estimate
from ampliflow.operators.estimate import Estimate
from ampliflow.operators.mapper import Mapping, ReadMapper
from ampliflow.functions.dna import mismatch_count
from ampliflow.operators.primers import best_hits_of
from ampliflow.operators.simjoin import hamming_join, scan_join
from ampliflow.operators.staging import dense_index
from ampliflow.sources import messagepack
from ampliflow.sources.readers import load_database
from ampliflow.sources.writers import database_json, report_lines, save_database, write_report

PRIMERS = [("ACCGTA", "TTGACC"), ("CAGYTG", "GGATTC")]
B1 = "TTTTACCGTAAAGGCTGGGTCTCAAGGTCAAAAAACAGCTGGATAGACCCCTTACTGAATCCTTTT"
REFERENCES = [
    B1, "TTTTACCGTAAAGGCTGGGTCTCAAGGTCAAAAAACAGCTGGATCGACCCCTTACTGAATCCTTTT", B1, "A" * 40,
    "TTTTACCGTAAAGGCTGGGTCTCAAGGTCAAAAAACAGCTGGATAGACCCCTRACTGAATCCTTTT", "TTTTACCGTANNNNCTGGGTCTCAAGGTCAAAAAACAGCTGGATAGACCCCTTACTGAATCCTTTT",
]
READS = [
    (5, "ACCGTAAAGGCTGGG", "TTGACCTTGAGACCC"), (4, "TCAGCTGGATAGACC", "GGATTCAGTAAGGG"), (3, "CAGTTGGATCGACCC", "GGATTCAGTAAGGGG"), (2, "CAGCTGGATAGACCC", "GGATTCAGTTAGGGG"),
    (1, "CAGCTGGATCGACCC", "GGATTCAGTCAGGGG"), (1, "CAGCTGGATNGACCC", "GGATTCAGTCAGGGG"), (1, "ACCGTAAAGG", "TTGACCTTGAGACCC"), (2, "ACCGTACCTTCTGGG", "TTGACCTTGAGACCC"),
]


@pytest.fixture(scope="module")
def db(spark):
    refs = spark.createDataFrame([(n, f"b{n + 1}", s) for n, s in enumerate(REFERENCES)], "seq_no long, id string, sequence string")
    return ReferenceBuilder(spark, PRIMERS, k=6, primer_mismatches=0).build(refs)


@pytest.fixture(scope="module")
def mapping(spark, db):
    reads = spark.createDataFrame([(f, b) for n, f, b in READS for _ in range(n)], "fwd string, bwd string")
    return ReadMapper(db, primer_mismatches=0).map(reads)


def values(df, column, key="j"):
    return [r[column] for r in df.orderBy(key).collect()]


def test_database(db):
    refs = db.refs.orderBy("j").collect()
    assert [r["name"] for r in refs] == ["b1", "b2", "b3", "", "b5"]
    assert [r["amplified"] for r in refs] == [4, 4, 4, 0, 6]
    kmers = {(s, r): [x["kmer"] for x in db.kmers.where(f"side = '{s}' AND region = {r}").orderBy("kmer_id").collect()] for s in ("fwd", "bwd") for r in (0, 1)}
    assert kmers == {("fwd", 0): ["AAGGCT"], ("bwd", 0): ["TTGAGA"], ("fwd", 1): ["GATAGA", "GATCGA"], ("bwd", 1): ["AGTAAG", "AGTCAG", "AGTTAG"]}
    assert [tuple(r) for r in db.pairs.where("region = 1").orderBy("h").select("fwd_id", "bwd_id").collect()] == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert sorted(tuple(r) for r in db.m.where("region = 1").select("h", "j", "x").collect()) == [(0, 0, 1.0), (0, 2, 1.0), (1, 4, 0.5), (2, 4, 0.5), (3, 1, 1.0)]
    assert [r["perfect"] for r in db.perfect.where("region = 0").orderBy("j").collect()] == [True, True, True, False, True]


def test_mapping(mapping):
    assert values(mapping.assigned, "n", "region") == [7, 10]
    assert values(mapping.mapped, "n", "region") == [5, 9]
    assert values(mapping.y, "y", "i") == pytest.approx([5 / 14, 4 / 14, 2 / 14, 3 / 14])
    assert mapping.q.count() == 16
    groups = mapping.groups.orderBy("j").collect()
    assert [r["g"] for r in groups] == [1, 2, 1, 0, 3]
    assert sorted({(r["g"], r["rep_j"]) for r in groups}) == [(0, 3), (1, 0), (2, 1), (3, 4)]


def test_estimate(mapping):
    e = Estimate.start(mapping)
    assert values(e.pi, "pi", "g") == pytest.approx([0, 0.4285484324787812, 0.38089679117175806, 0.1905547763494607], rel=1e-9)
    assert values(e.proportions(), "proportion") == pytest.approx([0.29998873173321455, 0.2666320458668913, 0.29998873173321455, 0, 0.13339049066667963], rel=1e-9)
    assert values(e.frequencies(), "frequency") == pytest.approx([0.31394795568404654, 0.27903910002262694, 0.31394795568404654, 0, 0.09306498860928002], rel=1e-9)
    assert values(e.mapped_by_reference(), "mapped") == [4, 4, 4, 0, 4]
    one = e.step()
    assert one.l1.first()["l1"] == pytest.approx(0.044061278042740286, rel=1e-9)
    assert one.step().l1.first()["l1"] == pytest.approx(0.017084477582579926, rel=1e-9)
    ten = e.refine(n=10, tol=0)
    assert ten.l1.first()["l1"] == pytest.approx(8.669366441530393e-06, rel=1e-6)
    assert values(ten.pi, "pi", "g") == pytest.approx([0, 0.4645234448852593, 0.3461003397129355, 0.18937621540180147], rel=1e-9)
    assert values(ten.frequencies(), "frequency") == pytest.approx([0.33147145329794314, 0.24696790625906048, 0.33147145329794314, 0, 0.09008918714505328], rel=1e-9)
    done = e.refine()
    assert done.l1.first()["l1"] < 5e-7
    assert math.isnan(e.refine(n=0).l1.first()["l1"])


def test_report(spark, mapping, tmp_path):
    lineages = spark.createDataFrame([("b1", "k;a"), ("b2", "k;b"), ("b3", "k;a"), ("b5", "k;c")], "id string, lineage string")
    report = Estimate.start(mapping).report(lineages, strict=True)
    assert [r["id"] for r in report.orderBy("j").collect()] == ["b1", "b2", "b3", "b5"]
    assert report_lines(report).first()["proportion"] == "2.999887317e-1"
    write_report(report, str(tmp_path / "report"), "a", "b", 19, 14)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert lines[0] == "#r1=a r2=b reads=19 mapped=14" and len(lines) == 6 and lines[2].startswith("b1\tk;a\t2.999887317e-1")
    with pytest.raises(Exception, match="no lineage"):
        Estimate.start(mapping).report(lineages.where("id <> 'b5'"), strict=True).collect()


@pytest.mark.parametrize("format", ["parquet", "json", "messagepack"])
def test_database_round_trip(spark, db, mapping, tmp_path, format):
    save_database(db, str(tmp_path / "db"), format)
    again = load_database(spark, str(tmp_path / "db"), format)
    assert again.k == 6
    for t in ("primers", "kmers", "pairs", "m", "perfect"):
        cols = sorted(getattr(db, t).columns)
        assert sorted(map(tuple, getattr(again, t).select(cols).collect())) == sorted(map(tuple, getattr(db, t).select(cols).collect())), t
    reads = spark.createDataFrame([(f, b) for n, f, b in READS for _ in range(n)], "fwd string, bwd string")
    assert sorted(map(tuple, ReadMapper(again, primer_mismatches=0).map(reads).q.collect())) == sorted(map(tuple, mapping.q.collect()))
    with pytest.raises(ValueError):
        load_database(spark, str(tmp_path / "db"), "xml")


def test_no_read_maps(spark, db):
    e = Estimate.start(ReadMapper(db, primer_mismatches=0).map(spark.createDataFrame([], "fwd string, bwd string")))
    assert e.frequencies().count() == 0


def test_samples_are_separate(spark, db):
    reads = spark.createDataFrame([(s, f, b) for s in ("x", "y") for n, f, b in READS for _ in range(n)], "sample string, fwd string, bwd string")
    pi = Estimate.start(ReadMapper(db, primer_mismatches=0).map(reads)).pi
    assert sorted(r["pi"] for r in pi.where("sample = 'x'").collect()) == pytest.approx(sorted(r["pi"] for r in pi.where("sample = 'y'").collect()))


@pytest.mark.parametrize("strategy", ["seed", "scan", "auto"])
def test_hamming_join_is_brute_force(spark, strategy):
    r = random.Random(5)
    base = ["".join(r.choice("ACGT") for _ in range(40)) for _ in range(60)]
    close = []
    for b in base:
        s = list(b)
        for k in r.sample(range(40), r.randrange(4)):
            s[k] = r.choice("ACGT")
        close.append("".join(s))
    queries = sorted(set(close + base[:20]) | ({base[3][:10] + "N" + base[3][11:]} if strategy != "seed" else set()))
    kmers = spark.createDataFrame([(0, n, b) for n, b in enumerate(base)], "region int, kmer_id long, kmer string")
    q = spark.createDataFrame([(0, s) for s in queries], "region int, q string")
    found = sorted((x["q"], x["kmer_id"], x["mm"]) for x in hamming_join(q, kmers, 2, 40, strategy).collect())
    want = sorted((s, n, d) for s in queries for n, b in enumerate(base) if (d := sum(x != y and x != "N" for x, y in zip(s, b))) <= 2)
    assert found == want


@pytest.mark.parametrize("limit", [1 << 20, 700])
def test_scan_of_partial_reads_and_many_mismatches(spark, limit):
    """Also where the k-mers exceed the limit and are dealt into parts: nothing is lost and nothing comes twice."""
    r = random.Random(9)
    base = ["".join(r.choice("ACGT") for _ in range(30)) for _ in range(50)]
    queries = sorted({b[: r.randrange(5, 31)] for b in base} | {"N" * 30, "ACGTN"})
    kmers = spark.createDataFrame([(n % 2, n, b) for n, b in enumerate(base)], "region int, kmer_id long, kmer string")
    q = spark.createDataFrame([(g, s) for s in queries for g in (0, 1, 5)], "region int, q string")
    got = sorted((x["region"], x["q"], x["kmer_id"], x["mm"]) for x in scan_join(q, kmers, 12, limit).collect())
    assert got == sorted((n % 2, s, n, d) for s in queries for n, b in enumerate(base) if (d := sum(x != y and x != "N" for x, y in zip(s, b))) <= 12)
    assert scan_join(q, kmers.where("kmer_id < 0"), 12, limit).collect() == []


def test_messagepack():
    """Values of the format's specification, and every length and number form."""
    for value, data in ((None, "c0"), (True, "c3"), (5, "05"), (-1, "ff"), (-33, "d0df"), (200, "ccc8"), (1 << 40, "cf0000010000000000"), (0.5, "cb3fe0000000000000"), ("a", "a161"), ([1, "b"], "9201a162"), ({"a": 1}, "81a16101"), (b"x", "c40178")):
        assert messagepack.packed(value).hex() == data and messagepack.unpacked(bytes.fromhex(data)) == value
    for value in ([0] * 70_000, "x" * 70_000, {str(k): k for k in range(20)}, [-(1 << 63), (1 << 64) - 1, -129, 65536, -40_000], b"y" * 300, 1.25):
        assert messagepack.unpacked(messagepack.packed(value)) == value
    with pytest.raises(EOFError):
        messagepack.unpacked(b"\x92\x01")
    with pytest.raises(ValueError):
        messagepack.unpacked(b"\x01\x01")
    named = {"k": 6, "regions": [{"primer": ["A", "C"], "unique_pairs": [], "unique_kmers": [[], []], "matrix": {"cols": 1, "data": [], "col_index": [], "row_index": [0]}, "perfect_match": [True]}], "names": ["b"], "amplified": b"\x02"}
    doc = json.loads(messagepack.to_json(messagepack.packed(named)))
    assert doc["amplified"] == [2] and doc["regions"][0]["perfect_match"] == [1] and json.loads(messagepack.to_json(messagepack.from_json(json.dumps(doc)))) == doc
    with pytest.raises(ValueError, match="names"):
        messagepack.to_json(messagepack.packed({"k": 6, "regions": [], "amplified": []}))


def test_messagepack_streams(spark, db, tmp_path, monkeypatch):
    """The document is that of the JSON form; no task holds it, neither when it is written nor when it is read, whatever the form of its structures."""
    for name in ("from_json", "unpacked", "to_json"):
        monkeypatch.setattr(messagepack, name, None)
    monkeypatch.setattr(messagepack, "PIECE", 16)
    path = str(tmp_path / "streamed")
    save_database(db, path, "messagepack")
    again = load_database(spark, path, "messagepack")
    assert sorted(map(tuple, again.m.collect())) == sorted(map(tuple, db.m.select(again.m.columns).collect()))
    monkeypatch.undo()
    doc = json.loads(messagepack.to_json(open(path, "rb").read()))
    assert doc == json.loads(database_json(db).first()["value"])
    named = tmp_path / "named"
    doc["amplified"] = bytes(doc["amplified"])
    named.write_bytes(messagepack.packed(doc | {"other": [1, {"a": "b"}]}))
    of_names = load_database(spark, str(named), "messagepack")
    for t in ("m", "kmers", "pairs", "perfect", "refs"):
        assert sorted(map(tuple, getattr(of_names, t).collect())) == sorted(map(tuple, getattr(again, t).collect())), t
    with pytest.raises(FileExistsError):
        save_database(db, path, "messagepack")


def test_arrays(mapping):
    got = Estimate.start(mapping).arrays()
    assert list(got["mapped"]) == [4, 4, 4, 0, 4] and got["frequency"].sum() == pytest.approx(1)
    assert list(got["assigned_by_region"]) == [7, 10] and list(got["mapped_by_region"]) == [5, 9]


def random_mapping(spark, db, seed, rows, groups, samples=("a", "b")):
    """A mapping of made-up entries; each sample has its own."""
    r = random.Random(seed)
    q, y, g = [], [], []
    for s in samples:
        q += [(s, i, j, r.random()) for i in range(rows) for j in r.sample(range(groups), r.randrange(1, 6))]
        y += [(s, i, 0, 1, 1.0 / rows) for i in range(rows)]
        g += [(s, j, j, j) for j in range(groups)]
    none = spark.createDataFrame([], "sample string, region int, n long")
    return Mapping(db, spark.createDataFrame(q, "sample string, i long, j long, x double"), spark.createDataFrame(y, "sample string, i long, region int, n long, y double"), spark.createDataFrame(g, "sample string, j long, g long, rep_j long"), none, none)


def test_steps_converge_as_the_kernel_does(spark, db, monkeypatch):
    """Both ways stop each sample at the same step; bucketed or not, a step is the same."""
    start = Estimate.start(random_mapping(spark, db, 1, 40, 12))
    by_kernel = start.refine(n=60, tol=2e-3)
    monkeypatch.setattr(estimate, "KERNEL_ENTRIES", 0)
    by_steps = start.refine(n=60, tol=2e-3)
    shares = [{(r["sample"], r["g"]): r["pi"] for r in e.pi.collect()} for e in (by_kernel, by_steps)]
    assert shares[0].keys() == shares[1].keys() and len(shares[0]) == 24
    assert all(shares[0][k] == pytest.approx(shares[1][k], abs=1e-14) for k in shares[0])
    changes = [{r["sample"]: r["l1"] for r in e.l1.collect()} for e in (by_kernel, by_steps)]
    assert changes[0] == pytest.approx(changes[1], rel=1e-9) and all(x < 2e-3 for x in changes[0].values())
    plain, cut = start.step(), start.bucketed(3).step()
    assert sorted(r["pi"] for r in plain.pi.collect()) == pytest.approx(sorted(r["pi"] for r in cut.pi.collect()), abs=1e-15)


def test_a_step_does_not_shuffle_entries(spark, db):
    """Between the bucketed entries and their joins there is no exchange; shares and sums are what moves."""
    start = Estimate.start(random_mapping(spark, db, 2, 30, 10)).bucketed(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = start._update()._jdf.queryExecution().sparkPlan()
        prepared = start._update()._jdf.queryExecution().executedPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan is not None
    scans = [k for k, line in enumerate(prepared) if "qg_by_" in line and "Scan" in line]
    assert len(scans) == 2
    for k in scans:
        depth = prepared[k].index("Scan")
        above = []
        for line in reversed(prepared[:k]):  # the operators that the scan feeds, up to its join
            at = next((i for i, c in enumerate(line) if c.isalpha()), len(line))
            if at < depth:
                above.append(line)
                depth = at
                if "Join" in line:
                    break
        assert any("Join" in line for line in above) and not any("Exchange" in line for line in above)


def test_best_hits_are_brute_force():
    r = random.Random(3)
    sequences = ["".join(r.choice("ACGTRN") for _ in range(r.choice([0, 3, 17, 60, 900]))) for _ in range(80)]
    primers = ["ACG", "GTGYCAGCMGCC", "A" * 40]
    mm, pos = best_hits_of(sequences, primers)
    for n, s in enumerate(sequences):
        for k, p in enumerate(primers):
            want = min(((mismatch_count(p, s[a : a + len(p)]), a) for a in range(len(s) - len(p) + 1)), default=(-1, -1))
            assert (mm[n, k], pos[n, k]) == want


def test_dense_index(spark):
    df = spark.createDataFrame([(k % 3, f"v{(k * 7) % 50:02d}") for k in range(50)], "g int, v string")
    got = [(r["v"], r["n"]) for r in dense_index(df, ["v"], "n").collect()]
    assert sorted(got) == [(f"v{k:02d}", k) for k in range(50)]
    by = dense_index(df, ["v"], "n", by="g").collect()
    for g in range(3):
        own = sorted((r["v"], r["n"]) for r in by if r["g"] == g)
        assert [n for _, n in own] == list(range(len(own)))


def test_reads_are_made_by_reference(spark):
    """The reverse complement of a reference is made once, below the join with the line items, and U is replaced without a table of symbols."""
    from pyspark.sql import functions as F

    from ampliflow.functions import dna
    from ampliflow.plans import fixture as fx

    rows = fx.read_rows(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "reverse(" not in plan
    assert rows.where("length(fwd) < 187 OR length(bwd) < 190").count() == 0
    spelled = spark.createDataFrame([("ACUGU",), ("ACG",), (None,)], "s string").select(dna.as_dna(F.col("s")).alias("s"))
    assert [r["s"] for r in spelled.collect()] == ["ACTGT", "ACG", None]
    assert "translate" not in spelled._jdf.queryExecution().optimizedPlan().toString()


def test_fitting_regions(spark):
    """Primers of several regions that fit the same read are listed in order; a read that fits none has an empty list, and so have nulls."""
    from ampliflow.operators.primers import edge_regions

    reads = spark.createDataFrame([("AACCGTAGGGGGGGGGG", "TTGACCGGGGGGGGG"), ("GGGGGGGGGGGGGGGG", "TTGACCGGGGGGGGG"), (None, "TTGACC")], "f string, b string")
    found = reads.select(edge_regions([("ACCGTA", "TTGACC"), ("GGATTC", "CAGTTG"), ("CCGTA", "TGACC")], 0)("f", "b").alias("r"))
    assert [[tuple(h) for h in x["r"]] for x in found.collect()] == [[(0, 7, 6), (2, 7, 6)], [], []]
    assert "fwd_end" in found.schema.simpleString() and found.select("r").where("size(r) = 2").count() == 1
