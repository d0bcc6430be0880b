"""FASTA and FASTQ in byte ranges: whatever the ranges, the records are those of the whole file."""

import bz2
import gzip
import random

import pytest

from ampliflow.sources import sequences
from ampliflow.sources.readers import pair_reads, read_fasta, read_fastq, read_pairs
from ampliflow.sources.sequences import Split, fasta_batches, fastq_batches, listed, splits_of


def fastq_text(seed, n, end="\n", tail=""):
    """Records whose quality lines often begin with @ or +, as those of good reads do."""
    r = random.Random(seed)
    out, want = [], []
    for k in range(n):
        size = r.randrange(0, 30)
        seq, quality = "".join(r.choice("ACGTN") for _ in range(size)), "".join(r.choice("@+I>5") for _ in range(size))
        head, plus = f"@read {k} @x", r.choice(("+", f"+read {k}"))
        out += [head, seq, plus, quality]
        want.append(tuple(x + end[:-1] for x in (head, seq, plus, quality)))
    return (end.join(out) + end + tail).encode(), want


def fasta_text(seed, n, end="\n"):
    r = random.Random(seed)
    out, want = [], []
    for k in range(n):
        head = f"s{k} " + r.choice((">x", "y z", ""))
        lines = ["".join(r.choice("ACGU") for _ in range(r.randrange(0, 20))) for _ in range(r.randrange(0, 4))]
        out += [">" * r.randrange(1, 3) + head, *lines]
        want.append((head.rstrip(), "".join(x + end[:-1] for x in lines)))
    return (end.join(out) + end).encode(), want


def records(batches, names):
    return [tuple(r[n] for n in names) for b in batches for r in b.to_pylist()]


@pytest.mark.parametrize("size", [1, 2, 7, 33, 100, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_any_ranges(tmp_path, monkeypatch, size, end):
    monkeypatch.setattr(sequences, "_BLOCK", 13)
    monkeypatch.setattr(sequences, "_RECORDS", 3)
    for seed in range(3):
        data, want = fastq_text(seed, 25, end, tail=random.Random(seed).choice(("", "@cut" + end, "@cut" + end + "ACGT" + end + "+" + end, end)))
        (tmp_path / "a.fq").write_bytes(data)
        got = [r for s in splits_of(listed(str(tmp_path / "a.fq")), size) for r in records(fastq_batches(s), ("id", "sequence", "strand", "quality"))]
        assert got == want
        data, want = fasta_text(seed, 25, end)
        (tmp_path / "a.fa").write_bytes(data)
        got = [r for s in splits_of(listed(str(tmp_path / "a.fa")), size) for r in records(fasta_batches(s), ("id", "sequence"))]
        assert got == want


def test_ends(tmp_path):
    """No line end at the end, no header sign, empty files, lines longer than any block."""
    for data, want in ((b"@a\nAC\n+\nII", [("@a", "AC")]), (b"", []), (b"@a\nAC\n+", []), (b"@a\n\n+\n\n", [("@a", "")]), (b"@a\n" + b"A" * 300_000 + b"\n+\n" + b"@" * 300_000, [("@a", "A" * 300_000)])):
        (tmp_path / "a.fq").write_bytes(data)
        for size in (50_000, 1 << 20):
            assert [r for s in splits_of(listed(str(tmp_path / "a.fq")), size) for r in records(fastq_batches(s), ("id", "sequence"))] == want
    (tmp_path / "b.fa").write_bytes(b"no sign\nAC\nGT\n>b\nA")
    assert records(fasta_batches(Split(str(tmp_path / "b.fa"), 0, 19)), ("id", "sequence")) == [("no sign", "ACGT"), ("b", "A")]


def test_pairing_equals_zip(spark, tmp_path):
    one, a = fastq_text(1, 400)
    two, b = fastq_text(2, 390, tail="@cut\nA\n")
    (tmp_path / "r1.fq").write_bytes(one)
    (tmp_path / "r2.fq").write_bytes(two)
    r1, r2 = read_fastq(spark, str(tmp_path / "r1.fq"), split_bytes=997), read_fastq(spark, str(tmp_path / "r2.fq"), split_bytes=1501)
    assert spark.read.format("fastq").option("path", str(tmp_path / "r1.fq")).option("splitBytes", 997).load().rdd.getNumPartitions() >= 15
    got = sorted(map(tuple, pair_reads(r1, r2).collect()))
    assert got == [(k, x[0], x[1], y[1]) for k, (x, y) in enumerate(zip(a, b))]


def test_several_files_and_compression(spark, tmp_path):
    """Numbers run on over the files of a folder by name; compressed ones are one split."""
    texts = [fasta_text(k, 30) for k in range(4)]
    (tmp_path / "a.fa").write_bytes(texts[0][0])
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(texts[1][0]))
    (tmp_path / "c.fa.bz2").write_bytes(bz2.compress(texts[2][0]))
    (tmp_path / "d.fa").write_bytes(texts[3][0])
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = read_fasta(spark, str(tmp_path), split_bytes=200).orderBy("seq_no").collect()
    want = [r for _, records in texts for r in records]
    assert [(r["seq_no"], r["id"], r["sequence"]) for r in got] == [(k, *r) for k, r in enumerate(want)]
    (tmp_path / "sub").mkdir()
    assert read_fasta(spark, str(tmp_path / "sub")).collect() == []
    with pytest.raises(FileNotFoundError):
        read_fasta(spark, str(tmp_path / "nowhere"))


def test_carriage_returns(spark, tmp_path):
    data, want = fastq_text(5, 20, "\r\n")
    (tmp_path / "a.fq").write_bytes(data)
    rows = read_fastq(spark, str(tmp_path / "a.fq"), strip_cr=True, split_bytes=100).orderBy("read_no").collect()
    assert [tuple(r)[1:] for r in rows] == [tuple(x[:-1] for x in r) for r in want]


def test_stream_of_files(spark, tmp_path):
    sequences.register(spark)
    (tmp_path / "in").mkdir()
    want = []

    def add(k):
        data, records = fastq_text(k, 40)
        (tmp_path / "in" / f"{k}.fq").write_bytes(data)
        want.extend(records)
        stream = spark.readStream.format("fastq").option("path", str(tmp_path / "in")).option("splitBytes", 300).load()
        query = stream.select("id", "sequence", "strand", "quality").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        query.awaitTermination()

    for k in range(3):  # each run reads the new file only
        add(k)
        assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(want)


def test_pairs_are_not_written_plain(spark, monkeypatch):
    """Mates that are written to be read again are compressed, and forward ones go without the backward ones; the pairs are those of the rows."""
    from pathlib import Path

    from ampliflow.operators.staging import shared_folder
    from ampliflow.plans import fixture as fx
    from ampliflow.plans import registry

    rows = [(o, n, 7, f"{'ACGT' * 40}{m}", f"{'TTGA' * 40}{b}") for o, n, m, b in ((2, 1, "A", "C"), (1, 2, "C", "A"), (1, 1, "G", "G"), (1, 1, "A", "T"), (1, 1, "A", "A"))]
    monkeypatch.setattr(fx, "read_rows", lambda *_: spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_suppkey long, fwd string, bwd string"))
    before = set(Path(shared_folder(spark)).glob("fastq-*-?wd"))
    found = [tuple(r) for r in registry.fastq_pairs(spark, "").orderBy("read_no").collect()]
    ordered = sorted((o, n, f, b) for o, n, _, f, b in rows)
    assert found == [(k, f"@{o}/{n}", f, b) for k, (o, n, f, b) in enumerate(ordered)]
    made = [p for folder in set(Path(shared_folder(spark)).glob("fastq-*-?wd")) - before for p in folder.glob("part-*")]
    assert made and all(p.suffix == ".gz" for p in made)


def test_pairs_are_read_side_by_side(spark, tmp_path, monkeypatch):
    """Splits with their mates, however they are cut, give what joining the reads gives, and shuffle none; unlike cuts are joined."""
    from ampliflow.sources import readers

    texts, want = zip(*(fastq_text(seed, n) for seed, n in ((1, 300), (2, 7), (3, 200), (4, 150), (5, 330))))
    for name, numbers in (("r1", (0, 1, 2)), ("r2", (3, 4))):
        (tmp_path / name).mkdir()
        for n in numbers:
            (tmp_path / name / f"part-{n}.fq.gz").write_bytes(gzip.compress(texts[n]))
            (tmp_path / f"{name}.fq").write_bytes(b"".join(texts[k] for k in numbers))
    one, two = [x for n in (0, 1, 2) for x in want[n]], [x for n in (3, 4) for x in want[n]]
    pairs = [(k, x[0], x[1], y[1]) for k, (x, y) in enumerate(zip(one, two))]
    for r1, r2 in (("r1", "r2"), ("r1", "r2.fq"), ("r1.fq", "r2"), ("r1.fq", "r2.fq")):
        found = read_pairs(spark, str(tmp_path / r1), str(tmp_path / r2), split_bytes=997)
        assert sorted(map(tuple, found.collect())) == pairs
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(sequences, "_RECORDS", 7)
    assert sorted(map(tuple, read_pairs(spark, str(tmp_path / "r2"), str(tmp_path / "r1")).collect())) == [(k, y[0], y[1], x[1]) for k, (x, y) in enumerate(zip(one, two))]
    monkeypatch.setattr(readers, "READ_AGAIN", 0)
    joined = read_pairs(spark, str(tmp_path / "r1"), str(tmp_path / "r2"))
    assert sorted(map(tuple, joined.collect())) == pairs and "Join" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_bases_are_packed(spark):
    from pyspark.errors import PythonException
    from pyspark.sql import functions as F

    from ampliflow.functions import dna

    texts = ["", "A", "AC", "AAA", "TTTT", "ACGTA", "C" * 170, "GATTACA" * 30, None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, s string").select("k", dna.packed("s").alias("p"))
    found = rows.select("k", F.length("p").alias("n"), dna.unpacked("p").alias("s")).orderBy("k").collect()
    assert [r["s"] for r in found] == texts and [r["n"] for r in found] == [None if t is None else len(t) // 4 + 1 for t in texts]
    with pytest.raises(PythonException, match="invalid DNA: AXN"):
        spark.createDataFrame([("AXN",)], "s string").select(dna.packed("s")).collect()
