import gzip

import pytest

from ampliflow.operators.database import primer_table
from ampliflow.operators.mapper import ReadMapper
from ampliflow.sources.readers import pair_reads, read_fasta, read_fastq, read_taxonomy
from ampliflow.streaming.counts import count_stream, totals


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one >x y\nACGU\nAC\n>two\n\nGG")
    got = read_fasta(spark, str(tmp_path / "a.fa")).orderBy("seq_no").collect()
    assert [(r["seq_no"], r["id"], r["sequence"]) for r in got] == [(0, "one >x y", "ACGUAC"), (1, "two", "GG")]
    assert read_fasta(spark, str(tmp_path / "a.fa"), id_first_token=True, to_dna=True).orderBy("seq_no").first()["sequence"] == "ACGTAC"
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">z\nAC\n")
    assert read_fasta(spark, str(tmp_path / "b.fa.gz")).first()["id"] == "z"
    (tmp_path / "crlf.fa").write_bytes(b">z\r\nAC\r\n")
    assert read_fasta(spark, str(tmp_path / "crlf.fa")).first()["sequence"] == "AC\r"


def test_fastq_pairs(spark, tmp_path):
    (tmp_path / "r1.fq").write_text("@a\nACGT\n+\n@III\n@b\nGG\n+\nII\n@c\nT\n+\n")
    (tmp_path / "r2.fq").write_text("@a\nTTTT\n+\nIIII\n")
    r1 = read_fastq(spark, str(tmp_path / "r1.fq"))
    assert [(r["id"], r["sequence"], r["quality"]) for r in r1.orderBy("read_no").collect()] == [("@a", "ACGT", "@III"), ("@b", "GG", "II")]
    assert [tuple(r) for r in pair_reads(r1, read_fastq(spark, str(tmp_path / "r2.fq"))).collect()] == [(0, "@a", "ACGT", "TTTT")]


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tk\tx\nb\ty\na\tlast\n")
    assert sorted(map(tuple, read_taxonomy(spark, str(tmp_path / "t.tsv")).collect())) == [("a", "last"), ("b", "y")]
    (tmp_path / "bad.tsv").write_text("a b\n")
    with pytest.raises(Exception, match="no tab"):
        read_taxonomy(spark, str(tmp_path / "bad.tsv")).collect()


def test_stream_equals_batch(spark, tmp_path):
    reads = spark.createDataFrame([("ACCGTAAAGGCTGGG", "TTGACCTTGAGACCC")] * 5 + [("AACCGTAAAGGCTGG", "TTGACCTTGAGACCC")] * 2, "fwd string, bwd string")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    mapper = ReadMapper(None, primers=primer_table(spark, [("ACCGTA", "TTGACC")]), kmer_length=6)
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    count_stream(mapper, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    counted = totals(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert sorted(map(tuple, counted)) == sorted(map(tuple, mapper.read_counts(reads).collect())) and counted[0]["n"] == 7


def test_command_line(spark, tmp_path):
    from ampliflow import cli
    from tests.test_profile import READS, REFERENCES

    (tmp_path / "refs.fa").write_text("".join(f">b{n + 1}\n{s}\n" for n, s in enumerate(REFERENCES)))
    pairs = [(f, b) for n, f, b in READS for _ in range(n)]
    for k, name in enumerate(("r1", "r2")):
        (tmp_path / f"{name}.fq").write_text("".join(f"@{i}\n{p[k]}\n+\n{'I' * len(p[k])}\n" for i, p in enumerate(pairs)))
    (tmp_path / "tax.tsv").write_text("".join(f"b{n}\tk;{n}\n" for n in range(1, 7)))
    args = ["--references", f"{tmp_path}/refs.fa", "--database", f"{tmp_path}/db", "--primers", "ACCGTA,TTGACC", "CAGYTG,GGATTC", "--r1", f"{tmp_path}/r1.fq", "--r2", f"{tmp_path}/r2.fq", "--taxonomy", f"{tmp_path}/tax.tsv", "--k", "6", "--primer-mismatches", "0"]
    for run in ("a", "b"):  # the second one loads the database
        cli.main([*args, "--report", f"{tmp_path}/{run}"], spark)
        lines = [r["value"] for r in spark.read.text(f"{tmp_path}/{run}").collect()]
        assert lines[0].endswith("reads=19 mapped=14") and lines[2].split("\t")[:2] == ["b1", "k;1"]
        assert float(lines[2].split("\t")[3]) == pytest.approx(0.33147145329794314, rel=1e-6)
