"""Files cut anywhere: every record once, whole, and bad ones told."""

import bz2
import gzip
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom.sources import files, records


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def cut(data, mark, size, read):
    """All ranges of a file, each by itself, read in pieces of a size."""
    out = []
    for start in range(0, len(data), size):
        rest = data[max(0, start - 1) :]
        out += records.spans((rest[i : i + read] for i in range(0, len(rest), read)), mark, start, min(start + size, len(data)))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from([b">", b"\n", b"a", b">x\nAC\n", b"LOCUS", b"\n\n", b" "]), max_size=25), st.integers(1, 12), st.integers(1, 9), st.sampled_from([b">", b"LOCUS"]))
def test_every_record_once(parts, size, read, mark):
    data = b"".join(parts)
    starts = [m.end() - len(mark) for m in re.finditer(rb"(?m)^" + re.escape(mark), data)]
    want = [(a, data[a:z]) for a, z in zip(starts, [*starts[1:], len(data)], strict=False)]
    first = data[: starts[0]] if starts else data
    assert cut(data, mark, size, read) == ([(0, first)] if first.strip() else []) + want


FASTA = ">A1.1:5-9 one\nAC\nGT\n\n>B2|x > y\r\nTT\r\nT\r\n>\nACG\n>empty\n>C3\n" + "ACGT" * 500 + "\n>D4\nA>C"


@pytest.mark.parametrize("split", [3, 64, 1000, 1 << 20])
def test_fasta(spark, tmp_path, split):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fasta").write_text("; a remark\n" + FASTA, newline="")
    (tmp_path / "in/b.fasta.gz").write_bytes(gzip.compress(FASTA.encode()))
    (tmp_path / "in/c.fa.bz2").write_bytes(bz2.compress(b">Z\nAA\n"))
    (tmp_path / "in/_SUCCESS").write_text("")
    (tmp_path / "in/bad.fa").write_bytes(b">\xff\nAA\n>E5\nGG")
    got = records.fasta_records(spark, str(tmp_path / "in"), split)
    good, bad = files.split_rejects(got)
    one = [("A1.1:5-9 one", "ACGT"), ("B2|x > y", "TTT"), ("C3", "ACGT" * 500), ("D4", "A>C")]
    want = [("a.fasta", *x) for x in one] + [("b.fasta.gz", *x) for x in one] + [("c.fa.bz2", "Z", "AA"), ("bad.fa", "E5", "GG")]
    assert sorted((r.file, r.header, r.seq) for r in good.collect()) == sorted(want)
    assert sorted((r.file, r.reject_reason) for r in bad.collect()) == sorted([("a.fasta", "stray"), ("bad.fa", "encoding")] + [(f, x) for f in ("a.fasta", "b.fasta.gz") for x in ("header", "sequence")])
    assert records.records(spark, str(tmp_path / "in/a.fasta"), "fasta", split).rdd.getNumPartitions() == -(-len("; a remark\n" + FASTA) // split)


GENBANK = """LOCUS       X{n}   12 bp    DNA     circular PLN 05-MAR-2020
ACCESSION   X{n}
KEYWORDS    .
  ORGANISM  Rosa alba{n}
REFERENCE   1
  JOURNAL   Plant J. {n}
FEATURES             Location/Qualifiers
     CDS             complement(join(1..3,7..9))
                     /gene="rbcL"
ORIGIN
        1 acgtacgtac gt
//
"""


@pytest.mark.parametrize("split", [50, 400, 1 << 20])
def test_genbank(spark, tmp_path, split):
    text = "".join(GENBANK.format(n=n) for n in range(7))
    (tmp_path / "x.gb").write_text(text + "LOCUS       Y1  no accession\nORIGIN\n        1 ac\n//\n" + GENBANK.format(n=9).replace("//\n", ""))
    good, bad = files.split_rejects(records.genbank_records(spark, str(tmp_path / "x.gb"), split))
    (tmp_path / "y.gb").write_text(text)
    plain = files.genbank(spark, str(tmp_path / "y.gb"))
    assert sorted(map(str, good.drop("offset", "file").collect())) == sorted(map(str, plain.drop("file").collect())) and plain.count() == 7
    assert sorted((r.accession, r.reject_reason) for r in bad.collect()) == [("", "accession"), ("X9", "end")]


def test_fasta_there_and_back(spark, tmp_path):
    df = spark.range(200).select(F.concat(F.lit("r"), "id").alias("header"), F.repeat(F.lit("ACGTN"), (F.col("id") % 90).cast("int") + 1).alias("seq"))
    files.write_fasta(df.repartition(3), str(tmp_path / "out"))
    back = records.fasta_records(spark, f"file://{tmp_path}/out", 777)
    assert sorted((r.header, r.seq) for r in back.where("reject_reason is null").collect()) == sorted(map(tuple, df.collect())) and back.count() == 200
    with pytest.raises(Exception, match="kind"):
        records.records(spark, str(tmp_path / "out"), "embl").collect()
