"""Many markers at once against one at a time, and the actions on aligned rows."""

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom.operators import curate, markers

RECORD = "marker string, accession string, header string, organism string, specimen_voucher string, journal string, date date, seq string"
HIT = "marker string, accession string, s_start int, s_end int, sum_hits_score double, source_round int"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def tables(spark):
    """Three markers, one with a third of all records and more; accessions occur in several."""
    r = np.random.default_rng(8)
    records, hits = [], []
    for m, n in (("hot", 60), ("b", 20), ("e", 1)):
        for k in range(n):
            seq = "".join(r.choice(list("ACGTN-"), 30, p=[0.25, 0.25, 0.2, 0.2, 0.05, 0.05]))
            bases = 30 - seq.count("-")
            records.append((m, f"A{k}", f"A{k}:11-{10 + bases}|x", f"Genus species{k % 7}", None if k % 3 else f"V{k}", "Plant J." if k % 2 else "Unpublished (2)", None, seq))
            hits.append((m, f"A{k}", 15, 6 + bases, float(r.integers(1, 9)), 1 + k % 2))
    return spark.createDataFrame(records, RECORD).repartition(3), spark.createDataFrame(hits, HIT)


@pytest.mark.parametrize("action", [markers.CONTROL, markers.REDUCE, markers.BOTH])
def test_as_one_marker_at_a_time(spark, action):
    records, hits = tables(spark)
    got = sorted(map(str, markers.run(records, hits, action, threshold=0.1).collect()))
    each = []
    for m in ("hot", "b", "e"):
        own, found = records.where(F.col("marker") == m), hits.where(F.col("marker") == m)
        if action == markers.REDUCE:  # without the marker in any key
            each += curate.reduced(own, found.select("accession", "sum_hits_score", "source_round")).select(*records.columns).collect()
        else:
            each += markers.run(own, found, action, threshold=0.1).select(*records.columns).collect()
    assert got == sorted(map(str, each)) and len(got) == (81 if action == markers.CONTROL else 7 + 7 + 1)


def test_control_keeps_rows_aligned_for_reduction(spark):
    rows = [("m", "a", "a:1-8|x", "o", None, None, None, "A----CGTACGT--"), ("m", "b", "b:1-9|x", "o", None, None, None, "ACGTACGTA-----"), ("m", "c", "c:1-9|x", "o", None, None, None, "CGTACGTA----A-")]
    hits = spark.createDataFrame([("m", "a", 2, 8, 1.0, 1), ("m", "b", 2, 8, 1.0, 1), ("m", "c", 1, 8, 1.0, 1)], HIT)
    records = spark.createDataFrame(rows, RECORD)
    from seqloom.operators.alignment import extension_controlled

    kept = {r.accession: (r.header, r.seq) for r in extension_controlled(records, hits.select("marker", "accession", "s_start", "s_end"), 0.5, ("marker",), aligned=True).collect()}
    assert kept == {"a": ("a:2-8|x", "-----CGTACGT--"), "b": ("b:1-9|x", "ACGTACGTA-----"), "c": ("c:1-8|x", "CGTACGTA------")}
    cut = {r.accession: r.seq for r in markers.run(records, hits, markers.CONTROL).collect()}
    assert cut == {a: s.replace("-", "") for a, (_, s) in kept.items()}
    with pytest.raises(ValueError, match="action"):
        markers.run(records, hits, 4)


def test_aggregated(spark, tmp_path):
    rows = [("m", "A1.1:2-9|Rosa_alba |g", "ACGT"), ("n", "B2|Rosa_canina", "GG"), ("n", "bare", "TT")]
    df = spark.createDataFrame(rows, "marker string, header string, seq string")
    sequences, table = markers.aggregated(df)
    assert sorted(map(tuple, sequences.collect())) == [("m", "Rosa_alba", "ACGT"), ("n", "Rosa_canina", "GG")]
    assert sorted(map(tuple, table.collect())) == [("m", "A1.1", "Rosa_alba"), ("n", "B2", "Rosa_canina")]
    markers.write_aggregated(df, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out/fasta/marker=m").glob("part*")) == ">Rosa_alba\nACGT\n"
    assert sorted(r.species for r in spark.read.option("header", True).csv(str(tmp_path / "out/tables")).collect()) == ["Rosa_alba", "Rosa_canina"]
