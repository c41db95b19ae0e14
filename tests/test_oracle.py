"""Every registered query of the library's own operators against its SQL in DuckDB, and hand-sized cases."""

import math
import os

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom.functions import bases, names
from seqloom.operators import graph, hits
from seqloom.plans import catalog
from seqloom.sources import files

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def canon(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return ""
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    out = catalog.queries()[name](spark, SF)
    cols = sorted(out.columns)
    got = [tuple(r[c] for c in cols) for r in out.collect()]
    assert got or name == "saturation"
    if sql := catalog.oracle_sql().get(name):
        con = duckdb.connect()
        for t in ("documents", "lineitem", "orders"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols
        assert canon(got) == canon(rel.select(*[f'"{c}"' for c in cols]).fetchall())


def test_chain_by_hand(spark):
    cols = "query_acc string, subject_acc string, hsp_id string, q_start int, q_end int, s_start int, s_end int, alignment_length int, n_identity int, bit_score double"
    rows = [("q", "s", "a", 100, 200, 1100, 1200, 101, 90, 50.0), ("q", "s", "b", 210, 300, 1210, 1300, 91, 80, 40.0), ("q", "s", "c", 310, 400, 5000, 5090, 91, 80, 30.0), ("q", "s", "d", 10, 90, 1300, 1220, 81, 70, 20.0)]
    r = hits.chain(spark.createDataFrame(rows, cols), 400, F.lit(400)).first()
    assert (r.s_start, r.s_end, r.hits_num, r.sum_hits_alignlen, r.q_end) == (1100, 1300, 3, 283, 300)


def test_markov_two_cliques(spark):
    e = [("g", a, b) for a, b in (("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d"))]
    got = {r.node: r.cluster for r in graph.markov_clusters(spark.createDataFrame(e, "graph_id string, i string, j string")).collect()}
    assert len({got[x] for x in "abc"}) == 1 and len({got[x] for x in "def"}) == 1 and got["a"] != got["f"]


def test_fasta_and_genbank(spark, tmp_path):
    (tmp_path / "x.fasta").write_text(">A1.1:5-9 one\nAC\nGT\n>B2|Order_Genus_sp|g|[1:3](+)\nTTT\n")
    assert {(r.header, r.seq) for r in files.fasta(spark, str(tmp_path / "x.fasta")).collect()} == {("A1.1:5-9 one", "ACGT"), ("B2|Order_Genus_sp|g|[1:3](+)", "TTT")}
    gb = 'LOCUS       X1   12 bp    DNA     circular PLN 05-MAR-2020\nACCESSION   X1\nKEYWORDS    .\n  ORGANISM  Rosa alba\n            Eukaryota.\nREFERENCE   1\n  JOURNAL   Unpublished\nREFERENCE   2\n  JOURNAL   Plant J. 1 (2)\nFEATURES             Location/Qualifiers\n     CDS             complement(join(1..3,7..9))\n                     /gene="rbcL"\n                     /product="a\n                     b"\nORIGIN\n        1 acgtacgtac gt\n//\n'
    (tmp_path / "x.gb").write_text(gb)
    r = files.genbank(spark, str(tmp_path / "x.gb")).first()
    assert (r.accession, r.organism, r.date, r.journals, r.seq, r.has_body) == ("X1", "Rosa alba", "05-MAR-2020", ["Plant J. 1 (2)"], "ACGTACGTACGT", True)
    f = r.features[0]
    assert (f.type, [(p.start, p.end, p.strand) for p in f.parts], {q.name: q.value for q in f.qualifiers}) == ("CDS", [(6, 9, -1), (0, 3, -1)], {"gene": "rbcL", "product": "a b"})


def test_small_functions(spark):
    r = spark.sql("SELECT 'ACGTR' AS s, 'gi|1|gb|AB1.1|A' AS h").select(bases.reverse_complement("s").alias("rc"), bases.kmer_index(F.lit("ACGT")).alias("k"), bases.expanded(F.lit("AR")).alias("x"), names.subject_of_hit(F.col("h")).alias("id"), bases.ends(F.lit("--AC-"))[0].alias("f")).first()
    assert (r.rc, r.k, r.x, r.id, r.f) == ("YACGT", 27, ["AA", "AG"], "AB1.1_A", 3)
