"""What is sent and read again: no more than a step needs."""

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom.operators import genomes, hits
from seqloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def test_features_of_other_genomes_go_first(spark, monkeypatch):
    seen, renewed = [], genomes.renewed
    monkeypatch.setattr(genomes, "renewed", lambda a, b: seen.append(a.select("genome").distinct().count()) or renewed(a, b))
    assert catalog.QUERIES["species_gene_sequences"](spark, SF).count() > 0
    g = catalog.view(spark, SF, "genomes")
    chosen = genomes.newest_distinct(g.where(genomes.reject_reason(F.col("organism"), F.col("keywords")).isNull())).count()
    assert seen[0] <= chosen < g.count()


def test_only_hits_in_line_are_sent(spark):
    """A group's array holds what is in line with its seed; groups of null keys stay."""
    columns = "query_acc string, subject_acc string, hsp_id string, q_start int, q_end int, s_start int, s_end int, alignment_length int, n_identity int, bit_score double"
    rows = [("q", "s", "a", 10, 50, 110, 150, 41, 40, 9.0), ("q", "s", "b", 60, 90, 160, 190, 31, 30, 5.0), ("q", "s", "c", 60, 90, 190, 160, 31, 30, 6.0), (None, "s", "d", 1, 9, 1, 9, 9, 9, 1.0)]
    found = hits.chain(spark.createDataFrame(rows, columns), 1000, F.lit(1000))
    assert "collect_list(if" in found._jdf.queryExecution().optimizedPlan().toString().lower().replace("case when", "if")
    assert {(r.query_acc, r.hsp_id, r.q_start, r.q_end, r.hits_num) for r in found.collect()} == {("q", "a", 10, 90, 2), (None, "d", 1, 9, 1)}


def test_kept_records_are_made_once(spark):
    assert not any("documents" in f for f in catalog.QUERIES["marker_runs"](spark, SF).inputFiles())
