"""Queries of the training-data operators against their SQL in DuckDB."""

import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from seqloom.llm import registry, suffix_dedup  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.mark.parametrize("name", ["op1_decontaminate", "op5_suffix_dedup", "op10_warc_fixity"])
def test_query(spark, name):
    got, con = registry.queries()[name](spark, SF), duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = con.sql(registry.oracle_sql()[name]).select(", ".join(f'"{c}"' for c in got.columns)).fetchall()
    assert rows and sorted(map(tuple, got.collect())) == sorted(rows)


def test_suffix_dedup_sql_by_loops():
    """Spans that touch, overlap, and lie at a text's ends, beyond one piece of the SQL; nulls, empty and short texts."""
    one, two = bytes(range(65, 91)) * 2, "é" * 25
    texts = [(0, None), (1, ""), (2, one.decode() + two), (3, "zz" + two + one.decode() + "y" * 700), (4, "y" * 40), (5, "q" * 300 + one.decode()[:50] + two + "y" * 60), (6, "y" * 49)]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    first, want = {}, {}
    for i, t in texts:
        b = (t or "").encode()
        for a in range(len(b) - 49):
            first.setdefault(b[a : a + 50], i)
        gone = [any(first[b[a : a + 50]] < i for a in range(max(0, x - 49), min(x, len(b) - 50) + 1)) for x in range(len(b))]
        spans = sum(g and not (x and gone[x - 1]) for x, g in enumerate(gone))
        want[i] = (len(b), sum(gone), spans)
    got = {r[0]: r[1:4] for r in con.sql(suffix_dedup.OP5_SQL).fetchall()}
    assert got == want and sum(n for _, n, _ in want.values()) > 200
