"""The Merkle manifest against a tree built in a loop, and its query against its SQL."""

import hashlib
import os
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"
from seqloom.llm import manifest as m  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, kept int"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def beside(levels, at, fanout):
    out = []
    for nodes in levels[:-1]:
        a = at - at % fanout
        out.append(("".join(nodes[a:at]), "".join(nodes[at + 1 : a + fanout])))
        at //= fanout
    return out


def brute(rows, fanout):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    names, out = sorted(by, key=lambda k: (k is not None, (k or "").encode())), []
    for k in names:
        by[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in by[k]], fanout) for k in names]
    top = tree([t[-1][0] for t in trees], fanout)
    for n, k in enumerate(names):
        for i, r in enumerate(by[k]):
            sides = beside(trees[n], i, fanout) + beside(top, n, fanout)
            cut = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            h = leaf((*r[:4], r[4].replace("\n", ""))) if cut else leaf(r)
            for a, z in sides:
                h = sha(a + h + z)
            out.append((r[0], leaf(r), trees[n][-1][0], top[-1][0], sha("".join(a + z for a, z in sides)), h, h == top[-1][0]))
    return sorted(out, key=str)


def altered():
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


@pytest.mark.parametrize(("fanout", "height"), [(3, 0), (3, 1), (3, 7), (2, 2)])
def test_manifest(spark, fanout, height):
    """A hot group, lone and null ones, nulls in every column, empty and long texts, repeated rows, clashing columns."""
    rows = [(i, None if i % 7 == 0 else f"s{i * i % 11}" if i < 200 else "hot", "en", i, f"a\n{i}") for i in range(290)]
    rows += [(None, "hot", None, None, None)] * 3 + [(1, "é", "en", 1, "")] * 2 + [(2, "Z", None, None, "\n" * 99_999), (3, None, "", 0, "x" * 200_000)]
    docs = spark.createDataFrame([(*r, "own", 7) for r in rows], SCHEMA).repartition(5)
    out = m.manifest(docs, keep=("doc_id", "leaf"), changed={"text": altered()}, fanout=fanout, height=height, proofs=True)
    assert out.columns == ["doc_id", "kept_leaf", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
    told = out.withColumn("up", m.folded(F.col("leaf"), F.col("proof"))).collect()
    assert {r.kept_leaf for r in told} == {"own"} and all(r.up == r.root for r in told)
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((tuple(r[c] for c in names) for r in told), key=str) == brute(rows, fanout)


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = (sorted(map(tuple, m.manifest(docs.repartition(n), keep=("doc_id",), height=2).collect())) for n in (1, 9))
    assert one == many and all(r[-1] for r in one)


def test_empty_and_lone(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert m.manifest(none, keep=("doc_id",)).collect() == []
    (r,) = m.manifest(spark.createDataFrame([(1, "a", "en", 1, "t", "", 0)], SCHEMA), keep=("doc_id",)).collect()
    assert r.leaf == r.subroot == r.root == r.folded_root == leaf((1, "a", "en", 1, "t")) and r.proof_sha256 == sha("") and r.verified


def test_query(spark):
    got = m.op11_manifest(spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(m.OP11_SQL).select(", ".join(got.columns)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and {r[-1] for r in want} == {True, False}
