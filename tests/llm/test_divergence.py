"""Divergences of sources against loops over whole numbers, and the query against its SQL."""

import os
import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import SparkSession

os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"
from seqloom.llm import divergence as d  # noqa: E402

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, rank int, value int, shard int"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def brute(rows, least):
    """rows: (text, lang, source)."""
    counts, df, out = defaultdict(Counter), defaultdict(Counter), []
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        counts[lang or "", source or ""].update(found)
        df[lang or ""].update(set(found))
    for lang in df:
        kept = {t for t, n in df[lang].items() if n >= least}
        own = {s: {t: counts[lang, s][t] for t in kept} for x, s in counts if x == lang}
        p = {s: {t: 1 + 10**9 * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept} for s, n in own.items()}
        whole = {t: sum(n[t] for n in own.values()) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 2) // (sum(whole.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pair = [(s2, sum(f(p[s][t], p[s2][t]) for t in kept)) for s2 in own if s2 != s]
            term = [(t, f(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pair), ("term", term)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1) if part == "pair" or k <= 10]
    return sorted(out)


@pytest.mark.parametrize(("shard", "sources", "held"), [(500_000, 256, 1 << 21), (20, 2, 50)])
def test_divergences(spark, monkeypatch, shard, sources, held):
    """Hot and lone sources, languages without kept terms, nulls, empty and long texts, ties, repeated rows, clashing names."""
    r = np.random.default_rng(5)
    words = ["Ab", "b", "É", "éa", "x", "Zq", "ö", "ÀB", "q", "日本", "c", "d", "e", "f", "g"]
    rows = [(" ".join(words[k] for k in r.zipf(1.5, 30) % len(words)) + f" only{i}", "en" if i % 3 else "dé", f"s{i % 7}" if i % 2 else "hot") for i in range(150)]
    rows += [rows[0]] * 5 + [(None, "en", "empty"), ("", None, None), ("ab 1", None, "x"), (" , 12", "fr", "a"), ("mot", "fr", "b"), ("seul", "it", "one"), (" ".join(["Long b"] * 60_000), "en", "s1")]
    docs = spark.createDataFrame([(i, *x, 1, "clash", 2, 3, 4) for i, x in enumerate(rows)], SCHEMA).repartition(4)
    monkeypatch.setattr(d, "HELD", held)
    got = d.divergences(docs, least=5, shard=shard, sources=sources)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    want = brute(rows, 5)
    assert sorted(map(tuple, got.collect())) == want and {x[2] for x in want} == {"pair", "term"} and ("fr", "a", "pair", "b", 0, 1) in want


def test_empty(spark):
    assert d.divergences(spark.createDataFrame([], SCHEMA)).collect() == []


def test_share_is_exact():
    r = np.random.default_rng(1)
    for total in (0, 7, 10**6, 10**12, 2**52):
        count = r.integers(0, total + 1, 200)
        for kept in (1, 999):
            assert d.share(count, total, kept).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 2 * kept) for c in count]
    with pytest.raises(ValueError, match="exactly"):
        d.share(np.array([1]), 2**53, 1)


def test_query(spark):
    got = d.op13_source_divergence(spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(d.OP13_SQL).select(", ".join(got.columns)).fetchall())
