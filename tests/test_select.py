"""Selection of new queries against graphs in which every hit, and every row, is a node."""

import itertools

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom.operators import compare, curate, graph, hits, select

CHAINED = "query_acc string, subject_acc string, hsp_id string, q_start int, q_end int, sum_hits_alignlen long, sum_hits_score double"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def by_matrix(n, edges):
    """Clusters of one graph on a dense matrix of all its nodes."""
    m = np.eye(n)
    for a, b in edges:
        m[a, b] = m[b, a] = 1
    m /= m.sum(0)
    for _ in range(100):
        new = (m @ m) ** 2
        new /= new.sum(0)
        new = np.where((new >= 1e-3) | (new == new.max(0)), new, 0)
        change, m = abs(new - m).max(), new
        if change <= 1e-8 + 1e-5 * new.max():
            break
    return [min(i for i in range(n) if m[i, i] > 0 and m[i, j] > 0) for j in range(n)]


def chained(seed):
    """A hot query, most of whose hits are at two places; a query of three hits, and of two; one that was used up."""
    r = np.random.default_rng(seed)
    out = []
    for q, n in (("hot", 260), ("three", 3), ("two", 2), ("gone", 2)):
        for k in range(n):
            a = 10 if k % 3 == 0 else 400 if k % 3 == 1 else int(r.integers(1, 900))
            out.append((q, f"S-{q}-{k}" if q != "gone" else f"used{k}", f"{q}-{k:03}", a, a + (90 if k % 3 < 2 else int(r.integers(20, 300))), int(r.integers(50, 60)), float(r.integers(1, 90))))
    return [*out, ("hot", "used0", "hot-used", 11, 12, 99, 45.0)]


def test_every_hit_has_the_cluster_of_its_node(spark):
    rows = chained(1)
    used = {"used0", "used1"}
    df = spark.createDataFrame(rows, CHAINED).repartition(3)
    got = {r.hsp_id: (r.query_acc, r.cluster) for r in select.position_clusters(df, F.lit(1000), spark.createDataFrame([(u,) for u in used], "subject_acc string")).collect()}
    want = {}
    for q in ("hot", "three"):
        own = sorted((x for x in rows if x[0] == q and x[1] not in used), key=lambda x: x[2])
        low, high = np.quantile([x[6] for x in own], [0.25, 0.75])
        own = [x for x in own if low <= x[6] <= high]
        near = [(i, j) for (i, x), (j, y) in itertools.combinations(enumerate(own), 2) if (x[3] - y[3]) ** 2 + (x[4] - y[4]) ** 2 <= 100**2]
        want |= {own[j][2]: (q, own[i][2]) for j, i in enumerate(by_matrix(len(own), near))}
    lone = {k: v for k, v in got.items() if v[0] == "two"}
    assert {k: v for k, v in got.items() if v[0] != "two"} == want and len(lone) == 1 and all(k == v[1] for k, v in lone.items()) and len(want) > 100
    best = {(r.query_acc, r.cluster): r.hsp_id for r in select.position_representatives(df, F.lit(1000), spark.createDataFrame([(u,) for u in used], "subject_acc string")).collect()}
    told = {x[2]: x for x in rows}
    for c in set(got.values()):
        assert best[c] == min((h for h in got if got[h] == c), key=lambda h: (-told[h][5], told[h][6], h))
    assert set(best) == set(got.values())


def test_sequence_clusters(spark):
    r = np.random.default_rng(3)
    make = lambda n: ["".join(r.choice(list("ACGT-"), 12, p=[0.55, 0.2, 0.1, 0.1, 0.05])) for _ in range(n)]
    groups = {"big": make(30) + ["ACGTACGTACGT"] * 9 + ["AAAAAAAAAAAA"] * 40, "four": make(4), "five": ["AAAAAAAAAAAA"] * 5}
    rows = [(g, f"{g}{k:02}", s) for g, ss in groups.items() for k, s in enumerate(ss)]
    df = spark.createDataFrame(rows, "g string, accession string, seq string").repartition(3)
    got = {x.accession: x.cluster for x in select.sequence_clusters(df, "g").collect()}
    want = {a: a for g, a, _ in rows if g == "four"}
    for g in ("big", "five"):
        own = [(a, s) for x, a, s in rows if x == g]
        near = [(i, j) for (i, (_, s)), (j, (_, t)) in itertools.combinations(enumerate(own), 2) if sum(p != q for p, q in zip(s, t, strict=True)) <= 0.3 * 12]
        want |= {own[j][0]: own[i][0] for j, i in enumerate(by_matrix(len(own), near))}
    assert got == want and len(rows) == len(got)
    best = select.sequence_representatives(df, "g").collect()
    assert {(x.g, x.cluster) for x in best} == {(a[:-2], c) for a, c in got.items()} and sum(x.g == "four" for x in best) == 4


def test_quantiles_by_counts_in_ranges(spark):
    r = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in r.integers(0, 500, 4000)] + [("ties", 3.0)] * 50 + [("two", 1.0), ("two", 2.0), ("one", 7.0), ("null", None)] + [("hot", None)] * 3
    got = {x.g: list(x.q) for x in curate.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), "v", ["g"], [0.25, 0.5, 0.75], 8).collect()}
    want = {g: np.quantile([v for x, v in rows if x == g and v is not None], [0.25, 0.5, 0.75]).tolist() for g in ("hot", "ties", "two", "one")}
    assert got == {g: pytest.approx(q) for g, q in want.items()}


def test_place_classes_lose_no_edge(spark):
    df = spark.createDataFrame(chained(2), CHAINED)
    classed = hits.place_classes(df)
    assert classed.count() == df.count() and graph.DENSE >= classed.select("query_acc", "place").distinct().count()


def test_dense_groups_are_few_nodes(spark, monkeypatch):
    """Rows that are all near each other are one node, so their edges are never listed; a null is alone."""
    seen = []
    monkeypatch.setattr(select, "markov_clusters", lambda edges, nodes: seen.append((edges.count(), nodes.count(), nodes.agg({"n": "sum"}).first()[0])) or graph.markov_clusters(edges, nodes))
    rows = [("g", f"{c}{k:02}", c * 20 + f"{k:08b}".replace("0", "A").replace("1", "C")) for c in "GT" for k in range(40)] + [("g", "z", None)]
    got = {x.accession: x.cluster for x in select.near_clusters(spark.createDataFrame(rows, "g string, accession string, seq string"), "g", 0.3).collect()}
    assert got == {a: "z" if a == "z" else f"{a[0]}00" for _, a, _ in rows}
    assert seen == [(0, 2, 80)]


def test_large_graphs_without_edges(spark, monkeypatch):
    """Groups of many different neighbourhoods go to no list of edges, and are clustered as dense matrices of all rows are."""
    r = np.random.default_rng(8)
    rows = [("big", f"b{k:02}", "".join(r.choice(list("ACGT"), 12, p=[0.6, 0.2, 0.1, 0.1]))) for k in range(70)]
    rows += [("big", f"c{k:02}", rows[k][2]) for k in range(9)] + [("small", f"s{k}", "ACGT" * 3) for k in range(4)]
    df = spark.createDataFrame(rows, "g string, accession string, seq string").repartition(3)
    seen, made = [], compare.near_rows
    monkeypatch.setattr(compare, "near_rows", lambda rows, *a: seen.extend(x.g for x in rows.select("g").collect()) or made(rows, *a))
    monkeypatch.setattr(graph, "DENSE", 10)
    monkeypatch.setattr(graph, "BLOCK", 7)
    got = {x.accession: x.cluster for x in select.near_clusters(df, "g", 0.3).collect()}
    want = {}
    for g in ("big", "small"):
        own = sorted((a, s) for x, a, s in rows if x == g)
        near = [(i, j) for (i, (_, s)), (j, (_, t)) in itertools.combinations(enumerate(own), 2) if sum(p != q for p, q in zip(s, t, strict=True)) <= 0.3 * 12]
        want |= {own[j][0]: own[i][0] for j, i in enumerate(by_matrix(len(own), near))}
    assert got == want and len(set(want.values())) > 5 and seen == ["small"]
